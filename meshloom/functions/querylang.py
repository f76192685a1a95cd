"""The query language: bare words must all occur, quoted ones in a row, ``or`` gives alternatives, ``-`` excludes. Nothing is an error."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

_PART = re.compile(r'(-?)"([^"]*)"?|(\S+)')
_WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Factor:
    """Words in a row, or one word; ``excluded`` if they must not occur."""

    words: tuple[str, ...]
    excluded: bool = False


@dataclass(frozen=True)
class Query:
    """Alternatives, each a list of factors that must hold together."""

    alternatives: tuple[tuple[Factor, ...], ...]

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(w for a in self.alternatives for f in a for w in f.words))

    @property
    def wanted(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(w for a in self.alternatives for f in a if not f.excluded for w in f.words))

    @property
    def simple(self) -> str:
        """``any``: one wanted word an alternative; ``two``: two wanted words of one alternative; else ``other``. Only positive single words are simple."""
        plain = all(len(f.words) == 1 and not f.excluded for a in self.alternatives for f in a)
        if plain and self.alternatives and all(len(a) == 1 for a in self.alternatives):
            return "any"
        if plain and len(self.alternatives) == 1 and len(self.wanted) == 2 and len(self.alternatives[0]) == 2:
            return "two"
        return "other"


def parse(text: str | None, lexeme: Callable[[str], str | None] = lambda w: w) -> Query:
    """Reads a query; words that the analyzer drops are left out, and with them factors and alternatives that hold nothing else."""
    alternatives: list[list[Factor]] = [[]]
    for m in _PART.finditer((text or "").lower()):
        if m[3] is None:
            excluded, words = m[1] == "-", _WORD.findall(m[2])
        else:
            part = m[3]
            if part == "or":
                alternatives.append([])
                continue
            excluded = part.startswith("-")
            words = _WORD.findall(part)
        kept = tuple(x for x in (lexeme(w) for w in words) if x)
        if kept:
            alternatives[-1].append(Factor(kept, excluded))
    return Query(tuple(tuple(dict.fromkeys(a)) for a in alternatives if a))
