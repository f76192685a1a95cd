"""Words of fields with positions and weights, and an English stemmer.

The simple analyzer takes runs of ASCII letters and digits as they are; the English one drops stop words,
whose positions stay taken, and stems the rest by the published Porter2 rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokens

#: Weights of the four classes of fields: title, headings with anchors, description, content.
WEIGHTS = (1.0, 0.4, 0.2, 0.1)

# English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def weighted_words(title: Column, headings: Column, anchors: Column, description: Column, content: Column) -> Column:
    """``array<struct<lexeme, pos, w>>`` of a page: fields one after the other, positions counted on."""
    empty = F.lit("")
    second = F.concat(F.coalesce(headings, empty), F.lit(" "), F.coalesce(anchors, empty))
    fields = [tokens(F.coalesce(c, empty)) for c in (title, second, description, content)]
    parts, offset = [], F.lit(0)
    for words, w in zip(fields, WEIGHTS):
        parts.append(_placed(words, offset, w))
        offset = offset + F.size(words)
    return F.concat(*parts)


def _placed(words: Column, offset: Column, w: float) -> Column:
    return F.transform(words, lambda x, i: F.struct(x.alias("lexeme"), (offset + i + 1).alias("pos"), F.lit(w).alias("w")))


_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words that the published algorithm treats by themselves.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_UNCHANGED = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())
# Endings of the second and third step, longest first, and what replaces them.
_STEP_TWO = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP_THREE = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP_FOUR = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split(), key=len, reverse=True)


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(w, start)
        return m.end() if m else len(w)

    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or after(0)
    return first, after(first)


def _short(w: str) -> bool:
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case English word."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in _SPECIAL or word in _UNCHANGED:
        return _SPECIAL.get(word, word)
    w = re.sub(r"(?:^y|(?<=[aeiouy])y)", "Y", word)
    r1, r2 = _regions(w)
    # plural and past forms
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w.endswith("eed") or w.endswith("eedly"):
        end = 3 if w.endswith("eed") else 5
        if len(w) - end >= r1:
            w = w[:-end] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if re.search("[aeiouy]", w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif _short(w) and r1 >= len(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end, new in _STEP_TWO:
        if w.endswith(end):
            w = w[: -len(end)] + new if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP_THREE:
        if w.endswith(end):
            w = w[: -len(end)] + new if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP_FOUR:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def english(word: str) -> str | None:
    """The lexeme of a word, or null for a stop word."""
    return None if word in STOP_WORDS else stem(word)


def simple(word: str) -> str:
    """The word as it is."""
    return word


def lexemes(words: Column, lexeme: Callable[[str], str | None]) -> Column:
    """The lexemes of an array of words, null where a word has none; a worker works out each distinct word of a batch once."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batch: pd.Series) -> pd.Series:
        known = {w: lexeme(w) for w in {w for ws in batch if ws is not None for w in ws}}
        return batch.map(lambda ws: None if ws is None else [known[w] for w in ws])

    return run(words)
