"""Keyed replacements of personal information: of the same type, script, form and gender, and the same wherever the same entity stands.

Every entity is parsed first, so all ways to write it share one canonical form: a phone number with or without its
country, an email with its signs spelled out, a name in capitals, in reverse or with initials. What carries the form
stays (signs, country codes, street types, connecting words, ends of domains), what identifies is replaced.
Numbers and mailboxes go through a keyed permutation of all strings of their form, so different ones stay different
by construction; words and names are made of keyed syllables, and ``pii.conflicts`` keeps them distinct over the corpus.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

#: Attempts after which made words grow by a letter each, and attempts in all.
PLAIN_ATTEMPTS, ATTEMPTS = 8, 40

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
_SOFT = {"latin": ("aeiou", "bdfgklmnprstv"), "cyrillic": ("аеиоу", "бвгдзклмнпрст")}
_INITIALS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя"}
#: Last letters that tell a name's gender alike, by script.
_ENDS = {"latin": ("a", "eiy", "ou"), "cyrillic": ("ая", "еиыйь", "оу")}
# Endings of family names of women, and of men.
_GENDERED = (("ская", "ский"), ("цкая", "цкий"), ("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"), ("ova", "ov"), ("eva", "ev"))
# Country codes of one and of two digits; all others have three.
_ONE, _TWO = "1 7", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
# Words of addresses that tell the form, not the place.
_FORM = frozenset(
    "street st road rd row lane avenue ave terrace close square court drive way mews place crescent gardens hill walk grove park quay alley "
    "rue chemin allée impasse boulevard quai route ruelle sentier cours calle avenida plaza camino paseo carrer ronda rua travessa praça estrada largo alameda beco "
    "straße strasse str weg gasse platz allee ring ufer damm steig hof улица ул проспект пер переулок дом д кв "
    "flat apt apartment unit suite room wohnung appartement appt piso apto box post office po p o postfach apartado correos caixa postal bp boîte postale абонентский ящик а я "
    "de la las los el du des del do da dos das d l n saint sankt bad new san santa le port são nova новый нижний bis ter".split()
)
_COMPOUND = re.compile(r"(.{2,}?)(straße|strasse|str|weg|gasse|platz|allee|ring|ufer|damm|steig|hof)$")
#: A word of an address.
PLACE_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_ADDRESS_PART = re.compile(r"\d+|[^\W\d_]+(?:['’\-][^\W\d_]+)*")
TOKEN_INITIAL = re.compile(r"^[^\W\d_]\.$")


def calling_code(digits: str) -> str:
    """The country code at the beginning of an international number."""
    return next((digits[:n] for n, known in ((1, _ONE), (2, _TWO)) if digits[:n] in known.split()), digits[:3])


def phone_parts(hit: str) -> tuple[str, str]:
    """What tells country and trunk, and the number within the country, which is the same in all ways to write it."""
    d = re.sub(r"\D", "", hit)
    abroad = 0 if hit.startswith("+") else 2 if d.startswith("00") else None
    if abroad is not None:
        skip = abroad + len(calling_code(d[abroad:]))
        skip += d[skip : skip + 1] == "0"
    else:
        skip = int(d[:1] == "0" or len(d) == 11 and d[:1] in "18")
    return d[:skip], d[skip:]


def email_parts(bare: str) -> tuple[str, str]:
    local, _, domain = bare.partition("@")
    return local, domain


def family_parts(low: str) -> tuple[str, str, str]:
    """Stem and ending of a family name, and the ending that men have."""
    for hers, his in _GENDERED:
        for end in (hers, his):
            if low.endswith(end) and len(low) > len(end) + 1:
                return low[: -len(end)], end, his
    return low, "", ""


def family_base(part: str) -> str:
    """The form that women and men of a name share."""
    stem, _, his = family_parts(part.lower().replace("’", "'"))
    return stem + his


def place_base(word: str) -> str | None:
    """What stands for the place in a word of an address: the word, its part before a street type, or none if it is a word of the form."""
    low = word.lower()
    if low in _FORM or len(low) == 1:
        return None
    m = _COMPOUND.match(low)
    return m[1] if m else low


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= ch <= "ӿ" for ch in word) else "latin"


def _plain(ch: str) -> str:
    return "й" if ch == "й" else unicodedata.normalize("NFD", ch)[0]


def in_case_of(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


class Surrogates:
    """Replacements derived from a key. ``others`` holds attempts of the components whose first replacement was taken."""

    def __init__(self, key: str, others: dict[tuple[str, str], int] | None = None):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.others = others or {}
        # one circle through all letters, so no initial stays and no two become one
        self.next_initial = {}
        for letters in _INITIALS.values():
            order = sorted(letters, key=lambda x: hashlib.blake2b(x.encode(), key=self.key).digest())
            self.next_initial |= dict(zip(order, order[1:] + order[:1]))

    def _attempt(self, kind: str, value: str, attempt: int | None) -> int:
        return self.others.get((kind, value), 0) if attempt is None else attempt

    def _stream(self, *what: object) -> Iterator[int]:
        block = 0
        while True:
            yield from hashlib.blake2b("\0".join(map(str, (*what, block))).encode(), key=self.key, digest_size=64).digest()
            block += 1

    # ------------------------------------------------------------ numbers and marks: a permutation of all strings of a form

    def permuted(self, kind: str, value: str, attempt: int = 0) -> str:
        """``value`` with digits, vowels and consonants replaced by such, by a keyed permutation of all strings of its form: a network of rounds that each add to
        one half what the other gives. A 0 at the beginning stays, and no other digit there becomes one."""
        pools = [self._pool(ch) for ch in value]
        free = [k for k, pool in enumerate(pools) if pool]
        if not free:
            return value
        cut = len(free) // 2
        size = lambda own: _product([len(pools[k]) for k in own])
        left, right = free[:cut], free[cut:]
        a_size, b_size = size(left), size(right)
        a, b = _number([(pools[k], value[k]) for k in left]), _number([(pools[k], value[k]) for k in right])
        led = pools[free[0]][0] == "0"
        while True:
            for n in range(8):
                if n % 2 or not left:
                    b = (b + self._draw(kind, value, free, attempt, n, a)) % b_size
                else:
                    a = (a + self._draw(kind, value, free, attempt, n, b)) % a_size
            digits = [*_letters(a, [pools[k] for k in left]), *_letters(b, [pools[k] for k in right])]
            if not led or (digits[0] == "0") == (value[free[0]] == "0"):  # else the permutation goes on until it is back among the strings it began with
                break
        out = list(value)
        for k, ch in zip(free, digits):
            out[k] = ch.upper() if value[k].isupper() else ch
        return "".join(out)

    def _draw(self, kind: str, value: str, free: list[int], attempt: int, n: int, other: int) -> int:
        form = "".join("x" if k in set(free) else ch for k, ch in enumerate(value))
        what = f"{kind}\0{form}\0{attempt}\0{n}\0{other}"
        return int.from_bytes(hashlib.blake2b(what.encode(), key=self.key, digest_size=32).digest(), "big")

    @staticmethod
    def _pool(ch: str) -> str:
        low = ch.lower()
        return "0123456789" if ch.isascii() and ch.isdigit() else _VOWELS if low in _VOWELS else _CONSONANTS if low in _CONSONANTS else ""

    # ------------------------------------------------------------ words and names: keyed syllables

    def word(self, kind: str, value: str, attempt: int, first: str = "", last: str = "") -> str:
        """A word of the script of ``value``: ``first`` begins it where given, ``last`` are the letters of which one ends it."""
        vowels, consonants = _SOFT[script_of(value)]
        stream = self._stream(kind, value, attempt)
        length = 4 + next(stream) % 4 + max(0, attempt - PLAIN_ATTEMPTS)
        out = first or consonants[next(stream) % len(consonants)]
        while len(out) < length:
            pool = consonants if out[-1] in vowels + "yыэюя" else vowels
            out += pool[next(stream) % len(pool)]
        if last:
            if (last[0] in vowels or last[0] in "яыйь") == (out[-1] in vowels):
                pool = consonants if out[-1] in vowels else vowels
                out += pool[next(stream) % len(pool)]
            out += last[next(stream) % len(last)]
        return out

    def given(self, low: str, attempt: int | None = None) -> str:
        """A given name of another initial, the same for all that share it, and with an ending that tells the same gender."""
        script = script_of(low)
        vowels, consonants = _SOFT[script]
        last = next((ends for ends in _ENDS[script] if _plain(low[-1]) in ends), consonants)
        last = "".join(ch for ch in last if ch in vowels) or last if last is not consonants else consonants
        return self.word("given", low, self._attempt("given", low, attempt), self.initial(low[0]), last)

    def family(self, base: str, attempt: int | None = None) -> str:
        stem, _, his = family_parts(base)
        before, mark, rest = stem.partition("'")
        made = self.word("family", base, self._attempt("family", base, attempt), last=_SOFT[script_of(base)][1] if his else "")
        return (self.initial(before[0]) + mark + made if mark and len(before) == 1 else made) + his

    def initial(self, letter: str) -> str:
        return self.next_initial.get(_plain(letter.lower()), self.next_initial["x"])

    # ------------------------------------------------------------ components, compared over the corpus

    def component(self, kind: str, value: str, attempt: int | None = None) -> str:
        """The replacement of one component by itself."""
        n = self._attempt(kind, value, attempt)
        if kind == "given":
            return self.given(value, n)
        if kind == "family":
            return self.family(value, n)
        if kind == "place":
            return self.word(kind, value, n)
        if kind == "mailbox":
            local, domain = email_parts(value)
            return self._grown(f"{kind}\0{domain}", local, n) + "@" + domain
        if kind == "domain":
            name, dot, top = value.rpartition(".")
            return self._grown(kind, name, n) + dot + top
        return self.permuted(kind, value, n)

    def _grown(self, kind: str, value: str, attempt: int) -> str:
        more = max(0, attempt - PLAIN_ATTEMPTS)  # where a form has too few replacements
        return self.permuted(kind, value + "a" * more, attempt)

    # ------------------------------------------------------------ entities as they stand in a text

    def phone(self, hit: str) -> str:
        lead, own = phone_parts(hit)
        return _filled(hit, lead + self.component("phone", own), str.isdigit)

    def id_number(self, hit: str, bare: str) -> str:
        return _filled(hit, self.component("id_number", bare), str.isalnum)

    def email(self, hit: str, bare: str, at: tuple[int, int], dots: re.Pattern) -> str:
        """The signs, written out or not, stay as they are."""
        local, domain = email_parts(bare)
        new_local = email_parts(self.component("mailbox", bare))[0]
        labels = self.component("domain", domain).split(".")
        tail, out, begin = hit[at[1] :], [], 0
        signs = [m.span() for m in dots.finditer(tail)]
        for (a, b), label, old in zip([*signs, (len(tail), len(tail))], labels, domain.split(".")):
            out += [in_case_of(label, tail[begin:a]) if tail[begin:a].isupper() else label, tail[a:b]]
            begin = b
        return (new_local.upper() if hit[: at[0]].isupper() else new_local) + hit[at[0] : at[1]] + "".join(out)

    def address(self, hit: str) -> str:
        """Street types, connecting words and the order of parts stay; places and numbers are replaced."""
        street = " ".join(w.lower() for w in PLACE_WORD.findall(hit))

        def new(m: re.Match) -> str:
            part = m[0]
            if part[0].isdigit():  # a house's number is replaced within its street, a postcode everywhere alike
                return self.permuted("post" if len(part) > 3 else f"house\0{street}", part)
            base = place_base(part)
            if base is None:
                return part if part.lower() in _FORM else self.permuted(f"letter\0{street}", part)
            return in_case_of(self.component("place", base), part) + part[len(base) :]

        return _ADDRESS_PART.sub(new, hit)

    def name_part(self, word: str, is_given: bool) -> str:
        """A given name with its hyphens, an initial, or a family name with its hyphens."""
        if TOKEN_INITIAL.match(word):
            return self.initial(word[0]).upper() + "."
        return "-".join(in_case_of(self._one(p, is_given), p) for p in word.split("-"))

    def _one(self, part: str, is_given: bool) -> str:
        low = part.lower().replace("’", "'")
        if is_given:
            return self.given(low)
        stem, end, his = family_parts(low)
        made = self.family(stem + his)
        return made[: len(made) - len(his)] + end


def _product(sizes: list[int]) -> int:
    out = 1
    for n in sizes:
        out *= n
    return out


def _number(letters: list[tuple[str, str]]) -> int:
    out = 0
    for pool, ch in letters:
        out = out * len(pool) + pool.index(ch.lower())
    return out


def _letters(number: int, pools: list[str]) -> list[str]:
    out = []
    for pool in reversed(pools):
        number, k = divmod(number, len(pool))
        out.append(pool[k])
    return out[::-1]


def _filled(hit: str, values: str, kind) -> str:
    """The characters of a kind in ``hit`` replaced by ``values``, one after the other; all others stay."""
    own = iter(values)
    return "".join(next(own) if kind(ch) else ch for ch in hit)
