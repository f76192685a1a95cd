"""Personal information in free text: found, and replaced by keyed surrogates.

Emails, phone and identity numbers and postal addresses are found by the forms they're written in;
names by the given and family names in use, of which hints are known: hints are parted into stems and
endings, and any known stem with any known ending is a name too. Every entity gets a replacement
derived from a key (``surrogates``); equal entities get equal replacements
wherever they stand, and a check over the whole corpus keeps different ones different.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .surrogates import ATTEMPTS, PLACE_WORD, Surrogates, email_parts, family_base, phone_parts, place_base

KINDS = ("email", "phone", "id_number", "address", "name")

_S = "[  ]"
_NOT_BEFORE = r"(?<![\w@+/.\-])"
_NOT_AFTER = r"(?![\w@]|[.\-/:]\d)"

# ---------------------------------------------------------------- emails

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_+\-])?"
_AT = rf"(?:{_S}?@{_S}?|{_S}?[\[({{<]{_S}?(?:at|AT|At|arroba|ARROBA|ät|собака){_S}?[\])}}>]{_S}?)"
_SPOKEN_AT = rf"{_S}(?:at|AT|arroba|ARROBA|собака){_S}"
_DOT = rf"(?:\.|{_S}?[\[({{]{_S}?(?:dot|DOT|punto|ponto|punkt|point|точка|\.){_S}?[\])}}]{_S}?|{_S}(?:dot|DOT|punto|ponto|punkt|точка){_S})"
_SPOKEN_DOT = _DOT.replace(r"(?:\.|", "(?:", 1)
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![\w.+%@\-])(?:{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}|{_LOCAL}{_SPOKEN_AT}{_LABEL}(?:{_SPOKEN_DOT}{_LABEL})*{_SPOKEN_DOT}[A-Za-z]{{2,}})(?![\w@])")
_EMAIL_HINT = re.compile(r"@|[\[({<]\s?(?:at|arroba|ät|собака)|\s(?:at|arroba|собака)\s.{1,60}(?:dot|punto|ponto|punkt|точка)", re.I)

# ---------------------------------------------------------------- phones and identity numbers

PHONE = re.compile(
    _NOT_BEFORE
    + "(?:"
    + "|".join(
        [
            rf"\+\d{{1,3}}(?:{_S}|[.\-/])?(?:\(0?\d{{1,4}}\)|\d{{1,5}})(?:(?:{_S}|[.\-/])?\d{{2,6}}){{1,5}}",
            r"00[1-9]\d(?:[ .\-/]?\d{1,6}){2,5}",
            rf"(?:1[ .\-])?\(\d{{3}}\){_S}?\d{{3}}[ .\-]\d{{4}}",
            r"(?:1[ .\-])?[2-9]\d{2}([ .\-])\d{3}\1\d{4}",
            r"1[2-9]\d{2}[2-9]\d{6}",
            r"0[1-9](?:([ .\-])\d{2})(?:\2\d{2}){3}",
            r"0[1-9]\d{1,4}/ ?\d{4,9}(?:[ \-]\d{1,4})?",
            r"07\d{3} ?\d{3} ?\d{3}",
            r"0[1-9]\d{1,3}[ \-]\d{6,8}",
            r"8[ \-]?\(\d{3}\)[ \-]?\d{3}[ \-]\d{2}[ \-]\d{2}",
        ]
    )
    + ")"
    + _NOT_AFTER
)
ID_NUMBER = re.compile(
    _NOT_BEFORE
    + "(?:"
    + "|".join(
        [
            r"\d{3}-\d{2}-\d{4}",
            r"\d{2}-\d{3}-\d{4}-[A-Z]",
            r"[A-Z]{2} \d{2} \d{2} \d{2} [A-Z]",
            r"[A-Z]{2}\d{6}[A-Z]",
            r"[A-Z]{2}\d{7}",
            r"\d{8}[ \-]?[A-Z]",
            r"[XYZ]\d{7}[A-Z]",
            r"\d{2} \d{3} \d{3} \d{3}",
            r"\d{9}",
        ]
    )
    + ")(?![\\w@]|[.\\-/:,]\\d|-[A-Z])"
)
_NUMBER_HINT = re.compile(r"\d(?:[\s().\-/]*\d){5}")
#: What stands before numbers that aren't personal: serial, order, part and version numbers and the like. Whole words, so that "port" isn't met in "passport".
_OTHER_NUMBER = re.compile(r"(?<!\w)(?:serial|order|part|batch|firmware|version|port|offset|ratio|grid|hash|total|sku|isbn|tune to|logged at|bestellung|seriennummer|teil|commande|pedido|pieza|peça|заказ|сери\w*)\b[^\n.;!?]{0,12}$", re.I)

#: Account numbers in groups of four, of which no part is a phone or identity number.
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")

# ---------------------------------------------------------------- addresses

_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’\-]+"
_PRE = r"(?:(?:Saint|St\.?|Sankt|Bad|New|San|Santa|Los|Las|La|Le|Port|São|Nova|Новый|Нижний) )?"
_TOWN = rf"{_PRE}{_CAP}"
_POST = r"\d{4,6}(?:-\d{3,4})?"
_GAP = r",[ \t ]*\n?[ \t ]*"
_TAIL = rf"{_GAP}(?:{_POST}{_S}{_TOWN}|{_TOWN}(?:,?{_S}{_POST}(?!\w))?)"
_NUMBER = rf"\d{{1,4}}(?:{_S}?[a-zA-Z](?![\w]))?(?:{_S}(?:bis|ter))?"
_FLAT = rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Wohnung|Appartement|Appt\.?|Piso|Apto\.?|кв\.){_S}\d{{1,4}}[a-zA-Z]?{_GAP})?"
_ENGLISH = "Street|St|Road|Rd|Row|Lane|Avenue|Ave|Terrace|Close|Square|Court|Drive|Way|Mews|Place|Crescent|Gardens|Hill|Walk|Grove|Park|Quay|Alley"
_FRENCH = "rue|chemin|avenue|allée|impasse|place|boulevard|quai|route|ruelle|sentier|cours|Rue|Chemin|Avenue|Allée|Impasse|Place|Boulevard|Quai|Route"
_IBERIAN = "Calle|Avenida|Plaza|Camino|Paseo|Carrer|Ronda|Rua|Travessa|Praça|Estrada|Largo|Alameda|Beco|calle|avenida|plaza|rua|travessa"
_OF = r"(?:de la |de los |de las |de l['’]|du |des |de |del |do |da |dos |das |d['’])?"
_GERMAN = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|ufer|damm|steig|hof"
ADDRESS = re.compile(
    r"(?<![\w.,\-/])(?:"
    + "|".join(
        [
            rf"{_FLAT}{_NUMBER},?{_S}{_CAP}(?:{_S}{_CAP})?{_S}(?:{_ENGLISH})\.?{_TAIL}",
            rf"{_FLAT}{_NUMBER},?{_S}(?:{_FRENCH}){_S}{_OF}{_CAP}(?:{_S}{_CAP})?{_TAIL}",
            rf"{_FLAT}(?:{_IBERIAN}){_S}{_OF}{_CAP}(?:{_S}{_CAP})?,?{_S}(?:n\.?º ?)?{_NUMBER}{_TAIL}",
            rf"{_FLAT}(?:[A-ZÄÖÜ][\w\-]*(?:{_GERMAN})|{_CAP}{_S}(?:Straße|Weg|Gasse|Platz|Allee)){_S}{_NUMBER}{_TAIL}",
            rf"(?:P\.?{_S}?O\.?{_S}?Box|Post Office Box|PO Box|Postfach|Apartado(?: de correos)?|Caixa Postal|BP|Boîte postale|Абонентский ящик|а/я){_S}\d{{1,6}}{_TAIL}",
            rf"(?:ул\.|улица|проспект|пер\.|переулок){_S}{_CAP}(?:{_S}{_CAP})?,?{_S}(?:д\.|дом)?{_S}?{_NUMBER}(?:,{_S}кв\.{_S}\d+)?{_TAIL}",
        ]
    )
    + ")"
)


# ---------------------------------------------------------------- names


@dataclass
class Parts:
    """The hints of one kind of name, and the stems and endings they're made of."""

    whole: frozenset[str]
    stems: frozenset[str]
    endings: frozenset[str]

    @classmethod
    def learn(cls, hints: list[str]) -> Parts:
        words = sorted({h.strip().lower() for h in hints if h and h.strip()})
        by_ending, by_stem = defaultdict(set), defaultdict(set)
        for w in words:
            for k in range(2, len(w) - 1):
                by_ending[w[k:]].add(w[:k])
                by_stem[w[:k]].add(w[k:])
        votes: Counter = Counter()
        for w in words:
            ways = [(min(len(by_ending[w[k:]]), len(by_stem[w[:k]])), len(by_ending[w[k:]]) * len(by_stem[w[:k]]), k) for k in range(2, len(w) - 1)]
            ways = [x for x in ways if x[0] >= 2]
            if ways:
                k = max(ways, key=lambda x: x[1])[2]
                votes[("e", w[k:])] += 1
                votes[("s", w[:k])] += 1
        stems = {x for (what, x), n in votes.items() if what == "s" and n >= 2}
        endings = {x for (what, x), n in votes.items() if what == "e" and n >= 2}
        for _ in range(3):  # a word with one known part gives away the other
            for w in words:
                known_end = next((w[k:] for k in range(2, len(w)) if w[k:] in endings), "")
                known_stem = next((w[:k] for k in range(len(w) - 2, 0, -1) if w[:k] in stems), "")
                if known_end and not known_stem:
                    stems.add(w[: -len(known_end)])
                elif known_stem and not known_end:
                    endings.add(w[len(known_stem) :])
        return cls(frozenset(words), frozenset(stems), frozenset(endings))

    def known(self, word: str) -> bool:
        w = word.lower()
        return w in self.whole or any(w[:-n] in self.stems and w[-n:] in self.endings for n in self._sizes)

    def likely(self, word: str) -> bool:
        """Has a known ending, or a known stem of some length and a short rest."""
        w = word.lower()
        ended = any(len(w) > n + 1 and w[-n:] in self.endings for n in self._sizes)
        return ended or any(w[:k] in self.stems for k in range(max(4, len(w) - 6), len(w) - 1))

    @cached_property
    def _sizes(self) -> tuple[int, ...]:
        return tuple(sorted({len(e) for e in self.endings}))


_UP = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_LOW = "a-zß-öø-ÿа-яё"
_NAME_WORD = rf"(?:[{_UP}](?:['’][{_UP}])?[{_LOW}]+(?:['’][{_UP}][{_LOW}]+)?|[{_UP}][{_UP}]+(?:['’][{_UP}]{{2,}})?)"
_FULL = rf"{_NAME_WORD}(?:-{_NAME_WORD})?"
_INITIAL = rf"[{_UP}]\."
#: Words of a name in their usual order, and in reverse with a comma.
_FORWARD = re.compile(rf"(?<![\w@\-])(?:{_FULL}|{_INITIAL})(?:{_S}?(?<=\.){_INITIAL}|{_S}(?:{_FULL}|{_INITIAL}))+(?![\w@])")
_REVERSE = re.compile(rf"(?<![\w@\-])({_FULL}),{_S}((?:{_FULL}|{_INITIAL})(?:{_S}{_INITIAL})*)(?![\w@])")
_TOKEN = re.compile(rf"{_FULL}|{_INITIAL}")


class Names:
    """Finds names made of a given and a family name, in either order, also with initials."""

    def __init__(self, given: Parts, family: Parts):
        self.given, self.family = given, family
        self._memo: dict[str, int] = {}

    def _class(self, word: str) -> int:
        """Bits: 1 given name, 2 family name, 4 like a given name, 8 like a family name, 16 initial."""
        found = self._memo.get(word)
        if found is None:
            if len(word) == 2 and word[1] == ".":
                found = 16
            else:
                parts = word.split("-")
                found = (
                    (1 if all(map(self.given.known, parts)) else 0)
                    | (2 if all(map(self.family.known, parts)) else 0)
                    | (4 if all(map(self.given.likely, parts)) else 0)
                    | (8 if all(map(self.family.likely, parts)) else 0)
                )
            if len(self._memo) > 200_000:
                self._memo.clear()
            self._memo[word] = found
        return found

    def find(self, text: str) -> list[tuple[int, int]]:
        out = []
        taken: list[tuple[int, int]] = []
        at = 0
        while m := _REVERSE.search(text, at):
            last, first = self._class(m[1]), [self._class(w) for w in _TOKEN.findall(m[2])]
            if last & 2 and (first[0] & 21) or last & 8 and first[0] & 1:
                out.append(m.span())
                taken.append(m.span())
                at = m.end()
            else:
                at = m.end(1)  # the word after the comma may begin a name itself
        for m in _FORWARD.finditer(text):
            tokens = [(t.start() + m.start(), t.end() + m.start(), self._class(t[0])) for t in _TOKEN.finditer(m[0])]
            k = 0
            while k < len(tokens):
                n = self._name_at(tokens, k)
                if n:
                    span = (tokens[k][0], tokens[k + n - 1][1])
                    if not any(a < span[1] and span[0] < b for a, b in taken):
                        out.append(span)
                    k += n
                else:
                    k += 1
        return out

    @staticmethod
    def _name_at(tokens: list[tuple[int, int, int]], k: int) -> int:
        """How many words from the k-th on are a name, 0 if none are: given name or initials, initials between, family name; or family name first."""
        kinds = [t[2] for t in tokens[k : k + 4]]
        if len(kinds) < 2:
            return 0
        if kinds[0] & 21:
            j = 1
            while j < len(kinds) and (kinds[j] & 16 or j == 1 and kinds[j] & 1 and not kinds[j] & 2 and j + 1 < len(kinds) and kinds[j + 1] & 2):
                j += 1
            if j < len(kinds):
                sure = any(x & 1 for x in kinds[:j])
                if kinds[j] & 2 or kinds[j] & 8 and sure:
                    return j + 1

        if kinds[0] & 2 and not kinds[0] & 1 and (kinds[1] & 1):
            return 3 if len(kinds) > 2 and kinds[2] & 16 else 2
        return 0


def learn_names(hints: DataFrame) -> Names:
    """From ``hint, hint_kind``; the hints are a list of bounded size. Null and blank hints are ignored, without hints no name is found."""
    rows = hints.select("hint", "hint_kind").where(F.col("hint").isNotNull()).distinct().collect()
    of = lambda kind: Parts.learn([r["hint"] for r in rows if r["hint_kind"] == kind])
    return Names(of("given"), of("family"))


def widen(names: Names, documents: DataFrame, text: str = "text") -> Names:
    """Learns further names from the words that stand beside known ones, counted over all documents.

    Every neighbour seen beside two or more different names takes part in learning. A capitalised word before known family names is a given name if it stands before several of them and seldom
    before given names, as a label would. Occurrences are counted before the shuffle; what is gathered is a list of words, not of occurrences.
    """
    shared = documents.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                for m in _FORWARD.finditer(t or ""):
                    tokens = _TOKEN.findall(m[0])
                    kinds = [n._class(w) for w in tokens]
                    for k in range(len(tokens) - 1):
                        word, after = tokens[k].lower(), tokens[k + 1].lower()
                        if kinds[k] & 1 and kinds[k + 1] & 8 and not kinds[k + 1] & 17:
                            out += [("family", w, word) for w in after.split("-")]
                        if not kinds[k] & 17 and kinds[k + 1] & 3:
                            out.append(("before", word, after if kinds[k + 1] & 2 else ""))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.string()) for j in range(3)], names=["kind", "word", "beside"])

    beside = documents.select(text).mapInArrow(run, "kind string, word string, beside string").groupBy("kind", "word")
    seen = beside.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.nullif("beside", F.lit(""))).alias("others"), F.count_if(F.col("beside") == "").alias("labels"))
    found = seen.where((F.col("n") >= 2) & (F.col("others") >= 2) & (2 * F.col("labels") < F.col("n"))).collect()
    of = lambda kind: [r["word"] for r in found if r["kind"] == kind]
    given = Parts.learn(list(names.given.whole))
    return Names(Parts(given.whole | frozenset(w for w in of("before") if w.isalpha()), given.stems, given.endings), Parts.learn([*names.family.whole, *of("family")]))


def detect(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """Start, end and kind of each item of personal information, in order; none overlap. Where two would, the earlier kind of ``KINDS`` stays."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if not any(a < end and start < b for a, b, _ in found):
            found.append((start, end, kind))

    if _EMAIL_HINT.search(text):
        for m in EMAIL.finditer(text):
            if not m[0].lower().startswith(("lxmf@", "mailto:")):
                add(*m.span(), "email")
    if any(ch.isdigit() for ch in text):
        addresses = [m.span() for m in ADDRESS.finditer(text)]
        numbers = _NUMBER_HINT.search(text) is not None  # six digits near each other, which all numbers sought have
        passed = addresses + [m.span() for m in _ACCOUNT.finditer(text)] if numbers else addresses
        inside = lambda a, b: any(x < b and a < y for x, y in passed)
        for m in PHONE.finditer(text) if numbers else ():
            if 8 <= sum(ch.isdigit() for ch in m[0]) <= 15 and not inside(*m.span()) and not _OTHER_NUMBER.search(text, max(0, m.start() - 30), m.start()):
                add(*m.span(), "phone")
        for m in ID_NUMBER.finditer(text) if numbers else ():
            if not inside(*m.span()) and not _OTHER_NUMBER.search(text, max(0, m.start() - 30), m.start()):
                add(*m.span(), "id_number")
        for a, b in addresses:
            add(a, b, "address")
    for a, b in names.find(text):
        add(a, b, "name")
    return sorted(found)


# ---------------------------------------------------------------- surrogates

#: Conflicts up to this number are broadcast, more are joined.
BROADCAST_ROWS = 300_000
#: Components with their attempts and replacements.
SPLIT = "kind string, value string, attempt int, new string"


def _is_given(word: str, hit: str, names: Names) -> bool:
    c = names._class(word)
    if c & 16 or (c & 1 and not c & 2):
        return True
    if c & 2:
        return False
    tokens = _TOKEN.findall(hit)
    return (word == tokens[-1]) if "," in hit else (word != tokens[-1])


_ANY_AT, _ANY_DOT = re.compile(rf"{_AT}|{_SPOKEN_AT}"), re.compile(_DOT)


def canonical(kind: str, hit: str) -> str:
    """One spelling for all forms in which the same entity is written; of phone numbers the part within the country."""
    if kind == "email":
        at = _ANY_AT.search(hit)
        return (hit[: at.start()] + "@" + _ANY_DOT.sub(".", hit[at.end() :])).lower()
    if kind == "phone":
        return phone_parts(hit)[1]
    if kind == "id_number":
        return re.sub(r"[^0-9A-Z]", "", hit.upper())
    return " ".join(hit.lower().split())


def components(kind: str, hit: str, names: Names) -> list[tuple[str, str]]:
    """What must stay distinct: a number, a mailbox and its domain, the words of a place, each part of a name."""
    if kind in ("phone", "id_number"):
        return [(kind, canonical(kind, hit))]
    if kind == "email":
        bare = canonical(kind, hit)
        return [("mailbox", bare), ("domain", email_parts(bare)[1])]
    if kind == "address":
        return [("place", base) for w in PLACE_WORD.findall(hit) if (base := place_base(w))]
    out = []
    for w in _TOKEN.findall(hit):
        if len(w) == 2 and w[1] == ".":
            continue
        given = _is_given(w, hit, names)
        out += [("given", p.lower().replace("’", "'")) if given else ("family", family_base(p)) for p in w.split("-")]
    return out


def replace(s: Surrogates, kind: str, hit: str, names: Names) -> str:
    """The surrogate of an item as it stands in a text."""
    if kind == "name":
        return _TOKEN.sub(lambda m: s.name_part(m[0], _is_given(m[0], hit, names)), hit)
    if kind == "phone":
        return s.phone(hit)
    if kind == "address":
        return s.address(hit)
    if kind == "email":
        return s.email(hit, canonical(kind, hit), _ANY_AT.search(hit).span(), _ANY_DOT)
    return s.id_number(hit, canonical(kind, hit))


def entities(documents: DataFrame, names: Names, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start, stop, kind, hit`` of each item found; ``text[start:stop]`` is the hit, in characters from 0.

    Null, empty and blank texts have none; repeated rows are searched each by itself, more columns are
    ignored, an empty table gives no row. Long texts are searched whole. Nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(names)  # the hints' stems and endings
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, stops, kinds, hits = [], [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for start, stop, what in detect(t, shared.value):
                    rows.append(k), starts.append(start), stops.append(stop), kinds.append(what), hits.append(t[start:stop])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(kinds, pa.string()), pa.array(hits, pa.string())], names=[key, "start", "stop", "kind", "hit"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, start int, stop int, kind string, hit string")


def conflicts(found: DataFrame, names: Names, secret: str) -> DataFrame:
    """``kind, value, attempt`` of the components whose first replacement another component has too, or that is a real one, with the attempt that is free.

    Components are compared over the whole corpus, by joins alone. Of those that want the same replacement the
    first by letters keeps it, the others try again, until all are distinct.
    """
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast((names, secret))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _ = shared.value
        for b in batches:
            own = {c for kind, hit in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in components(kind, hit, names)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([v for _, v in own], pa.string())], names=["kind", "value"])

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(shared.value[1])
        for b in batches:
            new = [s.component(k, v, n) for k, v, n in zip(*(b.column(j).to_pylist() for j in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["kind", "value", "attempt", "new"])

    parts = found.select("kind", "hit").distinct().mapInArrow(split, "kind string, value string").distinct()
    made = materialise(parts.withColumn("attempt", F.lit(0)).mapInArrow(replaced, SPLIT))
    real = made.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
    for _ in range(ATTEMPTS):  # words grow with the attempts, so none is left without a replacement unless something is wrong
        keeps = made.groupBy("kind", "new").agg(F.min("value").alias("keeps"), F.count(F.lit(1)).alias("n"))
        clash = keeps.join(real, ["kind", "new"], "left").where((F.col("n") > 1) | F.col("real"))
        losers = materialise(made.join(clash, ["kind", "new"]).where((F.col("value") != F.col("keeps")) | F.col("real")).select("kind", "value"))
        if losers.isEmpty():
            return made.where("attempt > 0").drop("new")
        # only those that lost are worked out anew
        other = made.join(losers, ["kind", "value"]).select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(replaced, SPLIT)
        made = materialise(made.join(losers, ["kind", "value"], "left_anti").unionByName(other))
    raise RuntimeError(f"after {ATTEMPTS} attempts some surrogates aren't distinct yet")


def redact(documents: DataFrame, names: Names, secret: str, template: str = "<{kind}:{surrogate}>", key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``key, text`` of every document, each item found replaced by a placeholder of its kind that holds its surrogate. Null stays null, the rest of the text as it is.

    Texts are searched once: what was found is written beside them. Most surrogates follow from the key alone. The few components in
    conflict are broadcast, or, if they're more than ``broadcast_rows``, joined to the documents that hold them.
    """
    spark = documents.sparkSession
    names_there = spark.sparkContext.broadcast(names)
    kind_of_key = documents.schema[key].dataType.simpleString()
    item = "start:int,stop:int,kind:string,hit:string"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[(x, y, k, t[x:y]) for x, y, k in detect(t, names_there.value)] for t in b.column(1).to_pylist()]
            flat = [x for xs in found for x in xs]
            columns = [pa.array([x[j] for x in flat], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=["start", "stop", "kind", "hit"]))], names=["key", "text", "found"])

    searched = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(search, f"key {kind_of_key}, text string, found array<struct<{item}>>")
    searched = materialise(searched.withColumn("row", F.monotonically_increasing_id()))
    others = conflicts(searched.select(F.inline("found")), names, secret)
    few = others.count() <= broadcast_rows
    known = {(r["kind"], r["value"]): r["attempt"] for r in others.collect()} if few else {}
    shared = spark.sparkContext.broadcast((secret, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret, known = shared.value
        s = Surrogates(secret, known)
        for b in batches:
            own = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            out = []
            for t, found, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), own):
                if more is not None:
                    s.others = {(m["kind"], m["value"]): m["attempt"] for m in more}
                pieces, at = [], 0
                for x in found:
                    pieces += [t[at : x["start"]], template.format(kind=x["kind"], surrogate=replace(s, x["kind"], x["hit"], names_there.value))]
                    at = x["stop"]
                out.append(None if t is None else "".join(pieces) + t[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    schema = f"`{key}` {kind_of_key}, text string"
    if few:
        return searched.select("key", "text", "found").mapInArrow(run, schema)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [{c for x in found for c in components(x["kind"], x["hit"], names_there.value)} for found in b.column(1).to_pylist()]
            at, flat = [k for k, cs in enumerate(each) for _ in cs], [c for cs in each for c in cs]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string())], names=["row", "kind", "value"])

    wanted = searched.select("row", "found").mapInArrow(held, "row bigint, kind string, value string").join(others, ["kind", "value"])
    per_row = wanted.groupBy("row").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("more"))
    none = F.array().cast("array<struct<kind:string,value:string,attempt:int>>")
    return searched.join(per_row, "row", "left").select("key", "text", "found", F.coalesce("more", none).alias("more")).mapInArrow(run, schema)
