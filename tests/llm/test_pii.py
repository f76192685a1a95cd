"""Personal information in its forms, what only looks like it, and the surrogates."""

import re

import pytest

from meshloom.llm import pii as P
from meshloom.llm import surrogates as S

HINTS = [("Ansel", "given"), ("Brida", "given"), ("Brimar", "given"), ("Calmar", "given"), ("Calda", "given"), ("Rose", "given"), ("Korvberg", "family"), ("Korvley", "family"), ("Wexlberg", "family"), ("Wexlley", "family"), ("Sorrova", "family"), (None, "given"), ("  ", "family")]
NAMES = P.Names(P.Parts.learn([h for h, k in HINTS if k == "given"]), P.Parts.learn([h for h, k in HINTS if k == "family"]))
DOCS = "doc_id long, text string, hit string"


def hits(text):
    return [(k, text[a:b]) for a, b, k in P.detect(text, NAMES)]


FOUND = [
    ("Write to a.b+c@example.org.", "email", "a.b+c@example.org"),
    ("mailto:X_Y@mail.example now", "email", "X_Y@mail.example"),
    ("reach kor-w (at) club.test, day", "email", "kor-w (at) club.test"),
    ("reach kor [at] club dot test, day", "email", "kor [at] club dot test"),
    ("reach korv.w at example dot org.", "email", "korv.w at example dot org"),
    *[(f"Call {p} soon", "phone", p) for p in ("+1 312 555 0176", "030/23125913", "312.555.0110", "01.99.00.22.80", "01 99 00 22 80", "+49 30 23125 453", "0049-30-23125-885", "(312) 555-0100", "14155550120", "+44 7700 900194", "07700 900 259", "+33 1 99 00 93 74", "808-555-0196")],
    *[(f"ID {p} (checked)", "id_number", p) for p in ("987-65-4388", "987652527", "XQ5354401", "28112482U", "58-209-6465-X", "ZZ 86 47 85 A", "00 741 299 509")],
    *[(f"Parcels go to {p}.", "address", p) for p in ("107 Oldivale Street, Falimoor 00157", "Flat 17, 156 Falsand Street, Harningholt", "100, rue du Norowheim, 00718 Velesmoor", "20 bis chemin de Velumvale, 00425 Thurowmere", "Calle de Kelobeck 167, 00686 Ismenstow", "Rua do Haldaford, 235, Sarnomouth", "Thuresleyweg 160, 00761 Breneldale", "Tarnostraße 203 c, 00605 Velarvale", "P.O. Box 193, Rosingstow 00549", "131b Birkeswick Road, Dunesheim")],
    *[(f"Signed, {p} Then more", "name", p) for p in ("Brimar Korvberg", "Calda Wexlley-Korvley", "KORVLEY, Brimar", "B. Wexlberg", "Brida M. Sorrova", "CALMAR KORVBERG", "Rose Sorrova", "Calmar Wexlova")],
    ('{"na": "Rose Korvley", "x": 1}', "name", "Rose Korvley"),
    ("Dr. Brida Korvley's meter", "name", "Brida Korvley"),
]


@pytest.mark.parametrize("text, kind, hit", FOUND)
def test_found(text, kind, hit):
    assert (kind, hit) in hits(text)


@pytest.mark.parametrize("text", [
    "Reach the mailbox as lxmf@9a8fabe6777f5ce2bb455f6e3de4ba31.", "Use the handle @relay_52 in the chat.", "Order 4471-17-50 left", "Part no. 17-1217-5", "Serial SN3713371337 is out",
    "Batch total: 25 577 2557 units", "Tune to 868.5825 MHz", "Firmware 56.59.8.75 is stable", "Logged at 2024-09-19 09:53:36.", "Grid square JN47qx, 47.471 north", "Ratio 15/45, offset -4515.",
    "The repeater on Morithberg Lane hums.", "The Eskithdale Avenue market opens at 5.", "Mark the frank answer in the log; a rose grew by the cliff.", "Korvberg climbed up to look.", "We met in Velesmoor.",
    "The announce hash is 4ea2adea929ce3686fa995b3ad4d31ac.", "1234567890123 0.000001 1,000,000", "", None,
])
def test_not_found(text):
    assert P.detect(text, NAMES) == []


@pytest.mark.parametrize("word", ["passport", "Passport:", "support", "Support:", "report", "airport", "transport", "apart", "subtotal", "document", "Desk:"])
def test_a_word_that_holds_another_hides_no_number(word):
    for number, kind in (("123456789", "id_number"), ("AB1234567", "id_number"), ("+1 555 123 4567", "phone"), ("+44 20 7946 0958", "phone")):
        assert hits(f"{word} {number}") == [(kind, number)]


@pytest.mark.parametrize("text", ["port 123456789", "Part AB1234567", "total: 123456789", "IBAN DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606"])
def test_numbers_of_other_kinds(text):
    assert hits(text) == []


def test_parts_are_learnt():
    assert {"korv", "wexl"} <= NAMES.family.stems and {"berg", "ley"} <= NAMES.family.endings
    none = P.Names(P.Parts.learn([]), P.Parts.learn([]))
    assert P.detect("Signed, Brimar Korvberg", none) == []


def test_entities_and_edges(spark):
    long = "no one here " * 50_000 + "a.b@example.org"
    rows = [(1, "x a.b@example.org", "clash"), (1, "x a.b@example.org", "clash"), (2, None, ""), (3, "", ""), (None, long, "")]
    got = [tuple(r) for r in P.entities(spark.createDataFrame(rows, DOCS), NAMES).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 17, "email", "a.b@example.org")] * 2 + [(None, 600_000, 600_015, "email", "a.b@example.org")], key=str)
    assert P.entities(spark.createDataFrame([], DOCS), NAMES).count() == 0
    hints = spark.createDataFrame(HINTS, "hint string, hint_kind string")
    assert P.learn_names(hints).family.stems == NAMES.family.stems


def test_surrogates_keep_form_and_identity(spark):
    text = "Signed, Brimar Korvberg (korv@example.org, 312.555.0110). KORVBERG, Brimar of 12 Oldi Road, Town 00157 met B. Korvberg and Brida Korvley."
    rows = [(1, text, ""), (2, "Brimar Korvberg again, 312-555-0110", ""), (3, None, ""), (4, "nothing", "")]
    out = {r.doc_id: r.text for r in P.redact(spark.createDataFrame(rows, DOCS), NAMES, "k").collect()}
    assert out[3] is None and out[4] == "nothing"
    one = re.findall(r"<(\w+):([^>]*)>", out[1])
    assert [k for k, _ in one] == ["name", "email", "phone", "name", "address", "name", "name"]
    given, family = one[0][1].split()
    assert one[3][1] == f"{family.upper()}, {given}" and one[5][1] == f"{given[0]}. {family}"  # the same person in other forms
    assert given[0] != "B" and given[-1] not in "aeiou" and family != "Korvberg" and re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", one[2][1])
    two = re.findall(r"<(\w+):([^>]*)>", out[2])
    assert two[0] == one[0] and re.sub(r"\D", "", two[1][1]) == re.sub(r"\D", "", one[2][1])
    other = {r.doc_id: r.text for r in P.redact(spark.createDataFrame(rows, DOCS), NAMES, "another key").collect()}
    assert other[1] != out[1]
    assert not any(x in out[1] for x in ("Korvberg", "korv@", "555.0110", "Oldi"))


def test_distinct_entities_stay_distinct(spark):
    # names of five letters have so few replacements that first choices collide
    rows = [(k, f"Signed, Brida {a}{b}ley", "") for k, (a, b) in enumerate((x, y) for x in "BCDFG" for y in ("a", "e", "i", "o", "u"))]
    names = P.Names(NAMES.given, P.Parts(frozenset(f"{a}{b}ley".lower() for a in "BCDFG" for b in "aeiou"), frozenset(), frozenset()))
    df = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r.text for r in P.redact(df, names, "k").collect()}
    assert len(set(out.values())) == len(rows)
    joined = {r.doc_id: r.text for r in P.redact(df, names, "k", broadcast_rows=0).collect()}
    assert joined == out


def test_widening_learns_from_the_corpus(spark):
    given = ["Brimar", "Brida", "Calmar", "Calda"]
    rows = [(k, f"Posted by Zelda {f}\nThanks to {given[k % 4]} Marvley and {given[k % 3]} Marvberg.", "") for k, f in enumerate(["Korvberg", "Wexlley", "Sorrova", "Korvley"] * 3)]
    wide = P.widen(NAMES, spark.createDataFrame(rows, DOCS))
    assert [x for x in ("Zelda Marvley", "A. Marvberg") if P.detect(x, wide)] == ["Zelda Marvley", "A. Marvberg"]
    assert not P.detect("A. Marvberg", NAMES)


def test_widening_reads_all_documents_and_keeps_all_words(spark):
    families = [f"{a}{b}{c}{d}berg" for a in "BCDFGHJKLM" for b in "aeiou" for c in "bcdfghjklmn" for d in ("ad", "em", "ik", "op", "ur", "az", "es", "il", "on", "ut")][:5200]
    rows = [(k, f"Thanks to {given} {f} today.", "") for k, (given, f) in enumerate((g, f) for f in families for g in ("Brimar", "Brida"))]
    rows += [(k, "The relay on the hill answers.", "") for k in range(len(rows), 20_200)]
    wide = P.widen(NAMES, spark.createDataFrame(rows, DOCS).repartition(4))
    assert [f for f in families if not P.detect(f"A. {f}", wide)] == []


def test_names_with_too_few_replacements_grow(spark, monkeypatch):
    rows = [(k, f"Signed, Brida {a}{b}", "") for k, (a, b) in enumerate((x, y) for x in "BCDFGHJKLMNPQRSTVWXZ" for y in "aeiou")]
    names = P.Names(NAMES.given, P.Parts(frozenset(t.split()[-1].lower() for _, t, _ in rows), frozenset(), frozenset()))
    df = spark.createDataFrame(rows, DOCS)
    out = [r.text for r in P.redact(df, names, "k").collect()]
    assert len(set(out)) == len(rows)
    real = {t.split()[-1] for _, t, _ in rows}
    assert not any(o.split()[-1].rstrip(">") in real for o in out)
    s = S.Surrogates("k")
    assert len(s.word("place", "town", S.PLAIN_ATTEMPTS + 30)) > 30 and len(s.component("mailbox", "al@b.c", S.PLAIN_ATTEMPTS + 3)) == 9
    monkeypatch.setattr(P, "ATTEMPTS", 0)
    with pytest.raises(RuntimeError):
        P.redact(df, names, "k")


def swapped(kind, *hits, names=NAMES, key="k"):
    s = S.Surrogates(key)
    return [P.replace(s, kind, h, names) for h in hits]


PEOPLE = P.Names(P.Parts.learn("Jo Al Anna Sarah John Jürgen Étienne Élise José María João Inês Иван Анна Юлия".split()), P.Parts.learn("Smith O'Brien Müller Petit García Gonçalves Петров Петрова Достоевский Достоевская".split()))


def test_ways_to_write_a_phone_number():
    forms = ["+44 20 7946 0958", "0044 20 7946 0958", "020 7946 0958", "+44 (0)20 7946 0958", "020-79460958"]
    out = swapped("phone", *forms)
    digits = [re.sub(r"\D", "", x) for x in out]
    assert len({d[-10:] for d in digits}) == 1 and digits[0][-10:] != "2079460958"
    assert [re.sub(r"\d", "0", x) for x in out] == [re.sub(r"\d", "0", x) for x in forms] and out[0].startswith("+44 ") and out[1].startswith("0044") and out[3].startswith("+44 (0)")
    for same in (["(212) 555-0123", "+1 212 555 0123", "1-212-555-0123", "12125550123"], ["8 (495) 123-45-67", "+7 495 123-45-67"], ["030/23125913", "+49 30 23125913", "0049-30-23125913"]):
        assert len({re.sub(r"\D", "", x)[-8:] for x in swapped("phone", *same)}) == 1


def test_ways_to_write_an_email():
    out = swapped("email", "john.doe@example.com", "john.doe [at] example [dot] com", "john.doe at example dot com", "JOHN.DOE@EXAMPLE.COM", "j.x@example.com", "john.doe@other.org")
    local, domain = out[0].split("@")
    assert out[1:4] == [f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local} at {domain.replace('.', ' dot ')}", out[0].upper()]
    assert out[4].endswith("@" + domain) and not out[5].startswith(local + "@") and domain.endswith(".com") and re.fullmatch("[a-z]{4}[.][a-z]{3}", local)
    assert "john" not in out[0] and "example" not in domain


def test_names_keep_initials_gender_and_script():
    for full, short in (("John Smith", "J. Smith"), ("Étienne Petit", "É. Petit"), ("Jürgen Müller", "J. Müller"), ("María García", "M. García"), ("João Gonçalves", "J. Gonçalves"), ("Иван Петров", "И. Петров")):
        a, b, back = swapped("name", full, short, f"{full.split()[1].upper()}, {full.split()[0]}", names=PEOPLE)
        given, family = a.split()
        assert b == f"{given[0]}. {family}" and back == f"{family.upper()}, {given}" and given[0] != full[0]
        assert S.script_of(a) == S.script_of(full) and not set(full.lower().split()) & set(a.lower().split())
    his, hers, hers2 = swapped("name", "Иван Петров", "Анна Петрова", "Юлия Достоевская", names=PEOPLE)
    assert hers.split()[1] == his.split()[1] + "а" and his.endswith("ов") and hers.split()[0][-1] in "ая" and hers2.endswith("ская") and his.split()[0][-1] not in "ая"
    for name in ("Anna", "Sarah", "Maria", "Inês"):
        (made,) = swapped("name", f"{name} Smith", names=PEOPLE)
        assert (made.split()[0][-1] == "a") == (name[-1] == "a")
    assert not any(x in " ".join(swapped("name", "Jo Smith", "Al Smith", names=PEOPLE)) for x in ("Jo", "Al", "Smith"))
    assert re.fullmatch(r"\w+ [A-Z]'[A-Z]?[a-z]+", swapped("name", "Anna O'Brien", names=PEOPLE)[0])


def test_addresses_keep_their_form():
    one, two, flat, french, german, box = swapped("address", "107 Oldivale Street, Falimoor 00157", "109 Oldivale Street, Falimoor 00157", "Flat 17, 156 Falsand Street, Falimoor", "20 bis rue du Norowheim, 00718 Velesmoor", "Thuresleyweg 160, 00761 Breneldale", "P.O. Box 193, Rosingstow 00549")
    m = re.fullmatch(r"(\d{3}) ([A-Z]\w+) Street, ([A-Z]\w+) (\d{5})", one)
    assert m and m[2] != "Oldivale" and m[3] != "Falimoor" and two[3:] == one[3:] and two[:3] != one[:3] and flat.endswith(f"Street, {m[3]}") and flat.startswith("Flat ")
    assert re.fullmatch(r"\d\d bis rue du [A-Z]\w+, \d{5} [A-Z]\w+", french) and re.fullmatch(r"[A-Z]\w+weg \d{3}, \d{5} [A-Z]\w+", german) and box.startswith("P.O. Box ")


@pytest.mark.parametrize("forms", [[f"{k:03d}" for k in range(1000)], [f"{a}{k}{b}" for a in "abcde" for b in "bcdfu" for k in range(10)], [str(k) for k in range(10)], [f"{k}-{a}" for k in range(10, 100) for a in "XYZ"]])
def test_permutations_keep_strings_apart(forms):
    s = S.Surrogates("k")
    out = [s.permuted("kind", x) for x in forms]
    assert len(set(out)) == len(forms) and [re.sub(r"\d", "0", x).isalpha() for x in out] == [re.sub(r"\d", "0", x).isalpha() for x in forms]
    assert all((a[0] == "0") == (b[0] == "0") for a, b in zip(forms, out))
    assert [s.permuted("kind", x, 1) for x in forms] != out and [S.Surrogates("l").permuted("kind", x) for x in forms] != out
