"""Repeated lines against brute force, on dirty fixtures and on the edges."""

import random
import unicodedata
from collections import Counter, defaultdict

from meshloom.llm import boilerplate as B

SCHEMA = "id long, url string, node_hash string, content string, source string, chunk long"


def key(line):
    return "".join(ch for ch in line.casefold() if ch.isalpha())


def brute(rows):
    total, seen = Counter(), defaultdict(set)
    for k, (_, url, node, content, *_rest) in enumerate(rows):
        if not content:
            continue
        site = (node or "").strip() or (url or "").split(":")[0]
        total[site] += 1
        for line in content.split("\n"):
            if key(line):
                seen[(site, key(line))].add(k)
    out = set()
    for _, (i, url, node, content, *_rest) in enumerate(rows):
        site = (node or "").strip() or (url or "").split(":")[0]
        for n, line in enumerate((content or "").split("\n"), 1):
            held = seen.get((site, key(line)), ())
            if key(line) and len(held) >= 5 and len(held) >= 0.1 * total[site]:
                out.add((i, n))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return {tuple(r) for r in B.repeated_lines(df).collect()}


def noisy(rng, line):
    way = rng.randrange(6)
    if way == 0:
        return line.upper()
    if way == 1:
        return line.replace(" ", "\u00a0") + "\t"
    if way == 2:
        return f"* {line} {rng.randrange(1000)} ──"
    if way == 3:
        return line[:3] + "\u00ad" + line[3:] + "\r"
    if way == 4:
        return line.title()
    return line


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = "relay mast Straße ёлка ключ naïve coax of the a b".split()
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        node = rng.choice(["n1", "n1", "n2", "n3", None])
        own = [noisy(rng, rng.choice(lines[: 12 if node == "n1" else 60])) for _ in range(rng.randrange(0, 9))] + [f"line {i} {rng.random()}", "", "12 34", "v 1", "v 2"][: rng.randrange(6)]
        rng.shuffle(own)
        rows.append((i, f"n9:/page/{i}.mu", node, rng.choice(["\n".join(own)] * 9 + [None])))
    assert found(spark, rows) == brute(rows)


def test_a_line_twice_in_a_page_counts_once(spark):
    rows = [(i, "n:/p", "n", "same line here\nsame line here") for i in range(4)]
    assert found(spark, rows) == set()
    assert len(found(spark, [*rows, (9, "n:/p", None, "Same, line here!")])) == 9


def test_edges(spark):
    long = "x" * 300_000 + " a long line of letters\n" * 3
    rows = [(i, None, None, long if i < 5 else "") for i in range(7)] + [(7, None, None, None), (8, "n:/a", " ", "1 2 3\n---")]
    assert found(spark, rows) == brute(rows)
    assert B.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_one_id_count_apart(spark):
    rows = [(1, "n:/p", "n", "the very same line of a page")] * 5
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    assert B.repeated_lines(df).count() == 5


def test_cut(spark):
    rows = [(i, "n:/p", "n", f"own {'abcdefgh'[i]}\nBoiler plate {i}\n\nlast {'abcdefgh'[i]}") for i in range(8)] + [(8, "n:/p", "n", None), (9, "n:/p", "n", "")]
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    got = {r.id: r.content for r in B.without_repeated_lines(df).collect()}
    assert got[0] == "own a\n\nlast a" and got[8] is None and got[9] == ""


def test_chunks_depend_on_a_lines_letters_alone():
    letters = B.Letters()
    line = "Please do not fetch more pages than you need from this slow relay"
    texts = [line, "other words before\n" + line.upper() + "\nafter", "x\n  " + unicodedata.normalize("NFC", line).replace(" ", "\u200b ")]
    text, number, chunk, a, b, of, chunks = B.line_chunks(letters, texts)
    at = [k for k in range(len(text)) if (text[k], number[k]) in {(0, 1), (1, 2), (2, 2)}]
    assert len(at) == 3 and len({(chunk[k], a[k], b[k]) for k in at}) == 1


def test_the_shuffle_join_gives_the_same(spark, monkeypatch):
    rows = [(i, "n:/p", "n" if i % 3 else None, f"Boiler plate {i}\nown text {'abcdefghijkl'[i]}\nBOILER-plate") for i in range(12)]
    want = found(spark, rows)
    monkeypatch.setattr(B, "BROADCAST_ROWS", -1)
    assert found(spark, rows) == want == brute(rows)


def test_chunks_of_a_text_wrapped_in_other_ways():
    notice = "This notice stands on every page of the society and asks all readers to sign the guestbook before the end of the season, whatever the weather on the ridge may be"
    words = notice.split()
    shapes = [notice, "\n".join(words), notice.upper().replace(" ", "  "), "\n".join([" ".join(words[:9]), " ".join(words[9:])]), "Another head\n" + notice + "\nAnd a tail"]
    out = [B.line_chunks(B.shared_letters(), [t]) for t in shapes]
    streams = [set(x[6].tolist()) for x in out]
    inner = streams[0] & streams[4]  # without the chunks at its ends
    assert len(inner) >= 3 and all(inner <= s for s in streams)
    assert out[0][2][0] in inner and out[2][2][0] == out[0][2][0] == out[4][2][1]


def test_every_line_has_its_chunk_in_its_document():
    rng = random.Random(5)
    texts = ["\n".join("".join(rng.choice("abcdefgh é\u200bÄß1 ") for _ in range(rng.randrange(0, 90))) for _ in range(rng.randrange(0, 12))) for _ in range(40)]
    text, number, chunk, a, b, of, chunks = B.line_chunks(B.shared_letters(), texts)
    held = set(zip(of.tolist(), chunks.tolist()))
    assert len(held) == len(of) and all((t, c) in held for t, c in zip(text.tolist(), chunk.tolist()))
    by_key = defaultdict(set)
    for c, x, y in zip(chunk.tolist(), a.tolist(), b.tolist()):
        by_key[x, y].add(c)
    assert all(len(v) == 1 for v in by_key.values())
