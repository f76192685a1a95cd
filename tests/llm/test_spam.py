"""Spam and what only looks like it."""

import random

from compare import ROOT

from meshloom.llm import spam as S

PAGES = "id long, url string, content string, ok boolean, lines string, from_url string"
LINKS = "from_url string, to_url string, lang string"
TEXT = {
    "en": "The relay on the hill answers every request that is sent to it. A new volunteer keeps a copy of the index while the others sleep, and it has been moved once.",
    "de": "Das Relais auf dem Hügel antwortet auf jede Anfrage. Die neue Gruppe speichert eine Kopie des Verzeichnisses, und sie wurde von Hand gebaut.",
    "fr": "Le relais sur la colline répond à chaque demande. La nouvelle équipe garde une copie de l'index, et elle a été déplacée depuis la tempête.",
    "ru": "Ретранслятор на холме отвечает на каждый запрос. Новая группа хранит копию указателя, и она была собрана вручную после бури.",
}


def judged(spark, contents, links=()):
    rows = [(i, f"n:/p{i}", c, True, "x", "y") for i, c in enumerate(contents)]
    found = S.spam_pages(spark.createDataFrame(rows, PAGES), spark.createDataFrame(list(links), LINKS))
    return {r.id for r in found.collect()}


def test_kinds(spark):
    rng = random.Random(1)
    words = "router panel cheap offer antenna coupon deal battery sale price".split()
    stuffed = " ".join(rng.choice(words) for _ in range(150))
    repeated = " ".join(rng.choice(["panel", "PANEL", "panels", "panel-deal", '"panel"', "cheap"]) for _ in range(120))
    tags = " · ".join(rng.choice(words) for _ in range(100))
    filler = " ".join(f"Router panel {w}bury. {w.title()} panel: cheap router." for w in "ash oak elm yew fir".split() * 8)
    bare_links = "\n".join(f"=> {rng.getrandbits(64):016x}:/page/a{k}.mu" for k in range(30))
    titles = "\n".join(f"* A walk through Town{k}" for k in range(30))
    readings = TEXT["en"] + "\n" + "\n".join(f"2025-01-{k + 1:02d} 12.{k} V {k} %" for k in range(25))
    explained = "\n".join(f"Town {k} - The relay on the hill answers every request that is sent to it." for k in range(20))
    contents_list = "\n".join(f"A quiet month in Town{k}" for k in range(12)) + "\n" + (TEXT["en"] + " ") * 6
    refrain = "\n".join(["The relay on the hill answers every request.", TEXT["en"]] * 6)
    tag_line = TEXT["en"] + "\nrouter, panel, cheap, offer, antenna, coupon"
    spam = [stuffed, repeated, tags, filler, bare_links, titles]
    fine = [readings, explained, contents_list, refrain, tag_line, *TEXT.values(), "(c) 2024 A Relay\nComing soon: Town\nThis page was visited 3 times", "", "   ", None]
    links = [(f"n:/p{k}", f"m:/q{j}", "") for k in (5, len(spam) + 2) for j in range(30)]
    assert judged(spark, spam + fine, links) == set(range(len(spam)))


def test_titles_without_links_are_no_list(spark):
    assert judged(spark, ["\n".join(f"* A walk through Town{k}" for k in range(30))]) == set()


def test_edges(spark):
    assert judged(spark, []) == set()
    long = "cheap panel offer router " * 40_000
    rows = [(1, "u", long, True, "", ""), (2, "u", long, False, "", ""), (3, None, long, None, "", ""), (4, None, long, True, "", "")]
    found = S.spam_pages(spark.createDataFrame(rows, PAGES), spark.createDataFrame([(None, None, None)], LINKS))
    assert {r.id for r in found.collect()} == {1, 4}


def test_share_on_the_tables(spark):
    from meshloom.sources.tables import read

    pages = read(spark, f"{ROOT}/sf0.01", "pages")
    n = S.spam_pages(pages, read(spark, f"{ROOT}/sf0.01", "links")).count()
    assert 0.01 < n / pages.count() < 0.1


def test_keywords_on_short_lines(spark):
    rng = random.Random(2)
    words = "router panel cheap offer antenna coupon deal battery sale price".split()
    same = "\n".join(["cheap lora antenna"] * 200)
    apart = "\n\n".join(["Cheap LoRa antenna!", "cheap lora-antenna", "* cheap lora antenna"] * 40)
    numbered = "\n".join(f"cheap lora antenna {k}" for k in range(60))
    one = "\n".join(rng.choice(words) for _ in range(120))
    few = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(2, 6))) for _ in range(60))
    tags = "\n".join(f"#{a}{b}" for a in words for b in ("world", "shop", "hut"))
    mixed = TEXT["en"] + "\n" + same
    readings = "\n".join(f"Station Hill {10 + k % 3}.{k} V {k} %" for k in range(30))
    volts = "\n".join(f"Station Hill {k} V" for k in range(30))
    names = "\n".join(f"{a}mar {b}berg" for a in ("Bri", "Cal", "Dor") for b in ("Korv", "Wexl", "Pell", "Sorr", "Vasqu"))
    refrain = "\n".join(["It is on the hill.", "We are with you.", "And so it was."] * 12)
    mostly = (TEXT["en"] + " ") * 4 + "\n" + "\n".join(["cheap lora antenna"] * 10)
    small = "Home\nFiles\nLinks"
    spam, fine = [same, apart, numbered, one, few, tags, mixed], [readings, volts, names, refrain, mostly, small]
    assert judged(spark, spam + fine) == set(range(len(spam)))


PROSE = {
    "Polish": "Wczoraj wieczorem poszliśmy z bratem na długi spacer wzdłuż rzeki, bo pogoda była wyjątkowo ładna. Na moście spotkaliśmy starego nauczyciela, który opowiedział nam o swoich podróżach.",
    "Finnish": "Eilen illalla kävelimme veljeni kanssa pitkään joen rantaa, koska sää oli poikkeuksellisen kaunis. Sillalla tapasimme vanhan opettajan, joka kertoi meille matkoistaan.",
    "Dutch": "Gisteravond maakten we met mijn broer een lange wandeling langs de rivier, omdat het weer bijzonder mooi was. Op de brug kwamen we een oude leraar tegen, die ons vertelde over zijn reizen.",
    "Italian": "Ieri sera abbiamo fatto con mio fratello una lunga passeggiata lungo il fiume, perché il tempo era davvero bello. Sul ponte abbiamo incontrato un vecchio maestro.",
    "Czech": "Včera večer jsme s bratrem šli na dlouhou procházku podél řeky, protože počasí bylo mimořádně hezké. Na mostě jsme potkali starého učitele, který nám vyprávěl o svých cestách.",
    "Ukrainian": "Учора ввечері ми з братом пішли на довгу прогулянку вздовж річки, бо погода була надзвичайно гарна. На мосту ми зустріли старого вчителя.",
    "Greek": "Χθες το βράδυ πήγαμε με τον αδελφό μου μια μεγάλη βόλτα κατά μήκος του ποταμού, επειδή ο καιρός ήταν πολύ καλός.",
    "Romanian": "Aseară am făcut cu fratele meu o plimbare lungă de-a lungul râului, pentru că vremea era deosebit de frumoasă.",
}


def test_prose_of_other_languages(spark):
    from meshloom.sources.tables import read

    corpus = read(spark, f"{ROOT}/sf0.001", "pages").select("id", "url", "content", "ok")
    rows = [(-k - 1, "u", f"{t}\n{t[: len(t) // 2]}", True) for k, t in enumerate(PROSE.values())]
    found = S.spam_pages(corpus.unionByName(spark.createDataFrame(rows, corpus.schema)), read(spark, f"{ROOT}/sf0.001", "links"))
    assert [list(PROSE)[-r.id - 1] for r in found.where("id < 0").collect()] == []


def test_limits_follow_the_language(spark):
    from meshloom.sources.tables import read

    c = S.SpamConfig(min_lines=30)
    limits = S.calibrate(S.line_figures(read(spark, f"{ROOT}/sf0.01", "pages").where("ok")), c)
    en, ru, fi = (S.LANGUAGES.index(x) for x in ("en", "ru", "fi"))
    assert limits.function[en] > 1.5 * limits.function[ru] and limits.function[fi] == min(limits.function) and len(limits.top) == len(S.LANGUAGES) + 1
    few = S.calibrate(S.line_figures(read(spark, f"{ROOT}/sf0.001", "pages").limit(0)), c)
    assert few.top[0] == c.fallback[1] and few.function[0] == c.fallback[0]


def test_links_with_and_without_words(spark):
    address = "0123456789abcdef0123456789abcdef:/page/a.mu"
    titled = "\n".join(f"The town by the river {address}" for _ in range(20))
    told = "\n".join(f"The relay on the hill answers every request that is sent to it, and a volunteer keeps a copy of the index: {address}" for _ in range(20))
    assert judged(spark, [titled, told]) == {0}


def test_a_short_list_of_linked_titles(spark):
    titles = "\n".join(f"* A walk through Town{k}" for k in range(7))
    assert judged(spark, [titles, titles], [("n:/p0", f"m:/q{k}", "") for k in range(7)]) == {0}
