"""Languages on held-out rows, of mixed texts, and on the edges."""

from pyspark.sql import functions as F

from compare import ROOT

from meshloom.llm import langid as G
from meshloom.sources.tables import read

PAGES = "id long, lang string, content string, ok boolean, label string, parts string"
TEXT = {
    "en": "The relay on the hill answers every request that is sent to it, and a new volunteer keeps a copy of the index while the others sleep.",
    "de": "Das Relais auf dem Hügel antwortet auf jede Anfrage, und die neue Gruppe speichert eine Kopie des Verzeichnisses, obwohl es niemand bemerkt hat.",
    "fr": "Le relais sur la colline répond à chaque demande, et la nouvelle équipe garde une copie de l'index sans que personne ne le remarque.",
    "es": "El repetidor del cerro responde a cada petición, y el nuevo equipo guarda una copia del índice mientras los otros duermen por la noche.",
    "pt": "O repetidor do morro responde a cada pedido, e a nova equipe guarda uma cópia do índice enquanto os outros não chegam à margem.",
    "ru": "Ретранслятор на холме отвечает на каждый запрос, а новая группа хранит копию указателя, пока остальные спят.",
}


def machines(spark):
    if not hasattr(machines, "kept"):
        machines.kept = G.fit(read(spark, f"{ROOT}/sf0.01", "pages").where("ok"))
    return machines.kept


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "en-US": "en", "en_GB": "en", " English ": "en", "eng": "en", "Deutsch": "de", "de-AT": "de", "español": "es", "Russian": "ru", "pt-BR": "pt", "fra": "fr", "English (UK)": "en", "it": "other", "": None, None: None, "und": None, "Unknown": None, "??": None, "n/a": None}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, x string")
    got = [r[1] for r in df.select("i", G.label_language(F.col("x"))).orderBy("i").collect()]
    assert got == list(cases.values())


def test_held_out_documents(spark):
    """Trained on pages, tested on the labels of documents, which are missing or wrong in few."""
    docs = read(spark, f"{ROOT}/sf0.01", "documents").where(F.col("lang").isNotNull() & (F.length("text") > 200))
    pages = docs.select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("content"), F.lit(True).alias("ok"))
    rows = G.document_languages(pages, machines=machines(spark)).collect()
    assert len(rows) > 800 and sum(r.label == r.main for r in rows) / len(rows) > 0.93


def test_each_language_and_each_pair(spark):
    m, c = machines(spark), G.LangConfig()
    for lang, text in TEXT.items():
        (part,) = G.stretches(m, [text], c)[0]
        assert G.LANGUAGES[part[2]] == lang and part[3] > 0.9
    for a in TEXT:
        for b in TEXT:
            if a != b:
                got = [(G.LANGUAGES[p[2]]) for p in G.stretches(m, [f"{TEXT[a]} {TEXT[a]}\n{TEXT[b]}"], c)[0]]
                assert got == [a, b]


def test_stretches_cover_what_they_say(spark):
    text = f"{TEXT['en']}\n2025-01-01 12.0 V 40 %\n{TEXT['ru']} {TEXT['en']}"
    parts = G.stretches(machines(spark), [text], G.LangConfig())[0]
    assert [G.LANGUAGES[p[2]] for p in parts] == ["en", "ru", "en"]
    assert text[parts[1][0] : parts[1][1]].startswith("Ретранслятор") and all(0 <= p[0] < p[1] <= len(text) for p in parts)


def test_cases(spark):
    short = "sehr gut, danke"
    rows = [
        (1, "en", TEXT["en"], True), (2, "de", TEXT["en"], True), (3, None, TEXT["fr"], True), (4, "it", TEXT["es"], True), (5, "pt-BR", TEXT["pt"], True),
        (6, "en", f"{TEXT['en']} {TEXT['en']}\n{TEXT['de']}", True), (7, "en", f'{TEXT["en"]} "{short}" {TEXT["en"]}', True), (8, "de", TEXT["en"], False),
        (9, None, None, True), (10, None, "", True), (11, None, "12 34 — 56", True), (12, "unknown", TEXT["ru"] * 300, True), (13, "de", TEXT["en"], None), (14, "de", TEXT["en"], True),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    spam = spark.createDataFrame([(14,)], "id long")
    found = G.document_languages(df, machines=machines(spark)).join(spam, "id", "left_anti")
    case = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("main"))
    got = {tuple(r) for r in found.where(case).select("id", F.explode("langs")).collect()}
    assert got == {(2, "en"), (3, "fr"), (4, "es"), (6, "en"), (6, "de"), (12, "ru")}


def test_without_labelled_rows(spark):
    """Lists of function words alone tell the languages apart."""
    rows = [(k, None, text, True, "", "") for k, text in enumerate(TEXT.values())]
    df = spark.createDataFrame(rows, PAGES)
    got = {r.id: r.main for r in G.document_languages(df).collect()}
    assert got == dict(enumerate(TEXT))
    assert G.document_languages(spark.createDataFrame([], PAGES)).count() == 0


def test_other_languages_are_none_of_the_six(spark):
    from test_spam import PROSE

    rows = [(k, None, text, True, "", "") for k, text in enumerate(PROSE.values())] + [(90 + k, None, f"{text} {text}", True, "", "") for k, text in enumerate(TEXT.values())]
    got = {r.id: r.main for r in G.document_languages(spark.createDataFrame(rows, PAGES), machines=machines(spark)).collect()}
    assert {k: v for k, v in got.items() if k >= 90} == {90 + k: lang for k, lang in enumerate(TEXT)}
    assert {list(PROSE)[k] for k in got if k < 90} <= {"Czech"}  # most of whose short words others have too
