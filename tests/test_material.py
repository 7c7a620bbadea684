"""Headings, exercises, requests, vocabulary, page layout, policies and providers on cases whose results are known."""

import random

import pytest
from pyspark.sql import functions as F

from veredas.functions import headings, ranking, study
from veredas.operators import layout, proficiency, providers
from veredas.sources import readers

BOOK = "TEMPORADA 11: Soluções e misturas\nUma introdução ao tema desta temporada.\nEPISÓDIO 01 – O que é uma solução? Texto do episódio. 1.1 Soluto: Dissolve-se no solvente.\n1.2 Solvente. Dissolve o soluto.\nCapítulo 2: 1. Calcule a massa do soluto. a) um b) dois c) três d) quatro\n"


@pytest.fixture(scope="module")
def book(spark):
    df = spark.createDataFrame([(1, BOOK), (2, "Só um texto sem nada mais."), (3, None), (4, "")], "id int, text string")
    return {(r["id"], r["position"]): r for r in headings.sections(df, "id", "text").collect()}


def test_sections(book):
    assert sorted(book) == [(1, 0), (1, 1), (1, 2), (2, 0), (4, 0)]
    assert [(book[1, i]["kind"], book[1, i]["number"], book[1, i]["title"]) for i in range(3)] == [("SECTION", None, "Introdução"), ("EPISODE", "01", "O que é uma solução"), ("CHAPTER", "2", "Chapter 2")]
    assert book[2, 0]["lines"] == ["Só um texto sem nada mais."] and book[4, 0]["lines"] == []


def test_subsections(book):
    assert book[1, 1]["lines"] == ["? Texto do episódio.", "## 1.1 Soluto", ": Dissolve-se no solvente.", "## 1.2 Solvente", ". Dissolve o soluto."]


def test_season(spark):
    row = spark.range(1).select(headings.season(F.lit(BOOK)).alias("a"), headings.season(F.lit("x")).alias("b")).first()
    assert (row["a"]["number"], row["a"]["title"], row["b"]) == (11, "Soluções e misturas", None)


@pytest.mark.parametrize("text,want", [
    ("1. Calcule a massa do soluto. a) um b) dois c) três d) quatro", [(1, "Calcule a massa do soluto.", ["a) um", "b) dois", "c) três", "d) quatro"], False)]),
    ("1. Calcule a massa do soluto. a) um b) dois", [(1, "Calcule a massa do soluto.", ["a) um", "b) dois"], True)]),
    ("1) Uma pergunta sem opções aqui.\n02. Outra pergunta, também sem.", [(1, "Uma pergunta sem opções aqui.", [], False), (2, "Outra pergunta, também sem.", [], False)]),
    ("1. Fora de ordem: b) um a) dois nesta", [(1, "Fora de ordem: b) um a) dois nesta", [], False)]),
    ("1. Curto.", []), ("nada", []), (None, []), ("", []),
])
def test_exercises(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, body string")
    assert [tuple(r)[2:] for r in headings.exercises(df, ["id"], "body").orderBy("at").collect()] == want


@pytest.mark.parametrize("text,want", [
    ("Quero estudar  Química no ensino médio", ("STUDY", "Química", "Ensino Médio", "MEDIUM", "MATERIAL")),
    ("hoje quero praticar álgebra fácil", ("PRACTICE", "Matemática", "Ensino Fundamental", "EASY", "QUESTION")),
    ("video de revolução industrial avançado", ("SEARCH", "História", "Ensino Fundamental", "HARD", "VIDEO")),
    ("naoquero estudar", ("SEARCH", "Geral", "Ensino Fundamental", "MEDIUM", "ALL")),
    (None, ("SEARCH", "Geral", "Ensino Fundamental", "MEDIUM", "ALL")), ("  ", ("SEARCH", "Geral", "Ensino Fundamental", "MEDIUM", "ALL")),
])
def test_request(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "q string").select(study.request(F.col("q")).alias("r")).first()["r"]) == want


def test_vocabulary(spark):
    entry = study.Vocabulary("C1", ("Soluções",), ("concentração molar", "Concentrações molares"), ("massa do soluto",), ("química",))
    texts = ["A química das soluções", "só química", "concentração molar e massa do soluto", None]
    rows = [r["m"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(study.vocabulary_match(F.col("t"), entry).alias("m")).collect()]
    assert (rows[0]["primary"], rows[0]["generic_ignored"], rows[0]["score"]) == (["Soluções"], ["química"], 60)
    assert rows[1] is None and rows[3] is None
    assert (rows[2]["specific"], rows[2]["contextual"], rows[2]["score"]) == (["concentração molar"], ["massa do soluto"], 90)


def rows_of(lines):
    """Rows of lines by the rule, one page at a time."""
    rows = []
    for x, y0, y1, i in sorted(lines, key=lambda z: (z[1], z[0], z[3])):
        if rows:
            top, bottom, low = min(r[1] for r in rows[-1]), max(r[2] for r in rows[-1]), min(r[2] - r[1] for r in rows[-1])
            short = min(low, y1 - y0)
            if short > 0 and (min(y1, bottom) - max(y0, top)) / short >= 0.5:
                rows[-1].append((x, y0, y1, i))
                continue
        rows.append([(x, y0, y1, i)])
    return [line[3] for row in rows for line in sorted(row, key=lambda z: (z[0], z[1], z[3]))]


def test_reading_order(spark):
    rng = random.Random(3)
    pages = {p: [(float(rng.randrange(8) * 10), float(y := rng.randrange(200)), float(y + rng.randrange(0, 30)), i) for i in range(rng.choice((1, 7, 60)))] for p in range(20)}
    df = spark.createDataFrame([(p, *line) for p, ls in pages.items() for line in ls], "p int, x0 double, y0 double, y1 double, id int")
    found: dict[int, list] = {}
    for r in layout.reading_order(df, ["p"], ["id"]).orderBy("p", "place").collect():
        found.setdefault(r["p"], []).append(r["id"])
    assert found == {p: rows_of(ls) for p, ls in pages.items()}


def test_two_columns(spark):
    two = [(1, x, 20.0 * i, 20.0 * i + 10, int(x) * 100 + i) for x in (10.0, 300.0) for i in range(5)]
    one = [(2, 10.0 + i % 2, 20.0 * i, 20.0 * i + 10, i) for i in range(8)]
    apart = [(3, x, at + 20.0 * i, at + 20.0 * i + 10, int(x) * 100 + i) for x, at in ((10.0, 0.0), (300.0, 400.0)) for i in range(5)]
    df = spark.createDataFrame(two + one + apart, "p int, x0 double, y0 double, y1 double, id int").withColumn("width", F.lit(500.0))
    assert [tuple(r) for r in layout.column_splits(df, ["p"], "width").collect()] == [(1, 155.0)]
    rows = layout.reading_order(df, ["p"], ["id"], columns=True, width="width").filter("p = 1").orderBy("place").collect()
    assert [r["id"] for r in rows] == [z[4] for z in two]


def test_policies(spark):
    t, no = F.lit(True), F.lit(False)
    row = spark.range(1).select(
        ranking.resource_score(t, t, F.lit("AUTHOR"), t, F.lit("theory"), no).alias("all"), ranking.resource_score(no, F.lit(None).cast("boolean"), F.lit(None), no, F.lit(None), t).alias("none"),
        ranking.resource_score(t, no, F.lit("X"), no, F.lit("X"), no, ranking.ResourcePolicy(direct=7.0, other_role=0.0)).alias("own"),
        ranking.video_score(t, t, t, F.lit("school"), F.lit("EASY"), F.lit("EASY"), F.lit(200), F.lit(50), no, F.lit("liked"), F.lit("too_fast"), F.lit("Um Exemplo"), {"TOO_FAST": F.lit(1), "TOO_BASIC": F.lit(2), "NEEDS_EXAMPLES": F.lit(1)}).alias("video"),
        ranking.video_score(no, no, no, F.lit(None), F.lit(None), F.lit("EASY"), F.lit(2000), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None), {}).alias("bare"),
    ).first()
    assert tuple(row) == (100.0, -38.0, 7.0, 35.0 + 25 + 20 + 20 + 10 + 20 + 30 - 30 - 30 - 40 + 25, 0.0)


def test_another_estimator(spark):
    class Certain:
        def score(self, hit, difficulty):
            return F.max(F.when(hit, 100.0).otherwise(0.0))

        def confidence(self):
            return F.lit(1.0)

    df = spark.createDataFrame([("a", True, "EASY"), ("a", False, "HARD"), ("a", None, "HARD"), ("b", False, "EASY")], "s string, hit boolean, level string")
    simple = {r["s"]: r for r in proficiency.coverage(proficiency.estimates(df, ["s"], "hit", "level")).collect()}
    assert (simple["a"]["score"], simple["a"]["confidence"], simple["a"]["status"], simple["b"]["status"]) == (26.32, 0.3, "IN_PROGRESS", "INSUFFICIENT_EVIDENCE")
    other = {r["s"]: r for r in proficiency.coverage(proficiency.estimates(df, ["s"], "hit", "level", Certain()), proficiency.CoveragePolicy(evidence=1, difficulties=1)).collect()}
    assert (other["a"]["score"], other["a"]["band"], other["b"]["status"], other["b"]["investigate"]) == (100.0, "CONSOLIDATED_MASTERY", "POSSIBLE_GAP", True)


def test_providers(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "a", None), (4, "b", "other")], "i int, prompt string, task string")
    own = providers.fake()
    assert [r["out"] for r in providers.answers(df, "prompt", "out", own).orderBy("i").collect()] == [own(["a"])[0], None, own(["a"])[0], own(["b"])[0]]
    by = {"x": providers.fake("x"), "y": providers.fake("y")}
    got = [r["out"] for r in providers.routed(df, "prompt", "task", "out", by, "y").orderBy("i").collect()]
    assert [g and g[0] for g in got] == ["x", None, "y", "y"]
    label = df.select(providers.keyword_classifier(F.col("prompt"), {"A": ["A"], "B": ["b"]}, "?").alias("l"))
    assert [r["l"] for r in label.collect()] == ["A", "?", "A", "B"]


def test_running_lines(spark):
    rows = [("d", p, t, y, y + 8.0) for p in range(4) for t, y in (("PROVA 2026", 2.0), ("abc", 2.0), (f"page {p}", 190.0), ("in the text", 100.0))]
    df = spark.createDataFrame([*rows, ("d", 9, "PROVA 2026", 100.0, 108.0), ("e", 1, "PROVA 2026", 2.0, 10.0), ("e", 2, None, 2.0, 10.0)], "doc string, page int, text string, y0 double, y1 double")
    df = df.withColumn("height", F.lit(200.0)).withColumn("x0", F.lit(1.0))
    assert [tuple(r) for r in layout.running_lines(df, ["doc"], "page", "text", "height").collect()] == [("d", "PROVA 2026")]
    left = layout.page_structure(df, ["doc"], "page", "text", ["text"], "height")
    assert left.count() == df.count() - 5 and left.filter("text is null").count() == 1


def test_parsed(spark):
    files = [("a/x.DOCX", readers.docx_file(["um", "dois & três"])), ("b.md", "# Título\r\n\r\nCorpo\nsegue\n\n".encode()), ("c.txt", b""), ("d.csv", b"1,2")]
    df = spark.createDataFrame(files, "path string, content binary")
    found = readers.parsed(df.filter("path not like '%csv'"))
    assert sorted(map(tuple, found.collect())) == [("a/x.DOCX", 0, "um"), ("a/x.DOCX", 1, "dois & três"), ("b.md", 0, "# Título"), ("b.md", 1, "Corpo\nsegue")]
    with pytest.raises(Exception, match="no parser for d.csv"):
        readers.parsed(df).collect()
    own = {**readers.PARSERS, "csv": lambda content: content.decode().split(",")}
    assert [r["text"] for r in readers.parsed(df.filter("path = 'd.csv'"), own).orderBy("number").collect()] == ["1", "2"]


@pytest.mark.parametrize("words,want", [({"x": ["Abc"], "y": ["b"]}, ["x", "y", "none", "none"]), ({"x": [], "y": []}, ["none"] * 4), ({}, ["none"] * 4)])
def test_keyword_classifier(spark, words, want):
    df = spark.createDataFrame([(0, "an aBC here"), (1, "b"), (2, "q"), (3, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(providers.keyword_classifier(F.col("t"), words, "none")).collect()] == want
