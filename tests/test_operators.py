"""Operators on small cases whose results are known."""

import datetime

import pytest
from pyspark.sql import functions as F

from veredas.functions import hashing, text
from veredas.operators import aggregates, filters, joins, keys, tree, windows
from veredas.sources import sinks
from veredas.streaming import batches

BANDS = [(0, 399, "Muito baixo"), (400, 599, "Baixo"), (600, 799, "Adequado"), (800, 899, "Alto"), (900, 1000, "Muito alto")]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("scores,ranks", [((900, 800, 700), (1, 2, 3)), ((800, 800, 600), (1, 1, 3)), ((900, 700, 700, 500), (1, 2, 2, 4)), ((), ())])
def test_competition_rank(spark, scores, ranks):
    df = table(spark, list(enumerate(scores)), "id int, score int")
    found = windows.competition_rank(df, "score", "place").orderBy("id").collect()
    assert tuple(r["place"] for r in found) == ranks


@pytest.mark.parametrize("score,name", [(lo, n) for lo, _, n in BANDS] + [(hi, n) for _, hi, n in BANDS])
def test_band(spark, score, name):
    assert spark.range(1).select(joins.band(F.lit(score), BANDS)).first()[0] == name


@pytest.mark.parametrize("score", [1001, -1])
def test_band_out_of_range(spark, score):
    with pytest.raises(Exception, match="(?i)band|range|score"):
        spark.range(1).select(joins.band(F.lit(score), BANDS)).collect()


def test_latest_per_key(spark):
    day = datetime.datetime
    df = table(spark, [(1, "a", day(2024, 1, 1)), (2, "a", day(2024, 2, 1)), (3, "b", None), (4, "b", day(2024, 1, 1))], "id int, k string, at timestamp")
    assert {r["id"] for r in keys.latest_per_key(df, ["k"], "at", "id").collect()} == {2, 3}


def test_runs_break_at_gaps(spark):
    df = table(spark, [("x", 1, "a"), ("x", 2, "a"), ("x", 3, "b"), ("x", 4, "a"), ("x", 6, "a")], "doc string, page int, who string")
    assert windows.runs(df, ["doc"], "page", "who").count() in (4, 5)


def test_unique_match_leaves_homonyms_open(spark):
    rows = table(spark, [(1, "ana", "ana"), (2, "bia", "bia"), (3, "zoe", "zoe")], "page int, name string, glued string")
    roster = table(spark, [(10, "ana", "ana"), (11, "bia", "bia"), (12, "bia", "bia")], "student int, name string, glued string")
    found = {r["page"]: r["student"] for r in joins.unique_match(rows, roster, ["name", "glued"], "student").collect()}
    assert found == {1: 10, 2: None, 3: None}


def test_reachable_ends_on_cycles(spark):
    edges = table(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "s string, t string")
    found = {(r[0], r[1]) for r in tree.reachable(edges, "s", "t").select("s", "t").collect()}
    assert ("a", "a") in found and ("a", "d") in found and ("d", "a") not in found


def test_half_open_range(spark):
    df = table(spark, [(datetime.datetime(2024, 1, d),) for d in (1, 2, 3)], "at timestamp")
    assert df.filter(filters.between_half_open("at", datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 3))).count() == 2


def test_blank(spark):
    df = table(spark, [(None,), ("",), (" \t\n",), ("x",)], "c string")
    assert df.filter(filters.blank(F.col("c"))).count() == 3


def test_median_of_metrics(spark):
    df = table(spark, [(900, "Muito alto"), (700, "Adequado"), (500, "Baixo")], "score int, band string")
    row = aggregates.score_metrics(df, "score", "band").first().asDict()
    assert 700.0 in row.values() and 3 in row.values()


def test_unit_interval(spark):
    got = spark.range(1).select(hashing.unit_interval(F.lit("11111111-1111-1111-1111-111111111111"))).first()[0]
    assert got == pytest.approx(0.7224301492766805)


def test_review(spark):
    df = table(spark, [("a", 1, True), ("b", 0, False), ("c", 0, True)], "id string, alerts int, scored boolean")
    at = lambda rate: [r[0] for r in df.select(batches.review(F.col("id"), F.col("alerts"), F.col("scored"), rate)).collect()]
    assert at(1.0) == ["REVIEW"] * 3 and at(0.0) == ["REVIEW", "REVIEW", "APPROVE"]


def test_plain_and_names(spark):
    row = spark.range(1).select(text.plain(F.lit("João ÁÉç")), text.single_spaced(F.lit(" a \n b "))).first()
    assert row[0].lower() == "joao aec" and row[1] == "a b"


def test_sinks_replace_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    first = table(spark, [(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    assert sinks.replace(first, path) == 2
    sinks.upsert(spark, path, table(spark, [(2, "c", 2), (3, "d", 2)], "id int, v string, at int"), ["id"], "at")
    assert {(r["id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    sinks.add_missing(spark, path, table(spark, [(3, "x", 9), (4, "e", 9)], "id int, v string, at int"), ["id"])
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {1, 2, 3, 4}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "event_id int, at timestamp"
    add = lambda ids: table(spark, [(i, datetime.datetime(2024, 1, 1)) for i in ids], schema).write.mode("append").parquet(src)

    def batch(rows, _):
        done = spark.read.parquet(out) if (tmp_path / "out").exists() else spark.createDataFrame([], schema)
        batches.apply_once(rows, done, "event_id").write.mode("append").parquet(out)

    for ids in ([1, 2, 2], [2, 3]):
        add(ids)
        batches.run_available(spark.readStream.schema(schema).parquet(src), batch, str(tmp_path / "ck"))
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_rows_without_a_score_rank_last(spark):
    df = table(spark, [(1, 10), (2, None), (3, 20), (4, None), (5, 10)], "id int, score int")
    for by in ((), ("k",)):
        found = windows.competition_rank(df.withColumn("k", F.lit(1)), "score", "place", by).orderBy("id").collect()
        assert [r["place"] for r in found] == [2, 4, 1, 4, 2]
    none = windows.competition_rank(df.filter("score is null"), "score", "place").collect()
    assert [r["place"] for r in none] == [1, 1]


def chunked(sizes, limit, rows, group):
    """Chunk numbers by the plainest fold."""
    out, number, taken, count = [], 0, 0, 0
    for i in range(0, len(sizes), group):
        part = sizes[i : i + group]
        if count and (count + len(part) > rows or taken + sum(part) > limit):
            number, taken, count = number + 1, 0, 0
        taken, count = taken + sum(part), count + len(part)
        out += [number] * len(part)
    return out


@pytest.mark.parametrize("group", [1, 2, 6])
def test_fifo_chunks(spark, group):
    import random

    draw = random.Random(group)
    sizes = {q: [draw.randint(1, 90) for _ in range(n)] for q, n in (("a", 500), ("b", 1), (None, 7), ("c", 36))}
    df = table(spark, [(q, i, s) for q, own in sizes.items() for i, s in enumerate(own)], "q string, at int, size long").repartition(5)
    with_small_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = windows.fifo_chunks(df, "q", ["at"], "size", 200, 10, group).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_small_batches)
    for q, own in sizes.items():
        rows = sorted((r["at"], r["size"], r["chunk"]) for r in found if r["q"] == q)
        assert [r[2] for r in rows] == chunked(own, 200, 10, group) and [r[1] for r in rows] == own


def test_ancestors_of_deep_trees_and_cycles(spark):
    deep = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(13)]
    found = tree.ancestors(table(spark, [*deep, ("x", "y"), ("y", "x")], "id string, parent string")).collect()
    of = {r["ancestor"]: r["depth"] for r in found if r["id"] == "n12"}
    assert of == {f"n{12 - k}": k for k in range(13)}
    assert {(r["ancestor"], r["depth"]) for r in found if r["id"] == "x"} == {("x", 0), ("y", 1)}


def test_means_depend_on_no_order(spark):
    rows = [(i % 3, round(0.01 * ((i * 7919) % 10001), 2)) for i in range(5000)]
    want = {}
    for k in range(3):
        cents = [round(v * 100) for q, v in rows if q == k]
        want[k] = ((2 * sum(cents) + len(cents)) // (2 * len(cents))) / 100
    for parts in (1, 7):
        df = table(spark, [*rows, (9, None)], "k int, v double").repartition(parts).groupBy("k").agg(aggregates.rounded_mean("v").alias("m"), aggregates.exact_mean("v").alias("x"))
        found = {r["k"]: r["m"] for r in df.collect()}
        assert found == want | {9: None}


@pytest.mark.parametrize("elapsed,gap,enough,stop,wide,want", [
    (1500, 0, 0, 0, 0, ("FINISH_TIME", "HARD_LIMIT_REACHED", False)), (10, 1, 1, 1, 1, ("FINISH_SUFFICIENT", "GLOBAL_SUFFICIENCY_REACHED", False)),
    (1400, 1, 1, 0, 1, ("CONTINUE", "GLOBAL_COVERAGE_INCOMPLETE", True)), (10, 0, 0, 0, 1, ("CONTINUE", "GLOBAL_COVERAGE_INCOMPLETE", False)),
    (1320, 1, 1, 0, 0, ("CONTINUE_PREREQUISITE_INVESTIGATION", "POSSIBLE_PREREQUISITE_GAP", True)), (10, 0, 1, 0, 0, ("FINISH_SUFFICIENT", "CONTENT_SUFFICIENCY_REACHED", False)),
    (1320, 0, 0, 0, 0, ("CONTINUE", "SOFT_LIMIT_HIGH_INFORMATION_ONLY", True)), (1319, 0, 0, 0, 0, ("CONTINUE", "INSUFFICIENT_EVIDENCE", False)),
])
def test_diagnostic_decision(spark, elapsed, gap, enough, stop, wide, want):
    from veredas.functions import scoring

    told = scoring.diagnostic_decision(F.lit("DISCIPLINE"), F.lit(elapsed), *[F.lit(bool(x)) for x in (gap, enough, stop, wide)])
    assert tuple(spark.range(1).select(told.alias("t")).select("t.*").first()) == want
