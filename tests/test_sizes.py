"""Steps whose memory or rounds must not grow with the rows of a group."""

from pyspark.sql import functions as F

from veredas.operators.joins import token_overlap
from veredas.operators.keys import cascade_fill
from veredas.operators.proficiency import estimates
from veredas.sources import readers, sinks
from veredas.streaming import stages


def test_workbooks_are_streamed(spark):
    """A workbook's rows come out of the reader in bounded batches, and whole numbers stay whole beside empty cells."""
    n = readers.SHEET_ROWS + 5
    rows = spark.range(n).selectExpr("if(id = 3, null, 'b') as by", "lpad(id, 6, '0') as name", "if(id % 2 = 0, cast(id as int), null) as grade")
    found = sinks.workbooks(rows, "by", ["name"]).toPandas().set_index("path")["content"]
    assert sorted(found.index) == ["None.xlsx", "b.xlsx"]
    got = list(readers._cells(iter([found.reset_index().query("path == 'b.xlsx'")])))
    assert [len(x) for x in got] == [readers.SHEET_ROWS, 5]
    cells = [c for x in got for c in x["cells"]]
    assert cells == [["name", "grade"], *[[f"{i:06d}", str(i) if i % 2 == 0 else None] for i in range(n) if i != 3]]
    assert [i for x in got for i in x["number"]] == list(range(n))


def test_cascade_fill_counts_places_in_a_row(spark):
    """No row is made for each place that a student might need, and a repeated item or a student without a name changes nothing else."""
    bank = spark.createDataFrame([("k", 1, True), ("k", 2, True), ("k", 2, True), ("k", 3, False), ("j", 9, False)], "key string, item int, w boolean")
    seen = spark.createDataFrame([("a", 2), ("a", 3), ("b", 3), (None, 1), ("c", 7), ("d", 9)], "student string, item int")
    found = cascade_fill(bank, seen, "student", "key", "item", [F.asc("item")], 3, F.col("w"))
    got = sorted((r["student"] or "", r["key"], r["stage"], r["item"]) for r in found.collect())
    assert got == [("", "k", 1, 1), ("", "k", 1, 2), ("", "k", 1, 2), ("a", "k", 1, 1), ("a", "k", 3, 2), ("a", "k", 3, 2), ("b", "k", 1, 1), ("b", "k", 1, 2), ("b", "k", 1, 2), ("d", "j", 4, 9)]
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_estimates_make_no_rows_for_what_is_counted_distinct(spark):
    rows = [("a", True, "EASY"), ("a", False, "HARD"), ("a", None, "EASY"), ("b", True, None), ("b", True, "EASY"), ("c", None, None)]
    found = estimates(spark.createDataFrame(rows, "k string, hit boolean, difficulty string"), ["k"], "hit", "difficulty")
    assert {r["k"]: (r["n"], r["levels"], r["outcomes"]) for r in found.collect()} == {"a": (3, 2, 2), "b": (2, 1, 1), "c": (1, 0, 0)}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_runs_open_in_growing_numbers(spark, tmp_path):
    """Seven chunks in three calls and an eighth for a failed one, each result's chunks apart and in order."""
    told = []

    class Service:
        def submit(self, requests):
            told.append(sorted({r["sequence"] for r in requests.filter("stage = 'OCR'").collect()}))

        def states(self, runs):
            failed = F.when((F.col("stage") == "OCR") & (F.col("sequence") == 1), "failed").otherwise("completed")
            return runs.select("school", "stage", "sequence", F.concat_ws("-", "stage", "sequence").alias("batch"), failed.alias("status"))

        def results(self, items, stage):
            return items.select("school", "id", F.lit(1).cast("long").alias("size"))

    line = stages.Pipeline(spark, str(tmp_path), Service(), (stages.Stage("OCR", 2), stages.Stage("CORRECTION", 1)), most=4, partitions=1, most_open=100)
    line.enqueue(spark.range(13).selectExpr("'a' as school", "lpad(id, 2, '0') as id", "1L as size"))
    calls = 0
    while line.call():
        calls += 1
    assert [x for x in told if x] == [[1], [2], [3, 4], [5, 6, 7, 8]] and calls < 9
    got = {(r["stage"], r["sequence"]): (r["status"], r["lines"]) for r in line.runs().collect()}
    ocr = {("OCR", i): ("failed" if i == 1 else "completed", 2 if i == 8 else 4) for i in range(1, 9)}
    assert got == {**ocr, **{("CORRECTION", i): ("completed", 1 if i == 7 else 2) for i in range(1, 8)}}
    assert sorted(r["id"] for r in line.output().collect()) == [f"{i:02d}" for i in range(13)]


def test_pairs_of_one_token_set_are_made_by_many_tasks(spark):
    left = spark.createDataFrame([(i, ["a", "b", "a"]) for i in range(400)] + [(400, ["c"]), (401, None), (402, [])], "q int, tokens array<string>")
    right = spark.createDataFrame([(f"n{i}", ["b", "a"]) for i in range(50)] + [("n50", ["c", "b"]), ("n51", [])], "id string, tokens array<string>")
    found = token_overlap(left, "q", right, "id").withColumn("task", F.spark_partition_id()).collect()
    want = [(i, f"n{j}", 2 if j < 50 else 1) for i in range(400) for j in range(51)] + [(400, "n50", 1)]
    assert sorted((r["q"], r["id"], r["common"]) for r in found) == sorted(want)
    assert len({r["task"] for r in found}) >= 4


def test_files_of_pairs_stay_small(spark, tmp_path):
    """Ids that repeat only after thousands of rows are beyond what Snappy looks back on: over a byte a row."""
    left = spark.range(640).selectExpr("id * 7919 % 1000003 as q", "array('a') as tokens")
    right = spark.range(6000).selectExpr("concat('P', pmod(xxhash64(id), 300000), '-', id) as id", "array('a', 'b') as tokens")
    token_overlap(left, "q", right, "id").write.option("compression", "snappy").parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.agg(F.count(F.lit(1)), F.count_distinct("q"), F.count_distinct("id"), F.count_distinct("q", "id")).first() == (3_840_000, 640, 6000, 3_840_000)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 3_840_000


def test_null_ids_are_paired(spark):
    left = spark.createDataFrame([(None, ["a"]), (1, ["a", "b"])], "q int, tokens array<string>")
    right = spark.createDataFrame([("x", ["a"]), (None, ["b"])], "id string, tokens array<string>")
    assert {tuple(r) for r in token_overlap(left, "q", right, "id").collect()} == {(None, "x", 1), (1, "x", 1), (1, None, 1)}
