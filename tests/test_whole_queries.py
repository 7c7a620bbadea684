"""Queries over all rows, on tables of more ids than the smallest ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import same_rows
from veredas import catalog


@pytest.fixture(scope="module")
def more(sf):
    return sf.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def con(more):
    con = duckdb.connect()
    for name in ("part", "lineitem", "region", "nation", "supplier", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{more}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["join_lexical_all", "fn_lexical_score_all", "agg_material_availability", "agg_material_availability_all", "lim_fresh_then_fill_all", "lim_cascade_fill_all"])
def test_no_id_is_left_out(name, spark, more, con):
    same_rows(catalog.QUERIES[name](spark, more), con, catalog.ORACLE[name])


def test_every_question_has_candidates(spark, more):
    for name in ("join_lexical_all", "fn_lexical_score_all"):
        assert catalog.QUERIES[name](spark, more).select("question_id").distinct().count() == spark.read.parquet(f"{more}/part.parquet").count()


TEXTS = [None, "", "a", " ", "\t \n", "1 starts with a digit", '"Quoted" text', " blank first", "漢字で書かれた文章です、とても短い", "12345 67890", "x" * 10, "x" * 11, "Ünder and over", "é", "same same same same same same", "0" * 80]


def test_every_document_has_a_row(spark, con, more, tmp_path):
    rows = [(2 * i + k, t) for i, t in enumerate(TEXTS) for k in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    odd = duckdb.connect()
    odd.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("src_text_recovery", "src_text_recovery_all", "fn_quote_offset", "fn_quote_offset_all"):
        for d, c in ((str(tmp_path), odd), (more, con)):
            found = catalog.QUERIES[name](spark, d)
            assert found.count() == c.execute("SELECT count(*) FROM documents").fetchone()[0]
            same_rows(found, c, catalog.ORACLE[name])


def test_fill_takes_seen_ones_last(spark):
    from pyspark.sql import functions as F

    from veredas.operators.keys import cascade_fill

    items = spark.createDataFrame([(i, "ab"[i % 2] if i < 20 else None, i % 3 == 0) for i in range(21)], "q int, c string, easy boolean")
    seen = spark.createDataFrame([(1, q) for q in (0, 0, 2, 6, 99, None)] + [(2, 3)], "s int, q int")
    for n in (1, 3, 8, 50):
        for easy in (None, F.col("easy")):
            want = set()
            for s, keys in ((1, "a"), (2, "b")):
                had = {r["q"] for r in seen.collect() if r["s"] == s}
                for c in keys:
                    rows = []
                    for i in range(20):
                        if "ab"[i % 2] == c:
                            ok = easy is None or i % 3 == 0
                            rows.append(((1 if ok else 2) if i not in had else (3 if ok else 4), i))
                    if any(r[0] == 3 for r in rows):
                        rows = [r for r in rows if r[0] < 4]
                    want |= {(s, c, i, stage) for stage, i in sorted(rows)[:n]}
            got = cascade_fill(items, seen, "s", "c", "q", [F.asc("q")], n, easy).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_exercises_of_a_small_file_are_dealt_over_tasks(spark, sf):
    rows = catalog.QUERIES["fn_exercise_split"](spark, sf)
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_headings_of_a_small_file_are_dealt_over_tasks(spark, sf):
    rows = catalog.QUERIES["fn_heading_parse"](spark, sf)
    assert rows.select(F.spark_partition_id()).distinct().count() > 1
