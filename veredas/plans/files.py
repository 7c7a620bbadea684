"""Sources and sinks, each as a round trip through the files it reads or writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from veredas.functions import text as X
from veredas.functions.scoring import ESSAY_BANDS
from veredas.operators.joins import band
from veredas.operators.keys import latest_per_key, n_rows
from veredas.operators.windows import competition_rank
from veredas.operators.layout import page_structure
from veredas.plans import tables as T
from veredas.plans.joins import BAND_SQL
from veredas.plans.registry import query
from veredas.sources import readers as R
from veredas.sources import sinks as K
from veredas.sources.shared import shared_path


def _snapshot(spark, d):
    """Approved essays with rank, band and the class of the newest enrolment."""
    newest = latest_per_key(T.scores(spark, d), ["student_id"], "at", "essay_id").select("student_id", F.col("class").alias("newest_class"))
    approved = T.scores(spark, d).filter("status = 'F' and score <= 1000").join(newest, "student_id", "left")
    ranked = competition_rank(approved, "score", "place")
    return ranked.select("essay_id", "student_id", "school", "gre", "newest_class", "score", band(F.col("score"), ESSAY_BANDS).alias("band"), "place")


SNAPSHOT = f"""WITH n AS (SELECT student_id, class AS newest_class FROM scores QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY at_ DESC NULLS FIRST, essay_id DESC) = 1)
SELECT essay_id, s.student_id, school, gre, newest_class, score, {BAND_SQL} AS band, rank() OVER (ORDER BY score DESC) AS place FROM scores s LEFT JOIN n ON n.student_id = s.student_id WHERE status = 'F' AND score <= 1000"""


@query("src_pg_join", SNAPSHOT)
def src_pg_join(spark, d):
    return _snapshot(spark, d)


@query("src_sqlite_scan", "SELECT essay_id, score, c1 FROM scores WHERE school = 'NATION_3'")
def src_sqlite_scan(spark, d):
    path = shared_path(spark, "snapshot")
    T.scores(spark, d).write.parquet(path)
    return R.table(spark, path).filter("school = 'NATION_3'").select("essay_id", "score", "c1")


@query("src_orm_scan", "SELECT id, type, name FROM nodes WHERE type <> 'SUBCONTENT' ORDER BY type, name")
def src_orm_scan(spark, d):
    return T.nodes(spark, d).filter("type <> 'SUBCONTENT'").select("id", "type", "name").orderBy("type", "name")


@query("src_catalog_cache", "SELECT content, count(*) AS items, min(c.name) AS shown FROM items JOIN (SELECT 'Brand#' || n_nationkey AS code, n_name AS name FROM nation) c ON c.code = content GROUP BY 1")
def src_catalog_cache(spark, d):
    codes = T.read(spark, d, "nation").selectExpr("concat('Brand#', n_nationkey) as content", "n_name as name")
    return T.items(spark, d).groupBy("content").agg(n_rows().alias("items")).join(codes, "content").select("content", "items", F.col("name").alias("shown"))


@query("src_parent_map", "SELECT id, parent FROM nodes WHERE parent IS NOT NULL")
def src_parent_map(spark, d):
    return T.nodes(spark, d).filter("parent is not null").select("id", "parent")


@query("src_csv", "SELECT DISTINCT c_mktsegment AS turma, c_name AS nome, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey::VARCHAR END AS documento FROM customer")
def src_csv(spark, d):
    path = shared_path(spark, "roster")
    rows = T.read(spark, d, "customer").selectExpr("'EM' as segmento", "'2026' as ano_letivo", "'1' as serie", "c_mktsegment as turma", "c_name as nome", "if(c_custkey % 4 <> 0, cast(c_custkey as string), '') as documento")
    rows.write.option("header", True).csv(path)
    return R.roster(spark, path).select("turma", "nome", "documento").distinct()


@query("src_pdf_text", r"SELECT doc_id, len(regexp_extract_all(text, '\d+')) AS numbers, len(string_split(text, chr(10))) AS n FROM documents")
def src_pdf_text(spark, d):
    """Text layers, as documents: their lines, and the numbers in them."""
    docs = T.read(spark, d, "documents").select("doc_id", "text")
    counts = R.lines(docs, "doc_id", "text").groupBy("doc_id").agg(n_rows().alias("n"))
    return docs.select("doc_id", F.regexp_count("text", F.lit(r"\d+")).cast("long").alias("numbers")).join(counts, "doc_id")


@query("src_docx", "SELECT p_brand || '-' || p_partkey // 500 AS file, (row_number() OVER (PARTITION BY p_brand, p_partkey // 500 ORDER BY p_partkey) - 1)::INT AS number, p_name || ' & ' || p_partkey AS text FROM part")
def src_docx(spark, d):
    """Writes each brand's parts as DOCX files of at most 500 ids and reads their paragraphs."""
    import pandas as pd

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [group["path"].iloc[0]], "content": [R.docx_file(group.sort_values("p_partkey")["text"].tolist())]})

    rows = T.read(spark, d, "part").selectExpr("concat(p_brand, '-', p_partkey div 500) as path", "p_partkey", "concat(p_name, ' & ', p_partkey) as text")
    packed = rows.groupBy("path").applyInPandas(pack, "path string, content binary")
    return R.docx_paragraphs(packed).withColumnRenamed("path", "file")


@query("src_pdf_layout", """WITH l AS (SELECT l_suppkey AS doc, l_orderkey AS page, l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN l_returnflag || ' EXAM' ELSE l_returnflag || l_linenumber END AS text, CASE WHEN l_linenumber % 2 = 1 THEN 10 ELSE 300 END AS x FROM lineitem),
heads AS (SELECT doc, text FROM l WHERE id = 1 AND length(text) >= 4 GROUP BY ALL HAVING count(DISTINCT page) >= 3), k AS (SELECT * FROM l ANTI JOIN heads USING (doc, text)),
pages AS (SELECT doc, page, count(*) FILTER (x = 10) >= 3 AND count(*) FILTER (x = 300) >= 3 AS two FROM k GROUP BY ALL)
SELECT doc, page, id, text, CASE WHEN two AND x = 300 THEN 1 ELSE 0 END AS side, row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN two AND x = 300 THEN 1 ELSE 0 END, id, text) - 1 AS place FROM k JOIN pages USING (doc, page)""")
def src_pdf_layout(spark, d):
    """Lines with places on pages, made of orders: running heads go, columns are found, lines come in reading order."""
    made = T.read(spark, d, "lineitem").selectExpr(
        "l_suppkey as doc", "l_orderkey as page", "l_linenumber as id", "concat(l_returnflag, if(l_linenumber = 1, ' EXAM', cast(l_linenumber as string))) as text",
        "if(l_linenumber % 2 = 1, 10D, 300D) as x0", "l_linenumber * 20D - 15 as y0", "l_linenumber * 20D - 5 as y1", "200D as height", "500D as width",
    )
    found = page_structure(made, ["doc"], "page", "text", ["id", "text"], "height", columns=True, width="width")
    return found.select("doc", "page", "id", "text", F.col("column").alias("side"), F.col("place").cast("long").alias("place"))


@query("src_answer_key", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '1=A,12=C' ELSE '1=B,2=E' END AS answers FROM part", maps=())
def src_answer_key(spark, d):
    made = F.expr("if(p_size % 2 = 0, 'Gabarito 1 - A 12. C 1: D', '1) B\\n2) E')")
    by_number = F.array_sort(F.transform(F.map_entries(X.answer_key(made)), lambda e: F.struct(e["key"].cast("int").alias("number"), e["value"].alias("letter"))))
    entries = F.transform(by_number, lambda e: F.concat(e["number"].cast("string"), F.lit("="), e["letter"]))
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(entries, ",").alias("answers"))


@query("src_yaml_rubric", "SELECT essay_id, CASE WHEN c1 >= 160 THEN 'HIGH' WHEN c1 >= 80 THEN 'MIDDLE' ELSE 'LOW' END AS level FROM scores")
def src_yaml_rubric(spark, d):
    levels = R.rubric(spark, "# points from which a level holds\nC1:\n  - HIGH: 160\n  - MIDDLE: 80\n  - LOW: 0\n")
    ladder = levels.filter("competency = 'C1'").agg(F.reverse(F.array_sort(F.collect_list(F.struct("points", "level")))).alias("ladder"))  # a few levels
    fits = F.filter("ladder", lambda x: F.col("c1") >= x["points"])
    return T.scores(spark, d).crossJoin(F.broadcast(ladder)).select("essay_id", F.element_at(fits, 1)["level"].alias("level"))


@query("src_jsonl_results", "SELECT 'doc-' || doc_id AS custom_id, 200 AS status FROM documents WHERE doc_id % 10 <> 3")
def src_jsonl_results(spark, d):
    path = shared_path(spark, "results")
    made = F.when(F.col("doc_id") % 10 == 3, "not json {").otherwise(F.to_json(F.struct(F.concat(F.lit("doc-"), "doc_id").alias("custom_id"), F.lit(200).alias("status"), F.lit("{}").alias("body"))))
    T.read(spark, d, "documents").select(made.alias("value")).write.text(path)
    return R.result_lines(spark, path).select("custom_id", "status")


@query("src_dispatch", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'DOCX' ELSE 'TEXT' END AS parser FROM pages")
def src_dispatch(spark, d):
    path = F.expr("concat('/in/', page_id, element_at(array('.pdf', '.DOCX', '.txt'), cast(page_id % 3 as int) + 1))")
    return T.read(spark, d, "pages").select("page_id", R.parser_for(path).alias("parser"))


RECOVERY_SQL = r"""WITH s AS (SELECT doc_id, text, substr(text, 2) AS rest, repeat('0', 40000) || text AS bad FROM documents),
l AS (SELECT *, length(regexp_replace(rest, '[^\p{L}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(rest, '[ \t\n\x0B\f\r]', '', 'g')), 0) AS other, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE / (40000 + length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g'))) AS native FROM s)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5(text) WHEN coalesce(round(other, 4), 0) > coalesce(round(native, 4), 0) THEN md5(rest) ELSE md5(bad) END AS h FROM l"""


@query("src_text_recovery", RECOVERY_SQL)
def src_text_recovery(spark, d):
    """A null text has a null hash; of two texts without letters the first stays."""
    return _recovered(T.read(spark, d, "documents"))


@query("src_text_recovery_all", RECOVERY_SQL)
def src_text_recovery_all(spark, d):
    return _recovered(T.read(spark, d, "documents"))


def _recovered(docs):
    """The extraction with more letters wins: the second is garbled in even documents, the first in odd ones."""
    bad = F.concat(F.lit("0" * 40000), "text")
    native = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(bad)
    other = F.when(F.col("doc_id") % 2 == 0, bad).otherwise(F.expr("substr(text, 2)"))
    return docs.select("doc_id", F.md5(R.better_text(native, other, X.letter_share)).alias("h"))


@query("src_file_hash", "SELECT DISTINCT sha256(p_brand || chr(10)) AS digest FROM part")
def src_file_hash(spark, d):
    path = shared_path(spark, "hashed")
    T.read(spark, d, "part").select(F.col("p_brand").alias("value"), F.col("p_brand").alias("k")).distinct().repartition("k").write.partitionBy("k").text(path)
    return R.files(spark, path, "*.txt").select("digest").distinct()


@query("snk_snapshot_replace", SNAPSHOT)
def snk_snapshot_replace(spark, d):
    path = shared_path(spark, "replaced")
    rows = _snapshot(spark, d)
    K.replace(rows.limit(5), path)
    K.replace(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query("snk_snapshot_insert", "SELECT status, count(*) AS n FROM scores WHERE status IN ('F', 'O') GROUP BY 1")
def snk_snapshot_insert(spark, d):
    path = shared_path(spark, "inserted")
    for s in ("F", "O"):
        K.append(T.scores(spark, d).filter(F.col("status") == s), path)
    return spark.read.parquet(path).groupBy("status").agg(n_rows().alias("n"))


@query("snk_upsert", "SELECT school, CASE WHEN school IN ('NATION_1', 'NATION_2') THEN 2 ELSE 1 END AS version FROM (SELECT DISTINCT school FROM scores)")
def snk_upsert(spark, d):
    path = shared_path(spark, "upserted")
    cuts = T.scores(spark, d).select("school").distinct()
    K.upsert(spark, path, cuts.withColumn("version", F.lit(1)), ["school"], "version")
    K.upsert(spark, path, cuts.filter("school in ('NATION_1', 'NATION_2')").withColumn("version", F.lit(2)), ["school"], "version")
    return K.keyed(spark, path, "school string, version int")


@query("snk_cache_rebuild", "SELECT status, CASE status WHEN 'F' THEN 0 ELSE count(*) END::BIGINT AS n FROM scores GROUP BY 1")
def snk_cache_rebuild(spark, d):
    path = shared_path(spark, "rebuilt")
    counts = T.scores(spark, d).groupBy("status").agg(n_rows().alias("n"))
    K.rebuild(counts, path, "status")
    K.rebuild(counts.filter("status = 'F'").withColumn("n", F.lit(0).cast("long")), path, "status")
    return spark.read.schema("n bigint, status string").parquet(path)


@query("snk_append_history", "SELECT kind, count(*) AS n FROM history GROUP BY 1")
def snk_append_history(spark, d):
    path = shared_path(spark, "history")
    for half in (0, 1):
        K.append(T.history(spark, d).filter(F.col("event_id") % 2 == half), path)
    return spark.read.parquet(path).groupBy("kind").agg(n_rows().alias("n"))


@query("snk_get_or_create", "SELECT DISTINCT classroom, school_id FROM links")
def snk_get_or_create(spark, d):
    path = shared_path(spark, "created")
    rows = T.links(spark, d).select("classroom", "school_id")
    K.add_missing(spark, path, rows.filter("school_id < 9"), ["classroom", "school_id"])
    K.add_missing(spark, path, rows, ["classroom", "school_id"])
    return K.keyed(spark, path, rows.schema)


XLSX_SQL = """WITH s AS (SELECT school, essay_id, printf('%08d', essay_id) AS name, CASE WHEN status <> 'P' THEN 'Sim' ELSE 'Não' END AS done, CASE WHEN status = 'F' THEN score END AS total, CASE WHEN status = 'F' THEN c1 END AS a, CASE WHEN status = 'F' THEN c2 END AS b,
  CASE WHEN status = 'F' THEN c3 END AS c, CASE WHEN status = 'F' THEN c4 END AS d, CASE WHEN status = 'F' THEN c5 END AS e FROM scores),
r AS (SELECT *, (row_number() OVER (PARTITION BY school ORDER BY name))::INT AS number FROM s), h AS (SELECT DISTINCT school FROM s)
SELECT 'submission_list' AS report, school, number, name || '|' || done AS line FROM r UNION ALL SELECT 'grades_total', school, number, name || '|' || done || '|' || coalesce(total::VARCHAR, '-') FROM r
UNION ALL SELECT 'grades_per_competency', school, number, concat_ws('|', name, done, coalesce(a::VARCHAR, '-'), coalesce(b::VARCHAR, '-'), coalesce(c::VARCHAR, '-'), coalesce(d::VARCHAR, '-'), coalesce(e::VARCHAR, '-'), coalesce(total::VARCHAR, '-')) FROM r
UNION ALL SELECT 'submission_list', school, 0, 'Aluno|Entregou' FROM h UNION ALL SELECT 'grades_total', school, 0, 'Aluno|Entregou|Nota total' FROM h UNION ALL SELECT 'grades_per_competency', school, 0, 'Aluno|Entregou|C1|C2|C3|C4|C5|Nota total' FROM h"""


@query("snk_xlsx", XLSX_SQL)
def snk_xlsx(spark, d):
    """Each school's essays as workbooks of the three layouts, written and read back: grades only of corrected ones."""
    graded = lambda c: F.when(F.col("status") == "F", F.col(c).cast("int")).alias({"score": "total"}.get(c, c))
    rows = T.scores(spark, d).select("school", F.lpad(F.col("essay_id").cast("string"), 8, "0").alias("name"), (F.col("status") != "P").alias("submitted"), *map(graded, ("score", "c1", "c2", "c3", "c4", "c5")))
    found = None
    for kind in K.REPORTS:
        read = R.sheet_rows(K.report_files(rows, kind, "school")).withColumn("report", F.lit(kind))
        found = read if found is None else found.unionAll(read)
    line = F.array_join("cells", "|", "-")
    return found.select("report", F.regexp_replace("path", r"\.xlsx$", "").alias("school"), "number", F.regexp_replace(line, r"\.0(?=\||$)", "").alias("line"))


@query("snk_report", """SELECT school, '{"school":"' || school || '","essays":' || count(*) || ',"best":' || max(score) || ',"note":null}' AS payload FROM scores GROUP BY 1""")
def snk_report(spark, d):
    stats = T.scores(spark, d).groupBy("school").agg(n_rows().alias("n"), F.max("score").alias("best"))
    return stats.select("school", K.report(school=F.col("school"), essays=F.col("n"), best=F.col("best"), note=F.lit(None).cast("string")).alias("payload"))


@query("snk_jsonl_requests", """SELECT 'score-' || essay_id AS custom_id, '{"custom_id":"score-' || essay_id || '","method":"POST","body":{"points":' || score || '}}' AS line FROM scores""")
def snk_jsonl_requests(spark, d):
    path = shared_path(spark, "requests")
    K.request_lines(T.scores(spark, d), path, F.concat(F.lit("score-"), "essay_id"), F.struct(F.col("score").alias("points")))
    return spark.read.text(path).select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.col("value").alias("line"))
