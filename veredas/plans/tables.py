"""The engine's tables as views over the generic test tables, as DataFrames and, for the oracle, as SQL.

scores: graded essays; items: answered questions; mastery: a student's state in a content; history: evidence
events; bank: questions; nodes, edges: curriculum tree and prerequisites; links: roster; videos: video events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scores(spark: SparkSession, d: str) -> DataFrame:
    e = F.expr
    essays = read(spark, d, "orders").join(read(spark, d, "customer"), e("o_custkey = c_custkey"))
    essays = essays.join(read(spark, d, "nation"), e("c_nationkey = n_nationkey")).join(read(spark, d, "region"), e("n_regionkey = r_regionkey"))
    grade = e("cast(floor(o_totalprice) as bigint) % 1001")
    points = {f"c{k}": e(f"(o_orderkey * {k} + cast(floor(o_totalprice) as bigint)) % 201") for k in range(1, 6)}
    return essays.select(
        F.col("o_orderkey").alias("essay_id"), F.col("o_custkey").alias("student_id"), F.col("n_name").alias("school"), F.col("r_name").alias("gre"),
        e("case when o_custkey % 7 <> 0 then c_mktsegment end").alias("class"), grade.alias("score"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"),
        *[v.alias(k) for k, v in points.items()],
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    e = F.expr
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), e("l_partkey = p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("result_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("question_id"), F.col("l_suppkey").alias("student_id"),
        e("l_returnflag <> 'N'").alias("answered"), e("case l_returnflag when 'A' then true when 'R' then false end").alias("is_correct"),
        e("case when l_returnflag = 'N' and l_linestatus = 'O' then 'UNKNOWN' end").alias("response"),
        F.col("p_brand").alias("content"), e("case when p_size % 3 <> 0 then p_type end").alias("subcontent"),
        e("case when p_size <= 16 then 'EASY' when p_size <= 33 then 'MEDIUM' else 'HARD' end").alias("difficulty"),
        e("concat('D', p_size % 5)").alias("discipline"), F.col("l_shipdate").alias("at"),
        e("l_quantity > 40").alias("provisional"), e("case when l_tax > 0.04 then 'LIST' else 'EXAM' end").alias("origin"),
    )


def mastery(spark: SparkSession, d: str) -> DataFrame:
    """One row a (student, content): answered, correct, score of 100, confidence by tenths, last activity."""
    rows = items(spark, d).filter("answered").groupBy("student_id", "content")
    rows = rows.agg(F.count(F.lit(1)).alias("answered"), F.count_if("is_correct").alias("correct"), F.max("at").alias("last_at"))
    return rows.withColumns({"score": F.round(F.col("correct") * 100.0 / F.col("answered"), 2), "confidence": F.least(F.lit(1.0), F.col("answered") / 10.0)})


def history(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").selectExpr(
        "event_id", "user_id as student_id", "ts as at", "event_type as kind", "value", "props",
        "case event_id % 4 when 0 then cast(null as boolean) when 3 then false else true end as is_correct",
        "case when event_id % 8 = 4 then 'UNKNOWN' end as response", "cast(value as bigint) % 12 as content",
    )


def bank(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").selectExpr(
        "p_partkey as question_id", "p_name as statement", "p_brand as content", "p_type as exam", "p_size as number", "p_retailprice as price",
        "case p_size % 5 when 0 then 'PUBLIC' when 1 then 'PRIVATE' when 2 then 'SCHOOL' when 3 then 'CLASSROOM' end as visibility",
        "case when p_size % 4 <> 0 then p_partkey % 25 end as school_id", "case when p_size % 7 = 0 then concat('o', p_partkey % 25) end as owner",
        "case p_size % 3 when 0 then 'PLATFORM' when 1 then 'AUTHOR' else 'IMPORTED' end as origin",
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    top = read(spark, d, "region").selectExpr("concat('R', r_regionkey) as id", "cast(null as string) as parent", "'DISCIPLINE' as type", "r_name as name")
    area = read(spark, d, "nation").selectExpr("concat('N', n_nationkey)", "concat('R', n_regionkey)", "'AREA'", "n_name")
    content = read(spark, d, "supplier").selectExpr("concat('S', s_suppkey)", "concat('N', s_nationkey)", "'CONTENT'", "s_name")
    sub = read(spark, d, "part").filter("p_partkey % 4 = 0").selectExpr("concat('P', p_partkey)", "concat('S', p_partkey % 10)", "'SUBCONTENT'", "p_name")
    return top.unionAll(area).unionAll(content).unionAll(sub)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A content needs the content of half its number."""
    return read(spark, d, "supplier").filter("s_suppkey >= 1").selectExpr("concat('S', s_suppkey) as content", "concat('S', s_suppkey div 2) as needs").filter("content <> needs")


def links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").selectExpr(
        "c_custkey as user_id", "c_name as name", "c_nationkey as school_id", "c_mktsegment as classroom", "c_acctbal > 0 as active",
        "case c_custkey % 9 when 0 then 'TEACHER' when 1 then 'COORDINATOR' else 'STUDENT' end as role",
        "case when c_custkey % 5 = 0 then 'SCHOOL' else 'CLASSROOM' end as scope",
    )


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """What was taught lately: one row for each event of some kinds."""
    return read(spark, d, "events").filter("event_type in ('signup', 'purchase', 'view')").selectExpr(
        "event_id", "user_id as classroom", "ts as recorded_at", "cast(value as bigint) % 12 as content", "value < 100 as active",
        "case event_type when 'signup' then 'TEACHER' when 'purchase' then 'COORDINATION' else 'SCHOOL_PLAN' end as source",
    )


SQL = {
    "scores": """scores AS (SELECT o_orderkey AS essay_id, o_custkey AS student_id, n_name AS school, r_name AS gre,
  CASE WHEN o_custkey % 7 <> 0 THEN c_mktsegment END AS class, floor(o_totalprice)::BIGINT % 1001 AS score, o_orderstatus AS status, o_orderdate AS at_,
  (o_orderkey * 1 + floor(o_totalprice)::BIGINT) % 201 AS c1, (o_orderkey * 2 + floor(o_totalprice)::BIGINT) % 201 AS c2, (o_orderkey * 3 + floor(o_totalprice)::BIGINT) % 201 AS c3,
  (o_orderkey * 4 + floor(o_totalprice)::BIGINT) % 201 AS c4, (o_orderkey * 5 + floor(o_totalprice)::BIGINT) % 201 AS c5
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "items": """items AS (SELECT l_orderkey AS result_id, l_linenumber AS position, l_partkey AS question_id, l_suppkey AS student_id,
  l_returnflag <> 'N' AS answered, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS is_correct,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'UNKNOWN' END AS response, p_brand AS content,
  CASE WHEN p_size % 3 <> 0 THEN p_type END AS subcontent, CASE WHEN p_size <= 16 THEN 'EASY' WHEN p_size <= 33 THEN 'MEDIUM' ELSE 'HARD' END AS difficulty,
  'D' || (p_size % 5) AS discipline, l_shipdate AS at_, l_quantity > 40 AS provisional, CASE WHEN l_tax > 0.04 THEN 'LIST' ELSE 'EXAM' END AS origin
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "mastery": """mastery AS (SELECT *, round(correct * 100.0::DOUBLE / answered, 2) AS score, least(1.0::DOUBLE, answered / 10.0::DOUBLE) AS confidence FROM (
  SELECT student_id, content, count(*) AS answered, count(*) FILTER (is_correct) AS correct, max(at_) AS last_at FROM items WHERE answered GROUP BY ALL))""",
    "history": """history AS (SELECT event_id, user_id AS student_id, ts AS at_, event_type AS kind, value, props,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 3 THEN false ELSE true END AS is_correct, CASE WHEN event_id % 8 = 4 THEN 'UNKNOWN' END AS response,
  trunc(value)::BIGINT % 12 AS content FROM events)""",
    "bank": """bank AS (SELECT p_partkey AS question_id, p_name AS statement, p_brand AS content, p_type AS exam, p_size AS number, p_retailprice AS price,
  CASE p_size % 5 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PRIVATE' WHEN 2 THEN 'SCHOOL' WHEN 3 THEN 'CLASSROOM' END AS visibility,
  CASE WHEN p_size % 4 <> 0 THEN p_partkey % 25 END AS school_id, CASE WHEN p_size % 7 = 0 THEN 'o' || (p_partkey % 25) END AS owner,
  CASE p_size % 3 WHEN 0 THEN 'PLATFORM' WHEN 1 THEN 'AUTHOR' ELSE 'IMPORTED' END AS origin FROM part)""",
    "nodes": """nodes AS (SELECT 'R' || r_regionkey AS id, NULL::VARCHAR AS parent, 'DISCIPLINE' AS type, r_name AS name FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'AREA', n_name FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'CONTENT', s_name FROM supplier
  UNION ALL SELECT 'P' || p_partkey, 'S' || (p_partkey % 10), 'SUBCONTENT', p_name FROM part WHERE p_partkey % 4 = 0)""",
    "edges": """edges AS (SELECT 'S' || s_suppkey AS content, 'S' || (s_suppkey // 2) AS needs FROM supplier WHERE s_suppkey >= 1)""",
    "links": """links AS (SELECT c_custkey AS user_id, c_name AS name, c_nationkey AS school_id, c_mktsegment AS classroom, c_acctbal > 0 AS active,
  CASE c_custkey % 9 WHEN 0 THEN 'TEACHER' WHEN 1 THEN 'COORDINATOR' ELSE 'STUDENT' END AS role,
  CASE WHEN c_custkey % 5 = 0 THEN 'SCHOOL' ELSE 'CLASSROOM' END AS scope FROM customer)""",
    "contexts": """contexts AS (SELECT event_id, user_id AS classroom, ts AS recorded_at, trunc(value)::BIGINT % 12 AS content, value < 100 AS active,
  CASE event_type WHEN 'signup' THEN 'TEACHER' WHEN 'purchase' THEN 'COORDINATION' ELSE 'SCHOOL_PLAN' END AS source
  FROM events WHERE event_type IN ('signup', 'purchase', 'view'))""",
}
NEEDS = {"mastery": ("items",)}


def sql(text: str) -> str:
    """The text with the views that it names put before it."""
    import re

    names: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in names:
            names.append(name)

    for n in SQL:
        if re.search(rf"\b{n}\b", text):
            add(n)
    text = text.strip()
    if not names:
        return text
    views = ",\n".join(SQL[n] for n in names)
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{text[14:]}"
    return f"WITH {views},\n{text[4:]}" if text.upper().startswith("WITH") else f"WITH {views}\n{text}"
