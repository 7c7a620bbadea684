"""Joins."""

from __future__ import annotations


from pyspark.sql import functions as F

from veredas.functions.scoring import ESSAY_BANDS
from veredas.operators import joins as J
from veredas.operators.filters import allowed_or_blank
from veredas.operators.keys import first_per_key, latest_per_key
from veredas.plans import tables as T
from veredas.plans.filters import AREAS
from veredas.plans.registry import query

AREA_SQL = "CASE WHEN {0} BETWEEN 1 AND 12 THEN 'LANGUAGES' WHEN {0} BETWEEN 13 AND 25 THEN 'HUMANITIES' WHEN {0} BETWEEN 26 AND 38 THEN 'NATURE' WHEN {0} BETWEEN 39 AND 50 THEN 'MATHEMATICS' END"
BAND_SQL = "CASE WHEN score <= 399 THEN 'Muito baixo' WHEN score <= 599 THEN 'Baixo' WHEN score <= 799 THEN 'Adequado' WHEN score <= 899 THEN 'Alto' ELSE 'Muito alto' END"
LATEST_SQL = "(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) = 1)"


def _latest_order(spark, d):
    return latest_per_key(T.read(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("join_inner_chain5", """SELECT p_brand AS content, n_name AS school, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def join_inner_chain5(spark, d):
    e = F.expr
    rows = T.read(spark, d, "lineitem").join(T.read(spark, d, "orders"), e("l_orderkey = o_orderkey")).join(T.read(spark, d, "part"), e("l_partkey = p_partkey"))
    rows = rows.join(T.read(spark, d, "customer"), e("o_custkey = c_custkey")).join(T.read(spark, d, "nation"), e("c_nationkey = n_nationkey"))
    return rows.groupBy(F.col("p_brand").alias("content"), F.col("n_name").alias("school")).agg(F.count(F.lit(1)).alias("n"))


@query("join_inner_chain4", "SELECT essay_id, school, gre, score FROM scores WHERE status = 'F' AND score >= 900")
def join_inner_chain4(spark, d):
    return T.scores(spark, d).filter("status = 'F' and score >= 900").select("essay_id", "school", "gre", "score")


@query("join_lateral_latest", f"SELECT c_custkey AS student_id, c_name AS name, o_orderkey AS enrolment_id FROM customer LEFT JOIN {LATEST_SQL} ON c_custkey = o_custkey")
def join_lateral_latest(spark, d):
    rows = T.read(spark, d, "customer").join(_latest_order(spark, d), F.expr("c_custkey = o_custkey"), "left")
    return rows.selectExpr("c_custkey as student_id", "c_name as name", "o_orderkey as enrolment_id")


@query("join_left_outer", "SELECT s_suppkey AS class_id, n_name AS unit FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 10")
def join_left_outer(spark, d):
    units = T.read(spark, d, "nation").filter("n_nationkey < 10")
    return T.read(spark, d, "supplier").join(units, F.expr("s_nationkey = n_nationkey"), "left").selectExpr("s_suppkey as class_id", "n_name as unit")


@query("join_left_agg_subquery", "SELECT c_custkey AS prompt_id, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey")
def join_left_agg_subquery(spark, d):
    counts = T.read(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = T.read(spark, d, "customer").join(counts, F.expr("c_custkey = o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("prompt_id"), F.coalesce("n", F.lit(0)).alias("n"))


@query("join_outer_on_pred", """SELECT question_id, content FROM bank WHERE content IN ('Brand#1', 'Brand#2', 'Brand#3') OR trim(coalesce(content, '')) = ''""")
def join_outer_on_pred(spark, d):
    allowed = T.bank(spark, d).filter("content in ('Brand#1', 'Brand#2', 'Brand#3')").select("content").distinct().withColumnRenamed("content", "code")
    return allowed_or_blank(T.bank(spark, d), "content", allowed, "code").select("question_id", "content")


@query("join_anti_outer_null", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti_outer_null(spark, d):
    return J.unclassified(T.read(spark, d, "documents"), T.read(spark, d, "labels"), "doc_id").select("doc_id")


@query("join_anti_exists", "SELECT o_orderkey AS submission_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti_exists(spark, d):
    done = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.read(spark, d, "orders").join(done, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("submission_id"))


@query("join_semi_exists", "SELECT question_id FROM bank b WHERE EXISTS (SELECT 1 FROM mastery m WHERE m.score < 30 AND (m.content = b.content OR m.student_id = b.question_id OR m.student_id = b.school_id))")
def join_semi_exists(spark, d):
    bank, weak = T.bank(spark, d), T.mastery(spark, d).filter("score < 30")
    one = bank.join(weak.select("content").distinct(), "content", "left_semi")
    ids = weak.select(F.col("student_id").alias("k")).distinct()
    two, three = (bank.join(ids, F.col(c) == F.col("k"), "left_semi") for c in ("question_id", "school_id"))
    return one.select("question_id").union(two.select("question_id")).union(three.select("question_id")).distinct()


@query("join_semi_in_subquery", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join_semi_in_subquery(spark, d):
    return T.read(spark, d, "documents").join(T.read(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("join_semi_or", "SELECT question_id FROM bank WHERE content = 'Brand#5' OR question_id IN (SELECT question_id FROM items WHERE student_id = 11)")
def join_semi_or(spark, d):
    bank = T.bank(spark, d)
    linked = bank.join(T.items(spark, d).filter("student_id = 11").select("question_id"), "question_id", "left_semi")
    return bank.filter("content = 'Brand#5'").select("question_id").union(linked.select("question_id")).distinct()


@query("join_range_asset", """SELECT a.p_partkey AS asset_id, q.p_partkey AS question_id FROM part a JOIN part q ON a.p_brand = q.p_brand AND a.p_size BETWEEN q.p_size - 1 AND q.p_size + 1
WHERE a.p_type = 'SMALL' AND q.p_type = 'ECONOMY'""")
def join_range_asset(spark, d):
    part = T.read(spark, d, "part")
    assets = part.filter("p_type = 'SMALL'").selectExpr("p_partkey as asset_id", "p_brand as run", "p_size as page")
    questions = part.filter("p_type = 'ECONOMY'").selectExpr("p_partkey as question_id", "p_brand as run", "p_size - 1 as page_start", "p_size + 1 as page_end")
    # a page interval is short: one row a page turns the range into a key
    pages = questions.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    return assets.join(pages, ["run", "page"]).select("asset_id", "question_id")


@query("join_asof_territory", """SELECT e.event_id, s.event_id AS owner FROM (SELECT * FROM events WHERE event_type <> 'signup') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def join_asof_territory(spark, d):
    rows = T.read(spark, d, "events")
    starts = rows.filter("event_type = 'signup'").selectExpr("user_id", "ts", "event_id as owner")
    points = rows.filter("event_type <> 'signup'").select("user_id", "ts", "event_id")
    return J.territory(starts, points, "user_id", ["ts"], "owner").select("event_id", "owner")


@query("join_range_band", f"SELECT essay_id, score, {BAND_SQL} AS band FROM scores WHERE score <= 1000")
def join_range_band(spark, d):
    return T.scores(spark, d).filter("score <= 1000").select("essay_id", "score", J.band(F.col("score"), ESSAY_BANDS).alias("band"))


@query("join_range_area", f"SELECT question_id, {AREA_SQL.format('number')} AS area FROM bank")
def join_range_area(spark, d):
    return T.bank(spark, d).select("question_id", J.band(F.col("number"), AREAS, strict=False).alias("area"))


@query("join_hash_dict", "SELECT student_id, result_id, position, items.question_id, exam, is_correct FROM items JOIN bank USING (question_id)")
def join_hash_dict(spark, d):
    return T.items(spark, d).join(T.bank(spark, d).select("question_id", "exam"), "question_id").select("student_id", "result_id", "position", "question_id", "exam", "is_correct")


@query("join_exact_unique_match", """WITH r AS (SELECT c_custkey AS student_id, c_mktsegment || (c_custkey % 300) AS key, c_name AS glued FROM customer),
k AS (SELECT key, min(student_id) AS a FROM r GROUP BY 1 HAVING count(*) = 1), g AS (SELECT glued, min(student_id) AS b FROM r GROUP BY 1 HAVING count(*) = 1),
p AS (SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 = 0 THEN 'MACHINERY' ELSE 'FURNITURE' END || (o_custkey % 300) AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS glued FROM orders)
SELECT page_id, coalesce(a, b) AS student_id FROM p LEFT JOIN k USING (key) LEFT JOIN g USING (glued)""")
def join_exact_unique_match(spark, d):
    roster = T.read(spark, d, "customer").selectExpr("c_custkey as student_id", "concat(c_mktsegment, c_custkey % 300) as key", "c_name as glued")
    pages = T.read(spark, d, "orders").selectExpr("o_orderkey as page_id", "concat(if(o_orderkey % 3 = 0, 'MACHINERY', 'FURNITURE'), o_custkey % 300) as key", "if(o_orderkey % 2 = 0, concat('Customer#', lpad(o_custkey, 9, '0')), null) as glued")
    return J.unique_match(pages, roster, ["key", "glued"], "student_id").select("page_id", "student_id")


@query("join_latest_answer_key", "SELECT l_partkey AS question_id, l_orderkey AS revision, l_returnflag AS answer FROM lineitem WHERE l_linestatus = 'F' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1")
def join_latest_answer_key(spark, d):
    official = T.read(spark, d, "lineitem").filter("l_linestatus = 'F'")
    newest = first_per_key(official, ["l_partkey"], [F.desc("l_orderkey"), F.desc("l_linenumber")])
    return newest.selectExpr("l_partkey as question_id", "l_orderkey as revision", "l_returnflag as answer")


@query("join_multi_key_lookup", """SELECT user_id, o_orderkey AS diagnostic_id FROM links LEFT JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY
row_number() OVER (PARTITION BY o_custkey, c_nationkey, o_orderstatus ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) = 1) ON user_id = o_custkey AND school_id = c_nationkey AND o_orderstatus = 'F'""")
def join_multi_key_lookup(spark, d):
    tests = T.read(spark, d, "orders").join(T.read(spark, d, "customer"), F.expr("o_custkey = c_custkey")).filter("o_orderstatus = 'F'")
    newest = latest_per_key(tests, ["o_custkey", "c_nationkey", "o_orderstatus"], "o_orderdate", "o_orderkey")
    return T.links(spark, d).join(newest, F.expr("user_id = o_custkey and school_id = c_nationkey"), "left").selectExpr("user_id", "o_orderkey as diagnostic_id")


@query("join_path_segments", """SELECT x.event_id, x.user_id, CASE WHEN x.event_type = 'error' THEN 'NOT_APPLICABLE' WHEN c_custkey IS NULL THEN 'NOT_FOUND' ELSE 'RESOLVED' END AS state
FROM events x LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON user_id = c_custkey""")
def join_path_segments(spark, d):
    own = T.read(spark, d, "customer").filter("c_nationkey < 12").select("c_custkey")
    state = F.when(F.col("event_type") == "error", "NOT_APPLICABLE").when(F.col("c_custkey").isNull(), "NOT_FOUND").otherwise("RESOLVED")
    return T.read(spark, d, "events").join(own, F.expr("user_id = c_custkey"), "left").select("event_id", "user_id", state.alias("state"))


@query("join_prereq_edges", "SELECT a.name AS content, b.name AS needs FROM edges JOIN nodes a ON content = a.id JOIN nodes b ON needs = b.id WHERE content <> needs")
def join_prereq_edges(spark, d):
    names = T.nodes(spark, d).select("id", "name")
    a, b = names.select(F.col("id").alias("content"), F.col("name").alias("a")), names.select(F.col("id").alias("needs"), F.col("name").alias("b"))
    return T.edges(spark, d).join(a, "content").join(b, "needs").filter("content <> needs").select(F.col("a").alias("content"), F.col("b").alias("needs")).distinct()


@query("join_student_chain", f"SELECT user_id, school_id, o_orderkey AS enrolment_id FROM links JOIN {LATEST_SQL} ON user_id = o_custkey WHERE active AND role = 'STUDENT'")
def join_student_chain(spark, d):
    return T.links(spark, d).filter("active and role = 'STUDENT'").join(_latest_order(spark, d), F.expr("user_id = o_custkey")).selectExpr("user_id", "school_id", "o_orderkey as enrolment_id")


@query("join_coverage_cross", """WITH k AS (SELECT student_id, discipline, count(*) AS n FROM items GROUP BY ALL), e AS (SELECT student_id, 'D' || unnest(generate_series(0, 9)) AS discipline FROM (SELECT DISTINCT student_id FROM items))
SELECT student_id, discipline, coalesce(n, 0)::BIGINT AS n FROM e LEFT JOIN k USING (student_id, discipline)""")
def join_coverage_cross(spark, d):
    """Every discipline of every student: the disciplines are a short list that each student's counts are laid over."""
    counts = T.items(spark, d).groupBy("student_id", "discipline").agg(F.count(F.lit(1)).alias("n"))
    every = counts.select("student_id").distinct().select("student_id", F.explode(F.array(*[F.lit(f"D{i}") for i in range(10)])).alias("discipline"))
    return every.join(counts, ["student_id", "discipline"], "left").select("student_id", "discipline", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_full_outer_merge", """WITH b AS (SELECT p_partkey AS number, p_size % 6 AS options, length(p_name) AS size, p_name AS text FROM part WHERE p_partkey % 3 <> 0),
e AS (SELECT p_partkey AS number, p_size % 5 AS options, length(p_brand) AS size, p_brand AS text FROM part WHERE p_partkey % 4 <> 0),
m AS (SELECT coalesce(b.number, e.number) AS number, CASE WHEN e.number IS NULL THEN 'base' WHEN b.number IS NULL THEN 'better' WHEN e.options > b.options OR (e.options = b.options AND e.size > b.size) THEN 'better' ELSE 'base' END AS winner,
b.options AS bo, e.options AS eo, b.size AS bs, e.size AS es, b.text AS bt, e.text AS et FROM b FULL OUTER JOIN e ON b.number = e.number)
SELECT number, winner, CASE winner WHEN 'base' THEN bo ELSE eo END AS options, CASE winner WHEN 'base' THEN bs ELSE es END AS size, CASE winner WHEN 'base' THEN bt ELSE et END AS text FROM m""")
def join_full_outer_merge(spark, d):
    part = T.read(spark, d, "part")
    base = part.filter("p_partkey % 3 <> 0").selectExpr("p_partkey as number", "p_size % 6 as options", "length(p_name) as size", "p_name as text")
    better = part.filter("p_partkey % 4 <> 0").selectExpr("p_partkey as number", "p_size % 5 as options", "length(p_brand) as size", "p_brand as text")
    return J.merge_passes(base, better, "number", "options", "size")


@query("join_left_keep_unlinked", "SELECT s_suppkey AS item_id, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def join_left_keep_unlinked(spark, d):
    linked = T.read(spark, d, "nation").filter("n_nationkey % 2 = 0")
    rows = T.read(spark, d, "supplier").join(linked, F.expr("s_nationkey = n_nationkey"), "left").join(T.read(spark, d, "region"), F.expr("n_regionkey = r_regionkey"), "left")
    return rows.selectExpr("s_suppkey as item_id", "n_name", "r_name")


@query("join_candidate_authorized", "SELECT DISTINCT question_id FROM items JOIN bank USING (question_id) JOIN links ON student_id = user_id WHERE visibility = 'PUBLIC' AND active AND answered")
def join_candidate_authorized(spark, d):
    public, active = T.bank(spark, d).filter("visibility = 'PUBLIC'"), T.links(spark, d).filter("active").select(F.col("user_id").alias("student_id"))
    return T.items(spark, d).filter("answered").join(public.select("question_id"), "question_id", "left_semi").join(active, "student_id", "left_semi").select("question_id").distinct()


@query("join_roster_class", f"SELECT user_id, name FROM links JOIN {LATEST_SQL} ON user_id = o_custkey WHERE active AND contains(lower(name), '12')")
def join_roster_class(spark, d):
    return T.links(spark, d).filter("active and contains(lower(name), '12')").join(_latest_order(spark, d), F.expr("user_id = o_custkey"), "left_semi").select("user_id", "name")


@query("join_target_expand", "SELECT DISTINCT user_id, name FROM links LEFT JOIN customer ON user_id = c_custkey WHERE classroom = 'MACHINERY' OR school_id IN (1, 2) OR user_id IN (5, 6)")
def join_target_expand(spark, d):
    links = T.links(spark, d)
    grades = spark.createDataFrame([(1,), (2,)], "school_id int")
    targets = links.join(grades, "school_id", "left_semi").select("user_id").union(links.filter("classroom = 'MACHINERY'").select("user_id")).union(links.filter("user_id in (5, 6)").select("user_id")).distinct()
    return targets.join(links.select("user_id", "name"), "user_id", "left")


@query("join_deep_filter_chain", "SELECT question_id FROM bank WHERE question_id IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT')")
def join_deep_filter_chain(spark, d):
    def apply(rows, priority=None, mode=None):
        """The chain joins in only if a filter needs it."""
        if priority is None and mode is None:
            return rows
        chain = T.read(spark, d, "lineitem").join(T.read(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
        chain = chain.filter(F.col("o_orderpriority") == priority) if priority else chain
        return rows.join(chain.select(F.col("l_partkey").alias("question_id")), "question_id", "left_semi")

    return apply(T.bank(spark, d), priority="1-URGENT").select("question_id")


@query("join_active_primary", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE toxic = 0")
def join_active_primary(spark, d):
    active = T.read(spark, d, "labels").filter("toxic = 0")
    one = first_per_key(active, ["doc_id"], [F.desc("quality")])
    return T.read(spark, d, "documents").select("doc_id").join(one.select("doc_id", "quality"), "doc_id")


@query("join_needs_review", "SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 ORDER BY doc_id")
def join_needs_review(spark, d):
    review = T.read(spark, d, "labels").filter("quality = 0")
    return T.read(spark, d, "documents").join(review.select("doc_id"), "doc_id").select("doc_id", "source").orderBy("doc_id")


@query("join_lexical", """WITH q AS (SELECT statement, unnest(list_distinct(string_split(statement, ' '))) AS t FROM (SELECT DISTINCT statement FROM bank)), n AS (SELECT id, unnest(list_distinct(string_split(lower(name), ' '))) AS t FROM nodes WHERE type = 'SUBCONTENT')
SELECT statement, id, count(*) AS common FROM q JOIN n USING (t) GROUP BY 1, 2""")
def join_lexical(spark, d):
    """Candidates of each distinct statement, which all questions of that statement share."""
    statements = T.bank(spark, d).select("statement").distinct().withColumn("tokens", F.split("statement", " "))
    places = T.nodes(spark, d).filter("type = 'SUBCONTENT'").select("id", F.split(F.lower("name"), " ").alias("tokens"))
    return J.token_overlap(statements, "statement", places, "id")


@query("join_lexical_all", """WITH q AS (SELECT question_id, unnest(list_distinct(string_split(statement, ' '))) AS t FROM bank), n AS (SELECT id, unnest(list_distinct(string_split(lower(name), ' '))) AS t FROM nodes WHERE type = 'SUBCONTENT')
SELECT question_id, id, count(*) AS common FROM q JOIN n USING (t) GROUP BY 1, 2""")
def join_lexical_all(spark, d):
    return _lexical(spark, d, T.bank(spark, d))


def _lexical(spark, d, bank):
    questions = bank.select("question_id", F.split("statement", " ").alias("tokens"))
    places = T.nodes(spark, d).filter("type = 'SUBCONTENT'").select("id", F.split(F.lower("name"), " ").alias("tokens"))
    return J.token_overlap(questions, "question_id", places, "id")
