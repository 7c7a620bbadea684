"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from veredas.operators import filters as P
from veredas.operators.keys import page
from veredas.plans import tables as T
from veredas.plans.registry import query

AREAS = ((1, 12, "LANGUAGES"), (13, 25, "HUMANITIES"), (26, 38, "NATURE"), (39, 50, "MATHEMATICS"))


@query("flt_eq_optional", "SELECT essay_id, school, class, score FROM scores WHERE gre = 'ASIA' AND class = 'MACHINERY'")
def flt_eq_optional(spark, d):
    given = {"gre": "ASIA", "school": None, "class": "MACHINERY"}
    return P.equal_where_given(T.scores(spark, d), given).select("essay_id", "school", "class", "score")


@query("flt_bank", """SELECT question_id, content, exam, number FROM bank
WHERE exam IN ('SMALL', 'ECONOMY') AND number BETWEEN 13 AND 25 AND statement ILIKE '%ring%' AND coalesce(origin, '') <> 'AUTHOR' AND price >= 901""")
def flt_bank(spark, d):
    wanted = P.all_of(F.col("exam").isin("SMALL", "ECONOMY"), F.col("number").between(13, 25), P.any_ilike("%ring%", "statement"), ~F.col("origin").eqNullSafe("AUTHOR"), F.col("price") >= 901)
    return T.bank(spark, d).filter(wanted).select("question_id", "content", "exam", "number")


@query("flt_between", "SELECT question_id, number FROM bank WHERE number BETWEEN 26 AND 38")
def flt_between(spark, d):
    low, high = next((a, b) for a, b, name in AREAS if name == "NATURE")
    return T.bank(spark, d).filter(F.col("number").between(low, high)).select("question_id", "number")


@query("flt_ilike_or", "SELECT question_id, statement, exam FROM bank WHERE statement ILIKE '%bolt%' OR exam ILIKE '%bolt%'")
def flt_ilike_or(spark, d):
    return T.bank(spark, d).filter(P.any_ilike("%bolt%", "statement", "exam")).select("question_id", "statement", "exam")


@query("flt_lower_like", "SELECT user_id, name FROM links WHERE lower(name) LIKE '%0007%' OR lower(classroom) LIKE '%0007%' OR lower(role) LIKE '%0007%'")
def flt_lower_like(spark, d):
    found = F.lit(False)
    for c in ("name", "classroom", "role"):
        found = found | F.lower(c).like("%0007%")
    return T.links(spark, d).filter(found).select("user_id", "name")


@query("flt_substring", "SELECT user_id, name FROM links WHERE contains(lower(name), 'r#00000012')")
def flt_substring(spark, d):
    return T.links(spark, d).filter(P.contains("name", "R#00000012")).select("user_id", "name")


@query("flt_in_list", "SELECT student_id, content, score FROM mastery WHERE student_id IN (3, 5, 8)")
def flt_in_list(spark, d):
    return T.mastery(spark, d).filter(F.col("student_id").isin(3, 5, 8)).select("student_id", "content", "score")


@query("flt_not_in", "SELECT question_id, content FROM bank b WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.question_id = b.question_id AND i.student_id = 7)")
def flt_not_in(spark, d):
    seen = T.items(spark, d).filter("student_id = 7").select("question_id")
    return T.bank(spark, d).join(seen, "question_id", "left_anti").select("question_id", "content")


@query("flt_is_null", "SELECT count(*) FILTER (is_correct IS NULL) AS without, count(*) FILTER (is_correct IS NOT NULL) AS with_outcome FROM history")
def flt_is_null(spark, d):
    return T.history(spark, d).agg(F.count_if(F.col("is_correct").isNull()).alias("without"), F.count_if(F.col("is_correct").isNotNull()).alias("with_outcome"))


@query("flt_blank_content", r"""SELECT content_id, content, trim(translate(coalesce(content, ''), chr(9) || chr(10) || chr(13) || chr(11) || chr(12), '     ')) = '' AS is_blank
FROM (SELECT p_partkey AS content_id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(9) || chr(10) WHEN 2 THEN '' ELSE p_brand END AS content FROM part)""")
def flt_blank_content(spark, d):
    some = F.expr("case p_partkey % 4 when 0 then null when 1 then ' \\t\\n' when 2 then '' else p_brand end")
    rows = T.read(spark, d, "part").select(F.col("p_partkey").alias("content_id"), some.alias("content"))
    return rows.withColumn("is_blank", P.blank(F.col("content")))


@query("flt_upper_eq", "SELECT question_id FROM bank WHERE upper(exam) = 'ECONOMY'")
def flt_upper_eq(spark, d):
    return T.bank(spark, d).filter(F.upper("exam") == "economy".upper()).select("question_id")


@query("flt_json_path_eq", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def flt_json_path_eq(spark, d):
    return T.read(spark, d, "events").filter(P.json_text("props", "k") == "42").select("event_id")


@query("flt_json_bool", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 90")
def flt_json_bool(spark, d):
    flagged = F.expr("to_json(named_struct('flag', cast(get_json_object(props, '$.k') as int) > 90))")
    flag = F.try_variant_get(F.parse_json(flagged), "$.flag", "boolean")
    return T.read(spark, d, "events").filter(flag).select("event_id")


@query("flt_time_window", "SELECT student_id, count(*) AS n FROM history WHERE at_ >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS GROUP BY student_id")
def flt_time_window(spark, d):
    return T.history(spark, d).filter(P.since("at", "2024-01-31 00:00:00", "7 days")).groupBy("student_id").agg(F.count(F.lit(1)).alias("n"))


@query("flt_half_open_range", "SELECT event_id FROM history WHERE at_ >= TIMESTAMP '2024-01-10' AND at_ < TIMESTAMP '2024-01-11'")
def flt_half_open_range(spark, d):
    return T.history(spark, d).filter(P.between_half_open("at", "2024-01-10 00:00:00", "2024-01-11 00:00:00")).select("event_id")


@query("flt_closed_range", "SELECT event_id FROM history WHERE at_ >= TIMESTAMP '2024-01-29'")
def flt_closed_range(spark, d):
    return T.history(spark, d).filter(P.between_closed("at", "2024-01-29 00:00:00", "no date")).select("event_id")


@query("flt_recency", """SELECT event_id, classroom FROM contexts JOIN events USING (event_id)
WHERE recorded_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS AND coalesce(json_extract_string(props, '$.year'), '2026') = '2026'""")
def flt_recency(spark, d):
    year = F.coalesce(P.json_text("props", "year"), F.lit("2026"))
    rows = T.contexts(spark, d).join(T.read(spark, d, "events").select("event_id", "props"), "event_id")
    return rows.filter(P.since("recorded_at", "2024-01-31 00:00:00", "14 days") & (year == "2026")).select("event_id", "classroom")


@query("flt_classroom_or_global", "SELECT user_id FROM links WHERE (classroom = 'MACHINERY' OR scope = 'SCHOOL') AND school_id = 4")
def flt_classroom_or_global(spark, d):
    links = T.links(spark, d).withColumn("room", F.expr("case when scope <> 'SCHOOL' then classroom end"))
    own = F.col("room").isNull() | (F.col("room") == "MACHINERY") | (F.col("classroom") == "MACHINERY")
    return links.filter(own & (F.col("school_id") == 4)).select("user_id")


@query("flt_null_or_equal", "SELECT question_id FROM bank WHERE school_id IS NULL OR school_id = 12")
def flt_null_or_equal(spark, d):
    return T.bank(spark, d).filter(F.col("school_id").isNull() | (F.col("school_id") == 12)).select("question_id")


@query("flt_visibility_question", """SELECT question_id FROM bank WHERE CASE WHEN visibility = 'PUBLIC' THEN true
WHEN school_id IS NULL AND owner IS NULL AND origin IN ('PLATFORM', 'IMPORTED', 'GENERATED') THEN true
WHEN visibility = 'PRIVATE' THEN coalesce(owner = 'o3', false) OR coalesce(school_id = 3, false)
WHEN visibility = 'SCHOOL' THEN coalesce(school_id = 3, false)
WHEN visibility = 'CLASSROOM' THEN coalesce(school_id = 3, false) AND content = 'Brand#7'
ELSE visibility IS NULL AND coalesce(school_id = 3, false) END""")
def flt_visibility_question(spark, d):
    return T.bank(spark, d).filter(P.question_visible(3, "Brand#7")).select("question_id")


@query("flt_visibility_resource", """SELECT question_id, granted FROM (SELECT question_id, visibility, school_id, question_id IN (SELECT question_id FROM items WHERE student_id = 9) AS granted FROM bank)
WHERE visibility = 'PUBLIC' OR (visibility = 'SCHOOL' AND school_id = 3) OR granted""")
def flt_visibility_resource(spark, d):
    grants = T.items(spark, d).filter("student_id = 9").select("question_id").distinct().withColumn("granted", F.lit(True))
    rows = T.bank(spark, d).join(grants, "question_id", "left").withColumn("granted", F.coalesce("granted", F.lit(False)))
    own = F.coalesce((F.col("visibility") == "SCHOOL") & (F.col("school_id") == 3), F.lit(False))
    return rows.filter(F.col("visibility").eqNullSafe("PUBLIC") | own | F.col("granted")).select("question_id", "granted")


@query("flt_visibility_material", "SELECT question_id FROM bank WHERE visibility = 'PUBLIC' OR (visibility = 'SCHOOL' AND school_id = 5)")
def flt_visibility_material(spark, d):
    return T.bank(spark, d).filter((F.col("visibility") == "PUBLIC") | ((F.col("visibility") == "SCHOOL") & (F.col("school_id") == 5))).select("question_id")


@query("flt_tenant_role", "SELECT question_id FROM bank WHERE school_id IS NULL OR school_id = 6")
def flt_tenant_role(spark, d):
    role, school = "TEACHER", 6
    scope = None if role == "PLATFORM_ADMIN" else F.col("school_id").isNull() | (F.col("school_id") == school)
    return T.bank(spark, d).filter(P.all_of(scope)).select("question_id")


@query("flt_scope_membership", "SELECT user_id FROM links WHERE role = 'STUDENT' AND active AND school_id = 2 AND classroom IN ('MACHINERY', 'FURNITURE') AND scope = 'CLASSROOM'")
def flt_scope_membership(spark, d):
    classrooms, school_wide = ["MACHINERY", "FURNITURE"], False
    inside = F.col("classroom").isin(classrooms) & (F.col("scope") == "CLASSROOM") if classrooms else F.lit(False)
    rule = inside | (F.col("scope") == "SCHOOL") if school_wide else inside
    return T.links(spark, d).filter((F.col("role") == "STUDENT") & F.col("active") & (F.col("school_id") == 2) & rule).select("user_id")


@query("flt_eligibility", """SELECT question_id, list_filter([CASE WHEN school_id IS NULL THEN 'NO_SCHOOL' END, CASE WHEN visibility IS NULL THEN 'NO_VISIBILITY' END,
CASE WHEN number > 40 THEN 'LATE' END, CASE WHEN owner IS NULL THEN 'NO_OWNER' END, CASE WHEN price < 950 THEN 'CHEAP' END], lambda x: x IS NOT NULL) AS reasons FROM bank""", lists=("reasons",))
def flt_eligibility(spark, d):
    broken = P.reasons(NO_SCHOOL=F.col("school_id").isNull(), NO_VISIBILITY=F.col("visibility").isNull(), LATE=F.col("number") > 40, NO_OWNER=F.col("owner").isNull(), CHEAP=F.col("price") < 950)
    return T.bank(spark, d).select("question_id", broken.alias("reasons"))


@query("flt_availability_state", """SELECT essay_id, CASE WHEN s <> 'ACTIVE' THEN s WHEN TIMESTAMP '1998-01-01' < a THEN 'WAITING' WHEN TIMESTAMP '1998-01-01' > b THEN 'CLOSED' ELSE 'OPEN' END AS state
FROM (SELECT essay_id, CASE status WHEN 'P' THEN 'CANCELLED' ELSE 'ACTIVE' END AS s, at_ AS a, at_ + INTERVAL 90 DAYS AS b FROM scores)""")
def flt_availability_state(spark, d):
    rows = T.scores(spark, d).selectExpr("essay_id", "case status when 'P' then 'CANCELLED' else 'ACTIVE' end as s", "at as a", "at + interval 90 days as b")
    return rows.select("essay_id", P.availability("s", "a", "b", "1998-01-01 00:00:00").alias("state"))


@query("flt_whitelist_sort", "SELECT essay_id, score FROM scores ORDER BY score DESC, essay_id LIMIT 50")
def flt_whitelist_sort(spark, d):
    by = P.sort_column("drop table", {"score": "score", "c1": "c1"}, "score")
    return page(T.scores(spark, d).select("essay_id", "score"), [F.desc(by), F.asc("essay_id")], 1, 50)


@query("flt_review_queue", """SELECT event_id, confidence FROM (SELECT event_id, least(value / 400, 1.0::DOUBLE) AS confidence, list_filter([CASE WHEN value < 20 THEN 'LOW' END, CASE WHEN kind = 'error' THEN 'ERROR' END], lambda x: x IS NOT NULL) AS reasons FROM history)
WHERE list_contains(reasons, 'ERROR') AND confidence BETWEEN 0.1 AND 0.5""")
def flt_review_queue(spark, d):
    rows = T.history(spark, d).select("event_id", F.least(F.col("value") / 400, F.lit(1.0)).alias("confidence"), P.reasons(LOW=F.col("value") < 20, ERROR=F.col("kind") == "error").alias("reasons"))
    return rows.filter(F.array_contains("reasons", "ERROR") & F.col("confidence").between(0.1, 0.5)).select("event_id", "confidence")


@query("prj_json_extract", "SELECT essay_id, c1, c2, c3, c4, c5, score AS total FROM scores")
def prj_json_extract(spark, d):
    packed = T.scores(spark, d).withColumn("final", F.to_json(F.struct(F.col("score").alias("total"), F.struct(*[F.struct(F.col(f"c{k}").alias("points")).alias(f"C{k}") for k in range(1, 6)]).alias("per_competency"))))
    final = F.from_json("final", "total bigint, per_competency struct<" + ", ".join(f"C{k}: struct<points: bigint>" for k in range(1, 6)) + ">")
    rows = packed.select("essay_id", final.alias("f"))
    return rows.select("essay_id", *[F.col(f"f.per_competency.C{k}.points").alias(f"c{k}") for k in range(1, 6)], F.col("f.total").alias("total"))


@query("prj_map_lookup_default", "SELECT c_custkey AS user_id, CASE WHEN n_nationkey < 20 THEN r_name ELSE 'NO REGION' END AS gre, CASE WHEN n_nationkey < 20 THEN n_name ELSE 'NO CITY' END AS city FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def prj_map_lookup_default(spark, d):
    known = T.read(spark, d, "nation").filter("n_nationkey < 20").join(T.read(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = T.read(spark, d, "customer").join(known, F.expr("c_nationkey = n_nationkey"), "left")
    return rows.select(F.col("c_custkey").alias("user_id"), F.coalesce("r_name", F.lit("NO REGION")).alias("gre"), F.coalesce("n_name", F.lit("NO CITY")).alias("city"))


@query("prj_display_name", "SELECT question_id, 'Brand ' || substr(content, 7) AS shown FROM bank")
def prj_display_name(spark, d):
    return T.bank(spark, d).select("question_id", F.initcap(F.regexp_replace(F.lower("content"), "#", " ")).alias("shown"))


@query("prj_title_concat", "SELECT question_id, CASE WHEN owner IS NOT NULL AND owner <> '' THEN statement || ' - ' || owner ELSE statement END AS title FROM bank")
def prj_title_concat(spark, d):
    themed = F.coalesce(F.col("owner") != "", F.lit(False))
    return T.bank(spark, d).select("question_id", F.when(themed, F.concat_ws(" - ", "statement", "owner")).otherwise(F.col("statement")).alias("title"))
