"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from veredas.functions import scoring as S
from veredas.functions import text as X
from veredas.operators import aggregates as A
from veredas.operators.joins import band
from veredas.operators.keys import first_per_key, n_rows, with_total
from veredas.operators.proficiency import coverage, estimates
from veredas.plans import tables as T
from veredas.plans.joins import BAND_SQL
from veredas.plans.registry import query


def _graded(spark, d):
    return T.scores(spark, d).filter("score <= 1000").withColumn("band", band(F.col("score"), S.ESSAY_BANDS))


METRICS_SQL = """WITH g AS (SELECT *, {band} AS band FROM scores WHERE score <= 1000),
s AS (SELECT {by} count(*) AS n, round(avg(score), 2) AS mean, median(score)::DOUBLE AS median, round(stddev_pop(score), 2) AS deviation FROM g GROUP BY ALL),
b AS (SELECT {by} band, count(*) AS k FROM g GROUP BY ALL)
SELECT s.*, map_from_entries(list((b.band, round(b.k * 100.0::DOUBLE / s.n, 1)) ORDER BY b.band)) AS bands FROM s JOIN b ON {on} GROUP BY ALL"""


@query("agg_metrics", METRICS_SQL.format(band=BAND_SQL, by="", on="true"), maps=("bands",))
def agg_metrics(spark, d):
    return A.score_metrics(_graded(spark, d), "score", "band")


@query("agg_cut_metrics", METRICS_SQL.format(band=BAND_SQL, by="school,", on="s.school = b.school"), maps=("bands",))
def agg_cut_metrics(spark, d):
    return A.score_metrics(_graded(spark, d), "score", "band", ["school"])


RANKED = """SELECT gre, school, count(*) AS n, round(avg(score), 1) AS media, round(avg(c1), 1) AS c1, round(avg(c2), 1) AS c2, round(avg(c3), 1) AS c3, round(avg(c4), 1) AS c4, round(avg(c5), 1) AS c5,
round(100.0::DOUBLE * count(*) FILTER (score >= 800) / count(*), 1) AS pct_800 FROM scores GROUP BY gre, school"""


@query("agg_group_avg_pct", RANKED)
def agg_group_avg_pct(spark, d):
    means = A.means_of({"media": "score"} | {f"c{k}": f"c{k}" for k in range(1, 6)})
    return T.scores(spark, d).groupBy("gre", "school").agg(n_rows().alias("n"), *means, A.share_at_least("score", 800).alias("pct_800")).orderBy(F.desc("media"), "school")


@query("agg_global_avg", "SELECT round(coalesce(avg(c1), 0), 1) AS c1, round(coalesce(avg(c2), 0), 1) AS c2, round(coalesce(avg(c3), 0), 1) AS c3, round(coalesce(avg(c4), 0), 1) AS c4, round(coalesce(avg(c5), 0), 1) AS c5 FROM scores")
def agg_global_avg(spark, d):
    return T.scores(spark, d).agg(*A.means_of({f"c{k}": f"c{k}" for k in range(1, 6)}))


@query("agg_group_class", "SELECT school, class, count(*) AS n, round(avg(score), 1) AS media FROM scores WHERE class IS NOT NULL GROUP BY ALL")
def agg_group_class(spark, d):
    return T.scores(spark, d).filter("class is not null").groupBy("school", "class").agg(n_rows().alias("n"), F.round(F.avg("score"), 1).alias("media"))


@query("agg_count_distinct", "SELECT count(DISTINCT student_id) AS active FROM history WHERE at_ >= TIMESTAMP '2024-01-31' - INTERVAL 2 DAYS")
def agg_count_distinct(spark, d):
    return T.history(spark, d).filter("at >= timestamp_ntz'2024-01-31' - interval 2 days").agg(F.count_distinct("student_id").alias("active"))


@query("agg_count_distinct_page", "SELECT count(DISTINCT question_id) AS total FROM items WHERE content = 'Brand#3'")
def agg_count_distinct_page(spark, d):
    return with_total(T.items(spark, d).filter("content = 'Brand#3'"), "question_id")


@query("agg_count_subquery", "SELECT count(*) AS total FROM (SELECT DISTINCT student_id, content FROM items)")
def agg_count_subquery(spark, d):
    return T.items(spark, d).select("student_id", "content").distinct().agg(n_rows().alias("total"))


@query("agg_group_count", """SELECT question_id, coalesce(a.n, 0)::BIGINT AS seen, coalesce(b.n, 0)::BIGINT AS answered, coalesce(c.n, 0)::BIGINT AS correct FROM bank
LEFT JOIN (SELECT question_id, count(*) n FROM items GROUP BY 1) a USING (question_id) LEFT JOIN (SELECT question_id, count(*) n FROM items WHERE answered GROUP BY 1) b USING (question_id)
LEFT JOIN (SELECT question_id, count(*) n FROM items WHERE is_correct GROUP BY 1) c USING (question_id)""")
def agg_group_count(spark, d):
    counts = T.items(spark, d).groupBy("question_id").agg(n_rows().alias("seen"), *A.counters(answered=F.col("answered"), correct=F.col("is_correct")))
    return T.bank(spark, d).select("question_id").join(counts, "question_id", "left").na.fill(0)


@query("agg_group_max", "SELECT question_id, max(result_id) AS newest FROM items GROUP BY 1")
def agg_group_max(spark, d):
    return T.items(spark, d).groupBy("question_id").agg(F.max("result_id").alias("newest"))


@query("agg_group_min", "SELECT question_id, min(position) AS first FROM bank LEFT JOIN items USING (question_id) GROUP BY 1")
def agg_group_min(spark, d):
    firsts = T.items(spark, d).groupBy("question_id").agg(F.min("position").alias("first"))
    return T.bank(spark, d).select("question_id").join(firsts, "question_id", "left")


@query("agg_scalar_max", "SELECT coalesce(max(result_id), 0) + 1 AS next_version FROM items")
def agg_scalar_max(spark, d):
    return T.items(spark, d).agg((F.coalesce(F.max("result_id"), F.lit(0)) + 1).alias("next_version"))


@query("agg_group_sum2", "SELECT stage, map_from_entries(list((status, n) ORDER BY status)) AS requests FROM (SELECT o_orderpriority AS stage, o_orderstatus AS status, sum(o_orderkey % 100)::BIGINT AS n FROM orders GROUP BY ALL) GROUP BY stage", maps=("requests",))
def agg_group_sum2(spark, d):
    sums = T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status")).agg(F.sum(F.expr("o_orderkey % 100")).alias("n"))
    return sums.groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("requests"))


# Means of two-decimal scores from sums of integers: sums of doubles would depend on the order of rows.
MX = "sum(round(score * 100)::BIGINT)::DOUBLE / (100.0::DOUBLE * count(score))"
M2 = "((2 * sum(round(score * 100)::BIGINT) + count(score)) // (2 * count(score)))::BIGINT / 100.0::DOUBLE"


@query("agg_student_bucket", f"SELECT CASE WHEN m < 48 THEN 'STRUGGLING' WHEN m < 52 THEN 'DEVELOPING' ELSE 'CONSOLIDATED' END AS bucket, count(*) AS n FROM (SELECT student_id, {MX} AS m FROM mastery GROUP BY 1) GROUP BY 1")
def agg_student_bucket(spark, d):
    return A.bucket_by_average(T.mastery(spark, d), "student_id", "score", [(48.0, "STRUGGLING"), (52.0, "DEVELOPING")], "CONSOLIDATED")


@query("agg_content_avg", f"SELECT content, {M2} AS mean, count(*) FILTER (score < 50) AS struggling, count(*) AS n FROM mastery GROUP BY 1")
def agg_content_avg(spark, d):
    return T.mastery(spark, d).groupBy("content").agg(A.rounded_mean("score").alias("mean"), F.count_if(F.col("score") < 50).alias("struggling"), n_rows().alias("n")).orderBy("mean", "content")


@query("agg_classroom_items", f"""WITH r AS (SELECT DISTINCT student_id, student_id % 8 AS classroom FROM mastery), c AS (SELECT classroom, content, {MX} AS m FROM r JOIN mastery USING (student_id) GROUP BY ALL),
p AS (SELECT classroom, list(content ORDER BY m, content)[1:3] AS priority FROM c WHERE m < 50 GROUP BY 1)
SELECT r.classroom, count(DISTINCT r.student_id) AS students, {M2} AS mean, any_value(priority) AS priority FROM r JOIN mastery USING (student_id) LEFT JOIN p ON p.classroom = r.classroom GROUP BY 1""", lists=("priority",))
def agg_classroom_items(spark, d):
    rows = T.mastery(spark, d).withColumn("classroom", F.expr("student_id % 8"))
    weak = rows.groupBy("classroom", "content").agg(A.exact_mean("score").alias("m")).filter("m < 50").groupBy("classroom").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("m", "content"))), lambda x: x["content"]), 1, 3).alias("priority"))
    stats = rows.groupBy("classroom").agg(F.count_distinct("student_id").alias("students"), A.rounded_mean("score").alias("mean"))
    return stats.join(weak, "classroom", "left")


@query("agg_hierarchy_rollup", """WITH c AS (SELECT gre AS unit, school AS segment, CASE WHEN student_id % 9 = 0 THEN 'Sem série cadastrada' ELSE 'G' || student_id % 4 END AS grade, class, round(avg(score), 1) AS m, count(DISTINCT student_id) AS k FROM scores WHERE class IS NOT NULL GROUP BY ALL)
SELECT unit, segment, grade, ((2 * sum(round(m * 10)::BIGINT) + count(m)) // (2 * count(m)))::BIGINT / 10.0::DOUBLE AS mean, sum(k)::BIGINT AS students, CASE WHEN grouping(grade) = 0 THEN string_agg(class || '=' || m, ',' ORDER BY class) END AS classrooms
FROM c GROUP BY GROUPING SETS ((unit, segment, grade), (unit, segment), (unit), ())""")
def agg_hierarchy_rollup(spark, d):
    """Units, segments, grades and their classrooms: a level's mean is that of its classrooms' rounded means, whatever their size."""
    grade = F.expr("case when student_id % 9 = 0 then 'Sem série cadastrada' else concat('G', student_id % 4) end")
    rooms = T.scores(spark, d).filter("class is not null").select(F.col("gre").alias("unit"), F.col("school").alias("segment"), grade.alias("grade"), "class", "student_id", "score")
    rooms = rooms.groupBy("unit", "segment", "grade", "class").agg(F.round(F.avg("score"), 1).alias("m"), F.count_distinct("student_id").alias("k"))
    found = A.hierarchy(rooms, ["unit", "segment", "grade"], "class", "m", "k")
    return found.withColumn("classrooms", F.array_join(F.transform("classrooms", lambda c: F.concat(c["class"], F.lit("="), c["m"].cast("string"))), ","))


@query("agg_teacher_summary", f"""SELECT teacher, count(DISTINCT student_id) AS students, {M2} AS mean, count(DISTINCT last_at::DATE) AS lessons FROM (SELECT 't' || (student_id % 11) AS teacher, * FROM mastery) GROUP BY 1""")
def agg_teacher_summary(spark, d):
    rows = T.mastery(spark, d).withColumn("teacher", F.expr("concat('t', student_id % 11)"))
    return rows.groupBy("teacher").agg(F.count_distinct("student_id").alias("students"), A.rounded_mean("score").alias("mean"), F.count_distinct(F.to_date("last_at")).alias("lessons"))


@query("agg_compare_classrooms", f"SELECT student_id % 8 AS classroom, count(DISTINCT student_id) AS students, {M2} AS mean, count(*) FILTER (score < 50) AS struggling, min(score) AS worst, max(score) AS best FROM mastery GROUP BY 1")
def agg_compare_classrooms(spark, d):
    rows = T.mastery(spark, d).withColumn("classroom", F.expr("student_id % 8"))
    return rows.groupBy("classroom").agg(F.count_distinct("student_id").alias("students"), A.rounded_mean("score").alias("mean"), F.count_if(F.col("score") < 50).alias("struggling"), F.min("score").alias("worst"), F.max("score").alias("best"))


def _bucket():
    """A bucket's counters; an unknown verdict of an answered question isn't a correct one, and no confidence is NONE."""
    classified = F.col("subcontent").isNotNull()
    confidence = F.upper(F.expr("element_at(array('high', 'MEDIUM', 'Low', ''), cast(position % 4 as int) + 1)"))
    return [n_rows().alias("seen"), *A.counters(
        answered=F.col("answered"), correct=F.col("is_correct"), wrong=~F.col("is_correct"), unknown=F.col("response").eqNullSafe("UNKNOWN"), provisional=F.col("provisional") & F.col("answered"),
        easy=F.col("difficulty") == "EASY", hard=F.col("difficulty") == "HARD", incorrect=F.col("answered") & ~F.coalesce("is_correct", F.lit(False)), unanswered=~F.col("answered"),
        classified=classified, forced_closure=classified & (F.col("question_id") % 11 == 0), visual=F.col("question_id") % 7 == 0,
        high=confidence == "HIGH", medium=confidence == "MEDIUM", low=confidence == "LOW", none=~confidence.isin("HIGH", "MEDIUM", "LOW"),
    )]


BUCKET_SQL = """count(*) AS seen, count(*) FILTER (answered) AS answered, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS wrong, count(*) FILTER (response IS NOT DISTINCT FROM 'UNKNOWN') AS unknown,
count(*) FILTER (provisional AND answered) AS provisional, count(*) FILTER (difficulty = 'EASY') AS easy, count(*) FILTER (difficulty = 'HARD') AS hard, count(*) FILTER (answered AND is_correct IS DISTINCT FROM true) AS incorrect, count(*) FILTER (NOT answered) AS unanswered,
count(subcontent) AS classified, count(*) FILTER (subcontent IS NOT NULL AND question_id % 11 = 0) AS forced_closure, count(*) FILTER (question_id % 7 = 0) AS visual,
count(*) FILTER (position % 4 = 0) AS high, count(*) FILTER (position % 4 = 1) AS medium, count(*) FILTER (position % 4 = 2) AS low, count(*) FILTER (position % 4 = 3) AS none"""


@query("agg_bucket_counters", f"SELECT student_id, {BUCKET_SQL} FROM items GROUP BY 1")
def agg_bucket_counters(spark, d):
    return T.items(spark, d).groupBy("student_id").agg(*_bucket())


@query("agg_by_discipline", f"SELECT student_id, discipline, {BUCKET_SQL} FROM items WHERE discipline <> 'D0' GROUP BY 1, 2")
def agg_by_discipline(spark, d):
    return T.items(spark, d).filter("discipline <> 'D0'").groupBy("student_id", "discipline").agg(*_bucket())


@query("agg_by_content_nested", """WITH f AS (SELECT discipline, content, subcontent, count(*) AS n, count(*) FILTER (is_correct) AS correct FROM items WHERE subcontent IS NOT NULL GROUP BY ALL),
c AS (SELECT discipline, content, count(*) AS n, count(*) FILTER (is_correct) AS correct FROM items GROUP BY ALL)
SELECT c.discipline, c.content, c.n, c.correct, list(f.subcontent || ':' || f.n || ':' || f.correct ORDER BY f.subcontent) AS subcontents FROM c JOIN f ON f.discipline = c.discipline AND f.content = c.content GROUP BY ALL""", lists=("subcontents",))
def agg_by_content_nested(spark, d):
    both = lambda *by: T.items(spark, d).groupBy(*by).agg(n_rows().alias("n"), F.count_if("is_correct").alias("correct"))
    fine = A.nested(both("discipline", "content", "subcontent").filter("subcontent is not null"), ["discipline", "content"], ["subcontent", "n", "correct"], "subcontents")
    shown = F.transform("subcontents", lambda x: F.concat_ws(":", x["subcontent"], x["n"], x["correct"]))
    return both("discipline", "content").join(fine, ["discipline", "content"]).withColumn("subcontents", shown)


@query("agg_class_pool", f"SELECT student_id % 8 AS classroom, {BUCKET_SQL} FROM items GROUP BY 1")
def agg_class_pool(spark, d):
    return T.items(spark, d).groupBy(F.expr("student_id % 8").alias("classroom")).agg(*_bucket())


@query("agg_set_collect", "SELECT student_id, list_sort(list(DISTINCT discipline)) AS disciplines FROM items GROUP BY 1", lists=("disciplines",))
def agg_set_collect(spark, d):
    return T.items(spark, d).groupBy("student_id").agg(F.array_sort(F.collect_set("discipline")).alias("disciplines"))


GRAIN_SQL = """count(*) AS seen, count(*) FILTER (answered) AS answered, count(*) FILTER (answered AND is_correct) AS correct, count(*) FILTER (answered AND NOT provisional) AS definitive, min(at_) AS first_at, max(at_) AS last_at"""


@query("agg_multi_grain", f"""WITH c AS (SELECT student_id, content, NULL::VARCHAR AS subcontent, 'content' AS grain, {GRAIN_SQL} FROM items GROUP BY 1, 2
UNION ALL SELECT student_id, content, subcontent, 'subcontent', {GRAIN_SQL} FROM items WHERE subcontent IS NOT NULL GROUP BY 1, 2, 3) SELECT * FROM c""")
def agg_multi_grain(spark, d):
    counts = [n_rows().alias("seen"), *A.counters(answered=F.col("answered"), correct=F.col("answered") & F.col("is_correct"), definitive=F.col("answered") & ~F.col("provisional")), F.min("at").alias("first_at"), F.max("at").alias("last_at")]
    return A.two_grains(T.items(spark, d), ["student_id"], "content", "subcontent", counts)


@query("agg_grain_add", """WITH o AS (SELECT student_id, content, origin, count(*) AS k FROM items WHERE answered GROUP BY ALL), t AS (SELECT student_id, content, count(*) AS answered, count(*) FILTER (provisional) AS provisional FROM items WHERE answered GROUP BY ALL)
SELECT t.student_id, t.content, t.answered, t.provisional, map_from_entries(list((o.origin, o.k) ORDER BY o.origin)) AS origins FROM t JOIN o ON o.student_id = t.student_id AND o.content = t.content GROUP BY ALL""", maps=("origins",))
def agg_grain_add(spark, d):
    rows = T.items(spark, d).filter("answered")
    totals = rows.groupBy("student_id", "content").agg(n_rows().alias("answered"), F.count_if("provisional").alias("provisional"))
    return totals.join(A.histogram(rows, ["student_id", "content"], "origin", "origins"), ["student_id", "content"])


@query("agg_domain_node", """SELECT student_id, content, count(*) FILTER (is_correct IS TRUE) AS correct, count(*) FILTER (is_correct IS FALSE AND response IS DISTINCT FROM 'UNKNOWN') AS wrong,
count(*) FILTER (response IS NOT DISTINCT FROM 'UNKNOWN') AS unknown, count(*) FILTER (at_ >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS) AS recent, max(at_) AS last_at FROM history GROUP BY ALL""")
def agg_domain_node(spark, d):
    unknown = F.col("response").eqNullSafe("UNKNOWN")
    recent = F.col("at") >= F.expr("timestamp_ntz'2024-01-31' - interval 7 days")
    counts = A.counters(correct=F.col("is_correct").eqNullSafe(True), wrong=F.col("is_correct").eqNullSafe(False) & ~unknown, unknown=unknown, recent=recent)
    return T.history(spark, d).groupBy("student_id", "content").agg(*counts, F.max("at").alias("last_at"))


@query("agg_evidence_contexts", "SELECT student_id, kind, content, count(*) AS n, max(at_) AS last_at FROM history GROUP BY ALL")
def agg_evidence_contexts(spark, d):
    return T.history(spark, d).groupBy("student_id", "kind", "content").agg(n_rows().alias("n"), F.max("at").alias("last_at"))


STATE_SQL = "CASE WHEN answered = 0 OR score IS NULL THEN 'NOT_EVALUATED' WHEN confidence < 0.3 THEN 'LOW_EVIDENCE' WHEN score < 40 THEN 'GAP' WHEN score >= 85 AND confidence >= 0.6 THEN 'MASTERED' ELSE 'DEVELOPING' END"


@query("agg_domain_summary", f"SELECT student_id, count(*) AS contents, count(*) FILTER (s = 'MASTERED') AS mastered, count(*) FILTER (s = 'GAP') AS gaps, count(*) FILTER (s = 'LOW_EVIDENCE') AS low_evidence FROM (SELECT student_id, {STATE_SQL} AS s FROM mastery) GROUP BY 1")
def agg_domain_summary(spark, d):
    state = S.mastery_state(F.col("score"), F.col("confidence"), F.col("answered"))
    return T.mastery(spark, d).withColumn("s", state).groupBy("student_id").agg(n_rows().alias("contents"), *A.counters(mastered=F.col("s") == "MASTERED", gaps=F.col("s") == "GAP", low_evidence=F.col("s") == "LOW_EVIDENCE"))


WEIGHT_SQL = "CASE difficulty WHEN 'EASY' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 1.2::DOUBLE ELSE 1.4::DOUBLE END"
PROFICIENCY_SQL = f"round(sum(CASE WHEN is_correct THEN {WEIGHT_SQL} ELSE 0 END) / sum({WEIGHT_SQL}) * 100, 2)"
PBAND_SQL = "CASE WHEN score < 40 THEN 'NEEDS_DEVELOPMENT' WHEN score < 60 THEN 'INITIAL_DEVELOPMENT' WHEN score < 75 THEN 'DEVELOPING' WHEN score < 90 THEN 'CONSISTENT_MASTERY' ELSE 'CONSOLIDATED_MASTERY' END"


def _proficiency(spark, d):
    return estimates(T.items(spark, d).filter("answered"), ["student_id", "content"], "is_correct", "difficulty", discipline=F.min("discipline"))


PROF_SQL = f"""p AS (SELECT *, {PBAND_SQL} AS band FROM (SELECT student_id, content, {PROFICIENCY_SQL} AS score, round(least(1.0::DOUBLE, count(*) / 10.0::DOUBLE), 4) AS confidence, count(*) AS n,
count(DISTINCT difficulty) AS levels, count(DISTINCT is_correct) AS outcomes, min(discipline) AS discipline FROM items WHERE answered GROUP BY ALL))"""
COVER_SQL = "CASE WHEN n = 0 THEN 'NOT_EVALUATED' WHEN outcomes > 1 THEN 'IN_PROGRESS' WHEN n < 3 OR levels < 2 THEN 'INSUFFICIENT_EVIDENCE' WHEN score >= 90 THEN 'CONSOLIDATED' WHEN score <= 40 THEN 'POSSIBLE_GAP' ELSE 'SUFFICIENT_EVIDENCE' END"


@query("agg_proficiency", f"WITH {PROF_SQL} SELECT student_id, content, score, confidence, band, n FROM p")
def agg_proficiency(spark, d):
    return _proficiency(spark, d).select("student_id", "content", "score", "confidence", "band", "n")


def _coverage(spark, d):
    return coverage(_proficiency(spark, d))


@query("agg_coverage", f"WITH {PROF_SQL} SELECT student_id, content, {COVER_SQL} AS status, n >= 3 AND score <= 40 AS investigate FROM p")
def agg_coverage(spark, d):
    return _coverage(spark, d).select("student_id", "content", "status", "investigate")


@query("agg_global_coverage", f"""WITH {PROF_SQL}, c AS (SELECT *, {COVER_SQL} AS status FROM p), x AS (SELECT student_id, discipline, ((2 * sum(round(confidence * 10000)::BIGINT) + count(confidence)) // (2 * count(confidence)))::BIGINT / 10000.0::DOUBLE AS confidence,
round(100.0::DOUBLE * count(*) FILTER (status IN ('SUFFICIENT_EVIDENCE', 'CONSOLIDATED', 'POSSIBLE_GAP')) / count(*), 2) AS coverage FROM c GROUP BY ALL)
SELECT student_id, ((2 * sum(round(coverage * 100)::BIGINT) + count(coverage)) // (2 * count(coverage)))::BIGINT / 100.0::DOUBLE AS coverage, ((2 * sum(round(confidence * 10000)::BIGINT) * 100 + count(confidence)) // (2 * count(confidence)))::BIGINT / 1000000.0::DOUBLE AS confidence, coalesce(list(discipline ORDER BY discipline) FILTER (coverage < 50), []) AS uncertain FROM x GROUP BY 1""", lists=("uncertain",))
def agg_global_coverage(spark, d):
    enough = F.col("status").isin("SUFFICIENT_EVIDENCE", "CONSOLIDATED", "POSSIBLE_GAP")
    by = _coverage(spark, d).groupBy("student_id", "discipline").agg(A.rounded_mean("confidence", 4, 4).alias("c"), F.round(100.0 * F.count_if(enough) / n_rows(), 2).alias("v"))
    low = F.array_sort(F.collect_list(F.when(F.col("v") < 50, F.col("discipline"))))
    return by.groupBy("student_id").agg(A.rounded_mean("v").alias("coverage"), A.rounded_mean("c", 6, 4).alias("confidence"), low.alias("uncertain"))


@query("agg_diag_result", "SELECT content, count(*) AS asked, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct AND response IS NULL) AS incorrect, count(*) FILTER (response = 'UNKNOWN') AS unknown FROM history GROUP BY 1")
def agg_diag_result(spark, d):
    return T.history(spark, d).groupBy("content").agg(n_rows().alias("asked"), *A.counters(correct=F.col("is_correct"), incorrect=~F.col("is_correct") & F.col("response").isNull(), unknown=F.col("response") == "UNKNOWN"))


CORRECTED_SQL = ", ".join(f"round(avg(CASE WHEN status = 'F' THEN c{i} END), 1) AS c{i}" for i in range(1, 6))


@query("agg_essay_dashboard", f"""WITH l AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY at_ DESC, essay_id DESC) = 1)
SELECT school_id, count(*) AS students, count(essay_id) AS submitted, round(100.0::DOUBLE * count(essay_id) / count(*), 1) AS pct, round(avg(score), 1) AS total, {CORRECTED_SQL} FROM links LEFT JOIN l ON user_id = student_id GROUP BY 1""")
def agg_essay_dashboard(spark, d):
    """Of each school's students the newest essays, and of the corrected ones the mean of each competency."""
    newest = first_per_key(T.scores(spark, d), ["student_id"], [F.desc("at"), F.desc("essay_id")]).withColumnRenamed("student_id", "user_id")
    rows = T.links(spark, d).join(newest, "user_id", "left")
    done = F.count("essay_id")
    means = [F.round(F.avg(F.when(F.col("status") == "F", F.col(f"c{i}"))), 1).alias(f"c{i}") for i in range(1, 6)]
    return rows.groupBy("school_id").agg(n_rows().alias("students"), done.alias("submitted"), F.round(100.0 * done / n_rows(), 1).alias("pct"), F.round(F.avg("score"), 1).alias("total"), *means)


@query("agg_correction_score", "SELECT result_id, count(*) AS items, count(*) FILTER (answered) AS answered, count(*) FILTER (is_correct) AS correct, count(*) FILTER (answered AND NOT is_correct) AS incorrect, count(*) FILTER (NOT answered) AS unanswered FROM items GROUP BY 1")
def agg_correction_score(spark, d):
    return T.items(spark, d).groupBy("result_id").agg(n_rows().alias("items"), *A.counters(answered=F.col("answered"), correct=F.col("is_correct"), incorrect=F.col("answered") & ~F.col("is_correct"), unanswered=~F.col("answered")))


@query("agg_distribution_summary", "SELECT count(*) AS n, count(*) FILTER (status = 'O') AS active, count(*) FILTER (status = 'P') AS cancelled, count(*) FILTER (status = 'F') AS closed, max(at_) AS newest FROM scores")
def agg_distribution_summary(spark, d):
    s = F.col("status")
    return T.scores(spark, d).agg(n_rows().alias("n"), *A.counters(active=s == "O", cancelled=s == "P", closed=s == "F"), F.max("at").alias("newest"))


@query("agg_student_dashboard", """SELECT student_id, count(*) FILTER (is_correct IS NOT NULL) AS answered, count(*) FILTER (is_correct) AS correct, round(100.0::DOUBLE * count(*) FILTER (is_correct) / nullif(count(*) FILTER (is_correct IS NOT NULL), 0), 1) AS pct,
greatest(1, count(DISTINCT at_::DATE)) AS streak_days FROM history GROUP BY 1""")
def agg_student_dashboard(spark, d):
    answered, correct = F.count("is_correct"), F.count_if("is_correct")
    return T.history(spark, d).groupBy("student_id").agg(answered.alias("answered"), correct.alias("correct"), F.round(F.try_divide(100.0 * correct, answered), 1).alias("pct"), F.greatest(F.lit(1), F.count_distinct(F.to_date("at"))).alias("streak_days"))


@query("agg_video_history", """WITH v AS (SELECT user_id AS student_id, trunc(value)::BIGINT % 20 AS video, ts, event_id, CASE WHEN event_type = 'purchase' THEN 100.0::DOUBLE ELSE least(100.0::DOUBLE, value) END AS progress,
CASE event_type WHEN 'view' THEN 'LIKED' WHEN 'error' THEN 'DISLIKED' END AS feedback, CASE event_type WHEN 'error' THEN ['TOO_BASIC', 'TOO_LONG', 'UNCLEAR'][event_id % 3 + 1] WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'CLEAR' END END AS reason FROM events),
h AS (SELECT student_id, map_from_entries(list((reason, n))) AS reasons FROM (SELECT student_id, reason, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT student_id, video, max(progress) AS progress, arg_max(feedback, (ts, event_id)) FILTER (feedback IS NOT NULL) AS feedback, any_value(reasons) AS reasons FROM v LEFT JOIN h USING (student_id) GROUP BY 1, 2""", maps=("reasons",))
def agg_video_history(spark, d):
    """For each video its furthest progress and the newest feedback, and how often the student gave each reason."""
    reason = "case event_type when 'error' then element_at(array('too_basic', 'TOO_LONG', 'Unclear'), cast(event_id % 3 as int) + 1) when 'view' then if(event_id % 5 = 0, 'clear', null) end as reason"
    rows = T.read(spark, d, "events").selectExpr("user_id as student_id", "cast(value as bigint) % 20 as video", "ts", "event_id", "if(event_type = 'purchase', 100.0D, least(100.0D, value)) as progress", "case event_type when 'view' then 'LIKED' when 'error' then 'DISLIKED' end as feedback", reason)
    when = F.when(F.col("feedback").isNotNull(), F.struct("ts", "event_id"))
    reasons = A.histogram(rows.filter("reason is not null").withColumn("reason", F.upper("reason")), ["student_id"], "reason", "reasons")
    return rows.groupBy("student_id", "video").agg(F.max("progress").alias("progress"), F.max_by("feedback", when).alias("feedback")).join(reasons, "student_id", "left")


MATERIALS_SQL = "SELECT content, count(DISTINCT m) AS materials FROM (SELECT content, question_id AS m FROM bank WHERE exam = 'SMALL' UNION ALL SELECT content, question_id FROM items) GROUP BY 1"


@query("agg_material_availability", MATERIALS_SQL)
def agg_material_availability(spark, d):
    return _materials(spark, d, T.items(spark, d))


@query("agg_material_availability_all", MATERIALS_SQL)
def agg_material_availability_all(spark, d):
    return _materials(spark, d, T.items(spark, d))


def _materials(spark, d, items):
    both = T.bank(spark, d).filter("exam = 'SMALL'").select("content", "question_id").unionByName(items.select("content", "question_id"))
    return both.groupBy("content").agg(F.count_distinct("question_id").alias("materials"))


@query("agg_extraction_validation", """WITH e AS (SELECT l_orderkey AS doc, l_linenumber AS number, l_discount AS confidence FROM lineitem), g AS (SELECT doc, max(number) AS top, list(DISTINCT number) AS seen, count(*) FILTER (confidence < 0.02) AS low, count(*) - count(DISTINCT number) AS repeated FROM e GROUP BY 1)
SELECT doc, list_sort(list_filter(generate_series(1, top), lambda x: NOT list_contains(seen, x::INT))) AS missing, repeated, low FROM g""", lists=("missing",))
def agg_extraction_validation(spark, d):
    rows = T.read(spark, d, "lineitem").selectExpr("l_orderkey as doc", "l_linenumber as number", "l_discount as confidence")
    stats = rows.groupBy("doc").agg(F.collect_set("number").alias("seen"), F.max("number").alias("top"), F.count_if(F.col("confidence") < 0.02).alias("low"), (n_rows() - F.count_distinct("number")).alias("repeated"))
    return stats.select("doc", F.array_except(F.sequence(F.lit(1), "top"), "seen").alias("missing"), "repeated", "low")


QUALITY_SQL = r"""WITH t AS (SELECT doc_id, doc_id % 4 AS kind, text || CASE doc_id % 4 WHEN 1 THEN chr(10) || 'QUESTÃO 12' || chr(10) || 'A  um' || chr(10) || 'B  dois' || chr(10) || 'C   três' || chr(10) || 'D  quatro' || chr(10) || 'E  cinco'
  WHEN 2 THEN chr(10) || ' Questão 3 /g12/g7' || chr(10) || 'A  x' || chr(10) || 'B  y' || chr(10) || 'C  z' || chr(10) || 'E  w' || chr(10) || 'questão 3' || chr(10) || 'A  x' ELSE '' END AS text FROM documents),
n AS (SELECT *, len(regexp_extract_all(text, '\p{L}')) AS letters, length(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')) AS solid,
  list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '') AS w FROM t)
SELECT doc_id, length(text) AS chars, letters, solid, len(regexp_extract_all(text, '/g\d+')) AS glyphs, round(coalesce(letters::DOUBLE / nullif(solid, 0), 1), 4) AS legibility,
round(coalesce(len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-zÀ-ÿ]{2,}')))::DOUBLE / nullif(len(w), 0), 1), 4) AS words, CASE kind WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS headers,
CASE WHEN kind IN (1, 2) THEN 1 ELSE 0 END AS numbers, CASE kind WHEN 1 THEN 12 WHEN 2 THEN 3 END AS first, CASE kind WHEN 1 THEN 12 WHEN 2 THEN 3 END AS last, CASE kind WHEN 1 THEN 1 ELSE 0 END AS runs FROM n"""


@query("agg_text_quality", QUALITY_SQL)
def agg_text_quality(spark, d):
    """Each text with an exam put to its end, whole, with a letter missing, or none."""
    whole, broken = "\nQUESTÃO 12\nA  um\nB  dois\nC   três\nD  quatro\nE  cinco", "\n Questão 3 /g12/g7\nA  x\nB  y\nC  z\nE  w\nquestão 3\nA  x"
    exam = F.when(F.col("doc_id") % 4 == 1, whole).when(F.col("doc_id") % 4 == 2, broken).otherwise("")
    return T.read(spark, d, "documents").select("doc_id", X.quality(F.concat("text", exam)).alias("q")).select("doc_id", "q.*")


@query("agg_retrieval_metrics", """WITH g AS (SELECT student_id AS case_id, content AS node, row_number() OVER (PARTITION BY student_id ORDER BY content) AS k FROM mastery WHERE score >= 75),
r AS (SELECT student_id AS case_id, content AS node, row_number() OVER (PARTITION BY student_id ORDER BY answered DESC, content) AS k FROM mastery QUALIFY k <= 5),
c AS (SELECT coalesce(g.case_id, r.case_id) AS case_id, count(g.node) AS gold, count(r.node) AS found, count(*) FILTER (g.node IS NOT NULL AND r.node IS NOT NULL) AS hits, coalesce(bool_or(g.node IS NOT NULL AND r.k <= 3), false) AS near, coalesce(bool_or(g.k = 1 AND r.k = 1), false) AS first
  FROM g FULL JOIN r ON g.case_id = r.case_id AND g.node = r.node GROUP BY 1)
SELECT count(*) FILTER (gold > 0) AS covered, round((count(*) FILTER (gold > 0 AND hits > 0))::DOUBLE / count(*) FILTER (gold > 0), 4) AS recall, round(sum(hits)::DOUBLE / sum(found), 4) AS precision,
round((count(*) FILTER (gold > 0 AND first))::DOUBLE / count(*) FILTER (gold > 0), 4) AS top_1, round((count(*) FILTER (gold > 0 AND near))::DOUBLE / count(*) FILTER (gold > 0), 4) AS top_3 FROM c""")
def agg_retrieval_metrics(spark, d):
    """Whether a student's five most answered contents are those mastered."""
    m = T.mastery(spark, d).withColumnRenamed("student_id", "case_id").withColumnRenamed("content", "node")
    gold = first_per_key(m.filter("score >= 75"), ["case_id"], [F.asc("node")], n=1_000_000, rank="place").select("case_id", "node", "place")
    found = first_per_key(m, ["case_id"], [F.desc("answered"), F.asc("node")], n=5, rank="place").select("case_id", "node", "place")
    return A.retrieval_metrics(gold, found, "case_id", "node", "place", 3)


@query("agg_count_pending", "SELECT result_id, count(*) FILTER (answered) AS answered, coalesce(list(position ORDER BY position) FILTER (NOT answered), []) AS pending FROM items GROUP BY 1", lists=("pending",))
def agg_count_pending(spark, d):
    pending = F.array_sort(F.collect_list(F.when(~F.col("answered"), F.col("position"))))
    return T.items(spark, d).groupBy("result_id").agg(F.count_if("answered").alias("answered"), pending.alias("pending"))


@query("agg_count_official", "SELECT count(DISTINCT question_id) AS n FROM bank WHERE exam = 'PROMO' AND number > 10")
def agg_count_official(spark, d):
    return T.bank(spark, d).filter("exam = 'PROMO' and number > 10").agg(F.count_distinct("question_id").alias("n"))


@query("agg_attempt_summary", "SELECT result_id, n - a AS unanswered, a - c AS incorrect, round(100.0::DOUBLE * c / nullif(n, 0), 2) AS pct FROM (SELECT result_id, count(*) AS n, count(*) FILTER (answered) AS a, count(*) FILTER (is_correct) AS c FROM items GROUP BY 1)")
def agg_attempt_summary(spark, d):
    rows = T.items(spark, d).groupBy("result_id").agg(n_rows().alias("n"), *A.counters(a=F.col("answered"), c=F.col("is_correct")))
    return rows.select("result_id", (F.col("n") - F.col("a")).alias("unanswered"), (F.col("a") - F.col("c")).alias("incorrect"), F.round(F.try_divide(F.col("c") * 100.0, F.col("n")), 2).alias("pct"))


@query("agg_score_total", "SELECT essay_id, CASE WHEN status = 'P' THEN 0 ELSE c1 + c2 + least(c3, 40) + c4 + CASE WHEN c1 < 20 THEN 0 ELSE least(c5, 40) END END AS total FROM scores")
def agg_score_total(spark, d):
    fifth = F.when(F.col("c1") < 20, 0).otherwise(F.least("c5", F.lit(40)))
    total = F.col("c1") + F.col("c2") + F.least("c3", F.lit(40)) + F.col("c4") + fifth
    return T.scores(spark, d).select("essay_id", F.when(F.col("status") == "P", 0).otherwise(total).alias("total"))
