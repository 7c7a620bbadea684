"""Window functions, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veredas.functions import scoring as S
from veredas.operators import windows as W
from veredas.operators.joins import band
from veredas.operators.keys import cascade_fill, first_per_key, latest_per_key, n_rows, page
from veredas.plans import tables as T
from veredas.plans.registry import query



@query("win_dedupe_active", "SELECT essay_id, CASE WHEN row_number() OVER (PARTITION BY student_id ORDER BY at_ DESC, essay_id DESC) > 1 THEN 'SUPERSEDED' ELSE status END AS status FROM scores")
def win_dedupe_active(spark, d):
    return W.supersede(T.scores(spark, d), ["student_id"], [F.desc("at"), F.desc("essay_id")], "status").select("essay_id", "status")


@query("win_rank_ties", "SELECT essay_id, rank() OVER (ORDER BY score DESC) AS place, rank() OVER (PARTITION BY school ORDER BY score DESC) AS school_place FROM scores")
def win_rank_ties(spark, d):
    rows = W.competition_rank(T.scores(spark, d), "score", "place")
    return W.competition_rank(rows, "score", "school_place", ["school"]).select("essay_id", "place", F.col("school_place").cast("long").alias("school_place"))


@query("win_latest_per_key", "SELECT student_id, essay_id, score FROM scores QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY at_ DESC NULLS FIRST, essay_id DESC) = 1")
def win_latest_per_key(spark, d):
    return latest_per_key(T.scores(spark, d), ["student_id"], "at", "essay_id").select("student_id", "essay_id", "score")


@query("win_latest_version", "SELECT content, max(question_id) AS version, arg_max(statement, question_id) AS title FROM bank WHERE visibility = 'PUBLIC' GROUP BY 1")
def win_latest_version(spark, d):
    return T.bank(spark, d).filter("visibility = 'PUBLIC'").groupBy("content").agg(F.max("question_id").alias("version"), F.max_by("statement", "question_id").alias("title"))


@query("win_trend_halves", """WITH r AS (SELECT student_id, content, CASE WHEN is_correct THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, row_number() OVER (PARTITION BY student_id, content ORDER BY at_, event_id) AS i, count(*) OVER (PARTITION BY student_id, content) AS n FROM history WHERE is_correct IS NOT NULL),
h AS (SELECT student_id, content, max(n) AS n, round(avg(CASE WHEN i > n // 2 THEN hit END) - avg(CASE WHEN i <= n // 2 THEN hit END), 2) AS change FROM r GROUP BY ALL)
SELECT student_id, content, n, CASE WHEN n < 4 THEN 'INSUFFICIENT_EVIDENCE' WHEN change >= 10 THEN 'IMPROVING' WHEN change <= -10 THEN 'DECLINING' ELSE 'STABLE' END AS trend FROM h""")
def win_trend_halves(spark, d):
    return W.half_trend(T.history(spark, d).filter("is_correct is not null"), ["student_id", "content"], ["at", "event_id"], F.col("is_correct"))


@query("win_first_last_delta", "SELECT student_id, arg_max(score, (at_, essay_id)) - arg_min(score, (at_, essay_id)) AS delta FROM scores GROUP BY 1 HAVING count(*) >= 2")
def win_first_last_delta(spark, d):
    at = F.struct("at", "essay_id")
    return T.scores(spark, d).groupBy("student_id").agg(n_rows().alias("n"), (F.max_by("score", at) - F.min_by("score", at)).alias("delta")).filter("n >= 2").drop("n")


@query("win_lag_gaps", "WITH n AS (SELECT doc, unnest(generate_series(low, high)) AS missing FROM (SELECT l_orderkey AS doc, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY 1)) SELECT doc, missing::INT AS missing FROM n WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc AND l_linenumber = missing)")
def win_lag_gaps(spark, d):
    return W.missing(T.read(spark, d, "lineitem").selectExpr("l_orderkey as doc", "l_linenumber as number"), ["doc"], "number")


@query("win_islands", """WITH p AS (SELECT event_id // 500 AS batch, event_id AS page, CASE WHEN event_type <> 'error' THEN user_id % 2 END AS student FROM events),
r AS (SELECT *, page - row_number() OVER (PARTITION BY batch, student ORDER BY page) AS island FROM p WHERE student IS NOT NULL)
SELECT batch, student, min(page) AS first, max(page) AS last, count(*) AS n FROM r GROUP BY batch, student, island""")
def win_islands(spark, d):
    pages = T.read(spark, d, "events").selectExpr("event_id div 500 as batch", "event_id as page", "if(event_type <> 'error', user_id % 2, null) as student")
    return W.runs(pages, ["batch"], "page", "student")


@query("win_last_k_same", "SELECT event_id, count(*) OVER w = 3 AND min(kind) OVER w = max(kind) OVER w AS same FROM history WINDOW w AS (PARTITION BY student_id ORDER BY at_, event_id ROWS 2 PRECEDING)")
def win_last_k_same(spark, d):
    return W.last_all_equal(T.history(spark, d), ["student_id"], ["at", "event_id"], "kind", 3, "same").select("event_id", "same")


@query("win_recent_k", "SELECT DISTINCT student_id, content FROM (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY at_ DESC, event_id DESC) <= 8)")
def win_recent_k(spark, d):
    return first_per_key(T.history(spark, d), ["student_id"], [F.desc("at"), F.desc("event_id")], 8).select("student_id", "content").distinct()


@query("win_recent_distinct", """WITH r AS (SELECT student_id, content, row_number() OVER (PARTITION BY student_id ORDER BY at_ DESC, event_id DESC) AS i FROM history), f AS (SELECT student_id, content, min(i) AS i FROM r WHERE i <= 20 GROUP BY ALL)
SELECT student_id, content, rank::INT AS rank FROM (SELECT student_id, content, row_number() OVER (PARTITION BY student_id ORDER BY i) AS rank FROM f) WHERE rank <= 5""")
def win_recent_distinct(spark, d):
    return W.recent_distinct(T.history(spark, d), ["student_id"], [F.desc("at"), F.desc("event_id")], "content", 20, 5)


CURVE_SQL = "CASE WHEN {0} = 0 THEN 0.0 WHEN {0} < 3 THEN least(0.3, {0} * 0.1) WHEN {0} < 10 THEN 0.3 + ({0} - 3) / 7 * 0.3 WHEN {0} < 20 THEN 0.6 + ({0} - 10) / 10 * 0.25 ELSE least(1.0, 0.85 + ({0} - 20) / 50 * 0.15) END"


@query("win_running_mastery", f"""WITH RECURSIVE a AS (SELECT student_id, content, is_correct, row_number() OVER (PARTITION BY student_id, content ORDER BY at_, event_id) AS i FROM history WHERE is_correct IS NOT NULL),
c AS (SELECT *, round((count(*) FILTER (is_correct) OVER w) * 100.0::DOUBLE / i, 2) AS score, count(*) FILTER (is_correct) OVER w AS correct FROM a WINDOW w AS (PARTITION BY student_id, content ORDER BY i)),
b AS (SELECT student_id, content, i, correct, score, ({CURVE_SQL.format('i::DOUBLE')})::DOUBLE AS confidence FROM c),
f AS (SELECT student_id, content, 0::BIGINT AS i, 'EASY' AS level FROM (SELECT DISTINCT student_id, content FROM b)
UNION ALL SELECT f.student_id, f.content, b.i, CASE WHEN b.confidence < 0.6 THEN level WHEN level = 'EASY' AND score >= 70 THEN 'MEDIUM' WHEN level = 'MEDIUM' AND score >= 70 THEN 'HARD' WHEN level = 'MEDIUM' AND score < 50 THEN 'EASY' WHEN level = 'HARD' AND score < 40 THEN 'MEDIUM' ELSE level END
FROM f JOIN b ON b.student_id = f.student_id AND b.content = f.content AND b.i = f.i + 1)
SELECT b.student_id, b.content, b.i AS answered, b.correct, b.score, round(b.confidence, 4) AS confidence, f.level FROM b JOIN f USING (student_id, content, i) QUALIFY row_number() OVER (PARTITION BY b.student_id, b.content ORDER BY b.i DESC) = 1""")
def win_running_mastery(spark, d):
    return W.running_mastery(T.history(spark, d).filter("is_correct is not null"), ["student_id", "content"], ["at", "event_id"], "is_correct")


@query("win_sequence_number", "SELECT student_id, content, row_number() OVER (PARTITION BY student_id ORDER BY score, content) AS place FROM mastery")
def win_sequence_number(spark, d):
    place = F.row_number().over(Window.partitionBy("student_id").orderBy("score", "content")).cast("long")
    return T.mastery(spark, d).select("student_id", "content", place.alias("place"))


@query("win_time_gap_spacing", "SELECT student_id, kind, count(*) FILTER (gap >= 6) AS wide, count(gap) AS gaps FROM (SELECT student_id, kind, extract(epoch FROM at_ - lag(at_) OVER (PARTITION BY student_id, kind ORDER BY at_, event_id)) / 3600.0::DOUBLE AS gap FROM history) GROUP BY ALL")
def win_time_gap_spacing(spark, d):
    before = F.lag("at").over(Window.partitionBy("student_id", "kind").orderBy("at", "event_id"))
    gap = F.timestamp_diff("MICROSECOND", before, F.col("at")) / 3600e6
    return T.history(spark, d).withColumn("gap", gap).groupBy("student_id", "kind").agg(F.count_if(F.col("gap") >= 6).alias("wide"), F.count("gap").alias("gaps"))


@query("win_variance_gate", "SELECT student_id, round(stddev_pop(value), 3) AS deviation, stddev_pop(value) >= 40 AS varies FROM history GROUP BY 1")
def win_variance_gate(spark, d):
    dev = F.stddev_pop("value")
    return T.history(spark, d).groupBy("student_id").agg(F.round(dev, 3).alias("deviation"), (dev >= 40).alias("varies"))


@query("win_repeated_artifact", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT count(*) AS k FROM documents), r AS (SELECT line, count(DISTINCT doc_id) AS docs FROM l WHERE length(line) > 10 GROUP BY 1)
SELECT line, docs FROM r, n WHERE docs >= 0.01 * k""")
def win_repeated_artifact(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") > 10).distinct()
    counts = lines.groupBy("line").agg(n_rows().alias("docs"))
    return counts.crossJoin(F.broadcast(docs.agg(n_rows().alias("k")))).filter("docs >= 0.01 * k").select("line", "docs")


@query("win_latest_official_limit1", "SELECT question_id, arg_max(is_correct, (result_id, position)) AS verdict FROM items WHERE is_correct IS NOT NULL GROUP BY 1")
def win_latest_official_limit1(spark, d):
    known = T.items(spark, d).filter("is_correct is not null")
    return first_per_key(known, ["question_id"], [F.desc("result_id"), F.desc("position")]).select("question_id", F.col("is_correct").alias("verdict"))


@query("win_fifo_chunks")
def win_fifo_chunks(spark, d):
    """Requests of a school in order, in chunks of at most 20 requests and 200,000 units of size; two requests stay together."""
    requests = T.scores(spark, d).select("school", "essay_id", (F.col("score") * 20 + 1).alias("size"))
    return W.fifo_chunks(requests, "school", ["essay_id"], "size", 200_000, 20, group=2)


@query("srt_multi_tiebreak", "SELECT student_id, content FROM mastery ORDER BY confidence DESC, score, content, student_id LIMIT 200")
def srt_multi_tiebreak(spark, d):
    return T.mastery(spark, d).orderBy(F.desc("confidence"), "score", "content", "student_id").select("student_id", "content").limit(200)


@query("srt_desc_single", "SELECT school, round(avg(score), 1) AS media FROM scores GROUP BY 1 ORDER BY media DESC, school")
def srt_desc_single(spark, d):
    return T.scores(spark, d).groupBy("school").agg(F.round(F.avg("score"), 1).alias("media")).orderBy(F.desc("media"), "school")


@query("srt_priority_enum", "SELECT essay_id, priority FROM (SELECT essay_id, CASE status WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM scores) ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, essay_id LIMIT 100")
def srt_priority_enum(spark, d):
    rows = T.scores(spark, d).selectExpr("essay_id", "case status when 'F' then 'HIGH' when 'O' then 'MEDIUM' else 'LOW' end as priority")
    return rows.orderBy(F.array_position(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), F.col("priority")), "essay_id").limit(100)


@query("srt_source_rank", "SELECT content, source, event_id FROM contexts QUALIFY row_number() OVER (PARTITION BY content ORDER BY CASE source WHEN 'TEACHER' THEN 0 WHEN 'COORDINATION' THEN 1 WHEN 'SCHOOL_PLAN' THEN 2 ELSE 3 END, recorded_at DESC, event_id) <= 3")
def srt_source_rank(spark, d):
    rank = F.array_position(F.array(*map(F.lit, S.SOURCE_ORDER)), F.col("source"))
    return first_per_key(T.contexts(spark, d), ["content"], [rank, F.desc("recorded_at"), F.asc("event_id")], 3).select("content", "source", "event_id")


@query("lim_offset_page", "SELECT DISTINCT question_id, content FROM items ORDER BY content, question_id LIMIT 20 OFFSET 40")
def lim_offset_page(spark, d):
    return page(T.items(spark, d).select("question_id", "content").distinct(), [F.asc("content"), F.asc("question_id")], 3, 20)


@query("lim_page_python", "SELECT user_id, name FROM links WHERE active ORDER BY name DESC LIMIT 15 OFFSET 15")
def lim_page_python(spark, d):
    return page(T.links(spark, d).filter("active").select("user_id", "name"), [F.desc("name")], 2, 15)


@query("lim_topk_scored", "SELECT student_id, content, score FROM mastery QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY score DESC, content) <= 3")
def lim_topk_scored(spark, d):
    return first_per_key(T.mastery(spark, d), ["student_id"], [F.desc("score"), F.asc("content")], 3).select("student_id", "content", "score")


@query("lim_argmax_decision", "SELECT student_id, content AS target FROM mastery QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY score, content) = 1")
def lim_argmax_decision(spark, d):
    return T.mastery(spark, d).groupBy("student_id").agg(F.min(F.struct("score", "content")).alias("m")).select("student_id", F.col("m.content").alias("target"))


@query("lim_lowest", "SELECT student_id, min(score) AS score, arg_min(content, (score, content)) AS content FROM mastery GROUP BY 1")
def lim_lowest(spark, d):
    return T.mastery(spark, d).groupBy("student_id").agg(F.min("score").alias("score"), F.min_by("content", F.struct("score", "content")).alias("content"))


@query("lim_exists_one", "SELECT EXISTS (SELECT 1 FROM scores WHERE gre = 'ASIA') AS found")
def lim_exists_one(spark, d):
    return T.scores(spark, d).filter("gre = 'ASIA'").limit(1).agg((n_rows() > 0).alias("found"))


@query("lim_first_attr", "SELECT school, min(gre) AS gre FROM scores GROUP BY 1")
def lim_first_attr(spark, d):
    return T.scores(spark, d).groupBy("school").agg(F.min("gre").alias("gre"))


@query("lim_role_precedence", "SELECT school_id, arg_min(user_id, (CASE role WHEN 'COORDINATOR' THEN 0 WHEN 'TEACHER' THEN 1 ELSE 2 END, user_id)) AS user_id FROM links WHERE active GROUP BY 1")
def lim_role_precedence(spark, d):
    rank = F.when(F.col("role") == "COORDINATOR", 0).when(F.col("role") == "TEACHER", 1).otherwise(2)
    return T.links(spark, d).filter("active").groupBy("school_id").agg(F.min_by("user_id", F.struct(rank.alias("r"), "user_id")).alias("user_id"))


@query("lim_fresh_then_fill", """WITH s AS (SELECT DISTINCT question_id FROM items WHERE student_id = 4), r AS (SELECT content, bank.question_id, s.question_id IS NOT NULL AS seen, row_number() OVER (PARTITION BY content ORDER BY s.question_id IS NOT NULL, price DESC, bank.question_id) AS k FROM bank LEFT JOIN s ON s.question_id = bank.question_id)
SELECT content, question_id, seen FROM r WHERE k <= 60""")
def lim_fresh_then_fill(spark, d):
    seen = T.items(spark, d).filter("student_id = 4").select("question_id").distinct().withColumn("seen", F.lit(True))
    rows = T.bank(spark, d).join(seen, "question_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return first_per_key(rows, ["content"], [F.asc("seen"), F.desc("price"), F.asc("question_id")], 60).select("content", "question_id", "seen")


@query("lim_fresh_then_fill_all", """WITH s AS (SELECT DISTINCT student_id, question_id FROM items), p AS (SELECT DISTINCT student_id, content FROM items)
SELECT p.student_id, content, bank.question_id, s.question_id IS NOT NULL AS seen FROM p JOIN bank USING (content) LEFT JOIN s ON s.student_id = p.student_id AND s.question_id = bank.question_id
QUALIFY row_number() OVER (PARTITION BY p.student_id, content ORDER BY s.question_id IS NOT NULL, price DESC, bank.question_id) <= 10""")
def lim_fresh_then_fill_all(spark, d):
    """Ten questions for every student in each content that they have answered in."""
    found = cascade_fill(T.bank(spark, d), T.items(spark, d), "student_id", "content", "question_id", [F.desc("price"), F.asc("question_id")], 10)
    return found.select("student_id", "content", "question_id", (F.col("stage") > 2).alias("seen"))


@query("lim_cascade_fill_all", """WITH s AS (SELECT DISTINCT student_id, question_id FROM items), p AS (SELECT DISTINCT student_id, content FROM items),
c AS (SELECT p.student_id, content, bank.question_id, CASE WHEN s.question_id IS NULL AND number <= 16 THEN 1 WHEN s.question_id IS NULL THEN 2 WHEN number <= 16 THEN 3 ELSE 4 END AS stage FROM p JOIN bank USING (content) LEFT JOIN s ON s.student_id = p.student_id AND s.question_id = bank.question_id),
g AS (SELECT *, count(*) FILTER (stage = 3) OVER (PARTITION BY student_id, content) AS thirds FROM c)
SELECT student_id, content, question_id, stage FROM g WHERE stage < 4 OR thirds = 0 QUALIFY row_number() OVER (PARTITION BY student_id, content ORDER BY stage, question_id) <= 70""")
def lim_cascade_fill_all(spark, d):
    """Up to 70 questions for every student in each content that they have answered in, easy ones wanted."""
    return cascade_fill(T.bank(spark, d), T.items(spark, d), "student_id", "content", "question_id", [F.asc("question_id")], 70, F.col("number") <= 16)


@query("lim_cascade_fill", """WITH s AS (SELECT DISTINCT question_id FROM items WHERE student_id = 4), c AS (SELECT content, bank.question_id, CASE WHEN s.question_id IS NULL AND number <= 16 THEN 1 WHEN s.question_id IS NULL THEN 2 WHEN number <= 16 THEN 3 ELSE 4 END AS stage FROM bank LEFT JOIN s ON s.question_id = bank.question_id),
g AS (SELECT *, count(*) FILTER (stage = 3) OVER (PARTITION BY content) AS thirds FROM c)
SELECT content, question_id, stage FROM g WHERE stage < 4 OR thirds = 0 QUALIFY row_number() OVER (PARTITION BY content ORDER BY stage, question_id) <= 70""")
def lim_cascade_fill(spark, d):
    seen = T.items(spark, d).filter("student_id = 4").select("question_id").distinct().withColumn("seen", F.lit(True))
    fresh, easy = F.col("seen").isNull(), F.col("number") <= 16
    stage = F.when(fresh & easy, 1).when(fresh, 2).when(easy, 3).otherwise(4)
    rows = T.bank(spark, d).join(seen, "question_id", "left").withColumn("stage", stage)
    thirds = F.count_if(F.col("stage") == 3).over(Window.partitionBy("content"))
    rows = rows.withColumn("thirds", thirds).filter("stage < 4 or thirds = 0")  # the last resort only without the one before it
    return first_per_key(rows, ["content"], [F.asc("stage"), F.asc("question_id")], 70).select("content", "question_id", "stage")


@query("set_union_sources", "SELECT DISTINCT classroom FROM (SELECT classroom FROM links WHERE role = 'TEACHER' UNION SELECT class FROM scores WHERE class IS NOT NULL UNION SELECT 'EXTRA')")
def set_union_sources(spark, d):
    extra = spark.createDataFrame([("EXTRA",)], "classroom string")
    return T.links(spark, d).filter("role = 'TEACHER'").select("classroom").union(T.scores(spark, d).filter("class is not null").select("class")).union(extra).distinct()


@query("set_union_roster", "SELECT user_id, 'CLASS' AS via FROM links WHERE classroom = 'MACHINERY' UNION ALL SELECT student_id, 'DIRECT' FROM scores WHERE score > 990")
def set_union_roster(spark, d):
    rows = T.links(spark, d).filter("classroom = 'MACHINERY'").select("user_id", F.lit("CLASS").alias("via"))
    return rows.unionByName(T.scores(spark, d).filter("score > 990").select(F.col("student_id").alias("user_id"), F.lit("DIRECT").alias("via")))


@query("set_union_links", "SELECT content, question_id FROM bank WHERE exam = 'LARGE' UNION SELECT content, question_id FROM items WHERE student_id = 8")
def set_union_links(spark, d):
    return T.bank(spark, d).filter("exam = 'LARGE'").select("content", "question_id").union(T.items(spark, d).filter("student_id = 8").select("content", "question_id")).distinct()


@query("set_union_search", "SELECT question_id, min(source) AS source FROM (SELECT question_id, 1 AS source FROM bank WHERE content = 'Brand#9' UNION ALL SELECT question_id, 2 FROM items WHERE student_id = 9) GROUP BY 1")
def set_union_search(spark, d):
    hits = T.bank(spark, d).filter("content = 'Brand#9'").select("question_id", F.lit(1).alias("source"))
    both = hits.unionByName(T.items(spark, d).filter("student_id = 9").select("question_id", F.lit(2).alias("source")))
    return first_per_key(both, ["question_id"], [F.asc("source")]).select("question_id", "source")


@query("set_diff_missing", "SELECT i AS number FROM generate_series(1, 60) t(i) EXCEPT SELECT number FROM bank")
def set_diff_missing(spark, d):
    return spark.range(1, 61).select(F.col("id").alias("number")).exceptAll(T.bank(spark, d).select(F.col("number").cast("long")).distinct())


@query("set_diff_stray", "SELECT event_type AS kind, count(*) AS strays FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 20) GROUP BY 1")
def set_diff_stray(spark, d):
    known = T.read(spark, d, "customer").filter("c_custkey > 20").select(F.col("c_custkey").alias("user_id"))
    return T.read(spark, d, "events").join(known, "user_id", "left_anti").groupBy(F.col("event_type").alias("kind")).agg(n_rows().alias("strays"))


@query("set_intersect_tokens", "SELECT question_id, list_sort(list_intersect(string_split(statement, ' '), ['red', 'blue', 'ring', 'bolt'])) AS common FROM bank", lists=("common",))
def set_intersect_tokens(spark, d):
    wanted = F.array(*map(F.lit, ("red", "blue", "ring", "bolt")))
    return T.bank(spark, d).select("question_id", F.array_sort(F.array_intersect(F.split("statement", " "), wanted)).alias("common"))


@query("set_distinct", "SELECT DISTINCT gre, school FROM scores ORDER BY school")
def set_distinct(spark, d):
    return T.scores(spark, d).select("gre", "school").distinct().orderBy("school")


@query("set_ordered_dedupe", "SELECT student_id, string_agg(kind, ',' ORDER BY i) AS kinds FROM (SELECT student_id, kind, min(event_id) AS i FROM history GROUP BY ALL) GROUP BY 1")
def set_ordered_dedupe(spark, d):
    firsts = T.history(spark, d).groupBy("student_id", "kind").agg(F.min("event_id").alias("i"))
    return firsts.groupBy("student_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


@query("set_unanimity", """SELECT student_id, content, CASE WHEN count(*) = count(kind) AND count(DISTINCT kind) = 1 AND min(c) = max(c) AND min(c) = 'HIGH' THEN 'ACCEPT' ELSE 'HUMAN_REVIEW' END AS verdict FROM (SELECT student_id, content, kind, CASE WHEN value >= 10 THEN 'HIGH' ELSE 'LOW' END AS c FROM history) GROUP BY ALL""")
def set_unanimity(spark, d):
    rows = T.history(spark, d).withColumn("c", F.when(F.col("value") >= 10, "HIGH").otherwise("LOW"))
    agreed = (n_rows() == F.count("kind")) & (F.count_distinct("kind") == 1) & (F.min("c") == F.max("c")) & (F.min("c") == "HIGH")
    return rows.groupBy("student_id", "content").agg(F.when(agreed, "ACCEPT").otherwise("HUMAN_REVIEW").alias("verdict"))


@query("flagship_ranking", """WITH s AS (SELECT school, gre, count(*) AS n, round(avg(score), 1) AS media FROM scores WHERE score <= 1000 GROUP BY ALL)
SELECT *, rank() OVER (ORDER BY media DESC) AS place, CASE WHEN media <= 399 THEN 'Muito baixo' WHEN media <= 599 THEN 'Baixo' WHEN media <= 799 THEN 'Adequado' WHEN media <= 899 THEN 'Alto' ELSE 'Muito alto' END AS band FROM s""")
def flagship_ranking(spark, d):
    """Schools by average score: rank with ties, and the band of the average."""
    rows = T.scores(spark, d).filter("score <= 1000").groupBy("school", "gre").agg(n_rows().alias("n"), F.round(F.avg("score"), 1).alias("media"))
    return W.competition_rank(rows, "media", "place").withColumn("band", band(F.ceil("media"), S.ESSAY_BANDS))
