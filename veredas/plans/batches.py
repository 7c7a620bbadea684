"""Micro-batch operators over bounded tables, and streams that run until their files are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from veredas.operators.keys import latest_per_key
from veredas.plans import tables as T
from veredas.plans.registry import query
from veredas.sources.shared import shared_path
from veredas.streaming import batches as B
from veredas.streaming.machines import run_with_state, terminal_states
from veredas.streaming.stages import Pipeline


MOST_OPEN = 4096  # runs of a school and stage at once


class _Rule:
    """A service for which a school whose number ends in 0 or 5 has its first OCR batch failed, and all others are completed."""

    def __init__(self, folder: str):
        self.folder = folder

    def submit(self, requests):
        requests.write.mode("append").parquet(self.folder)  # a run that comes again is known already

    def states(self, runs):
        spark = runs.sparkSession
        if runs.isEmpty():
            return spark.createDataFrame([], "school string, stage string, sequence int, batch string, status string")
        known = spark.read.schema("id string, stage string, school string, sequence int").parquet(self.folder).select("school", "stage", "sequence").distinct()
        failed = (F.col("stage") == "OCR") & (F.col("sequence") == 1) & F.col("school").rlike("[05]$")
        met = runs.select("school", "stage", "sequence").join(known, ["school", "stage", "sequence"])
        return met.select("school", "stage", "sequence", F.concat_ws("-", "school", "stage", "sequence").alias("batch"), F.when(failed, "failed").otherwise("completed").alias("status"))

    def results(self, items, stage):
        return items.select("school", "id", F.lit({"OCR": 100_000}.get(stage, 20_000)).cast("long").alias("size"))


@query("stm_stage_machine", """WITH e AS (SELECT school, (row_number() OVER (PARTITION BY school ORDER BY essay_id::VARCHAR) - 1) // 471 AS chunk FROM scores),
c AS (SELECT school, chunk, count(*) AS n, regexp_matches(school, '[05]$') AS odd FROM e GROUP BY 1, 2)
SELECT school, 'OCR' AS stage, (chunk + 1 + odd::INT)::INT AS sequence, (2 * n)::INT AS lines, 'completed' AS status FROM c UNION ALL SELECT school, 'OCR', 1, (2 * n)::INT, 'failed' FROM c WHERE odd AND chunk = 0
UNION ALL SELECT school, 'CORRECTION', (chunk + 1)::INT, n::INT, 'completed' FROM c UNION ALL SELECT school, 'SCORING', (chunk + 1)::INT, (6 * n)::INT, 'completed' FROM c""")
def stm_stage_machine(spark, d):
    """The run table when every essay has gone through OCR, correction and scoring, a call at a time.

    A school's runs are opened in growing numbers once its first has been completed, so that calls don't go with its essays.
    """
    folder = shared_path(spark, "stages")
    line = Pipeline(spark, folder, _Rule(f"{folder}/submitted"), most_open=MOST_OPEN)
    line.enqueue(T.scores(spark, d).select("school", F.col("essay_id").cast("string").alias("id"), F.lit(200_000).cast("long").alias("size")))
    while line.call():
        pass
    return line.runs().select("school", "stage", "sequence", "lines", "status")


@query("stm_pending_collect", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def stm_pending_collect(spark, d):
    done = T.read(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"))
    return B.pending(T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), done, "id")


@query("stm_idempotent_apply", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def stm_idempotent_apply(spark, d):
    results = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    sink = T.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return B.apply_once(results, sink, "id")


@query("stm_partial_pair", "SELECT conv_id, max(text) FILTER (role = 'system') AS header, max(text) FILTER (role = 'user') AS body FROM conversations GROUP BY 1 HAVING max(text) FILTER (role = 'user') IS NOT NULL")
def stm_partial_pair(spark, d):
    rows = T.read(spark, d, "conversations").withColumn("region", F.expr("case role when 'system' then 'header' when 'user' then 'body' end"))
    return B.paired(rows, "conv_id", "region", "text")


@query("stm_latest_run", "SELECT school, status, essay_id FROM scores QUALIFY row_number() OVER (PARTITION BY school, status ORDER BY at_ DESC NULLS FIRST, essay_id DESC) = 1")
def stm_latest_run(spark, d):
    return latest_per_key(T.scores(spark, d), ["school", "status"], "at", "essay_id").select("school", "status", "essay_id")


@query("stm_driver_transition", """SELECT user_id, arg_min(s, (t, ts, event_id)) AS status FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS s,
CASE WHEN event_type IN ('purchase', 'error') THEN 0 ELSE 1 END AS t FROM events) GROUP BY 1""")
def stm_driver_transition(spark, d):
    """A run's state in a keyed store, over micro-batches of events that come in five files in no order of time."""
    out = shared_path(spark, "transitions")
    state = F.expr("case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end")
    events = T.read(spark, d, "events").select("user_id", state.alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    for i in (3, 0, 4, 1, 2):
        events.filter(F.col("id") % 5 == i).write.parquet(f"{out}/events/{i}")
    schema = "user_id bigint, status string, at bigint, id bigint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(f"{out}/events")

    def batch(rows, number):
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/states/{number}")

    run_with_state(terminal_states(stream, "user_id", "long"), batch, f"{out}/checkpoint", "update")
    told = spark.read.schema("key bigint, status string, batch int").option("recursiveFileLookup", "true").parquet(f"{out}/states")
    return told.groupBy(F.col("key").alias("user_id")).agg(F.max_by("status", "batch").alias("status"))


@query("stm_sampling", """SELECT essay_id, CASE WHEN essay_id % 20 = 0 OR status = 'P' OR ('0x' || substr(sha256(unhex(md5(essay_id::VARCHAR))), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE < 0.05 THEN 'REVIEW' ELSE 'APPROVE' END AS decision FROM scores""")
def stm_sampling(spark, d):
    h = F.md5(F.col("essay_id").cast("string"))
    return T.scores(spark, d).select("essay_id", B.review(h, (F.col("essay_id") % 20 == 0).cast("int"), F.col("status") != "P", 0.05).alias("decision"))


@query("stm_event_log", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stm_event_log(spark, d):
    """A log that has every event twice is read as a stream, and each event kept once."""
    out = shared_path(spark, "log")
    twice = f"{out}/twice"
    events = T.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.unionAll(events).write.parquet(twice)
    stream = spark.readStream.schema("event_id bigint, ts timestamp, event_type string").parquet(twice)
    once = B.deduplicated(stream, "event_id", "ts", "400 days")
    once.writeStream.format("parquet").option("path", f"{out}/once").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id bigint, ts timestamp, event_type string").parquet(f"{out}/once").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
