"""Stages of batch requests, chained and resumable: OCR, correction and scoring of a school's essays, or any others.

Requests wait in tables. A call announces new requests as chunks, hears what became of open batches, lets the state machine take
one step for each (school, stage), and does what that asks for: submits a chunk, or applies results, which are the next stage's
requests. Every part writes a folder named by the call, and does nothing where that is complete; a call that was cut off
anywhere is taken up where it stopped, with the same run numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veredas.operators.windows import fifo_chunks
from veredas.sources.shared import exists
from veredas.streaming.machines import INBOX, OUTBOX, run_with_state, stage_runs

REQUESTS = "school string, id string, size long"
QUEUED = "school string, id string, token string"

# What a submitted batch may hold.
MOST_REQUESTS = 10_000
MOST_BYTES = 90 * 1024 * 1024


@dataclass(frozen=True)
class Stage:
    name: str
    lines: int  # requests of one item, which stay together


# The stages in their order, and the requests of an item.
STAGES = (Stage("OCR", 2), Stage("CORRECTION", 1), Stage("SCORING", 6))


class Provider(Protocol):
    """The service that runs batches. A run (school, stage, sequence) that comes again is the batch that it already has."""

    def submit(self, requests: DataFrame) -> None:
        """school, stage, sequence, id: the items of the runs to start."""

    def states(self, runs: DataFrame) -> DataFrame:
        """school, stage, sequence, batch, status of those of the runs (school, stage, sequence, token) that have been submitted."""

    def results(self, items: DataFrame, stage: str) -> DataFrame:
        """school, id, size: what a stage's completed items (school, id) give, as requests of the next stage."""


class Pipeline:
    def __init__(self, spark: SparkSession, folder: str, provider: Provider, stages: Sequence[Stage] = STAGES, most: int = MOST_REQUESTS, most_bytes: int = MOST_BYTES, poll_ms: int = 60_000, partitions: int = 4, most_open: int = 1):
        """``most_open``: runs of a (school, stage) that may be open at once, as ``StageRuns`` opens them."""
        self.spark, self.folder, self.provider, self.stages = spark, folder.rstrip("/"), provider, stages
        self.most, self.most_bytes, self.poll_ms, self.partitions, self.most_open = most, most_bytes, poll_ms, partitions, most_open

    def _done(self, path: str) -> bool:
        return exists(self.spark, f"{self.folder}/{path}/_SUCCESS")

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{path}")

    def _read(self, path: str, schema: str) -> DataFrame:
        """All folders of a kind; no rows before the first."""
        if not exists(self.spark, f"{self.folder}/{path}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{path}")

    def _calls(self) -> int:
        """How many calls have been finished: the number of the next one."""
        n = 0
        while self._done(f"finished/c{n:06d}"):
            n += 1
        return n

    def enqueue(self, requests: DataFrame, stage: str | None = None) -> None:
        """Requests (school, id, size) for a stage, the first if none is named. Those of one call replace each other."""
        n, stage = self._calls(), stage or self.stages[0].name
        self._write(self._chunked(requests, stage, f"{n:06d}"), f"requests/{stage}/c{n:06d}-new")

    def _chunked(self, requests: DataFrame, stage: str, name: str) -> DataFrame:
        """The requests with their chunks' tokens. Those of different ``sequence``, where they have one, are in different chunks, in its order."""
        lines = next(s.lines for s in self.stages if s.name == stage)
        runs = [F.lpad(F.col("sequence").cast("string"), 6, "0")] if "sequence" in requests.columns else []
        queue = F.concat_ws("/", *runs, "school") if runs else F.col("school")
        rows = requests.select("school", "id", F.col("size").cast("long").alias("size"), queue.alias("_queue"), F.concat_ws("-", F.lit(name), *runs).alias("_name"))
        cut = fifo_chunks(rows, "_queue", ["id"], "size", self.most_bytes, self.most // lines)
        return cut.select("school", "id", F.concat("_name", F.lit("-"), F.lpad(F.col("chunk").cast("string"), 6, "0")).alias("token"))

    def queued(self, stage: str) -> DataFrame:
        """school, id, token (of its chunk) of all requests of a stage so far."""
        return self._read(f"requests/{stage}", QUEUED)

    def outbox(self) -> DataFrame:
        return self._read("outbox", OUTBOX + ", step long")

    def runs(self) -> DataFrame:
        """The run table: school, stage, sequence, token, lines, batch, status."""
        last = self.outbox().filter("kind = 'run'").groupBy("school", "stage", "sequence")
        state = F.max_by(F.struct("token", "lines", "batch", "status"), F.struct("step", "place")).alias("s")
        return last.agg(state).select("school", "stage", "sequence", "s.*")

    def call(self) -> bool:
        """One call for every school and stage; false if there was nothing left to do."""
        n = self._calls()
        name = f"c{n:06d}"
        if not self._done(f"inbox/{name}"):
            self._write(self.letters(n), f"inbox/{name}")
        self.step(n)
        asked = self.outbox().filter(F.col("step") == n)
        self.submit(asked)
        self.apply(asked, n)
        busy = not asked.isEmpty()
        self._write(asked.groupBy("kind").count(), f"finished/{name}")
        return busy

    def letters(self, n: int) -> DataFrame:
        """Chunks not announced yet, reports on open runs, and a call for each (school, stage) that has ever had requests."""
        chunks = None
        for s in self.stages:
            own = self.queued(s.name).groupBy("school", "token").agg((F.count(F.lit(1)) * s.lines).cast("int").alias("lines")).withColumn("stage", F.lit(s.name))
            chunks = own if chunks is None else chunks.unionByName(own)
        announced = self._read("inbox", INBOX).filter("kind = 'chunk'").select("school", "stage", "token")
        new = chunks.join(announced, ["school", "stage", "token"], "left_anti").withColumn("kind", F.lit("chunk"))
        open_ = self.runs().filter("status not in ('completed', 'failed', 'expired', 'cancelled')").select("school", "stage", "sequence", "token")
        reports = self.provider.states(open_).withColumn("kind", F.lit("report"))
        calls = chunks.select("school", "stage").distinct().withColumn("kind", F.lit("call"))
        every = new.unionByName(reports, allowMissingColumns=True).unionByName(calls, allowMissingColumns=True).withColumn("at", F.lit(n).cast("long"))
        names = [f.split()[0] for f in INBOX.split(", ")]
        return every.select(*[F.col(c) for c in names])

    def step(self, n: int) -> None:
        inbox = self.spark.readStream.schema(INBOX).option("recursiveFileLookup", "true").parquet(f"{self.folder}/inbox")

        def batch(rows: DataFrame, number: int) -> None:
            rows.withColumn("step", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/outbox/b{number:06d}")

        run_with_state(stage_runs(inbox, self.poll_ms, self.most_open), batch, f"{self.folder}/checkpoint", "append", once=True, partitions=self.partitions)

    def submit(self, asked: DataFrame) -> None:
        for s in self.stages:
            runs = asked.filter((F.col("kind") == "submit") & (F.col("stage") == s.name)).select("school", "stage", "sequence", "token")
            if not runs.isEmpty():
                self.provider.submit(runs.join(self.queued(s.name), ["school", "token"]).select("school", "stage", "sequence", "id"))

    def apply(self, asked: DataFrame, n: int) -> None:
        """Results of a completed run become the next stage's requests, or the last stage's output."""
        for i, s in enumerate(self.stages):
            runs = asked.filter((F.col("kind") == "apply") & (F.col("stage") == s.name)).select("school", "token", "sequence")
            if runs.isEmpty():
                continue
            items = runs.join(self.queued(s.name), ["school", "token"])
            found = self.provider.results(items.select("school", "id"), s.name)
            if i + 1 < len(self.stages):
                if self.most_open > 1:  # a run's results are chunked by themselves, as if they had come alone
                    found = found.join(items.groupBy("school", "id").agg(F.min("sequence").alias("sequence")), ["school", "id"])
                after = self.stages[i + 1].name
                self._write(self._chunked(found, after, f"{n + 1:06d}"), f"requests/{after}/c{n + 1:06d}")
            else:
                self._write(found.select(*[f.split()[0] for f in REQUESTS.split(", ")]), f"output/c{n:06d}")

    def output(self) -> DataFrame:
        """school, id, size of what the last stage has given."""
        return self._read("output", REQUESTS)
