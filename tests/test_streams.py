"""Stage runs and terminal states: chained, cut off between any two steps, in shuffled batches."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veredas.operators.windows import fifo_chunks
from veredas.streaming import machines, stages


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Two partitions of state: each is a store of its own, opened in every batch."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


class Service:
    """A provider that keeps what it has been sent; a batch is done one call after it was submitted, or fails."""

    def __init__(self, spark, fail=()):
        self.spark, self.fail = spark, set(fail)
        self.batches, self.asked, self.times = {}, [], 0

    def submit(self, requests):
        runs = {}
        for r in requests.collect():
            runs.setdefault((r["school"], r["stage"], r["sequence"]), set()).add(r["id"])
        for run, ids in runs.items():
            self.asked.append(run)
            assert self.batches.setdefault(run, (f"batch-{'-'.join(map(str, run))}", ids))[1] == ids  # a run that comes again is the same

    def states(self, runs):
        rows = []
        for r in runs.collect():
            run = (r["school"], r["stage"], r["sequence"])
            if run in self.batches:
                rows.append((*run, self.batches[run][0], "failed" if run in self.fail else "completed"))
        return self.spark.createDataFrame(rows, "school string, stage string, sequence int, batch string, status string")

    def results(self, items, stage):
        return items.select("school", "id", F.lit(10).cast("long").alias("size"))


REQUESTS = [("a", f"a{i:02d}", 10) for i in range(7)] + [("b", f"b{i:02d}", 10) for i in range(3)]


def made(spark, folder, service):
    return stages.Pipeline(spark, folder, service, (stages.Stage("OCR", 2), stages.Stage("CORRECTION", 1), stages.Stage("SCORING", 6)), most=12, partitions=2)


def finished(spark, line, service, times=25):
    for _ in range(times):
        if not line.call():
            break
    runs = {(r["school"], r["stage"], r["sequence"]): (r["status"], r["lines"]) for r in line.runs().collect()}
    return runs, sorted(r["id"] for r in line.output().collect())


WANTED = {
    **{("a", "OCR", 1): ("completed", 12), ("a", "OCR", 2): ("completed", 2), ("b", "OCR", 1): ("completed", 6)},
    **{("a", "CORRECTION", 1): ("completed", 6), ("a", "CORRECTION", 2): ("completed", 1), ("b", "CORRECTION", 1): ("completed", 3)},
    **{("a", "SCORING", i): ("completed", 12) for i in (1, 2, 3)}, ("a", "SCORING", 4): ("completed", 6), ("b", "SCORING", 1): ("completed", 12), ("b", "SCORING", 2): ("completed", 6),
}


def test_stages_are_chained(spark, tmp_path):
    service = Service(spark)
    line = made(spark, str(tmp_path), service)
    line.enqueue(spark.createDataFrame(REQUESTS, stages.REQUESTS))
    runs, out = finished(spark, line, service)
    assert runs == WANTED and out == sorted(r[1] for r in REQUESTS)
    assert sorted(service.asked) == sorted(service.batches)  # each submitted once


class Cut(Exception):
    pass


def test_cut_off_between_any_two_steps(spark, tmp_path):
    """Each step of each call loses its driver once, the odd ones before they run, the others right after; a new driver goes on from the folder."""
    service, lost = Service(spark), set()

    class Falling(stages.Pipeline):
        pass

    for number, name in enumerate(("letters", "step", "submit", "apply")):

        def falling(self, *args, _name=name, _number=number, _step=getattr(stages.Pipeline, name)):
            here = (_name, self._calls())
            first, before = here not in lost, (_number + self._calls()) % 2
            lost.add(here)
            if first and before:
                raise Cut
            done = _step(self, *args)
            if first:
                raise Cut
            return done

        setattr(Falling, name, falling)
    line = lambda: Falling(spark, str(tmp_path), service, (stages.Stage("OCR", 2), stages.Stage("CORRECTION", 1)), most=12, partitions=2)
    some = [r for r in REQUESTS if r[0] == "b"]
    line().enqueue(spark.createDataFrame(some, stages.REQUESTS))
    for _ in range(40):
        try:
            if not line().call():
                break
        except Cut:
            continue
    runs = {(r["school"], r["stage"], r["sequence"]): (r["status"], r["lines"]) for r in line().runs().collect()}
    assert runs == {k: v for k, v in WANTED.items() if k[1] != "SCORING" and k[0] == "b"} and len(lost) >= 16
    assert sorted(r["id"] for r in line().output().collect()) == sorted(r[1] for r in some)
    assert set(service.asked) == set(service.batches)


def test_failed_run_is_tried_again_under_a_new_number(spark, tmp_path):
    service = Service(spark, fail={("a", "OCR", 1)})
    line = stages.Pipeline(spark, str(tmp_path), service, (stages.Stage("OCR", 2),), most=12, partitions=2)
    line.enqueue(spark.createDataFrame(REQUESTS, stages.REQUESTS))
    runs, out = finished(spark, line, service)
    assert runs == {("a", "OCR", 1): ("failed", 12), ("a", "OCR", 2): ("completed", 12), ("a", "OCR", 3): ("completed", 2), ("b", "OCR", 1): ("completed", 6)}
    assert out == sorted(r[1] for r in REQUESTS)
    assert service.batches["a", "OCR", 1][1] == service.batches["a", "OCR", 2][1]  # the same chunk, before the one behind it


def test_first_chunk_is_that_of_fifo_chunks(spark, tmp_path):
    service = Service(spark)
    line = made(spark, str(tmp_path), service)
    requests = spark.createDataFrame(REQUESTS, stages.REQUESTS)
    line.enqueue(requests)
    line.call()
    cut = fifo_chunks(requests, "school", ["id"], "size", stages.MOST_BYTES, 6).filter("chunk = 0 and school = 'a'")
    assert service.batches["a", "OCR", 1][1] == {r["id"] for r in cut.collect()}


def fed(spark, tmp_path, process, schema, steps, mode):
    """The rows that a machine gives out for each of the steps' input rows."""
    src, out, seen = tmp_path / "in", [], []
    src.mkdir()
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"f{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        now = []
        machines.run_with_state(process(stream), lambda df, _, now=now: now.extend(df.collect()), str(tmp_path / "checkpoint"), mode, once=True)
        out.append(now)
        seen += now
    return out


def test_run_states(spark, tmp_path):
    """One school's letters, step by step: a run without a batch is asked for again, one with a batch only polled, an ended one never left."""
    letter = lambda kind, at, sequence=None, token=None, batch=None, status=None: ("a", "OCR", kind, sequence, token, 5 if token else None, batch, status, at)
    call = lambda at: letter("call", at)
    steps = [
        [letter("chunk", 0, token="t1"), letter("chunk", 0, token="t2"), call(0)],
        [call(1)],
        [letter("chunk", 2, token="t1"), letter("report", 2, 1, batch="x", status="validating"), call(2)],
        [letter("report", 3, 1, batch="y", status="completed"), letter("report", 3, 9, batch="x", status="completed"), call(3)],
        [letter("report", 4, 1, batch="x", status="completed"), call(4)],
        [letter("report", 5, 1, batch="x", status="failed"), letter("report", 5, 2, batch="z", status="expired"), call(5)],
    ]
    found = fed(spark, tmp_path, lambda s: machines.stage_runs(s, poll_ms=10**9), machines.INBOX, steps, "append")
    told = [[(r["kind"], r["sequence"], r["token"], r["status"]) for r in sorted(rows, key=lambda r: r["place"])] for rows in found]
    assert told == [
        [("run", 1, "t1", "pending"), ("submit", 1, "t1", "pending")],
        [("submit", 1, "t1", "pending")],
        [("run", 1, "t1", "validating"), ("poll", 1, "t1", "validating")],
        [("poll", 1, "t1", "validating")],
        [("run", 1, "t1", "completed"), ("apply", 1, "t1", "completed"), ("run", 2, "t2", "pending"), ("submit", 2, "t2", "pending")],
        [("run", 2, "t2", "expired"), ("run", 3, "t2", "pending"), ("submit", 3, "t2", "pending")],
    ]


def test_timer_polls(spark, tmp_path):
    """A run with a batch is asked for when its time is up, without a call for its school."""
    letter = lambda school, kind, at, **v: (school, "OCR", kind, v.get("sequence"), v.get("token"), 5, v.get("batch"), v.get("status"), at)
    steps = [
        [letter("a", "chunk", 0, token="t1"), letter("a", "call", 0)],
        [letter("a", "report", 1, sequence=1, batch="x", status="in_progress")],
        [letter("b", "call", 2)],
    ]
    found = fed(spark, tmp_path, lambda s: machines.stage_runs(s, poll_ms=0), machines.INBOX, steps, "append")
    assert ("a", "poll", 1, "in_progress") in {(r["school"], r["kind"], r["sequence"], r["status"]) for r in found[2]}


def test_terminal_states_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.randrange(40), rng.choice(["running", "validating", "completed", "failed", "expired"]), rng.randrange(100), i) for i in range(400)]
    wanted = {}
    for key in {e[0] for e in events}:
        ended = sorted((at, i, s) for k, s, at, i in events if k == key and s in machines.TERMINAL)
        wanted[key] = ended[0][2] if ended else None
    for order in (1,):
        rows = [*events, *rng.sample(events, 60)]  # some come again
        rng.shuffle(rows)
        (tmp_path / str(order)).mkdir()
        found = fed(spark, tmp_path / str(order), lambda s: machines.terminal_states(s, "key", "int"), "key int, status string, at long, id long", [rows[i::5] for i in range(5)], "update")
        last = {r["key"]: r["status"] for step in found for r in step}
        assert {k: v for k, v in last.items() if v in machines.TERMINAL} == {k: v for k, v in wanted.items() if v}
        assert {k for k, v in last.items() if v not in machines.TERMINAL} == {k for k, v in wanted.items() if not v}


def test_terminal_states_ask_the_store_once():
    """A key that doesn't change costs one call to the store, one that does two; a null time comes last."""
    calls, kept = [], {}
    state = SimpleNamespace(exists=lambda: calls.append("exists") or "s" in kept, get=lambda: calls.append("get") or kept.get("s"), update=lambda v: calls.append("update") or kept.update(s=v))
    machine = machines.FirstTerminal()
    machine.init(SimpleNamespace(getValueState=lambda *a: state))
    feed = lambda *rows: [d["status"].tolist() for d in machine.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["status", "at", "id"])]), None)]
    assert feed(("running", 3, 0), ("validating", 2, 5)) == [["running"]]
    assert feed(("failed", None, 1), ("completed", 7, 3), ("expired", 7, 4), ("running", 1, 9)) == [["completed"]]
    assert feed(("failed", 9, 2), ("completed", 7, 3)) == [] and kept["s"] == ("completed", 7, 3)
    assert calls == ["get", "update", "get", "update", "get"]


def test_event_order_of_a_batch_does_not_matter(spark, tmp_path):
    """Rows of one batch come as the shuffle brings them: the earliest terminal one by time counts."""
    rows = [(1, "failed", 5, 2), (1, "completed", 5, 1), (1, "running", 1, 0)]
    found = fed(spark, tmp_path, lambda s: machines.terminal_states(s, "key", "int"), "key int, status string, at long, id long", [rows], "update")
    assert [(r["key"], r["status"]) for r in found[0]] == [(1, "completed")]
