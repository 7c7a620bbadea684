"""State machines over streams, kept in a keyed state store: the stage runs of a school, and states that end."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veredas.streaming.batches import TERMINAL

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

INBOX = "school string, stage string, kind string, sequence int, token string, lines int, batch string, status string, at long"
OUTBOX = "school string, stage string, kind string, sequence int, token string, lines int, batch string, status string, place int"
_OUT = ["school", "stage", "kind", "sequence", "token", "lines", "batch", "status", "place"]
_FIRST = {"chunk": 0, "report": 1, "call": 2}  # of one moment


class StageRuns(StatefulProcessor):
    """The runs of one (school, stage): a queue of chunks, and the runs that are open.

    Rows of kind ``chunk`` join the queue; ``report`` says what became of a run's batch; each ``call`` does one step: it submits the first
    chunk as a new run, takes up a run that has no batch yet, asks for the state of one that has, or applies a completed one before
    the next. A terminal state is never left, a run is never given a second batch, and a chunk that has been seen isn't queued again; that of a run that ended
    without results goes back to the head of the queue. A timer asks for the state of an open run where no call does.

    One run is open at a time, or up to ``most_open``: the first is then alone, and after runs that have all been completed twice as
    many are opened at once; after one that ended without results there is one again. So calls go with the logarithm of the queue.
    """

    def __init__(self, poll_ms: int, most_open: int = 1):
        self.poll_ms, self.most_open = poll_ms, most_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "run string, queue string, seen string")

    def _load(self) -> None:
        """The runs opened last (sequence, token, lines, batch, status, applied), the queue of (token, lines), and the tokens seen: a row a chunk each."""
        run, queue, seen = self.state.get() if self.state.exists() else ("null", "[]", "[]")
        self.queue, self.seen, runs = json.loads(queue), json.loads(seen), json.loads(run) or []
        self.runs = [runs] if runs and not isinstance(runs[0], list) else runs  # one run, as it was kept before there could be several

    def _save(self) -> None:
        self.state.update((json.dumps(self.runs), json.dumps(self.queue), json.dumps(self.seen)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows), ignore_index=True)  # a row a chunk, report or call, not a request
        found["first"] = found["kind"].map(_FIRST)
        found = found.sort_values(["at", "first", "sequence", "token"], kind="stable")
        self._load()
        out: list[tuple] = []
        for row in found.itertuples(index=False):
            if row.kind == "chunk":
                self._chunk(row)
            elif row.kind == "report":
                out += self._report(row)
            else:
                out += self._call(timerValues)
        self._save()
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = [("poll", *run[:5]) for run in self._open() if run[3]]
        if out:
            self._wait(timerValues)
        yield self._rows(key, out)

    def close(self) -> None:
        pass

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *x, i) for i, x in enumerate(out)], columns=_OUT)

    def _open(self) -> list[list]:
        return [run for run in self.runs if run[4] not in TERMINAL]

    def _wait(self, timerValues) -> None:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.poll_ms)

    def _chunk(self, row) -> None:
        if row.token not in self.seen:
            self.seen.append(row.token)
            self.queue.append([row.token, int(row.lines)])

    def _report(self, row) -> list[tuple]:
        run = next((r for r in self._open() if r[0] == int(row.sequence)), None)
        if not run or (run[3] and run[3] != row.batch):
            return []
        run[3:] = [row.batch, row.status, False]
        return [("run", *run[:5])]

    def _call(self, timerValues) -> list[tuple]:
        out = []
        for run in self.runs:
            if run[4] not in TERMINAL:
                out.append(("poll" if run[3] else "submit", *run[:5]))
            elif run[4] == "completed" and not run[5]:
                out.append(("apply", *run[:5]))
                run[5] = True
        if self._open():
            return out
        lost = [run for run in self.runs if run[4] != "completed"]
        chunks = [[run[1], run[2]] for run in lost] + self.queue
        if not chunks:
            return out
        last = self.runs[-1][0] if self.runs else 0
        width = 1 if lost or not self.runs else min(2 * len(self.runs), self.most_open)
        self.queue = chunks[width:]
        self.runs = [[last + i, token, lines, None, "pending", False] for i, (token, lines) in enumerate(chunks[:width], 1)]
        self._wait(timerValues)
        return [*out, *[(kind, *run[:5]) for run in self.runs for kind in ("run", "submit")]]


class FirstTerminal(StatefulProcessor):
    """A key's state: its earliest terminal one by (at, id), whatever the order of arrival; else the open one.

    An event that comes again, or later than a terminal one, changes nothing. A row is given out only where the state changes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()  # none if there is none: asking for that first would be another call
        best = old
        for batch in rows:
            events = list(zip(*(batch[c].tolist() for c in ("status", "at", "id")), strict=True))
            ended = [e for e in events if e[0] in TERMINAL]
            if ended:
                status, at, id_ = min(ended, key=lambda e: (e[1] != e[1], e[1], e[2]))  # without a time last
                new = (status, int(at), int(id_))
                if best is None or best[0] not in TERMINAL or new[1:] < tuple(best[1:]):
                    best = new
            elif best is None and events:
                best = (events[0][0], 0, 0)
        if best is not None and best != old:
            self.state.update(tuple(best))
            yield pd.DataFrame([(*key, best[0])], columns=["key", "status"])

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession, partitions: int | None):
    """The state store that state machines need, for the streams that are started inside; in so many partitions, if given."""
    wanted = {STORE: ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    was = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def stage_runs(inbox: DataFrame, poll_ms: int = 60_000, most_open: int = 1) -> DataFrame:
    """What the runs of each (school, stage) ask for: kind run, submit, poll or apply; ``inbox`` is a stream of INBOX."""
    keyed = inbox.groupBy("school", "stage")
    return keyed.transformWithStateInPandas(StageRuns(poll_ms, most_open), OUTBOX, "Append", "ProcessingTime")


def terminal_states(events: DataFrame, key: str, kind: str) -> DataFrame:
    """key, status: a row for each change of state; ``events`` is a stream of (key, status, at, id), at and id whole numbers."""
    return events.groupBy(key).transformWithStateInPandas(FirstTerminal(), f"key {kind}, status string", "Update", "None")


def run_with_state(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str, once: bool = False, partitions: int | None = None) -> None:
    """Processes what is there and ends; state and offsets lie in the checkpoint, where the next call goes on.

    ``once``: in one batch, which is what a machine with timers needs: as long as timers may fire, it always has another batch to run.
    ``partitions`` of the state, each a store of its own that every batch opens: a checkpoint keeps the number it began with.
    """
    with state_store(stream.sparkSession, partitions):
        writer = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint)
        (writer.trigger(once=True) if once else writer.trigger(availableNow=True)).start().awaitTermination()
