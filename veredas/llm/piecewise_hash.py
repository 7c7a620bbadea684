"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over every ``WINDOW`` bytes. Where it is -1 modulo the block size, a piece ends; each piece gives one of 64
characters, from its own hash. The block size is the smallest of 3, 6, 12, ... for which ``TARGET`` pieces are
enough, halved while a signature is shorter than half of that. A fingerprint is ``size:signature:signature at twice
the size``, so that two are compared at any size that both have: by edit distance, where a replaced character
costs an insertion and a deletion, and only if they share a run of ``RUN`` characters (fewer if short).

The text after a document's is found without a shuffle of pairs: rows are dealt in ranges of doc_id and sorted, a
pass over each range meets every document with its next, and the last row of a range meets the first of the next
one through a table of one row a range.

Nulls: a null text counts as empty; its fingerprint is ``3::``, and two empty ones are alike (1), one and a
text are not (0). Rows are ordered by doc_id (null first), then by a hash of the text, then by the text: so
ties and repeated rows have a next row too. A single row is its own next. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veredas.llm.common import pick, written

WINDOW = 7
LEAST = 3
TARGET = 64
RUN = 5
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
STRETCH = 1 << 20  # bytes hashed at a time


def rolling(data: bytes) -> np.ndarray:
    """The hash of the last WINDOW bytes at each byte."""
    b = np.frombuffer(b"\0" * (WINDOW - 1) + data, np.uint8).astype(np.uint32)
    h = np.zeros(len(data), np.uint32)
    for i in range(WINDOW):
        h *= np.uint32(0x9E3779B1)
        h += b[i : i + len(data)] + np.uint32(1)
    return h ^ (h >> np.uint32(15))


def _signature(data: bytes, ends: np.ndarray) -> str:
    crc, start, out = zlib.crc32, 0, []
    view = memoryview(data)
    for e in ends.tolist():
        out.append(SIGNS[crc(view[start:e]) & 63])
        start = e
    if start < len(data):
        out.append(SIGNS[crc(view[start:]) & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    size = LEAST
    while size * TARGET < len(data):
        size *= 2
    least = max(LEAST, size // 4)
    # ends at the smallest size asked for hold those at its multiples, 2 and 4 times as large
    found = [np.zeros(0, np.int64)]
    hashes = [np.zeros(0, np.uint32)]
    for start in range(0, len(data), STRETCH):
        back = min(start, WINDOW - 1)
        h = rolling(data[start - back : start + STRETCH])[back:]
        at = np.flatnonzero(h % np.uint32(least) == least - 1)
        found.append(at + start + 1)
        hashes.append(h[at])
    ends, h = np.concatenate(found), np.concatenate(hashes)
    at = lambda s: ends[h % np.uint32(s) == s - 1]
    while size > least and len(at(size)) < TARGET // 2:
        size //= 2
    return f"{size}:{_signature(data, at(size))}:{_signature(data, at(2 * size))}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        u = state & masks.get(c, 0)
        state = (state + u | state - u) & full
    return len(a) - state.bit_count()


def _likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(RUN, (min(len(a), len(b)) + 1) // 2)
    parts = {a[i : i + run] for i in range(len(a) - run + 1)}
    if all(b[i : i + run] not in parts for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the best over the block sizes that both fingerprints have; 0 if they have none in common."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = ((int(s), x, y) for s, x, y in (f.split(":") for f in (a, b)))
    if n == m:
        return max(_likeness(a1, b1), _likeness(a2, b2))
    return _likeness(a2, b1) if m == 2 * n else _likeness(a1, b2) if n == 2 * m else 0.0


def edited(text: str, after: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the start of the next one."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


DONE, FIRST, LAST = 0, 1, 2
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result(doc_id, text: str, own: str, after: str, after_print: str) -> tuple:
    new = edited(text, after)
    new_print = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, new_print, likeness(own, new_print), likeness(own, after_print)


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted range: its rows but for the last are done; its first and last rows stand with their texts besides."""
    names = [x.split()[0] for x in OUT.split(", ")]
    held, part = None, None
    for batch in batches:
        rows = []
        for doc_id, text, part in zip(batch["doc_id"].astype(object), batch["text"], batch["part"], strict=True):
            doc_id, text = None if doc_id is None or doc_id != doc_id else int(doc_id), text or ""
            own = held[2] if held and held[1] == text else fingerprint(text)
            if held is None:
                rows.append((FIRST, int(part), text, doc_id, None, None, own, None, None, None))
            else:
                rows.append((DONE, int(part), None, *_result(*held, text, own)))
            held = (doc_id, text, own)
        yield _frame(rows, names)
    if held is not None:
        yield _frame([(LAST, int(part), held[1], held[0], None, None, held[2], None, None, None)], names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "part", "text", *names])
    return out.astype({"doc_id": "Int64", "n_chars": "Int64", "kind": "int32", "part": "int32"})


def _joints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in OUT.split(", ")]
    for b in batches:
        ids = [None if pd.isna(x) else int(x) for x in b["doc_id"]]
        rows = [_result(i, t, p, a, q) for i, t, p, a, q in zip(ids, b["text"], b["fingerprint"], b["after"], b["after_print"], strict=True)]
        yield _frame([(DONE, 0, None, *r) for r in rows], names)[names]


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").withColumn("part", F.spark_partition_id())
    found = written(dealt.mapInPandas(_ranges, f"kind int, part int, text string, {OUT}"), "ranges")
    ends = found.filter(F.col("kind") != DONE)
    # one row a range from here on
    order = ends.filter(F.col("kind") == FIRST).select("part")
    around = F.min("part").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    order = order.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), around).alias("next_part"))
    first = ends.filter(F.col("kind") == FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    last = ends.filter(F.col("kind") == LAST).select("part", "doc_id", "text", "fingerprint")
    joints = last.join(order, "part").join(first, "next_part").select("doc_id", "text", "fingerprint", "after", "after_print").mapInPandas(_joints, OUT)
    return found.filter(F.col("kind") == DONE).select(*joints.columns).unionAll(joints)
