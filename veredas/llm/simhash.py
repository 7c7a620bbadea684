"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within ``RADIUS`` = 3 bits differ in at most one bit (half the radius, rounded down) of their upper
or of their lower 32 bits. So every distinct fingerprint emits, for each of its halves, all variants of the half
within one bit: the ball of half the radius. Shuffled on (half, variant), a fingerprint meets every other
whose own half is such a variant; colliding pairs are verified on all 64 bits and deduplicated. Nothing is
missed: the search is exact. (Balls of 64-bit fingerprints would need radius 2 on one side: 2081 rows each.)

Crowded halves: where more than ``CROWD`` fingerprints share a half, they meet on a second key, the same rule
applied to the 16-bit quarters of the other half (at most 3 bits differ there, so at most one in a quarter).

Links join distinct fingerprints; components are found by the smallest label with pointer jumping, in tables,
and each row gets its component's smallest doc_id. Copies are one fingerprint and are never paired.

Nulls: a null, empty or blank text has fingerprint zero, linked like any other. A null doc_id is never the
smallest, unless all ids of the component are null: component_id is null then. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veredas.llm.common import number_columns, pick, remove, written

SHINGLE = 3
SEED = 42
RADIUS = 3
CROWD = 128


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned: a bit is 1 if it is set in over half the hashes of the shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if shingle == 3 and n > 1:
        hashes = [digest(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = np.array(hashes[i : i + 65536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return pick(docs, "doc_id", "text").select("doc_id", _text_key(F.col("text")).alias("text_key"), F.pandas_udf(run, "long")("text").alias("fp"))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _bits(n: int) -> Column:
    return F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(n)])


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct pairs (a < b) of the distinct fingerprints ``fp`` that differ in at most 3 bits."""
    half = F.explode(F.array(*[F.struct(F.lit(h).alias("half"), k.alias("key"), o.alias("rest")) for h, k, o in (
        (0, F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)), (1, F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)),
    )]))
    own = fps.select("fp", half.alias("h")).select("fp", "h.*")
    balls = own.select("fp", "half", "rest", F.explode(F.transform(_bits(32), lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    crowded = written(own.groupBy("half", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("half", "key", F.lit(1).alias("many")), "crowded")
    pairs = []
    for where in ("left_anti", "left_semi"):
        a, b = own.join(crowded, ["half", "key"], where), balls.join(crowded, ["half", "key"], where)
        on = ["half", "key"]
        if where == "left_semi":
            quarters = lambda: F.array(*[F.struct(F.lit(q).alias("quarter"), F.shiftrightunsigned("rest", 16 * q).bitwiseAND(0xFFFF).alias("part")) for q in (0, 1)])
            a = a.select("fp", "half", "key", F.explode(quarters()).alias("q")).select("fp", "half", "key", "q.*")
            b = b.select("fp", "half", "key", F.explode(quarters()).alias("q")).select("fp", "half", "key", "q.*")
            b = b.select("fp", "half", "key", "quarter", F.explode(F.transform(_bits(16), lambda m: F.col("part").bitwiseXOR(m))).alias("part"))
            on = [*on, "quarter", "part"]
        a, b = a.select(F.col("fp").alias("a"), *on), b.select(F.col("fp").alias("b"), *on)
        # Spark takes the variants to be as few as the fingerprints, so it would broadcast them: they are always shuffled
        met = a.join(b.hint("merge"), on).filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        pairs.append(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs[0].unionAll(pairs[1]).distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, c for each vertex of the pairs (a, b): c is the same for all of a component.

    Every round a vertex takes the smallest label among its neighbours' and its own, then its label's label;
    rounds grow with the logarithm of a component's width. A round is a table, so no lineage builds up.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("c")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        least = labels.join(near, "v").select("v", "c", F.least("c", "near").alias("to"))
        of = labels.select(F.col("v").alias("to"), F.col("c").alias("jump"))
        step = written(least.join(of, "to", "left").select("v", F.col("c").alias("was"), F.least("to", "jump").alias("c")), "labels")
        remove(labels)
        labels = step.select("v", "c")
        if step.filter("c != was").isEmpty():
            remove(both)
            return labels


def grouped(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_key, fp, component (the same for all of a component), component_id of each row."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(written(links(distinct.select("fp"), crowd), "links"))
    linked = distinct.join(labels, distinct["fp"] == labels["v"], "left").select("fp", "first", F.coalesce("c", "fp").alias("component"))
    firsts = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    found = written(linked.join(firsts, "component").select(F.col("fp").alias("of"), "component", "component_id"), "components")
    return rows.join(found, F.col("fp") == F.col("of")).drop("of")


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id of its component)."""
    return grouped(docs, crowd).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One document of each component, all columns kept: that of the smallest doc_id (null last); of repeated rows, one.

    The texts aren't shuffled unless the keys of the kept rows are too many to broadcast; only rows whose id and
    text repeat meet by key.
    """
    rows = grouped(docs, crowd).select("doc_id", "text_key", "component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    keep = rows.groupBy("component").agg(first).select("first.doc_id", "first.text_key")
    copies = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    keep = keep.alias("k").join(copies.alias("c"), F.expr("k.doc_id <=> c.doc_id and k.text_key = c.text_key")).select("k.doc_id", "k.text_key", "n")
    keep = written(keep.withColumnsRenamed({"doc_id": "keep_id", "text_key": "keep_key"}), "kept")
    flat, at = number_columns(docs)
    flat = flat.withColumn("key", _text_key(F.col(at["text"])))
    on = F.col(at["doc_id"]).eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    once = flat.join(keep.filter("n = 1"), on, "left_semi")
    repeated = flat.join(keep.filter("n > 1"), on, "left_semi").dropDuplicates([at["doc_id"], "key"])
    return once.unionAll(repeated).drop("key").toDF(*docs.columns)
