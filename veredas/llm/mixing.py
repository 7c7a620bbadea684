"""Mixing sources to target weights: hash-random keys, distributed prefix sums, a cut at each source's budget.

A source's documents are ordered by a hash of the id, as good as random and the same in each run. Hash keys
are uniform, so their leading digits are range buckets of near equal size, in a source of any size: sums by
(source, bucket), a prefix sum over a source's buckets, and a running sum inside each bucket give every
document its place in its source, and no task holds a source. The words from a place to the next fill whole
epochs first; the rest of the budget is cut inside the order.

Nulls: a null text has no words, a null source is a source of its own (the last), a null id is hashed as empty
text. Ties and repeated rows are ordered by a hash of the text; identical rows may swap places. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veredas.llm.common import WORD, number_columns, pick, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST_EPOCHS = 2.0
MOST_BROADCAST = 100_000  # sources whose cuts are broadcast, after they are counted
DIGITS = 3  # leading hex digits of a key that make a range bucket: 16 ** 3 buckets a source


def _skey(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _key(doc_id: Column, text: Column) -> Column:
    """Order in a source: a hash of the id, then of the text."""
    return F.concat(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), F.md5(F.coalesce(text, F.lit(""))))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """skey, source, source_size, target for the rows (skey, source, source_size).

    Budget share * all words, dealt by weight and capped at most * source_size, the excess dealt again. With
    sources in the order of cap / weight, the level of the water is the highest (budget - caps before) /
    (weights from here on), and a target is the least of cap and weight * level. One row a source: small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - before) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    filled = caps.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.select("skey", "source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _placed(narrow: DataFrame, weights, share: float, most: float, digits: int) -> DataFrame:
    """Each row with its source's target, whole epochs, the rest of its budget, and the words before it."""
    sizes = narrow.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    goals = targets(sizes, weights, share, most).withColumn("epochs", epochs).withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    narrow = narrow.withColumn("bucket", F.substring("key", 1, digits))
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        narrow.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
        .select("skey", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
        .join(goals.drop("source"), "skey")
    )
    inside = Window.partitionBy("skey", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return (
        narrow.withColumn("inside", F.sum("size").over(inside))
        .join(buckets, ["skey", "bucket"])
        .withColumn("before", F.col("ahead") + F.col("inside") - F.col("size"))
    )


def _narrow(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "doc_id", "text", "source")
    rows = rows.select("doc_id", "source", _skey(F.col("source")).alias("skey"), _size(F.col("text")).alias("size"), _key(F.col("doc_id"), F.col("text")).alias("key"))
    return written(rows, "mix")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, digits: int = DIGITS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row: the words of it that the mix takes, repeats counted.

    The document at a source's cut gives the part that makes the budget exact.
    """
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    return _placed(_narrow(docs), weights, share, most, digits).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "source"
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, digits: int = DIGITS) -> DataFrame:
    """The mix as documents, all columns kept: a document of k epochs stands in k rows.

    Documents stay whole: that at a source's cut comes in if at least half of it does. The cut of a source is a
    key, so the texts aren't shuffled: they meet a table of one row a source (shuffled by source only if
    there are more than ``MOST_BROADCAST`` sources). Documents without words don't come in.
    """
    placed = _placed(_narrow(docs), weights, share, most, digits)
    inside = F.col("rest") - F.col("before") >= F.col("size") / 2
    cuts = placed.groupBy("skey").agg(F.first("epochs").alias("epochs"), F.max(F.when(inside & (F.col("rest") > 0), F.col("key"))).alias("cut"))
    cuts = written(cuts, "cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= MOST_BROADCAST else cuts
    flat, at = number_columns(docs)
    doc_id, text = F.col(at["doc_id"]), F.col(at["text"])
    copies = F.when(_size(text) > 0, F.col("epochs") + F.coalesce(_key(doc_id, text) <= F.col("cut"), F.lit(False)).cast("long")).otherwise(0)
    met = flat.withColumn("skey", _skey(F.col(at["source"]))).join(cuts, "skey")
    out = met.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return out.select(*[F.col(f"_{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)
