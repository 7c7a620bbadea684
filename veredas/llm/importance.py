"""Target-distribution importance resampling over hashed n-grams, from a table of word positions.

Words are exploded with their positions; within a document a window's ``lead`` puts the following words beside each, so that a row
has the n-grams of every order up to ``ORDER`` that start at it. An n-gram's bucket is its CRC-32 modulo ``BUCKETS``. Buckets are
counted over all documents (S) and over all target texts (T), with partial sums before the shuffle; a bucket's gain
is the floored log ratio of its smoothed shares, and the gains, one row a bucket, are joined to the positions. A
document's weight is the floored mean of its gains; Gumbel noise from a hash of its id makes the draw of the highest
scores a sample without replacement by those weights, and the same in every run.

A text goes through the plan in stretches of ``STRETCH`` words and the few that follow, so that a text of any length is many
short windows; stretches are dealt out before they are exploded, and the window needs no other shuffle. Positions are written once, as bucket
numbers, and read for the counts and for the weights. Ranks don't need one sorted partition: places by score come from the counts of
the scores that occur (whole numbers, bounded by the logarithm of the table's size), places within a score from a window by score.

Nulls: a null or empty text has no words, no features and weight 0. A null id is hashed as empty text, and comes before others in
ties. Repeated rows and equal ids count and are drawn each. Empty tables: no documents give no rows; without target
texts t and T are 0. Other columns are ignored, whatever their names; an id keeps its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veredas.llm.common import pick, remove, written
from veredas.llm.decontamination import words

ORDER = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
STRETCH = 4096


def positions(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS, stretch: int = STRETCH) -> DataFrame:
    """row, id, b1 ... b<order>: for each word of each row's ``text`` the buckets of the n-grams that start there.

    ``row`` numbers the rows of the table. A row without words has one position, all null.
    """
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "id", words(F.col("text")).alias("words"))
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(stretch)))
    cut = rows.select("row", "id", "words", first.alias("first"))
    cut = cut.select("row", "id", "first", F.array_join(F.slice("words", F.col("first") + 1, stretch + order - 1), " ").alias("piece"))
    dealt = cut.repartition("row", "first")
    word = F.posexplode_outer(F.when(F.col("piece") != "", F.split("piece", " "))).alias("at", "word")
    told = dealt.select("row", "id", "first", word)
    following = Window.partitionBy("row", "first").orderBy("at")
    told = told.withColumns({f"w{n}": F.lead("word", n - 1).over(following) if n > 1 else F.col("word") for n in range(1, order + 1)})
    own = told.filter(F.col("at").isNull() | (F.col("at") < stretch))  # the rest only follow
    gram = lambda n: F.when(F.col(f"w{n}").isNotNull(), F.concat_ws(" ", *[F.col(f"w{i}") for i in range(1, n + 1)]))
    bucket = lambda n: F.pmod(F.crc32(gram(n).cast("binary")), F.lit(buckets)).cast("int")
    return own.select("row", "id", *[bucket(n).alias(f"b{n}") for n in range(1, order + 1)])


def bucket_counts(at: DataFrame, order: int = ORDER) -> DataFrame:
    """bucket, n: how many n-grams of all orders fall into it. Counted before they are shuffled: tasks times buckets."""
    counts = [at.filter(F.col(f"b{n}").isNotNull()).groupBy(F.col(f"b{n}").alias("bucket")).agg(F.count(F.lit(1)).alias("n")) for n in range(1, order + 1)]
    every = counts[0]
    for more in counts[1:]:
        every = every.unionAll(more)
    return every.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: a row for each bucket, counted or not."""
    both = written(
        source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"]),
        "buckets",
    )
    in_source, in_target = (float(x) for x in both.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t").cast("double") + 1.0) * F.lit(in_source + buckets) / ((F.col("s").cast("double") + 1.0) * F.lit(in_target + buckets))
    found = written(both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")), "gains")
    remove(both)
    return found


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, stretch: int = STRETCH) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document. Its table is written."""
    at = written(positions(pick(docs, "text", id="doc_id"), order, buckets, stretch), "positions")
    told = positions(pick(target, "text").withColumn("id", F.lit(None).cast("int")), order, buckets, stretch)
    gain = gains(bucket_counts(at, order), bucket_counts(told, order), buckets)
    met, names = at, [f"b{n}" for n in range(1, order + 1)]
    for b in names:
        met = met.join(F.broadcast(gain.select(F.col("bucket").alias(b), F.col("gain").alias(f"g{b}"))), b, "left")
    total = F.sum(sum((F.coalesce(F.col(f"g{b}"), F.lit(0)) for b in names), F.lit(0)))
    features = sum((F.count(b) for b in names), F.lit(0))
    found = met.groupBy("row", "id").agg(F.count("b1").alias("n_words"), features.cast("long").alias("n_features"), total.cast("long").alias("total"))
    mean = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    found = found.select(F.col("id").alias("doc_id"), "n_words", "n_features", mean.cast("long").alias("weight"))
    found = written(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    remove(at)
    remove(gain)
    return found


def places(scored: DataFrame, drawn: int) -> DataFrame:
    """score, before: the scores that the draw reaches, and how many eligible rows have a higher one. A row a score."""
    counts = scored.filter(F.col("n_words") >= LEAST_WORDS).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("score", F.coalesce(before, F.lit(0)).alias("before")).filter(F.col("before") < drawn)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, stretch: int = STRETCH) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, ... by score, ties by doc_id; null: not drawn), n_words of each document."""
    scored = weights(docs, target, seed=seed, stretch=stretch)
    drawn = scored.filter(F.col("n_words") >= LEAST_WORDS).count() * percent // 100
    reached = written(places(scored, drawn), "places")
    lowest = reached.agg(F.min("score")).first()[0]  # rows of lower scores, or too short, have no rank
    open_ = F.lit(False) if lowest is None else (F.col("n_words") >= LEAST_WORDS) & (F.col("score") >= F.lit(lowest))
    inside = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight"))
    rank = F.col("before") + inside
    chosen = scored.filter(open_).join(F.broadcast(reached), "score").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = scored.filter(~open_).withColumn("rank", F.lit(None).cast("long"))
    return chosen.drop("before").unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
