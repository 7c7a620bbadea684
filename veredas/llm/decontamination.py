"""Benchmark decontamination: a hash set of normalised test n-grams, verified hits, spans or documents removed.

Texts are lower-cased (A-Z) and cut into words. A window is N consecutive words of a benchmark item; an item of
fewer words is one window. Every position of a document is hashed over a window's words and probed in the
hash set; a hit counts only if the words are equal. A document word inside any occurrence of a window is hit.

A text is cut into words once; each of its positions is probed with every length that windows have (N of them at
most). The hash set is broadcast after its bytes are counted, up to ``most_broadcast``; a larger one is joined by
shuffling probes, salted so that a common window's probes spread, with the same result. Windows go through the
plan one a row, so texts of any length pass.

Nulls: a null or empty text has no words. A benchmark row of null id hits words but isn't counted as an item.
Equal ids with equal texts have the same result, once a row; equal ids with different texts are told apart.
Empty tables give no rows or no hits. Other columns are kept out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veredas.llm.common import ascii_lower, number_columns, pick, written

N = 10
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing: all ASCII but digits and letters
MOST_BROADCAST = 128_000_000  # bytes of windows
SALTS = 16  # parts of a shuffled window


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN), "")


def _window(words: Column, at: Column, length: Column | int) -> Column:
    return F.slice(words, at, F.lit(length) if isinstance(length, int) else length)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(benchmark: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (hash, gram, length), and the items (hash, gram, item_id) that have them."""
    items = pick(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.size("words"), F.lit(n)))
    starts = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    grams = starts.select(_window(F.col("words"), F.col("at"), F.col("length")).alias("gram"), "length", "item_id")
    grams = written(grams.withColumn("hash", F.xxhash64("gram")).distinct(), "windows")
    return grams.select("hash", "gram", "length").distinct(), grams.select("hash", "gram", "item_id").filter("item_id is not null").distinct()


def _bytes(grams: DataFrame) -> int:
    """About what the rows take in memory: a window's words, 16 bytes for each, and 100 for the row."""
    return grams.agg(F.sum(F.octet_length(F.array_join("gram", "")) + 16 * F.size("gram") + 100)).first()[0] or 0


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, text_key, at, length, hash, gram), and the windows' items (hash, gram, item_id)."""
    grams, items = windows(benchmark, n)
    small = _bytes(grams) <= most_broadcast
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect()) or [n]  # at most n numbers
    rows = pick(docs, "doc_id", "text").select("doc_id", _text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("words")).filter(F.size("words") >= lengths[0])
    starts = rows.select("doc_id", "text_key", "words", F.explode(F.sequence(F.lit(1), F.size("words") - (lengths[0] - 1))).alias("at"))
    if len(lengths) == 1:
        probes = starts.withColumns({"length": F.lit(lengths[0]), "hash": F.xxhash64(_window(F.col("words"), F.col("at"), lengths[0]))})
    else:
        of_length = [F.struct(F.lit(k).alias("length"), F.xxhash64(_window(F.col("words"), F.col("at"), k)).alias("hash")) for k in lengths]
        probes = starts.select("*", F.inline(F.array(*of_length))).filter(F.col("at") + F.col("length") - 1 <= F.size("words"))
    window = _window(F.col("words"), F.col("at"), F.col("length"))
    own = grams.select(F.col("hash").alias("gram_hash"), "gram", F.col("length").alias("gram_length"))
    on = (F.col("hash") == F.col("gram_hash")) & (F.col("length") == F.col("gram_length"))
    if small:
        own = F.broadcast(own)
    else:  # probes are shuffled: with their own words only, not the text's
        probes = probes.withColumns({"window": window, "salt": F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS))}).drop("words")
        own = own.withColumn("gram_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on, window = on & (F.col("salt") == F.col("gram_salt")), F.col("window")
    return probes.join(own, on & (window == F.col("gram"))).select("doc_id", "text_key", "at", "length", "hash", "gram"), items


def _covered(spans: Column) -> Column:
    """Words inside sorted spans (at, length)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(so_far: Column, span: Column) -> Column:
        end = F.greatest(so_far["end"], span["at"] + span["length"])
        return F.struct(end.alias("end"), (so_far["n"] + end - F.greatest(so_far["end"], span["at"])).alias("n"))

    return F.aggregate(spans, zero, add, lambda x: x["n"])


def _spans(docs: DataFrame, benchmark: DataFrame, n: int, most_broadcast: int) -> DataFrame:
    """hit_id, hit_key (of the text), spans (at, length), items: a row for each id and text that is hit."""
    found, items = hits(docs, benchmark, n, most_broadcast)
    found = written(found.distinct(), "hits")
    spans = found.select("doc_id", "text_key", "at", "length").distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("at", "length"))).alias("spans"))
    met = found.select("doc_id", "text_key", "hash", "gram").distinct()
    if _bytes(items) <= most_broadcast:
        named = met.join(F.broadcast(items), ["hash", "gram"])
    else:  # a common window's documents spread over salts
        salted = met.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)))
        named = salted.join(items.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["hash", "gram", "salt"])
    with_items = named.select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    met = spans.alias("s").join(with_items.alias("i"), F.expr("s.doc_id <=> i.doc_id and s.text_key = i.text_key"), "left")
    return met.select(F.col("s.doc_id").alias("hit_id"), F.col("s.text_key").alias("hit_key"), "spans", "items")


#: A row's hits are those of the same id and the same text.
_OWN = "doc_id <=> hit_id and text_key = hit_key"


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row, and the hit spans (word numbers from 1)."""
    rows = pick(docs, "doc_id", "text").select("doc_id", _text_key(F.col("text")).alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    met = rows.join(_spans(docs, benchmark, n, most_broadcast), F.expr(_OWN), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return met.select(
        "doc_id", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"), "spans",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The documents without a hit, all columns kept."""
    found, _ = hits(docs, benchmark, n, most_broadcast)
    hit = written(found.select("doc_id", "text_key").distinct(), "hit-docs").withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    flat, at = number_columns(docs)
    flat = flat.join(hit, F.col(at["doc_id"]).eqNullSafe(F.col("hit_id")) & (_text_key(F.col(at["text"])) == F.col("hit_key")), "left_anti")
    return flat.toDF(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id and the normalised text without its hit words, which may split it: parts, an array of strings."""
    rows = pick(docs, "doc_id", "text").select("doc_id", _text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("words"))
    met = rows.join(_spans(docs, benchmark, n, most_broadcast), F.expr(_OWN), "left")
    keep = F.expr("""
        case when spans is null then array(array_join(words, ' ')) else
        filter(split(array_join(transform(words, (w, i) ->
            case when exists(spans, s -> i + 1 >= s.at and i + 1 < s.at + s.length) then '\n' else w end), ' '), '( ?\n ?)+'), p -> p != '')
        end""")
    return met.select("doc_id", keep.alias("parts"))
