"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

A document's set are the hashes of its distinct shingles; documents link when 100 * intersection >= ``PERCENT`` * union, so
that sets of n and m link with at least c = ceil(PERCENT (n + m) / (100 + PERCENT)) in common. Equal sets are one set, and
links are searched among the distinct sets:

- Small sets (up to a boundary) enumerate their subsets of the fixed sizes c that a partner may ask for. Sets that link share a subset
  of their c. The smallest set of a subset links with every other for which c is enough, and two others
  that link both link with it: so each subset gives a star, never all its pairs.
- Large sets are found over inverted lists. A token's list has the sets that hold it in their prefix, the n - ceil(PERCENT n / 100) + 1
  rarest tokens; sets that link share one of those. Rarity is by counts of all shingles of all documents in ``COUNTERS`` counters
  (any fixed order is right; this one keeps common passages out of the lists). A list is scanned from a hub, the set with the
  fewest rare tokens, and only what is not in the list's main component after that is compared with the others. Parity
  sketches, lower bounds of the difference, let most pairs go unread, and of lists with the same sets one is kept. So many near copies cost a
  star, not their square, and no link between components is missed: the result is exact.
- The boundary is the size at which the subsets that would be written plus the lists that would be scanned are fewest.

All candidates are verified by the whole sets. Components are found by the smallest label with pointer jumping, in tables.

Hashes have 64 bits: a set, a shingle or a subset is taken for another one with a chance of 2^-64 a pair.

Nulls: a null, empty or blank text has an empty set (n_shingles 0), linked with nothing: its component is its own doc_id. With fewer words
than a shingle has, the whole sequence is one. A null doc_id is never the smallest, unless all ids of the component are null. Rows of equal ids or
equal texts are documents each, and those of equal sets are linked. An empty table gives no rows. Other columns are
ignored, whatever their names; an id keeps its type.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from veredas.llm.common import pick, remove, written
from veredas.llm.simhash import components

WIDTH = 4  # words of a shingle
PERCENT = 85
COUNTERS = 1 << 20
SLICE = 1 << 14  # counters summed together
MOST_SMALL = 26  # the boundary is sought up to this size: beyond it, subsets are many thousands a set
STRETCH = 1 << 17  # bytes of a text that are hashed at once
MOST_BROADCAST = 64_000_000  # bytes of numbers
SKETCH = 8  # longs of a sketch
UNIQUE = (1 << 48) - 1  # the bits of a set's number that its rank ends with
_PARITY = [f"p{i}" for i in range(SKETCH)]
HELD = 5_000  # sets, and
MOST_TOKENS = 500_000  # tokens that a task gives out at once
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_LETTER = np.array([xxhash.xxh64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
_BLANK = np.array([bytes([b]).isspace() for b in range(256)])


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse, modulo 2^64."""
    both = (np.full(n, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(b)[:-1]]) for b in both)


def _hashed(data: np.ndarray) -> np.ndarray:
    """A hash of each word: differences of running sums of letters times powers, so no word is made."""
    edges = np.flatnonzero(np.diff(~_BLANK[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(1 << max(12, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * powers[: len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _word_hashes(data: np.ndarray, stretch: int) -> np.ndarray:
    """Hashes of the words in their order, A-Z as a-z; long ones go in stretches that end between words."""
    found, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = at + stretch
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            after = blanks if len(blanks) else np.flatnonzero(_BLANK[data[end:]])
            end = at + int(blanks[-1]) + 1 if len(blanks) else end + int(after[0]) if len(after) else len(data)
        found.append(_hashed(data[at:end]))
        at = end
    return np.concatenate(found) if len(found) > 2 else found[-1]


@lru_cache
def _factor(i: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(b"place", i) | 1)


class Sets(NamedTuple):
    """The shingle sets of some texts: each one's tokens (distinct, sorted) lie between two bounds; its number is a hash of them."""

    tokens: np.ndarray
    bounds: np.ndarray
    numbers: np.ndarray

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for i, number in enumerate(self.numbers.tolist()):
            yield number, self.tokens[self.bounds[i] : self.bounds[i + 1]]


def _sets(held: list[bytes], width: int, stretch: int) -> Sets:
    data = np.frombuffer(b"\n".join(held), np.uint8)
    h = _word_hashes(data, stretch)
    words = _counts(data, held)
    ends = np.cumsum(words)
    used = np.minimum(words, width)
    sizes = np.where(words > 0, words - used + 1, 0)
    end_of = np.repeat(ends, words)
    total = np.full(len(h), width, np.uint64)  # how many words there are counts, and each one's place
    for i in range(width):
        total[: max(0, len(h) - i)] += h[i:] * _factor(i)
    keep = np.arange(len(h)) + width <= end_of
    for d in np.flatnonzero((words > 0) & (words < width)):  # all words are one shingle
        first = ends[d] - words[d]
        total[first] = np.uint64(words[d]) + sum((h[first + i : first + i + 1] * _factor(i) for i in range(words[d])), np.zeros(1, np.uint64))[0]
        keep[first] = True
    total = _mixed(total[keep])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        total[start:end].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[bounds[:-1][sizes > 0]] = True
    tokens = total[new]
    bounds = np.concatenate([[0], np.cumsum(new)])[bounds]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(tokens + _STEPS[0]))])
    numbers = _mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return Sets(tokens, bounds, numbers.view(np.int64))


def _counts(data: np.ndarray, held: list[bytes]) -> np.ndarray:
    """How many words each text has."""
    starts = np.flatnonzero(np.diff(~_BLANK[data], prepend=False, append=False))[::2]
    after = np.cumsum([len(t) + 1 for t in held])
    return np.diff(np.searchsorted(starts, after), prepend=0)


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    """A column's texts as bytes, a part of it copied at a time."""
    for at in range(0, len(column), 500):
        yield from (x.as_py() for x in column.slice(at, 500).cast(pa.binary()))


def shingle_sets(texts: Iterable[str | bytes | None], width: int = WIDTH, stretch: int = STRETCH) -> Iterator[Sets]:
    """The sets of the texts in their order, some texts at a time: as many as have ``stretch`` bytes, or one that has more."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > stretch:
            yield _sets(held, width, stretch)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield _sets(held, width, stretch)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted."""
    return next(shingle_sets([text], width)).tokens


def enough(n: int, m: int, percent: int = PERCENT) -> int:
    """The overlap that links sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def _least(n: int, percent: int) -> int:
    """The smallest partner of a set of n, and the least that they share."""
    return -(-percent * n // 100)


def subset_sizes(n: int, boundary: int, percent: int = PERCENT) -> list[int]:
    """The overlaps that partners up to the boundary may ask of a set of n."""
    partners = range(max(1, _least(n, percent)), min(boundary, 100 * n // percent) + 1)
    return sorted({enough(n, m, percent) for m in partners if enough(n, m, percent) <= min(n, m)})


def boundary_of(sizes: dict[int, tuple[int, int]], percent: int = PERCENT, most: int = MOST_SMALL) -> int:
    """The size up to which subsets cost less than lists, of {n: (sets, list entries to scan)}."""

    def cost(x: int) -> int:
        subsets = sum(count * sum(math.comb(n, c) for c in subset_sizes(n, x, percent)) for n, (count, _) in sizes.items() if n <= x)
        return subsets + sum(scan for n, (_, scan) in sizes.items() if 100 * n >= percent * (x + 1))

    return min(range(most + 1), key=lambda x: (cost(x), x))


def _measured(width: int, counters: int, kept: int, schema: pa.Schema):
    """(doc_id, text_key, set, n, tokens, counts): a row for each text, tokens of small sets only; and a last row of a task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.int64)
        for batch in batches:
            numbers, sizes, held = [], [], []
            for sets in shingle_sets(_texts(batch.column(2)), width):
                np.add.at(counts, (sets.tokens % np.uint64(counters)).astype(np.int64), 1)
                sizes.append(np.diff(sets.bounds))
                numbers.append(sets.numbers)
                held += [t.view(np.int64).tolist() if 0 < len(t) <= kept else None for _, t in sets]
            size = np.concatenate([np.zeros(0, np.int64), *sizes])
            number = pa.array(np.concatenate([np.zeros(0, np.int64), *numbers]), mask=size == 0)
            told = [batch.column(0), batch.column(1), number, pa.array(size), pa.array(held, pa.list_(pa.int64())), pa.nulls(len(size), pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(told, schema, strict=True)], schema=schema)
        last = [None, None, None, None, None, zlib.compress(counts.tobytes(), 1)]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, schema, strict=True)], schema=schema)

    return run


def shingle_counts(measured: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """How many shingles of all texts fall into each counter. Slices of the counters are summed by Spark, so the driver gets each slice once."""

    def slices(row) -> Iterator[tuple[int, np.ndarray]]:
        counts = np.frombuffer(zlib.decompress(bytes(row[0])), np.int64)
        return ((at, counts[at : at + SLICE]) for at in range(0, counters, SLICE))

    parts = measured.filter("counts is not null").select("counts").rdd.flatMap(slices).reduceByKey(np.add, max(1, counters // SLICE // 4))
    sums = np.zeros(counters, np.int64)
    for at, packed in parts.mapValues(lambda x: zlib.compress(x.tobytes(), 1)).collect():
        sums[at : at + SLICE] = np.frombuffer(zlib.decompress(packed), np.int64)
    return sums


class _Order:
    """Tokens from rare to common, by the counters."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        load = float(counts.mean()) if len(counts) else 0.0
        self.load, self.noise = load, load + 4 * math.sqrt(load) + 1

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.counts[(tokens % np.uint64(len(self.counts))).astype(np.int64)]

    def prefix(self, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The rarest tokens that a partner can't all miss, and the counts of all tokens."""
        seen = self.of(tokens)
        n = len(tokens) - _least(len(tokens), percent) + 1
        last = np.partition(seen, n - 1)[n - 1]
        rarer, same = seen < last, np.flatnonzero(seen == last)  # of equal counts the smaller hashes: tokens are sorted
        rarer[same[: n - int(rarer.sum())]] = True
        return tokens[rarer], seen


def _scans(order, percent: int):
    """(n, scan): about how many list entries a small set's prefix has to be compared with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = _Order(order.value)
        for batch in batches:
            scans = []
            for tokens in batch["tokens"]:
                first, _ = by.prefix(np.asarray(tokens, np.int64).view(np.uint64), percent)
                scans.append(len(first) + int(np.maximum(by.of(first) - by.load, 0).sum()))
            yield pd.DataFrame({"n": batch["n"], "scan": scans})

    return run


def _subset_keys(tokens: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    mixed = _mixed(tokens + _STEPS[1])
    total = mixed.sum(dtype=np.uint64)
    for c in sizes:
        left_out = np.array(list(combinations(range(len(tokens)), len(tokens) - c)), np.int64)
        yield c, _mixed(total - mixed[left_out].sum(axis=1, dtype=np.uint64) + np.uint64(c))


def _entries(order, width: int, percent: int, boundary: int):
    """(listed, key, set, rank): tokens whose list a set is in, and subsets. Of a key's sets the hub has the smallest rank, which no two share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, met = _Order(order.value), set()
        rows: list[tuple] = []
        for batch in batches:
            for number, tokens in (x for sets in shingle_sets(_texts(batch.column(0)), width) for x in sets):
                n = len(tokens)
                if not n or number in met:
                    continue
                met.add(number)
                unique = number & UNIQUE
                if n <= boundary:
                    rows += [(False, keys, number, n << 48 | unique) for _, keys in _subset_keys(tokens, subset_sizes(n, boundary, percent))]
                if 100 * n >= percent * (boundary + 1):
                    first, seen = by.prefix(tokens, percent)
                    rows.append((True, first, number, int(1000 * (seen <= by.noise).mean()) << 48 | unique))
                if len(rows) >= HELD:
                    yield _entry_rows(rows)
                    rows = []
        yield _entry_rows(rows)

    return run


def _entry_rows(rows: list[tuple]) -> pa.RecordBatch:
    lengths = [len(r[1]) for r in rows]
    listed, number, rank = (np.repeat(np.array([r[i] for r in rows], kind), lengths) for i, kind in ((0, bool), (2, np.int64), (3, np.int64)))
    keys = np.concatenate([r[1] for r in rows]).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (listed, keys, number, rank)], names=["listed", "key", "set", "rank"])


def _tokens(width: int):
    """(set, n, tokens, sketch, p0 ...): each set's tokens, and the parities of how many fall to each bit; a task gives a set once.

    p0 ... are 512 bits for all sets; ``sketch`` has as many as the set has tokens or more, a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        rows, size = [], 0
        for batch in batches:
            for number, tokens in (x for sets in shingle_sets(_texts(batch.column(0)), width) for x in sets):
                if not len(tokens) or number in met:
                    continue
                met.add(number)
                rows.append((number, tokens.view(np.int64), _parity(tokens, 6 + SKETCH.bit_length() - 1), _parity(tokens, max(6, (len(tokens) - 1).bit_length()))))
                size += len(tokens)
                if size >= MOST_TOKENS:
                    yield _token_rows(rows)
                    rows, size = [], 0
        if rows:
            yield _token_rows(rows)

    return run


def _parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """2^bits parities, by the tokens' first bits: so half as many are the exclusive or of neighbours."""
    odd = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 64)[:, ::-1], axis=1).view(">i8").astype(np.int64).ravel()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))


def _token_rows(rows: list[tuple]) -> pa.RecordBatch:
    number, tokens, short, long = zip(*rows, strict=True)
    sketches = np.stack(short)
    columns = [pa.array(number, pa.int64()), pa.array([len(t) for t in tokens], pa.int32()), _lists(tokens), _lists(long), *[pa.array(sketches[:, i]) for i in range(SKETCH)]]
    return pa.RecordBatch.from_arrays(columns, names=["set", "n", "tokens", "sketch", *_PARITY])


def _enough(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / (100 + percent)).cast("int")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two sets, in columns of these prefixes, allow a link: no shingle of one alone leaves its bit as it is."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    differ = sum((F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in _PARITY), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= n + m - 2 * _enough(n, m, percent))


def _small(df: DataFrame) -> DataFrame:
    """A table of numbers, broadcast if it is small enough."""
    return F.broadcast(df) if 24 * df.count() <= MOST_BROADCAST else df


def _halved(sketch: Column) -> Column:
    """Half as many parities: a bit for each two neighbours, packed two longs to one."""
    both = lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 1))  # noqa: E731  the even bits count

    def packed(x: Column) -> Column:
        x = both(x).bitwiseAND(0x5555555555555555)
        for step, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step)).bitwiseAND(mask)
        return x

    places = F.sequence(F.lit(0), F.floor(F.size(sketch) / 2).cast("int") - 1)
    return F.transform(places, lambda i: packed(F.get(sketch, 2 * i)).bitwiseOR(F.shiftleft(packed(F.get(sketch, 2 * i + 1)), 32)))


def _near(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and long sketches allow a link. Partners differ in size by less than half, so one halving makes sketches alike."""
    size = lambda p: _small(tokens.select(F.col("set").alias(p), F.col("n").alias(f"{p}_n")).distinct())
    alike = pairs.join(size("a"), "a").join(size("b"), "b").filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    alike = written(alike, "alike")
    side = lambda p: tokens.select(F.col("set").alias(p), F.col("sketch").alias(f"{p}_sketch"))
    met = side("a").join(_small(alike), "a").join(side("b"), "b")
    n, m, sizes = F.col("a_n"), F.col("b_n"), F.size("a_sketch") - F.size("b_sketch")
    one, two = F.when(sizes > 0, _halved(F.col("a_sketch"))).otherwise(F.col("a_sketch")), F.when(sizes < 0, _halved(F.col("b_sketch"))).otherwise(F.col("b_sketch"))
    differ = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    found = written(met.filter(differ <= n + m - 2 * _enough(n, m, percent)).select("a", "b").distinct(), "pairs")
    remove(alike)
    return found


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Few pairs go to the sets of their a; only those, one set a pair, are shuffled to their b."""
    pairs = _near(pairs, tokens, percent)
    hubs = written(pairs.select(F.col("b").alias("set")).distinct(), "hubs")
    met = tokens.select(F.col("set").alias("a"), F.col("tokens").alias("of_a")).join(_small(pairs), "a")
    other = tokens.join(_small(hubs), "set", "left_semi").select(F.col("set").alias("b"), F.col("tokens").alias("of_b"))
    met = met.join(other, "b").withColumn("same", F.size(F.array_intersect("of_a", "of_b")))
    found = met.filter(100 * F.col("same") >= percent * (F.size("of_a") + F.size("of_b") - F.col("same"))).select("a", "b").distinct()
    found = written(found, "edges")
    remove(pairs)
    remove(hubs)
    return found


def _unresolved(members: DataFrame, labels: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that share a list and no component yet, as far as their sketches allow a link.

    In each list what is outside the component of most of its sets is compared with all others.
    """
    lists = members.filter("listed").select("key", "set").distinct().join(_small(labels.select(F.col("v").alias("set"), "c")), "set", "left")
    lists = lists.select("key", "set", F.coalesce("c", "set").alias("label"))
    by_label = lists.groupBy("key", "label").agg(F.count(F.lit(1)).alias("sets"))
    main = by_label.groupBy("key").agg(F.max_by("label", F.struct("sets", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    open_ = written(lists.join(main.select("key", "main"), "key").join(tokens.select("set", "n", *_PARITY).dropDuplicates(["set"]), "set"), "open")
    columns = ("set", "label", "main", "n", *_PARITY)
    a = open_.filter("label != main").select("key", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = open_.select("key", *[F.col(c).alias(f"b_{c}") for c in columns])
    once = (F.col("b_label") == F.col("b_main")) | (F.col("a_set") < F.col("b_set"))  # of two outside, one asks
    met = a.join(b, (a["key"] == b["key"]) & (F.col("a_label") != F.col("b_label")) & once & _may_link("a_", "b_", percent))
    found = written(met.select(F.col("a_set").alias("a"), F.col("b_set").alias("b")).distinct(), "unresolved")
    remove(open_)
    return found


def _tokens_of(docs: DataFrame, measured: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(set, n, tokens, p0 ...) of each of the sets, from the first document that has it; more than once only if that row repeats."""
    first = measured.join(_small(sets), "set", "left_semi").groupBy("set").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    first = written(first.select(F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("key")).distinct(), "first")
    on = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    kept = "set long, n int, tokens array<long>, sketch array<long>, " + ", ".join(f"{p} long" for p in _PARITY)
    tokens = written(docs.join(_small(first), on, "left_semi").select("text").mapInArrow(_tokens(width), kept), "tokens")
    remove(first)
    return tokens


def set_components(docs: DataFrame, measured: DataFrame, order, boundary: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """v, c: the component of each distinct set that links with another."""
    entries = written(docs.select("text").mapInArrow(_entries(order, width, percent, boundary), "listed boolean, key long, set long, rank long"), "entries")
    hubs = entries.groupBy("key").agg(F.min_by("set", "rank").alias("hub"), F.max("rank").alias("high"))
    hubs = hubs.filter(F.col("hub").bitwiseAND(UNIQUE) != F.col("high").bitwiseAND(UNIQUE))  # of more than one set
    members = written(entries.select("listed", "key", "set").join(hubs.select("key", "hub"), "key"), "members")
    remove(entries)
    # keys of the same sets say the same: one of them is enough (the near copies of a pair share all the lists they are in)
    told = members.groupBy("key").agg(F.max("listed").alias("listed"), F.min("hub").alias("hub"), F.count(F.lit(1)).alias("sets"), *[F.sum(F.xxhash64("set", F.lit(i)).cast("decimal(38,0)")).alias(f"sum{i}") for i in (0, 1)])
    keys = written(told.groupBy("listed", "hub", "sets", "sum0", "sum1").agg(F.min("key").alias("key")).select("key"), "keys")
    once = written(members.join(_small(keys), "key", "left_semi"), "members")
    remove(members)
    remove(keys)
    members = once
    sets = written(members.select("set").distinct(), "sets")
    tokens = _tokens_of(docs, measured, sets, width)
    remove(sets)
    stars = written(members.filter("set != hub").select(F.col("set").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    edges = _verified(stars, tokens, percent)
    remove(stars)
    labels = components(edges)
    pairs = _unresolved(members, labels, tokens, percent)
    rest = _verified(pairs, tokens, percent)
    for table in (members, tokens, pairs):
        remove(table)
    if not rest.isEmpty():
        found = components(edges.unionAll(rest))
        remove(labels)
        labels = found
    remove(edges)
    remove(rest)
    return labels


def grouped(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, counters: int = COUNTERS, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of its component, itself included) of each row."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    form = StructType([rows.schema["doc_id"], *_parse("text_key long, set long, n long, tokens array<long>, counts binary")])
    measured = written(rows.mapInArrow(_measured(width, counters, MOST_SMALL * 100 // percent + 1, to_arrow_schema(form)), form), "measured")
    order = docs.sparkSession.sparkContext.broadcast(shingle_counts(measured, counters))  # counters numbers
    sets = measured.filter("n is not null").select("doc_id", "set", "n")
    if boundary is None:
        small = measured.filter("tokens is not null").dropDuplicates(["set"]).select("n", "tokens").mapInPandas(_scans(order, percent), "n long, scan long")
        boundary = boundary_of({r[0]: (r[1], r[2]) for r in small.groupBy("n").agg(F.count(F.lit(1)), F.sum("scan")).collect()}, percent)  # a row a size
    labels = set_components(rows, measured, order, boundary, width, percent)
    linked = sets.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("first")).join(labels.select(F.col("v").alias("set"), "c"), "set", "left")
    linked = linked.select("set", "first", F.coalesce("c", "set").alias("component"))
    firsts = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    found = written(linked.join(firsts, "component").select("set", "component_id"), "components")
    remove(labels)
    met = sets.join(found, "set", "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _parse(fields: str) -> list[StructField]:
    return list(StructType.fromDDL(fields))
