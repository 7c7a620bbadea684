"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of a text's lower-cased words, a space after each, and one end symbol. Training texts give
counts of all strings of ``DEPTH`` + 1 symbols, so of all shorter ones. A context (up to DEPTH symbols) is a state if its
next-symbol counts diverge enough from those of its suffix: by ``TELLING`` nats for each next symbol it has
seen; the suffixes of a state are states. Next-symbol distributions are smoothed into those of the next shorter
state (weights n / (n + ESCAPE t), t distinct next symbols), the shortest into the uniform one. Copies among the
training texts raise n without telling more, so ESCAPE is above 1 (3 of 1, 2, 3, 4, 6 and 8, on a seventh of the training
rows that was left out for that; rows held out for good had no part in it). A symbol is scored in the longest state that is
a suffix of what came before.

Every context that diverges enough is a state, so the tree grows with the input and no task holds it whole. Counts
are taken over all training texts. Texts are dealt into chunks of about ``CHUNK_BYTES`` by a hash; a task streams its
chunks one by one, so the number of tasks is Spark's. Each chunk asks for its own words and its own
strings of DEPTH + 1 symbols; counts are summed by word and by string, and what was asked goes back to the chunks: a
word's count, a string's log probability. Strings are priced in parts by the ``HEAD`` symbols before the last: a part
holds its own strings and the states that end in those symbols; states shorter than HEAD, bounded by the alphabet, are
broadcast. So a task holds one chunk and what it asked for, or one part of the tree.

Nulls: a null text counts as empty: it is one end token. A null id is hashed as empty text. Equal ids with different
texts go to chunks of their own. With no training text N and V are 0 and every symbol is as likely. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veredas.llm.common import pick, remainder, remove, written

DEPTH = 5
STATES = None  # all that pass
HEAD = 3
PART = 500_000  # distinct strings priced together
TELLING = 0.5
ESCAPE = 3.0
CHUNK_BYTES = 16_000_000
NAMED = 16  # chunks to a task, up to which their numbers are chosen
BATCH = 1_000_000  # symbols coded at a time: a task holds some 100 bytes for each
END = b"\n"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def coded(found: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The last depth + 1 symbols up to each symbol, as a number; and where each text starts."""
    pad = END * depth
    data = b"".join(pad + b" ".join(f) + END for f in found)
    b = np.frombuffer(data, np.uint8)
    n = len(b) - depth
    code = np.zeros(n, np.uint64)
    for k in range(depth + 1):
        code <<= np.uint64(8)
        code |= b[k : k + n]
    sizes = np.fromiter((max(0, sum(map(len, f)) + len(f) - 1) + 1 + depth for f in found), np.int64, len(found))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keep = np.ones(n, bool)
    for k in range(depth):  # strings that begin in one text and end in the padding of the next
        later = starts[1:] - 1 - k
        keep[later[later >= 0]] = False
    return code[keep], starts - depth * np.arange(len(found))


def _merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def _batched(texts) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for t in texts:
        held.append(words(t))
        size += len(t or "")
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(texts) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for found in _batched(texts):
        c, n = np.unique(coded(found)[0], return_counts=True)
        codes, counts = _merge(np.concatenate([codes, c]), np.concatenate([counts, n])) if len(codes) else (c, n)
    return codes, counts


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        codes, counts = _counted(batch["text"])
        yield pd.DataFrame({"code": codes.view(np.int64), "n": counts})


def contexts(grams: DataFrame, states: int | None = STATES, telling: float = TELLING) -> DataFrame:
    """d (length), k (context and next symbol as a number), n: the next-symbol counts of the states.

    ``grams`` has each string's count. ``states`` keeps only so many of greatest divergence, with their suffixes.
    """
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col("code").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("k")) for d in range(DEPTH + 1)]))
    every = written(grams.select(at.alias("x"), "n").groupBy("x.d", "x.k").agg(F.sum("n").alias("n")), "contexts")
    mask = F.element_at(F.array(*[F.lit((1 << 8 * d) - 1).cast("long") for d in range(DEPTH + 1)]), F.col("d") + 1)
    cut = every.select("d", "k", "n", F.shiftrightunsigned("k", 8).alias("s"))
    totals = cut.groupBy("d", "s").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    # a context's suffix has one symbol less: the counts of (suffix, next) and of the suffix
    own = cut.filter("d > 0").withColumn("pk", F.col("k").bitwiseAND(mask)).withColumn("ps", F.shiftrightunsigned("pk", 8))
    shorter = every.select((F.col("d") + 1).alias("d"), F.col("k").alias("pk"), F.col("n").alias("pn"))
    above = totals.select((F.col("d") + 1).alias("d"), F.col("s").alias("ps"), F.col("total").alias("ptotal"))
    met = own.join(shorter, ["d", "pk"]).join(above, ["d", "ps"]).join(totals, ["d", "s"])
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("pn") / F.col("ptotal"))))
    told = met.groupBy("d", "s", "types").agg(gain.alias("gain")).filter(F.col("gain") >= telling * F.col("types"))
    best = (told if states is None else told.orderBy(F.desc("gain"), "d", "s").limit(states)).select("d", "s")
    ends = F.explode(F.sequence(F.lit(0), F.col("d")))  # the suffixes of states are states
    low = F.element_at(F.array(*[F.lit((1 << 8 * d) - 1).cast("long") for d in range(DEPTH + 1)]), F.col("e") + 1)
    kept = best.select("s", ends.alias("e")).select(F.col("e").alias("d"), F.col("s").bitwiseAND(low).alias("s")).distinct()
    kept = kept.unionAll(grams.sparkSession.createDataFrame([(0, 0)], "d int, s long")).distinct()
    return cut.join(kept, ["d", "s"], "left_semi").select(F.col("d").cast("tinyint").alias("d"), "k", "n")


def _collected(found: DataFrame) -> tuple[np.ndarray, ...]:
    rows = found.toArrow()
    return tuple(rows[c].to_numpy() for c in ("d", "k", "n"))


def tree(docs: DataFrame, states: int | None = STATES, telling: float = TELLING) -> tuple[np.ndarray, ...]:
    """The whole tree of ``contexts`` as arrays, for a table that is small."""
    grams = docs.select("text").mapInPandas(_grams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return _collected(contexts(written(grams, "grams"), states, telling))


MIX = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Numbers to values, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2 + 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.values = keys, values
        left = np.arange(len(keys))
        at = self._at(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several for one slot, the last stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = self._at(keys)
        out = self.slot[at]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slot[at]
            out[left] = got
            off = (got >= 0) & (self.keys[got] != keys[left])
            left, at = left[off], at[off]
        return out


class Model:
    """Log10 probabilities by state, and the weight that a state gives to what it hasn't seen."""

    def __init__(self, d: np.ndarray, k: np.ndarray, n: np.ndarray):
        self.seen: list[Table] = []
        self.states: list[Table] = []
        for depth in range(DEPTH + 1):
            own = d == depth
            key, count = k[own].astype(np.int64).view(np.uint64), n[own].astype(float)
            states, of = np.unique(key >> np.uint64(8), return_inverse=True)
            total, types = np.bincount(of, count, len(states)), np.bincount(of, minlength=len(states))
            spare = ESCAPE * types
            rest = spare / (total + spare)
            if depth:
                shorter = 10 ** self.log10(key & np.uint64((1 << 8 * depth) - 1), depth - 1)
            else:
                shorter = np.full(len(key), 1 / 256)
            p = (count + spare[of] * shorter) / (total + spare)[of] if len(key) else count
            self.seen.append(Table(key, np.log10(p)))
            self.states.append(Table(states, np.log10(rest)))

    def log10(self, codes: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """For each number of depth + 1 symbols: the last one's probability after the others."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        for d in range(depth, -1, -1):
            if not len(left):
                break
            key = codes[left] & np.uint64((1 << 8 * (d + 1)) - 1)
            hit = self.seen[d].find(key)
            found = hit >= 0
            out[left[found]] += self.seen[d].values[hit[found]]
            left, key = left[~found], key[~found]
            if len(left) and len(self.states[d].keys):
                state = self.states[d].find(key >> np.uint64(8))
                known = state >= 0
                out[left[known]] += self.states[d].values[state[known]]
        out[left] += np.log10(1 / 256)
        return out

    def scores(self, texts) -> list[float]:
        return [x for found in _batched(texts) for x in _scored(found, self.log10)]


def _scored(found: list[list[bytes]], log10) -> list[float]:
    codes, starts = coded(found)
    return np.add.reduceat(log10(codes), starts).tolist()


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 7) == 2


def _names(docs: DataFrame, n: int, parts: int) -> Column | None:
    """An array of n numbers for the chunks, which Spark's hash deals over ``parts`` tasks as evenly as 8 n tries allow.

    Nothing depends on it but the lengths of tasks. None where there are many chunks to a task: the hash is even enough then.
    """
    if n > NAMED * parts:
        return None
    tries = docs.sparkSession.range(8 * n).select(F.col("id").cast("int").alias("id"))
    same = Window.partitionBy(F.pmod(F.hash("id"), F.lit(parts))).orderBy("id")
    found = tries.select("id", F.row_number().over(same).alias("k")).orderBy("k", "id").limit(n).collect()
    return F.expr(f"array({','.join(str(r['id']) for r in found)})")


def _by_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(chunk, rows) of a partition sorted by chunk, one batch's part of a chunk at a time."""
    for batch in batches:
        chunks = batch["chunk"].to_numpy()
        ends = np.flatnonzero(np.diff(chunks, append=chunks[-1:] + 1)) + 1 if len(chunks) else []
        for start, end in zip([0, *ends[:-1]], ends, strict=False):
            yield int(chunks[start]), batch.iloc[start:end]


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(chunk, word, n): the words of a chunk, and how often its training texts have each. A chunk is held at a time."""
    for chunk, parts in itertools.groupby(_by_chunk(batches), key=lambda x: x[0]):
        counts: Counter = Counter()
        for _, rows in parts:
            for text, out in zip(rows["text"], rows["held_out"], strict=True):
                found = words(text)
                if out:
                    for w in set(found):
                        counts.setdefault(w, 0)
                else:
                    counts.update(found)
        names, numbers = list(counts), list(counts.values())
        for i in range(0, len(names), 50_000):
            yield pd.DataFrame({"chunk": chunk, "word": names[i : i + 50_000], "n": numbers[i : i + 50_000]})


def _pack(codes: np.ndarray) -> bytes:
    """Sorted numbers, as their differences."""
    return zlib.compress(np.diff(codes, prepend=np.uint64(0)).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint64), dtype=np.uint64)


def _split(codes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket, and where its codes are; order is kept."""
    of = (((codes * MIX) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    ends = np.flatnonzero(np.diff(of[order], append=-1)) + 1
    for start, end in zip([0, *ends[:-1]], ends, strict=False):
        yield int(of[order[start]]), order[start:end]


def _wanted(buckets: int):
    """(bucket, chunk, codes, counts): the strings of a chunk, and how often its training texts have each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, parts in itertools.groupby(_by_chunk(batches), key=lambda x: x[0]):
            held: tuple[np.ndarray, np.ndarray] | None = None
            for _, rows in parts:
                for out, texts in rows.groupby("held_out")["text"]:
                    codes, counts = _counted(texts)
                    counts = counts * (not out)
                    held = (codes, counts) if held is None else _merge(np.concatenate([held[0], codes]), np.concatenate([held[1], counts]))
            codes, counts = held
            told = [(b, chunk, _pack(codes[at]), zlib.compress(counts[at].tobytes(), 1)) for b, at in _split(codes, buckets)]
            yield pd.DataFrame(told, columns=["bucket", "chunk", "codes", "counts"])

    return run


def _summed(asked: pd.DataFrame) -> pd.DataFrame:
    codes = np.concatenate([_unpack(x) for x in asked["codes"]])
    counts = np.concatenate([np.frombuffer(zlib.decompress(x), np.int64) for x in asked["counts"]])
    codes, counts = _merge(codes, counts)
    return pd.DataFrame({"code": codes.view(np.int64), "n": counts})


def _priced(shared, buckets: int):
    def run(strings: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        codes = np.sort(strings["code"].to_numpy(np.int64)).view(np.uint64)
        logs = Model(*(np.concatenate([a, states[c].to_numpy(a.dtype)]) for a, c in zip(shared.value, ("d", "k", "n"), strict=True))).log10(codes)
        rows = [(b, _pack(codes[at]), logs[at].tobytes()) for b, at in _split(codes, buckets)]
        return pd.DataFrame(rows, columns=["bucket", "codes", "logs"])

    return run


def _returned(asked: pd.DataFrame, priced: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers to each chunk, in the form of the words' answers: c = -1 tells them apart."""
    codes, logs = _prices(priced["codes"], priced["logs"])
    rows = []
    for chunk, packed in zip(asked["chunk"], asked["codes"], strict=True):
        own = logs[np.searchsorted(codes, _unpack(packed))].tobytes()
        rows.append((chunk, len(packed).to_bytes(8, "big") + packed + own, -1, False))
    return pd.DataFrame(rows, columns=["chunk", "word", "c", "first"])


def _prices(packed, logs) -> tuple[np.ndarray, np.ndarray]:
    if not len(packed):
        return np.zeros(0, np.uint64), np.zeros(0)
    codes, values = np.concatenate([_unpack(x) for x in packed]), np.concatenate([np.frombuffer(x, float) for x in logs])
    order = np.argsort(codes, kind="stable")
    return codes[order], values[order]


def _prices_of(dealt: DataFrame, buckets: int, states: int | None, telling: float, part: int) -> tuple[DataFrame, list[DataFrame]]:
    """(chunk, word, c, first): the log probabilities of each chunk's strings, packed; and the tables that are read for it."""
    asked = written(dealt.mapInPandas(_wanted(buckets), "bucket int, chunk int, codes binary, counts binary"), "asked")
    grams = written(asked.groupBy("bucket").applyInPandas(lambda rows: _summed(rows), "code long, n long"), "grams")
    found = written(contexts(grams.filter("n > 0"), states, telling), "tree")
    base = dealt.sparkSession.sparkContext.broadcast(_collected(found.filter(F.col("d") < HEAD)))  # bounded by the alphabet
    parts = max(1, -(-grams.count() // part))
    of = lambda k: F.pmod(F.xxhash64(F.shiftrightunsigned(k, 8).bitwiseAND((1 << 8 * HEAD) - 1)), F.lit(parts)).cast("int")
    strings, longer = grams.select(of("code").alias("part"), "code"), found.filter(F.col("d") >= HEAD).withColumn("part", of("k"))
    priced = strings.groupBy("part").cogroup(longer.groupBy("part")).applyInPandas(_priced(base, buckets), "bucket int, codes binary, logs binary")
    answers = asked.select("bucket", "chunk", "codes").groupBy("bucket").cogroup(priced.groupBy("bucket")).applyInPandas(_returned, "chunk int, word binary, c long, first boolean")
    return answers, [asked, grams, found]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_train long, n_first long"


def _answered(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    packed, counts = answers.loc[answers["c"] < 0, "word"], answers[answers["c"] >= 0]
    cut = [8 + int.from_bytes(x[:8], "big") for x in packed]
    codes, values = _prices([x[8:k] for x, k in zip(packed, cut, strict=True)], [x[k:] for x, k in zip(packed, cut, strict=True)])
    prices = Table(codes, values)
    # plain numbers: sums of numpy's own scalars take several times as long
    logs = dict(zip(counts["word"], np.log10(counts["c"].to_numpy() + 1.0).tolist(), strict=True)).__getitem__
    n, hits, sums, score = [], [], [], []
    for held in _batched(docs["text"]):
        for found in held:
            got = list(map(logs, found))
            n.append(len(got))
            sums.append(sum(got))
            hits.append(len(got) - got.count(0.0))  # log10(c + 1) is 0 for c = 0 only
        score += _scored(held, lambda codes: prices.values[prices.find(codes)])
    out = pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "held_out": docs["held_out"].astype(bool), "n_tokens": n, "n_known": hits, "logs": sums, "score": score})
    out["n_train"] = (out["n_tokens"] + 1).where(~out["held_out"], 0)
    out["n_first"] = 0
    if len(out):
        out.loc[out.index[0], "n_first"] = int(counts["first"].sum())
    return out


def language_model_scores(docs: DataFrame, states: int | None = STATES, telling: float = TELLING, chunk_bytes: int = CHUNK_BYTES, part: int = PART) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    rows = pick(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: small chunks aren't put together again
    chunk, names = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"), _names(docs, n, parts)
    chunk = chunk if names is None else F.element_at(names, chunk + 1)
    dealt = rows.select(chunk.alias("chunk"), "doc_id", "text", "held_out").repartition(parts, "chunk").sortWithinPartitions("chunk")
    asked = dealt.mapInPandas(_asked, "chunk int, word binary, n long")
    same = Window.partitionBy("word")
    first = (F.row_number().over(same.orderBy("chunk")) == 1) & (F.sum("n").over(same) > 0)
    sums = asked.select("chunk", "word", F.sum("n").over(same).alias("c"), first.alias("first"))
    prices, read = _prices_of(dealt, max(1, n // 2), states, telling, part)
    answers = sums.unionByName(prices)
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_answered, SCORED)
    scored = written(scored, "scored")
    for table in read:
        remove(table)
    tokens, distinct, ends = scored.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_first"), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    vocabulary = distinct + (ends > 0)  # and the end token, which every training text has once
    total = float(np.log10(tokens + vocabulary + 1.0))
    end = float(np.log10(ends + 1.0))
    return scored.select(
        "doc_id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("logs") + end - (F.col("n_tokens") + 1) * total).alias("base_score"), "score",
    )
