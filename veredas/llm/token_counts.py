"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of more than ``CHUNK`` bytes is encoded by the library in overlapping chunks, with the offsets of its
tokens. Two neighbours are spliced at the last boundary in their overlap that both have and that is proven stable.
If there is none, the overlap is widened, back to the last splice; if there is none there either, one stretch goes on
past the chunk, and the chunk grows (doubling, so the work stays in proportion) until the stretch ends.

A boundary is stable if no merge of the vocabulary can cross it: no piece holds these two characters side by
side. That is read off the vocabulary, so it is proven, not hoped for: merges act on one side or the other, and
the tokens of a text are the tokens of the stretches between stable boundaries. Such pairs are frequent in text of any
script, with or without spaces. What is encoded at a time is bounded by a chunk, its overlap and the longest stretch
without such a pair (a long run of one letter is one: the library too can only encode it whole).

Texts up to ``CHUNK`` use the same fact: their stretches from space to space are encoded by the library once and
remembered, in a table that is emptied when it holds ``MEMO`` of them.

Nulls: a null text counts as empty, 0 tokens. Ties, repeated rows and null ids are rows like others. An
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veredas.llm.common import pick

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 32_768  # bytes
OVERLAP = 256
MEMO = 400_000
BATCH = 2_000_000  # characters encoded at a time
MARK = "▁"  # the model writes a space as this character


class Counter32k:
    """Counts tokens as the model's library does, without begin, end or added special tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        #: pairs of characters that some piece has side by side
        self.inner = frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1))
        if any(a != MARK and b == MARK for a, b in self.inner):
            raise ValueError("a piece goes on past a space: words are no stretches of this vocabulary")
        self.memo: dict[str, int] = {}
        self.stretch = re.compile(f"{MARK}+[^{MARK}]*")

    def stretches(self, marked: str, first: bool) -> list[str]:
        """Marked text, cut before each run of marks; only the start of the text may lack its mark."""
        return self.stretch.findall(MARK + marked if first or not marked.startswith(MARK) else marked)

    def learn(self, stretches: Iterable[str]) -> dict[str, int]:
        """The memo, with the tokens of these stretches: runs of marks and what follows.

        The library puts one mark before any text, but none before an empty one. One call encodes all that is new.
        """
        wanted = set(stretches)
        new = [s for s in wanted if s not in self.memo]
        if new:
            if len(self.memo) + len(new) > MEMO:
                self.memo = {}
                new = list(wanted)
            self.memo.update(zip(new, map(len, self.model.encode([s[1:] for s in new], num_threads=1))))
            self.memo[MARK] = 1
        return self.memo

    def stable(self, data: bytes, at: int) -> bool:
        """Whether no token can reach over this offset, which is that of a character."""
        before = _cut(data, at - 1)
        pair = data[before : _cut(data, at + 4, at)].decode()[:2].replace(" ", MARK)
        return pair not in self.inner

    def offsets(self, data: bytes, start: int, end: int) -> np.ndarray:
        """Where in the text the tokens of a chunk begin, as the library gives it."""
        found = self.model.encode(data[start:end].decode(), return_type="proto").pieces
        return np.fromiter((p.begin for p in found), np.int64, len(found)) + start

    def common(self, data: bytes, here: np.ndarray, after: np.ndarray, low: int, high: int) -> int | None:
        """The last stable boundary between these offsets that both chunks have."""
        both = np.intersect1d(here[(here > low) & (here < high)], after[(after > low) & (after < high)])
        return next((at for at in both[::-1].tolist() if self.stable(data, at)), None)

    def whole(self, texts: list[str]) -> list[int]:
        """Tokens of each of some texts; these should be a few MB at most together."""
        found = [self.stretches(t.replace(" ", MARK), True) if t else [] for t in texts]
        memo = self.learn(itertools.chain.from_iterable(found))
        return [sum(map(memo.__getitem__, f)) for f in found]

    def chunked(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The same number from overlapping chunks."""
        data = text.encode()
        size = len(data)
        begin, start, end = 0, 0, _cut(data, chunk)  # the chunk, and the last splice in it
        total, here = 0, self.offsets(data, 0, end)
        while end < size:
            width, high = overlap, _cut(data, end + chunk)
            while True:
                low = _cut(data, max(begin, end - width))
                after = self.offsets(data, low, high)
                at = self.common(data, here, after, max(start, low), end)
                if at is not None or low <= start:
                    break
                width *= 8
            if at is None:
                end = _cut(data, end + max(chunk, end - begin))
                here = self.offsets(data, begin, end)
            else:
                total += int(np.searchsorted(here, at) - np.searchsorted(here, start))
                begin, start, end, here = low, at, high, after
        return total + int(len(here) - np.searchsorted(here, start))


def _cut(data: bytes, at: int, least: int = 0) -> int:
    """The offset of the character that this byte is in; the end if it is past that."""
    if at >= len(data):
        return len(data)
    while at > least and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


@functools.cache
def _counter(name: str) -> Counter32k:
    import public_tokenizers

    return Counter32k(public_tokenizers.path(name))


def counts(texts: Iterable[str | None], model: str = MODEL, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    counter, out = _counter(model), []
    texts = [t or "" for t in texts]
    few: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        long = len(t) > chunk or 4 * len(t) > chunk and len(t.encode()) > chunk
        out.append(counter.chunked(t, chunk, overlap) if long else 0)
        if not long:
            few.append(i)
            size += len(t)
        if size > BATCH or i == len(texts) - 1:
            for k, n in zip(few, counter.whole([texts[k] for k in few]), strict=True):
                out[k] = n
            few, size = [], 0
    return out


def counting(model: str, chunk: int, overlap: int) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counts(texts, model, chunk, overlap), dtype="int64")

    return run


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. No shuffle: a row is counted where it is read."""
    rows = pick(docs, "doc_id", "text")
    counted = rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.pandas_udf(counting(model, chunk, overlap), "long")("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
