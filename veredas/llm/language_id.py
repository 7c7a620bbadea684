"""Language identification by words first, then shorter and shorter character n-grams.

The model has, for each language, log frequencies of words and of the n-grams of words (n = 4 to 1, with word
ends marked). A known word of a text is scored by its log frequency in each language. An unseen word falls back to
its n-grams of the greatest n of which any is known, and takes their mean. A text is the sum over its words
plus the languages' log shares; the score is the posterior of the best language.

The model is fitted on a bounded sample of labelled rows, ``SAMPLE`` a language as expected: a row is in if a
hash of its id and text falls below SAMPLE / (rows of the language). All words and n-grams of the sample are kept.
Every row is predicted, over its whole text. A word is a run of letters (Unicode's categories L): numerals such as ½
or Ⅷ are none.

Nulls: a null text or one without a letter is ``und`` with score 0; so is every text if nothing was learned. A
row of null text or null language isn't learned from. A null id is hashed as empty text. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veredas.llm.common import number_columns, pick, remainder, written

SAMPLE = 1500  # labelled rows of a language, as expected
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")  # letters, and other numerals
REMEMBER = 200_000  # unseen words whose scores a worker keeps


def words_of(text: str) -> Counter[str]:
    """The words of a text, in lower case, with their counts."""
    found = Counter(LETTERS.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:  # few: numerals part letters
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, kind, gram, n): kind 0 for words, n for n-grams; an n-gram counts once for each use of its word."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            words: Counter[str] = Counter()
            for t in texts:
                words.update(words_of(t))
            kinds = {0: words} | {n: Counter() for n in ORDERS}
            for w, c in words.items():
                for n in ORDERS:
                    for g in grams(w, n):
                        kinds[n][g] += c
            for kind, c in kinds.items():
                if not c:  # no word, or none as long as these n-grams
                    continue
                yield pd.DataFrame({"lang": lang, "kind": kind, "gram": list(c), "n": list(c.values())})


def _log_frequencies(table, n_langs: int) -> tuple[dict[str, int], np.ndarray]:
    """Index and matrix (gram by language) of smoothed log frequencies, of an Arrow table (gram, counts by language)."""
    index = {gram: i for i, gram in enumerate(table["gram"].to_pylist())}
    counts = np.stack([table[f"n{k}"].to_numpy() for k in range(n_langs)], 1).astype(float)
    return index, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(index) + 1e-9)).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], shares: list[float], words, by_order: dict[int, tuple]):
        self.langs, self.prior, self.words, self.by_order = langs, np.log(np.array(shares)), words, by_order
        self.seen: dict[str, np.ndarray] = {}

    def unseen(self, word: str) -> np.ndarray:
        out = self.seen.get(word)
        if out is None:
            out = np.zeros(len(self.langs))
            for n in ORDERS:
                index, table = self.by_order[n]
                if hits := [i for g in grams(word, n) if (i := index.get(g)) is not None]:
                    out = table[hits].mean(0)
                    break
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            if len(word) <= 64:
                self.seen[word] = out
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.langs:
            return UNKNOWN, 0.0
        index, table = self.words
        total = self.prior.copy()
        at, times = [], []
        for w, c in words.items():
            i = index.get(w)
            if i is None:
                total += c * self.unseen(w)
            else:
                at.append(i)
                times.append(c)
        if at:
            total += np.array(times, float) @ table[at]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> Model:
    """Learns from text and language of rows that aren't held out."""
    rows = pick(docs, "doc_id", "text", "lang").filter("text is not null and lang is not null").filter(~held_out)
    n = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not n:
        return Model([], [], ({}, np.zeros((0, 0))), {k: ({}, np.zeros((0, 0))) for k in ORDERS})
    langs = sorted(n)
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / n[lang])))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = rows.filter(draw < share[F.col("lang")]).select("lang", "text")
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, lang in enumerate(langs)]
    sums = few.mapInPandas(counted, "lang string, kind int, gram string, n long").groupBy("kind", "gram").agg(*by_lang)
    sums = written(sums, "grams")
    kinds = {}
    for kind in (0, *ORDERS):
        kinds[kind] = _log_frequencies(sums.filter(F.col("kind") == kind).drop("kind").toArrow(), len(langs))
    total = sum(n.values())
    return Model(langs, [n[x] / total for x in langs], kinds[0], {k: kinds[k] for k in ORDERS})


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


def _predicting(model: Model, spark):
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    return F.pandas_udf(run, "lang_pred string, score double")


def languages(docs: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    model = model or fit(docs, held_out(F.col("doc_id")), sample)
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _predicting(model, docs.sparkSession)("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language is known with at least this score, all columns kept."""
    model = fit(docs, held_out(F.col("doc_id")), sample)
    flat, at = number_columns(docs)
    told = flat.withColumn("p", _predicting(model, docs.sparkSession)(F.col(at["text"])))
    kept = told.filter((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least)).drop("p")
    return kept.toDF(*docs.columns)
