"""Toxicity by multiple-instance learning: sentences are scored, documents are their noisy-or.

A sentence's score is a logistic function of the words in it, and of their first four and five characters (so
inflected and compounded forms count). A document is toxic with probability 1 - product(1 - sentence score).
The weights are learned from document labels only, by gradient steps on the documents' log loss; what they
put on sentences then locates the offending ones.

The model is fitted on a bounded sample of labelled rows: of each label, the ``SAMPLE`` rows of least hash that
aren't held out. Every row is scored, over its whole text.

Nulls: a null text counts as empty. A text without a word has no sentence and score 0. A null label isn't
learned from; an id with several labelled rows counts once for each label, and of several texts of an id the
least one is learned from. With no labelled row of either kind every
score is 0. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veredas.llm.common import pick, remainder

SAMPLE = 2500  # labelled rows of each label
LEAST = 5  # toxic documents of the sample that have a feature
TELLING = 20.0  # least likelihood ratio of a feature: chance gives one in 100,000 such
STEPS = 300
RATE = 0.05
DECAY = 1e-4
REMEMBER = 300_000  # words whose weights a worker keeps
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> tuple[str, ...]:
    return (f"={word}", word[:4], word[:5]) if len(word) > 4 else (f"={word}", word)


class Words(dict):
    """Weights of words, worked out when first asked for."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        w = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) >= REMEMBER:
            self.clear()
        if len(word) <= 64:
            self[word] = w
        return w


class Model:
    def __init__(self, weights: dict[str, float], bias: float | None):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None, words: Words) -> tuple[float, list[float]]:
        """The document's score, and its sentences'."""
        if self.bias is None:
            return 0.0, []
        weight, find = words.__getitem__, WORD.findall
        z = np.array([sum(map(weight, set(f))) for s in SENTENCE.split((text or "").lower()) if (f := find(s))])
        if not len(z):
            return 0.0, []
        z = np.clip(z + self.bias, -35, 35)
        clean = -np.logaddexp(0, z).sum()  # log of the product of 1 - p
        return float(-np.expm1(clean)), (1 / (1 + np.exp(-z))).tolist()


def _found(text: str) -> set[str]:
    """The features of a text."""
    return {f for w in set(WORD.findall(text.lower())) for f in features(w)}


def _telling(texts: list[str], labels: np.ndarray) -> dict[str, int]:
    """The features that more toxic documents have than chance explains, by the likelihood ratio of their counts.

    Only features of enough toxic documents are counted in clean ones, so rare words take no memory there.
    """
    n1, n = labels.sum(), len(labels)
    toxic: Counter[str] = Counter()
    for text, y in zip(texts, labels, strict=True):
        if y:
            toxic.update(_found(text))
    with_it = {f: [0, k] for f, k in toxic.items() if k >= LEAST}
    del toxic
    for text, y in zip(texts, labels, strict=True):
        if not y:
            for f in _found(text):
                if f in with_it:
                    with_it[f][0] += 1
    names = list(with_it)
    c = np.array([with_it[f] for f in names], float).reshape(-1, 2)
    total, share = c.sum(1), n1 / n
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * sum(np.nan_to_num(c[:, k] * np.log(c[:, k] / (total * q))) for k, q in ((0, 1 - share), (1, share)))
    kept = [f for f, r, x, t in zip(names, ratio, c[:, 1], total, strict=True) if r >= TELLING and x / t > share]
    return {f: i for i, f in enumerate(sorted(kept))}


def train(texts: list[str], labels: list[int]) -> Model:
    """Gradient steps on the documents' log loss over all sentences; a few thousand documents.

    Only features that tell are given weights, as a single sentence's rare words could explain any document.
    """
    if not texts or len(set(labels)) < 2:
        return Model({}, None)
    y = np.array(labels)
    index = _telling(texts, y)
    feature, sentence, doc = array("i"), array("i"), array("i")  # compact, as there are millions
    for d, text in enumerate(texts):
        for s in SENTENCE.split(text.lower()):
            if found := WORD.findall(s):
                own = {index[f] for w in set(found) for f in features(w) if f in index}
                feature.extend(own)
                sentence.extend([len(doc)] * len(own))
                doc.append(d)
    if not doc:
        return Model({}, None)
    feature, sentence, doc = np.array(feature, np.int64), np.array(sentence, np.int64), np.array(doc, np.int64)
    w = np.full(len(index) + 1, 2.0)  # the last is the bias
    w[-1] = -5.0
    speed, power = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        z = np.clip(w[-1] + np.bincount(sentence, w[feature], len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc, -np.logaddexp(0, z), len(y)))
        toxic = np.clip(1 - clean, 1e-9, 1)
        # d loss / d z of a sentence: p, times 1 for a clean document and -clean / toxic for a toxic one
        g = p * np.where(y == 1, -clean / toxic, 1.0)[doc]
        grad = np.append(np.bincount(feature, g[sentence], len(index)), g.sum()) / len(y)
        grad[:-1] += DECAY * w[:-1]
        speed = 0.9 * speed + 0.1 * grad
        power = 0.999 * power + 0.001 * grad * grad
        w -= RATE * speed / (1 - 0.9**t) / (np.sqrt(power / (1 - 0.999**t)) + 1e-9)
    return Model({f: float(w[i]) for f, i in index.items()}, float(w[-1]))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 5) == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    marks = pick(labels, "doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).distinct()
    draw = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    drawn = draw[0].unionAll(draw[1])  # at most 2 * sample rows of two numbers: broadcast
    rows = pick(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = rows.orderBy("doc_id", "toxic").collect()  # the bounded sample
    return train([r["text"] or "" for r in found], [r["toxic"] for r in found])


def _scoring(model: Model, spark):
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        words = Words(m.weights)
        for texts in batches:
            found = [m.score(t, words) for t in texts]
            worst = [max(range(len(s)), key=s.__getitem__) if s else None for _, s in found]
            yield pd.DataFrame({
                "score": [d for d, _ in found],
                "offending": [[i for i, p in enumerate(s) if p >= 0.5] for _, s in found],
                "worst_sentence": pd.array(worst, dtype="Int32"),
            })

    return F.pandas_udf(run, "score double, offending array<int>, worst_sentence int")


def toxicity(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (sentences of score 0.5 or more, from 0), worst_sentence of each row."""
    model = model or fit(docs, labels, sample)
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _scoring(model, docs.sparkSession)("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.score", (F.col("p.score") >= 0.5).cast("int").alias("predicted"), "p.offending", "p.worst_sentence")
