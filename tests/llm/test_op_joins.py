"""Jaccard join, centroid clustering and importance resampling against plain Python, with odd rows."""

import hashlib
import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_op_rows import ODD, SCHEMA, clashing
from veredas.llm import centroids, importance, jaccard

by_text = lambda rows: sorted(rows, key=lambda r: tuple(map(str, r)))


def edited(words, share, rng, fresh):
    return [next(fresh) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def near():
    """Groups of near copies around the threshold, of small and large sets, with a passage that many texts share."""
    rng = random.Random(5)
    names = [f"w{i}" for i in range(400)]
    fresh = (f"new{i}" for i in range(10**6))
    passage = rng.choices(names, k=40)
    texts = []
    for size in (3, 5, 9, 10, 11, 16, 17, 18, 22, 25, 29, 30, 60, 150, 400):
        base = rng.choices(names, k=size)
        for share in (0, 0.01, 0.02, 0.03, 0.05):
            texts.append(edited(base, share, rng, fresh))
        texts += [base[1:], base[:-1], base[2:], base + base[:1], base[:-1] + ["end"], base[: size * 9 // 10]]
    for _ in range(30):
        texts.append(passage + rng.choices(names, k=20))
        texts.append(edited(passage + passage[::-1], 0.02, rng, fresh))
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("boundary", [None, 0, 7, 26])
def test_jaccard(spark, near, boundary):
    rows = [*near, (None, near[0][1]), (7, near[3][1]), (7, near[3][1]), (8, ""), (9, None), (10, " \n"), (11, "One two"), (12, "one TWO"), (13, "two one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = jaccard.grouped(df, boundary=boundary)
    assert by_text(map(tuple, found.collect())) == by_text(brute.jaccard_components(rows))


def test_jaccard_is_no_worse_with_few_counters(spark, near):
    """Counters only order the tokens: with one of them any order is as right."""
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert by_text(map(tuple, jaccard.grouped(df, counters=1).collect())) == by_text(brute.jaccard_components(near))


def test_jaccard_counters_reach_the_driver_once(spark, monkeypatch):
    """However many tasks count, the driver gets each counter once."""
    got, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: got.append(collect(self)) or got[-1])
    counters, tasks = 1 << 16, 40
    rng = np.random.default_rng(1)
    counts = [rng.integers(0, 1 << 60, counters) >> 8 for _ in range(tasks)]
    rows = [(zlib.compress(c.tobytes(), 1),) for c in counts] + [(None,)]
    measured = spark.createDataFrame(rows, "counts binary").repartition(tasks)
    assert (jaccard.shingle_counts(measured, counters) == np.sum(counts, axis=0)).all()
    assert 0 < sum(len(pickle.dumps(x)) for x in got) <= 1.1 * 8 * counters


def test_jaccard_hot_group(spark):
    """Six hundred near copies of one text cost stars: fewer verified pairs than the square of the group."""
    rng = random.Random(1)
    fresh = (f"new{i}" for i in range(10**6))
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(base, 0.01, rng, fresh) if i else base)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_text(map(tuple, jaccard.grouped(df).collect())) == by_text(brute.jaccard_components(rows))


def test_jaccard_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    expected = by_text(brute.jaccard_components([(r[0], r[1]) for r in ODD]))
    for df in (odd, clashing(odd)):
        assert by_text(map(tuple, jaccard.grouped(df).collect())) == expected
    empty = jaccard.grouped(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.isEmpty()
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r[2] for r in jaccard.grouped(named).collect() if r[0] in ("d1", "d7") and r[1] == 1} == {"d1"}


def test_subsets_meet():
    """Sets whose overlap links them share a subset of a size that both enumerate."""
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 24)
        a = np.array(sorted(rng.sample(range(10**6), n)), np.uint64)
        b = np.unique(np.array(rng.sample(a.tolist(), max(1, n - rng.randint(0, 2))) + [rng.randrange(10**6) for _ in range(rng.randint(0, 2))], np.uint64))
        if max(len(a), len(b)) > 24:
            continue
        same = len(np.intersect1d(a, b))
        keys = [{(c, k) for c, found in jaccard._subset_keys(x, jaccard.subset_sizes(len(x), 24)) for k in found.tolist()} for x in (a, b)]
        linked = 100 * same >= 85 * (len(a) + len(b) - same)
        met = any(c >= jaccard.enough(len(a), len(b)) for c, _ in keys[0] & keys[1])
        assert met == linked


def test_boundary_by_cost():
    assert jaccard.boundary_of({n: (10, 1) for n in range(1, 27)}) < 7  # lists are all but free
    assert jaccard.boundary_of({n: (10, 10**6) for n in range(1, 19)}) >= 18  # lists are very long
    assert jaccard.boundary_of({}) == 0


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(n)]


def clustered(df):
    rows = df.collect()
    return by_text((r["vec_id"], r["cluster"], r["distance"]) for r in rows), rows


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_centroids(spark, n):
    rows = vectors(n)
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None] + [1.0] * 63), (904, [float("nan")] * 64), (905, [float("inf")] * 64), (906, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3).withColumns({"cluster": F.lit("?"), "vector": F.lit("?"), "q": F.lit(1)})
    found, all_rows = clustered(centroids.clusters(df))
    expected, last = brute.kmeans(rows)
    assert found == by_text(expected)
    for r in all_rows:
        own = [d for _, c, d in expected if c == r["cluster"]]
        assert (r["cluster_inertia"], r["inertia"]) == (sum(own), sum(d for _, _, d in expected))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, last[r["cluster"]])).encode()).hexdigest()


def test_centroids_ties_and_repeated_rows(spark):
    rows = [(1, [0.5] * 64)] * 20 + [(None, [-0.5] * 64)] * 3 + [(2, [0.5] * 64), (3, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    found, all_rows = clustered(centroids.clusters(df))
    assert found == by_text(brute.kmeans(rows)[0]) and df.schema["vec_id"].dataType == centroids.clusters(df).schema["vec_id"].dataType


@pytest.mark.parametrize("large", [3e4, 1e7, 1e12, 1e200, 1.7e308])
def test_centroids_beyond_float64(spark, large):
    """Beyond the bound, integers take over: the assignment stays exact; distances that no long holds are null."""
    rows = vectors(40, 3) + [(100 + i, [large * (1 + i / 7)] * 32 + [-large] * 32) for i in range(0, 5) if large * 2 < 1e308 or not i]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = [(i, c, d if d < 1 << 63 else None) for i, c, d in brute.kmeans(rows)[0]]
    assert clustered(centroids.clusters(df))[0] == by_text(expected)


def test_products_are_exact():
    """Distances at the edge of 2^53 by matrix products, beyond it by integers."""
    rng = np.random.default_rng(4)
    for most in (1000, 5_000_000, 6_000_000, 10**8, 2 * 10**8, 10**9, 10**12):
        x, c = rng.integers(-most, most, (50, 64)), rng.integers(-most, most, (8, 64)).tolist()
        cluster, distance = centroids.nearest(x, c)
        for row, k, d in zip(x.tolist(), cluster, distance, strict=True):
            assert (int(d), int(k)) == min((sum((a - b) ** 2 for a, b in zip(row, at, strict=True)), j) for j, at in enumerate(c))
    for width, most in ((2, 1 << 14), (4, 1 << 30), (8, 1 << 60), (13, 1 << 100)):
        x = np.array([[most, -most, 0, -1]], np.int64 if most < 1 << 62 else object)
        assert centroids.unpacked(*centroids.packed(x), 4).tolist() == x.tolist() and centroids.packed(x)[0] == width


@pytest.mark.parametrize("stretch", [1, 2, 7, 4096])
def test_importance(spark, sf, stretch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60 if stretch < 7 else 10**6)
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [tuple(r) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = importance.resampled(df, target, stretch=stretch).drop("n_words").collect()
    assert by_text(map(tuple, found)) == by_text(brute.resampled(rows, [r["text"] for r in target.collect()]))


def test_importance_rows(spark):
    rows = [*[(r[0], r[1]) for r in ODD], *[(i // 3, f"{'word ' * (15 + i)} end") for i in range(30)], *[(50, "same words " * 12)] * 5]
    df = spark.createDataFrame([(*r, "en", "x", 1) for r in rows], SCHEMA)
    for target in ([], [("t", "word word end")], [("t", None), (None, "")]):
        told = spark.createDataFrame(target, "item_id string, text string")
        expected = by_text(brute.resampled(rows, [t for _, t in target]))
        for docs in (df, clashing(df)):
            assert by_text(map(tuple, importance.resampled(docs, clashing(told)).drop("n_words").collect())) == expected
    empty = importance.resampled(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("t", "a b")], "item_id string, text string"))
    assert empty.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"] and empty.isEmpty()
