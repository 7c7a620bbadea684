"""Centroid clustering in integers: squared distances as |x|² - 2x·c + |c|² by blocked matrix products.

Each component becomes the integer floor(``SCALE`` * x), and everything after that is exact. Vectors are written
once, as blocks of rows in the narrowest integers that hold them; every round reads the blocks again and multiplies
each with the centroids in float64. That is exact as long as no partial sum can reach 2^53: with d components, of at
most X in a vector and C in the centroids, as long as d (X + C)² stays below it. A vector beyond that bound is taken
in 64-bit integers (below 2^63), or in integers of any length. Sums and counts of each cluster meet by
``RDD.treeAggregate``, so neither the driver nor a task ever gets more than a few sums of k centroids at a time.

Kept are vectors with exactly ``DIMENSIONS`` components, none null or not finite; others have no row in the result. Centroids start as the
k kept vectors of smallest SHA-256 of ``3:<vec_id>`` (a null id: ``3:``), ties by the vector's components; with fewer
vectors there are fewer centroids. Ties of distances go to the smaller number, so of equal centroids the later stays
empty and where it is. Repeated rows and equal ids count each. A distance or sum beyond 64 bits is null (the
assignment is exact all the same). An empty table gives no rows. Other columns are ignored, whatever their names; an
id keeps its type.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from veredas.llm.common import pick, written

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024  # a power of two: products are exact
SEED = 3
ROWS = 4096  # of a block
EXACT = 1 << 53  # float64 holds every integer up to it
LONG = 1 << 63


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers, or as Python's where they may not fit."""
    if not values.size or np.abs(values).max() < 2.0**52:
        return np.floor(values * SCALE).astype(np.int64)
    whole = lambda x: int(x) * SCALE if abs(x) >= 2.0**52 else math.floor(x * SCALE)
    return np.array([[whole(x) for x in row] for row in values.tolist()], object)


def packed(x: np.ndarray) -> tuple[int, bytes]:
    """Bytes a component, and the components in as many: 2, 4, 8, or what the largest needs."""
    most = int(np.abs(x).max(initial=0))
    width = next((w for w in (2, 4, 8) if most < 1 << (8 * w - 1)), most.bit_length() // 8 + 1)
    if width <= 8:
        return width, x.astype(f"<i{width}").tobytes()
    return width, b"".join(v.to_bytes(width, "little", signed=True) for v in x.ravel().tolist())


def unpacked(width: int, data: bytes, dimensions: int) -> np.ndarray:
    if width <= 8:
        return np.frombuffer(data, f"<i{width}").reshape(-1, dimensions).astype(np.int64)
    found = [int.from_bytes(data[i : i + width], "little", signed=True) for i in range(0, len(data), width)]
    return np.array(found, object).reshape(-1, dimensions)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's centroid, and the squared distance to it: of equal ones the smallest number."""
    n, d = x.shape
    largest = max(abs(v) for c in centroids for v in c)
    sizes = np.abs(x).max(axis=1, initial=0)
    below = lambda bound: math.isqrt((bound - 1) // d) - largest  # noqa: E731  the largest component that keeps d (X + C)² under the bound
    cluster, distance = np.zeros(n, np.int64), np.zeros(n, object)
    fast = np.flatnonzero(sizes <= below(EXACT))
    if len(fast):
        a, c = x[fast].astype(float), np.array(centroids, float)
        squares = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
        cluster[fast] = squares.argmin(1)
        distance[fast] = squares.min(1).astype(np.int64)
    slow = np.flatnonzero(sizes > below(EXACT))
    if len(slow):
        kind = np.int64 if max(map(int, sizes[slow])) <= below(LONG) else object
        a, c = x[slow].astype(kind), np.array([[int(v) for v in c] for c in centroids], kind)
        squares = np.stack([((a - row) ** 2).sum(1) for row in c], axis=1)
        cluster[slow] = squares.argmin(1)
        distance[slow] = squares.min(1)
    return cluster, distance


def cluster_sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of each cluster's rows, as Python's integers."""
    if len(x) * int(np.abs(x).max(initial=0)) < EXACT:
        own = np.zeros((len(x), k))
        own[np.arange(len(x)), cluster] = 1.0
        return (own.T @ x.astype(float)).astype(np.int64).astype(object)
    return np.array([x[cluster == c].astype(object).sum(axis=0) if (cluster == c).any() else [0] * x.shape[1] for c in range(k)], object)


def _blocks(dimensions: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                width, data = packed(quantised(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids.cast(schema.field(0).type), pa.array([width], pa.int32()), pa.array([data], pa.binary())], schema=schema)

    return run


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and the vector as doubles, of the vectors that count."""
    rows = pick(vectors, "vec_id", vector="embedding").withColumn("vector", F.col("vector").cast("array<double>"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter((F.size("vector") == dimensions) & whole)


def starts(rows: DataFrame, k: int, seed: int = SEED) -> list[list[int]]:
    """The first centroids; k rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return [list(map(int, quantised(np.array([r["vector"]], float))[0])) for r in first]


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    rows = kept(vectors, dimensions)
    kind = rows.schema["vec_id"].dataType
    out = StructType().add("vec_id", kind).add("cluster", IntegerType()).add("distance", LongType()).add("cluster_inertia", LongType()).add("inertia", LongType()).add("centroid_sha256", StringType())
    centroids = starts(rows, k, seed)
    if not centroids:
        return rows.sparkSession.createDataFrame([], out)
    form = StructType().add("ids", ArrayType(kind)).add("width", IntegerType()).add("data", BinaryType())
    blocks = written(rows.mapInArrow(_blocks(dimensions, _arrow(form)), form), "blocks")
    matrices = blocks.select("width", "data").rdd.map(lambda r: unpacked(r[0], bytes(r[1]), dimensions))
    k = len(centroids)
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    nothing = (np.zeros((k, dimensions), object), np.zeros(k, object))
    for _ in range(rounds):

        def counted(so_far, x, at=centroids):
            cluster, _ = nearest(x, at)
            return add(so_far, (cluster_sums(x, cluster, len(at)), np.bincount(cluster, minlength=len(at)).astype(object)))

        sums, counts = matrices.treeAggregate(nothing, counted, add)
        centroids = [[int(v) // int(n) for v in total] if n else old for total, n, old in zip(sums, counts, centroids, strict=True)]

    def summed(so_far, x, at=centroids):
        cluster, distance = nearest(x, at)
        return so_far + np.array([sum(map(int, distance[cluster == c])) for c in range(len(at))], object)

    inertia = [int(v) for v in matrices.treeAggregate(np.zeros(k, object), summed, lambda a, b: a + b)]
    return blocks.mapInArrow(_assigned(centroids, inertia, dimensions, _arrow(out)), out)


def _long(value: int) -> int | None:
    return value if value < LONG else None


def _assigned(centroids: list[list[int]], inertia: list[int], dimensions: int, schema: pa.Schema):
    digests = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids])
    of_cluster, total = pa.array(list(map(_long, inertia)), pa.int64()), _long(sum(inertia))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0).slice(i, 1).flatten()
                cluster, distance = nearest(unpacked(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), dimensions), centroids)
                at = pa.array(cluster)
                columns = [ids, at.cast(pa.int32()), pa.array([_long(int(v)) for v in distance], pa.int64()), of_cluster.take(at), pa.array([total] * len(ids), pa.int64()), digests.take(at)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run
