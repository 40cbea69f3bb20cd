"""Centroid clustering by progressive search over Walsh-Hadamard coefficients.

Vectors become whole numbers, and those are transformed exactly: a Walsh-Hadamard transform of 64 whole numbers is 64 whole
numbers, and the squared distance of two transformed vectors is 64 times that of the vectors. Differences to the centroids are
added up from the coarsest coefficients (fewest sign changes) to the finest. A sum over some coefficients is a lower bound, so a centroid
whose sum is already above the whole distance of another is strictly worse and goes; those that stay get all 64 coefficients, so the
distances are exact and ties go to the smaller number. A round is one pass: each task adds up its vectors per centroid, Spark
adds the tasks' sums, and only the centroids' 64 sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..streaming.storage import stored

SIZE = 64
SCALE = 1024
#: Ends of the groups of coefficients that are added together.
LEVELS = (4, 8, 16, 32, 64)
#: Largest whole number of a component, and largest coefficient whose distances are within 64 bits.
LARGEST, FAST = 1 << 40, 1 << 27


def _walsh_order() -> np.ndarray:
    """Places of the fast transform's results in order of their sign changes."""
    n = np.arange(SIZE)
    gray = n ^ n >> 1
    bits = SIZE.bit_length() - 1
    return sum((gray >> i & 1) << (bits - 1 - i) for i in range(bits))


ORDER = _walsh_order()
#: Where each place of the fast transform lies in Walsh order.
PLACE = np.argsort(ORDER)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of rows of 64 whole numbers, coarse to fine."""
    y = x
    step = 1
    while step < SIZE:
        pairs = y.reshape(len(y), -1, 2, step)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(y), SIZE)
        step *= 2
    return y[:, ORDER]


def restored(coefficients: np.ndarray) -> np.ndarray:
    """The rows that have these coefficients."""
    y = coefficients[:, PLACE]
    return transform(y)[:, PLACE] // SIZE


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centre; both sides are coefficients."""
    if len(rows) and max(np.abs(rows).max(), np.abs(centres).max()) > FAST:
        rows, centres = rows.astype(object), centres.astype(object)  # whole numbers of any size
    part = np.zeros((len(rows), len(centres)), rows.dtype)
    alive = np.ones(part.shape, bool)
    every = np.arange(len(rows))
    begin = 0
    for end in LEVELS:
        i, j = np.nonzero(alive)
        d = rows[i, begin:end] - centres[j, begin:end]
        part[i, j] += (d * d).sum(axis=1)
        if begin == 0:  # the best so far is finished at once: what it comes to is the bound
            lead = part.argmin(axis=1)
            d = rows[:, end:] - centres[lead, end:]
            bound = part[every, lead] + (d * d).sum(axis=1)
        alive &= (part <= bound[:, None]).astype(bool)
        begin = end
    whole = np.where(alive, part, (bound + 1)[:, None])
    best = whole.argmin(axis=1)
    return best, whole[every, best] // SIZE


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch.column(1))
        if x.max() > LARGEST or x.min() < -LARGEST:
            raise ValueError(f"a component is beyond {LARGEST} / {SCALE}")
        c = transform(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), SIZE).cast(pa.list_(pa.int64()))], batch.schema.names)


def coefficients(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, c): the coefficients of each vector of exactly 64 components, none null or non-finite."""
    v = vectors[vector]
    fine = (F.size(v) == SIZE) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.filter(F.coalesce(fine, F.lit(False))).select(
        vectors[key].alias("key"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("c"))
    shape = T.StructType([T.StructField("key", vectors.schema[key].dataType), T.StructField("c", T.ArrayType(T.LongType()))])
    return whole.mapInArrow(_transformed, shape)


def _sums(centres: list[list[int]]):
    """Rows to (cluster, n, sums): one row per task and centre that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centres, np.int64)
        n, s = np.zeros(len(at), np.int64), np.zeros((len(at), SIZE), object)
        for batch in batches:
            if len(batch):
                rows = _matrix(batch.column(0))
                best, _ = nearest(rows, at)
                for j in np.unique(best):
                    mine = rows[best == j]
                    n[j] += len(mine)
                    s[j] += mine.sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return run


def _assigned(centres: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centres, np.int64)
        for batch in batches:
            if len(batch):
                best, far = nearest(_matrix(batch.column(1)), at)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(far.tolist(), pa.int64())], ["key", "cluster", "distance"])

    return run


def start_hash(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)


def moved(centres: list[list[int]], sums: list) -> list[list[int]]:
    """The centres' coefficients after a round, from (cluster, n, sums of coefficients) rows: floors of the exact means."""
    out = list(centres)
    for r in sums:
        total = restored(np.array([r.s], object))[0]
        out[r.cluster] = transform(np.array([[x // r.n for x in total]], object))[0].tolist()
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that has 64 finite components.

    Centres start as the ``k`` vectors of smallest hash of ``seed`` and key (equal hashes: smaller coefficients first; fewer vectors: as
    many centres). Every round assigns all vectors and moves each centre that has some. Other vectors give no row; a null key
    hashes as empty text; a repeated row counts each time; no vectors give an empty table; other columns are not read. A
    component beyond 2^30 raises an error, as do distances beyond 64 bits.
    """
    rows = stored(coefficients(vectors, key, vector), "coefficients")
    starts = rows.orderBy(start_hash(F.col("key"), seed), "c").limit(k).collect()
    if not starts:
        kinds = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return rows.select("key", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    centres = [r.c for r in starts]
    for _ in range(rounds):
        parts = rows.select("c").mapInArrow(_sums(centres), "cluster int, n long, s array<long>")
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(SIZE)]).alias("s"))
        centres = moved(centres, sums.collect())
    shape = T.StructType([rows.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    found = stored(rows.mapInArrow(_assigned(centres), shape), "clusters")
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    components = restored(np.array(centres, object)).tolist()
    by = lambda values, kind: F.array(*[F.lit(x).cast(kind) for x in values])[F.col("cluster")]
    return found.select(
        "key", "cluster", "distance", by([inertia.get(i) for i in range(len(centres))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in components], "string").alias("centroid_sha256"))
