"""Centroid clustering: the transform, the search and whole runs against plain arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("panelforge.llm")
from panelforge.llm import centroids  # noqa: E402

SHAPE = "vec_id long, embedding array<float>, label int, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0, "x") for k, v in rows], SHAPE)


def plain(rows, k=8, rounds=10):
    """The contract, vector by vector."""
    whole = [(key, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for key, v in rows
             if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda key: hashlib.sha256(f"3:{'' if key is None else key}".encode()).hexdigest()
    centres = [list(v) for _, v in sorted(whole, key=lambda r: (name(r[0]), centroids.transform(np.array([r[1]], np.int64))[0].tolist()))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in whole:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(own, centres)]
    out = [(key, *near(v)[::-1]) for key, v in whole]
    sums = [sum(d for _, c, d in out if c == i) for i in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((key, c, d, sums[c], sum(sums), digest[c]) for key, c, d in out), key=repr)


def test_transform_is_exact_and_ordered_coarse_to_fine():
    basis = centroids.transform(np.eye(64, dtype=np.int64)).T
    changes = (np.diff(basis, axis=1) != 0).sum(axis=1)
    assert changes.tolist() == list(range(64))
    x = np.random.default_rng(1).integers(-5000, 5000, (50, 64))
    assert (centroids.restored(centroids.transform(x)) == x).all()
    d = centroids.transform(x[:1]) - centroids.transform(x[1:2])
    assert (d * d).sum() == 64 * ((x[0] - x[1]) ** 2).sum()


@pytest.mark.parametrize("scale", [3, 1000, 1 << 32])
def test_search_equals_every_distance_ties_to_the_smaller_number(scale):
    r = np.random.default_rng(2)
    x, c = r.integers(-scale, scale, (300, 64)), r.integers(-scale, scale, (8, 64))
    c[5] = c[2]
    x[:8] = c
    if scale > 1 << 30:  # only what is near enough has a distance of 64 bits
        x = c[r.integers(0, 8, 300)] + r.integers(-9, 9, (300, 64))
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)), i) for i, w in enumerate(c)) for v in x]
    best, far = centroids.nearest(centroids.transform(x), centroids.transform(c))
    assert [(int(d), int(b)) for d, b in zip(far, best)] == want


def test_rounds_against_plain_lloyd(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(i % 5, 1) / 4 for _ in range(64)]) for i in range(120)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (200, rows[9][1])]  # a repeated row, no key, an equal vector
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [None] + [0.5] * 63), (305, [math.nan] + [0.5] * 63),
             (306, [math.inf] + [0.5] * 63)]
    got = sorted((tuple(x) for x in centroids.cluster(frame(spark, rows).repartition(5)).collect()), key=repr)
    assert got == plain(rows)


def test_few_vectors_and_none(spark):
    few = [(i, [i / 8] * 64) for i in range(3)]
    assert sorted(tuple(x) for x in centroids.cluster(frame(spark, few)).collect()) == plain(few)
    none = centroids.cluster(frame(spark, [(1, None)]))
    assert none.collect() == []
    assert none.columns == ["key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_the_range_raise(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(frame(spark, [(1, [1e30] * 64)]))
