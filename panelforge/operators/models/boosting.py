"""Additive boosting of multi-class trees with a validation set that ends the training.

Features are cut into bins once. A round grows one tree per class on the gradients of the softmax loss, level by level: each task
adds up gradients per (class, node, feature, bin) of the rows it reads, Spark adds the tasks' sums, and the driver, which sees
nothing but those sums, picks the splits. Their number is bounded by classes, nodes, features and bins, whatever the rows. The loss on the
validation rows comes with the first level of the next round, so a round of depth d is d passes. Margins are stored every few
rounds; between two stores a task applies the trees grown since.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ...streaming.storage import stored, stored_evenly

#: A tree is a list of levels; a level maps a node to (feature, bin, gain); ``leaves`` maps (level, node) to its value.
KEEP = 5
#: Tasks that add up the tasks' sums of a pass, whose number does not depend on the rows: the session's many partitions cost more than the pass.
SUMS = 4


@dataclass
class Tree:
    levels: list[dict[int, tuple[int, int, float]]] = field(default_factory=list)
    leaves: dict[tuple[int, int], float] = field(default_factory=dict)

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Per level the rows (feature, cut, whether split) of all its nodes and of none, and the value of each node below the last level.

        A node that was not split leads left under a cut nothing exceeds, so its value is that of its leftmost node below.
        """
        out = []
        for depth, level in enumerate(self.levels):
            t = np.zeros((3, 2 ** depth + 1), np.int64)
            t[1] = np.iinfo(np.int32).max
            for node, (f, cut, _) in level.items():
                t[:, node] = f, cut, 1
            out.append(t)
        values = np.zeros(2 ** len(self.levels))
        for (depth, node), value in self.leaves.items():
            values[node << (len(self.levels) - depth)] = value
        return out, values

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """Node of each row at the last level; a row whose node was not split has left it and is at -1."""
        return walk(x, self.tables()[0], leave=True)

    def values(self, x: np.ndarray) -> np.ndarray:
        levels, values = self.tables()
        return values[walk(x, levels)]


def walk(x: np.ndarray, levels: list[np.ndarray], leave: bool = False) -> np.ndarray:
    """Node of each row below the last of ``levels``; with ``leave`` -1 for a row whose node was not split."""
    flat, first, at = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
    for feature, cut, split in levels:
        new = 2 * at + (flat[first + feature[at]] > cut[at])
        at = np.where(split[at] > 0, new, -1) if leave else new
    return at


def add_trees(margins: np.ndarray, x: np.ndarray, tables: list[list[tuple]]) -> None:
    """Add the values of every round's trees, given as their tables, to the margins of their classes."""
    for step in tables:
        for c, (levels, values) in enumerate(step):
            margins[:, c] += values[walk(x, levels)]


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists, without a Python object for each number."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    classes: int
    rounds: list[list[Tree]]
    best: int
    losses: list[float]

    def probabilities(self, df: DataFrame) -> Column:
        """Array of class probabilities of each row, by the rounds up to the best one."""
        edges, trees, k = [np.array(e) for e in self.edges], [[t.tables() for t in step] for step in self.rounds[:self.best]], self.classes

        @F.arrow_udf("array<double>")
        def scored(x: pa.Array) -> pa.Array:
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(edges))
            binned = np.column_stack([np.searchsorted(e, flat[:, i]) for i, e in enumerate(edges)])
            margins = np.zeros((len(x), k))
            add_trees(margins, binned, trees)
            return _lists(softmax(margins))

        return scored(F.array(*[_number(df[f]) for f in self.features]))

    def importances(self) -> dict[str, float]:
        """Mean gain of each feature's splits, as a share of the total."""
        gains: dict[int, list[float]] = {}
        for step in self.rounds[:self.best]:
            for tree in step:
                for level in tree.levels:
                    for f, _, gain in level.values():
                        gains.setdefault(f, []).append(gain)
        mean = [sum(g) / len(g) if (g := gains.get(i)) else 0.0 for i in range(len(self.features))]
        return {f: float(m / (sum(mean) or 1.0)) for f, m in zip(self.features, mean)}


def _number(c: Column) -> Column:
    """Null and NaN features count as 0."""
    x = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.when(F.isnan(x), 0.0).otherwise(x)


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Cut points of each feature: its quantiles, each value once."""
    shares = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(_number(F.col(f)), shares, 100 * bins).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(q or [])) for q in found]


def _passes(trees: list[list[Tree]], growing: list[Tree], k: int, bins: int, with_loss: bool):
    """Rows (x, y, w, valid, m) to sums (class, node, feature, bin, g, h); the validation loss and weight come as class -1."""
    grown, below = [[t.tables() for t in step] for step in trees], [t.tables()[0] for t in growing]
    wide = 2 ** max((len(levels) for levels in below), default=0)

    def run(batches):
        sums, loss = None, np.zeros(2)
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            valid = batch.column(3).to_numpy(zero_copy_only=False)
            margins = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), k).copy()
            add_trees(margins, x, grown)
            p = softmax(margins)
            if with_loss and valid.any():
                loss += (-np.log(np.maximum(p[valid, y[valid]], 1e-300))).sum(), valid.sum()
            x, p, y, w = x[~valid], p[~valid], y[~valid], w[~valid]
            n = x.shape[1]
            if sums is None:
                sums = np.zeros((2, len(below), wide * n * bins))
            places = np.arange(n) * bins + x
            for c, levels in enumerate(below):
                at = walk(x, levels, leave=True)
                here = at >= 0
                cell = (at[here, None] * (n * bins) + places[here]).ravel()
                for i, s in enumerate((w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c]))):
                    sums[i, c] += np.bincount(cell, np.repeat(s[here], n), sums.shape[2])
        found = [np.zeros(0, np.int64)] * 4 + [np.zeros(0)] * 2
        if sums is not None:
            g, h = sums.reshape(2, len(below), wide, -1, bins)
            at = np.nonzero(h > 0)
            found = [*at, g[at], h[at]]
        rows = [np.append(v, last) for v, last in zip(found, (-1, 0, 0, 0, *loss))]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if i < 4 else pa.float64()) for i, v in enumerate(rows)], ["c", "node", "f", "b", "g", "h"])

    return run


def _moved(trees: list[list[Tree]], k: int):
    grown = [[t.tables() for t in step] for step in trees]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            margins = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), k).copy()
            add_trees(margins, x, grown)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _lists(margins)], batch.schema.names)

    return run


def boost(rows: DataFrame, features: list[str], label: str, classes: int, weight: str | None = None, valid: str | None = None, rounds: int = 200,
          depth: int = 5, rate: float = 0.05, patience: int = 20, bins: int = 64, l2: float = 1.0, l1: float = 0.1, gain: float = 1.0,
          least: float = 5.0, edges: list[list[float]] | None = None) -> Boosted:
    """Grow up to ``rounds`` rounds of trees on the rows whose ``valid`` is not true; ``label`` is a class number.

    The training ends when ``patience`` rounds have not lowered the log loss of the validation rows; the rounds up to the lowest
    one count. Without validation rows all rounds count. ``l1`` and ``l2`` shrink leaf values, a split gains at least ``gain``, and each of its
    sides holds a sum of second derivatives of at least ``least``. Equal gains (to nine digits) go to the smaller feature, then bin.
    """
    kept = rows.filter(F.col(label).isNotNull())
    held = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(False)
    edges = edges or quantile_edges(kept.filter(~held), features, bins)
    n_bins = max([len(e) for e in edges], default=0) + 1
    binned = F.array(*[_bin(_number(F.col(f)), e) for f, e in zip(features, edges)])
    now = stored_evenly(kept.select(binned.cast("array<int>").alias("x"), F.col(label).cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast(
        "double").alias("w"), held.alias("v"), F.array(*[F.lit(0.0)] * classes).alias("m")), "boosting")
    shrink = lambda g: np.copysign(np.maximum(np.abs(g) - l1, 0.0), g)
    worth = lambda g, h: shrink(g) ** 2 / (h + l2)

    def sums(recent, growing, with_loss):
        found = now.mapInArrow(_passes(recent, growing, classes, n_bins, with_loss), "c int, node int, f int, b int, g double, h double")
        table = found.repartition(SUMS, "c", "node", "f", "b").groupBy("c", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        c, node, f, b, g, h = (table[n].to_numpy() for n in ("c", "node", "f", "b", "g", "h"))
        out: dict[tuple[int, int], np.ndarray] = {}
        told = c < 0
        loss = float(g[told][0] / h[told][0]) if told.any() and h[told][0] else None
        for key in sorted(set(zip(c[~told].tolist(), node[~told].tolist()))):
            mine = (c == key[0]) & (node == key[1])
            out[key] = np.zeros((len(features), n_bins, 2))
            out[key][f[mine], b[mine]] = np.stack([g[mine], h[mine]], axis=1)
        return out, loss

    def split(hist):
        """Best (gain, feature, bin) of a node, or none that is worth it."""
        total = hist[0].sum(axis=0)
        left = hist.cumsum(axis=1)
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            value = 0.5 * (worth(left[..., 0], left[..., 1]) + worth(right[..., 0], right[..., 1]) - worth(*total)) - gain
        allowed = ~np.isnan(value) & (np.minimum(left[..., 1], right[..., 1]) >= least) & (np.arange(n_bins) < np.array([len(e) for e in edges])[:, None])
        best = None
        if allowed.any():
            near = allowed & (value >= value[allowed].max() - 1e-8)  # those that may be the best once rounded
            for f, b in zip(*(i.tolist() for i in np.nonzero(near))):
                rounded = round(float(value[f, b]), 9)
                if rounded > 0 and (best is None or rounded > best[0]):
                    best = (rounded, f, b)
        return best, total

    grown, recent, losses, best = [], [], [], 0
    while True:
        step = [Tree() for _ in range(classes)]
        for level in range(depth):
            found, loss = sums(recent, step, level == 0)
            if level == 0:
                if loss is not None:
                    losses.append(loss)
                    best = len(losses) - 1 if loss < min(losses[:-1], default=math.inf) else best
                if not found or len(grown) == rounds or loss is not None and len(losses) - 1 - best >= patience:
                    return Boosted(features, edges, classes, grown, best if losses else len(grown), losses)
            for tree in step:
                tree.levels.append({})
            for (c, node), hist in sorted(found.items(), key=lambda x: x[0]):
                chosen, (g, h) = split(hist)
                tree = step[c]
                if chosen is None:
                    tree.leaves[level, node] = float(-rate * shrink(g) / (h + l2))
                    continue
                value, f, b = chosen
                tree.levels[level][node] = (f, b, value)
                if level == depth - 1:
                    left = hist[f][:b + 1].sum(axis=0)
                    for side, (sg, sh) in enumerate((left, (g, h) - left)):
                        tree.leaves[depth, 2 * node + side] = float(-rate * shrink(sg) / (sh + l2))
            if not any(t.levels[level] for t in step):
                break
        grown.append(step)
        recent.append(step)
        if len(recent) == KEEP:
            shape = now.schema
            now = stored(now.mapInArrow(_moved(recent, classes), shape), "boosting")
            recent = []


def _bin(x: Column, edges: list[float]) -> Column:
    """Number of edges below ``x``."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < x)) if edges else F.lit(0)
