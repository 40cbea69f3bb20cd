"""Entity clustering: features, scaling, k-means, silhouette and rule labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ...sources.readers import lookup
from ...streaming.storage import stored_evenly
from ..imputation import impute_median


def features(env: DataFrame, eco: DataFrame, cities: DataFrame, entity: str, env_means: dict[str, Column],
             eco_means: dict[str, Column]) -> DataFrame:
    """Historical means per entity, gaps filled with the column median (0 if a column is empty)."""
    a = env.groupBy(entity).agg(*[F.avg(c).alias(n) for n, c in env_means.items()])
    b = eco.groupBy(entity).agg(*[F.avg(c).alias(n) for n, c in eco_means.items()])
    joined = cities.join(a, entity, "left").join(b, entity, "left")
    return impute_median(joined, [*env_means, *eco_means])


def standardise(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std over the whole table; a constant column gives 0."""
    s = df.agg(F.struct(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).alias("s")).scalar()
    return df.withColumns({
        f"{c}{suffix}": F.when(s[f"s_{c}"] > 0, (F.col(c) - s[f"m_{c}"]) / s[f"s_{c}"]).otherwise(F.col(c) - s[f"m_{c}"])
        for c in cols
    })


def _starts(sample: np.ndarray, k: int, starts: int, seed: int) -> list[np.ndarray]:
    """Starting centres of ``starts`` runs: far rows of a sample, each drawn with a chance by its squared distance to those before."""
    out = []
    for i in range(starts):
        r = np.random.default_rng([seed, k, i])
        chosen = [sample[r.integers(len(sample))]]
        while len(chosen) < k:
            d = np.min([((sample - c) ** 2).sum(axis=1) for c in chosen], axis=0)
            if d.sum() <= 0:
                break  # fewer distinct rows than k
            chosen.append(sample[r.choice(len(sample), p=d / d.sum())])
        if len(chosen) == k:
            out.append(np.array(chosen))
    return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def _rows_of(batch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


#: Tasks that add up the tasks' sums of a pass, which are few rows however large the table: the session's many partitions cost more than the pass.
SUMS = 4
#: Rows whose distances are held at once; their arrays stay within a core's cache.
BLOCK = 2048


def _nearest(x: list[np.ndarray], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre (the first of equals) and squared distance for every run (rows of the result) and row; ``centres`` is run x cluster x column."""
    best = low = None
    for c in range(centres.shape[1]):
        d = sum((x[j][None, :] - centres[:, c, j, None]) ** 2 for j in range(len(x)))
        if low is None:
            best, low = np.zeros(d.shape, np.int64), d
        else:
            best[d < low] = c
            low = np.minimum(low, d)
    return best, low


def _lloyd_step(runs: dict[int, np.ndarray]):
    """Rows meet the centres of every run: (run, cluster, n, sums, squares, cost) added up within a task.

    Runs of as many clusters are measured together, column by column.
    """
    alike: dict[int, list[int]] = {}
    for run, centres in runs.items():
        alike.setdefault(len(centres), []).append(run)
    packed = [(k, ids, np.array([runs[i] for i in ids])) for k, ids in alike.items()]

    def step(batches):
        held = [np.zeros((3 + c.shape[2], len(ids) * k)) for k, ids, c in packed]
        for batch in batches:
            rows = _rows_of(batch) if len(batch) else np.zeros((0, 1))
            for at in range(0, len(rows), BLOCK):
                x = [np.ascontiguousarray(v) for v in rows[at:at + BLOCK].T]
                square = sum(v ** 2 for v in x)
                for (k, ids, centres), sums in zip(packed, held):
                    best, low = _nearest(x, centres)
                    cell = (best + k * np.arange(len(ids))[:, None]).ravel()
                    sums[0] += np.bincount(cell, minlength=sums.shape[1])
                    for i, v in enumerate([square, *x], 1):
                        sums[i] += np.bincount(cell, np.broadcast_to(v, best.shape).ravel(), sums.shape[1])
                    sums[-1] += np.bincount(cell, low.ravel(), sums.shape[1])
        for (k, ids, _), sums in zip(packed, held):
            some = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(ids)[some // k], pa.int32()), pa.array(some % k, pa.int32()), pa.array(sums[0, some].astype(np.int64)),
                pa.array(sums[2:-1, some].T.tolist(), pa.list_(pa.float64())), pa.array(sums[1, some]), pa.array(sums[-1, some])], ["run", "c", "n", "s", "q", "cost"])

    return step


def _silhouettes(runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """(run, total) of the squared-distance silhouettes, from each cluster's size, mean and mean square."""

    def step(batches):
        totals = dict.fromkeys(runs, 0.0)
        for batch in batches:
            if not len(batch):
                continue
            x = _rows_of(batch)
            for run, (n, mean, square) in runs.items():
                best = _distances(x, mean).argmin(axis=1)
                far = (x ** 2).sum(axis=1)[:, None] - 2 * x @ mean.T + square[None, :]
                own = far[np.arange(len(x)), best] * n[best] / np.maximum(n[best] - 1, 1)
                far[np.arange(len(x)), best] = np.inf
                other = far.min(axis=1)
                s = np.where(n[best] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
                totals[run] += float(s.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.float64())], ["run", "total"])

    return step


def lloyd(points: DataFrame, runs: dict[int, np.ndarray], rounds: int) -> dict[int, dict]:
    """Move the centres of all runs together, one pass a round, until none moves: centres, sizes, squares, cost and rounds of each.

    ``points`` is one array column. A centre without rows stays where it is; ``rounds`` bounds the passes, and a run that reached the bound says
    ``settled`` false.
    """
    state = {r: {"centres": c, "rounds": 0, "settled": False} for r, c in runs.items()}
    for turn in range(1, rounds + 1):
        moving = {r: s["centres"] for r, s in state.items() if not s["settled"]}
        if not moving:
            break
        shape = "run int, c int, n long, s array<double>, q double, cost double"
        dims = len(next(iter(moving.values()))[0])
        found = points.mapInArrow(_lloyd_step(moving), shape).repartition(SUMS, "run", "c").groupBy("run", "c").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s"), F.sum("q").alias("q"), F.sum("cost").alias("cost")).toArrow().to_pylist()
        of_run: dict[int, list[dict]] = {}
        for row in found:
            of_run.setdefault(row["run"], []).append(row)
        for r in moving:
            old = state[r]["centres"]
            new, n, q, cost = old.copy(), np.zeros(len(old)), np.zeros(len(old)), 0.0
            for row in of_run.get(r, []):
                c, size = row["c"], row["n"]
                new[c], n[c], q[c], cost = np.array(row["s"]) / size, size, row["q"] / size, cost + row["cost"]
            state[r] |= {"centres": new, "n": n, "q": q, "cost": cost, "rounds": turn, "settled": bool(np.abs(new - old).max() <= 1e-12 * max(1.0, np.abs(old).max()))}
    return state


def kmeans_select(df: DataFrame, cols: list[str], k_min: int = 2, k_max: int = 8, seed: int = 42, starts: int = 10, rounds: int = 300,
                  sample: int = 2000, given: dict[int, np.ndarray] | None = None):
    """k-means for each k from several starts, all of them in one pass a round; the k with the best silhouette wins.

    Starts are drawn from at most ``sample`` rows (those of least hash), or ``given`` by k. Of a k's starts the one of least cost counts; a k with an
    empty cluster is left out. Returns (rows with ``cluster_id``, list of (k, silhouette), the chosen run with its k, centres, cost, rounds and
    whether it settled).
    """
    df = df.drop("cluster_id")
    points = stored_evenly(df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x")), "points")
    if given is None:
        drawn = np.array([r.x for r in points.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(sample).collect()]).reshape(-1, len(cols))
        given = {k: _starts(drawn, k, starts, seed) for k in range(k_min, k_max + 1)} if len(drawn) else {}
    else:
        given = {k: [np.array(c, float)] for k, c in given.items()}
    numbered = [(k, c) for k, many in given.items() for c in many]
    done = lloyd(points, {i: c for i, (_, c) in enumerate(numbered)}, rounds)
    best: dict[int, int] = {}
    for i, (k, _) in enumerate(numbered):
        if (done[i]["n"] > 0).all() and (k not in best or done[i]["cost"] < done[best[k]]["cost"]):
            best[k] = i
    if not best:
        raise ValueError(f"fewer than {k_min} distinct points")
    stats = {i: (done[i]["n"], done[i]["centres"], done[i]["q"]) for i in best.values()}
    total = {r.run: r.t for r in points.mapInArrow(_silhouettes(stats), "run int, total double").groupBy("run").agg(F.sum("total").alias("t")).collect()}
    tried = [(k, total[i] / done[i]["n"].sum()) for k, i in sorted(best.items())]
    k = max(tried, key=lambda t: (t[1], -t[0]))[0]
    run = done[best[k]] | {"k": k}
    centres = lookup(df.sparkSession, [(i, *map(float, c)) for i, c in enumerate(run["centres"])], "cluster_id int, " + ", ".join(f"`{c}` double" for c in cols))
    return assign(df, cols, centres).drop("distance"), tried, run


def centroids(df: DataFrame, cols: list[str], cluster: str = "cluster_id") -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n_members"))


def assign(df: DataFrame, cols: list[str], centres: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Nearest centre and distance for each row. The k centres travel as one scalar array."""
    packed = centres.agg(F.collect_list(F.struct(cluster, *cols)).alias("c")).scalar()
    near = F.array_min(F.transform("_centres", lambda c: F.struct(
        reduce(lambda a, b: a + b, [F.pow(F.col(x) - c[x], 2) for x in cols]).alias("d2"), c[cluster].alias("id"))))
    placed = df.withColumn("_centres", packed).withColumn("_near", near)
    return placed.withColumns({cluster: F.col("_near.id"), "distance": F.sqrt("_near.d2")}).drop("_near", "_centres")


def silhouette_squared(df: DataFrame, cols: list[str], cluster: str) -> DataFrame:
    """Silhouette per row under the squared Euclidean distance, in linear time.

    The mean squared distance to a cluster follows from its size, mean and mean square:
    |x|^2 - 2 x.m + E|y|^2. Rows gain ``a``, ``b`` and ``silhouette``.
    """
    sq = reduce(lambda a, b: a + b, [F.pow(F.col(c), 2) for c in cols])
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(sq).alias("q"), *[F.avg(c).alias(c) for c in cols])
    packed = stats.agg(F.collect_list(F.struct(F.col(cluster).alias("id"), "n", "q", *cols)).alias("s")).scalar()

    def mean_d2(c):
        cross = reduce(lambda a, b: a + b, [F.col(x) * c[x] for x in cols])
        return F.greatest(F.lit(0.0), sq - 2 * cross + c["q"])

    own = F.get(F.filter("_stats", lambda c: c["id"] == F.col(cluster)), F.lit(0))
    others = F.filter("_stats", lambda c: c["id"] != F.col(cluster))
    a = F.when(own["n"] > 1, mean_d2(own) * own["n"] / (own["n"] - 1))
    out = df.withColumn("_stats", packed).withColumns({"a": a, "b": F.array_min(F.transform(others, mean_d2))}).drop("_stats")
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return out.withColumn("silhouette", value)


def silhouette(df: DataFrame, entity: str, cols: list[str], cluster: str, block_rows: int = 2048) -> DataFrame:
    """Exact Euclidean silhouette per entity.

    The measure needs every distance. Rows are cut into hashed blocks of about ``block_rows``;
    a task sees one pair of blocks, computes its distances in numpy and emits only the sum per
    entity and cluster. Blocks are spread by entity hash, so no cluster gathers in one task.
    """
    blocks = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("n")).scalar()
    base = df.select(F.col(entity).alias("id"), F.col(cluster).cast("long").alias("cl"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    base = base.withColumns({"n": blocks, "blk": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    # Each row goes to its own block's pairings: once as the point measured, once as the target.
    left = base.withColumn("other", every).select("id", "cl", "x", F.col("blk").alias("i"), F.col("other").alias("j"))
    right = base.withColumn("other", every).select(
        F.col("cl").alias("cl2"), F.col("x").alias("x2"), F.col("other").alias("i2"), F.col("blk").alias("j2"))
    id_type = df.schema[entity].dataType.simpleString()

    def measure(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "cl": [], "other": [], "d": [], "n": []})
        x, y = np.stack(a["x"]), np.stack(b["x2"])
        out = []
        for k in np.unique(b["cl2"]):
            z = y[b["cl2"].to_numpy() == k]
            d = np.zeros(len(x))
            for start in range(0, len(z), 256):
                d += np.sqrt(((x[:, None, :] - z[None, start:start + 256, :]) ** 2).sum(-1)).sum(1)
            out.append(pd.DataFrame({"id": a["id"], "cl": a["cl"], "other": k, "d": d, "n": len(z)}))
        return pd.concat(out)

    parts = left.groupBy("i", "j").cogroup(right.groupBy("i2", "j2")).applyInPandas(
        measure, f"id {id_type}, cl long, other long, d double, n long")
    sums = parts.groupBy("id", "cl", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own, far = F.col("cl") == F.col("other"), F.col("cl") != F.col("other")
    ab = sums.groupBy("id", "cl").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(far, F.col("d") / F.col("n"))).alias("b"),
    )
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select(F.col("id").alias(entity), F.col("cl").alias(cluster), "a", "b", value.alias("silhouette"))


# Labels by the signs of the scaled centre (income, greening trend, pollution).
INCOME_GREENING, INCOME_STAGNANT, INCOME_STABLE = "High-Income-Greening", "High-Income-Stagnant", "High-Income-Stable"
POLLUTED, IMPROVING, MIXED = "Industrializing-Polluted", "Emerging-Improving", "Developing-Mixed"


def label_clusters(df: DataFrame, cluster: str, income: str, trend: str, pollution: str) -> DataFrame:
    """Label per cluster from its mean in scaled features, compared with 0."""
    c = df.groupBy(cluster).agg(*[F.avg(x).alias(x) for x in (income, trend, pollution)], F.count(F.lit(1)).alias("n_members"))
    rich, green, dirty = F.col(income) > 0, F.col(trend) > 0, F.col(pollution) > 0
    wealthy = F.when(green, INCOME_GREENING).when(dirty, INCOME_STAGNANT).otherwise(INCOME_STABLE)
    other = F.when(dirty, POLLUTED).when(green, IMPROVING).otherwise(MIXED)
    return c.withColumn("cluster_label", F.when(rich, wealthy).otherwise(other))
