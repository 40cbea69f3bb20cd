"""Source divergence audit: how far the sources of a language differ in their words, by a frequent-pattern tree of term rows.

A term row holds, for one term of a language, every source that uses it, in source order, with the source's probability of the
term. Most of a pair's divergence is the same for all terms that neither source uses; what a term adds beyond that is a
correction of the sources in its row. Rows are inserted into a prefix tree with multiplicities, so a start that many rows share
is one path, and the correction of a (node, ancestor) combination is computed once and counted as often as rows pass the node.
The tree is walked in sorted order, range by range: a task holds one path, never the tree, and a path cut between two ranges is
only counted in two parts. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..streaming.storage import stored

#: Term bytes: letters, A-Z lowered, and all of UTF-8 beyond ASCII; everything else parts terms.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
UNIT = 1_000_000_000


def terms_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(FOLD).split()


def _counted(most: int):
    """(lang, source, text) rows to counts of terms and of documents with them, summed within a task; ``most`` counts are held at once."""

    def flush(held):
        for (lang, source), (uses, docs) in held.items():
            n = len(uses)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(uses), pa.binary()).cast(pa.string()),
                pa.array(list(uses.values()), pa.int64()), pa.array([docs[t] for t in uses], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        seen = 0
        for batch in batches:
            for lang, source, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = terms_of(raw)
                one = set(words)
                uses, docs = held[lang, source]
                uses.update(words)
                docs.update(one)
                seen += len(one)
                if seen > 4 * most and sum(len(u) for u, _ in held.values()) > most:
                    yield from flush(held)
                    held.clear()
                    seen = 0
        yield from flush(held)

    return run


def term_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): uses of each term, and rows that hold it, of ``docs`` (lang, source, text)."""
    raw = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_counted(most), "lang string, source string, term string, n long, docs long")
    return raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 V)), exact; null where the language keeps no term."""
    return F.expr(f"cast(1 + (cast({UNIT} as decimal(10)) * cast({n} + 2 as decimal(20))) div nullif(cast({total} + 2 * v as decimal(20)), 0) as bigint)")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _walk(most: int):
    """Sorted (lang, path, n) rows to (lang, a, b, value): the corrections of every two sources that share rows.

    Rows arrive in path order, so the tree is met depth first: what a new row does not share with the path at hand is finished.
    """

    def corrections(nodes):
        own, counts, above = (np.concatenate(x) for x in zip(*[
            (np.broadcast_to(x, (len(up), 3)), np.full(len(up), n), up) for x, n, up in nodes]))
        (_, p, p0), (_, q, q0) = own.T, above.T
        return above[:, 0], own[:, 0], counts * (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str, str], int] = defaultdict(int)
        names: list[str] = []
        number: dict[str, int] = {}
        lang, path, nodes, waiting = None, [], [], 0  # path: [key, row (source, p, p0), multiplicity] from the root down

        def settle():
            nonlocal waiting
            if nodes:
                a, b, value = corrections(nodes)
                pair, at = np.unique(a * len(names) + b, return_inverse=True)
                sums = np.zeros(len(pair), np.int64)
                np.add.at(sums, at, value)
                for k, v in zip(pair.tolist(), sums.tolist()):
                    totals[lang, names[k // len(names)], names[k % len(names)]] += v
            nodes.clear()
            waiting = 0

        def finish(depth):
            nonlocal waiting
            if len(path) > depth:
                rows = np.array([x for _, x, _ in path], np.int64)
                while len(path) > depth:
                    _, x, n = path.pop()
                    if path:
                        path[-1][2] += n  # rows that pass a node pass its parent
                        nodes.append((rows[len(path)], n, rows[:len(path)]))
                        waiting += len(path)
                if waiting > most:
                    settle()

        for batch in batches:
            for now, row, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != lang:
                    finish(0)
                    settle()
                    lang, names, number = now, [], {}
                shared = 0
                keys = [(x["source"], x["p"]) for x in row]
                while shared < min(len(path), len(keys)) and path[shared][0] == keys[shared]:
                    shared += 1
                finish(shared)
                for key, x in list(zip(keys, row))[shared:]:
                    if key[0] not in number:
                        number[key[0]] = len(names)
                        names.append(key[0])
                    path.append([key, (number[key[0]], x["p"], x["p0"]), 0])
                path[-1][2] += n
        finish(0)
        settle()
        if totals:
            k = list(totals)
            yield pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in k], pa.string()) for i in range(3)], pa.array(list(totals.values()), pa.int64())],
                                             ["lang", "a", "b", "value"])

    return run


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10,
          held: int = 200_000) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its divergence from every other source (``pair``), and the ``top`` terms
    that it uses more than its language does (``term``).

    A language keeps the terms that stand in at least ``least_docs`` of its rows. Nulls are empty text; a row counts as often as it
    occurs; texts may be of any length; a group without terms still gets pairs, zero where its language keeps no term; ties rank
    by item; an empty table gives an empty table; other columns are not read. ``held`` bounds what a task holds.
    """
    clean = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for n, c in (("text", text), ("lang", lang), ("source", source))])
    rows = term_counts(clean, held).groupBy("lang", "term").agg(
        F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
    rows = stored(rows.filter(F.col("docs") >= least_docs).drop("docs"), "term_rows")
    languages = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("t_lang"))
    used = rows.select("lang", "term", "n_lang", F.inline("uses"))
    groups = clean.select("lang", "source").distinct().join(languages, "lang", "left").join(
        used.groupBy("lang", "source").agg(F.sum("n").alias("t")), ["lang", "source"], "left").select(
            "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("t_lang", F.lit(0)).alias("t_lang"))
    groups = stored(groups.withColumn("p0", _share("0", "t")), "groups")
    items = used.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "t").alias("p"), "p0", _share("n_lang", "t_lang").alias("q"))
    items = stored(items, "items")

    terms = items.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    paths = items.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("path"))
    paths = paths.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("n"))
    tree = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(
        _walk(held), "lang string, a string, b string, value long")

    # What a source's own uses add beside any other source's zero, and the start that all pairs share.
    uses = items.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    own = uses.unionByName(groups.select("lang", "source", F.lit(None).cast("long").alias("p"), "p0", F.col("v").alias("n")))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    value = F.when(F.col("p").isNotNull(), F.col("n") * (_apart("p", "q0") - _apart("p0", "q0"))).when(
        F.col("source") < F.col("other"), F.col("n") * _apart("p0", "q0")).otherwise(0)
    single = own.join(other, "lang").filter("source != other").select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), value.alias("value"))
    both = single.unionByName(tree).groupBy("lang", "a", "b").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    pairs = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(
        F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part: part.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
