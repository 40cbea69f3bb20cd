"""Substring dedup: an FM-index per shard, streamed segments, repeated windows removed from all but the smallest document.

A window is ``length`` consecutive words. Each window has an anchor: of its 8-word runs the one with the least hash, the
leftmost of equals. Equal windows have equal anchors, so windows meet in the shard of their anchor. Consecutive windows of one
document with one anchor form a segment of fewer than twice ``length`` words. Only anchors that occur in more than one document
count; documents with the same words are one. Equal segments are one as well. Shards are whole anchors up to ``shard_words``; each
is indexed, and its segments are searched in it. The windows of an anchor in more than ``hot`` documents are dealt each to a
shard of its own words instead, so a passage of very many documents is spread and each of its windows is held once.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..streaming.storage import stored
from .fm_index import FMIndex

RUN = 8
HOT = 1024
SHARD_WORDS = 1 << 19


class _Hashes(dict):
    """Hashes of words; forgets them beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


def anchors(words: list[bytes], length: int, hashes: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each run of windows with one anchor."""
    n = len(words)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    run = min(RUN, length)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    m = n - run + 1
    g = w[:m].copy()
    for j in range(1, run):
        g = g * np.uint64(0x9E3779B97F4A7C15) + w[j:j + m]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    order = np.argsort(g, kind="stable")
    in_order = g[order]
    rank = np.empty(m, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
    least, span, width = rank * m + np.arange(m), 1, length - run + 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    place = least % m
    starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    return g[place[starts]].view(np.int64), starts, np.concatenate([starts[1:], [len(place)]]) - 1


def _scan(length: int):
    kinds = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("whole", pa.binary()), ("runs", pa.list_(pa.struct(
        [("anchor", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])))])

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            n, whole, ends, parts = [], [], [0], []
            for raw in batch.column(1).to_pylist():
                words = (raw or b"").split()
                a = anchors(words, length, hashes)
                n.append(len(words))
                whole.append(hashlib.sha256(b" ".join(words)).digest())
                parts.append(a)
                ends.append(ends[-1] + len(a[0]))
            flat = [np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(3)]
            runs = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32))],
                                              fields=list(kinds.field("runs").type.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)],
                schema=kinds)

    return run


def _segments(length: int):
    """Candidate documents to segments: shard key, digest of the words, words, first window, whether it is a single window."""

    def run(batches):
        from xxhash import xxh3_128_digest, xxh64_intdigest

        names = ["key", "whole", "first", "shard", "digest", "words", "single"]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
        for batch in batches:
            for key, whole, raw, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = (raw or b"").split()
                if hashlib.sha256(b" ".join(words)).digest() != whole:
                    continue  # another text under the same key
                rows = []
                for r in runs:
                    if r["hot"]:
                        for i in range(r["first"], r["last"] + 1):
                            part = b" ".join(words[i:i + length])
                            h = xxh64_intdigest(part)
                            rows.append((key, whole, i, h - (1 << 64) * (h >> 63), xxh3_128_digest(part), part, True))
                    else:
                        part = b" ".join(words[r["first"]:r["last"] + length])
                        rows.append((key, whole, r["first"], r["anchor"], xxh3_128_digest(part), part, False))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def search_shard(sequences: list[list], values: np.ndarray, length: int) -> list[np.ndarray]:
    """Index the sequences and stream them through: the least value that holds each window."""
    return FMIndex(sequences, values, length).statistics(sequences)


def _index(length: int, shard_words: int):
    """Rows sorted by shard key: whole keys are gathered to a shard, indexed, and searched."""

    def finish(rows):
        words = [w.split(b" ") for _, w, _ in rows]
        least = search_shard(words, np.array([k for _, _, k in rows], np.int64), length)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in least])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _, _ in rows], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(least)))],
            ["digest", "least"])

    def run(batches):
        rows, size, before = [], 0, None
        for batch in batches:
            for shard, digest, words, key in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= shard_words and shard != before:
                    yield finish(rows)
                    rows, size = [], 0
                rows.append((digest, words, key))
                size, before = size + words.count(b" ") + 2, shard
        if rows:
            yield finish(rows)

    return run


def _remove(length: int):
    """Candidate documents and their repeated windows to what is left of them."""

    def run(batches):
        for batch in batches:
            keys, wholes, n, shas = [], [], [], []
            for key, whole, raw, starts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = (raw or b"").split()
                if hashlib.sha256(b" ".join(words)).digest() != whole:
                    continue
                marks = np.zeros(len(words) + 1, np.int32)
                at = np.unique(np.array(starts, np.int64))
                np.add.at(marks, at, 1)
                np.add.at(marks, at + length, -1)
                gone = np.cumsum(marks)[:-1] > 0
                keys.append(key)
                wholes.append(whole)
                n.append(int(gone.sum()))
                shas.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(wholes, pa.binary()), pa.array(n, pa.int64()), pa.array(shas, pa.binary())],
                ["key", "whole", "n_removed", "kept"])

    return run


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, hot: int = HOT,
                     shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, candidates, windows): all documents with their words counted, the texts that share an anchor, and the
    windows (key, whole, starts) that also start in a document with a smaller key."""
    pairs = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("binary").alias("raw"))
    scan = stored(pairs.mapInArrow(
        _scan(length), "key long, n_words long, whole binary, runs array<struct<anchor:long,first:int,last:int>>"), "scan")
    first = scan.filter("key is not null").groupBy("whole").agg(F.min("key").alias("least"))
    scanned = stored(scan.join(first, "whole", "left"), "scanned")
    runs = scanned.filter("key = least").select("key", "whole", F.explode("runs").alias("r")).select(
        "key", "whole", "r.anchor", "r.first", "r.last")
    shared = stored(runs.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("n")).filter(
        "a < b").select("anchor", (F.col("n") > hot).alias("hot")), "shared")
    lists = runs.join(shared, "anchor").groupBy("key", "whole").agg(F.collect_list(F.struct("anchor", "first", "last", "hot")).alias("runs"))
    candidates = stored(pairs.join(lists, "key").select("key", "whole", "raw", "runs"), "candidates")
    segments = stored(candidates.mapInArrow(
        _segments(length), "key long, whole binary, first int, shard long, digest binary, words binary, single boolean"), "segments")
    contents = segments.groupBy("shard", "digest").agg(
        F.min("key").alias("key"), F.max("key").alias("most"), F.first("words").alias("words"), F.first("single").alias("single"))
    contents = contents.filter("not single or key < most").select("shard", "digest", "words", "key")
    found = stored(contents.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _index(length, shard_words), "digest binary, least array<long>"), "found")
    hits = segments.select("key", "whole", "first", "digest").join(found, "digest")
    earlier = F.filter(F.transform("least", lambda v, i: F.when(v < F.col("key"), F.col("first") + i)), lambda s: s.isNotNull())
    windows = hits.select("key", "whole", earlier.alias("s")).filter("size(s) > 0").groupBy("key", "whole").agg(
        F.flatten(F.collect_list("s")).alias("starts"))
    return scanned, candidates, windows


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, **options) -> DataFrame:
    """(key, n_words, n_removed, kept) per row of ``docs``; ``kept`` holds the digest of the words that stay.

    A word goes if a window that covers it also starts in a document with a smaller key. Documents with fewer words than a
    window, null texts among them, lose nothing; a null key neither loses words nor makes others lose them; rows that
    repeat a key are one document, each judged by its own text.
    """
    scanned, candidates, windows = repeated_windows(docs, key, text, length, **options)
    left = candidates.select("key", "whole", "raw").join(windows, ["key", "whole"]).mapInArrow(
        _remove(length), "key long, whole binary, n_removed long, kept binary").dropDuplicates(["key", "whole"])
    copy = (F.col("least") < F.col("key")) & (F.col("n_words") >= length)
    rest = scanned.drop("runs").join(left, ["key", "whole"], "left")
    return rest.select(
        "key", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(F.col("n_removed").isNotNull(), F.sha2("kept", 256)).otherwise(
            F.lower(F.hex("whole"))).alias("kept_sha256"))
