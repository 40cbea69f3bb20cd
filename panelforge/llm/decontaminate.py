"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, one scan of each text.

Texts and items are normalised byte for byte (A-Z lowered, everything that is not a word byte a space), so a place in the
normalised text is the same place in the original. The automaton holds each distinct window once, between spaces, and finds
all occurrences in one pass. Its patterns are sent to the executors only up to ``most_bytes`` of items. A larger benchmark stays a
table: windows of items and of documents go by their 128-bit names and meet in an equi-join, so neither the driver nor a task holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..streaming.storage import stored

#: Word bytes: digits, letters and all of UTF-8 beyond ASCII.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
KIND = "struct<n_words:long,n_hit:long,items:array<long>,spans:array<struct<start:long,end:long>>>"


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(FOLD).split()


def windows(words: list[bytes], size: int) -> set[bytes]:
    """The distinct windows of an item; a shorter item is one window."""
    if not words:
        return set()
    return {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def build(items: list[tuple[int | None, bytes | None]], size: int):
    """Automaton with, for each window, its number of words and its items (those with an id); None without windows."""
    from ahocorasick import Automaton

    owners: dict[bytes, set[int]] = {}
    for item, raw in items:
        for w in windows(words_of(raw), size):
            owners.setdefault(w, set()).update([] if item is None else [item])
    if not owners:
        return None
    a = Automaton()
    for w, ids in owners.items():
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, frozenset(ids)))
    a.make_automaton()
    return a


def described(raw: bytes | None, words: list[bytes], marks: list[tuple[int, int]]) -> tuple[int, list[dict]]:
    """Number of hit words and hit spans (code points of the original); ``marks`` are (first word, number of words)."""
    if not marks:
        return 0, []
    edges = np.zeros(len(words) + 1, np.int32)
    at, n = np.array(marks).T
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    hit = np.cumsum(edges)[:-1] > 0
    folded = np.frombuffer(raw.translate(FOLD), np.uint8)
    inside = np.concatenate([[False], folded != 0x20, [False]])
    starts, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return int(hit.sum()), [{"start": int(points[starts[i]]), "end": int(points[stops[j - 1]])}
                            for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def scan(raw: bytes | None, automaton) -> dict:
    """Words, hit words, items and hit spans (code points of the original) of one text."""
    words = words_of(raw)
    ids: set[int] = set()
    marks: list[tuple[int, int]] = []
    if automaton is not None and words:
        ends = None
        for last, (n, own) in automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
            if ends is None:
                ends = np.cumsum([len(w) + 1 for w in words])  # place of the space after each word
            at = int(np.searchsorted(ends, last))
            marks.append((at - n + 1, n))
            ids |= own
    n_hit, spans = described(raw, words, marks)
    return {"n_words": len(words), "n_hit": n_hit, "items": sorted(ids), "spans": spans}


ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _finder(items: list[tuple[int | None, bytes | None]], size: int):
    """Arrow function of a text column; a task builds the automaton once."""

    @F.arrow_udf(KIND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = build(items, size)
        for batch in batches:
            yield pa.array([scan(x, automaton) for x in batch.to_pylist()], ARROW)

    return found


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  size: int = 10, most_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with one struct column ``hits``: words, hit words, items found (ascending), hit spans in code points.

    Null texts and texts without words have no hits; texts may be of any length; items without words match nothing; a null item id
    matches but is not listed; repeated rows are judged each by itself. All columns of ``docs`` stay; only the name ``hits`` is replaced.
    """
    tests = benchmark.select(benchmark[item].cast("long").alias("i"), benchmark[item_text].cast("binary").alias("t"))
    kept = [c for c in docs.columns if c != "hits"]
    if (tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > most_bytes:
        return _joined(docs.select(*kept), tests, text, size)
    rows = [(r.i, bytes(r.t or b"")) for r in tests.toLocalIterator()]  # at most ``most_bytes``
    return docs.select(*kept, _finder(rows, size)(docs[text].cast("binary")).alias("hits"))


def _names(lengths: list[int] | None, size: int):
    """(id, text) rows to (id, at, n, w): the names of a text's windows, of an item's own length or of every one of ``lengths``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(raw.as_py())
                for n in ([min(size, len(words))] if lengths is None else [x for x in lengths if x <= len(words)]) if words else []:
                    at = np.arange(len(words) - n + 1)
                    names = [xxh3_128_digest(b" ".join(words[j:j + n])) for j in at]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(np.full(len(at), n), pa.int32()), pa.array(names, pa.binary())],
                        ["id", "at", "n", "w"])

    return run


def _joined(docs: DataFrame, tests: DataFrame, text: str, size: int) -> DataFrame:
    """``contamination`` by an equi-join on window names."""
    shape = "id long, at long, n int, w binary"
    wide = stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[text].cast("binary").alias("t"),
                              F.monotonically_increasing_id().alias("id")), "documents")
    items = stored(tests.select("i", "t").mapInArrow(_names(None, size), shape).select(F.col("id").alias("i"), "n", "w").distinct(), "windows")
    lengths = [r.n for r in items.select("n").distinct().collect()]  # at most ``size`` numbers
    found = wide.select("id", "t").mapInArrow(_names(sorted(lengths), size), shape).join(items.select("n", "w").distinct(), ["n", "w"], "left_semi")
    found = stored(found, "hits")
    marks = found.groupBy("id").agg(F.collect_list(F.struct("at", F.col("n").cast("long").alias("n"))).alias("marks"))  # a document's words at most
    owners = found.select("id", "n", "w").distinct().join(items.filter("i IS NOT NULL"), ["n", "w"]).groupBy("id").agg(F.sort_array(F.collect_set("i")).alias("items"))

    @F.arrow_udf(KIND)
    def told(raws: pa.Array, placed: pa.Array, ids: pa.Array) -> pa.Array:
        out = []
        for raw, m, own in zip(raws.to_pylist(), placed.to_pylist(), ids.to_pylist()):
            words = words_of(raw)
            n_hit, spans = described(raw, words, [(x["at"], x["n"]) for x in m or []])
            out.append({"n_words": len(words), "n_hit": n_hit, "items": own or [], "spans": spans})
        return pa.array(out, ARROW)

    done = wide.join(marks, "id", "left").join(owners, "id", "left")
    return done.select(*[F.col("doc")[c].alias(c) for c in docs.columns], told("t", "marks", "items").alias("hits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a hit, with the columns of ``docs``."""
    held = docs.withColumnRenamed("hits", "_held")
    return contamination(held, benchmark, text, **options).filter("hits.n_hit = 0").drop("hits").withColumnRenamed(
        "_held", "hits").select(*docs.columns)
