"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A file is an 8-byte header (``TOKREC``, version, bytes per id) and records, each

    length of the payload, unsigned 64 bit | masked CRC-32 of those 8 bytes | payload | masked CRC-32 of the payload

all little-endian. The payload is the document's id (signed 64 bit, the smallest number for null) and its token ids. A mask is
a rotation by 15 bits plus a constant, so that a checksum stored inside checksummed data does no harm. Each task writes one
file of its range of document ids to a name of its own; only the index, which Spark commits, makes a file part of the set, so
files of lost attempts are never read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

MAGIC = b"TOKREC\x01"
MASK = 0xA282EAD8
NULL_ID = -(1 << 63)
INDEX = "part int, file string, offset long, length long, key long, n_tokens long, at long"
#: A single blank or line break between two other characters always starts a token of its own or the next word's token.
APART = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
#: So does a mark after a letter; letters here are those of Latin-1.
SOLID = re.compile(r" ?\S+")
PLAIN = re.compile(r"[ \n]\s|\s[ \n]")
UNITS = re.compile(r"\n| ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?*#%$&| \n]|\Z)|[.,;:!?*#%$&|]+(?=[ \n]|\Z)| ?[^ \n]+")
#: A worker keeps the units of its last texts: so many, and as many before them.
REMEMBERED = 3 << 16


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record; a wrong length or checksum raises."""
    head = bytes(record[:8])
    (n,), (check,) = struct.unpack("<Q", head), struct.unpack("<I", record[8:12])
    if check != masked(head) or len(record) != n + 16:
        raise ValueError("record length is damaged")
    payload = bytes(record[12:12 + n])
    if struct.unpack("<I", record[12 + n:])[0] != masked(payload):
        raise ValueError("record payload is damaged")
    return payload


def cut(text: str) -> list[str]:
    """Parts of a text whose encodings, one after another, are the encoding of the text."""
    if not text:
        return []
    if text[0] not in " \n" and text[-1] not in " \n" and not PLAIN.search(text):
        return UNITS.findall(text)
    return APART.split(text)


class Encoder:
    """The tokenizers library on the distinct parts of texts; ids as little-endian bytes of ``width``.

    For byte-level pieces split by the usual pattern (words with the blank before them, runs of white space). A text that
    holds an added token (``<|endoftext|>``) goes to the library whole, as a cut may fall inside or beside the token; with
    ``literal`` special tokens in texts are ordinary characters.
    """

    def __init__(self, spec: str, literal: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = literal
        added = [t for t in self.library.get_added_tokens_decoder().values() if t.content and not (literal and t.special)]
        # What is sought in the normalized text, or holds the line break that joins parts, cannot be told from parts.
        every = any("\n" in t.content or t.normalized and self.library.normalizer is not None for t in added)
        self.whole = re.compile("" if every else "|".join(re.escape(t.content) for t in added) or r"(?!)")
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        (self.line,) = self._ids(["\n"])[0]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self.whole.search(t)]
        if whole:
            held = dict(zip(whole, self._ids([texts[i] for i in whole])))
            rest = iter(self._parted([t for i, t in enumerate(texts) if i not in held]))
            return [np.array(held[i], f"<u{self.width}").tobytes() if i in held else next(rest) for i in range(len(texts))]
        return self._parted(texts)

    def _parted(self, texts: list[str]) -> list[bytes]:
        parts = [cut(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = []
        for u in set().union(*parts):
            if u not in self.known:
                if u in self.older:
                    self.known[u] = self.older[u]
                else:
                    new.append(u)
        # Parts without white space inside are encoded many at a time: a line break between two of them is a token of its own.
        plain = [u for u in new if SOLID.fullmatch(u)]
        for i in range(0, len(plain), 256):
            some = plain[i:i + 256]
            ids = np.array(self._ids(["\n".join(some)])[0], f"<u{self.width}")
            cuts = [*(np.flatnonzero(ids == self.line) * self.width).tolist(), ids.nbytes]
            if len(cuts) != len(some):  # a character that only the library takes for white space: these go one by one
                continue
            raw, at = ids.tobytes(), 0
            for unit, cut_at in zip(some, cuts):
                self.known[unit] = raw[at:cut_at]
                at = cut_at + self.width
        rest = [u for u in new if u not in self.known]
        for unit, ids in zip(rest, self._ids(rest) if rest else ()):
            self.known[unit] = np.array(ids, f"<u{self.width}").tobytes()
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


@lru_cache(1)
def encoder(spec: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(spec, literal=False)


def groups(values: list, most: int) -> Iterator[list]:
    """Runs of texts of about ``most`` characters, so that memory follows the texts, not the batch."""
    run, size = [], 0
    for v in values:
        run.append(v)
        size += len(v)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def write(docs: DataFrame, folder: str, spec: str, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """Encode every text, append ``end``, write the records in ascending key order under ``folder``, return the index.

    Ids are the library's own without added special tokens: one that stands in a text is that token. Null texts are empty: one id. Null keys come first; rows of equal keys are ordered by text, all of them stay.
    ``spec`` is the tokenizer's JSON; ``folder`` is any place that Arrow's file systems open and all executors share.
    """

    def run(batches):
        import os

        from pyarrow import fs
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = encoder(spec)
        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        stop, out, place, at = np.array([end], f"<u{tokens.width}").tobytes(), None, 8, 0
        try:
            for batch in batches:
                rows = []
                keys = iter(batch.column(0).to_pylist())
                for some in groups([t or "" for t in batch.column(1).to_pylist()], 1 << 20):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}")
                        out.write(MAGIC + bytes([tokens.width]))
                    for ids in tokens.encode(some):
                        k = next(keys)
                        record = frame(struct.pack("<q", NULL_ID if k is None else k) + ids + stop)
                        out.write(record)
                        n = len(ids) // tokens.width + 1
                        rows.append((part, name, place, len(record), k, n, at))
                        place, at = place + len(record), at + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, (
                        pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                    ["part", "file", "offset", "length", "key", "n_tokens", "at"])
        finally:
            if out is not None:
                out.close()

    spark = docs.sparkSession
    ordered = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    ordered.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index, with ``start``: the number of ids in all records before."""
    rows = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(before, "part").withColumn("start", F.col("base") + F.col("at")).drop("base")


def read(rows: DataFrame, folder: str, raw: bool = False, most: int = 8 << 20) -> DataFrame:
    """Index rows in any order, with ``ids`` read from the files; every checksum is verified.

    ``ids`` is an array, or with ``raw`` the ids as little-endian unsigned 32-bit numbers.
    Neighbouring records come in one read of up to ``most`` bytes; after a shuffle each record is one ranged read.
    """
    names = rows.columns
    at = {n: i for i, n in enumerate(names)}

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        name, source, width = None, None, 0
        for batch in batches:
            files, offsets, lengths, keys = (batch.column(at[n]).to_pylist() for n in ("file", "offset", "length", "key"))
            i = 0
            while i < len(files):
                j, size = i, 0
                while j < len(files) and (j == i or files[j] == files[i] and offsets[j] == offsets[i] + size and size + lengths[j] <= most):
                    size += lengths[j]
                    j += 1
                if files[i] != name:
                    if source is not None:
                        source.close()
                    name, source = files[i], store.open_input_file(f"{root}/{files[i]}")
                    head = source.read_at(8, 0)
                    if head[:7] != MAGIC:
                        raise ValueError(f"{name} is no record file")
                    width = head[7]
                data = memoryview(source.read_at(size, offsets[i]))
                ids, ends, place = [], [0], 0
                for r in range(i, j):
                    payload = unframe(data[place:place + lengths[r]])
                    if struct.unpack("<q", payload[:8])[0] != (NULL_ID if keys[r] is None else keys[r]):
                        raise ValueError("the record is another document's")
                    ids.append(np.frombuffer(payload, f"<u{width}", offset=8).astype("<u4"))
                    ends.append(ends[-1] + len(ids[-1]))
                    place += lengths[r]
                values = pa.array([x.tobytes() for x in ids], pa.binary()) if raw else pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, values], [*names, "ids"])
                i = j

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("ids", T.BinaryType() if raw else T.ArrayType(T.IntegerType()))]))
