"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

A text (blanks as the blank mark, one mark in front) is cut where no piece can reach across: before a blank mark that
follows another character, and around characters that no longer piece holds. In each part, the pairs of neighbouring symbols that form a
piece wait in an agenda; the best score, then the leftmost, is merged and its new neighbours are entered, until none is
left. Symbols without a piece become bytes. A part is worked out once per worker and then remembered.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: A worker keeps the parts of its last texts: so many, and as many before them.
REMEMBERED = 1 << 18


class Model:
    """A merge-type vocabulary with byte fallback and no normalisation; others are refused."""

    def __init__(self, proto: bytes, remembered: int = REMEMBERED):
        self.remembered = remembered
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(proto)
        n = m.normalizer_spec
        kinds = {p.type for p in m.pieces}
        if (m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces
                or not n.add_dummy_prefix or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix
                or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("only merge-type models with byte fallback and identity normalisation are supported")
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.shown = [{NORMAL: p.piece.replace(MARK, " "), UNKNOWN: " ⁇ ", CONTROL: ""}.get(p.type, "") for p in m.pieces]
        self.value = {i: b for b, i in self.bytes.items()}
        for b, i in self.bytes.items():
            if b < 0x80:
                self.shown[i] = chr(b)
        self.high = np.zeros(len(m.pieces), bool)
        self.high[[i for b, i in self.bytes.items() if b >= 0x80]] = True
        self.marked = np.array([p.type == NORMAL and p.piece.startswith(MARK) for p in m.pieces])
        self.silent = np.array([p.type == CONTROL for p in m.pieces])
        longer = set("".join(p for p in self.ids if len(p) > 1))
        inside = any(MARK in p.lstrip(MARK) for p in self.ids)
        #: Where parts begin; without a pattern the whole text is one part.
        self.parts = None
        if not inside:
            alone = "" if "\n" in longer else "\n"
            self.parts = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + f"|{alone}" * bool(alone))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def agenda(self, part: str) -> list[int]:
        """Ids of one part."""
        ids, scores = self.ids, self.scores
        symbols: list[str | None] = list(part)
        n = len(symbols)
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                heap.append((-scores[pair], i, pair))
        if heap:
            heapq.heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                _, i, pair = heapq.heappop(heap)
                j = after[i]
                if symbols[i] is None or j >= n or len(symbols[i]) + len(symbols[j]) != len(pair):
                    continue
                symbols[i], symbols[j] = pair, None
                k, h = after[j], before[i]
                after[i] = k
                if k < n:
                    before[k] = i
                    right = pair + symbols[k]
                    if right in scores:
                        heapq.heappush(heap, (-scores[right], i, right))
                if h >= 0:
                    left = symbols[h] + pair
                    if left in scores:
                        heapq.heappush(heap, (-scores[left], h, left))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                i = ids.get(s)
                if i is None:
                    out.extend(self.bytes[b] for b in s.encode())
                else:
                    out.append(i)
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = MARK + text.replace(" ", MARK)
        parts = [marked] if self.parts is None else self.parts.findall(marked)
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for p in parts:
            if p not in known:
                known[p] = older[p] if p in older else np.array(self.agenda(p), np.int32).tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, parts)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        first = int(np.argmin(self.silent[ids]))  # the first id that shows anything
        skip = 1 if self.marked[ids[first]] else 0
        if not self.high[ids].any():
            return "".join(map(self.shown.__getitem__, ids.tolist()))[skip:]
        out: list[str] = []
        run = bytearray()
        for i in ids.tolist():
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run = bytearray()
            out.append(self.shown[i])
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)[skip:]


@lru_cache(1)
def model_of(proto: bytes, remembered: int = REMEMBERED) -> Model:
    """One model for all tasks of a worker."""
    return Model(proto, remembered)


def _utf8(run: bytes) -> str:
    """Characters of a run of bytes; each byte that belongs to none is a replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i:i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def encoded(text: Column, proto: bytes, decode: bool = True, remembered: int = REMEMBERED) -> Column:
    """Struct of ``ids`` and, on demand, their ``decoded`` text. A null text is empty. A worker remembers up to twice ``remembered`` distinct parts."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(proto, remembered)
        for batch in batches:
            ids = [model.encode(t or "") for t in batch.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            words = pa.array([model.decode(x) for x in ids] if decode else [None] * len(ids), pa.string())
            yield pa.StructArray.from_arrays([lists, words], fields=list(kind))

    return made(text)


def pieces(docs: DataFrame, proto: bytes, text: str = "text", decode: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with one struct column ``pieces`` (``ids``, ``decoded``); a column of that name is replaced.

    Empty and null texts have no ids and decode to the empty text; every row is encoded whole, repeated rows each time.
    """
    return docs.select(*[c for c in docs.columns if c != "pieces"], encoded(docs[text], proto, decode, remembered).alias("pieces"))


def against_library(docs: DataFrame, proto: bytes, text: str = "text") -> DataFrame:
    """Rows whose ids or decoded text differ from the sentencepiece library's, compared in Arrow batches; none is right."""

    @F.arrow_udf("boolean")
    def differs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from sentencepiece import SentencePieceProcessor

        library, model = SentencePieceProcessor(model_proto=proto), Model(proto)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            theirs = library.encode(texts, num_threads=1)
            ours = [model.encode(t) for t in texts]
            back = library.decode(theirs, num_threads=1) if texts else []
            yield pa.array([a.tolist() != b or model.decode(a) != c for a, b, c in zip(ours, theirs, back)])

    return docs.withColumn("_differs", differs(docs[text])).filter("_differs").drop("_differs")
