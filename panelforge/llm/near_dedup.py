"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, Hamming distance verified, linked texts as components.

A fingerprint has 64 bits in ``BLOCKS`` blocks. Two fingerprints that differ in at most ``distance`` bits agree in at
least ``BLOCKS - distance`` blocks, so each fingerprint is dealt out once for every choice of that many blocks. Equal
fingerprints are one node before any of this. Rows that share blocks arrive sorted and next to each other; each such
bucket gives a spanning forest of its verified links, never all pairs. A bucket beyond ``bucket`` fingerprints is not held: its
members are linked exactly through all fingerprints at half the distance (two are linked if and only if they share one).

``similar`` links texts by the Jaccard similarity of their shingle sets instead: MinHash bands, then the whole sets. ``near_copies`` joins both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..streaming.storage import stored
from .batches import small_batches

SEED = 42
BLOCKS = 7


def shingle_hashes(raw: bytes | None, size: int = 4) -> np.ndarray:
    """XXH64 of every shingle of a text: words without ASCII white space, A-Z lowered, joined by spaces."""
    from xxhash import xxh64_intdigest

    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    cuts = map(slice, starts[:n].tolist(), ends[size - 1:].tolist())
    return np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED, n)), np.uint64, n)


def simhash(raw: bytes | None, size: int = 4) -> int:
    """The fingerprint of a text as a signed 64-bit number; zero without words."""
    h = shingle_hashes(raw, size)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at:at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprint(text: Column, size: int = 4) -> Column:
    @F.arrow_udf("long")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([simhash(x, size) for x in batch.to_pylist()], pa.int64())

    return made(text.cast("binary"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def block_masks(distance: int, blocks: int = BLOCKS) -> list[int]:
    """One mask for each choice of blocks that must agree."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) - (1 << 64) * (sum(c) >> 63) for c in combinations(parts, blocks - distance)]


def forest(members: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected among distinct fingerprints; each member but one of a component is reached once."""
    left, a, b = members, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                hit, left = left[near], left[~near]
                a.append(np.full(len(hit), x))
                b.append(hit)
                queue.extend(hit)
    return a, b


def _link(distance: int, bucket: int):
    """Sorted (table, key, fp) rows to links (u, v); members of a bucket that is too large come as (u, null)."""

    def emit(pairs, alone):
        u = np.concatenate([p[0] for p in pairs] + alone)
        v = np.concatenate([p[1] for p in pairs])
        second = pa.concat_arrays([pa.array(v.view(np.int64), pa.int64()), pa.nulls(len(u) - len(v), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64), pa.int64()), second], ["u", "v"])

    def run(batches):
        rest = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        spilled = None  # key of a bucket whose first members have been passed on

        def work(t, k, f, last):
            nonlocal rest, spilled
            pairs, alone = [], []
            new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(t)]])
            large = ends - starts > bucket
            large[0] |= spilled == (t[0], k[0])
            if not last:  # the last bucket may go on in the next batch
                at = starts[-1]
                spilled = (t[at], k[at]) if large[-1] else None
                rest = tuple(x[at:at if large[-1] else len(t)] for x in (t, k, f))
                if not large[-1]:
                    starts, ends, large = starts[:-1], ends[:-1], large[:-1]
            alone = [f[s:e] for s, e in zip(starts[large], ends[large])]
            starts, ends = starts[~large], ends[~large]
            two = starts[ends - starts == 2]
            ok = np.bitwise_count(f[two] ^ f[two + 1]) <= distance
            pairs.append((f[two][ok], f[two + 1][ok]))
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                pairs.extend(zip(*forest(f[s:e], distance)))
            return emit(pairs, alone)

        for batch in batches:
            t, k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if len(t):
                yield work(*(np.concatenate(x) for x in zip(rest, (t, k, f.view(np.uint64)))), False)
        if len(rest[0]):
            yield work(*rest, True)

    return run


def _halfway(distance: int):
    """Each fingerprint with every fingerprint at half the distance at most."""
    reach = [0]
    for n in range(1, distance // 2 + 1):
        reach += [sum(1 << i for i in c) for c in combinations(range(64), n)]
    flips = np.array(reach, np.uint64)

    def run(batches):
        for batch in batches:
            for x in batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((flips ^ x).view(np.int64)), pa.array(np.full(len(flips), x).view(np.int64))], ["m", "u"])

    return run


def links(fps: DataFrame, distance: int = 4, bucket: int = 4096) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``): a spanning set of all pairs within ``distance``, even."""
    masks = block_masks(distance)
    dealt = fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "k"), "fp")
    dealt = dealt.repartition("t", "k").sortWithinPartitions("t", "k")
    found = stored(dealt.mapInArrow(_link(distance, bucket), "u long, v long"), "links")
    close = found.filter("v is not null").distinct()
    dense = found.filter("v is null").select("u").distinct()
    if dense.isEmpty():
        return close
    near = stored(dense.mapInArrow(_halfway(distance), "m long, u long"), "halfway")
    centre = near.groupBy("m").agg(F.min("u").alias("v"))
    return close.unionByName(near.join(centre, "m").filter("u != v").select("u", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of edges and sum of their hashes: equal for equal sets."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); the root is the smallest node that can be reached.

    Large and small stars in turn, each one aggregation and one join per round, stored, until nothing moves.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = _state(now)
    while True:
        sides = both(now)
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "stars")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        new = stored(small, "stars")
        if _state(new) == before:
            break
        now, before = new, _state(new)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, size: int = 4, bucket: int = 4096,
            carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, fp, root, component): each row's fingerprint, the smallest one of its component and the component's smallest key.

    Documents without words, null texts among them, have fingerprint zero and are linked like any other. A repeated row
    comes out again; a null key is no smallest key unless all of a component's are null; texts may be of any length. Columns named in
    ``carry`` come along, others are not read.
    """
    marked = stored(docs.select(docs[key].alias("key"), *carry, fingerprint(docs[text], size).alias("fp")), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    tied = components(links(nodes.select("fp"), distance, bucket)).withColumnRenamed("node", "fp")
    rooted = stored(nodes.join(tied, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(smallest, "root").select("fp", "root", "component")
    return marked.join(named, "fp").select("key", *carry, "fp", "root", "component")


def set_marks(bands: int, rows: int, size: int):
    """Of each text, the 128-bit name of its set of shingles, the set's size, one byte of each MinHash, and one key for each band of ``rows`` of them.

    Texts without words have neither bytes nor keys.
    """
    r = np.random.default_rng(SEED)
    flip, times, mix = (r.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1) for n in (bands * rows, bands * rows, bands * rows))
    flip, times, mix = flip[:, None], times[:, None], mix.reshape(bands, rows)

    @F.arrow_udf("struct<node: binary, size: long, bytes: binary, bands: array<long>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            nodes, sizes, marks, keys = [], [], [], []
            for raw in batch:
                h = np.unique(shingle_hashes(raw.as_py(), size))
                nodes.append(xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                least = np.full(bands * rows, ~np.uint64(0))
                for at in range(0, len(h), 512):
                    np.minimum(least, ((h[at:at + 512] ^ flip) * times).min(axis=1), out=least)
                marks.append((least >> np.uint64(56)).astype(np.uint8).tobytes() if len(h) else b"")
                key = (least.reshape(bands, rows) * mix).sum(axis=1, dtype=np.uint64)
                keys.append((key ^ key >> np.uint64(32)).view(np.int64) if len(h) else np.zeros(0, np.int64))
            yield pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                               ["node", "size", "bytes", "bands"])

    return made


def shingle_sets(text: Column, size: int) -> Column:
    """Struct of a text's set name and its distinct shingle hashes in ascending order."""

    @F.arrow_udf("struct<node: binary, set: array<long>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [np.unique(shingle_hashes(raw.as_py(), size)) for raw in batch]
            nodes = pa.array([xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            yield pa.StructArray.from_arrays([nodes, pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["node", "set"])

    return made(text.cast("binary"))


def set_forest(sets: list[np.ndarray], roots: list[bytes], least: float) -> list[tuple[int, int]]:
    """Links between sets with a Jaccard similarity of at least ``least`` that connect what they can connect; ``roots`` tell what is connected already.

    Each set outside the largest component is compared with every set that is not yet in its own, if their sizes allow the similarity.
    """
    by_size = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in by_size]
    own = np.unique([roots[i] for i in by_size], return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    largest = np.bincount(own).argmax()
    out = []
    for i in np.flatnonzero(own != largest):
        low, high = np.searchsorted(sizes, least * sizes[i]), np.searchsorted(sizes, sizes[i] / least, "right")
        if not sizes[i] or (own[low:high] == own[i]).all():
            continue
        part = slice(starts[low], starts[high])
        at = np.minimum(np.searchsorted(sets[i], every[part]), sizes[i] - 1)
        both = np.bincount(owner[part][sets[i][at] == every[part]] - low, minlength=high - low)
        near = both / (sizes[low:high] + sizes[i] - both) >= least
        for j in low + np.flatnonzero(near & (own[low:high] != own[i])):
            if own[j] != own[i]:
                out.append((by_size[i], by_size[j]))
                own[own == own[j]] = own[i]
    return out


def _verified(least: float):
    """Sorted (hub, part, u, set) rows, a hub's own set first (without u), to its links (u, v): one hub is held at a time."""

    def run(batches):
        hub, held = None, None
        for batch in batches:
            us, vs = [], []
            for v, u, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                own = x.values.to_numpy().view(np.uint64)
                if u is None:
                    hub, held = v, own.copy()
                elif v == hub and len(own) and min(len(own), len(held)) >= least * max(len(own), len(held)):
                    both = len(np.intersect1d(held, own, assume_unique=True))
                    if both / (len(held) + len(own) - both) >= least:
                        us.append(u)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    return run


def _searched(least: float):
    """Sorted (k, i, j, node, root, set) rows to links (u, v) within each (k, i, j), held one at a time."""

    def emit(nodes, roots, sets):
        found = set_forest(sets, roots, least)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x[s]] for x in found], pa.binary()) for s in (0, 1)], ["u", "v"])

    def run(batches):
        key, rows = None, ([], [], [])
        for batch in batches:
            for k, i, j, node, root, x in zip(*(batch.column(c).to_pylist() for c in range(5)), batch.column(5)):
                if (k, i, j) != key:
                    if rows[0]:
                        yield emit(*rows)
                    key, rows = (k, i, j), ([], [], [])
                for held, value in zip(rows, (node, root, x.values.to_numpy().view(np.uint64).copy())):
                    held.append(value)
        if rows[0]:
            yield emit(*rows)

    return run


def _alike(slack: float):
    """(u, v, bytes of u, bytes of v) rows to the pairs (u, v) whose bytes agree often enough."""

    def run(batches):
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(batch), -1) for i in (2, 3))
                yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(axis=1) >= slack))

    return run


def _apart(slack: float):
    """Sorted (k, i, j, node, root, bytes) rows to the rows (k, node, root) that agree often enough with one of another root, per (k, i, j)."""

    def emit(key, nodes, roots, marks):
        own = np.unique(roots, return_inverse=True)[1]
        m = np.frombuffer(b"".join(marks), np.uint8).reshape(len(nodes), -1)
        largest = np.bincount(own).argmax()
        hit = np.zeros(len(nodes), bool)
        for x in np.flatnonzero(own != largest):
            near = (own != own[x]) & ((m == m[x]).mean(axis=1) >= slack)
            if near.any():
                hit |= near
                hit[x] = True
        at = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), pa.int64()), *[pa.array([x[i] for i in at], pa.binary()) for x in (nodes, roots)]], ["k", "node", "root"])

    def run(batches):
        key, rows = None, ([], [], [])
        for batch in batches:
            for k, i, j, *values in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if (k, i, j) != key:
                    if rows[0]:
                        yield emit(key, *rows)
                    key, rows = (k, i, j), ([], [], [])
                for held, value in zip(rows, values):
                    held.append(value)
        if rows[0]:
            yield emit(key, *rows)

    return run


def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` (k, node, ...) dealt by node over the ``blocks`` of their bucket, every two blocks (i, j) together."""
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, "k").withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("b", "o", "blocks")


#: Nodes that are asked for are sent to every task up to this many (eight bytes each), else joined.
SENT = 1 << 20


def _sets_of(texts: DataFrame, nodes: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(node, set) of the nodes ``asked``: only one text of each is cut into shingles."""
    which = stored(nodes.join(asked, "node", "left_semi").select("hash").distinct(), "asked")
    which = F.broadcast(which) if which.count() <= SENT else which
    found = texts.join(which, "hash", "left_semi").select(shingle_sets(F.col("text"), size).alias("m")).select("m.*")
    with small_batches(texts.sparkSession):
        return stored(found.groupBy("node").agg(F.first("set").alias("set")).join(asked, "node", "left_semi"), "sets")


def set_links(marks: DataFrame, facts: DataFrame, sets_of, least: float, held: int = 1 << 21, parts: int = 64) -> DataFrame:
    """Links (u, v) between nodes of ``marks`` (k, node), whose ``facts`` are (node, size, bytes), that connect every pair of one bucket k with Jaccard of at least ``least``.

    Each member of a bucket is first compared with the bucket's smallest, and where buckets stay open their members with each other.
    Either way bytes of the MinHashes come first: pairs that agree in less than ``least`` by five standard errors go. Only for the
    others ``sets_of`` (a function of nodes) brings whole sets, which decide. A smallest's set is sent once for each of ``parts`` its members are
    dealt over, theirs once a pair. Open buckets, each distinct list of members once, are dealt in blocks of about ``held`` bytes or
    hashes, every two blocks together, so a task holds two blocks of one bucket whatever its size.
    """
    width = facts.agg(F.max(F.octet_length("bytes"))).first()[0] or 1
    slack = least - 5 * (least * (1 - least) / width) ** 0.5
    spark = marks.sparkSession
    least_of = marks.groupBy("k").agg(F.min("node").alias("v"))
    side = lambda n: facts.select(F.col("node").alias(n), F.col("bytes").alias(f"b{n}"))
    pairs = marks.join(least_of, "k").filter("node != v").select(F.col("node").alias("u"), "v").distinct()
    near = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "bu", "bv").mapInArrow(_alike(slack), "u binary, v binary")
    pairs = stored(near.withColumn("part", F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int")), "candidates")
    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    hubs = pairs.select(F.col("v").alias("node"), "part").distinct().join(sets, "node").select(F.col("node").alias("v"), "part", F.lit(None).cast("binary").alias("u"), "set")
    members = pairs.join(sets.withColumnRenamed("node", "u"), "u").select("v", "part", "u", "set")
    dealt = hubs.unionByName(members).repartition("v", "part").sortWithinPartitions("v", "part", F.asc_nulls_first("u"))
    with small_batches(spark):
        first = stored(dealt.mapInArrow(_verified(least), "u binary, v binary"), "near")

    tied = components(first)
    h = F.xxhash64("node")
    rooted = marks.join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    opened = rooted.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")).filter("n > 2 and low != high")
    blocks = opened.groupBy("n", "x", "s").agg(F.min("k").alias("k")).select("k", F.ceil(F.col("n") * width / held).cast("int").alias("blocks"))
    rows = _in_blocks(rooted.select("k", "node", "root"), stored(blocks, "open")).join(facts.select("node", "bytes"), "node").select("k", "i", "j", "node", "root", "bytes")
    rows = rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    hit = stored(rows.mapInArrow(_apart(slack), "k long, node binary, root binary"), "open").distinct()
    if hit.isEmpty():
        return first
    hit = stored(hit.join(facts.select("node", "size"), "node"), "hit")
    sets = sets_of(hit.select("node").distinct())
    blocks = hit.groupBy("k").agg(F.ceil(F.sum("size") / held).cast("int").alias("blocks"))
    rest = _in_blocks(hit.select("k", "node", "root"), blocks).join(sets, "node").select("k", "i", "j", "node", "root", "set")
    found = rest.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(_searched(least), "u binary, v binary")
    with small_batches(spark):
        return first.unionByName(stored(found, "near"))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, size: int = 5, bands: int = 40, rows: int = 5,
            held: int = 1 << 21, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, node, root, component): each row's set of ``size``-word shingles by name, the smallest of its component and that component's smallest key.

    Two documents are linked if the Jaccard similarity of their sets is at least ``least``; every link is verified on the whole
    sets. Candidates agree in one of ``bands`` bands of ``rows`` MinHashes: at a similarity of 0.8 a pair is missed once in eight
    million, above it less often. Texts of equal sets are one node, those without words among them. Null keys are as in ``classes``;
    texts may be of any length.
    """
    texts = docs.select(docs[key].alias("key"), *carry, docs[text].alias("text"), F.xxhash64(docs[text]).alias("hash"))
    found = set_marks(bands, rows, size)(F.col("text").cast("binary"))
    with small_batches(docs.sparkSession):
        marked = stored(texts.select("key", *carry, "hash", found.alias("m")).select("key", *carry, "hash", "m.*"), "marks")
    nodes = stored(marked.groupBy("node").agg(F.min("key").alias("least"), *[F.first(c).alias(c) for c in ("hash", "size", "bytes", "bands")]), "nodes")
    dealt = nodes.select("node", F.explode("bands").alias("k"))
    shared = nodes.select(F.explode("bands").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    marks = stored(dealt.join(stored(shared, "buckets"), "k", "left_semi"), "marks")
    tied = components(set_links(marks, nodes.select("node", "size", "bytes"), lambda asked: _sets_of(texts, nodes, asked, size), least, held))
    rooted = stored(nodes.join(tied, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "root", "component")
    return marked.join(named, "node").select("key", *carry, "node", "root", "component")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("name",)) -> DataFrame:
    """(key, name, root): rows linked by their SimHash fingerprints as ``classes`` does, or by the Jaccard similarity of their sets as ``similar``
    does, directly or through others. ``carry`` names one column that tells the rows apart.

    Only fingerprint components that hold several components of sets link anything more.
    """
    name = carry[0]
    alike = similar(docs, key, text, carry=carry).select("key", name, F.col("root").alias("v"))
    close = classes(docs, key, text, carry=carry).select(name, F.col("root").alias("fp")).distinct()
    pairs = stored(alike.select(name, "v").distinct().join(close, name).select("fp", "v").distinct(), "pairs")
    several = pairs.groupBy("fp").agg(F.min("v").alias("u"), F.max("v").alias("last")).filter("u != last").select("fp", "u")
    tied = components(pairs.join(several, "fp").filter("u != v").select("u", "v"))
    return alike.join(tied.select(F.col("node").alias("v"), "root"), "v", "left").select("key", name, F.coalesce("root", "v").alias("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", find=classes, **options) -> DataFrame:
    """One document of every component that ``find`` tells, with the columns of ``docs``: the one with the smallest key.

    Rows of equal key and text are one document. Of a component's rows with the smallest key but different texts the one of the smallest
    digest stays; a component without keys keeps its row of the smallest digest, and a null key beside others goes.
    """
    name = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), docs[key].cast("string")), F.lit("-")), F.lit("\n"), F.coalesce(docs[text], F.lit(""))).cast("binary")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), name.alias("name"))
    found = find(rows.select(F.col("doc")[key].alias("key"), F.col("doc")[text].alias("text"), "name"), "key", "text", carry=("name",), **options)
    first = F.min(F.struct(F.col("key").isNull(), "key", "name"))
    stay = stored(found.groupBy("root").agg(first.alias("s")).select("s.name"), "stay")
    return rows.join(stay, "name", "left_semi").dropDuplicates(["name"]).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
