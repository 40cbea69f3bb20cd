"""Sharding by extendible hashing: a directory over hash-prefix bits, in which only oversized buckets split on another bit.

The hash of a row is the first 60 bits of the MD5 of its key as text, so any engine finds the same shard. Rows are summed per
hash once; each level then needs only the sums of buckets that are still too large, and their rows alone go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..streaming.storage import stored

BITS = 60


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth) -> Column:
    return F.shiftright(h, BITS - depth) if isinstance(depth, int) else F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def leaves(sums: DataFrame, limit: int) -> DataFrame:
    """Buckets (prefix, depth, rows, bytes) from sums per hash (h, n, size): split while larger than ``limit``.

    A bucket of one hash value cannot be split by its bits and stays, marked ``full``.
    """
    open_, done, depth = sums, None, 0
    while True:
        level = open_.groupBy(prefix(F.col("h"), depth).alias("prefix")).agg(
            F.sum("n").alias("rows"), F.sum("size").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
        level = stored(level.withColumns({"depth": F.lit(depth), "full": (F.col("bytes") > limit) & (F.col("low") == F.col("high"))}), "level")
        fits = (F.col("bytes") <= limit) | F.col("full")
        settled = level.filter(fits).drop("low", "high")
        done = settled if done is None else done.unionByName(settled)
        if level.filter(~fits).isEmpty():
            return stored(done, "leaves")
        depth += 1
        split = level.filter(~fits).select(F.col("prefix").alias("p"))
        open_ = stored(open_.withColumn("p", prefix(F.col("h"), depth - 1)).join(split, "p", "left_semi").drop("p"), "open")


def directory(buckets: DataFrame) -> DataFrame:
    """The directory: one slot for each value of the deepest prefix, with the bucket it points to."""
    deepest = buckets.agg(F.max("depth")).first()[0] or 0
    free = (F.lit(deepest) - F.col("depth")).cast("int")
    first = F.call_function("shiftleft", F.col("prefix"), free)
    return buckets.withColumn("slot", F.explode(F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), free) - 1))).withColumn(
        "bits", F.lit(deepest))


def assign(docs: DataFrame, limit: int, key: str = "doc_id", size: str = "text") -> DataFrame:
    """``docs`` with the struct ``shard``: ``name``, ``depth``, ``rows``, ``bytes``.

    A shard holds at most ``limit`` bytes (of the column ``size``, null is 0), except that a single row may be larger.
    Rows of one key that together exceed it cannot be told apart by bits: they fill numbered pages of at most ``limit``
    bytes, each input partition its own. All columns stay; only ``shard`` is replaced; an empty table has no shards.
    """
    own = [c for c in docs.columns if c != "shard"]
    h, n = key_hash(docs[key]), F.coalesce(F.octet_length(docs[size].cast("binary")), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("_doc"), h.alias("_h"), n.alias("_n"))
    buckets = leaves(stored(rows.groupBy(F.col("_h").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("size")), "sums"), limit)
    slots = stored(directory(buckets), "directory")
    bits = (slots.agg(F.max("bits")).first()[0] or 0)
    named = rows.withColumn("slot", prefix(F.col("_h"), bits)).join(slots, "slot")
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.lpad(F.bin("prefix"), F.col("depth").cast("int"), F.lit("0")))
    plain = F.struct(name.alias("name"), F.col("depth").cast("int").alias("depth"), F.col("rows").alias("rows"), F.col("bytes").alias("bytes"))
    if buckets.filter(F.col("full") & (F.col("rows") > 1)).isEmpty():
        return named.select(*[F.col("_doc")[c].alias(c) for c in own], plain.alias("shard"))
    paged = F.col("full") & (F.col("rows") > 1)
    whole = named.filter(~paged).select("_doc", plain.alias("shard"))
    return whole.unionByName(_pages(named.filter(paged), limit, name)).select(*[F.col("_doc")[c].alias(c) for c in own], "shard")


def _pages(rows: DataFrame, limit: int, name: Column) -> DataFrame:
    from pyspark.sql import Window

    rows = stored(rows.select("_doc", "_n", name.alias("_name"), "depth", F.spark_partition_id().alias("_part")), "full")
    # A page begins at every multiple of half the limit, or holds one row that is larger than that.
    half = max(1, limit // 2)
    run = Window.partitionBy("_name", "_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(run), F.lit(0))
    page = F.when(F.col("_n") > half, F.concat(F.lit("r"), F.row_number().over(Window.partitionBy("_name", "_part").orderBy("_n")))).otherwise(
        F.floor(before / half).cast("string"))
    numbered = stored(rows.withColumn("_page", F.concat_ws("-", "_name", "_part", page)), "pages")
    sums = numbered.groupBy("_page").agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("bytes"))
    return numbered.join(sums, "_page").select("_doc", F.struct(F.col("_page").alias("name"), F.col("depth").cast("int").alias("depth"), "rows", "bytes").alias("shard"))


def write(docs: DataFrame, limit: int, path: str, **options) -> None:
    """One folder for each shard."""
    assign(docs, limit, **options).withColumn("shard", F.col("shard.name")).repartition("shard").write.partitionBy("shard").parquet(path)
