"""Keyed tables in hash buckets with a manifest: an upsert or a new version rewrites only the buckets whose rows change.

Rows lie in ``data/<run>/_bucket=<n>``; a manifest names the run that holds each bucket, with its rows and largest surrogate. A
commit writes new folders beside the old ones and then creates the next manifest, which is one small file: readers see the table before
or after it, a run that dies leaves files that no manifest names, and of two runs that start from one manifest the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..streaming import storage
from . import dimensional

BUCKET = "_bucket"


def bucket_of(key: list[str], buckets: int) -> Column:
    """Number of the bucket of a key; equal keys, nulls among them, have one bucket."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def _state(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per bucket what tells its rows from others: their number and two sums of their hashes."""
    h = F.xxhash64(*columns)
    return df.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("x"))


class BucketTable:
    """A table under ``path``. ``surrogate`` names a column whose largest value the manifest keeps."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = manifest if manifest is not None else self._latest()

    # ---- manifests ----------------------------------------------------------------
    def _latest(self) -> dict:
        for name in sorted(storage.names(self.spark, f"{self.path}/manifest"), reverse=True):
            text = storage.read_text(self.spark, f"{self.path}/manifest/{name}")
            if text.endswith("\n"):  # a manifest that was not finished has no last line break
                return json.loads(text)
        raise FileNotFoundError(f"no table under {self.path}")

    def _commit(self, changed: dict[int, dict]) -> None:
        new = self.manifest | {"version": self.manifest["version"] + 1, "buckets": self.manifest["buckets"] | {str(b): v for b, v in changed.items()}}
        storage.create_text(self.spark, f"{self.path}/manifest/{new['version']:012d}.json", json.dumps(new) + "\n")
        self.manifest = new

    @classmethod
    def create(cls, df: DataFrame, path: str, key: list[str], buckets: int = 64, surrogate: str | None = None) -> BucketTable:
        """Store ``df`` as a new table; a table that exists is an error."""
        start = {"version": 0, "key": key, "n": buckets, "surrogate": surrogate, "schema": json.loads(df.schema.json()), "buckets": {}}
        table = cls(df.sparkSession, path, start)
        table._commit(table._written(df.withColumn(BUCKET, bucket_of(key, buckets))))
        return table

    @property
    def n_buckets(self) -> int:
        return self.manifest["n"]

    @property
    def key(self) -> list[str]:
        return self.manifest["key"]

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.manifest["schema"])

    def folders(self) -> dict[int, str]:
        """Folder of each bucket that has rows."""
        return {int(b): v["folder"] for b, v in self.manifest["buckets"].items() if v["rows"]}

    # ---- reading and writing -------------------------------------------------------
    def read(self, only: set[int] | None = None) -> DataFrame:
        """The rows, of some buckets or of all: other folders are not opened."""
        return self._read(only).drop(BUCKET)

    def _read(self, only: set[int] | None) -> DataFrame:
        picked = [f"{self.path}/{f}" for b, f in sorted(self.folders().items()) if only is None or b in only]
        df = self.spark.read.schema(self.schema).parquet(*picked) if picked else self.spark.createDataFrame([], self.schema)
        return df.withColumn(BUCKET, bucket_of(self.key, self.n_buckets))

    def _written(self, rows: DataFrame) -> dict[int, dict]:
        """Write rows by bucket under a new run; what the manifest says of each bucket written."""
        run = f"data/{uuid.uuid4().hex}"
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{run}")
        top = self.manifest["surrogate"]
        facts = self.spark.read.parquet(f"{self.path}/{run}").groupBy(BUCKET).agg(
            F.count(F.lit(1)).alias("n"), (F.max(top) if top else F.lit(None)).alias("top")) if storage.names(self.spark, f"{self.path}/{run}") != ["_SUCCESS"] else None
        return {r[BUCKET]: {"folder": f"{run}/{BUCKET}={r[BUCKET]}", "rows": r.n, "top": r.top} for r in (facts.collect() if facts else [])}

    def apply(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Bring in new rows: ``merge(old rows, new rows)`` of the buckets that the new keys touch. Returns the buckets rewritten.

        Buckets whose rows come out as they were are not written; without any the manifest stays. What reaches the driver is
        a line per bucket.
        """
        columns = self.schema.names
        dealt = storage.stored(new.withColumn(BUCKET, bucket_of(self.key, self.n_buckets)), "incoming")
        touched = {r[0] for r in dealt.select(BUCKET).distinct().collect()}
        merged = lambda some: merge(self.read(some), dealt.filter(F.col(BUCKET).isin(sorted(some))).drop(BUCKET)).select(*columns).withColumn(
            BUCKET, bucket_of(self.key, self.n_buckets))
        if not touched:
            return []
        before = {r[BUCKET]: tuple(r)[1:] for r in _state(self._read(touched), columns).collect()}
        after = {r[BUCKET]: tuple(r)[1:] for r in _state(merged(touched), columns).collect()}
        changed = {b for b in touched if before.get(b) != after.get(b)}
        if changed:
            emptied = {b: {"folder": "", "rows": 0, "top": None} for b in changed - set(after)}
            self._commit(emptied | self._written(merged(changed)))
        return sorted(changed)

    def upsert(self, new: DataFrame, update_cols: list[str], order: list[str] | None = None) -> list[int]:
        """``dimensional.upsert`` on the touched buckets."""
        return self.apply(new, lambda old, rows: dimensional.upsert(old, rows, self.key, update_cols, order))

    def merge_versions(self, snapshot: DataFrame, tracked: list[str], as_of: str, **options) -> list[int]:
        """``dimensional.scd2_merge`` on the touched buckets; surrogates go on from the table's largest one."""
        top = max((v["top"] for v in self.manifest["buckets"].values() if v["top"] is not None), default=0)
        return self.apply(snapshot, lambda old, rows: dimensional.scd2_merge(
            old, rows, self.key[0], tracked, as_of, self.manifest["surrogate"], top=top, **options))

    def vacuum(self) -> int:
        """Delete the folders of runs that the manifest no longer names; returns their number."""
        used = {f.split("/")[1] for f in self.folders().values()}
        old = [n for n in storage.names(self.spark, f"{self.path}/data") if n not in used]
        for name in old:
            storage.delete(self.spark, f"{self.path}/data/{name}")
        return len(old)
