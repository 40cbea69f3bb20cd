"""Token counts kept by deltas: signed changes update additive totals by source, language and tokenizer version.

A change carries what a document counted before and after (null: not there). It becomes up to two signed rows, one against the
old key and one for the new. A batch is summed and committed as one folder named by its id; totals are the sums of all
committed batches. A batch that is already committed is not applied again, so a batch can be repeated after any failure;
``compact`` folds committed batches into one, keeping their ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = ("source", "lang", "tokenizer")
DELTAS = "batch long, source string, lang string, tokenizer string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of changes: structs ``old`` and ``new`` of the three keys and ``n_tokens``, either null.

    A revised count is minus the old and plus the new; a document that moves to another source or language leaves one key
    and enters the other; null keys are keys of their own; a null count is 0.
    """
    side = lambda c, sign: F.struct(*[F.col(c)[k].alias(k) for k in KEYS], F.lit(sign).cast("long").alias("docs"),
                                    (sign * F.coalesce(F.col(c)["n_tokens"], F.lit(0))).cast("long").alias("tokens"))
    both = F.filter(F.array(F.when(F.col("old").isNotNull(), side("old", -1)), F.when(F.col("new").isNotNull(), side("new", 1))), lambda s: s.isNotNull())
    return changes.select("batch", F.explode(both).alias("s")).select("batch", "s.*")


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed deltas; None before the first."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return None
    return spark.read.schema(DELTAS).option("recursiveFileLookup", "true").parquet(path)


def apply(path: str, changes: DataFrame) -> None:
    """Commit the batches of ``changes`` (``batch``, ``old``, ``new``) that are not committed yet, each whole.

    All batches of one call are one write, and Spark's commit makes all of it visible or none. A batch id must not be
    reused for other changes.
    """
    spark = changes.sparkSession
    deltas = signed(changes).groupBy("batch", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    before = committed(spark, path)
    if before is not None:
        deltas = deltas.join(before.select("batch").distinct(), "batch", "left_anti")
    deltas.write.parquet(f"{path}/{uuid.uuid4().hex}")


def totals(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Documents, tokens and batches per key, as of a batch id if one is given; keys that went back to nothing stay, with zeros."""
    rows = committed(spark, path)
    if rows is None:
        rows = spark.createDataFrame([], DELTAS)
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"), F.countDistinct("batch").alias("n_batches"))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The committed deltas rewritten as few files under another path."""
    rows = committed(spark, path)
    rows.groupBy("batch", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{to}/{uuid.uuid4().hex}")


def count_words(text: Column) -> Column:
    """Runs without ASCII white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def count_marks(text: Column) -> Column:
    """Words and single marks: letters and digits together, every other visible ASCII character alone."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "a"), r"[\x00-\x20\x7F]+", "")), F.lit(0)).cast("long")
