"""URL filters over time: dated list entries become validity intervals, and every capture meets those active when it was fetched.

An entry names a host; it covers that host and all below it. Added and removed entries of one (list, host) in order of time make
intervals from an addition to the next removal. A capture asks for its host and each parent; intervals are dealt by month,
so a capture meets only those of its own month, whatever the length of a list's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ENDLESS = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and trailing dot; null if the URL has none."""
    raw = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(raw, r"\.$", ""), F.lit(""))


def parents(host: Column) -> Column:
    """The host and its parents of two labels or more, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array(host)).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, host, valid_from, valid_to) from dated entries (list, host, at, added).

    Additions while active and removals while inactive change nothing; of an addition and a removal at the same time the removal holds.
    Entries with a null in any of the four columns are void.
    """
    one = entries.select("list", F.lower("host").alias("host"), "at", "added").dropna().groupBy("list", "host", "at").agg(F.min("added").alias("added"))
    order = Window.partitionBy("list", "host").orderBy("at")
    turns = one.withColumn("_was", F.coalesce(F.lag("added").over(order), F.lit(False))).filter("added != _was")
    return turns.withColumn("valid_to", F.coalesce(F.lead("at").over(order), F.lit(ENDLESS).cast("timestamp"))).filter("added").select(
        "list", "host", F.col("at").alias("valid_from"), "valid_to")


def _hit(column: str):
    return lambda s: F.struct(F.col(column).alias("host"), s["list"].alias("list"))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with the struct ``verdict``: ``blocked``, ``entries`` (active entries that cover the host), ``lists``, ``host``
    (the longest listed host, null if none).

    An interval holds from its first moment up to, not including, its end. Captures without host or time meet nothing. Rows
    need no key: repeated captures are judged each. All columns stay; only ``verdict`` is replaced.
    """
    own = [c for c in captures.columns if c != "verdict"]
    last = captures.agg(F.max(at).cast("timestamp")).scalar()
    valid = intervals(entries).withColumn("_end", F.least("valid_to", F.greatest(last, F.col("valid_from"))))
    dealt = valid.withColumn("_month", F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc("_end", "month"), F.expr("interval 1 month"))))
    # Active entries are counted per (host, month) in one row, so a capture meets one row for each of its host's parents.
    listed = dealt.groupBy(F.col("host").alias("_host"), "_month").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("_spans"))
    asked = captures.select(F.struct(*[captures[c] for c in own]).alias("_doc"), captures[at].cast("timestamp").alias("_at"), parents(host_of(captures[url])).alias("_hosts"))
    # Each parent is a column of its own step, so captures are never multiplied: the depth of hosts in the table is the number of steps.
    deepest = asked.agg(F.max(F.size("_hosts"))).first()[0] or 0
    out = asked.withColumn("_found", F.array().cast("array<struct<host:string,list:string>>")).withColumn("_month", F.trunc("_at", "month"))
    for i in range(deepest):
        step = listed.withColumnRenamed("_host", f"_h{i}")
        out = out.withColumn(f"_h{i}", F.get("_hosts", F.lit(i))).join(step, [f"_h{i}", "_month"], "left")
        active = F.filter("_spans", lambda s: (s["valid_from"] <= F.col("_at")) & (F.col("_at") < s["valid_to"]))
        hits = F.transform(F.coalesce(active, F.array().cast("array<struct<list:string,valid_from:timestamp,valid_to:timestamp>>")), _hit(f"_h{i}"))
        out = out.withColumn("_found", F.concat("_found", hits)).drop("_spans", f"_h{i}")
    f = F.col("_found")
    return out.select(*[F.col("_doc")[c].alias(c) for c in own], F.struct(
        (F.size(f) > 0).alias("blocked"), F.size(f).cast("long").alias("entries"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(f, lambda s: s["list"]))), ",").alias("lists"),
        F.get(F.transform(f, lambda s: s["host"]), F.lit(0)).alias("host")).alias("verdict"))
