"""Suite and prompt versions over time (Q2): validity intervals and as-of lookup.

``validity`` turns snapshots ``(suite, at, version)`` into one row per time a version was in force:
consecutive snapshots of one version are one interval, and a version that returns gets another one.
``as_of`` tells which version was in force at given times.  Neither orders a whole suite in one task:
rows are numbered over a global sort and joined by number, so a suite may hold any share of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.ledger import previous_in_order
from graphloom.session import cut_lineage


def running_count(df: DataFrame, order: list, flag: str, name: str) -> DataFrame:
    """``name``: how many rows with a true ``flag`` come before a row in the total order, itself included.

    Counted inside the partitions of a global sort and shifted by the partitions before (one row each).
    """
    s = cut_lineage(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    inside = Window.partitionBy("_p").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    counts = s.groupBy("_p").agg(F.count_if(F.col(flag)).alias("_n"))
    before = counts.select("_p", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"))
    return (s.withColumn("_c", F.count_if(F.col(flag)).over(inside)).join(F.broadcast(before), "_p")
            .withColumn(name, F.col("_c") + F.coalesce("_off", F.lit(0))).drop("_p", "_mid", "_c", "_off"))


def validity(snapshots: DataFrame) -> DataFrame:
    """Intervals ``(suite, version, valid_from, valid_to, n_snapshots)`` of ``snapshots(suite, at, version)``.

    ``valid_to`` is the start of the suite's next interval (exclusive), null for the one in force now.  Of
    several versions at one time the largest counts, and ``n_snapshots`` counts times, not rows.  Rows without
    a suite or time are left out; a null version counts as none being in force until the next one.
    """
    s = (snapshots.filter("suite IS NOT NULL AND at IS NOT NULL").groupBy("suite", "at").agg(F.max("version").alias("version")))
    s = cut_lineage(s)
    # "the version before" is told apart from "no row before"
    seen = previous_in_order(s.withColumn("here", F.lit(True)), "suite", "at", ["version", "here"])
    changed = F.col("prev_here").isNull() | ~F.col("version").eqNullSafe(F.col("prev_version"))
    seen = cut_lineage(running_count(seen.select("suite", "at", "version", changed.alias("changed")), ["suite", "at"], "changed", "n"))
    starts = seen.filter("changed").select("suite", "version", F.col("at").alias("valid_from"), "n")
    follows = starts.select("suite", F.col("valid_from").alias("valid_to"), (F.col("n") - 1).alias("n"))
    sizes = seen.groupBy("n").agg(F.count(F.lit(1)).alias("n_snapshots"))
    return (starts.join(follows, ["suite", "n"], "left").join(sizes, "n").filter("version IS NOT NULL")
            .select("suite", "version", "valid_from", "valid_to", "n_snapshots"))


def as_of(rows: DataFrame, intervals: DataFrame, suite: str = "suite", at: str = "at") -> DataFrame:
    """``rows`` with ``version`` and ``valid_from``: the interval of their suite that holds at their time, or null."""
    own = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    starts = intervals.select(F.col("suite").alias("_s"), F.col("valid_from").alias("_t"), F.lit(True).alias("_start"), F.lit(-1).cast("long").alias("_row"),
                              "version", "valid_from", "valid_to")
    asked = own.filter(F.col(suite).isNotNull() & F.col(at).isNotNull()).select(
        F.col(suite).alias("_s"), F.col(at).alias("_t"), F.lit(False).alias("_start"), "_row")
    n = cut_lineage(running_count(starts.unionByName(asked, allowMissingColumns=True), ["_s", "_t", F.desc("_start"), "_row"], "_start", "_n"))
    hit = (n.filter("NOT _start").select("_row", "_s", "_t", "_n")
           .join(n.filter("_start").select("_n", F.col("_s").alias("_s2"), "version", "valid_from", "valid_to"), "_n")
           .filter("_s = _s2 AND (valid_to IS NULL OR _t < valid_to)").select("_row", "version", "valid_from"))
    return own.join(hit, "_row", "left").drop("_row")


def version_index(intervals: DataFrame) -> DataFrame:
    """One row per version of a suite: ``suite, version, first_from, last_from, n_intervals, n_snapshots, in_force``."""
    return intervals.groupBy("suite", "version").agg(
        F.min("valid_from").alias("first_from"), F.max("valid_from").alias("last_from"), F.count(F.lit(1)).alias("n_intervals"),
        F.sum("n_snapshots").alias("n_snapshots"), F.bool_or(F.col("valid_to").isNull()).alias("in_force"))
