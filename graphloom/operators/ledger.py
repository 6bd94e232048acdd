"""Run ledger: filters, roll-ups, run numbers, content fingerprints and version notes
(P13 P14 A1 A6 A11 F6 F12 W1 W2 W3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

# Version naming and version-note texts used by the ledger.
VERSION_FORMAT = "%s_v%03d"
NOTE_INITIAL = "Initial prompt snapshot."
NOTE_UNCHANGED = "No detected changes."
NOTE_CHANGED_PREFIX = "Changed: "
NOTE_CHANGED_SUFFIX = "."
ITEM_NEW_SUFFIX = " (new)"
ITEM_DELTA_FORMAT = " (%+d chars)"


def filter_runs(runs: DataFrame, sprint: str | None = None, prompt: str | None = None,
                suite_prefix: str | None = None, model_substring: str | None = None,
                passed: bool = False, failed: bool = False,
                canonical: bool = False) -> DataFrame:
    """P13 / P14 with the reference rules.

    sprint and prompt compare with ``=``; suite is a **prefix** and model a
    **substring** test (a missing value counts as ``''``); ``passed`` keeps
    rows whose flag is true, ``failed`` rows whose flag is false (null is
    neither); ``canonical`` keeps rows marked canonical.
    """
    df = runs
    if sprint:
        df = df.filter(F.col("sprint") == sprint)
    if prompt:
        df = df.filter(F.col("prompt_version") == prompt)
    if suite_prefix:
        df = df.filter(F.coalesce(F.col("suite_version"), F.lit("")).startswith(suite_prefix))
    if model_substring:
        df = df.filter(F.coalesce(F.col("orchestrator_model"), F.lit("")).contains(model_substring))
    if passed:
        df = df.filter(F.col("passed").eqNullSafe(True))
    if failed:
        df = df.filter(F.col("passed").eqNullSafe(False))
    if canonical:
        df = df.filter(F.col("canonical").eqNullSafe(True))
    return df


def aggregate_runs(runs: DataFrame, key: str) -> DataFrame:
    """A1: per key - runs, passed (true), failed (not true: null counts as failed),
    cost (exact decimal sum, 6 places), tokens, nodes and edges.  Missing key -> 'unknown'.
    """
    def z(c):
        return F.coalesce(F.col(c), F.lit(0))
    return (runs.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key))
            .agg(F.count(F.lit(1)).alias("runs"),
                 F.count_if(F.col("passed").eqNullSafe(True)).alias("passed"),
                 F.count_if(~F.col("passed").eqNullSafe(True)).alias("failed"),
                 F.sum(F.coalesce(F.col("cost_usd"), F.lit(0).cast("decimal(18,6)")))
                 .cast("decimal(24,6)").alias("cost_usd"),
                 F.sum(z("in_tokens")).cast("long").alias("in_tokens"),
                 F.sum(z("out_tokens")).cast("long").alias("out_tokens"),
                 F.sum(z("nodes")).cast("long").alias("total_nodes"),
                 F.sum(z("edges")).cast("long").alias("total_edges")))


def global_row_number(df: DataFrame, order_cols: list[str], name: str = "run_num") -> DataFrame:
    """1-based position of every row in the total order ``order_cols``.

    No single-partition window: the rows are range-partitioned by a global
    sort and written once; each partition's start offset comes from the
    per-partition counts (one row per partition, a bounded table), added to
    the position inside the partition.
    """
    s = cut_lineage(df.orderBy(*order_cols)
                    .withColumn("_p", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()))
    counts = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    offsets = counts.select(
        "_p", "_m0",
        (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    return (s.join(F.broadcast(offsets), "_p")
            .withColumn(name, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_mid")
                               - F.col("_m0") + 1).cast("long"))
            .drop("_p", "_mid", "_m0", "_off"))


def content_fingerprint(files: DataFrame, group_col: str, name_col: str,
                        content_col: str) -> DataFrame:
    """8-hex fingerprint of each group's set of ``(name, content)`` files.

    Each file is hashed on its own (``sha256(name || ':\\n' || content)``);
    the group hash is ``sha256`` of the file count and the sums of the two
    60-bit halves of the file hashes, so it is order-free and computed by a
    partial aggregation: a huge group never becomes one value.
    """
    h = F.sha2(F.concat(F.col(name_col).cast("string"), F.lit(":\n"),
                        F.coalesce(F.col(content_col), F.lit(""))), 256)
    hi = F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")
    lo = F.conv(F.substring(h, 16, 15), 16, 10).cast("decimal(38,0)")
    agg = (files.select(group_col, hi.alias("hi"), lo.alias("lo"))
           .groupBy(group_col)
           .agg(F.count(F.lit(1)).alias("n_files"), F.sum("hi").alias("s_hi"),
                F.sum("lo").alias("s_lo")))
    fp = F.substring(F.sha2(F.concat_ws("|", F.col("n_files").cast("string"),
                                        F.col("s_hi").cast("string"),
                                        F.col("s_lo").cast("string")), 256), 1, 8)
    return agg.select(group_col, "n_files", fp.alias("fingerprint"))


def assign_versions(snapshots: DataFrame, suite_col: str, time_col: str,
                    hash_col: str = "fingerprint") -> DataFrame:
    """Same hash -> same version; a new hash gets the next ``<suite>_vNNN``.

    Version order is first-seen order of each distinct hash within a suite
    (ties by hash).  Suites are matched by equality (not by name prefix).
    """
    first = snapshots.groupBy(suite_col, hash_col).agg(F.min(time_col).alias("_first"))
    # numbered over all suites at once and then counted from each suite's start: no suite is one task
    n = cut_lineage(global_row_number(first, [suite_col, "_first", hash_col], "_n"))
    start = n.groupBy(suite_col).agg(F.min("_n").alias("_start"))
    ver = n.join(start, suite_col).withColumn("version", F.format_string(
        VERSION_FORMAT, F.col(suite_col).cast("string"), (F.col("_n") - F.col("_start") + 1).cast("int")))
    return snapshots.join(ver.select(suite_col, hash_col, "version"), [suite_col, hash_col])


def version_notes(prompts: DataFrame, suite_col: str = "suite", version_col: str = "version_no",
                  name_col: str = "name", content_col: str = "content") -> DataFrame:
    """Per version, what changed against the immediately previous version.

    ``prompts(suite, version_no, name, content)``.  A name absent from
    version ``n-1`` is ``name (new)``; a changed text is ``name (+N chars)`` /
    ``name (-N chars)``.  The first version is ``Initial prompt snapshot.``,
    a version without changes ``No detected changes.``  The previous version
    is found by an equi-join on ``version_no - 1`` (no window over a suite).
    """
    p = prompts.select(F.col(suite_col).alias("suite"), F.col(version_col).alias("v"),
                       F.col(name_col).alias("name"), F.col(content_col).alias("content"))
    versions = p.select("suite", "v").distinct()
    first_v = p.groupBy("suite").agg(F.min("v").alias("v0"))
    prev = p.select("suite", (F.col("v") + 1).alias("v"), "name",
                    F.col("content").alias("prev_content"))
    prev_exists = p.select("suite", (F.col("v") + 1).alias("v")).distinct().withColumn(
        "has_prev", F.lit(True))
    delta = F.length("content") - F.length("prev_content")
    items = (p.join(prev, ["suite", "v", "name"], "left")
             .join(prev_exists, ["suite", "v"], "left")
             .select("suite", "v", "name",
                     F.when(F.col("prev_content").isNull() & F.col("has_prev").isNotNull(),
                            F.concat(F.col("name"), F.lit(ITEM_NEW_SUFFIX)))
                     .when(F.col("prev_content").isNotNull()
                           & (F.col("prev_content") != F.col("content")),
                           F.concat(F.col("name"), F.format_string(ITEM_DELTA_FORMAT, delta)))
                     .alias("item")))
    changed = (items.filter(F.col("item").isNotNull()).groupBy("suite", "v")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "item"))),
                                             lambda x: x["item"]), ", ").alias("items")))
    return (versions.join(first_v, "suite").join(changed, ["suite", "v"], "left")
            .join(prev_exists, ["suite", "v"], "left")
            .select(F.col("suite").alias(suite_col), F.col("v").alias(version_col),
                    F.when(F.col("v") == F.col("v0"), F.lit(NOTE_INITIAL))
                    .when(F.col("items").isNotNull(),
                          F.concat(F.lit(NOTE_CHANGED_PREFIX), F.col("items"),
                                   F.lit(NOTE_CHANGED_SUFFIX)))
                    .otherwise(F.lit(NOTE_UNCHANGED)).alias("note")))


def load_run_log(spark, path: str) -> DataFrame:
    """A run log written as a JSON array (optional fields absent -> null);
    a missing file gives an empty table with the run-log schema."""
    from graphloom.schemas import RUN_LOG
    from graphloom.streaming.corrections import _exists
    if not _exists(spark, path):
        return spark.createDataFrame([], RUN_LOG)
    return spark.read.schema(RUN_LOG).option("multiLine", True).json(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Append runs to a Parquet run log; run numbers are assigned at read
    time with ``global_row_number`` (no read-modify-write of one file)."""
    runs.write.mode("append").parquet(path)


def model_call_rollup(calls: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run, model calls, input/output tokens and cost (rounded to 6 places)."""
    return (calls.groupBy(key)
            .agg(F.count(F.lit(1)).alias("iterations"),
                 F.sum(F.coalesce("in_tokens", F.lit(0))).cast("long").alias("in_tokens"),
                 F.sum(F.coalesce("out_tokens", F.lit(0))).cast("long").alias("out_tokens"),
                 F.bround(F.sum(F.coalesce(F.col("cost_usd").cast("decimal(18,6)"),
                                          F.lit(0).cast("decimal(18,6)"))), 6).alias("cost_usd")))


def previous_in_order(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """``prev_<c>`` for each column c: the value on the previous row of the same
    ``key`` in ``order`` (null on a key's first row) - a ``lag`` without a
    window partitioned by ``key``.

    Only the narrow keys are sorted: they are numbered over a range partitioning
    (``global_row_number``), so a key holding a third of all rows is spread over
    many tasks, and each key is paired with the number before it.  The
    columns come from one equi-join on ``(key, previous order)``.  Rows of equal
    (key, order) have the same previous row; if there are several rows there, the largest of them
    by its columns.  A row with a null key or order has no previous row.
    """
    keys = df.select(F.col(key).alias("_k"), F.col(order).alias("_o")).filter("_k IS NOT NULL AND _o IS NOT NULL").distinct()
    n = cut_lineage(global_row_number(keys, ["_k", "_o"], "_n"))
    before = n.select((F.col("_n") + 1).alias("_n"), F.col("_k").alias("_bk"), F.col("_o").alias("_bo"))
    link = cut_lineage(n.join(before, "_n").filter("_k = _bk").select("_k", "_o", "_bo"))
    rows = (df.groupBy(F.col(key).alias("_rk"), F.col(order).alias("_ro"))
            .agg(F.max(F.struct(*cols)).alias("_r")))
    # (key, order) -> the columns of the row before: the text travels in one join only
    prev = link.join(rows, (F.col("_k") == F.col("_rk")) & (F.col("_bo") == F.col("_ro"))).select("_k", "_o", "_r")
    return (df.join(prev, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_o")), "left")
            .select(*[F.col(c) for c in df.columns], *[F.col("_r").getField(c).alias(f"prev_{c}") for c in cols]))
