"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 40-bit hash of its id.  A source takes each of its
documents ``floor(target / size of the source)`` times, and once more those whose hash lies
below a threshold.  The threshold comes from nested histograms: words by
source and the hash's leading 10 bits give the bucket in which the remaining
budget ends; only that bucket is counted again by the next 10 bits, and so on.
Nothing is sorted and no document meets another: the last step is a filter on the hash.
A source with a third of all rows is 1,024 buckets like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import word_count
from graphloom.operators.ledger import global_row_number
from graphloom.session import cut_lineage

BITS, LEVELS = 10, 4
KEY = ["no_source", "src"]


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share_percent: int = 150,
            most: int = 2) -> DataFrame:
    """``sizes`` (no_source, src, source_size) with ``target`` (double).

    Sources in code point order, null last, take the weights in turn.  A target
    above ``most`` times its source is cut to that and the excess goes to the others
    by weight, until none is above.  Each round is one aggregation of the
    source table that returns three integers, so the result does not depend on the order of sums.
    """
    if share_percent > 100 * most:
        raise ValueError("the share asked for exceeds what the sources may give")
    n = len(weights)
    ranked = global_row_number(sizes, KEY, "_rank")
    s = cut_lineage(ranked.withColumn("w", F.element_at(
        F.array(*[F.lit(int(x)) for x in weights]), ((F.col("_rank") - 1) % n + 1).cast("int")).cast("long")))
    whole = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    num, den, seen = 0, 1, -1
    while True:
        # a source is capped when most * size < weight * num / (100 * den)
        capped = (F.lit(100 * most).cast("decimal(38,0)") * F.col("source_size") * F.lit(den)
                  < F.col("w") * F.lit(num).cast("decimal(38,0)")) if seen >= 0 else F.lit(False)
        used, free, count = s.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0)), F.count_if(capped)).first()
        if count == seen or not free:
            break
        num, den, seen = share_percent * whole - 100 * most * int(used), int(free), count
    rate = num / (100 * den)
    return s.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.lit(rate) * F.col("w"))).drop("w", "_rank")


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(no_source, src, limit)``: documents with hash below ``limit`` fill ``rest``.

    ``sizes``: no_source, src, h, size; ``budgets``: no_source, src, rest.  One
    histogram per level; from the second on only the boundary buckets' documents
    are read.  In the last level the boundary bucket is taken if that comes nearer.
    """
    level, left = sizes, budgets
    by_bucket = Window.partitionBy(*KEY).orderBy("bucket")
    by_source = Window.partitionBy(*KEY)
    for k in range(LEVELS):
        width = 1 << (BITS * (LEVELS - 1 - k))
        bucket = F.floor(F.col("h") / F.lit(width)).cast("long")
        hist = level.groupBy(*KEY, bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        # at most 2 ** BITS rows of a source
        run = (hist.withColumn("upto", F.sum("words").over(by_bucket)).join(left, KEY)
               .withColumn("over", F.col("upto") > F.col("rest"))
               .withColumn("edge", F.min(F.when(F.col("over"), F.col("bucket"))).over(by_source)))
        step = (run.groupBy(*KEY).agg(
            F.max("rest").alias("rest"), F.max("edge").alias("edge"),
            F.coalesce(F.max(F.when(~F.col("over"), F.col("upto"))), F.lit(0)).alias("inside"),
            F.max(F.when(F.col("bucket") == F.col("edge"), F.col("words"))).alias("edge_words")))
        found = cut_lineage(step.select(*KEY, (F.col("rest") - F.col("inside")).alias("rest"), "edge", "edge_words"))
        if k == LEVELS - 1:
            near = F.when(2 * F.col("rest") >= F.col("edge_words"), 1).otherwise(0)
            return found.select(*KEY, F.coalesce(F.col("edge") + near, F.lit(1 << (BITS * LEVELS))).alias("limit"))
        left = found.select(*KEY, "rest")
        edges = found.select(*KEY, "edge")
        level = cut_lineage(level.withColumn("edge", bucket).join(edges, [*KEY, "edge"], "left_semi").drop("edge"))
    raise AssertionError


def hashed(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` as (everything it has in ``row``), doc_id, source key, size and hash."""
    source, doc = F.col("source"), F.col("doc_id")
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("null")))), 1, 10), 16, 10)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc.cast("long").alias("doc_id"),
                       source.isNull().alias("no_source"), F.coalesce(source.cast("string"), F.lit("")).alias("src"),
                       word_count(F.col("text")).alias("size"), h.cast("long").alias("h"))


def plan(sizes: DataFrame, **options) -> DataFrame:
    """``(no_source, src, source_size, target, full, limit)``: what each source gives.

    ``sizes``: no_source, src, size, h.  Every document is taken ``full`` times and, if its
    hash is below ``limit``, once more.
    """
    t = targets(sizes.groupBy(*KEY).agg(F.sum("size").alias("source_size")), **options)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = cut_lineage(t.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")))
    # a source whose target is whole copies has no threshold to look for
    open_ = t.filter("rest > 0")
    limits = thresholds(sizes.join(open_.select(*KEY), KEY, "left_semi"), open_.select(*KEY, "rest"))
    return cut_lineage(t.join(limits, KEY, "left").select(*KEY, "source_size", "target", "full", F.coalesce("limit", F.lit(0)).alias("limit")))


def copies() -> Column:
    return F.col("full") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``taken`` is the document's words times its copies in the mix (0, 1 or 2
    with the default options).  Null texts have size 0; null sources are one
    source, the last.  Rows that repeat a doc_id share a hash and so a fate.  The
    hash depends on seed and id only, so reruns agree.  No rows give no rows.
    """
    d = cut_lineage(hashed(docs, seed).drop("row"))
    return d.join(plan(d, **options), KEY).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies()).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Sizes are counted in one pass and texts are read in a second one; only the small table of
    sources is joined to them.
    """
    p = plan(cut_lineage(hashed(docs, seed).drop("row")), **options)
    return (hashed(docs, seed).join(p, KEY).filter(copies() > 0)
            .select("row", F.explode(F.sequence(F.lit(1), copies())).alias("_")).select("row.*"))
