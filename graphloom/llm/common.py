"""Helpers shared by the operators of this subpackage.

Every operator first selects the columns it needs under private names, so extra
or clashing columns in its input never matter.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.idset import bitmap  # noqa: F401 (operators take it from here)
from graphloom.session import cut_lineage, release

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]"
BLANK = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def give_back() -> None:
    """Returns freed memory of this process to the system.

    Spark keeps a task's Python worker for later stages, and what its allocator keeps would count against the
    executor until then.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other systems' allocators have none
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A task function for ``mapInArrow`` that gives memory back when it ends."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return task


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0), without an array of words.

    Each word with the blanks behind it shrinks to one character; possessive
    quantifiers keep the scan linear in the length of the text.
    """
    body = F.ltrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.length(F.regexp_replace(body, f"{WORD}++{BLANK}*+", "x")).cast("long")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node; ``edges`` has ``a`` and ``b`` (long).

    Large-star / small-star contraction (Kiveris et al. 2014): each round joins
    every node's larger, then smaller neighbours to its smallest one.  The edge
    table never grows, only a scalar reaches the driver, and each round is a
    written table, so a lost executor repeats one round.  Runs to the fixpoint.
    Nodes without edges are their own component.
    """
    e = cut_lineage(edges.filter("a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size = e.count()
    last = None
    while size:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low2, "u")
        small = (pairs.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                              F.col("m").alias("v")).filter("u <> v").distinct())
        e, old = cut_lineage(small), e
        release(old)
        # at the fixpoint the edges are stars whose centres are nobody's leaf
        state = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                                                    F.lit(0).cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    labels = e.groupBy("u").agg(F.min("v").alias("v"))
    return (nodes.select("node").join(labels, F.col("node") == F.col("u"), "left")
            .select("node", F.coalesce("v", "node").alias("component")))
