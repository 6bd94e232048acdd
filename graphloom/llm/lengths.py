"""Token counts: an exact length histogram and what follows from it.

Each document is encoded whole and reduced to its length; equal lengths are
counted before the shuffle.  The histogram has one row per distinct length, and
sums over it answer every context limit: totals, quantiles and what a limit cuts off.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of this vocabulary's pre-tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET = 1024


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


def encoded_length(text: Column, path: str = RANKS) -> Column:
    """Tokens of a whole text (null and empty: 0); special strings are ordinary text.

    The driver reads the vocabulary file (under 1 MB) and broadcasts it.
    """
    with open(path, "rb") as f:
        vocabulary = SparkSession.active().sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken
        code = tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=read_ranks(vocabulary.value), special_tokens={})
        for s in batches:
            yield s.map(lambda t: len(code.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)


def histogram(lengths: DataFrame) -> DataFrame:
    """``(n_tokens, docs)``: documents of every length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def limits(hist: DataFrame) -> DataFrame:
    """One row per distinct length, taken as a context limit.

    n_tokens, docs (of just this length), docs_over and tokens_over (of longer
    documents), total_docs, total_tokens, truncated_total (tokens left when every document is cut
    at the limit) and share_up_to (documents that fit whole).  Suffix sums run inside
    buckets of 1,024 lengths; what lies beyond a bucket comes from the bucket
    sums, one row per 1,024 possible lengths.  An empty histogram gives no rows.
    """
    h = hist.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET).cast("long"))
    sums = h.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    beyond = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = sums.select("bucket", F.coalesce(F.sum("d").over(beyond), zero).alias("d_far"),
                       F.coalesce(F.sum("t").over(beyond), zero).alias("t_far"),
                       F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    near = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.sum("docs").over(near), zero)
    tokens = F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(near), zero)
    return (h.withColumn("d", over).withColumn("t", tokens).join(sums, "bucket")
            .withColumn("docs_over", F.col("d") + F.col("d_far")).withColumn("tokens_over", F.col("t") + F.col("t_far"))
            .select("n_tokens", "docs", "docs_over", "tokens_over", "total_docs", "total_tokens",
                    (F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
                    ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("share_up_to")))


def quantiles(limit_rows: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the least length that at least that share of documents do not exceed."""
    asked = F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share")
    return (limit_rows.select("n_tokens", "share_up_to", asked).filter("share_up_to >= share")
            .groupBy("share").agg(F.min("n_tokens").alias("n_tokens")))


def truncated_totals(limit_rows: DataFrame, asked: list[int]) -> DataFrame:
    """``(limit, truncated_total)`` for any limits, also ones that no document has as its length.

    Between two lengths the total grows by one token for each longer document, so the
    next length up answers; beyond the longest document nothing is cut.
    """
    want = F.explode(F.array(*[F.lit(int(x)) for x in asked])).alias("limit")
    at = F.col("truncated_total") - (F.col("n_tokens") - F.col("limit")) * (F.col("docs") + F.col("docs_over"))
    return (limit_rows.select("*", want).groupBy("limit")
            .agg(F.min_by(F.when(F.col("n_tokens") >= F.col("limit"), at),
                          F.when(F.col("n_tokens") >= F.col("limit"), F.col("n_tokens"))).alias("hit"),
                 F.max("total_tokens").alias("whole"))
            .select("limit", F.coalesce("hit", "whole").alias("truncated_total")))


def token_counts(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """The limits table of ``docs.text``.  Null and empty texts have length 0; repeated rows count each."""
    lengths = docs.select(encoded_length(F.col("text"), path).alias("n_tokens"))
    return limits(cut_lineage(histogram(lengths)))  # written, so that texts are encoded once
