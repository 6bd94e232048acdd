"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table ``(digest, keep_id)`` with one row per distinct
text, bucketed and sorted by the SHA-256 digest.  A batch of new documents is
reduced to its distinct digests (partial aggregation before the shuffle, so a
text with a third of all rows sends one row per task), anti-joined with the index by
sort-merge (the batch is dealt by the index's buckets, the index side is not
shuffled) and the digests that are new are appended.  A batch that failed half
way can be repeated: digests already stored are skipped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, ensure_checkpoint_dir


class DigestIndex:
    """Handle of one index: a folder in shared storage and its bucket count.

    The bucket count is fixed for the life of the index; it is part of the
    folder name, so opening it with another count starts another index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = f"{path.rstrip('/')}/buckets-{buckets}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        """The index as it is stored now."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, digests: DataFrame) -> None:
        """Append the digests of ``digests`` (doc_id, digest) that the index lacks.

        Of the batch's equal digests the largest doc_id is stored; a digest
        that is stored already keeps its document.
        """
        new = (digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
               .repartition(self.buckets, "digest")
               .join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
               .select("digest", "keep_id"))
        # dealt by the bucket number itself, one task writes a bucket whatever the session's number of partitions is
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        new.repartition(self.buckets, bucket).write.insertInto(self.name)

    def close(self) -> None:
        """Forget the table's name; the stored files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest)`` of every row; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"))


def dedup(spark: SparkSession, docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The documents enter the index in two batches, the upper half of the ids
    first, so that of equal texts the largest doc_id is the one stored.
    ``group_size`` counts the rows of ``docs`` with the text.  Null text equals
    empty text.  Rows that repeat a doc_id are separate copies, and all of them are
    kept when theirs is the id that stays.  A null doc_id is never kept; a
    group of null ids only has a null keep_id.  No rows give no rows.
    """
    d = cut_lineage(digests(docs))
    lo, hi = d.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is not None:
        middle = (lo + hi) // 2
        index.add(d.filter(F.col("doc_id") > middle))
        index.add(d.filter(F.col("doc_id") <= middle))
    index.add(d.filter(F.col("doc_id").isNull()))
    groups = cut_lineage(index.rows().join(
        d.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")).repartition(index.buckets, "digest"),
        "digest"))
    # both sides are plain files: a text with very many copies is a skewed join that AQE splits
    return d.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def fresh_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """A new, empty index in the shared folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return DigestIndex(spark, f"{base}/digest-index/{uuid.uuid4().hex}", buckets)
