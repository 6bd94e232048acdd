"""Lookups and listings over the store tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR_COLUMNS = ("embedding",)


def without_vectors(df: DataFrame) -> DataFrame:
    """Drop vector columns (pruned at the Parquet scan, never read)."""
    return df.drop(*[c for c in VECTOR_COLUMNS if c in df.columns])


def lookup_nodes(nodes: DataFrame, ids: DataFrame, id_col: str = "node_id") -> DataFrame:
    """P2 for a table of ids: the newest row per id (append-only store).

    Newest = largest ``updated_at``, ties by the remaining content, so the
    answer is deterministic.  Ids that do not exist give no row.
    """
    n = without_vectors(nodes).join(ids.select(F.col(id_col).alias("node_id")).distinct(),
                                    "node_id", "left_semi")
    cols = [c for c in n.columns if c != "node_id"]
    # one struct is both the order and the row, so every text is in the shuffle once
    newest = F.max(F.struct("updated_at", *[c for c in cols if c != "updated_at"]))
    return n.groupBy("node_id").agg(newest.alias("_n")).select("node_id", *[F.col("_n").getField(c).alias(c) for c in cols])


def list_nodes(nodes: DataFrame, limit: int = 200) -> DataFrame:
    """K4: first ``limit`` nodes by (created_at, node_id), without vectors.

    A global top-n: each partition keeps its own first ``limit`` rows
    (TakeOrderedAndProject), so nothing but ``limit`` rows per task moves.
    """
    return without_vectors(nodes).orderBy(F.col("created_at").asc_nulls_first(), "node_id") \
        .limit(limit)


def list_communities(communities: DataFrame, limit: int = 100) -> DataFrame:
    """K5: first ``limit`` communities by (updated_at, community_id), without vectors."""
    return without_vectors(communities).orderBy(
        F.col("updated_at").asc_nulls_first(), "community_id").limit(limit)


def search_registry(registry: DataFrame, file_types: list[str]) -> DataFrame:
    """Extractors whose ``file_types`` contain any requested type (exact, case-sensitive)."""
    want = F.array(*[F.lit(t) for t in file_types])
    return registry.filter(F.arrays_overlap(F.col("file_types"), want))


def get_extractors(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """Registry rows for a table of ``skill_id`` values (JSON columns decoded, S12)."""
    from graphloom.sources.store import registry_from_json_columns
    return registry_from_json_columns(registry).join(ids.select("skill_id").distinct(),
                                                     "skill_id", "left_semi")
