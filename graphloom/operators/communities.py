"""Community rows, membership write-back and summaries (GR6 GR11 GR12 A8 K8 U4 J7 EM2).

Members are kept as rows ``(community_id, node_id, ...)``: a community can
hold a large share of all nodes, so it is never collected into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY_CHARS = 400


def community_rows(labels: DataFrame, nodes: DataFrame, level: int = 0) -> DataFrame:
    """GR6 + A8 + K8 + U4.

    ``labels(node_id, comm)``; ``nodes(node_id, source_file, chunk_type, summary)``.
    Singleton communities are dropped unless every community is a singleton
    (decided by one scalar, ``max(size)``).  ``community_id`` is
    ``'comm:' || smallest member id`` - stable across runs, unlike a random
    uuid.  One row per member with its summary cut to 400 characters.
    """
    sizes = labels.groupBy("comm").agg(F.count(F.lit(1)).alias("n_members"),
                                       F.min("node_id").alias("first_member"))
    max_size = sizes.agg(F.max("n_members")).first()[0] or 0
    if max_size > 1:
        sizes = sizes.filter(F.col("n_members") > 1)
    n = nodes.select("node_id", "source_file", "chunk_type",
                     F.substring(F.coalesce(F.col("summary"), F.lit("")), 1, SUMMARY_CHARS)
                     .alias("summary"))
    return (labels.join(sizes, "comm")
            .join(n, "node_id", "left")
            .select(F.concat(F.lit("comm:"), F.col("first_member")).alias("community_id"),
                    F.lit(level).alias("level"), "n_members", "node_id", "source_file",
                    "chunk_type", "summary"))


def write_back_membership(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Set ``community_id`` of member nodes (new value wins, unknown members ignored).

    ``members(node_id, community_id[, updated_at])``; when a node is listed
    under several communities the newest assignment wins (then the larger id).
    Returns the full new version of the nodes table (write it to a new
    path; never overwrite the path being read).
    """
    m = members
    if "updated_at" not in m.columns:
        m = m.withColumn("updated_at", F.lit(None).cast("timestamp"))
    latest = (m.groupBy("node_id")
              .agg(F.max_by("community_id", F.struct("updated_at", "community_id"))
                   .alias("new_community")))
    return (nodes.join(latest, "node_id", "left")
            .withColumn("community_id", F.coalesce("new_community", "community_id"))
            .drop("new_community"))


def extractive_summary(members: DataFrame) -> DataFrame:
    """EM2 default for communities: member count, chunk-type counts and the
    summaries of the three members with the most characters of summary
    (ties by node id).  Distributed; only bounded values are concatenated.
    """
    from pyspark.sql import Window
    type_counts = (members.groupBy("community_id", "chunk_type").agg(F.count(F.lit(1)).alias("n"))
                   .groupBy("community_id")
                   .agg(F.array_join(F.sort_array(F.collect_list(
                       F.concat_ws(":", F.coalesce("chunk_type", F.lit("unknown")),
                                   F.col("n").cast("string")))), ", ").alias("types")))
    w = Window.partitionBy("community_id").orderBy(F.length("summary").desc(), "node_id")
    lead = (members.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 3)
            .groupBy("community_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "summary"))),
                                          lambda x: x["summary"]), " | ").alias("lead")))
    return (type_counts.join(lead, "community_id")
            .select("community_id",
                    F.substring(F.concat(F.lit("["), F.col("types"), F.lit("] "), F.col("lead")),
                                1, SUMMARY_CHARS).alias("summary")))


def lead_summary(nodes: DataFrame, text_col: str = "raw_cleaned", max_chars: int = SUMMARY_CHARS,
                 boilerplate: list[str] | None = None) -> DataFrame:
    """EM2 default for nodes: boilerplate lines removed (X8), then the leading
    sentences up to ``max_chars`` characters.  A pluggable summariser replaces
    this column."""
    from graphloom.operators.extract import strip_boilerplate
    text = F.col(text_col)
    if boilerplate:
        text = strip_boilerplate(text, boilerplate)
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(clean, 1, max_chars)
    # end at the last sentence end inside the cut when there is one
    last_end = F.regexp_extract(cut, r"^(.*[.!?])\s", 1)
    return nodes.withColumn("summary", F.when(F.length(last_end) > 0, last_end).otherwise(cut))
