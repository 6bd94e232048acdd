"""The community build as one job: GR4, GR5, GR7, GR6, EM2, EM1, GR11, J7.

Reads nodes and edges of a store and writes the communities of every level, their tree, the members and the nodes'
membership as one release: readers see all of it or none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.communities import extractive_summary, write_back_membership
from graphloom.operators.graph import simple_graph
from graphloom.operators.hierarchy import ancestors, community_tree, louvain_levels
from graphloom.operators.ledger import global_row_number
from graphloom.operators.vectors import embed_text
from graphloom.session import cut_lineage, release
from graphloom.sources.store import Store


def node_levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(levels, pairs)``: ``(id, community, level)`` of every node by Louvain and the simple graph ``(src, dst)`` it ran on.

    Communities are named after their smallest node id.  Louvain runs on numbers, given by the order of the ids.
    """
    pairs = cut_lineage(simple_graph(nodes, edges))
    numbers = cut_lineage(global_row_number(nodes.select("node_id").distinct(), ["node_id"], "number"))
    end = lambda c: numbers.select(F.col("node_id").alias(c), F.col("number").alias(f"{c}_number"))
    numbered = pairs.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst"))
    levels = louvain_levels(numbered, numbers.select(F.col("number").alias("id")))
    named = cut_lineage(levels.join(numbers.select(F.col("number").alias("id"), "node_id"), "id").select("node_id", "community", "level"))
    first = named.groupBy("level", "community").agg(F.min("node_id").alias("first"))
    out = cut_lineage(named.join(first, ["level", "community"]).select(F.col("node_id").alias("id"), F.col("first").alias("community"), "level"))
    for t in (numbers, named):
        release(t)
    return out, pairs


def build_communities(store: Store, embed: Callable[[DataFrame], DataFrame] | None = None,
                      summarise: Callable[[DataFrame], DataFrame] = extractive_summary) -> str:
    """Builds and stores the communities of the store's graph; returns the release.

    ``summarise`` maps member rows (community_id, node_id, chunk_type, summary) to (community_id, summary), ``embed`` adds ``vec`` to
    rows with a summary.  Communities of one node are dropped unless there are no others (GR6), at every level.  A node's
    ``community_id`` becomes its community of the top level, null if that was dropped.
    """
    nodes, edges = store.read("nodes"), store.read("edges")
    levels, pairs = node_levels(nodes, edges)
    tree = cut_lineage(community_tree(levels, pairs))
    some = tree.filter("n_members > 1").isEmpty()
    kept = cut_lineage(tree if some else tree.filter("n_members > 1"))
    members = levels.select(F.concat_ws(":", F.lit("comm"), F.col("level").cast("string"), "community").alias("community_id"),
                            F.col("id").alias("node_id"), "level").join(kept.select("community_id"), "community_id", "left_semi")
    members = cut_lineage(members)
    facts = nodes.select("node_id", "chunk_type", F.coalesce("summary", F.lit("")).alias("summary"))
    summaries = cut_lineage(summarise(members.join(facts, "node_id")))
    vectors = (embed or (lambda rows: embed_text(rows, "summary")))(summaries)
    communities = (kept.select("community_id", "level").join(vectors.select("community_id", "summary", F.col("vec").alias("embedding")), "community_id")
                   .withColumn("updated_at", F.current_timestamp()))
    top = levels.agg(F.max("level")).first()[0]
    # all members' ids are new, so a node without a community loses its old one
    own = members.filter(F.col("level") == F.lit(top)).select("node_id", "community_id")
    written = write_back_membership(nodes.withColumn("community_id", F.lit(None).cast("string")), own)
    done = store.commit_tables({"community_tree": kept, "community_members": members, "communities": communities, "nodes": written})
    for t in (levels, pairs, tree, kept, members, summaries):
        release(t)
    return done


def community_path(store: Store, node_ids: DataFrame) -> DataFrame:
    """``(node_id, community_id, level)`` of every community that a node lies in, from its top community down the stored members."""
    return store.read("community_members").join(node_ids.select("node_id").distinct(), "node_id", "left_semi")


def stored_ancestors(store: Store) -> DataFrame:
    """The ancestor closure of the stored tree."""
    return ancestors(store.read("community_tree"))
