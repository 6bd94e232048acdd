"""Whole-graph operators: simple graph, degrees, density, edge reports,
modularity and connected components (GR4 GR8 GR9 GR10, A3 A4 A9 A10, J4).

Graphs are two DataFrames: ``nodes(node_id)`` and ``edges(source_node_id,
target_node_id, ...)``.  The undirected algorithms take ``(src, dst)`` pairs
of any orderable id type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.schemas import CONFIDENCE_LEVELS
from graphloom.session import cut_lineage, release


def simple_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR4 + J4: undirected simple graph ``(src, dst)``, src <= dst.

    Edges with an endpoint that is not a node are dropped (two semi joins),
    multi-edges and both orientations collapse to one pair, self-loops stay.
    """
    ids = cut_lineage(nodes.select("node_id").distinct())
    named = edges.filter(F.col("source_node_id").isNotNull() & F.col("target_node_id").isNotNull())
    pairs = named.select(F.least("source_node_id", "target_node_id").alias("src"), F.greatest("source_node_id", "target_node_id").alias("dst"))
    # the first join deals the pairs by src: collapsing them there moves nothing again
    return (pairs.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").distinct()
            .join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR10: out/in/total degree per node (multi-edges counted), zero for isolated nodes."""
    out_d = edges.groupBy(F.col("source_node_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("out_degree"))
    in_d = edges.groupBy(F.col("target_node_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("in_degree"))
    return (nodes.select("node_id").distinct()
            .join(out_d, "node_id", "left").join(in_d, "node_id", "left")
            .select("node_id",
                    F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"),
                    F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))
            .withColumn("degree", F.col("out_degree") + F.col("in_degree")))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row - nodes, edges, edge density (edges/nodes), isolated nodes."""
    # One aggregation over node rows and edge rows (no join of the two counts).
    node_rows = degrees(nodes, edges).select(F.lit(0).alias("is_edge"), "degree")
    edge_rows = edges.select(F.lit(1).alias("is_edge"), F.lit(None).cast("long").alias("degree"))
    return (node_rows.unionByName(edge_rows)
            .agg(F.count_if(F.col("is_edge") == 0).alias("n_nodes"),
                 F.count_if(F.col("is_edge") == 1).alias("n_edges"),
                 F.count_if(F.col("degree") == 0).alias("n_isolated"))
            .select("n_nodes", "n_edges",
                    F.round(F.col("n_edges") / F.col("n_nodes"), 6).alias("edge_density"),
                    "n_isolated"))


def edge_report_cube(edges: DataFrame) -> DataFrame:
    """A10: edge counts by type x confidence with all sub-totals (CUBE)."""
    return edges.cube("type", "confidence").agg(F.count(F.lit(1)).alias("n_edges"))


def edge_type_summary(edges: DataFrame) -> DataFrame:
    """A3 + A4: sorted distinct edge types (CSV), counts per confidence, invalid ones."""
    conf = F.col("confidence")
    return edges.agg(
        F.array_join(F.sort_array(F.collect_set("type")), ", ").alias("edge_types"),
        F.count_if(conf == "deterministic").alias("n_deterministic"),
        F.count_if(conf == "probabilistic").alias("n_probabilistic"),
        F.count_if(conf == "inferred").alias("n_inferred"),
        F.count_if(~conf.isin(*CONFIDENCE_LEVELS) | conf.isNull()).alias("n_invalid"),
    )


def invalid_confidences(edges: DataFrame) -> DataFrame:
    """A4: ``(confidence, type, n_edges, first_edge)`` of the edges whose confidence is outside the domain, null included."""
    wrong = ~F.coalesce(F.col("confidence").isin(*CONFIDENCE_LEVELS), F.lit(False))
    return edges.filter(wrong).groupBy("confidence", "type").agg(F.count(F.lit(1)).alias("n_edges"), F.min("edge_id").alias("first_edge"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """GR8: Newman modularity of a labelling of an undirected simple graph.

    ``edges(src, dst)`` (one row per undirected edge), ``labels(id, comm)``.
    Q = sum_c [ L_c / m - (d_c / 2m)^2 ]; a self-loop adds 2 to the degree.
    Returns one row ``n_communities, n_edges, modularity``.
    """
    lab = cut_lineage(labels.select(F.col("id"), F.col("comm")))
    # the input edges are read once; every edge gives one row per end and one if it is inner
    e = cut_lineage(edges.select("src", "dst")
                    .join(lab.withColumnRenamed("id", "src").withColumnRenamed("comm", "cs"), "src", "left")
                    .join(lab.withColumnRenamed("id", "dst").withColumnRenamed("comm", "cd"), "dst", "left"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    part = lambda comm, l_c, d_c: F.struct(F.col(comm).alias("comm"), l_c.alias("l_c"), d_c.alias("d_c"))
    ends = (e.select(F.explode(F.array(
        part("cs", F.when(F.col("cs") == F.col("cd"), 1).otherwise(0).cast("long"), one),
        part("cd", zero, one))).alias("x")).select("x.*").filter("comm IS NOT NULL"))
    per = (ends.unionByName(lab.select("comm", zero.alias("l_c"), zero.alias("d_c")))
           .groupBy("comm").agg(F.sum("l_c").alias("l_c"), F.sum("d_c").alias("d_c")))
    rows = (per.select(F.lit(0).alias("is_edge"), "l_c", "d_c")
            .unionByName(e.select(F.lit(1).alias("is_edge"), zero.alias("l_c"), zero.alias("d_c"))))
    tot = rows.agg(F.count_if(F.col("is_edge") == 0).alias("n_communities"),
                   F.count_if(F.col("is_edge") == 1).alias("m"),
                   F.sum("l_c").alias("sum_l"),
                   F.sum(F.col("d_c").cast("double") * F.col("d_c")).alias("sum_d2"))
    return tot.select("n_communities", F.col("m").alias("n_edges"),
                      F.round(F.col("sum_l") / F.col("m")
                              - F.col("sum_d2") / (4.0 * F.col("m") * F.col("m")), 9)
                      .alias("modularity"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None,
                         max_rounds: int | None = None) -> DataFrame:
    """GR9: component label = smallest node id in the component.

    Min-label propagation with pointer jumping (label(u) <- label(label(u))),
    which cuts the rounds from the diameter to about its logarithm on most
    graphs.  Labels are never sent to every task, which each round would do again through
    the driver.  Runs until no label changes; a bound may be passed and raises
    when it is hit.  Every round is a written table, and tables two
    rounds old are deleted; the driver only reads the number of changed
    labels.  Returns ``id, component``.
    """
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    adj = cut_lineage(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter(
        F.col("u") != F.col("v")).distinct())
    ids = adj.select(F.col("u").alias("id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.select(F.col("node_id").alias("id")))
    labels = cut_lineage(ids.distinct().select("id", F.col("id").alias("label")))
    rounds = 0
    while True:
        if max_rounds is not None and rounds == max_rounds:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
        nb = (adj.join(labels.select(F.col("id").alias("v"), F.col("label").alias("lv")).hint("merge"), "v")
              .groupBy(F.col("u").alias("id")).agg(F.min("lv").alias("m")))
        step = (labels.join(nb.hint("merge"), "id", "left")
                .select("id", "label", F.least("label", F.coalesce("m", "label")).alias("low")))
        heads = step.select(F.col("id").alias("head"), F.col("low").alias("next"))
        new = cut_lineage(step.join(heads.hint("merge"), F.col("low") == F.col("head"), "left")
                          .select("id", F.col("label").alias("old"),
                                  F.least("low", F.coalesce("next", "low")).alias("label")))
        changed = new.filter(F.col("label") != F.col("old")).count()
        release(labels)
        labels, rounds = new, rounds + 1
        if changed == 0:
            return labels.select("id", F.col("label").alias("component"))
