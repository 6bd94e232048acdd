"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads whole tables (or views Spark derives from them); none
runs on literal input alone.  Column names equal those of the matching SQL
in ``graphloom.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import traverse as tv
from graphloom.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------ traversal ----

@register("blast_radius_regions")
def blast_radius_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR1/GR2: inbound depth-3 walk from every region, edges by hop/type/confidence."""
    t = tv.blast_radius(fx.ent_edges(spark, sf_dir), fx.ent_roots(spark, sf_dir, "region"),
                        fx.ent_nodes(spark, sf_dir), depth=3)
    return (t.edges.groupBy("root_id", "hop", "type", "confidence")
            .agg(F.count(F.lit(1)).alias("n_edges")))


@register("traverse_outbound_orders")
def traverse_outbound_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR1 outbound, depth 3, every order is a root."""
    t = tv.traverse(fx.ent_edges(spark, sf_dir), fx.ent_roots(spark, sf_dir, "orders"), 3,
                    "outbound")
    return t.edges.select("root_id", "edge_id", "hop")


@register("outbound_orders_by_hop")
def outbound_orders_by_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR1 outbound, depth 3, every order is a root: edges per root and hop, with a checksum of their ids."""
    part = F.conv(F.substring(F.md5("edge_id"), 1, 8), 16, 10).cast("long")
    return tv.edge_sums(fx.ent_edges(spark, sf_dir), fx.ent_roots(spark, sf_dir, "orders"), 3, "outbound", checksum=part)


@register("traverse_both_nations")
def traverse_both_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR1 both directions, depth 2, every nation is a root (U2, times_seen)."""
    t = tv.traverse(fx.ent_edges(spark, sf_dir), fx.ent_roots(spark, sf_dir, "nation"), 2, "both")
    return t.edges.select("root_id", "edge_id", "hop", "times_seen")


@register("traverse_fringe")
def traverse_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR1 with include_fringe: inbound depth 2 from every region, nodes incl. hop 2."""
    t = tv.traverse(fx.ent_edges(spark, sf_dir), fx.ent_roots(spark, sf_dir, "region"), 2,
                    "inbound", nodes=fx.ent_nodes(spark, sf_dir), include_fringe=True)
    return t.nodes.select("root_id", "node_id", "hop")


@register("weakest_path_confidence")
def weakest_path_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR2 + P16: weakest confidence on the strongest shortest path, counted per hop."""
    t = tv.blast_radius(fx.ent_edges(spark, sf_dir), fx.ent_roots(spark, sf_dir, "region"),
                        fx.ent_nodes(spark, sf_dir), depth=3)
    return (t.nodes.groupBy("root_id", "hop", "weakest_confidence")
            .agg(F.count(F.lit(1)).alias("n_nodes")))


@register("connect_pairs")
def connect_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR3: how each (customer, supplier) pair of an order line connects."""
    from graphloom.session import read_table
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = (li.join(od, li.l_orderkey == od.o_orderkey)
             .select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("a"),
                     F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("b")))
    return tv.connect_pairs(fx.ent_edges(spark, sf_dir), pairs)


@register("connect_paths")
def connect_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR3: paths of one and two edges between the customer and the supplier of each order line and between each customer and
    its region: edge ids, types, directions, weakest confidence."""
    from graphloom.session import read_table
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = lambda c: F.concat(F.lit("c:"), F.col(c).cast("string")).alias("a")
    pairs = (li.join(od, li.l_orderkey == od.o_orderkey)
             .select(customer("o_custkey"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("b")))
    nation = read_table(spark, sf_dir, "nation")
    home = (read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(customer("c_custkey"), F.explode(F.array(F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")),
                                                             F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")))).alias("b")))
    found = tv.connect_paths(fx.ent_edges(spark, sf_dir), pairs.unionByName(home))
    return found.select("a", "b", "hops", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("nodes", "edge_ids", "types", "forward")],
                        "weakest_confidence", "n_parallel")


# ------------------------------------------------------- graph reports ----

@register("degrees_density")
def degrees_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR10: out/in/total degree of every ENT node (isolated nodes included)."""
    from graphloom.operators.graph import degrees
    return degrees(fx.ent_nodes(spark, sf_dir), fx.ent_edges(spark, sf_dir))


@register("graph_summary")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges, edge density, isolated nodes of ENT."""
    from graphloom.operators.graph import graph_summary as gs
    return gs(fx.ent_nodes(spark, sf_dir), fx.ent_edges(spark, sf_dir))


@register("edge_type_confidence_cube")
def edge_type_confidence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: ENT edges by type x confidence with CUBE sub-totals."""
    from graphloom.operators.graph import edge_report_cube
    return edge_report_cube(fx.ent_edges(spark, sf_dir))


@register("edge_type_summary")
def edge_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + A4: edge type list and confidence counts of ENT."""
    from graphloom.operators.graph import edge_type_summary as ets
    return ets(fx.ent_edges(spark, sf_dir))


@register("invalid_confidences")
def invalid_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: ENT edges of urgent orders and of returned lines with a confidence outside the domain, listed by value and type."""
    from graphloom.operators.graph import invalid_confidences as ic
    e = fx.ent_edges(spark, sf_dir)
    odd = (F.when(F.col("evidence") == "1-URGENT", F.lit("certain")).when((F.col("evidence") == "F") & (F.col("confidence") == "inferred"), F.lit(None).cast("string"))
           .otherwise(F.col("confidence")))
    return ic(e.withColumn("confidence", odd))


@register("simple_graph")
def simple_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR4 + J4: undirected simple graph of ENT."""
    from graphloom.operators.graph import simple_graph as sg
    return sg(fx.ent_nodes(spark, sf_dir), fx.ent_edges(spark, sf_dir))


# --------------------------------------------------------------- vectors ----

def _node_vectors(spark, sf_dir, name):
    """Vectors under the node ids of the store (strings)."""
    return fx.embedding_vectors(spark, sf_dir).select(
        F.concat(F.lit("doc:"), F.col("vec_id").cast("string")).alias(name), F.col("embedding").alias("vec"), "vec_id")


def _vector_topk(spark, sf_dir, metric):
    """Queries: every vector whose id is divisible by 100, against all vectors."""
    from graphloom.operators.vectors import topk
    r = topk(_node_vectors(spark, sf_dir, "query_id").filter("vec_id % 100 = 0"), _node_vectors(spark, sf_dir, "item_id"),
             5, metric, exclude_self=True)
    return r.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@register("vector_topk_dot")
def vector_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: 5 nearest other vectors of the query vectors by dot product."""
    return _vector_topk(spark, sf_dir, "dot")


@register("vector_topk_l2")
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: 5 nearest other vectors of the query vectors by Euclidean distance."""
    return _vector_topk(spark, sf_dir, "l2")


@register("vector_topk_cosine")
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: 5 most cosine-similar other vectors of the query vectors."""
    return _vector_topk(spark, sf_dir, "cosine")


@register("vector_topk_approx")
def vector_topk_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the query vectors' 5 best by sign hashes against the exact ones, for cosine and dot: queries, queries without
    five rows, whether nine tenths of the neighbours are found and whether all scores are exact."""
    from graphloom.operators.signhash import approx_topk, recall
    from graphloom.operators.vectors import topk
    from graphloom.session import cut_lineage
    q, c = _node_vectors(spark, sf_dir, "query_id").filter("vec_id % 100 = 0"), _node_vectors(spark, sf_dir, "item_id")
    out = None
    for metric in ("cosine", "dot"):
        exact = cut_lineage(topk(q, c, 5, metric, exclude_self=True))
        found = cut_lineage(approx_topk(q, c, 5, metric, exclude_self=True))
        both = found.join(exact.select("query_id", "item_id", F.col("score").alias("right")), ["query_id", "item_id"])
        wrong = both.agg(F.count_if(F.abs(F.col("score") - F.col("right")) > 1e-9).alias("n_wrong"), F.lit(1).alias("one"))
        full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rows"))
        rows = (recall(found, exact).join(full, "query_id", "left")
                .agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(F.coalesce("n_rows", F.lit(0)) < F.col("n_exact")).alias("n_short"),
                     (F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("recall_ok"), F.lit(1).alias("one"))
                .join(wrong, "one").select(F.lit(metric).alias("metric"), "n_queries", "n_short", "recall_ok", "n_wrong"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("vector_topk_communities")
def vector_topk_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: 3 best community centroids (mean vector per label) for every vector."""
    from graphloom.operators.vectors import centroids, topk
    v = fx.embedding_vectors(spark, sf_dir)
    cent = centroids(v.select("label", F.col("embedding").alias("vec")), "label")
    r = topk(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")),
             cent.select(F.col("label").alias("item_id"), "vec"), 3, "cosine")
    return r.select("query_id", F.col("item_id").alias("community"),
                    F.round("score", 6).alias("score"), "rank")


@register("knn_graph")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN fixture: undirected 5-NN graph over embeddings (dot product)."""
    return fx.knn_edges(spark, sf_dir).select("src", "dst", F.round("score", 6).alias("score"))


@register("modularity_labels")
def modularity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR8: modularity of the language labelling on the document graph."""
    from graphloom.operators.graph import modularity
    return modularity(fx.doc_links(spark, sf_dir), fx.doc_labels(spark, sf_dir))


@register("connected_components")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR9: components of the document graph (linked documents only)."""
    from graphloom.operators.graph import connected_components as cc
    return cc(fx.doc_links(spark, sf_dir))


# ----------------------------------------------------------- corrections ----

@register("corrections_capture")
def corrections_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections captured from dialogue turns (user right after assistant)."""
    return fx.cor_corrections(spark, sf_dir).select(
        "correction_id", "session_id", "target_type", "target_id", "original", "corrected")


@register("corrections_search")
def corrections_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark question against every captured correction (exact rule)."""
    from graphloom.operators.corrections import search_corrections
    return search_corrections(fx.benchmark_questions(spark, sf_dir),
                              fx.cor_corrections(spark, sf_dir))


@register("correction_postings")
def correction_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, factorised: question words and the corrections whose text holds them (linear output)."""
    from graphloom.operators.corrections import correction_postings as cp
    return cp(fx.benchmark_questions(spark, sf_dir), fx.cor_corrections(spark, sf_dir))


@register("corrections_by_source")
def corrections_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + A7: corrections of the document nodes of every source file."""
    from graphloom.operators.corrections import corrections_by_file
    nodes = fx.doc_nodes(spark, sf_dir)
    files = nodes.select("source_file")
    return corrections_by_file(files, nodes, fx.cor_corrections(spark, sf_dir, doc_target=True))


@register("corrections_named")
def corrections_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each correction's target names: a node id, a path with a scheme, a concept name, its last part, or nothing."""
    from graphloom.operators.aliases import resolve_targets
    return resolve_targets(fx.named_corrections(spark, sf_dir), fx.named_nodes(spark, sf_dir))


@register("corrections_of_files")
def corrections_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of every document file, found by path, node id or concept name."""
    from graphloom.operators.aliases import corrections_of_files as cf
    nodes = fx.named_nodes(spark, sf_dir)
    written = nodes.select(F.concat(F.lit("file:./"), F.col("source_file")).alias("source_file"))
    return cf(written, nodes, fx.named_corrections(spark, sf_dir))


CORRECTION_SPLIT_TURN = 4


@register("correction_before_after")
def correction_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question/correction matches that appear only after later turns are captured.

    "Before" holds the corrections captured from turns < 4 of each dialogue,
    "after" all of them; the result is after EXCEPT before.
    """
    from graphloom.operators.corrections import new_matches
    from graphloom.session import cut_lineage
    cor = cut_lineage(fx.cor_corrections(spark, sf_dir))  # both states are read from it
    return new_matches(fx.benchmark_questions(spark, sf_dir), cor.filter(F.col("turn") < CORRECTION_SPLIT_TURN), cor)


# ---------------------------------------------------------------- ledger ----

def _runlog_rollup(spark, sf_dir, key):
    from graphloom.operators.ledger import aggregate_runs
    a = aggregate_runs(fx.run_log(spark, sf_dir), key)
    return a.withColumn("cost_usd", F.bround("cost_usd", 6).cast("double"))


@register("runlog_aggregate")
def runlog_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: run-log roll-up by orchestrator model (missing -> 'unknown')."""
    return _runlog_rollup(spark, sf_dir, "orchestrator_model")


@register("runlog_aggregate_sprint")
def runlog_aggregate_sprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: run-log roll-up by sprint."""
    return _runlog_rollup(spark, sf_dir, "sprint")


@register("runlog_filter")
def runlog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt v003, suite prefix 'click', model containing '-1', passed is true."""
    from graphloom.operators.ledger import filter_runs
    r = filter_runs(fx.run_log(spark, sf_dir), prompt="v003", suite_prefix="click",
                    model_substring="-1", passed=True)
    return r.select("event_id", "sprint", "prompt_version", "suite_version",
                    "orchestrator_model", "passed")


@register("runlog_failed_canonical")
def runlog_failed_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13 + P14: failed (false, not null) canonical runs of sprint 'view'."""
    from graphloom.operators.ledger import filter_runs
    r = filter_runs(fx.run_log(spark, sf_dir), sprint="view", failed=True, canonical=True)
    return r.select("event_id", "sprint", "passed", "canonical")


@register("run_numbers")
def run_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run number of every run, ordered by (ts, event_id), without a one-partition window."""
    from graphloom.operators.ledger import global_row_number
    r = fx.run_log(spark, sf_dir).select("event_id", "ts")
    return global_row_number(r, ["ts", "event_id"]).select("event_id", "run_num")


@register("suite_fingerprint")
def suite_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 + F6 + W3: fingerprint per (source, lang) snapshot, versions per source."""
    from graphloom.operators.ledger import assign_versions, content_fingerprint
    from graphloom.session import read_table
    docs = read_table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "text")
    snaps = content_fingerprint(docs.withColumn("snap", F.struct("source", "lang")),
                                "snap", "doc_id", "text")
    snaps = snaps.select(F.col("snap.source").alias("source"), F.col("snap.lang").alias("lang"),
                         "n_files", "fingerprint")
    return assign_versions(snaps, "source", "lang").select(
        "source", "lang", "n_files", "fingerprint", "version")


@register("version_notes")
def version_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 + F12: change notes per dialogue turn (suite = conversation, name = role)."""
    from graphloom.operators.ledger import version_notes as vn
    from graphloom.session import read_table
    c = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("suite"), F.col("turn").alias("version_no"),
        F.col("role").alias("name"), F.col("text").alias("content"))
    return vn(c)


def _canonical_versions(spark, sf_dir):
    """Validity of prompt versions per sprint, from the canonical runs."""
    from graphloom.operators.versions import validity
    runs = fx.run_log(spark, sf_dir)
    return runs, validity(runs.filter("canonical").select(F.col("sprint").alias("suite"), F.col("ts").alias("at"), F.col("prompt_version").alias("version")))


@register("version_intervals")
def version_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: when each prompt version was in force in a sprint (canonical runs); a version that returns has several intervals."""
    return _canonical_versions(spark, sf_dir)[1]


@register("version_index")
def version_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: one row per sprint and prompt version: first and last start, intervals, snapshots, whether it is in force."""
    from graphloom.operators.versions import version_index as vi
    return vi(_canonical_versions(spark, sf_dir)[1])


@register("runs_as_of")
def runs_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: every run with the canonical prompt version that was in force in its sprint when it ran."""
    from graphloom.operators.versions import as_of
    runs, intervals = _canonical_versions(spark, sf_dir)
    found = as_of(runs.select("event_id", "sprint", "ts", "prompt_version"), intervals, "sprint", "ts")
    return found.select("event_id", "sprint", "prompt_version", F.col("version").alias("version_in_force"), "valid_from")


# ----------------------------------------------------------- communities ----

def _doc_component_labels(spark, sf_dir):
    """Components of the document graph over all documents (isolated ones alone)."""
    from graphloom.operators.graph import connected_components as cc
    v = fx.doc_labels(spark, sf_dir).select(F.col("id").alias("node_id"))
    lab = cc(fx.doc_links(spark, sf_dir), nodes=v)
    return lab.select(F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("node_id"),
                      F.concat(F.lit("doc:"), F.col("component").cast("string")).alias("comm"))


def _louvain(spark, sf_dir, links):
    from graphloom.operators.louvain import louvain
    return louvain(links, nodes=fx.doc_labels(spark, sf_dir).select("id"))[0]


@register("louvain_communities")
def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR5: Louvain communities of the document graph (see louvain_invariants for its SQL)."""
    return _louvain(spark, sf_dir, fx.doc_links(spark, sf_dir)).select("id", "community")


@register("louvain_invariants")
def louvain_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR5: what any Louvain result must satisfy - every document once, no community
    across two components, modularity (GR8) not below that of the components."""
    from graphloom.operators.graph import connected_components as cc, modularity
    from graphloom.session import cut_lineage
    links = cut_lineage(fx.doc_links(spark, sf_dir))
    nodes = fx.doc_labels(spark, sf_dir).select("id")
    found = cut_lineage(_louvain(spark, sf_dir, links).select("id", "community"))
    parts = cut_lineage(cc(links, nodes=nodes.select(F.col("id").alias("node_id"))))
    mixed = (found.join(parts, "id").groupBy("community")
             .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")))
    counts = mixed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_assigned"), F.count_if(F.col("lo") != F.col("hi")).alias("n_mixed"))
    total = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    q = modularity(links, found.withColumnRenamed("community", "comm")).select(F.col("modularity").alias("q"))
    base = modularity(links, parts.withColumnRenamed("component", "comm")).select(F.col("modularity").alias("component_modularity"))
    # four one-row tables
    rows = [t.withColumn("one", F.lit(1)) for t in (total, counts, q, base)]
    out = rows[0]
    for t in rows[1:]:
        out = out.join(t, "one")
    return out.select("n_nodes", "n_assigned", "n_mixed", "component_modularity",
                      (F.col("q") >= F.col("component_modularity") - 1e-9).alias("modularity_ok"))


@register("community_tree")
def community_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR7: parents, sizes, children and edge weights of the trade hierarchy (kind in a nation, nation, region)."""
    from graphloom.operators.hierarchy import community_tree as ct
    return ct(fx.trade_levels(spark, sf_dir), fx.trade_edges(spark, sf_dir))


@register("community_closure")
def community_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR7: every community with all communities above it, and the members and inner edges found below each."""
    from graphloom.operators.hierarchy import ancestors, community_tree as ct, rolled_up
    from graphloom.session import cut_lineage
    tree = cut_lineage(ct(fx.trade_levels(spark, sf_dir), fx.trade_edges(spark, sf_dir)))
    closure = cut_lineage(ancestors(tree))
    below = rolled_up(closure, tree.filter("level = 0"), "n_members", "inner_weight")
    return (closure.join(below.select(F.col("community_id").alias("ancestor_id"), F.col("n_members").alias("n_below"),
                                      F.col("inner_weight").alias("inner_below")), "ancestor_id")
            .select("community_id", "ancestor_id", "distance", "n_below", "inner_below"))


@register("louvain_tree")
def louvain_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR5 + GR7 on a graph with communities inside its components (entities and what they belong to):
    what every right Louvain hierarchy has, next to the modularity of components and of nations."""
    from graphloom.operators.graph import modularity
    from graphloom.operators.hierarchy import community_tree as ct, louvain_levels
    from graphloom.session import cut_lineage
    nodes, edges = (cut_lineage(t) for t in fx.forest(spark, sf_dir))
    levels = cut_lineage(louvain_levels(edges, nodes.select("id"), follow=True))
    tree = cut_lineage(ct(levels, edges))
    top = levels.agg(F.max("level")).first()[0]
    up = tree.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("community_id")).agg(F.sum("n_members").alias("below"))
    sums = tree.join(up, "community_id", "left").agg(
        F.sum(F.when(F.col("level") == top, F.col("n_members"))).alias("n_assigned"),
        F.count_if((F.col("level") > 0) & ~F.col("below").eqNullSafe(F.col("n_members"))).alias("n_wrong_sums"),
        (F.max("level") >= 1).alias("several_levels"))
    final = levels.filter(F.col("level") == top)
    mixed = (final.join(nodes.select("id", "region"), "id").groupBy("community").agg(F.countDistinct("region").alias("n"))
             .agg(F.count_if(F.col("n") > 1).alias("n_mixed")))
    q = {}
    for name, labels in (("q", final.select("id", F.col("community").alias("comm"))),
                         ("component_modularity", nodes.select("id", F.col("region").alias("comm"))),
                         ("nation_modularity", nodes.select("id", F.coalesce("nation", F.lit(-1) - F.col("region")).alias("comm")))):
        q[name] = modularity(edges, labels).select(F.col("modularity").alias(name))
    total = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    rows = [t.withColumn("one", F.lit(1)) for t in (total, sums, mixed, *q.values())]  # one row each
    out = rows[0]
    for t in rows[1:]:
        out = out.join(t, "one")
    return out.select("n_nodes", "n_assigned", "n_wrong_sums", "n_mixed", "several_levels", "component_modularity", "nation_modularity",
                      (F.col("q") > F.col("component_modularity") + 0.05).alias("above_components"),
                      (F.col("q") >= 0.98 * F.col("nation_modularity")).alias("near_nations"))


@register("store_communities")
def store_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR4 -> GR5 -> GR7 -> GR6 -> EM2 -> EM1 -> GR11 -> J7 on a store with the documents and their links, as one release: every
    document with its stored community, that community's members, and whether a summary and a vector were stored."""
    from graphloom.operators.community_build import build_communities
    from graphloom.sources.store import Store
    store = Store(spark, _scratch(spark, "community-store"))
    store.ensure_tables()
    node = lambda c: F.concat(F.lit("doc:"), F.col(c).cast("string"))
    docs = fx.doc_nodes(spark, sf_dir)
    store.append_nodes(docs.select("node_id", "language", "source_file", "chunk_type", "raw_cleaned",
                                   F.concat(F.lit("doc "), F.coalesce(F.substring("summary", 1, 100), F.lit(""))).alias("summary")))
    store.append_edges(fx.doc_links(spark, sf_dir).select(
        F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string")).alias("edge_id"), node("src").alias("source_node_id"),
        node("dst").alias("target_node_id"), F.lit("SAME").alias("type"), F.lit("deterministic").alias("confidence")))
    build_communities(store)
    sizes = store.read("community_tree").select("community_id", "n_members")
    listed = store.read("community_members").groupBy("community_id").agg(F.count(F.lit(1)).alias("n_listed"))
    texts = store.read("communities").select("community_id", (F.length("summary") > 0).alias("has_summary"),
                                             (F.size("embedding") == 64).alias("has_vector"))
    own = store.read("nodes").select("node_id", "community_id")
    facts = sizes.join(listed, "community_id").join(texts, "community_id")
    return own.join(facts, "community_id", "left").select(
        "node_id", F.regexp_replace("community_id", "^comm:[0-9]+:", "").alias("first_member"), "n_members", "n_listed", "has_summary", "has_vector")


@register("community_members")
def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR6 + A8 + U4 + K8: member rows of the document graph's components (singletons dropped)."""
    from graphloom.operators.communities import community_rows
    return community_rows(_doc_component_labels(spark, sf_dir), fx.doc_nodes(spark, sf_dir))


@register("membership_writeback")
def membership_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community ids written back to the document nodes."""
    from graphloom.operators.communities import community_rows, write_back_membership
    nodes = fx.doc_nodes(spark, sf_dir)
    members = community_rows(_doc_component_labels(spark, sf_dir), nodes)
    return write_back_membership(nodes, members.select("node_id", "community_id")).select(
        "node_id", "community_id")


@register("community_corrections")
def community_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR12: corrections of the members of every community, as rows."""
    from graphloom.operators.communities import community_rows
    from graphloom.operators.corrections import community_corrections as cc
    members = community_rows(_doc_component_labels(spark, sf_dir), fx.doc_nodes(spark, sf_dir))
    return cc(members, fx.cor_corrections(spark, sf_dir, doc_target=True)).select("community_id", "node_id", "correction_id")


@register("corrections_for_documents")
def corrections_for_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 + J10: corrections whose target is an English document node (semi join on the target)."""
    from graphloom.operators.corrections import corrections_for_targets
    nodes = fx.doc_nodes(spark, sf_dir).filter("language = 'en'").select(F.col("node_id").alias("target_id"))
    return corrections_for_targets(nodes, fx.cor_corrections(spark, sf_dir, doc_target=True)).select(
        "correction_id", "target_id", "corrected")


@register("chunk_correction_context")
def chunk_correction_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM3: every document node with the corrections that concern it (left join on the node)."""
    from graphloom.operators.corrections import corrections_by_file, with_correction_context
    nodes = fx.doc_nodes(spark, sf_dir).select("node_id", "source_file")
    by_file = corrections_by_file(nodes.select("source_file"), nodes, fx.cor_corrections(spark, sf_dir, doc_target=True))
    return with_correction_context(nodes, by_file).select("node_id", "source_file", "correction_id")


@register("document_summaries")
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM2: lead summary of every document (the leading sentences within 400 characters are the feature)."""
    from graphloom.operators.communities import lead_summary
    return lead_summary(fx.doc_nodes(spark, sf_dir)).select("node_id", "summary")


# ----------------------------------------------- extraction, files, gaps ----

@register("html_chunks")
def html_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headings, links and paragraphs of every page."""
    from graphloom.operators.extract import html_chunks as hc
    from graphloom.session import read_table
    return hc(read_table(spark, sf_dir, "pages"))


@register("unresolved_links")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LNK edges whose target is not a known node, by type and confidence."""
    from graphloom.operators.gaps import unresolved_edges
    return unresolved_edges(fx.lnk_nodes(spark, sf_dir), fx.lnk_edges(spark, sf_dir))


@register("gap_report")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 + G3 + G4: one long table of gaps (files without extractor, unresolved
    and low-confidence edges)."""
    from graphloom.operators.gaps import gap_report as gr
    from graphloom.operators.extract import match_extractors
    _, unmatched = match_extractors(fx.document_files(spark, sf_dir), fx.registry(spark))
    return gr(unmatched_files=unmatched, nodes=fx.lnk_nodes(spark, sf_dir),
              edges=fx.lnk_edges(spark, sf_dir), scored_edges=fx.ent_edges(spark, sf_dir))


@register("cross_site_segment_match")
def cross_site_segment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 + F13: links matched to page paths (exact) or to a route's first segment."""
    from graphloom.operators.infer import route_matches
    return route_matches(fx.lnk_nodes(spark, sf_dir), fx.lnk_edges(spark, sf_dir))


@register("api_calls")
def api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's call matched to a contract by operation, fixed path, route template or its fixed segments."""
    from graphloom.operators.routes import match_calls
    routes, specs, calls = fx.api_tables(spark, sf_dir)
    return match_calls(calls, routes, specs)


@register("api_contracts")
def api_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract nodes, from specs or made from the route, with the edge from every route."""
    from graphloom.operators.routes import contract_edges, contracts
    routes, specs, _ = fx.api_tables(spark, sf_dir)
    return contract_edges(contracts(routes, specs))


@register("cross_file_edges")
def cross_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as references to brand names, suppliers and customers as definitions of nation
    names: local, unique, ambiguous and unresolved references all occur."""
    from graphloom.operators.infer import infer_cross_file_edges
    refs, defs = fx.symbol_tables(spark, sf_dir)
    return infer_cross_file_edges(refs, defs).select("source_node_id", "target_node_id", "type", "confidence", "evidence")


@register("registry_match")
def registry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 + J6: every document file with the extractor registered for its type."""
    from graphloom.operators.extract import match_extractors
    matched, _ = match_extractors(fx.document_files(spark, sf_dir), fx.registry(spark))
    return matched.select("doc_id", "file_type", "skill_id")


@register("files_without_extractor")
def files_without_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of document files per type that no extractor covers."""
    from graphloom.operators.extract import match_extractors
    _, unmatched = match_extractors(fx.document_files(spark, sf_dir), fx.registry(spark))
    return unmatched.groupBy("file_type").agg(F.count(F.lit(1)).alias("n_files"))


@register("language_samples")
def language_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: per language the head of its first document file by path (the head is the feature)."""
    from graphloom.functions.text import ext_language, extension
    from graphloom.sources.files import sample_heads
    return sample_heads(fx.document_files(spark, sf_dir).select(
        "path", "text", ext_language(extension("path")).alias("language")))


@register("normalised_paths")
def normalised_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document file paths written with a scheme or a leading ./ compare equal after normalising."""
    from graphloom.functions.text import normalise_path
    f = fx.document_files(spark, sf_dir)
    raw = F.concat(F.element_at(F.array(F.lit(""), F.lit("./"), F.lit("file://"), F.lit("file:./")),
                                (F.pmod(F.col("doc_id"), F.lit(4)) + 1).cast("int")), F.col("path"))
    return f.select("doc_id", raw.alias("written"), normalise_path(raw).alias("path"))


@register("ext_language_map")
def ext_language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 + F2: extension and language of every document file path."""
    from graphloom.functions.text import ext_language, extension
    f = fx.document_files(spark, sf_dir)
    return f.select("doc_id", "path", extension("path").alias("ext"),
                    ext_language(extension("path")).alias("language"))


def _contract_nodes(spark, sf_dir):
    d = fx.doc_nodes(spark, sf_dir)
    did = F.col("doc_id")
    return d.select(
        "node_id", "language", "source_file", "raw_cleaned", "doc_id",
        F.when(F.pmod(did, F.lit(11)) == 0, F.lit(None).cast("string"))
        .otherwise(F.col("chunk_type")).alias("chunk_type"),
        F.when(F.pmod(did, F.lit(9)) == 0, F.lit("")).otherwise(F.col("summary")).alias("summary"),
        F.array(
            F.struct(F.concat(F.lit("src:"), F.col("source_file")).alias("target"),
                     F.lit("BELONGS_TO").alias("type"),
                     F.element_at(F.array(F.lit("deterministic"), F.lit("probabilistic"),
                                          F.lit("bogus"), F.lit(None).cast("string")),
                                  (F.pmod(did, F.lit(4)) + 1).cast("int")).alias("confidence"),
                     F.lit("source").alias("evidence")),
            F.struct(F.when(F.pmod(did, F.lit(5)) == 0, F.lit(""))
                     .otherwise(F.concat(F.lit("lang:"), F.col("language"))).alias("target"),
                     F.lit("WRITTEN_IN").alias("type"),
                     F.lit("inferred").alias("confidence"),
                     F.lit("lang").alias("evidence"))).alias("edges"))


@register("contract_validation")
def contract_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 + P12: document chunks with blanked fields split into valid / rejected."""
    from graphloom.operators.extract import validate_nodes
    valid, rejected = validate_nodes(_contract_nodes(spark, sf_dir).drop("edges", "doc_id"))
    return (valid.select("node_id", F.lit(True).alias("valid"), F.lit("").alias("errors"))
            .unionByName(rejected.select("node_id", F.lit(False).alias("valid"),
                                         F.array_join("errors", ", ").alias("errors"))))


@register("inline_edges")
def inline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 + P9 + P8: inline edges exploded, empty targets skipped, confidence coerced."""
    from graphloom.operators.extract import explode_inline_edges
    return explode_inline_edges(_contract_nodes(spark, sf_dir))


@register("json_repair")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model-style responses built from every dialogue turn (code fence,
    triple-quoted value, raw newlines in strings) repaired and parsed."""
    from graphloom.functions.text import repair_json
    from graphloom.session import read_table
    c = read_table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("```json\n{\"conv\": "), F.col("conv_id").cast("string"),
                   F.lit(", \"turn\": "), F.col("turn").cast("string"),
                   F.lit(", \"role\": \"\"\""), F.col("role"),
                   F.lit("\"\"\", \"text\": \""), F.col("text"), F.lit("\"}\n```"))
    schema = "conv long, turn long, role string, text string"
    parsed = c.select("conv_id", "turn", "text",
                      F.from_json(repair_json(raw), schema).alias("j"))
    return parsed.select(
        "conv_id", "turn", F.col("j.role").alias("role"),
        (F.col("j.conv").isNotNull() & (F.col("j.conv") == F.col("conv_id"))).alias("parsed"),
        F.coalesce(F.col("j.text") == F.col("text"), F.lit(False)).alias("text_ok"))


# ------------------------------------------------- questions and quality ----

@register("question_routing")
def question_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of every question form about every nation and supplier (all routes occur)
    and of every benchmark item (rule table, first match wins)."""
    from graphloom.operators.context import route_questions
    q = fx.entity_questions(spark, sf_dir).select("question_id", "text").unionByName(
        fx.benchmark_questions(spark, sf_dir).select(
            F.concat(F.lit("item:"), F.col("question_id").cast("string")).alias("question_id"), "text"))
    return route_questions(q).select("question_id", "route", "target", "direction", "depth")


@register("question_walks")
def question_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 -> GR1: the questions that ask for a walk, walked from their entity in the routed
    direction and to the routed depth; edges counted by question and hop."""
    from graphloom.operators.context import route_questions
    from graphloom.session import cut_lineage
    routed = cut_lineage(route_questions(fx.entity_questions(spark, sf_dir).filter("node_id LIKE 's:%' AND form IN (0, 2, 4)"))
                         .select("question_id", "node_id", "direction", "depth"))
    edges = fx.ent_edges(spark, sf_dir)
    parts = []
    for direction, depth in [("inbound", 3), ("inbound", 2), ("outbound", 2)]:
        asked = routed.filter((F.col("direction") == direction) & (F.col("depth") == depth))
        walk = tv.traverse(edges, asked.select(F.col("node_id").alias("root_id")).distinct(), depth, direction)
        n = walk.edges.groupBy("root_id", "hop").agg(F.count(F.lit(1)).alias("n_edges"))
        parts.append(asked.join(n, asked.node_id == n.root_id).select("question_id", "hop", "n_edges"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("question_walks_routed")
def question_walks_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 -> GR1 as `question_walks`, for every question that is routed to a walk: nations and
    suppliers, every form, both directions too.  Each root is walked once a direction, to the largest depth asked of it:
    what a hop has does not depend on the depth."""
    from graphloom.operators.context import ROUTING_RULES, route_questions
    from graphloom.session import cut_lineage
    routed = cut_lineage(route_questions(fx.entity_questions(spark, sf_dir)).filter("direction <> 'none'")
                         .select("question_id", "node_id", "direction", "depth"))
    edges = fx.ent_edges(spark, sf_dir)
    far = cut_lineage(routed.groupBy("direction", F.col("node_id").alias("root_id")).agg(F.max("depth").alias("depth")))
    counts = []
    for direction, depth in sorted({rule[3:] for rule in ROUTING_RULES if rule[3] != "none"}):
        roots = far.filter((F.col("direction") == direction) & (F.col("depth") == depth)).select("root_id")
        if not roots.isEmpty():
            counts.append(tv.edge_sums(edges, roots, depth, direction)
                          .select(F.col("root_id").alias("node_id"), F.lit(direction).alias("direction"), "hop", "n_edges"))
    if not counts:
        return routed.limit(0).select("question_id", F.lit(0).alias("hop"), F.lit(0).cast("long").alias("n_edges"))
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return routed.join(every, ["node_id", "direction"]).filter("hop < depth").select("question_id", "hop", "n_edges")


@register("quality_checks")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 + U1 + F10: run assertions on ENT and on benchmark texts used as answers."""
    from graphloom.operators.gaps import quality_checks as qc
    answers = fx.benchmark_questions(spark, sf_dir).select(
        F.col("question_id").alias("answer_id"), "text")
    return qc(fx.ent_nodes(spark, sf_dir), fx.ent_edges(spark, sf_dir), answers,
              min_nodes=8, min_files=3, min_deterministic=1,
              expected_edge_types=("IMPORTS", "CALLS", "INHERITS"),
              keywords=("order", "service", "the"), min_answer_length=100)


@register("run_assertions")
def run_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 + A12: the whole rule table on an extractor per nation, ENT, region communities and benchmark texts as answers;
    passing and failing rows of every rule with a subject."""
    from graphloom.operators.assertions import answer_rules, check_run, community_rules, extractor_rules, graph_rules
    comms = fx.region_communities(spark, sf_dir).withColumn(
        "summary", F.when(F.col("community_id") == "comm:r:3", F.lit(None).cast("string")).otherwise(F.col("summary")))
    tables = {"registry": fx.checked_registry(spark, sf_dir), "nodes": fx.ent_nodes(spark, sf_dir), "edges": fx.ent_edges(spark, sf_dir),
              "communities": comms, "answers": fx.benchmark_questions(spark, sf_dir).withColumnRenamed("question_id", "answer_id")}
    rules = (extractor_rules("native-parser", "python") + graph_rules(8, 7, 1, ("IMPORTS", "CALLS")) + community_rules(4)
             + answer_rules(("order", "service", "thth"), 100))
    return check_run(rules, tables)


@register("run_summary")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a run that stores ENT and the region communities, with the events as its model calls: counted while written."""
    from graphloom.session import read_table
    from graphloom.sources.store import Store
    store = Store(spark, _scratch(spark, "run-store"))
    store.ensure_tables()
    edges = fx.ent_edges(spark, sf_dir).withColumn("confidence", F.when(F.col("confidence") == "inferred", "guessed").otherwise(F.col("confidence")))
    calls = read_table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("in_tokens"),
                                                       F.pmod("event_id", F.lit(1000)).alias("out_tokens"), F.col("value").alias("cost_usd"))
    nodes = fx.ent_nodes(spark, sf_dir).withColumn("summary", F.when(F.col("node_id").startswith("r:"), "").otherwise(F.col("summary")))
    row = store.write_run(nodes, edges, fx.region_communities(spark, sf_dir), calls)
    return row.withColumn("cost_usd", F.col("cost_usd").cast("double")).withColumn("timed", F.col("duration_s") > 0).drop("duration_s")


def _versioned_doc_nodes(spark, sf_dir):
    """An append-only node table with two versions of the English documents."""
    d = fx.doc_nodes(spark, sf_dir)
    v1 = d.select("node_id", "summary", F.lit("2024-01-01 00:00:00").cast("timestamp")
                  .alias("updated_at"))
    v2 = d.filter(F.col("language") == "en").select(
        "node_id", F.concat(F.lit("Second version. "), F.col("raw_cleaned")).alias("summary"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("updated_at"))
    return v1.unionByName(v2)


@register("node_lookup")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest version of every requested node id (all document ids requested)."""
    from graphloom.operators.search import lookup_nodes
    wanted = fx.doc_nodes(spark, sf_dir).select("node_id")
    found = lookup_nodes(_versioned_doc_nodes(spark, sf_dir), wanted)
    return found.select("node_id", F.length("summary").alias("summary_len"),
                        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@register("list_nodes")
def list_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: first 200 ENT nodes in (created_at, node_id) order, no vectors (limit is the feature)."""
    from graphloom.operators.search import list_nodes as ln
    n = fx.ent_nodes(spark, sf_dir).withColumn("created_at", F.lit(None).cast("timestamp"))
    return ln(n, 200).select("node_id", "chunk_type")


# ------------------------------------------------------------- streaming ----

def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a streaming sink."""
    import uuid
    from graphloom.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _scattered(spark, sf_dir, name, folder, key, files=5):
    """A table dealt over several files by a hash, so that neighbouring rows arrive in different batches."""
    from graphloom.session import read_table
    t = read_table(spark, sf_dir, name)
    t.repartition(files, F.xxhash64(*key)).write.mode("overwrite").parquet(folder)
    return t.schema


@register("stream_corrections")
def stream_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the dialogue table as a stream of five files, one a batch, turns of a dialogue
    scattered over them; the result equals the batch capture (C1)."""
    from graphloom.streaming.corrections import read_corrections, run_correction_stream
    src, sink = _scratch(spark, "stream-turns"), _scratch(spark, "stream-corrections")
    _scattered(spark, sf_dir, "conversations", src, ["conv_id", "turn"])
    run_correction_stream(spark, src, sink, max_files_per_trigger=1)
    return read_corrections(spark, sink).select(
        "correction_id", "session_id", "target_type", "target_id", "original", "corrected")


@register("stream_ingest")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: documents as a stream of five files, one a batch, content-hashed, newest version kept."""
    from graphloom.streaming.ingest import current_nodes, run_ingest_stream
    files, sink = _scratch(spark, "stream-docs"), _scratch(spark, "stream-ingest")
    schema = _scattered(spark, sf_dir, "documents", files, ["doc_id"])
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)

    def to_nodes(b):
        return b.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"),
                        F.col("source").alias("source_file"), F.col("lang").alias("language"),
                        F.col("text").alias("content"))
    run_ingest_stream(spark, src, sink, to_nodes)
    return current_nodes(spark, sink).select("node_id", "source_file", "language", "content_hash")


def _email_edges(text: str) -> list[dict]:
    import re
    return [{"target": m, "type": "MENTIONS", "confidence": "probabilistic", "evidence": "address"}
            for m in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", text)]


def _lines(text: str) -> Iterator[str]:
    """The parts of ``text.split("\\n")``, one at a time."""
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def record_chunks(path: str, text: str) -> Iterator[dict]:
    """A user's extractor: one chunk per line ``<id> TAB <text>``, which belongs to its file and mentions addresses."""
    for line in _lines(text):
        if line:
            name, _, body = line.partition("\t")
            yield {"chunk_type": "record", "name": name, "raw_cleaned": body, "edges": [
                {"target": path, "type": "BELONGS_TO", "confidence": "deterministic", "evidence": "file"}, *_email_edges(body)]}


def line_chunks(path: str, text: str) -> list[dict]:
    """A user's extractor: one chunk per line that is not blank; a file with a secret is an error."""
    import re
    out = []
    for i, line in enumerate(text.split("\n"), 1):
        if re.search(r"(?i)(token|secret|password|api_key)\s*=\s*\"[0-9a-f]{16,}\"", line):
            raise ValueError(f"secret in line {i}")
        if line.strip(" "):
            edges = _email_edges(line)
            out.append({"chunk_type": "contact" if edges else "paragraph", "name": f"line {i}", "raw_cleaned": line, "edges": edges})
    return out


@register("stream_files")
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 over files + X1: four drops of files (changed, deleted, brought back) that arrive in the order 4, 2, 1,
    3, some files a batch, with compactions on the way; the chunks and edges of the files that are there at the end."""
    from graphloom.sources.extractors import extract_files, register_extractor
    from graphloom.streaming.files import compact, current_chunks, current_edges, run_file_stream
    root, sink = _scratch(spark, "stream-drops"), _scratch(spark, "stream-files")
    drops = fx.document_drops(spark, sf_dir)
    name = register_extractor(spark, "record_chunks", record_chunks)
    for batch, arriving in enumerate([(4,), (2,), (1,), (3,)]):
        (drops.filter(F.col("drop").isin(*arriving)).repartition("drop", "file").sortWithinPartitions("drop", "file", "n")
         .select("drop", "file", "value").write.mode("append").partitionBy("drop", "file").text(root))
        run_file_stream(spark, root, sink, lambda files: extract_files(files, {"txt": name}),
                        logical=lambda place: F.regexp_extract(place, "^file=([^/]+)/", 1))
        if batch == 1:
            compact(spark, sink)
    chunks = current_chunks(spark, sink).select(F.lit("chunk").alias("kind"), "path", "name", F.sha2("raw_cleaned", 256).alias("detail"),
                                                F.lit(1).cast("long").alias("n"))
    edges = (current_edges(spark, sink).groupBy("path", F.col("type").alias("name"), F.col("target_node_id").alias("detail"))
             .agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "path", "name", "detail", "n"))
    return chunks.unionByName(edges)


@register("extract_user_function")
def extract_user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's line extractor as a table function over every document file, called in a lateral join;
    files with a secret give a reject row."""
    from graphloom.functions.text import ext_language, extension
    from graphloom.sources.extractors import extract_files, register_extractor
    files = fx.document_files(spark, sf_dir).select("path", ext_language(extension("path")).alias("language"), "text")
    name = register_extractor(spark, "line_chunks", line_chunks)
    languages = ["python", "typescript", "scss", "csharp", "md", "json", "yaml", "protobuf", "txt"]
    found = extract_files(files, {lang: name for lang in languages})
    return found.select("path", "language", "chunk_type", "name", "raw_cleaned", F.size("edges").alias("n_edges"), "error_class", "error_message")


@register("context_assembly")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: context rows for every benchmark item (its whole text, and the vector of its number):
    corrections, 3 communities, 5 nodes, the links of the best node in the document graph."""
    from graphloom.operators.context import assemble_context
    from graphloom.operators.vectors import centroids
    v = fx.embedding_vectors(spark, sf_dir)
    questions = fx.benchmark_questions(spark, sf_dir).join(
        v.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec")), "question_id")
    nodes = v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    comms = centroids(v.select("label", F.col("embedding").alias("vec")), "label").select(
        F.col("label").alias("item_id"), "vec")
    links = fx.doc_links(spark, sf_dir).withColumn("confidence", F.lit("deterministic"))
    return assemble_context(questions, fx.cor_corrections(spark, sf_dir), nodes, comms, links)


@register("context_retrieval")
def context_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: every question form about every nation and supplier and every benchmark item, routed: ranked
    corrections, communities or nodes by the vectors of the named entity, and the walk from the best node."""
    from graphloom.operators.retrieval import retrieve
    nodes = fx.ent_nodes(spark, sf_dir).select("node_id", F.col("summary").alias("text"))
    comms = fx.region_communities(spark, sf_dir).select("community_id", F.col("summary").alias("text"))
    return retrieve(fx.all_questions(spark, sf_dir), fx.cor_corrections(spark, sf_dir), nodes, comms, fx.ent_edges(spark, sf_dir))


@register("context_changes")
def context_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrections that questions get before and after later turns are captured, compared by rank."""
    from graphloom.operators.retrieval import correction_changes
    from graphloom.session import cut_lineage
    cor = cut_lineage(fx.cor_corrections(spark, sf_dir))  # both states are read from it
    return correction_changes(fx.all_questions(spark, sf_dir), cor.filter(F.col("turn") < CORRECTION_SPLIT_TURN), cor)


@register("file_diagnostics")
def file_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License lines, secrets and personal data found per document line."""
    from graphloom.operators.extract import diagnostics
    from graphloom.session import read_table
    return diagnostics(read_table(spark, sf_dir, "documents"), "doc_id")


@register("diagnostics_by_rule")
def diagnostics_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9 + G1-style roll-up: matching lines and documents per rule."""
    d = file_diagnostics(spark, sf_dir)
    return d.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n_lines"),
                                             F.countDistinct("doc_id").alias("n_docs"))


@register("model_call_rollup")
def model_call_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as model calls of a run (run = user): calls, tokens, cost."""
    from graphloom.operators.ledger import model_call_rollup as mcr
    from graphloom.session import read_table
    calls = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.get_json_object("props", "$.k").cast("long").alias("in_tokens"),
        F.pmod(F.col("event_id"), F.lit(1000)).alias("out_tokens"),
        F.col("value").alias("cost_usd"))
    return mcr(calls).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@register("list_communities")
def list_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: first 100 components of the document graph by id with their sizes (limit is the feature)."""
    from graphloom.operators.search import list_communities as lc
    lab = _doc_component_labels(spark, sf_dir)
    comms = lab.groupBy(F.col("comm").alias("community_id")).agg(
        F.count(F.lit(1)).alias("n_members")).withColumn(
        "updated_at", F.lit(None).cast("timestamp"))
    return lc(comms, 100).select("community_id", "n_members")


@register("gap_comparison")
def gap_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps before and after an extractor for German is registered."""
    from graphloom.operators.extract import match_extractors
    from graphloom.operators.gaps import compare_gaps, gap_report
    from graphloom.schemas import REGISTRY
    files = fx.document_files(spark, sf_dir)
    reg1 = fx.registry(spark)
    reg2 = reg1.unionByName(spark.createDataFrame(
        [("x-de", "german-prose", ["de"], ["paragraph"], [], [], "builtin", "python", "extract",
          "", "", None, 1)], REGISTRY))
    _, un1 = match_extractors(files, reg1)
    _, un2 = match_extractors(files, reg2)
    e = fx.ent_edges(spark, sf_dir)
    return compare_gaps(gap_report(unmatched_files=un1, scored_edges=e),
                        gap_report(unmatched_files=un2, scored_edges=e))


# ------------------------------------------------------- store and files ----

@register("store_round_trip")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT, the region communities and the captured corrections appended to a new store and read back:
    rows, rejected rows, rows whose empty values got a default, confidences coerced."""
    from graphloom.sources.store import Store
    store = Store(spark, _scratch(spark, "round-trip"))
    store.ensure_tables()
    nodes = fx.ent_nodes(spark, sf_dir).withColumn("chunk_type", F.when(F.col("chunk_type") != "part", F.col("chunk_type")))
    bad_nodes = store.append_nodes(nodes.withColumn("summary", F.when(~F.col("chunk_type").eqNullSafe("region"), F.col("summary"))))
    store.append_edges(fx.ent_edges(spark, sf_dir).select(
        "edge_id", "source_node_id", F.when(F.col("type") != "INHERITS", F.col("target_node_id")).alias("target_node_id"), "type",
        F.when(F.col("confidence") != "probabilistic", F.col("confidence")).alias("confidence")))
    bad_comms = store.append_communities(fx.region_communities(spark, sf_dir).withColumn(
        "summary", F.when(F.col("community_id") != "comm:r:0", F.col("summary"))))
    store.append_corrections(fx.cor_corrections(spark, sf_dir))
    n = F.count(F.lit(1))
    rows = [store.read("nodes", with_vectors=False).agg(F.lit("nodes").alias("table"), n.alias("n"), F.count_if(F.col("chunk_type") == "unknown").alias("n_filled")),
            store.read("edges").agg(F.lit("edges").alias("table"), n.alias("n"), F.count_if(F.col("confidence") == "inferred").alias("n_filled")),
            store.read("communities", with_vectors=False).agg(F.lit("communities").alias("table"), n.alias("n"), F.count_if(F.col("level") == 0).alias("n_filled")),
            store.read("corrections").agg(F.lit("corrections").alias("table"), n.alias("n"), F.count_if(F.col("captured_at").isNotNull()).alias("n_filled")),
            bad_nodes.agg(F.lit("rejected nodes").alias("table"), n.alias("n"), F.lit(0).cast("long").alias("n_filled")),
            bad_comms.agg(F.lit("rejected communities").alias("table"), n.alias("n"), F.lit(0).cast("long").alias("n_filled"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@register("run_export")
def run_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 + A5: ENT stored as a run, exported as JSON without vectors and read back, with the run's meta row."""
    from graphloom.session import read_table
    from graphloom.sources.store import Store
    out = _scratch(spark, "run-export")
    store = Store(spark, _scratch(spark, "export-store"))
    store.ensure_tables()
    calls = read_table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("in_tokens"),
                                                       F.pmod("event_id", F.lit(1000)).alias("out_tokens"), F.col("value").alias("cost_usd"))
    summary = store.write_run(fx.ent_nodes(spark, sf_dir), fx.ent_edges(spark, sf_dir), fx.region_communities(spark, sf_dir), calls)
    store.export_run(out, summary)
    meta = spark.read.json(f"{out}/meta").withColumn("one", F.lit(1))
    count = lambda name: spark.read.json(f"{out}/{name}").agg(F.count(F.lit(1)).alias(f"{name}_read"), F.lit(1).alias("one"))
    read = count("nodes").join(count("edges"), "one").join(count("communities"), "one").join(meta, "one")  # one row each
    return read.select("nodes_read", "edges_read", "communities_read", "nodes", "edges", "communities", "files", "edge_types", "n_deterministic",
                       "n_invalid", "calls", "in_tokens", "out_tokens", "cost_usd", (F.col("duration_s") > 0).alias("timed"))


@register("files_scanned")
def files_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S2: a folder tree with the documents of each source and language, scanned recursively: name, extension, language, length."""
    from graphloom.sources.files import scan_files
    root = _scratch(spark, "scanned")
    lines = fx.document_drops(spark, sf_dir).filter("drop = 1")
    (lines.repartition("file").sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").text(root))
    found = scan_files(spark, root, "*.txt")
    return found.select(F.regexp_extract("path", "/file=([^/]+)/", 1).alias("file"), "ext", "language", "valid_utf8",
                        F.length("text").alias("n_chars"), F.sha2("text", 256).alias("content"))


@register("run_log_round_trip")
def run_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + S10 + W1: the run log written as JSON arrays of about a thousand runs, loaded, appended to a Parquet log and numbered."""
    from graphloom.operators.ledger import append_runs, global_row_number, load_run_log
    folder, log = _scratch(spark, "run-json"), _scratch(spark, "run-log")
    runs = fx.run_log(spark, sf_dir)
    files = runs.count() // 1000 + 1  # one scalar
    names = ["timestamp", "sprint", "nodes", "edges", "passed", "prompt_version", "suite_version", "run_dir", "cost_usd", "in_tokens", "out_tokens", "canonical"]
    (runs.groupBy(F.pmod(F.xxhash64("run_dir"), F.lit(files)).alias("file")).agg(F.to_json(F.collect_list(F.struct(*names))).alias("value"))
     .repartition(files, "file").write.partitionBy("file").text(folder))
    append_runs(load_run_log(spark, folder).drop("file"), log)
    numbered = global_row_number(spark.read.parquet(log).drop("run_num"), ["timestamp", "run_dir"])
    return numbered.select("run_num", "run_dir", "sprint", "passed", "suite_version", F.col("cost_usd").cast("double").alias("cost_usd"),
                           "in_tokens", "skill_id", "canonical")


@register("registry_json")
def registry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 + S12 + F4: a registry of one extractor per nation written with JSON list columns, its entries for the even regions
    looked up by id and decoded again."""
    from graphloom.operators.search import get_extractors
    from graphloom.session import read_table
    from graphloom.sources.store import registry_to_json_columns
    k = F.col("n_nationkey").cast("string")
    reg = read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("x-"), k).alias("skill_id"), "n_regionkey", F.array(F.concat(F.lit("t"), k), F.concat(F.lit('.t"'), k)).alias("file_types"),
        F.array(F.struct(F.lit("CALLS").alias("type"), F.lit("inferred").alias("confidence"))).alias("edge_types"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("none"))).alias("limitations"))
    written = registry_to_json_columns(reg)
    found = get_extractors(written.drop("n_regionkey"), reg.filter("n_regionkey % 2 = 0"))
    return (found.join(written.select("skill_id", F.col("file_types").alias("as_json")), "skill_id")
            .select("skill_id", "as_json", F.array_join("file_types", "|").alias("file_types"), F.array_join("limitations", "|").alias("limitations"),
                    F.col("edge_types")[0]["type"].alias("edge_type")))


@register("stripped_lines")
def stripped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 + X7: license and secret lines stripped from every document, and whether its first word would be a page-wide selector."""
    from graphloom.operators.extract import is_infrastructure, strip_boilerplate
    from graphloom.session import read_table
    d = read_table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    clean = strip_boilerplate("text", [r"(?i)licensed under", r"(?i)(token|secret|password|api_key)\s*="])
    selector = F.element_at(F.array(*[F.lit(x) for x in ("*", "html ", ".card", "body", "::before", "*::after", "body p", "#html")]),
                            (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    return d.select("doc_id", F.length(clean).alias("n_chars"), F.sha2(clean, 256).alias("content"), is_infrastructure(selector).alias("page_wide"))


@register("embedded_documents")
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM1: hashed vectors of every document: dimensions, whether the length is 1 (0 without words), and whether equal texts have
    equal vectors."""
    from graphloom.operators.vectors import dot, embed_text
    from graphloom.session import read_table
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    v = embed_text(d, "text").withColumn("key", F.sha2("text", 256))
    length = dot("vec", "vec")
    same = v.groupBy("key").agg(F.min(F.col("vec").cast("string")).alias("lo"), F.max(F.col("vec").cast("string")).alias("hi"))
    return (v.join(same, "key").select("doc_id", F.size("vec").alias("dims"), (F.abs(length - 1) < 1e-5).alias("unit"),
                                       (F.col("lo") == F.col("hi")).alias("same_for_copies")))


@register("rejected_files")
def rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: files that the user's line extractor rejects, counted by extension and error class."""
    from graphloom.operators.gaps import unparseable_by_type as ubt
    return ubt(extract_user_function(spark, sf_dir).filter("error_class IS NOT NULL"))


# ------------------------------------------------- registered extractors ----

def _document_chunks(spark, sf_dir):
    from graphloom.functions.text import ext_language, extension
    from graphloom.sources.files import run_extractors
    files = fx.document_files(spark, sf_dir).select(
        "path", ext_language(extension("path")).alias("language"), "text")
    return run_extractors(files)


@register("extract_document_files")
def extract_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X2: the registered extractors (Python, TypeScript, SCSS) run over every
    document file of their language; one row per chunk or per rejected file
    (no SQL oracle: the extractors are Python functions)."""
    return _document_chunks(spark, sf_dir).select("path", "language", "chunk_type", "name",
                                                  "error_class")


@register("unparseable_by_type")
def unparseable_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: rejected document files counted by extension and error class (no SQL oracle)."""
    from graphloom.operators.gaps import unparseable_by_type as ubt
    from graphloom.sources.files import chunks_to_graph
    _, _, rejects = chunks_to_graph(_document_chunks(spark, sf_dir))
    return ubt(rejects)
