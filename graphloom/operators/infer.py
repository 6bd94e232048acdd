"""Cross-file and cross-language edge inference (J8, J9, EM1, EM2 defaults).

J8 joins references to definitions by name across files; J9 matches
client-side URL literals to server routes.  Both are equi-joins against a
table of distinct keys (paths, segments, names), never a pairing of all
references with all definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import first_segment

# Reference kind -> confidence of the inferred edge.
KIND_CONFIDENCE = {"IMPORTS": "deterministic", "INHERITS": "deterministic",
                   "IMPLEMENTS": "deterministic", "INJECTS": "deterministic",
                   "CALLS": "probabilistic"}


def route_matches(routes: DataFrame, links: DataFrame) -> DataFrame:
    """Each link ``(edge_id, target_node_id)`` matched to a known route.

    ``path`` match: the link equals a route path (deterministic).
    ``segment`` match: the link's first segment equals the first segment of
    at least one route (probabilistic); ``n_routes`` tells how many routes
    share it.  Both sides are reduced to distinct keys first.
    """
    paths = routes.select(F.col("node_id").alias("target")).distinct()
    segs = (routes.select(first_segment("node_id").alias("segment"))
            .filter(F.length("segment") > 0)
            .groupBy("segment").agg(F.count(F.lit(1)).alias("n_routes")))
    lk = links.select("edge_id", F.col("target_node_id").alias("href"))
    exact = (lk.join(paths, lk.href == paths.target)
             .select("edge_id", "href", F.lit("path").alias("match_kind"),
                     F.col("target"), F.lit(1).cast("long").alias("n_routes"),
                     F.lit("deterministic").alias("confidence")))
    by_seg = (lk.withColumn("segment", first_segment("href"))
              .join(segs, "segment")
              .select("edge_id", "href", F.lit("segment").alias("match_kind"),
                      F.col("segment").alias("target"), "n_routes",
                      F.lit("probabilistic").alias("confidence")))
    return exact.unionByName(by_seg)


def infer_cross_file_edges(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Resolve symbol references ``(node_id, source_file, name, kind)`` to
    definitions ``(node_id, source_file, name)``.

    * one definition of the name in the referring file -> edge to it;
    * otherwise one definition in the whole table -> edge to it (cross-file);
    * several candidates -> one ``inferred`` edge to a symbol node
      ``name:<name>`` plus one ``DEFINES`` edge from that node to each
      candidate, so references x definitions pairs are never built for a
      common name (output linear in references plus definitions);
    * no definition -> the edge keeps the bare name as target (an
      unresolved edge for the gap report, G3).

    Resolved edges take their confidence from the kind: IMPORTS, INHERITS,
    IMPLEMENTS, INJECTS deterministic, CALLS probabilistic, else inferred.
    """
    defs = definitions.select(F.col("node_id").alias("target_node_id"),
                              F.col("source_file").alias("def_file"), "name").distinct()
    local = (defs.groupBy(F.col("name").alias("l_name"), F.col("def_file").alias("ref_file"))
             .agg(F.countDistinct("target_node_id").alias("n_local"),
                  F.min("target_node_id").alias("local_target")))
    glob = (defs.groupBy("name")
            .agg(F.countDistinct("target_node_id").alias("n_defs"),
                 F.min("target_node_id").alias("only_target"),
                 F.min("def_file").alias("only_file")))
    refs = references.select(F.col("node_id").alias("source_node_id"),
                             F.col("source_file").alias("ref_file"), "name", "kind")
    kind_conf = F.coalesce(
        F.create_map(*[F.lit(x) for kv in KIND_CONFIDENCE.items() for x in kv])[F.col("kind")],
        F.lit("inferred"))
    r = (refs.join(local.withColumnRenamed("l_name", "name"), ["name", "ref_file"], "left")
         .join(glob, "name", "left"))
    symbol_id = F.concat(F.lit("name:"), F.col("name"))
    ambiguous = (F.col("n_local") > 1) | (F.col("n_local").isNull() & (F.col("n_defs") > 1))
    target = (F.when(F.col("n_local") == 1, F.col("local_target"))
              .when(ambiguous, symbol_id)
              .when(F.col("n_defs") == 1, F.col("only_target"))
              .otherwise(F.col("name")))
    conf = F.when(ambiguous, F.lit("inferred")).otherwise(kind_conf)
    where = (F.when(F.col("n_local") == 1, F.col("ref_file"))
             .when(ambiguous, F.format_string("%d candidates", F.col("n_defs")))
             .when(F.col("n_defs") == 1, F.col("only_file"))
             .otherwise(F.lit("nowhere")))
    edges = (r.select("source_node_id", target.alias("target_node_id"), F.col("kind").alias("type"),
                      conf.alias("confidence"),
                      F.format_string("%s references %s defined in %s", F.col("ref_file"),
                                      F.col("name"), where).alias("evidence"))
             .filter(F.col("source_node_id") != F.col("target_node_id")))
    symbol = (defs.join(glob.filter(F.col("n_defs") > 1).select("name"), "name")
              .select(symbol_id.alias("source_node_id"), "target_node_id",
                      F.lit("DEFINES").alias("type"), F.lit("inferred").alias("confidence"),
                      F.format_string("%s defined in %s", F.col("name"), F.col("def_file"))
                      .alias("evidence")))
    out = edges.unionByName(symbol)
    return out.withColumn("edge_id", F.sha2(F.concat_ws("\u0001", "source_node_id",
                                                        "target_node_id", "type"), 256))
