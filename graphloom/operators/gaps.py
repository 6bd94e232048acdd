"""Gap report and run-quality checks as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unresolved_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per (type, confidence) all edges and those whose target is not a node."""
    known = nodes.select(F.col("node_id").alias("target_node_id")).distinct().withColumn(
        "_known", F.lit(True))
    e = edges.join(known, "target_node_id", "left")
    return (e.groupBy("type", "confidence")
            .agg(F.count(F.lit(1)).alias("n_edges"),
                 F.count_if(F.col("_known").isNull()).alias("n_unresolved")))


def unparseable_by_type(rejects: DataFrame) -> DataFrame:
    """G1: extractor rejects ``(path, error_class)`` counted by extension and class."""
    from graphloom.functions.text import extension
    return (rejects.groupBy(extension("path").alias("ext"), "error_class")
            .agg(F.count(F.lit(1)).alias("n_files")))


def gap_report(unmatched_files: DataFrame | None = None, nodes: DataFrame | None = None,
               edges: DataFrame | None = None, scored_edges: DataFrame | None = None,
               rejects: DataFrame | None = None) -> DataFrame:
    """G1-G4 as one long table ``(section, key, n)``."""
    parts = []
    if rejects is not None:
        parts.append(unparseable_by_type(rejects).select(
            F.lit("unparseable").alias("section"),
            F.concat_ws("/", "ext", "error_class").alias("key"), F.col("n_files").alias("n")))
    if unmatched_files is not None:
        parts.append(unmatched_files.groupBy(F.col("file_type").alias("key"))
                     .agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit("no_extractor").alias("section"), "key", "n"))
    if nodes is not None and edges is not None:
        u = unresolved_edges(nodes, edges)
        parts.append(u.select(F.lit("unresolved").alias("section"),
                              F.concat_ws("/", "type", "confidence").alias("key"),
                              F.col("n_unresolved").alias("n")))
    if scored_edges is not None:
        parts.append(scored_edges.filter(F.col("confidence") == "inferred")
                     .groupBy(F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit("low_confidence").alias("section"), "key", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_gaps(run1: DataFrame, run2: DataFrame) -> DataFrame:
    """Full outer join of two gap tables with the change per (section, key)."""
    a = run1.select("section", "key", F.col("n").alias("n_run1"))
    b = run2.select("section", "key", F.col("n").alias("n_run2"))
    j = a.join(b, ["section", "key"], "full")
    return j.select("section", "key", F.coalesce("n_run1", F.lit(0)).alias("n_run1"),
                    F.coalesce("n_run2", F.lit(0)).alias("n_run2"),
                    (F.coalesce("n_run2", F.lit(0)) - F.coalesce("n_run1", F.lit(0)))
                    .alias("delta"))


def quality_checks(nodes: DataFrame, edges: DataFrame, answers: DataFrame | None = None,
                   min_nodes: int = 8, min_files: int = 3, min_deterministic: int = 1,
                   expected_edge_types: tuple[str, ...] = (),
                   keywords: tuple[str, ...] = (), min_answer_length: int = 100) -> DataFrame:
    """Q1 + U1 + F10: run assertions as rows ``(check, observed, expected, passed)``.

    Node and edge facts come from one aggregation each; answer checks are
    per answer row.  Nothing raises.
    """
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"),
                  F.countDistinct("source_file").alias("n_files"))
    exp = F.array(*[F.lit(t) for t in expected_edge_types]) if expected_edge_types \
        else F.array().cast("array<string>")
    e = edges.agg(F.count_if(F.col("confidence") == "deterministic").alias("n_det"),
                  F.count_if(~F.col("confidence").isin("deterministic", "probabilistic",
                                                       "inferred") | F.col("confidence").isNull())
                  .alias("n_invalid"),
                  F.sort_array(F.collect_set("type")).alias("types"))
    def row(check, observed, expected, passed):
        return F.struct(F.lit(check).alias("check"), observed.cast("string").alias("observed"),
                        expected.alias("expected"), passed.alias("passed"))
    node_rows = n.select(F.explode(F.array(
        row("min_nodes", F.col("n_nodes"), F.lit(str(min_nodes)), F.col("n_nodes") >= min_nodes),
        row("min_files", F.col("n_files"), F.lit(str(min_files)), F.col("n_files") >= min_files),
    )).alias("r")).select("r.*")
    inter = F.array_intersect(F.col("types"), exp)
    edge_rows = e.select(F.explode(F.array(
        row("min_deterministic", F.col("n_det"), F.lit(str(min_deterministic)),
            F.col("n_det") >= min_deterministic),
        row("valid_confidences", F.col("n_invalid"), F.lit("0"), F.col("n_invalid") == 0),
        row("expected_edge_type", F.array_join(F.sort_array(inter), ","), F.array_join(exp, ","),
            (F.size(exp) == 0) | (F.size(inter) > 0)),
    )).alias("r")).select("r.*")
    out = node_rows.unionByName(edge_rows)
    if answers is not None:
        from graphloom.functions.text import any_keyword
        a = answers.select(
            F.concat(F.lit("answer:"), F.col("answer_id").cast("string")).alias("check"),
            F.length("text").cast("string").alias("observed"),
            F.lit(f">{min_answer_length} chars, any of {','.join(keywords)}").alias("expected"),
            ((F.length("text") > min_answer_length)
             & (any_keyword("text", list(keywords)) if keywords else F.lit(True))).alias("passed"))
        out = out.unionByName(a)
    return out
