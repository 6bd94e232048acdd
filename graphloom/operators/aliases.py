"""Corrections found by what their target is called (J3, J10): ids, paths, concept names.

A correction's target may be a node id, a file path (with a scheme or ``./``), a concept name or
the last part of one.  ``alias_table`` lists every way to name a node once, with the number of nodes that share it;
``resolve_targets`` takes the most exact way that names anything.  A name of several nodes stays one
row with their number: the nodes are in ``alias_nodes``, so corrections of a common name
never meet all its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normalise_path

#: Ways to name a node, the most exact first.
KINDS = ["id", "path", "name", "segment"]


def last_segment(name) -> Column:
    """What follows the last ``.``, ``/``, ``:`` or ``#`` of a name; names that end with one are left whole."""
    c = F.col(name) if isinstance(name, str) else name
    found = F.regexp_extract(c, r"[./:#]([^./:#]+)$", 1)
    return F.when(found != "", found).otherwise(c)


def _ways(identity: Column, path: Column, name: Column) -> Column:
    """The aliases of a node or a target as an array of (kind, alias); nulls and empty ones are left out."""
    folded = F.lower(F.trim(name))
    ways = [identity, normalise_path(path), folded, last_segment(folded)]
    each = F.array(*[F.struct(F.lit(i).alias("kind"), w.alias("alias")) for i, w in enumerate(ways)])
    return F.filter(each, lambda w: F.coalesce(w["alias"] != "", F.lit(False)))


def alias_nodes(nodes: DataFrame) -> DataFrame:
    """``(kind, alias, node_id, source_file)``: every way to name every node of ``nodes(node_id, source_file, name)``."""
    named = nodes.select("node_id", "source_file", F.explode(_ways(F.col("node_id"), F.col("source_file"), F.col("name"))).alias("w"))
    return named.select("w.kind", "w.alias", "node_id", "source_file").distinct()


def alias_table(nodes: DataFrame) -> DataFrame:
    """``(kind, alias, n_nodes, node_id, source_file)``: one row per alias; node and file only where it names one."""
    each = alias_nodes(nodes)
    found = each.groupBy("kind", "alias").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("node_id").alias("node"),
                                              F.min("source_file").alias("lo"), F.max("source_file").alias("hi"))
    return found.select("kind", "alias", "n_nodes", F.when(F.col("n_nodes") == 1, F.col("node")).alias("node_id"),
                        F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("source_file"))


def resolve_targets(corrections: DataFrame, nodes: DataFrame) -> DataFrame:
    """``correction_id, match_kind, alias, n_nodes, node_id, source_file`` of every correction.

    ``match_kind`` is the most exact kind whose alias the target is, or null; ``node_id`` is null where the alias names several
    nodes, ``source_file`` where they lie in several files.  Null targets match nothing.
    """
    target = F.col("target_id")
    asked = corrections.select("correction_id", F.explode_outer(_ways(target, target, target)).alias("w"))
    met = (asked.select("correction_id", F.col("w.kind").alias("kind"), F.col("w.alias").alias("alias"))
           .join(alias_table(nodes), ["kind", "alias"], "left"))
    hit = F.struct("kind", "alias", "n_nodes", "node_id", "source_file")
    first = met.groupBy("correction_id").agg(F.min(F.when(F.col("n_nodes").isNotNull(), hit)).alias("m"))
    kind = F.when(F.col("m").isNotNull(), F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("m.kind")))
    return first.select("correction_id", kind.alias("match_kind"), "m.alias", F.coalesce("m.n_nodes", F.lit(0)).cast("long").alias("n_nodes"),
                        "m.node_id", "m.source_file")


def corrections_of_files(files: DataFrame, nodes: DataFrame, corrections: DataFrame) -> DataFrame:
    """``source_file, correction_id, match_kind`` of the corrections whose target names the file or something in it alone.

    ``files(source_file)``; paths compare normalised.
    """
    wanted = files.select(normalise_path("source_file").alias("path")).distinct()
    found = resolve_targets(corrections, nodes).filter("source_file IS NOT NULL").withColumn("path", normalise_path("source_file"))
    return found.join(wanted, "path", "left_semi").select("source_file", "correction_id", "match_kind")
