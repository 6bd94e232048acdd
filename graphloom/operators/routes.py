"""Calls matched to routes (J9): contract nodes, literal paths, templates and partly dynamic urls.

A route's path and a call's url become segments; a segment that is a parameter (``{id}``,
``:id``, ``${id}``, ``*``) is a wildcard.  Both sides are reduced to distinct patterns, and a pattern
index is kept over (length, first segment): which sets of wildcard positions occur there.  A call's key for a set
is its segments with those positions blanked, so a match is an equi-join on (length, both sets, key): no
call is compared with routes that differ in a fixed segment.

Several routes may match.  The best has the most fixed segments in common, then the fewest
wildcards; routes that are equally good make the match ``inferred``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

#: Parameter segments of routes and dynamic segments of urls.
PARAMETER = r"\$\{|^\{.*\}$|^:[A-Za-z_]|^\*$"


def pattern(url) -> Column:
    """Segments of a url or route path without scheme, host, query, fragment and empty segments; parameters are ``*``."""
    c = F.col(url) if isinstance(url, str) else url
    path = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(PARAMETER), "*").otherwise(s))


def path_text(segments) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def _mask(segments: str) -> Column:
    return F.array_join(F.transform(F.col(segments), lambda s: F.when(s == "*", "1").otherwise("0")), "")


def _patterns(rows: DataFrame, url: str) -> DataFrame:
    """Distinct patterns: ``segments, text, size, mask`` and ``first`` (``*`` for a wildcard, empty without segments)."""
    p = rows.select(pattern(url).alias("segments")).distinct()
    return cut_lineage(p.select("segments", path_text("segments").alias("text"), F.size("segments").alias("size"), _mask("segments").alias("mask"),
                                F.coalesce(F.try_element_at("segments", F.lit(1)), F.lit("")).alias("first")))


def _met(patterns: DataFrame, others: DataFrame) -> DataFrame:
    """The patterns with the masks of the other side that may match them: by length and first segment."""
    # "*" meets every first segment, which the key "?" stands for
    mine = F.when(F.col("first") == "*", F.array(F.lit("?"))).otherwise(F.array("first", F.lit("*")))
    theirs = F.array("first", F.lit("?"))
    masks = others.select("size", F.col("mask").alias("other"), F.explode(theirs).alias("at")).distinct()
    keyed = patterns.withColumn("at", F.explode(mine)).join(masks, ["size", "at"]).drop("at").dropDuplicates(["text", "other"])
    blank = F.transform("segments", lambda s, i: F.when((F.substring(F.col("other"), i + 1, F.lit(1)) == "1"), "*").otherwise(s))
    return keyed.withColumn("key", F.array_join(blank, "/"))


def match_patterns(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``(call, route, n_routes, dynamic)``: for distinct call patterns the best route pattern and how many are as good.

    ``calls`` and ``routes`` are tables of ``_patterns``; a call pattern without a route has no row.
    """
    c = _met(calls, routes).select("size", F.col("mask").alias("mc"), F.col("other").alias("mr"), "key", F.col("text").alias("call"))
    r = _met(routes, calls).select("size", F.col("mask").alias("mr"), F.col("other").alias("mc"), "key", F.col("text").alias("route"))
    wild = F.length(F.replace("mr", F.lit("0"), F.lit("")))
    same = F.size(F.filter(F.split("key", "/"), lambda s: ~s.isin("*", "")))
    met = cut_lineage(c.join(r, ["size", "mc", "mr", "key"]).select("call", "route", F.contains("mc", F.lit("1")).alias("dynamic"),
                                                                     F.struct(same.alias("same"), (-wild).alias("wild")).alias("score")))
    top = met.groupBy("call").agg(F.max("score").alias("score"))
    return (met.join(top, ["call", "score"]).groupBy("call")
            .agg(F.min("route").alias("route"), F.count(F.lit(1)).alias("n_routes"), F.any_value("dynamic").alias("dynamic")))


def contracts(routes: DataFrame, specs: DataFrame) -> DataFrame:
    """Contract node of each route: ``route_id, pattern, contract_id, source``.

    ``routes(route_id, template)``, ``specs(operation, template)``.  A route whose pattern a spec describes has the contract
    ``spec:<operation>`` (the smallest of several), any other one a synthetic ``contract:<pattern>``.  Routes of
    one pattern share their contract.
    """
    described = specs.select(path_text(pattern("template")).alias("pattern"), "operation").groupBy("pattern").agg(F.min("operation").alias("operation"))
    return (routes.select("route_id", path_text(pattern("template")).alias("pattern")).join(described, "pattern", "left")
            .select("route_id", "pattern",
                    F.coalesce(F.concat(F.lit("spec:"), "operation"), F.concat(F.lit("contract:"), "pattern")).alias("contract_id"),
                    F.when(F.col("operation").isNotNull(), "spec").otherwise("synthetic").alias("source")))


def contract_edges(nodes: DataFrame) -> DataFrame:
    """Edges from each route to its contract node (``IMPLEMENTS``, deterministic)."""
    return nodes.select(F.col("route_id").alias("source_node_id"), F.col("contract_id").alias("target_node_id"),
                        F.lit("IMPLEMENTS").alias("type"), F.lit("deterministic").alias("confidence"),
                        F.concat(F.col("source"), F.lit(" contract")).alias("evidence"))


def match_calls(calls: DataFrame, routes: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per call: ``call_id, kind, contract_id, n_routes, confidence``.

    ``calls(call_id, url, operation)``.  In this order: ``contract`` (the operation of a generated client is one of a
    spec), ``path`` (all segments are fixed on both sides), ``template`` (a fixed url fits a route's parameters) are
    deterministic, ``dynamic`` (the fixed segments of a partly dynamic url fit) is probabilistic; several routes that fit
    equally well make it inferred, with the contract of the smallest pattern.  ``none``: no route fits, contract and confidence are null.
    Null urls and operations match nothing; a null url has no segments, like ``/``, but is not matched to a route of ``/``.
    """
    c = _patterns(calls.filter("url IS NOT NULL"), "url")
    r = _patterns(routes.filter("template IS NOT NULL"), "template")
    nodes = contracts(routes, specs).select(F.col("pattern").alias("route"), "contract_id").distinct()
    found = match_patterns(c, r).join(nodes, "route").withColumnsRenamed({"contract_id": "by_path", "call": "text"})
    operations = specs.select("operation", F.concat(F.lit("spec:"), "operation").alias("by_operation")).distinct()
    rows = (calls.select("call_id", "url", "operation").withColumn("text", F.when(F.col("url").isNotNull(), path_text(pattern("url"))))
            .join(operations, "operation", "left").join(found, "text", "left"))
    static = ~F.col("dynamic")
    kind = (F.when(F.col("by_operation").isNotNull(), "contract").when(F.col("route").isNull(), "none")
            .when(static & (F.col("route") == F.col("text")), "path").when(static, "template").otherwise("dynamic"))
    rows = rows.withColumn("kind", kind)
    sure = (F.when(F.col("kind") == "contract", "deterministic").when(F.col("kind") == "none", F.lit(None).cast("string"))
            .when(F.col("n_routes") > 1, "inferred").when(F.col("kind") == "dynamic", "probabilistic").otherwise("deterministic"))
    return rows.select("call_id", "kind", F.coalesce("by_operation", "by_path").alias("contract_id"),
                       F.when(F.col("by_operation").isNull(), F.coalesce("n_routes", F.lit(0))).otherwise(1).cast("long").alias("n_routes"),
                       sure.alias("confidence"))
