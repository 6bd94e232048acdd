"""Extraction and write-side checks.

HTML pages are cut into chunks with built-in regex functions; registry
lookups are joins; contract checks split a table into valid and rejected
rows with an ``errors`` array instead of raising per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schemas import coerce_confidence

# What the HTML extractor keeps (chunk type -> pattern, group 1).
HTML_PATTERNS = {
    "title": r"(?is)<title[^>]*>(.*?)</title>",
    "heading": r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>",
    "link": r"(?is)<a(?:\s[^>]*)?\shref\s*=\s*[\"']([^\"'>]*)[\"']",
    "paragraph": r"(?is)<p(?:\s[^>]*)?>(.*?)</p>",
}

# Selectors that are page infrastructure, not components.
INFRA_SELECTOR = r"^\s*(\*|html|body|::before|::after|\*::before|\*::after)\s*$"

REQUIRED_NODE_FIELDS = ["node_id", "language", "source_file", "chunk_type", "raw_cleaned",
                        "summary"]


def html_chunks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, chunk_type, ordinal, content)`` for titles, headings, links, paragraphs."""
    found = F.array(*[F.struct(F.lit(kind).alias("chunk_type"),
                               F.regexp_extract_all(F.col(html_col), F.lit(pat), 1).alias("parts"))
                      for kind, pat in HTML_PATTERNS.items()])
    # one scan: all kinds of one page are exploded together
    return (pages.select(F.col(id_col).alias("page_id"), F.explode(found).alias("f"))
            .select("page_id", F.col("f.chunk_type").alias("chunk_type"), F.posexplode("f.parts").alias("ordinal", "content"))
            .withColumn("ordinal", F.col("ordinal") + 1))


def is_infrastructure(selector) -> Column:
    """``*``, ``html``, ``body``, ``::before``/``::after`` rules."""
    c = F.col(selector) if isinstance(selector, str) else selector
    return c.rlike(INFRA_SELECTOR)


def strip_boilerplate(text, patterns: list[str]) -> Column:
    """Drop lines matching any boilerplate pattern before summarising."""
    c = F.col(text) if isinstance(text, str) else text
    lines = F.split(c, r"\n")
    rx = "|".join(f"(?:{p})" for p in patterns)
    return F.array_join(F.filter(lines, lambda ln: ~ln.rlike(rx)), "\n")


def match_extractors(files: DataFrame, registry: DataFrame, type_col: str = "file_type") -> tuple[DataFrame, DataFrame]:
    """P4 + J6 + G2: files joined to the extractors whose ``file_types`` contain their type.

    Returns ``(matched, unmatched)``; ``unmatched`` is the gap list of files
    with no extractor (left anti join).  The planner picks the join by size.
    """
    r = registry.select("skill_id", "name", F.explode("file_types").alias(type_col)).distinct()
    matched = files.join(r, type_col, "inner")
    unmatched = files.join(r.select(type_col).distinct(), type_col, "left_anti")
    return matched, unmatched


def validate_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P10 + P12: ``(valid, rejected)``; rejected rows carry ``errors`` (missing fields)."""
    checks = [F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""),
                     F.lit(f"missing {f}")) for f in REQUIRED_NODE_FIELDS if f in nodes.columns]
    with_err = nodes.withColumn("errors", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    return (with_err.filter(F.size("errors") == 0).drop("errors"),
            with_err.filter(F.size("errors") > 0))


def explode_inline_edges(nodes: DataFrame, edges_col: str = "edges") -> DataFrame:
    """P15 + P9 + P8: inline ``edges array<struct<target,type,confidence,evidence>>``
    become edge rows; empty targets are skipped and confidences coerced.

    ``edge_id`` is a content hash of source, target, type and position, so a
    re-run produces the same ids.
    """
    e = nodes.select(F.col("node_id").alias("source_node_id"),
                     F.posexplode(edges_col).alias("pos", "e"))
    return (e.filter(F.length(F.coalesce(F.col("e.target"), F.lit(""))) > 0)
            .select(F.sha2(F.concat_ws("\u0001", "source_node_id", F.col("e.target"),
                                       F.coalesce(F.col("e.type"), F.lit("UNKNOWN")),
                                       F.col("pos").cast("string")), 256).alias("edge_id"),
                    "source_node_id", F.col("e.target").alias("target_node_id"),
                    F.coalesce(F.col("e.type"), F.lit("UNKNOWN")).alias("type"),
                    coerce_confidence(F.col("e.confidence")).alias("confidence"),
                    F.coalesce(F.col("e.evidence"), F.lit("")).alias("evidence")))


# Health-signal rules per line (rule, severity, pattern).
DIAGNOSTIC_RULES = [
    ("license", "info", r"(?i)(licensed under|released under the .*license)"),
    ("secret", "error", r"(?i)(token|secret|password|api_key)\s*=\s*\"[0-9a-f]{16,}\""),
    ("personal_data", "warning", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
]


def diagnostics(files: DataFrame, id_col: str, text_col: str = "text",
                rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``(id, line_no, rule, severity)`` for every line matching a rule.

    The rule table is compiled into per-line expressions (no join between
    lines and rules); one row per (line, matching rule).
    """
    rs = rules or DIAGNOSTIC_RULES
    lines = files.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n"))
                         .alias("line_no", "line"))
    hits = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(r).alias("rule"),
                                                            F.lit(s).alias("severity")))
                     for r, s, p in rs])
    return (lines.select(id_col, (F.col("line_no") + 1).alias("line_no"),
                         F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h"))
            .select(id_col, "line_no", "h.rule", "h.severity"))
