"""Run assertions as data (Q1, A12): a rule table, compiled to one pass over each input table.

A rule names a table, an aggregate of it and what the result must satisfy.  All rules of a table are evaluated
by one aggregation; the checks come back as rows ``(table, check, subject, observed, expected, passed)`` and nothing
raises.  Rules with a ``subject`` are evaluated per value of that column: one row per extractor, answer or document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import any_keyword
from graphloom.schemas import CONFIDENCE_LEVELS

CHECKED = "table string, check string, subject string, observed string, expected string, passed boolean"


@dataclass(frozen=True)
class Rule:
    """``observed`` is an aggregate over ``table``; ``op`` is one of >=, >, = and compares it with ``expected``."""
    table: str
    check: str
    observed: Column
    op: str
    expected: object
    subject: str | None = None


def _says(text: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0


def extractor_rules(keyword: str, environment: str | None = None, table: str = "registry") -> list[Rule]:
    """Of every extractor: the parser's keyword in tool name, handbook or script, the three documents, the environment."""
    where = F.concat_ws("\n", "tool_name", "handbook", "extraction_script")
    rules = [Rule(table, "parser_keyword", F.count_if(any_keyword(where, [keyword])), ">=", 1, "skill_id")]
    rules += [Rule(table, f"has_{c}", F.count_if(_says(c)), ">=", 1, "skill_id") for c in ("handbook", "summarisation_instructions", "application_role")]
    if environment:
        rules.append(Rule(table, "environment", F.max("execution_environment"), "=", environment, "skill_id"))
    return rules


def graph_rules(min_nodes: int, min_files: int, min_deterministic: int, edge_types: Sequence[str]) -> list[Rule]:
    """Nodes, source files, deterministic edges, valid confidences, at least one edge of an expected type."""
    valid = F.coalesce(F.col("confidence").isin(*CONFIDENCE_LEVELS), F.lit(False))
    return [Rule("nodes", "min_nodes", F.count(F.lit(1)), ">=", min_nodes),
            Rule("nodes", "min_files", F.count_distinct("source_file"), ">=", min_files),
            Rule("edges", "min_deterministic", F.count_if(F.col("confidence") == "deterministic"), ">=", min_deterministic),
            Rule("edges", "invalid_confidences", F.count_if(~valid), "=", 0),
            Rule("edges", "expected_edge_types", F.count_if(F.col("type").isin(*edge_types)), ">=", 1)]


def community_rules(min_communities: int) -> list[Rule]:
    """Enough communities, each with a summary; none where no community is asked for."""
    if not min_communities:
        return []
    return [Rule("communities", "min_communities", F.count(F.lit(1)), ">=", min_communities),
            Rule("communities", "without_summary", F.count_if(~_says("summary")), "=", 0)]


def answer_rules(keywords: Sequence[str], min_length: int) -> list[Rule]:
    """Of every answer: longer than ``min_length`` characters and with one of the keywords."""
    return [Rule("answers", "answer_length", F.max(F.length(F.coalesce(F.col("text"), F.lit("")))), ">", min_length, "answer_id"),
            Rule("answers", "answer_keywords", F.count_if(any_keyword("text", list(keywords))), ">=", 1, "answer_id")]


def check_run(rules: Sequence[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """Every rule as rows; a rule about a table that is not there fails with a null observation.

    An empty table has counts of 0; rules with a subject have no row there.
    """
    out = None
    for table, subject in sorted({(r.table, r.subject or "") for r in rules}):
        mine = [r for r in rules if (r.table, r.subject or "") == (table, subject)]
        df = tables.get(table)
        if df is None:
            continue
        grouped = df.groupBy(F.col(subject).cast("string").alias("subject")) if subject else df.withColumn("subject", F.lit(None).cast("string")).groupBy()
        facts = grouped.agg(*[r.observed.alias(f"r{i}") for i, r in enumerate(mine)])
        if not subject:
            facts = facts.withColumn("subject", F.lit(None).cast("string"))

        def row(i: int, r: Rule) -> Column:
            seen = F.col(f"r{i}")
            test = {">=": seen >= F.lit(r.expected), ">": seen > F.lit(r.expected), "=": seen == F.lit(r.expected)}[r.op]
            return F.struct(F.lit(table).alias("table"), F.lit(r.check).alias("check"), F.col("subject"), seen.cast("string").alias("observed"),
                            F.lit(f"{r.op} {r.expected}").alias("expected"), F.coalesce(test, F.lit(False)).alias("passed"))
        rows = facts.select(F.inline(F.array(*[row(i, r) for i, r in enumerate(mine)])))
        out = rows if out is None else out.unionByName(rows)
    lost = [(r.table, r.check, None, None, f"{r.op} {r.expected}", False) for r in rules if r.table not in tables]
    if lost:
        missing = next(iter(tables.values())).sparkSession.createDataFrame(lost, CHECKED)
        out = missing if out is None else out.unionByName(missing)
    return out
