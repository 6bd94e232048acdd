r"""URL filter: a trie over reversed host labels and path segments, longest match first.

A rule is ``(host, path, verdict)``.  It fits a url whose host is the rule's or a subdomain of it
and whose path starts with the rule's path.  Of the rules that fit, the one of the longest host
decides, then the one of the longest path; where the same host and path is both allowed and
blocked, block decides.  A url that no rule fits gets the default verdict.

The trie has an edge per host label from the last label on, an edge from a host's node to the
root of its paths, and an edge per whole path segment; the last piece of a rule's path may
be part of a segment, so a node keeps these pieces as *tails*.  It is built of the rules
and broadcast only while their text is at most ``RULE_BYTES``.  Longer lists are joined: a url's host
suffixes meet the distinct lengths of the paths of that host, then the prefixes of these lengths meet the
rules.  Both are equi-joins on keys that are unique among the rules, so no url meets more than its own prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ALLOW, BLOCK = "allow", "block"
#: Most text of rules (bytes of hosts and paths) that is made into a trie and broadcast: some 100,000 rules.
RULE_BYTES = 4 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null and for a text without ``://``."""
    given = F.coalesce(url, F.lit(""))
    at = "://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(given, at, 1), _UPPER, _LOWER), F.regexp_extract(given, at, 2)


class Trie:
    """Nodes are numbers; ``edges[node, label]`` leads on, and ``edges[node, None]`` from a host to its paths."""

    def __init__(self, edges: dict[tuple[int, str | None], int], tails: dict[int, dict[str, tuple[str, str]]]):
        self.edges, self.tails = edges, tails
        self.sizes = {node: sorted({len(t) for t in at}, reverse=True) for node, at in tails.items()}

    @classmethod
    def of(cls, rules: list[tuple[str, str, str]]) -> Trie:
        """The trie of rules (host, path, verdict)."""
        trie = cls({}, {})
        for host, path, verdict in rules:
            *whole, tail = path.split("/")
            node = 0
            for label in [*(reversed(host.split(".")) if host else ()), None, *whole]:
                node = trie.edges.setdefault((node, label), len(trie.edges) + 1)
            at = trie.tails.setdefault(node, {})
            if at.get(tail, ("", ALLOW))[1] != BLOCK:
                at[tail] = (host + path, verdict)
        return cls(trie.edges, trie.tails)

    def path_roots(self, host: str) -> list[int]:
        """Roots of the paths of every host in the rules that the host is or lies below, longest host first."""
        node, roots = 0, []
        if (0, None) in self.edges:
            roots.append(self.edges[0, None])
        for label in reversed(host.split(".")):
            node = self.edges.get((node, label))
            if node is None:
                break
            if (node, None) in self.edges:
                roots.append(self.edges[node, None])
        return roots[::-1]

    def longest(self, root: int, segments: list[str]) -> tuple[str, str] | None:
        """Rule text and verdict of the longest path below one host that starts the segments."""
        node, found = root, None
        for segment in segments:
            at = self.tails.get(node)
            if at:
                for size in self.sizes[node]:
                    if size <= len(segment) and segment[:size] in at:
                        found = at[segment[:size]]
                        break
            node = self.edges.get((node, segment))
            if node is None:
                break
        return found

    def judge(self, roots: list[int], path: str) -> tuple[str, str] | None:
        segments = path.split("/")
        for root in roots:
            found = self.longest(root, segments)
            if found:
                return found
        return None


def _by_trie(urls: DataFrame, trie: Trie, default: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast((trie.edges, trie.tails))  # plain values: no class to import in tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*shared.value)
        for batch in batches:
            hosts = batch.column("host").dictionary_encode()
            roots = [trie.path_roots(h) for h in hosts.dictionary.to_pylist()]
            rules, verdicts = [], []
            for place, path in zip(hosts.indices.to_pylist(), batch.column("path").to_pylist(), strict=True):
                found = trie.judge(roots[place], path) if roots[place] else None
                rules.append(found and found[0])
                verdicts.append(found[1] if found else default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                                             [*batch.schema.names, "rule", "verdict"])

    return urls.mapInArrow(run, StructType([*urls.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())]))


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same decisions for any number of rules, by equi-joins of prefixes."""
    rules = (rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
             .withColumn("size", F.length("rule_path")))
    sizes = rules.select("rule_host", "size").distinct()
    each = urls.select("host", "path").distinct()
    labels = F.split("host", "\\.", -1)
    suffix = F.transform(F.sequence(F.lit(1), F.size("labels")),
                         lambda k: F.array_join(F.slice(F.col("labels"), k, F.size("labels")), "."))
    own = (each.withColumn("labels", labels)
           .select("host", "path", F.explode(F.array_union(suffix, F.array(F.lit("")))).alias("rule_host")))
    met = (own.join(sizes, "rule_host").filter(F.col("size") <= F.length("path"))
           .withColumn("rule_path", F.expr("substring(path, 1, size)"))
           .join(rules.drop("size"), ["rule_host", "rule_path"]))
    best = met.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule_host").alias("h"), F.col("size"), F.concat("rule_host", "rule_path").alias("rule"),
        F.col("verdict"))).alias("best"))
    return (urls.join(best, ["host", "path"], "left")
            .select(*urls.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = ALLOW, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, rule (text of the deciding rule, else null), verdict.

    ``pages`` has page_id and url, ``rules`` host, path and verdict ('allow' or 'block', anything else is an error).
    Null and malformed urls have an empty host and path and get the default, or a rule of the
    empty host and path.  Null hosts and paths of rules count as empty; an empty host fits every
    url.  Repeated pages give repeated rows; repeated rules count once; tables may be empty; other columns are left out.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("rule_host"),
                         F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    size, odd = rules.agg(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 1),
                          F.count_if(~F.coalesce(F.col("verdict").isin(ALLOW, BLOCK), F.lit(False)))).first()
    if odd:
        raise ValueError(f"{odd} rules are neither '{ALLOW}' nor '{BLOCK}'")
    if (size or 0) > rule_bytes:
        return _by_join(urls, rules, default)
    return _by_trie(urls, Trie.of([tuple(r) for r in rules.collect()]), default)  # at most rule_bytes of text
