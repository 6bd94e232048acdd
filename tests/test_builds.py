import os
import tempfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import community_build
from graphloom.operators.aliases import alias_table, corrections_of_files, resolve_targets
from graphloom.operators.assertions import Rule, answer_rules, check_run, community_rules, extractor_rules, graph_rules
from graphloom.operators.community_build import build_communities, stored_ancestors
from graphloom.sources.store import Store


# ---- names

NODES = [("n1", "src/a.py", "app.OrderService"), ("n2", "src/a.py", "app.Payment"), ("n3", "./src/b.py", "lib.Payment"), ("n4", None, None), ("n5", "c.py", "n1")]


def test_targets_by_id_path_name_and_segment(spark):
    nodes = spark.createDataFrame(NODES, "node_id string, source_file string, name string")
    targets = ["n1", "file://src/a.py", "./src/b.py", "APP.ORDERSERVICE ", "orderservice", "payment", "lib.payment", "none", "", None, "n4"]
    cor = spark.createDataFrame([(f"c{i:02}", t, "x", "y") for i, t in enumerate(targets)], "correction_id string, target_id string, original string, corrected string")
    got = [tuple(r)[1:] for r in sorted(resolve_targets(cor, nodes).collect(), key=lambda r: r.correction_id)]
    assert got == [("id", "n1", 1, "n1", "src/a.py"), ("path", "src/a.py", 2, None, "src/a.py"), ("path", "src/b.py", 1, "n3", "./src/b.py"),
                   ("name", "app.orderservice", 1, "n1", "src/a.py"), ("segment", "orderservice", 1, "n1", "src/a.py"), ("segment", "payment", 2, None, None),
                   ("name", "lib.payment", 1, "n3", "./src/b.py"), (None, None, 0, None, None), (None, None, 0, None, None), (None, None, 0, None, None),
                   ("id", "n4", 1, "n4", None)]
    files = spark.createDataFrame([("./src/a.py",), ("other.py",), (None,)], "source_file string")
    assert {(r.correction_id, r.match_kind) for r in corrections_of_files(files, nodes, cor).collect()} == {("c00", "id"), ("c01", "path"), ("c03", "name"), ("c04", "segment")}
    assert alias_table(nodes.limit(0)).count() == 0 and resolve_targets(cor.limit(0), nodes).count() == 0
    assert resolve_targets(cor, nodes.limit(0)).filter("match_kind IS NULL").count() == len(targets)


# ---- assertions

def test_rules_pass_and_fail_per_subject(spark):
    registry = spark.createDataFrame([("good", "Roslyn tool", "book", "say", "role", "python", None), ("bad", None, "", "say", None, "node", "uses roslyn"), ("no", "x", "y", "z", "r", None, None)],
                                     "skill_id string, tool_name string, handbook string, summarisation_instructions string, application_role string, execution_environment string, extraction_script string")
    nodes = spark.createDataFrame([("a", "f1"), ("b", "f1")], "node_id string, source_file string")
    edges = spark.createDataFrame([("e1", "CALLS", "deterministic"), ("e2", "X", None), ("e3", "X", "odd")], "edge_id string, type string, confidence string")
    comms = spark.createDataFrame([("c", "text"), ("d", " ")], "community_id string, summary string")
    answers = spark.createDataFrame([("q1", "the order is here"), ("q2", "short"), ("q3", None)], "answer_id string, text string")
    rules = extractor_rules("ROSLYN", "python") + graph_rules(2, 2, 1, ("CALLS",)) + community_rules(1) + answer_rules(("Order",), 5)
    rows = check_run(rules, {"registry": registry, "nodes": nodes, "edges": edges, "communities": comms, "answers": answers}).collect()
    got = {(r.table, r.check, r.subject): (r.observed, r.passed) for r in rows}
    assert {k[2]: v[1] for k, v in got.items() if k[1] == "parser_keyword"} == {"good": True, "bad": True, "no": False}
    assert {k[2]: v[1] for k, v in got.items() if k[1] == "has_handbook"} == {"good": True, "bad": False, "no": True}
    assert {k[2]: v[1] for k, v in got.items() if k[1] == "has_application_role"} == {"good": True, "bad": False, "no": True}
    assert {k[2]: v for k, v in got.items() if k[1] == "environment"} == {"good": ("python", True), "bad": ("node", False), "no": (None, False)}
    assert got["nodes", "min_nodes", None] == ("2", True) and got["nodes", "min_files", None] == ("1", False)
    assert got["edges", "invalid_confidences", None] == ("2", False) and got["edges", "expected_edge_types", None] == ("1", True)
    assert got["communities", "without_summary", None] == ("1", False) and got["communities", "min_communities", None] == ("2", True)
    assert {k[2]: v[1] for k, v in got.items() if k[1] == "answer_length"} == {"q1": True, "q2": False, "q3": False}
    assert {k[2]: v[1] for k, v in got.items() if k[1] == "answer_keywords"} == {"q1": True, "q2": False, "q3": False}
    assert community_rules(0) == []


def test_rules_of_missing_and_empty_tables(spark):
    nodes = spark.createDataFrame([], "node_id string, source_file string")
    rows = {r.check: (r.observed, r.passed) for r in check_run([Rule("nodes", "some", F.count(F.lit(1)), ">=", 1), Rule("gone", "any", F.count(F.lit(1)), ">=", 0)], {"nodes": nodes}).collect()}
    assert rows == {"some": ("0", False), "any": (None, False)}


# ---- store: releases, build, run summary

@pytest.fixture
def store(spark):
    s = Store(spark, tempfile.mkdtemp(prefix="gl-store-"))
    s.ensure_tables()
    return s


def fill(spark, store, groups=3):
    """Cliques of five nodes, linked in a row, and a lone node with an old community."""
    ids = [f"g{g}n{i}" for g in range(groups) for i in range(5)]
    nodes = spark.createDataFrame([(n, "py", "f.py", "class", "raw", f"summary of {n}", "old" if n == "g0n0" else None) for n in [*ids, "lone"]],
                                  "node_id string, language string, source_file string, chunk_type string, raw_cleaned string, summary string, community_id string")
    pairs = [(f"g{g}n{i}", f"g{g}n{j}") for g in range(groups) for i in range(5) for j in range(i)] + [(f"g{g}n0", f"g{g + 1}n0") for g in range(groups - 1)]
    store.append_nodes(nodes)
    store.append_edges(spark.createDataFrame([(f"{a}-{b}", a, b, "CALLS", "deterministic") for a, b in [*pairs, ("g0n0", "unknown")]],
                                             "edge_id string, source_node_id string, target_node_id string, type string, confidence string"))
    return ids


def test_community_build_is_one_release(spark, store):
    ids = fill(spark, store)
    build_communities(store)
    members = defaultdict(set)
    for r in store.read("community_members").collect():
        members[r.level, r.community_id].add(r.node_id)
    tree = {r.community_id: r for r in store.read("community_tree").collect()}
    assert {c for _, c in members} == set(tree) == {r.community_id for r in store.read("communities").collect()}
    assert all(len(members[tree[c].level, c]) == tree[c].n_members for c in tree)
    assert {frozenset(m) for (level, _), m in members.items() if level == 0} == {frozenset(n for n in ids if n.startswith(f"g{g}")) for g in range(3)}
    own = {r.node_id: r.community_id for r in store.read("nodes").collect()}
    top = max(level for level, _ in members)
    assert own["lone"] is None and {n: c for (level, c), m in members.items() if level == top for n in m} == {n: c for n, c in own.items() if c}
    assert all(r.summary and len(r.embedding) == 64 for r in store.read("communities").collect())
    assert all(not r.parent_id or r.parent_id in tree for r in tree.values()) and stored_ancestors(store).count() >= len(tree)


def test_failed_half_leaves_the_old_version(spark, store, monkeypatch):
    ids = fill(spark, store)
    # the communities themselves do not matter here
    known = (spark.createDataFrame([(n, n[:2], 0) for n in ids] + [("lone", "lone", 0)], "id string, community string, level int"),
             spark.createDataFrame([("g0n0", "g0n1")], "src string, dst string"))
    monkeypatch.setattr(community_build, "node_levels", lambda nodes, edges: known)
    build_communities(store)
    before = {t: store.read(t).count() for t in ("nodes", "communities", "community_tree", "community_members")}
    paths = {t: store.path(t) for t in before}

    def dies(rows):  # the embedding fails while the release is being written
        return rows.withColumn("vec", F.expr("array(cast(raise_error('no model') as float))"))
    with pytest.raises(Exception, match="no model"):
        build_communities(store, embed=dies)
    assert {t: store.read(t).count() for t in before} == before and {t: store.path(t) for t in before} == paths
    # the next build takes other versions and counts as a whole
    build_communities(store)
    assert all(store.path(t) > paths[t] for t in before) and {t: store.read(t).count() for t in before} == before


def test_two_writers_cannot_take_one_version(spark, store):
    fill(spark, store)
    taken = store._next_version("nodes")
    os.remove(os.path.join(taken, "_CLAIMED"))
    assert store._next_version("nodes") != taken  # the folder is there already
    real, store_b = Store._next_version, Store(spark, store.base)
    fs_create = f"{store.base}/nodes/v0099"
    os.makedirs(fs_create)
    claimed = real(store_b, "nodes")
    assert claimed.endswith("v0100") and os.path.exists(f"{claimed}/_CLAIMED")
    with pytest.raises(Exception, match="exist"):
        from graphloom.sources.store import _fs
        fs, p = _fs(spark, f"{claimed}/_CLAIMED")
        fs.create(p, False)


def test_run_summary_counts_what_is_written(spark, store):
    nodes = spark.createDataFrame([("a", "text"), ("b", ""), ("c", None), (None, "x"), ("d", "more")], "node_id string, summary string")
    edges = spark.createDataFrame([("1", "a", "d", "deterministic"), ("2", "a", "", "inferred"), ("3", "d", "x", "odd"), ("4", "d", "a", None)],
                                  "edge_id string, source_node_id string, target_node_id string, confidence string")
    calls = spark.createDataFrame([(5, 7, 0.25), (None, 1, None)], "in_tokens long, out_tokens long, cost_usd double")
    row = store.write_run(nodes, edges, spark.createDataFrame([("k", "s"), ("l", "")], "community_id string, summary string"), calls).first()
    assert (row.nodes, row.rejected, row.edges, row.n_deterministic, row.n_inferred, row.coerced, row.communities) == (2, 3, 3, 1, 2, 2, 1)
    assert (row.calls, row.in_tokens, row.out_tokens, float(row.cost_usd)) == (2, 5, 8, 0.25) and row.duration_s > 0
    assert (store.read("nodes").count(), store.read("edges").count(), store.read("communities").count()) == (2, 3, 1)
    few = store.write_run(nodes.limit(0), edges.limit(0)).first()
    assert (few.nodes, few.edges, few.communities, few.calls, few.cost_usd) == (0, 0, 0, 0, None)


def test_export_has_the_run_in_its_meta_row(spark, store):
    ids = fill(spark, store)
    out = tempfile.mkdtemp(prefix="gl-export-")
    more = spark.createDataFrame([("x", "more")], "node_id string, summary string")
    edges = spark.createDataFrame([("9", "x", "lone", "odd")], "edge_id string, source_node_id string, target_node_id string, confidence string")
    summary = store.write_run(more, edges, None, spark.createDataFrame([(1, 2, 0.5)], "in_tokens long, out_tokens long, cost_usd double"))
    store.export_run(out, summary)
    meta = spark.read.json(f"{out}/meta").first()
    assert (meta.nodes, meta.files, meta.communities, meta.calls, meta.out_tokens, meta.cost_usd) == (len(ids) + 2, 2, 0, 1, 2, 0.5)
    assert spark.read.json(f"{out}/nodes").count() == meta.nodes and "embedding" not in spark.read.json(f"{out}/nodes").columns
    store.export_run(out)
    assert "calls" not in spark.read.json(f"{out}/meta").columns


def test_export_is_compressed_and_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.ensure_tables()
    edges = spark.range(20_000).select(F.concat(F.lit("e:"), F.col("id")).alias("edge_id"), F.concat(F.lit("a:"), F.col("id")).alias("source_node_id"),
                                       F.lit("b").alias("target_node_id"), F.lit("CALLS").alias("type"), F.lit("inferred").alias("confidence"))
    store.append_edges(edges)
    store.export_run(str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "edges"))
    plain = back.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    assert back.select("edge_id", "source_node_id").exceptAll(edges.select("edge_id", "source_node_id")).isEmpty() and back.count() == 20_000
    assert sum(f.stat().st_size for f in (tmp_path / "out" / "edges").glob("part-*")) < plain / 4
