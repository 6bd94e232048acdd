import json
import tempfile

from pyspark.sql import functions as F

from graphloom.operators.extract import diagnostics
from graphloom.operators.gaps import compare_gaps
from graphloom.operators.ledger import global_row_number, load_run_log


def test_diagnostics_rules(spark):
    docs = spark.createDataFrame(
        [(1, "hello\nLicensed under the Apache License, Version 2.0.\nmail me: a.b@example.org"),
         (2, 'x token = "0123456789abcdef0123"\nplain')], "doc_id long, text string")
    got = sorted((r.doc_id, r.line_no, r.rule) for r in diagnostics(docs, "doc_id").collect())
    assert got == [(1, 2, "license"), (1, 3, "personal_data"), (2, 1, "secret")]


def test_compare_gaps(spark):
    a = spark.createDataFrame([("s", "x", 3), ("s", "y", 1)], "section string, key string, n long")
    b = spark.createDataFrame([("s", "x", 1), ("s", "z", 2)], "section string, key string, n long")
    got = {(r.key, r.n_run1, r.n_run2, r.delta) for r in compare_gaps(a, b).collect()}
    assert got == {("x", 3, 1, -2), ("y", 1, 0, -1), ("z", 0, 2, 2)}


def test_run_log_json_with_missing_fields(spark):
    d = tempfile.mkdtemp(prefix="gl-runlog-")
    path = f"{d}/run_log.json"
    rows = [{"run_num": 1, "sprint": "s0", "nodes": 9, "passed": False},
            {"run_num": 2, "sprint": "s1", "nodes": 57, "passed": True, "cost_usd": 0.363483,
             "in_tokens": 274143}]
    with open(path, "w") as f:
        json.dump(rows, f)
    r = load_run_log(spark, path)
    got = {x.run_num: (x.sprint, x.cost_usd, x.in_tokens) for x in r.collect()}
    assert got[1] == ("s0", None, None) and float(got[2][1]) == 0.363483
    assert load_run_log(spark, f"{d}/missing.json").count() == 0


def test_louvain_levels_nest(spark):
    import itertools
    from graphloom.operators.louvain import louvain_hierarchy
    edges = []
    for c in range(4):
        base = c * 6
        edges += [(base + i, base + j) for i, j in itertools.combinations(range(6), 2)]
        edges.append((base + 5, ((c + 1) % 4) * 6))
    e = spark.createDataFrame(edges, "src long, dst long")
    levels, hist = louvain_hierarchy(e)
    rows = levels.collect()
    assert {r.level for r in rows} >= {0}
    # every level covers every node exactly once
    for lv in {r.level for r in rows}:
        assert sorted(r.id for r in rows if r.level == lv) == list(range(24))


def test_lead_summary(spark):
    from graphloom.operators.communities import lead_summary
    df = spark.createDataFrame([("a", "First one.  Second   one! " + "x" * 500)], "node_id string, raw_cleaned string")
    s = lead_summary(df).first().summary
    assert s == "First one. Second one!"
