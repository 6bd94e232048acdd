from pyspark.sql import functions as F

from graphloom.operators import ledger as L

RUNS = "sprint string, prompt_version string, suite_version string, orchestrator_model string, passed boolean, cost_usd decimal(18,6), in_tokens long, out_tokens long, nodes long, edges long, canonical boolean"


def runs(spark):
    rows = [("s1", "v001", "abc_v001", "m-1", True, 0.1, 10, 1, 5, 2, True),
            ("s1", "v001", "ab_v001", None, None, 0.2, 20, 2, 6, 3, None),
            ("s2", "v002", None, "m-2", False, None, None, 3, 7, 4, True)]
    from decimal import Decimal
    rows = [r[:5] + (None if r[5] is None else Decimal(str(r[5])),) + r[6:] for r in rows]
    return spark.createDataFrame(rows, RUNS)


def test_filters_follow_reference_rules(spark):
    r = runs(spark)
    assert L.filter_runs(r, suite_prefix="ab").count() == 2
    assert L.filter_runs(r, model_substring="-").count() == 2  # null model counts as ''
    assert L.filter_runs(r, passed=True).count() == 1
    assert L.filter_runs(r, failed=True).count() == 1        # null is neither
    assert L.filter_runs(r, canonical=True).count() == 2


def test_aggregate_null_counts_as_failed(spark):
    a = {x.sprint: x for x in L.aggregate_runs(runs(spark), "sprint").collect()}
    assert (a["s1"].runs, a["s1"].passed, a["s1"].failed) == (2, 1, 1)
    assert float(a["s1"].cost_usd) == 0.3 and a["s2"].in_tokens == 0
    m = {x.orchestrator_model for x in L.aggregate_runs(runs(spark), "orchestrator_model").collect()}
    assert "unknown" in m


def test_global_row_number_many_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(13)
    got = L.global_row_number(df, ["k"], "n").collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i + 1) for i in range(1000)]


def test_version_notes(spark):
    p = spark.createDataFrame(
        [(1, 1, "a", "xx"), (1, 2, "a", "xxxx"), (1, 2, "b", "y"), (1, 3, "a", "xxxx"),
         (1, 3, "b", "y"), (1, 4, "a", "zzzz"), (1, 4, "b", "y")],
        "suite long, version_no long, name string, content string")
    got = {r.version_no: r.note for r in L.version_notes(p).collect()}
    assert got == {1: "Initial prompt snapshot.", 2: "Changed: a (+2 chars), b (new).",
                   3: "No detected changes.", 4: "Changed: a (+0 chars)."}


def test_fingerprint_order_free_and_versions(spark):
    f1 = spark.createDataFrame([("s", 1, "a", "x"), ("s", 1, "b", "y"), ("s", 2, "a", "x"),
                                ("s", 2, "b", "y"), ("s", 3, "a", "CHANGED")],
                               "suite string, t long, name string, content string")
    fp = L.content_fingerprint(f1.withColumn("snap", F.struct("suite", "t")), "snap", "name", "content")
    fp = fp.select("snap.suite", "snap.t", "fingerprint")
    v = {r.t: r.version for r in L.assign_versions(fp, "suite", "t").collect()}
    assert v == {1: "s_v001", 2: "s_v001", 3: "s_v002"}


def test_previous_in_order_matches_lag_with_hot_key(spark):
    from pyspark.sql import Window
    rows = [(0, t, f"v{t}") for t in range(3000)] + [(k, t, f"w{k}-{t}") for k in range(1, 40)
                                                     for t in range(0, 30, 3)]
    df = spark.createDataFrame(rows, "k long, t long, v string").repartition(7)
    got = {(r.k, r.t): r.prev_v for r in L.previous_in_order(df, "k", "t", ["v"]).collect()}
    w = Window.partitionBy("k").orderBy("t")
    exp = {(r.k, r.t): r.p for r in df.withColumn("p", F.lag("v").over(w)).collect()}
    assert got == exp
