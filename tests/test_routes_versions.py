import random
from collections import defaultdict

import pytest

from graphloom.operators.routes import contract_edges, contracts, match_calls
from graphloom.operators.signhash import approx_topk, probe_order, recall
from graphloom.operators.traverse import connect_paths
from graphloom.operators.vectors import topk
from graphloom.operators.versions import as_of, validity, version_index
from tests.conftest import edges_df


# ---- routes

def segments(url):
    return ["*" if s.startswith(("${", ":")) or s == "*" or (s.startswith("{") and s.endswith("}")) else s
            for s in url.split("?")[0].split("#")[0].split("/") if s]


def plain_match(calls, routes, specs):
    described = defaultdict(list)
    for op, t in specs:
        described["/" + "/".join(segments(t))].append(op)
    patterns = {"/" + "/".join(segments(t)) for _, t in routes}
    contract = {p: f"spec:{min(described[p])}" if p in described else f"contract:{p}" for p in patterns}
    out = set()
    for call, url, op in calls:
        if op in {o for o, _ in specs}:
            out.add((call, "contract", f"spec:{op}", 1, "deterministic"))
            continue
        c = segments(url) if url is not None else None
        fits = []
        for p in patterns if c is not None else ():
            r = [x for x in p.split("/") if x]
            if len(r) == len(c) and all(x == y or "*" in (x, y) for x, y in zip(c, r)):
                fits.append((-sum(x == y != "*" for x, y in zip(c, r)), r.count("*"), p))
        if not fits:
            out.add((call, "none", None, 0, None))
            continue
        top = min(fits)[:2]
        best = sorted(p for *s, p in fits if tuple(s) == top)
        dynamic = "*" in c
        kind = "dynamic" if dynamic else "path" if best[0] == "/" + "/".join(c) else "template"
        out.add((call, kind, contract[best[0]], len(best), "inferred" if len(best) > 1 else "probabilistic" if dynamic else "deterministic"))
    return out


def test_calls_equal_plain_matching(spark):
    rnd = random.Random(2)
    part = lambda: rnd.choice(["a", "b", "c", "{id}", ":x", "*"])
    routes = [(f"r{i}", "/" + "/".join(part() for _ in range(rnd.randint(0, 4)))) for i in range(60)]
    seg = lambda: rnd.choice(["a", "b", "c", "d", "${x}"])
    calls = [(f"c{i}", "/" + "/".join(seg() for _ in range(rnd.randint(0, 4))) + rnd.choice(["", "/", "?q=/a/b", "#f"]), rnd.choice([None, None, "op1", "other"])) for i in range(200)]
    calls += [("null", None, None), ("null op", None, "op1")]
    specs = [("op1", routes[0][1]), ("op0", routes[0][1]), ("op2", "/not/a/route")]
    frames = (spark.createDataFrame(calls, "call_id string, url string, operation string"), spark.createDataFrame(routes, "route_id string, template string"),
              spark.createDataFrame(specs, "operation string, template string"))
    got = {tuple(r) for r in match_calls(*frames).collect()}
    assert got == plain_match(calls, routes, specs) and {k for _, k, *_ in got} == {"contract", "path", "template", "dynamic", "none"}
    nodes = contracts(frames[1], frames[2])
    assert contract_edges(nodes).count() == len(routes)
    assert match_calls(frames[0].limit(0), *frames[1:]).count() == 0
    assert {r.kind for r in match_calls(frames[0], frames[1].limit(0), frames[2].limit(0)).collect()} == {"none"}


# ---- paths

def test_paths_keep_edges_directions_and_weakest_tier(spark):
    e = edges_df(spark, [("e1", "a", "m", "CALLS", "probabilistic"), ("e0", "a", "m", "USES", "probabilistic"), ("e2", "b", "m", "CALLS", "inferred"),
                         ("e3", "a", "b"), ("e4", "a", "a"), ("e5", "m", "h")] + [(f"h{i}", "h", f"x{i}") for i in range(30)])
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "h"), ("x1", "x2"), ("a", "a"), ("a", "nowhere"), (None, "a"), ("a", "b")], "a string, b string")
    got = {(r.a, r.b, tuple(r.nodes), tuple(r.edge_ids), tuple(r.types), tuple(r.forward), r.weakest_confidence, r.n_parallel) for r in connect_paths(e, pairs).collect()}
    assert got == {
        ("a", "b", ("a", "b"), ("e3",), ("CALLS",), (True,), "deterministic", 1), ("b", "a", ("b", "a"), ("e3",), ("CALLS",), (False,), "deterministic", 1),
        ("a", "b", ("a", "m", "b"), ("e0", "e2"), ("USES", "CALLS"), (True, False), "inferred", 2),
        ("b", "a", ("b", "m", "a"), ("e2", "e0"), ("CALLS", "USES"), (True, False), "inferred", 2),
        ("a", "h", ("a", "m", "h"), ("e0", "e5"), ("USES", "CALLS"), (True, True), "probabilistic", 2),
        ("x1", "x2", ("x1", "h", "x2"), ("h1", "h2"), ("CALLS", "CALLS"), (False, True), "deterministic", 1)}


# ---- versions

def test_versions_that_return_and_as_of(spark):
    rows = [("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b"), ("s", 3, "a"), ("s", 5, "a"), ("s", 6, None), ("s", 8, "a"), ("t", 4, "z"), (None, 1, "n"), ("s", None, "n")]
    intervals = validity(spark.createDataFrame(rows, "suite string, at long, version string"))
    assert {tuple(r) for r in intervals.collect()} == {("s", "a", 1, 3, 2), ("s", "b", 3, 5, 1), ("s", "a", 5, 6, 1), ("s", "a", 8, None, 1), ("t", "z", 4, None, 1)}
    assert {tuple(r) for r in version_index(intervals).collect()} == {("s", "a", 1, 8, 3, 4, True), ("s", "b", 3, 3, 1, 1, False), ("t", "z", 4, 4, 1, 1, True)}
    asked = [("s", 0), ("s", 1), ("s", 4), ("s", 5), ("s", 7), ("s", 99), ("t", 3), ("t", 4), ("u", 5), (None, 5), ("s", None), ("s", 4)]
    got = sorted(as_of(spark.createDataFrame(asked, "suite string, at long"), intervals).collect(), key=str)
    want = [("s", 0, None, None), ("s", 1, "a", 1), ("s", 4, "b", 3), ("s", 4, "b", 3), ("s", 5, "a", 5), ("s", 7, None, None), ("s", 99, "a", 8),
            ("t", 3, None, None), ("t", 4, "z", 4), ("u", 5, None, None), (None, 5, None, None), ("s", None, None, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], "suite string, at long, version string")
    assert validity(none).count() == 0


def test_one_long_suite_is_spread(spark):
    rnd = random.Random(3)
    rows = [("big", t, rnd.choice("ab")) for t in range(3000)]
    got = sorted(validity(spark.createDataFrame(rows, "suite string, at long, version string")).collect(), key=lambda r: r.valid_from)
    starts = [t for t in range(3000) if t == 0 or rows[t][2] != rows[t - 1][2]]
    assert [r.valid_from for r in got] == starts and [r.valid_to for r in got] == [*starts[1:], None]
    assert sum(r.n_snapshots for r in got) == 3000


# ---- approximate search

def test_probes_come_in_order_of_cost():
    margins = [0.5, -2.0, 0.1, 1.0]
    codes = probe_order(__import__("numpy").array(margins), 16)
    assert codes[0] == 0b1101 and sorted(codes) == list(range(16))
    cost = [sum(m * m for i, m in enumerate(margins) if (c ^ codes[0]) >> i & 1) for c in codes]
    assert cost == sorted(cost)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_approximate_search_reaches_its_recall(spark, metric):
    rnd = random.Random(6)
    base = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [x + rnd.gauss(0, 0.4) for x in rnd.choice(base)]) for i in range(1500)]
    rows += [(2000 + i, base[0]) for i in range(300)] + [(3000, None), (3001, [0.0] * 16)]
    v = spark.createDataFrame(rows, "item_id long, vec array<double>")
    q = v.filter("item_id % 20 = 0 OR item_id > 2990").withColumnRenamed("item_id", "query_id")
    found, exact = approx_topk(q, v, 5, metric, exclude_self=True), topk(q, v, 5, metric, exclude_self=True)
    r = recall(found, exact).collect()
    assert sum(x.n_found for x in r) >= 0.9 * sum(x.n_exact for x in r) and len(r) == q.filter("vec IS NOT NULL").count()
    assert found.groupBy("query_id").count().filter("count <> 5").count() == 0
    few = approx_topk(q, v.limit(2), 5, metric)
    assert few.groupBy("query_id").count().filter("count <> 2").count() == 0
    assert approx_topk(q, v.limit(0), 5, metric).count() == 0
