import itertools

import pytest
from pyspark.sql import functions as F

from conftest import edges_df, nodes_df
from graphloom.operators import graph as G


def ring_of_cliques(spark, n_cliques=6, size=8):
    edges = []
    for c in range(n_cliques):
        base = c * size
        edges += [(base + i, base + j) for i, j in itertools.combinations(range(size), 2)]
        edges.append((base + size - 1, ((c + 1) % n_cliques) * size))
    return spark.createDataFrame(edges, "src long, dst long")


def test_simple_graph_drops_unknown_and_collapses(spark):
    e = edges_df(spark, [("1", "a", "b"), ("2", "b", "a"), ("3", "a", "b"), ("4", "a", "zz"),
                         ("5", "c", "c")])
    got = sorted(tuple(r) for r in G.simple_graph(nodes_df(spark, ["a", "b", "c"]), e).collect())
    assert got == [("a", "b"), ("c", "c")]


def test_degrees_and_summary(spark):
    e = edges_df(spark, [("1", "a", "b"), ("2", "a", "b"), ("3", "b", "c")])
    n = nodes_df(spark, ["a", "b", "c", "d"])
    d = {r.node_id: (r.out_degree, r.in_degree) for r in G.degrees(n, e).collect()}
    assert d == {"a": (2, 0), "b": (1, 2), "c": (0, 1), "d": (0, 0)}
    s = G.graph_summary(n, e).first()
    assert (s.n_nodes, s.n_edges, s.edge_density, s.n_isolated) == (4, 3, 0.75, 1)


def test_modularity_of_ring(spark):
    e = ring_of_cliques(spark)
    lab = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().select(
        "id", (F.col("id") / 8).cast("long").alias("comm"))
    q = G.modularity(e, lab).first()
    assert q.n_communities == 6
    assert abs(q.modularity - 0.798851) < 1e-6


def test_connected_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5)], "src long, dst long")
    n = spark.createDataFrame([(7,)], "node_id long")
    got = {r.id: r.component for r in G.connected_components(e, nodes=n).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 7: 7}


def test_louvain_ring_of_cliques(spark):
    from graphloom.operators.louvain import louvain
    m, hist = louvain(ring_of_cliques(spark))
    comms = m.groupBy("community").agg(F.collect_set("id").alias("ids")).collect()
    assert len(comms) == 6
    assert sorted(sorted(c.ids)[0] for c in comms) == [0, 8, 16, 24, 32, 40]
    assert abs(hist[-1]["modularity"] - 0.798851) < 1e-6


def test_louvain_isolated_nodes_stay_alone(spark):
    from graphloom.operators.louvain import louvain
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    n = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    m, _ = louvain(e, nodes=n)
    got = {r.id: r.community for r in m.collect()}
    assert got[3] == 3 and got[1] == got[2]


def test_louvain_nodes_of_one_neighbour_follow_it(spark):
    """A root, five hubs, items of the hubs, parts of the items, a linked pair, a looped end: ends are settled before any round."""
    from graphloom.operators.louvain import louvain
    edges = [(0, h) for h in range(1, 6)]
    edges += [(h, 100 * h + i) for h in range(1, 6) for i in range(40)]
    edges += [(100 * h + i, 10000 * h + 100 * i + j) for h in range(1, 6) for i in range(40) for j in range(i % 2)]
    edges += [(90000, 90001), (1, 90002), (90002, 90002)]
    e = spark.createDataFrame(edges, "src long, dst long")
    final, hist, levels = louvain(e, return_levels=True, follow=True)
    first = {r.id: r.community for r in levels.filter("level = 0").collect()}
    ends = {10000 * h + 100 * i + j: 100 * h + i for h in range(1, 6) for i in range(40) for j in range(i % 2)}
    ends |= {100 * h + i: h for h in range(1, 6) for i in range(0, 40, 2)} | {90001: 90000}
    assert first == {n: ends.get(n, n) for n in first}
    assert hist[0]["rounds"] == 0 and hist[0]["moves"] == len(ends) and sum(h["rounds"] for h in hist) <= 12
    comm = {r.id: r.community for r in final.collect()}
    for h in range(1, 6):  # hubs stay apart, with all that belongs to them
        assert {comm[100 * h + i] for i in range(40)} | {comm[n] for n, item in ends.items() if item // 100 == h} == {comm[h]}
    assert len({comm[h] for h in range(1, 6)}) == 5 and comm[90000] == comm[90001]
