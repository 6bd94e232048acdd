import random
from collections import Counter, defaultdict

import pytest

from graphloom.operators.hierarchy import ancestors, community_tree, louvain_levels, rolled_up

LEVELS = "id string, community string, level int"


def nested(seed=1):
    rnd = random.Random(seed)
    fine = {f"n{i}": f"c{rnd.randint(0, 11)}" for i in range(60)}
    mid = {c: f"m{rnd.randint(0, 4)}" for c in set(fine.values())}
    top = {m: rnd.choice(["c0", "t1"]) for m in set(mid.values())}  # an id of another level again
    rows = [(n, c, 0) for n, c in fine.items()] + [(n, mid[c], 1) for n, c in fine.items()] + [(n, top[mid[c]], 2) for n, c in fine.items()]
    nodes = sorted(fine)
    edges = [(rnd.choice(nodes), rnd.choice(nodes), rnd.randint(1, 9)) for _ in range(200)] + [("n0", "stranger", 3), (None, "n1", 2)]
    return rows, edges


def test_tree_equals_plain_counts(spark):
    rows, edges = nested()
    got = {r.community_id: r for r in community_tree(spark.createDataFrame(rows + rows[:5], LEVELS),
                                                     spark.createDataFrame(edges, "src string, dst string, w int")).collect()}
    at = defaultdict(dict)
    for n, c, level in rows:
        at[level][n] = f"comm:{level}:{c}"
    want = {}
    for level in (0, 1, 2):
        inner, cut = Counter(), Counter()
        for a, b, w in edges:
            x, y = at[level].get(a), at[level].get(b)
            if x and y and x == y:
                inner[x] += w
            elif x and y:
                cut[x] += w
                cut[y] += w
        for c in set(at[level].values()):
            members = [n for n in at[level] if at[level][n] == c]
            kids = {at[level - 1][n] for n in members} if level else set()
            want[c] = (level, at[level + 1][members[0]] if level < 2 else None, len(members), len(kids), inner[c], cut[c])
    assert {c: (r.level, r.parent_id, r.n_members, r.n_children, r.inner_weight, r.cut_weight) for c, r in got.items()} == want


def test_closure_and_roll_up(spark):
    chain = [(f"a{i}", f"a{i + 1}" if i < 9 else None) for i in range(10)] + [("b", "a4"), ("lone", None)]
    tree = spark.createDataFrame(chain, "community_id string, parent_id string")
    closure = ancestors(tree)
    got = {(r.community_id, r.ancestor_id): r.distance for r in closure.collect()}
    up = dict(chain)
    want = {}
    for c in up:
        a, d = c, 0
        while a is not None:
            want[c, a] = d
            a, d = up[a], d + 1
    assert got == want
    values = spark.createDataFrame([("a0", 5), ("b", 7), ("a3", 1), ("lone", 2)], "community_id string, x long")
    assert {r.community_id: r.x for r in rolled_up(closure, values, "x").collect()} == {
        **{f"a{i}": 5 for i in (0, 1, 2)}, "a3": 6, **{f"a{i}": 13 for i in range(4, 10)}, "b": 7, "lone": 2}
    assert ancestors(tree.limit(0)).count() == 0


def test_wrong_hierarchies_raise(spark):
    crossing = [("x", "c", 0), ("y", "c", 0), ("x", "p", 1), ("y", "q", 1)]
    missing = [("x", "c", 0), ("y", "c", 0), ("x", "p", 1)]
    edges = spark.createDataFrame([], "src string, dst string")
    for rows in (crossing, missing):
        with pytest.raises(ValueError):
            community_tree(spark.createDataFrame(rows, LEVELS), edges)
    assert community_tree(spark.createDataFrame([], LEVELS), edges).count() == 0
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "community_id string, parent_id string")
    with pytest.raises(ValueError):
        ancestors(loop).count()


def test_louvain_tree_of_cliques_in_groups(spark):
    """Cliques of four, linked to rings of cliques, rings linked loosely: two levels or more, all nested."""
    edges, n = [], 0
    for ring in range(6):
        first = n
        for c in range(5):
            ids = range(n, n + 4)
            edges += [(a, b) for a in ids for b in ids if a < b]
            n += 4
        edges += [(first + 4 * c, first + 4 * ((c + 1) % 5) + 1) for c in range(5)]
        if ring:
            edges.append((first, first - 20))
    e = spark.createDataFrame(edges, "src long, dst long")
    levels = louvain_levels(e)
    tree = community_tree(levels, e).collect()
    assert max(r.level for r in tree) >= 1
    kids = Counter()
    for r in tree:
        if r.parent_id:
            kids[r.parent_id] += r.n_members
    assert all(kids[r.community_id] == r.n_members for r in tree if r.level)
    for level in {r.level for r in tree}:
        mine = [r for r in tree if r.level == level]
        assert sum(r.n_members for r in mine) == n and sum(2 * r.inner_weight + r.cut_weight for r in mine) == 2 * len(edges)
