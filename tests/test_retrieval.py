import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators.retrieval import best, correction_changes, key_terms, letter_pairs, rank_corrections, retrieve
from graphloom.operators.vectors import topk


def corrections_df(spark, texts):
    return spark.createDataFrame([(f"k{i:03}", t, "", None) for i, t in enumerate(texts)],
                                 "correction_id string, original string, corrected string, target_id string")


def plain_ranks(questions, texts, top):
    low = [f"{t}  ".lower() for t in texts]
    out = set()
    for q, text in questions:
        words = {w for w in re.split(r"\s+", (text or "").lower()) if len(w) > 2}
        df = {w: sum(w in s for s in low) for w in words}
        score = Counter()
        for i, s in enumerate(low):
            for w in words:
                if w in s:
                    score[f"k{i:03}"] += len(texts) * 1000 // df[w]
        for rank, (c, x) in enumerate(sorted(score.items(), key=lambda kv: (-kv[1], kv[0]))[:top], 1):
            out.add((q, c, x, rank))
    return out


@pytest.mark.parametrize("top", [1, 4])
def test_ranked_corrections_equal_plain_scoring(spark, top):
    rnd = random.Random(top)
    vocabulary = ["the", "order", "service", "pay", "payment", "refund", "ledger", "audit", "queue", "zeta", "of", "x"]
    weights = [40, 9, 9, 6, 5, 4, 3, 2, 2, 1, 30, 30]
    texts = [" ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, 9))) for _ in range(80)]
    questions = [(f"q{i}", " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 8)))) for i in range(40)]
    questions += [("null", None), ("none", "unheard words"), ("common", "the"), ("again", questions[0][1])]
    q = spark.createDataFrame(questions, "question_id string, text string")
    got = {tuple(r) for r in rank_corrections(q, corrections_df(spark, texts), top).collect()}
    assert got == plain_ranks(questions, texts, top)


def test_changes_between_two_states(spark):
    q = spark.createDataFrame([("q", "refund payment")], "question_id string, text string")
    before = corrections_df(spark, ["refund", "payment", "queue"])
    after = before.unionByName(corrections_df(spark, ["", "", "", "refund payment"]).filter("correction_id = 'k003'"))
    got = {(r.correction_id, r.change, r.old_rank, r.new_rank) for r in correction_changes(q, before, after, 2).collect()}
    assert got == {("k003", "added", None, 1), ("k000", "moved", 1, 2), ("k001", "removed", 2, None)}
    assert correction_changes(q, before, before, 2).count() == 0


def test_key_terms_and_letter_pairs(spark):
    texts = ["What is the blast radius of Supplier#000000012?", "What does UNITED STATES depend on? What are its dependencies?", "who uses it", "", None,
             "Née à Zürich. The end"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(key_terms("text").alias("k")).collect()
    assert [r.k for r in rows] == ["Supplier#000000012", "UNITED STATES", "who uses it", "", "", "Z"]
    got = spark.createDataFrame([("abab",), ("é",), (None,)], "t string").select(letter_pairs("t").alias("v")).collect()
    assert sum(got[0].v) == 3 and got[0].v[(97 * 31 + 98) % 64] >= 2 and sum(got[1].v) == sum(got[2].v) == 0


def test_best_has_a_limit_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    top = best(df, ["k"], [F.desc("id")], 4)
    assert {(r.k, r.rank, r.id) for r in top.collect()} == {(k, i + 1, 999 - ((999 - k) % 3) - 3 * i) for k in range(3) for i in range(4)}
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_retrieve_routes_and_walks(spark):
    names = {"a": "Alpha", "b": "Beta", "c": "Gamma", "d": "Delta"}
    edges = [("e1", "b", "a", "CALLS", "deterministic", ""), ("e2", "c", "b", "CALLS", "inferred", ""), ("e3", "d", "c", "CALLS", "probabilistic", ""),
             ("e4", "a", "d", "USES", "probabilistic", "")]
    e = spark.createDataFrame(edges, "edge_id string, source_node_id string, target_node_id string, type string, confidence string, evidence string")
    nodes = spark.createDataFrame(list(names.items()), "node_id string, summary string").select("node_id", letter_pairs("summary").alias("vec"))
    comms = spark.createDataFrame([("one", "Alpha Beta"), ("two", "Gamma Delta")], "community_id string, s string").select("community_id", letter_pairs("s").alias("vec"))
    cor = corrections_df(spark, ["blast of everything", "nothing"])
    q = spark.createDataFrame([("q1", "What is the blast radius of Alpha?"), ("q2", "What does Alpha depend on? What are its dependencies?"),
                               ("q3", "Overview of the Gamma Delta domain"), ("q4", "Where is Beta"), ("q5", None), ("q6", "Who uses Alpha?")],
                              "question_id string, text string")
    got = retrieve(q, cor, nodes, comms, e, {"edge": 2}).collect()
    of = lambda i, kind: [(r.item, r.score) for r in sorted(got, key=lambda r: r.rank) if r.question_id == i and r.kind == kind]
    assert of("q1", "correction") == [("k000", 2000)]
    assert of("q1", "node")[0] == ("a", 0) and of("q1", "edge") == [("e1", 3), ("e3", 3)]
    assert of("q2", "edge") == [("e4", 2), ("e3", 2)][:len(of("q2", "edge"))] or of("q2", "edge")[0][0] in ("e3", "e4")
    assert of("q3", "community")[0] == ("two", 0) and not of("q3", "node") and not of("q3", "edge")
    assert of("q4", "node")[0][0] == "b" and not of("q4", "edge") and not of("q4", "community")
    assert of("q6", "edge") == [("e1", 2), ("e2", 2)]
    assert {r.route for r in got if r.question_id == "q1"} == {"blast_radius"}
    own = retrieve(q.withColumn("vec", F.lit(None).cast("array<double>")), cor, nodes, comms, e).collect()
    assert {r.kind for r in own} == {"correction"}  # no vector, no hit


def test_topk_in_blocks_equals_one_block(spark):
    rnd = random.Random(4)
    rows = [(f"v{i:03}", [float(rnd.randint(-3, 3)) for _ in range(4)]) for i in range(150)] + [("null", None)]
    v = spark.createDataFrame(rows, "item_id string, vec array<double>")
    q = v.withColumnRenamed("item_id", "query_id")
    for metric in ("dot", "cosine", "l2"):
        one = {tuple(r) for r in topk(q, v, 3, metric, exclude_self=True).collect()}
        assert {tuple(r) for r in topk(q, v, 3, metric, exclude_self=True, block_bytes=1500).collect()} == one


def test_nearest_by_products_equals_all_differences():
    import numpy as np
    from graphloom.operators.vectors import _best, _nearest, _scores
    rng = np.random.default_rng(3)
    for c in (rng.integers(0, 3, (400, 6)).astype(float), 1e6 + rng.normal(size=(400, 6)) * 1e-6, np.ones((40, 6))):
        q = np.concatenate([c[:20], c[:5] + 1e-9])
        items = rng.permutation(len(c))
        for hidden in (None, np.arange(len(q))[:, None] == np.arange(len(c))[None, :]):
            s = _scores(q, c, "l2")
            places, scores = _nearest(q, c, items, 5, hidden)
            if hidden is not None:
                s[hidden] = -np.inf
            want = _best(s, items, 5)
            assert [p.tolist() for p in places] == [w.tolist() for w in want]
            assert all((a == s[i, w]).all() for i, (a, w) in enumerate(zip(scores, want)))


def test_pairs_of_letters_are_made_once_a_text(spark):
    from graphloom.operators.retrieval import letter_pairs
    df = spark.createDataFrame([("abab",), ("",), (None,), ("x",), ("\u00e9a b",)], "t string").select("t", letter_pairs("t", 8).alias("v"))
    got = {r.t: r.v for r in df.collect()}
    for t, v in got.items():
        c = [ord(x) for x in t or "" if " " <= x <= "~"]
        assert v == [float(sum((a * 31 + b) % 8 == d for a, b in zip(c, c[1:]))) for d in range(8)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # a lambda would make the pairs again for each dimension
    assert plan.index("regexp_replace") < plan.index("lambdafunction")


def test_both_states_are_searched_at_once(spark, monkeypatch):
    """Corrections that come, go, change their text, repeat or have no id; the words are looked for once."""
    from graphloom.operators import corrections as C
    calls, plain = [], C.word_matches
    monkeypatch.setattr(C, "word_matches", lambda *a: calls.append(1) or plain(*a))
    schema = "correction_id string, original string, corrected string, target_id string"
    old = [("a", "refund payment", "", None), ("b", "queue", "", None), ("b", "ledger", "", None), ("gone", "refund", "", None), ("same", "audit", None, "t")]
    new = [("a", "refund", "queue", None), ("b", "ledger", "audit", None), ("c", "payment", "", None), ("c", "payment", "", None), (None, "refund", "", None),
           ("same", "audit", None, "t")]
    q = [("q1", "refund queue"), ("q2", "audit"), ("q3", "payment ledger"), ("q4", None), ("q4", "ledger")]
    text = lambda r: " ".join(x or "" for x in r[1:])
    pairs = lambda rows: {(i, r[0]) for i, t in q for w in (t or "").split() for r in rows if r[0] and w in text(r)}
    b, a = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    questions = spark.createDataFrame(q, "question_id string, text string")
    got = [tuple(r) for r in C.new_matches(questions, b, a).collect()]
    assert sorted(got) == sorted(pairs(new) - pairs(old)) and len(calls) == 1
    both = [{tuple(r) for r in rank_corrections(questions, c, 2).select("question_id", "correction_id", "rank").collect()} for c in (b, a)]
    calls.clear()
    got = {tuple(r) for r in correction_changes(questions, b, a, 2).select("question_id", "correction_id", "old_rank", "new_rank").collect()}
    ranks = [{(i, c): r for i, c, r in s} for s in both]
    assert got == {(*k, ranks[0].get(k), ranks[1].get(k)) for k in ranks[0] | ranks[1] if ranks[0].get(k) != ranks[1].get(k)} and len(calls) == 1


def test_items_that_are_alike_are_searched_once(spark, monkeypatch):
    """Many ids of few texts, an id of two texts, a text that is null; the nearest are those of a search through all."""
    from graphloom.operators import retrieval as R
    from graphloom.operators import vectors as V
    rows = [(f"i{i:03}", ["alpha", "beta", "alpha", None, "gamma ray"][i % 5]) for i in range(200)] + [("i000", "gamma ray"), ("i001", "beta"), ("i", "delta")]
    items = spark.createDataFrame(rows, "item_id string, text string")
    texts = spark.createDataFrame([("alpha",), ("gamma",), ("",), ("beta delta",)], "terms string").withColumn("vec", letter_pairs("terms"))
    plain = topk(texts.withColumnRenamed("terms", "query_id"), items.select("item_id", letter_pairs("text").alias("vec")), 7, "l2")
    want = sorted((r.query_id, r["rank"], r.item_id, r.score) for r in plain.collect())
    seen = []
    monkeypatch.setattr(V, "topk", lambda q, c, *a: seen.append(c.count()) or topk(q, c, *a))
    for given in (items, items.select("item_id", letter_pairs("text").alias("vec"))):
        got = R.nearest(texts, given, 7)
        assert sorted((r.terms, r["rank"], r.item_id, r.distance) for r in got.collect()) == want
    assert seen == [5, 5]


def test_distances_known_before_change_nothing(spark, monkeypatch):
    from graphloom.operators import vectors as V
    rnd = random.Random(9)
    rows = [(i, [float(rnd.randint(0, 3)) for _ in range(5)]) for i in range(400)]
    c = spark.createDataFrame(rows, "item_id long, vec array<double>")
    q = c.filter("item_id < 60").withColumnRenamed("item_id", "query_id")
    want = sorted(map(tuple, topk(q, c, 4, "l2").collect()))
    looked = []
    plain = V._far_at_most
    monkeypatch.setattr(V, "_far_at_most", lambda some, k: looked.append(len(some)) or plain(some, k))
    monkeypatch.setattr(V, "TASK_PAIRS", 5000)
    monkeypatch.setattr(V, "SAMPLE", 50)
    assert sorted(map(tuple, topk(q, c, 4, "l2").collect())) == want and looked == [50]


def test_retrieve_lists_no_walk(spark):
    """60 roots around a hub: each walk has all 60 edges, of which the first two are looked up."""
    from test_connect_work import join_rows
    n = 60
    e = spark.createDataFrame([(f"e{i:02}", f"n{i}", "hub", "T", "deterministic", "") for i in range(n)],
                              "edge_id string, source_node_id string, target_node_id string, type string, confidence string, evidence string")
    from graphloom.operators.retrieval import walk_edges
    rows, most = join_rows(walk_edges(spark.createDataFrame([(f"n{i}", "both", 2) for i in range(n)], "root_id string, direction string, depth int"), e, 2))
    assert len(rows) == 2 * n and {r.n_edges for r in rows} == {n} and most < n * n / 4
