import numpy as np

from graphloom.operators.vectors import centroids, topk


def brute(q, c, k, metric, exclude_self):
    out = {}
    for i, qv in q.items():
        scores = []
        for j, cv in c.items():
            if exclude_self and i == j:
                continue
            if metric == "dot":
                s = float(np.dot(qv, cv)); key = (-s, j)
            elif metric == "cosine":
                s = float(np.dot(qv, cv) / np.linalg.norm(qv) / np.linalg.norm(cv)); key = (-s, j)
            else:
                s = float(np.linalg.norm(qv - cv)); key = (s, j)
            scores.append((key, j, s))
        scores.sort()
        out[i] = [(j, s) for _, j, s in scores[:k]]
    return out


def test_topk_matches_brute_force_with_many_blocks(spark):
    rng = np.random.default_rng(7)
    vecs = {i: rng.normal(size=8).astype(np.float32) for i in range(60)}
    vecs[59] = vecs[3].copy()  # an exact tie, broken by id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vecs.items()], "id long, vec array<float>")
    for metric in ("dot", "cosine", "l2"):
        got = topk(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "item_id"),
                   4, metric, exclude_self=True, block_bytes=7 * 8 * 8)
        res = {}
        for r in got.orderBy("query_id", "rank").collect():
            res.setdefault(r.query_id, []).append((r.item_id, r.score))
        exp = brute({i: v.astype(np.float64) for i, v in vecs.items()},
                    {i: v.astype(np.float64) for i, v in vecs.items()}, 4, metric, True)
        assert set(res) == set(exp)
        for i in exp:
            assert [j for j, _ in res[i]] == [j for j, _ in exp[i]], (metric, i)
            assert np.allclose([s for _, s in res[i]], [s for _, s in exp[i]])


def test_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [3.0, 2.0]), (2, [0.0, 4.0])],
                               "g int, vec array<float>")
    got = {r.g: list(r.vec) for r in centroids(df, "g").collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 4.0]}


def test_topk_takes_string_ids_and_skips_null_vectors(spark):
    from graphloom.operators.vectors import topk
    schema = "id string, vec array<float>"
    rows = [("doc:1", [1.0, 0.0]), ("doc:2", [0.9, 0.1]), ("doc:3", None), ("doc:4", [0.0, 1.0]), ("doc:5", [None, 1.0]), ("doc:0", [0.9, 0.1])]
    t = spark.createDataFrame(rows, schema)
    got = topk(t.withColumnRenamed("id", "query_id"), t.withColumnRenamed("id", "item_id"), 2, "dot", exclude_self=True)
    assert got.schema["item_id"].dataType.simpleString() == "string"
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append(r.item_id)
    assert by == {"doc:1": ["doc:0", "doc:2"], "doc:2": ["doc:1", "doc:0"], "doc:0": ["doc:1", "doc:2"], "doc:4": ["doc:0", "doc:2"]}
    assert topk(t.limit(0).withColumnRenamed("id", "query_id"), t.withColumnRenamed("id", "item_id"), 2).count() == 0


def test_approx_topk_recall_on_the_embeddings(spark):
    """K3: stated query set against all vectors; the exact neighbours that lie closer than the typical distance are found."""
    from graphloom.operators.vectors import approx_topk, missing_queries, topk
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = v.filter("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS vec")
    c = v.selectExpr("vec_id AS item_id", "embedding AS vec")
    exact = {(r.query_id, r.item_id) for r in topk(q, c, 5, "l2").collect()}
    found = approx_topk(q, c, 5).cache()
    near = {(r.query_id, r.item_id) for r in found.collect()}
    assert len(near & exact) / len(exact) >= 0.9
    assert missing_queries(q, found).count() == 0
