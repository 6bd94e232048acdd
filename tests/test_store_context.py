import tempfile

from pyspark.sql import functions as F

from graphloom.operators.context import ROUTING_RULES, route_questions
from graphloom.sources.store import Store, registry_from_json_columns


def test_store_create_append_writeback(spark):
    st = Store(spark, tempfile.mkdtemp(prefix="gl-store-"))
    assert st.ensure_tables() == ["communities", "community_members", "corrections", "edges", "nodes", "registry"]
    assert st.read("registry").count() == 0
    nodes = spark.createDataFrame([("a", "s1"), ("b", ""), ("c", "s3")], "node_id string, summary string")
    rejected = st.append_nodes(nodes)
    assert [r.node_id for r in rejected.collect()] == ["b"]
    got = {r.node_id: (r.language, r.chunk_type) for r in st.read("nodes").collect()}
    assert got == {"a": ("unknown", "unknown"), "c": ("unknown", "unknown")}
    edges = spark.createDataFrame([("e1", "a", "c", "weird"), ("e2", "a", "", None)],
                                  "edge_id string, source_node_id string, target_node_id string, confidence string")
    st.append_edges(edges)
    e = st.read("edges").collect()
    assert [(r.edge_id, r.confidence, r.type) for r in e] == [("e1", "inferred", "UNKNOWN")]
    members = spark.createDataFrame([("a", "comm:a"), ("zz", "comm:a")], "node_id string, community_id string")
    st.write_back_membership(members)
    got = {r.node_id: r.community_id for r in st.read("nodes").collect()}
    assert got == {"a": "comm:a", "c": None}
    assert "embedding" not in st.read("nodes", with_vectors=False).columns


def test_registry_json_columns(spark):
    df = spark.createDataFrame([("x", '["py", "pyi"]', '[{"type": "CALLS", "confidence": "probabilistic"}]')],
                               "skill_id string, file_types string, edge_types string")
    r = registry_from_json_columns(df).first()
    assert r.file_types == ["py", "pyi"] and r.edge_types[0].type == "CALLS"


def test_routing_precedence(spark):
    q = spark.createDataFrame([
        (1, "What is the blast radius of IOrderRepository?"),
        (2, "What depends on OrderService?"),
        (3, "What does OrderController depend on?"),
        (4, "How do OrderService and Order connect?"),
        (5, "Give me an overview of the payments domain"),
        (6, "Show Order"), (7, "What classes depend on X?"), (8, "Which classes would be impacted if X changes?"),
        (9, "What does class X do?"), (10, "Where is the blinking cursor?"),
        (11, "How does the order domain relate to payments?")], "question_id long, text string")
    got = {r.question_id: (r.route, r.direction, r.depth) for r in route_questions(q).collect()}
    assert got == {1: ("blast_radius", "inbound", 3), 2: ("dependents", "inbound", 2),
                   3: ("dependencies", "outbound", 2), 4: ("connection", "both", 2),
                   5: ("domain", "none", 0), 6: ("lookup", "none", 0), 7: ("dependents", "inbound", 2),
                   8: ("blast_radius", "inbound", 3), 9: ("behaviour", "outbound", 2), 10: ("lookup", "none", 0),
                   11: ("domain", "none", 0)}
    assert len(ROUTING_RULES) == 6


def test_embed_and_approx_topk(spark):
    from graphloom.operators.vectors import approx_topk, embed_text, topk
    docs = spark.createDataFrame([(i, f"order {i % 3} service repository {i}") for i in range(30)],
                                 "id long, text string")
    v = embed_text(docs, "text", dim=32)
    norms = [sum(x * x for x in r.vec) for r in v.collect()]
    assert all(abs(n - 1.0) < 1e-5 for n in norms)
    q = v.select(F.col("id").alias("query_id"), "vec")
    c = v.select(F.col("id").alias("item_id"), "vec")
    exact = {(r.query_id, r.item_id) for r in topk(q, c, 3, "l2").collect()}
    approx = {(r.query_id, r.item_id) for r in approx_topk(q, c, 3).collect()}
    assert len(approx & exact) / len(exact) > 0.8


def test_store_communities_embeds_appends_and_writes_back(spark):
    st = Store(spark, tempfile.mkdtemp(prefix="gl-store2-"))
    st.ensure_tables()
    st.append_nodes(spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s")],
                                          "node_id string, summary string"))
    members = spark.createDataFrame([("comm:a", "a", 0), ("comm:a", "b", 0)],
                                    "community_id string, node_id string, level int")
    summaries = spark.createDataFrame([("comm:a", "orders and payments")],
                                      "community_id string, summary string")
    st.store_communities(members, summaries)
    c = st.read("communities").first()
    assert c.member_node_ids is None and len(c.embedding) == 64
    assert sorted((r.community_id, r.node_id, r.level) for r in st.read("community_members").collect()) == [("comm:a", "a", 0), ("comm:a", "b", 0)]
    got = {r.node_id: r.community_id for r in st.read("nodes").collect()}
    assert got == {"a": "comm:a", "b": "comm:a", "c": None}


def test_extractive_summary_and_correction_rows(spark):
    from graphloom.operators.communities import extractive_summary
    from graphloom.operators.corrections import community_corrections, with_correction_context
    m = spark.createDataFrame([("k", "a", "class", "Order keeps items."), ("k", "b", "method", "x"),
                               ("k", "c", "class", "Service confirms orders.")],
                              "community_id string, node_id string, chunk_type string, summary string")
    s = extractive_summary(m).first().summary
    assert s.startswith("[class:2, method:1] ") and "Service confirms orders." in s
    cor = spark.createDataFrame([("x1", "a", "old", "new")],
                                "correction_id string, target_id string, original string, corrected string")
    assert [r.correction_id for r in community_corrections(m, cor).collect()] == ["x1"]
    chunks = spark.createDataFrame([("n1", "f.py"), ("n2", "g.py")], "node_id string, source_file string")
    by_file = spark.createDataFrame([("f.py", "n1", "x1", "old", "new")],
                                    "source_file string, node_id string, correction_id string, original string, corrected string")
    got = {(r.node_id, r.correction_id) for r in with_correction_context(chunks, by_file).collect()}
    assert got == {("n1", "x1"), ("n2", None)}
