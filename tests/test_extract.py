import os

from pyspark.sql import functions as F

from graphloom.operators.infer import infer_cross_file_edges
from graphloom.operators.traverse import traverse
from graphloom.sources.files import (chunks_to_graph, definitions, run_extractors, scan_files,
                                     sample_heads)

DATA = os.path.join(os.path.dirname(__file__), "data")


def test_scan_empty_match_is_empty(spark):
    assert scan_files(spark, os.path.join(DATA, "orders_py"), "*.nothing").count() == 0


def test_python_suite_end_to_end(spark):
    files = scan_files(spark, os.path.join(DATA, "orders_py"), "*.py")
    assert files.count() == 5
    heads = sample_heads(files, 50).collect()
    assert len(heads) == 1 and heads[0].path.endswith("broken.py")
    chunks = run_extractors(files)
    nodes, refs, rejects = chunks_to_graph(chunks)
    rej = rejects.collect()
    assert len(rej) == 1 and rej[0].error_class == "SyntaxError"
    names = {r.name for r in nodes.collect()}
    assert {"Order", "OrderRepository", "IOrderRepository", "OrderService", "OrderController",
            "OrderService.confirm_order"} <= names
    edges = infer_cross_file_edges(refs, definitions(nodes))
    by_name = {r.node_id: r.name for r in nodes.collect()}
    named = {(by_name.get(r.source_node_id), r.type, by_name.get(r.target_node_id, r.target_node_id),
              r.confidence) for r in edges.collect()}
    assert ("OrderRepository", "INHERITS", "IOrderRepository", "deterministic") in named
    assert ("OrderService", "INJECTS", "IOrderRepository", "deterministic") in named
    assert ("OrderController", "INJECTS", "OrderService", "deterministic") in named
    assert ("service.py", "IMPORTS", "Order", "deterministic") in named
    # blast radius of the interface reaches the implementation, service and controller
    iid = [k for k, v in by_name.items() if v == "IOrderRepository"]
    t = traverse(edges, spark.createDataFrame([(iid[0],)], "root_id string"), 3, "inbound")
    hit = {by_name.get(r.node_id) for r in t.nodes.collect()}
    assert {"OrderRepository", "OrderService", "OrderController"} <= hit


def test_typescript_extractor(spark):
    files = scan_files(spark, os.path.join(DATA, "orders_ts"), "*.ts")
    nodes, refs, _ = chunks_to_graph(run_extractors(files))
    r = {(x.name, x.kind) for x in refs.join(nodes.select("node_id", F.col("name").alias("src")),
                                             "node_id").select(F.col("src"), "name", "kind")
         .withColumnRenamed("src", "s").select(F.concat_ws(">", "s", "name").alias("name"), "kind")
         .collect()}
    assert ("OrderRepository>IOrderRepository", "IMPLEMENTS") in r
    assert ("OrderService>IOrderRepository", "INJECTS") in r
    assert ("OrderService.confirmOrder>findById", "CALLS") in r


def test_scss_extractor(spark):
    files = scan_files(spark, os.path.join(DATA, "card_scss"), "*.scss")
    nodes, refs, _ = chunks_to_graph(run_extractors(files))
    kinds = {(r.chunk_type, r.name) for r in nodes.collect()}
    assert ("variable", "$card-padding") in kinds and ("mixin", "card-shadow") in kinds
    assert ("infrastructure-rule", "*") in kinds and ("style-rule", ".card") in kinds
    assert ("bem-element", ".card__title") in kinds and ("import", "variables") in kinds
    k = {(r.name, r.kind) for r in refs.collect()}
    assert ("card-shadow", "INCLUDES") in k and (".card", "EXTENDS") in k
