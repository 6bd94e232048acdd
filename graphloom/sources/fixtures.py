"""Graph, correction and run-log views over the test tables (FIXTURES.md §B).

Every view is a lazy DataFrame derived from the parquet tables, so its size
grows with the tables.  The DuckDB oracle builds the same views from its own
SQL text (``graphloom.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import read_table


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# ---------------------------------------------------------------- ENT ----

def ent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity graph nodes: one per region, nation, customer, supplier, part, order."""
    def part(table, prefix, key, name, chunk_type):
        df = read_table(spark, sf_dir, table)
        return df.select(
            F.concat(F.lit(prefix), _s(key)).alias("node_id"),
            F.lit(chunk_type).alias("chunk_type"),
            F.lit(table).alias("source_file"),
            (_s(name) if name else F.lit(None).cast("string")).alias("summary"),
        )
    return (part("region", "r:", "r_regionkey", "r_name", "region")
            .unionByName(part("nation", "n:", "n_nationkey", "n_name", "nation"))
            .unionByName(part("customer", "c:", "c_custkey", "c_name", "customer"))
            .unionByName(part("supplier", "s:", "s_suppkey", "s_name", "supplier"))
            .unionByName(part("part", "p:", "p_partkey", "p_name", "part"))
            .unionByName(part("orders", "o:", "o_orderkey", "o_orderpriority", "order")))


def _flag_confidence(col: str, det: str, prob: str) -> F.Column:
    c = F.col(col)
    return (F.when(c == det, F.lit("deterministic"))
            .when(c == prob, F.lit("probabilistic"))
            .otherwise(F.lit("inferred")))


def ent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity graph edges (directed, typed, with confidence and evidence)."""
    nation = read_table(spark, sf_dir, "nation")
    customer = read_table(spark, sf_dir, "customer")
    supplier = read_table(spark, sf_dir, "supplier")
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")

    def edge(df, eid, src, tgt, etype, conf, evidence):
        return df.select(
            eid.alias("edge_id"), src.alias("source_node_id"), tgt.alias("target_node_id"),
            F.lit(etype).alias("type"), conf.alias("confidence"), evidence.alias("evidence"))

    nr = edge(nation, F.concat(F.lit("nr:"), _s("n_nationkey")),
              F.concat(F.lit("n:"), _s("n_nationkey")), F.concat(F.lit("r:"), _s("n_regionkey")),
              "INHERITS", F.lit("deterministic"), F.lit("fk"))
    cn = edge(customer, F.concat(F.lit("cn:"), _s("c_custkey")),
              F.concat(F.lit("c:"), _s("c_custkey")), F.concat(F.lit("n:"), _s("c_nationkey")),
              "IMPLEMENTS", F.lit("deterministic"), F.col("c_mktsegment"))
    sn = edge(supplier, F.concat(F.lit("sn:"), _s("s_suppkey")),
              F.concat(F.lit("s:"), _s("s_suppkey")), F.concat(F.lit("n:"), _s("s_nationkey")),
              "IMPLEMENTS", F.lit("deterministic"), F.lit("fk"))
    oc = edge(orders, F.concat(F.lit("oc:"), _s("o_orderkey")),
              F.concat(F.lit("o:"), _s("o_orderkey")), F.concat(F.lit("c:"), _s("o_custkey")),
              "CALLS", _flag_confidence("o_orderstatus", "F", "O"), F.col("o_orderpriority"))
    row_key = F.concat_ws("-", _s("l_orderkey"), _s("l_partkey"), _s("l_suppkey"),
                          _s("l_linenumber"))
    line_conf = _flag_confidence("l_returnflag", "N", "R")
    op = edge(lineitem, F.concat(F.lit("op:"), row_key),
              F.concat(F.lit("o:"), _s("l_orderkey")), F.concat(F.lit("p:"), _s("l_partkey")),
              "USES", line_conf, F.col("l_linestatus"))
    os_ = edge(lineitem, F.concat(F.lit("os:"), row_key),
               F.concat(F.lit("o:"), _s("l_orderkey")), F.concat(F.lit("s:"), _s("l_suppkey")),
               "INJECTS", line_conf, F.col("l_linestatus"))
    return nr.unionByName(cn).unionByName(sn).unionByName(oc).unionByName(op).unionByName(os_)


def ent_roots(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Every row of one entity table as a traversal root (``root_id``)."""
    prefix, key = {"region": ("r:", "r_regionkey"), "nation": ("n:", "n_nationkey"),
                   "customer": ("c:", "c_custkey"), "supplier": ("s:", "s_suppkey"),
                   "part": ("p:", "p_partkey"), "orders": ("o:", "o_orderkey")}[table]
    return read_table(spark, sf_dir, table).select(
        F.concat(F.lit(prefix), _s(key)).alias("root_id"))


# ---------------------------------------------------------------- KNN ----

def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, embedding, label`` straight from the embeddings table."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def knn_edges(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """KNN: undirected k-nearest-neighbour graph (dot product), ``src < dst`` and score."""
    from graphloom.operators.vectors import knn_graph
    return knn_graph(embedding_vectors(spark, sf_dir), k=k, metric="dot")


def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP: the document graph, ``src < dst``, two edges a document at most.

    Documents with the same normalised text, or with the same first line, are
    linked to the smallest id among them: stars, so the edges grow with the
    documents, not with the square of a group.
    """
    d = read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\x0B\f\r]+", " "))
    keys = d.select("doc_id", F.explode(F.array(
        F.sha2(F.concat(F.lit("text:"), plain), 256),
        F.sha2(F.concat(F.lit("line:"), F.substring_index("text", "\n", 1)), 256))).alias("key"))
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("src"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (keys.join(heads, "key").filter("doc_id <> src")
            .select("src", F.col("doc_id").alias("dst")).distinct())


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given labelling of the document graph: ``id, comm`` (the language)."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("comm"))


# ---------------------------------------------------------------- COR ----

def cor_corrections(spark: SparkSession, sf_dir: str, doc_target: bool = False) -> DataFrame:
    """COR: corrections captured from the dialogue table.

    ``doc_target`` points each correction at a document node instead,
    ``'doc:' || (conv_id % number of documents)`` (the J3 variant).
    """
    from graphloom.operators.corrections import capture_from_dialogue
    turns = read_table(spark, sf_dir, "conversations")
    cor = capture_from_dialogue(turns)
    if doc_target:
        n_docs = read_table(spark, sf_dir, "documents").count()  # one scalar
        cor = cor.withColumn("target_id", F.concat(
            F.lit("doc:"), F.pmod(F.col("conv_id"), F.lit(n_docs)).cast("string")))
    return cor


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions table: every benchmark item is a question."""
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), "text")


# Question forms about one entity (or two), with the route each must take.
QUESTION_FORMS = [
    ("blast_radius", "What is the blast radius of %s?"),
    ("blast_radius", "Which classes would be impacted if %s changes?"),
    ("dependents", "What classes depend on %s?"),
    ("dependents", "Who uses %s?"),
    ("dependencies", "What does %s depend on? What are its dependencies?"),
    ("behaviour", "What does class %s do?"),
    ("connection", "How are %s and its region connected?"),
    ("domain", "Give me an overview of the %s domain and how its parts relate"),
    ("lookup", "Where is the blinking cursor of %s?"),
]


def entity_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(question_id, node_id, form, text)``: every question form about every nation and supplier."""
    named = (read_table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), _s("n_nationkey")).alias("node_id"), F.col("n_name").alias("name"))
             .unionByName(read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), _s("s_suppkey")), F.col("s_name"))
                          .toDF("node_id", "name")))
    forms = F.array(*[F.struct(F.lit(i).alias("form"), F.format_string(t, F.col("name")).alias("text"))
                      for i, (_, t) in enumerate(QUESTION_FORMS)])
    return (named.select("node_id", F.explode(forms).alias("f"))
            .select(F.concat_ws("#", "node_id", F.col("f.form").cast("string")).alias("question_id"), "node_id", "f.form", "f.text"))


def all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(question_id, text)``: every question form about every entity, and every benchmark item."""
    items = benchmark_questions(spark, sf_dir)
    return (entity_questions(spark, sf_dir).select("question_id", "text")
            .unionByName(items.select(F.concat(F.lit("item:"), _s("question_id")).alias("question_id"), "text")))


def region_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(community_id, summary)``: one community per region, summarised by its name and its nations' names."""
    nation = (read_table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey"))
              .agg(F.array_join(F.sort_array(F.collect_list("n_name")), " ").alias("nations")))  # some nations a region
    return read_table(spark, sf_dir, "region").join(nation, "r_regionkey", "left").select(
        F.concat(F.lit("comm:r:"), _s("r_regionkey")).alias("community_id"),
        F.concat_ws(" ", "r_name", "nations").alias("summary"))


# -------------------------------------------------------------- TRADE ----

def trade_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRADE: customers and suppliers in a hierarchy ``(id, community, level)``: kind in a nation, nation, region."""
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c:"), _s("c_custkey")).alias("id"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("kind"))
    supplier = read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s:"), _s("s_suppkey")).alias("id"), F.col("s_nationkey").alias("n_nationkey"), F.lit("supplier").alias("kind"))
    member = customer.unionByName(supplier).join(nation, "n_nationkey")
    levels = F.array(F.struct(F.lit(0).alias("level"), F.concat_ws("/", _s("n_nationkey"), F.col("kind")).alias("community")),
                     F.struct(F.lit(1).alias("level"), _s("n_nationkey").alias("community")),
                     F.struct(F.lit(2).alias("level"), F.concat(F.lit("region "), _s("n_regionkey")).alias("community")))
    return member.select("id", F.explode(levels).alias("l")).select("id", "l.community", "l.level")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRADE: customer - supplier pairs ``(src, dst, w)`` with w line items between them."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return (read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey")
            .groupBy(F.concat(F.lit("c:"), _s("o_custkey")).alias("src"), F.concat(F.lit("s:"), _s("l_suppkey")).alias("dst"))
            .agg(F.count(F.lit(1)).alias("w")))


# ------------------------------------------------------------- FOREST ----

def forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """FOREST: ``nodes(id, nation, region)`` and ``edges(src, dst)`` of regions, nations, customers, suppliers and orders.

    Every entity is linked to the one it belongs to, so a region is one component and its nations are
    communities inside it.  Ids are key * 5 + kind.
    """
    def own(c, kind):
        return (F.col(c).cast("long") * 5 + kind)
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    orders = (read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(customer, "c_custkey"))
    place = (F.col("n_nationkey").cast("long").alias("nation"), F.col("n_regionkey").cast("long").alias("region"))
    none = F.lit(None).cast("long")
    nodes = (read_table(spark, sf_dir, "region").select(own("r_regionkey", 0).alias("id"), none.alias("nation"), F.col("r_regionkey").cast("long").alias("region"))
             .unionByName(nation.select(own("n_nationkey", 1).alias("id"), *place))
             .unionByName(customer.select(own("c_custkey", 2).alias("id"), *place))
             .unionByName(supplier.select(own("s_suppkey", 3).alias("id"), *place))
             .unionByName(orders.select(own("o_orderkey", 4).alias("id"), *place)))
    edges = (nation.select(own("n_regionkey", 0).alias("src"), own("n_nationkey", 1).alias("dst"))
             .unionByName(customer.select(own("n_nationkey", 1).alias("src"), own("c_custkey", 2).alias("dst")))
             .unionByName(supplier.select(own("n_nationkey", 1).alias("src"), own("s_suppkey", 3).alias("dst")))
             .unionByName(orders.select(own("c_custkey", 2).alias("src"), own("o_orderkey", 4).alias("dst"))))
    return nodes, edges


# --------------------------------------------------------------- DOCN ----

def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOCN: one node per document; embedding from the embeddings table when present."""
    docs = read_table(spark, sf_dir, "documents")
    emb = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding")
    return (docs.join(emb, "doc_id", "left")
            .select(F.concat(F.lit("doc:"), _s("doc_id")).alias("node_id"),
                    F.col("lang").alias("language"), F.col("source").alias("source_file"),
                    F.lit("document").alias("chunk_type"), F.col("text").alias("raw_cleaned"),
                    F.col("text").alias("summary"),
                    F.lit(None).cast("string").alias("community_id"), "embedding",
                    "doc_id"))


def document_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DROPS: ``(drop, file, n, value)``, the lines of files that change over four drops.

    One file per source and language, one line per document.  Drop 1 has all files, drop 2 the French ones edited,
    drop 3 deletes the German ones, drop 4 brings back the French ones of even sources as they were and, edited,
    the German ones of every fourth source.
    """
    d = read_table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    body = F.translate(F.coalesce("text", F.lit("")), "\n\r\t", "   ")
    d = d.select(F.concat_ws(".", "source", "lang", F.lit("txt")).alias("file"), F.col("doc_id").alias("n"), "lang", number.alias("number"),
                 F.concat_ws("\t", _s("doc_id"), body).alias("value"))
    edited = F.concat("value", F.lit(" (edited)"))
    lines = (d.select(F.lit(1).alias("drop"), "file", "n", "value")
             .unionByName(d.filter("lang = 'fr'").select(F.lit(2).alias("drop"), "file", "n", edited.alias("value")))
             .unionByName(d.filter("lang = 'fr' AND number % 2 = 0").select(F.lit(4).alias("drop"), "file", "n", "value"))
             .unionByName(d.filter("lang = 'de' AND number % 4 = 0").select(F.lit(4).alias("drop"), "file", "n", edited.alias("value"))))
    gone = d.filter("lang = 'de'").select("file").distinct().select(
        F.lit(3).alias("drop"), F.concat("file", F.lit(".deleted")).alias("file"), F.lit(0).cast("long").alias("n"), F.lit("").alias("value"))
    return lines.unionByName(gone)


def named_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAMED: document nodes ``(node_id, source_file, name)`` with a concept name; every tenth shares the name of its language."""
    f = document_files(spark, sf_dir)
    own = F.concat(F.col("source"), F.lit(".Doc"), _s("doc_id"))
    shared = F.concat(F.lit("shared."), F.coalesce("file_type", F.lit("none")))
    return f.select(F.concat(F.lit("doc:"), _s("doc_id")).alias("node_id"), F.col("path").alias("source_file"),
                    F.when(F.pmod("doc_id", F.lit(10)) == 0, shared).otherwise(own).alias("name"))


def named_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAMED: corrections whose target is an id, a path with a scheme, a concept name, its last part, a shared name or nothing known."""
    cor = cor_corrections(spark, sf_dir)
    files = document_files(spark, sf_dir)
    n_docs = files.count()  # one scalar
    docs = files.select("doc_id", "source", "path", F.coalesce("file_type", F.lit("none")).alias("lang"))
    d = cor.withColumn("doc_id", F.pmod("conv_id", F.lit(n_docs))).join(docs, "doc_id")
    key, own = _s("doc_id"), F.concat(F.lit("doc"), _s("doc_id"))
    way = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    target = (F.when(way == 0, F.concat(F.lit("doc:"), key)).when(way == 1, F.concat(F.lit("file://"), "path"))
              .when(way == 2, F.concat(F.lit(" "), F.upper("source"), F.lit("."), F.upper(own), F.lit(" "))).when(way == 3, F.upper(own))
              .when(way == 4, F.concat(F.lit("Shared."), "lang")).otherwise(F.concat(F.lit("Nothing#"), key)))
    return d.select("correction_id", target.alias("target_id"), "original", "corrected")


def checked_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHECKED: one extractor per nation; some lack a handbook, a role or the keyword, some run elsewhere."""
    n, k = F.col("n_nationkey"), _s("n_nationkey")
    return read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("x-"), k).alias("skill_id"), F.concat(F.lit("tool "), "n_name").alias("tool_name"),
        F.when(n % 4 != 0, F.concat(F.lit("Uses the "), F.when(n % 3 == 0, "Native-Parser").otherwise("regex"))).alias("handbook"),
        F.when(n % 5 == 0, "import native-parser").otherwise("").alias("extraction_script"),
        F.concat(F.lit("say "), k).alias("summarisation_instructions"), F.when(n % 7 == 0, " ").otherwise("role").alias("application_role"),
        F.when(n % 6 == 0, "node").otherwise("python").alias("execution_environment"))


# ---------------------------------------------------------------- RUN ----

def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUN: a run log derived from the events table (one run per event)."""
    ev = read_table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    return ev.select(
        "event_id", "ts",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("event_type").alias("sprint"),
        F.concat(F.lit("v00"), F.pmod(uid, F.lit(7)).cast("string")).alias("prompt_version"),
        F.when(F.pmod(eid, F.lit(11)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("event_type"), F.lit("_v001"))).alias("suite_version"),
        F.when(F.pmod(uid, F.lit(5)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("model-"), F.pmod(uid, F.lit(3)).cast("string")))
        .alias("orchestrator_model"),
        F.when(F.pmod(eid, F.lit(13)) == 0, F.lit(None).cast("boolean"))
        .otherwise(F.col("value") > 20).alias("passed"),
        F.col("value").cast("decimal(18,6)").alias("cost_usd"),
        F.get_json_object("props", "$.k").cast("long").alias("in_tokens"),
        F.pmod(eid, F.lit(1000)).cast("long").alias("out_tokens"),
        F.pmod(eid, F.lit(50)).cast("long").alias("nodes"),
        F.pmod(eid, F.lit(30)).cast("long").alias("edges"),
        F.concat(F.lit("runs/"), eid.cast("string")).alias("run_dir"),
        (F.pmod(eid, F.lit(17)) == 0).alias("canonical"),
    )


# ---------------------------------------------------------------- LNK ----

def lnk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LNK nodes: distinct URL paths of the pages."""
    from graphloom.functions.text import url_path
    return (read_table(spark, sf_dir, "pages").select(url_path("url").alias("node_id"))
            .distinct())


def lnk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LNK edges: page path -> each ``href`` value (type LINKS, deterministic)."""
    from graphloom.functions.text import url_path
    from graphloom.operators.extract import HTML_PATTERNS
    p = read_table(spark, sf_dir, "pages")
    links = p.select("page_id", url_path("url").alias("source_node_id"),
                     F.posexplode(F.regexp_extract_all("html", F.lit(HTML_PATTERNS["link"]), 1))
                     .alias("pos", "target_node_id"))
    return links.select(
        F.concat(F.lit("l:"), _s("page_id"), F.lit(":"), (F.col("pos") + 1).cast("string"))
        .alias("edge_id"),
        "source_node_id", "target_node_id", F.lit("LINKS").alias("type"),
        F.lit("deterministic").alias("confidence"), F.lit("href").alias("evidence"), "page_id")


# --------------------------------------------------------------- SYM ----

def symbol_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """SYM: ``(references, definitions)`` of names, as extractors give them.

    Every supplier defines its name and, in the file of its nation, the name of
    that nation; every order refers to a supplier name (by its key), to the name of its
    customer's nation or to an unknown name.
    """
    sup = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    file_of = F.concat(F.lit("nation"), _s("s_nationkey"), F.lit(".py"))
    defs = sup.select(F.concat(F.lit("s:"), _s("s_suppkey")).alias("node_id"), file_of.alias("source_file"), F.explode(
        F.array("s_name", F.when(F.pmod("s_suppkey", F.lit(3)) == 0, F.col("n_name")))).alias("name")).filter("name IS NOT NULL")
    cust = read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read_table(spark, sf_dir, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    n_suppliers = read_table(spark, sf_dir, "supplier").count()  # one scalar
    name = (F.when(F.pmod(key, F.lit(4)) == 0, F.col("n_name"))
            .when(F.pmod(key, F.lit(4)) == 1, F.lit("Unknown#name"))
            .otherwise(F.concat(F.lit("Supplier#"), F.lpad((F.pmod(key, F.lit(n_suppliers)) + 1).cast("string"), 9, "0"))))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("IMPORTS", "CALLS", "INHERITS", "MENTIONS")]), (F.pmod(key, F.lit(4)) + 1).cast("int"))
    refs = orders.select(F.concat(F.lit("o:"), key.cast("string")).alias("node_id"),
                         F.concat(F.lit("nation"), _s("c_nationkey"), F.lit(".py")).alias("source_file"),
                         name.alias("name"), kinds.alias("kind"))
    return refs, defs


# ---------------------------------------------------------------- API ----

def api_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """API: ``routes(route_id, template)``, ``specs(operation, template)`` and ``calls(call_id, url, operation)``.

    Suppliers, nations and regions give routes with fixed and parameter segments, some suppliers and nations a spec, and
    every order makes a call: fixed, partly dynamic, by operation or to no route.
    """
    sup = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    k, n = _s("k"), _s("n")
    kind = F.pmod("k", F.lit(3))
    routes = sup.select(F.concat(F.lit("rt:s"), k).alias("route_id"),
                        F.when(kind == 0, F.concat(F.lit("/api/suppliers/"), k))
                        .when(kind == 1, F.concat(F.lit("/api/nations/"), n, F.lit("/suppliers/{id}")))
                        .otherwise(F.concat(F.lit("/api/suppliers/:id/parts/"), F.pmod("k", F.lit(7)).cast("string"))).alias("template"))
    routes = (routes.unionByName(nation.select(F.concat(F.lit("rt:n"), n), F.concat(F.lit("/api/{kind}/"), n)).toDF("route_id", "template"))
              .unionByName(read_table(spark, sf_dir, "region").select(F.concat(F.lit("rt:r"), _s("r_regionkey")).alias("route_id"),
                                                                       F.lit("/api/{kind}/{id}").alias("template"))))
    specs = (sup.filter("k % 6 = 0").select(F.concat(F.lit("getSupplier"), k).alias("operation"), F.concat(F.lit("/api/suppliers/"), k).alias("template"))
             .unionByName(nation.filter("n % 2 = 0").select(F.concat(F.lit("listNation"), n).alias("operation"),
                                                            F.concat(F.lit("/api/nations/"), n, F.lit("/suppliers/{id}")).alias("template"))))
    n_suppliers = sup.count()  # one scalar
    key, form = F.col("o_orderkey"), F.pmod("o_custkey", F.lit(8))
    supplier, place = (F.pmod(key, F.lit(n_suppliers)) + 1).cast("string"), F.pmod(key, F.lit(25)).cast("string")
    url = (F.when(form == 0, F.concat(F.lit("/api/suppliers/"), supplier, F.lit("?x=1")))
           .when(form == 1, F.concat(F.lit("/api/nations/"), place, F.lit("/suppliers/${sid}")))
           .when(form == 2, F.concat(F.lit("https://host.example/api/suppliers/"), supplier, F.lit("/parts/"), F.pmod(key, F.lit(9)).cast("string")))
           .when(form == 4, F.concat(F.lit("/api/${kind}/"), place)).when(form == 5, F.concat(F.lit("/${base}/suppliers/"), supplier))
           .when(form == 6, F.concat(F.lit("/api/orders/"), key.cast("string"), F.lit("/lines")))
           .when(form == 7, F.concat(F.lit("/api/nations/"), place, F.lit("#top"))))
    operation = (F.when(form == 3, F.concat(F.lit("getSupplier"), supplier)).when(form == 7, F.concat(F.lit("op"), key.cast("string"))))
    calls = read_table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), key.cast("string")).alias("call_id"), url.alias("url"),
                                                       operation.alias("operation"))
    return routes, specs, calls


# ---------------------------------------------------------------- REG ----

def registry(spark: SparkSession) -> DataFrame:
    """REG: the extractor registry (user configuration, two extractors)."""
    from graphloom.schemas import REGISTRY
    rows = [("x-en", "english-prose", ["en", ".en"], ["paragraph"], [("BELONGS_TO", "deterministic")],
             [], "builtin", "python", "extract", "", "", None, 1),
            ("x-fr", "french-prose", ["fr", ".fr"], ["paragraph"], [("BELONGS_TO", "deterministic")],
             [], "builtin", "python", "extract", "", "", None, 1)]
    return spark.createDataFrame(rows, REGISTRY)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen as files: ``path = source/doc_<id>.<ext>`` with a spread of extensions."""
    # Extensions given to the document files, by doc_id mod 10.
    exts = ["py", "ts", "scss", "cs", "tsx", "md", "json", "yml", "proto", "txt"]
    arr = F.array(*[F.lit(e) for e in exts])
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("file_type"), "source", "text",
                    F.concat(F.col("source"), F.lit("/doc_"), _s("doc_id"), F.lit("."),
                             F.element_at(arr, (F.pmod(F.col("doc_id"), F.lit(10)) + 1).cast("int")))
                    .alias("path"))
