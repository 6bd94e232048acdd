"""Routed retrieval (R2) and its difference between two states of the corrections.

The questions are routed first (R1) and the plan is split by the route: a question about a domain
searches communities, any other one searches nodes, and one whose route names a direction walks the graph from
its best node (GR1).  Corrections are looked up for every question.

Nothing is computed per question that questions share: vectors are searched once per distinct
key terms, each start node is walked once per direction and depth, and corrections are ranked
once per distinct set of words.  Each kind is cut to its best few per key before it
is joined to the questions, so the result grows with the questions alone.  ``best`` is a row
number with a bound, which Spark evaluates with a partial limit before the shuffle, so no
key's rows come together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.context import route_questions
from graphloom.session import cut_lineage

#: Most rows of a kind that a question gets: corrections, communities, nodes, edges.
TOP = {"correction": 5, "community": 3, "node": 5, "edge": 10}
#: Weight of a word that one of N corrections has: N times this.
WEIGHT = 1000
DIMENSIONS = 64


def best(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order, with their ``rank`` from 1.

    Bounds up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) are
    applied to each partition before the shuffle.
    """
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


# ---------------------------------------------------------------- vectors ----

def key_terms(text: str) -> Column:
    """Names in a question: capitalised words that do not begin a sentence, joined by blanks; without any, the whole text."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(^|[.?!]\s+)[A-Za-z]+", " ")
    names = F.regexp_extract_all(body, F.lit("[A-Z][A-Za-z0-9_#]*"), 0)
    return F.when(F.size(names) > 0, F.array_join(names, " ")).otherwise(F.coalesce(F.col(text), F.lit("")))


def letter_pairs(text: str, dimensions: int = DIMENSIONS) -> Column:
    """Counts of neighbouring printable ASCII characters, hashed to ``dimensions``: a vector that needs no model.

    A real embedding replaces this column.
    """
    chars = F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^ -~]", ""), ""), lambda c: F.ascii(c))
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))),
                       lambda a, b: F.pmod(a * 31 + b, F.lit(dimensions)))
    # bound to a variable: a column used inside a lambda is computed again for every dimension
    return F.transform(F.array(pairs), lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda d: (F.size(p) - F.size(F.array_remove(p, d))).cast("double")))[0]


# ------------------------------------------------------------ corrections ----

def rank_corrections(questions: DataFrame, corrections: DataFrame, top: int = TOP["correction"],
                     qw: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """``(question_id, correction_id, score, rank)``: the best corrections of each question.

    The rule that makes a correction match is P6's.  A word that ``df`` of the N corrections have weighs
    ``N * 1000 div df``, a correction scores the sum of the weights of the question's words it has, and ties
    go to the smaller id.

    Questions with the same words are one.  Their candidates come from their essential words only: if a word has
    ``df >= top``, then ``top`` corrections score at least its weight, so corrections that have nothing but words whose
    weights together are less cannot be among the best.  Words that most corrections have are thus looked up for the
    candidates alone.  Written ``question_words`` and ``word_matches`` may be passed as ``qw`` and ``postings``.
    """
    from graphloom.operators.corrections import question_words, word_matches
    if qw is None:
        qw = cut_lineage(question_words(questions))
    if postings is None:
        postings = cut_lineage(word_matches(qw, corrections))
    n = corrections.count()
    weights = cut_lineage(postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
                          .withColumn("weight", F.expr(f"{n * WEIGHT}L div df")))
    known = cut_lineage(qw.join(weights, "word"))
    # a question's words are bounded by its text
    asked = cut_lineage(known.groupBy("question_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("word")), " "), 256).alias("words_id")))
    words = cut_lineage(asked.groupBy("words_id").agg(F.min("question_id").alias("question_id"))
                        .join(known, "question_id").select("words_id", "word", "df", "weight"))
    light_first = Window.partitionBy("words_id").orderBy("weight", "word")
    floor = F.max(F.when(F.col("df") >= top, F.col("weight"))).over(Window.partitionBy("words_id"))
    essential = (words.withColumn("upto", F.sum("weight").over(light_first.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("floor", F.coalesce(floor, F.lit(0).cast("long")))
                 .filter("upto >= floor").select("words_id", "word"))
    candidates = essential.join(postings, "word").select("words_id", "correction_id").distinct()
    scored = (candidates.join(words, "words_id").join(postings, ["word", "correction_id"])
              .groupBy("words_id", "correction_id").agg(F.sum("weight").alias("score")))
    found = best(scored, ["words_id"], [F.desc("score"), F.col("correction_id")], top)
    return asked.join(found, "words_id").select("question_id", "correction_id", "score", "rank")


def correction_changes(questions: DataFrame, before: DataFrame, after: DataFrame, top: int = TOP["correction"]) -> DataFrame:
    """How each question's corrections differ between two states of the corrections.

    Returns ``question_id, correction_id, change, old_rank, new_rank`` with change ``added``, ``removed`` or ``moved``;
    rows whose rank is the same are left out.  The words are looked for in both states at once.
    """
    from graphloom.operators.corrections import matches_of_states, question_words
    qw = cut_lineage(question_words(questions))
    hits = cut_lineage(matches_of_states(qw, before, after))
    old, new = (rank_corrections(questions, c, top, qw, hits.filter(state).select("word", "correction_id"))
                .select("question_id", "correction_id", F.col("rank").alias(r))
                for c, state, r in ((before, "old", "old_rank"), (after, "new", "new_rank")))
    change = F.when(F.col("old_rank").isNull(), "added").when(F.col("new_rank").isNull(), "removed").otherwise("moved")
    return (old.join(new, ["question_id", "correction_id"], "full").filter("NOT (old_rank <=> new_rank)")
            .select("question_id", "correction_id", change.alias("change"), "old_rank", "new_rank"))


# --------------------------------------------------------------- retrieval ----

def _entries(items: DataFrame, k: int) -> DataFrame:
    """``(item_id, vec, ids)``: the distinct vectors of ``items(item_id string, vec or text)``, each with its k smallest ids.

    Of items that are alike only the k smallest ids can be among the k nearest.  ``item_id`` begins with the smallest of them, so that
    entries are ordered as their items are, and is of one entry only.  A text that many items have is made a vector once.
    """
    from graphloom.operators.vectors import _usable
    one = F.struct("item_id").alias("x")  # keeps an id that is null
    if "text" in items.columns:
        texts = best(items.select(F.coalesce("text", F.lit("")).alias("text"), "item_id"), ["text"], [F.col("item_id")], k)
        texts = texts.groupBy("text").agg(F.collect_list(one).alias("ids"))  # k at most
        items = cut_lineage(texts.select(letter_pairs("text").alias("vec"), "ids")).select("vec", F.explode("ids").alias("x")).select("vec", "x.item_id")
    items = items.withColumn("vec", F.col("vec").cast("array<double>")).filter(_usable("vec"))
    entries = best(items.select("vec", "item_id"), ["vec"], [F.col("item_id")], k).groupBy("vec").agg(F.sort_array(F.collect_list(one)).alias("ids"))
    first = F.coalesce(F.col("ids")[0]["item_id"], F.lit(""))
    return cut_lineage(entries.select(F.concat(first, F.lit("\0"), F.sha2(F.to_json("vec"), 256)).alias("item_id"), "vec", "ids"))


def nearest(texts: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``(terms, item_id, distance, rank)`` for distinct ``terms`` of ``texts`` with ``vec``: the k nearest items (L2).

    ``items(item_id, vec)``, or with ``text``, whose ``letter_pairs`` are the vector.
    """
    from graphloom.operators.vectors import topk
    queries = texts.select(F.col("terms").alias("query_id"), "vec")
    if items.schema["item_id"].dataType.simpleString() != "string":
        items = items if "vec" in items.columns else items.select("item_id", letter_pairs("text").alias("vec"))
        found = topk(queries, items, k, "l2")
        return found.select(F.col("query_id").alias("terms"), "item_id", F.col("score").alias("distance"), "rank")
    entries = _entries(items, k)
    # an item among the k nearest is of an entry among the k nearest
    found = topk(queries, entries.select("item_id", "vec"), k, "l2").drop("rank")
    found = found.join(entries.select("item_id", "ids"), "item_id").select(F.col("query_id").alias("terms"), F.col("score").alias("distance"), F.explode("ids").alias("x"))
    return best(found.select("terms", "x.item_id", "distance"), ["terms"], [F.col("distance"), F.col("item_id")], k)


def walk_edges(roots: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """The first edges of every walk: ``root_id, direction, depth, edge_id, confidence, hop, n_edges, rank``.

    ``roots(root_id, direction, depth)``.  Strong confidence first, then near edges, then ids; ``n_edges`` are all
    edges of the walk.  Each root is walked once a direction, to the largest depth that is asked of any.
    """
    from graphloom.operators.traverse import first_edges
    out = None
    for (direction,) in sorted(roots.select("direction").distinct().collect()):  # the routing rules' few
        rows = first_edges(edges, roots.filter(F.col("direction") == direction), direction, top).withColumn("direction", F.lit(direction))
        out = rows if out is None else out.unionByName(rows)
    return out


def retrieve(questions: DataFrame, corrections: DataFrame, nodes: DataFrame, communities: DataFrame,
             edges: DataFrame, top: dict[str, int] | None = None) -> DataFrame:
    """R2: what answers each question, one row per (question, kind, rank).

    ``questions(question_id string, text)``, ``corrections`` as in P6, ``nodes(node_id, vec)`` and
    ``communities(community_id, vec)`` with vectors of ``letter_pairs`` (or any others, if the
    questions have a ``vec`` column too) or with a ``text`` that they are made of, ``edges`` as in GR1.  Returns ``question_id, route, kind,
    kind_order, rank, item, score``: corrections (score: weight of the matched words), then
    communities and nodes (score: squared distance), then edges of the walk (score: edges of the whole walk).  A question without
    any hit has no row; null texts count as empty.
    """
    top = TOP | (top or {})
    routed = route_questions(questions).withColumn("terms", key_terms("text"))
    given = "vec" in questions.columns
    routed = cut_lineage(routed.select("question_id", "text", "route", "target", "direction", "depth", "terms",
                                       *(["vec"] if given else [])))
    if given:  # the vector, not the terms, says which questions ask the same
        routed = routed.withColumn("terms", F.sha2(F.to_json("vec"), 256))
        texts = routed.groupBy("terms", "target").agg(F.any_value("vec").alias("vec"))
    else:
        texts = routed.select("terms", "target").distinct().withColumn("vec", letter_pairs("terms"))
    texts = cut_lineage(texts)

    def rows(kind: str, found: DataFrame, item: str, score: Column) -> DataFrame:
        order = list(TOP).index(kind)
        return found.select("question_id", "route", F.lit(kind).alias("kind"), F.lit(order).alias("kind_order"), "rank",
                            F.col(item).cast("string").alias("item"), score.cast("long").alias("score"))

    squared = F.round(F.col("distance") * F.col("distance"))
    ranked = rank_corrections(routed, corrections, top["correction"]).join(routed.select("question_id", "route"), "question_id")
    out = rows("correction", ranked, "correction_id", F.col("score"))
    hits = {}
    for target, items, name, kind in (("community", communities, "community_id", "community"), ("node", nodes, "node_id", "node")):
        asked = texts.filter(F.col("target") == target)
        found = cut_lineage(nearest(asked, items.select(F.col(name).alias("item_id"), "vec" if "vec" in items.columns else "text"), top[kind]))
        hits[kind] = found
        mine = routed.filter(F.col("target") == target).select("question_id", "route", "terms")
        out = out.unionByName(rows(kind, mine.join(found, "terms"), "item_id", squared))
    start = hits["node"].filter("rank = 1").select("terms", F.col("item_id").cast("string").alias("root_id"))
    walkers = cut_lineage(routed.filter("direction <> 'none' AND target = 'node'").join(start, "terms")
                          .select("question_id", "route", "root_id", "direction", "depth"))
    walks = walk_edges(walkers.select("root_id", "direction", "depth").distinct(), edges, top["edge"])
    if walks is not None:
        out = out.unionByName(rows("edge", walkers.join(walks, ["root_id", "direction", "depth"]), "edge_id", F.col("n_edges")))
    return out
