"""Community hierarchy (GR7): parents, roll-ups and ancestors.

A hierarchy is given as the membership of every node at every level,
``(id, community, level)``, level 0 the finest.  ``community_tree`` turns it into
one row per community with its parent on the next level.  Everything above level 0
is computed from the level below it, so members and edges are read once
and the tables shrink with each level.  Community ids of different
levels may be equal; the tree's ids hold the level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, release


def tree_id(level, community) -> Column:
    """Id of a community in the tree: ``comm:<level>:<community>``."""
    c = F.col(community) if isinstance(community, str) else community
    return F.concat_ws(":", F.lit("comm"), F.col(level) if isinstance(level, str) else F.lit(level), c.cast("string"))


def parent_links(levels: DataFrame) -> DataFrame:
    """``(community, level, parent, nested)``: the community of the next level that has the members.

    ``nested`` is false where members of one community lie in several communities of the next
    level (then the smallest is the parent) or in none; the top level has no parent and is nested.
    """
    above = levels.select("id", F.col("community").alias("up"), (F.col("level") - 1).alias("level"))
    top = levels.agg(F.max("level")).first()[0]
    return (levels.join(above, ["id", "level"], "left")
            .groupBy("community", "level")
            .agg(F.min("up").alias("parent"), F.max("up").alias("last"), F.count(F.lit(1)).alias("n"), F.count("up").alias("n_up"))
            .select("community", "level", "parent",
                    ((F.col("level") == F.lit(top))
                     | ((F.col("n_up") == F.col("n")) & (F.col("parent") == F.col("last")))).alias("nested")))


def community_tree(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """GR7: one row per community of every level.

    ``levels(id, community, level)``, ``edges(src, dst[, w])`` (undirected, w = 1
    where absent).  Returns ``community_id, level, parent_id, n_members, n_children,
    inner_weight, cut_weight``: the weight of edges inside the community and of
    edges that leave it.  Edges with an end in no community count for neither.
    Levels that are not nested raise ``ValueError``.
    """
    lv = cut_lineage(levels.select("id", "community", F.col("level").cast("int").alias("level")).distinct())
    links = cut_lineage(parent_links(lv))
    if not links.filter("NOT nested").isEmpty():
        raise ValueError("a community's members lie in several communities of the next level")
    n_levels = (links.agg(F.max("level")).first()[0] + 1) if not links.isEmpty() else 0
    finest = lv.filter("level = 0").select("id", "community")
    weight = (F.col("w") if "w" in edges.columns else F.lit(1)).cast("long").alias("w")
    ends = finest.withColumnRenamed("id", "src").withColumnRenamed("community", "a")
    pairs = (edges.select("src", "dst", weight).join(ends, "src")
             .join(finest.withColumnRenamed("id", "dst").withColumnRenamed("community", "b"), "dst"))
    between = cut_lineage(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
    size = cut_lineage(finest.groupBy("community").agg(F.count(F.lit(1)).alias("n_members"), F.lit(0).cast("long").alias("n_children")))
    out = None
    for level in range(n_levels):
        own = links.filter(F.col("level") == level).select("community", "parent")
        part = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("community"), F.col("w").alias("inner"), F.lit(0).cast("long").alias("cut"))))
        part = part.otherwise(F.array(*[F.struct(F.col(c).alias("community"), F.lit(0).cast("long").alias("inner"), F.col("w").alias("cut")) for c in "ab"]))
        weights = (between.select(F.explode(part).alias("x")).select("x.*").groupBy("community")
                   .agg(F.sum("inner").alias("inner_weight"), F.sum("cut").alias("cut_weight")))
        rows = (size.join(own, "community").join(weights, "community", "left")
                .select(tree_id(level, "community").alias("community_id"), F.lit(level).alias("level"),
                        F.when(F.col("parent").isNotNull(), tree_id(level + 1, "parent")).alias("parent_id"),
                        "n_members", "n_children", F.coalesce("inner_weight", F.lit(0)).cast("long").alias("inner_weight"),
                        F.coalesce("cut_weight", F.lit(0)).cast("long").alias("cut_weight")))
        out = rows if out is None else out.unionByName(rows)
        if level + 1 < n_levels:
            size = cut_lineage(size.join(own, "community").groupBy(F.col("parent").alias("community"))
                               .agg(F.sum("n_members").alias("n_members"), F.count(F.lit(1)).alias("n_children")))
            up_a, up_b = (own.select(F.col("community").alias(c), F.col("parent").alias(f"up_{c}")) for c in "ab")
            between = cut_lineage(between.join(up_a, "a").join(up_b, "b")
                                  .groupBy(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
                                  .agg(F.sum("w").alias("w")))
    if out is None:
        return levels.sparkSession.createDataFrame([], "community_id string, level int, parent_id string, n_members long, "
                                                       "n_children long, inner_weight long, cut_weight long")
    return out


def ancestors(tree: DataFrame) -> DataFrame:
    """``(community_id, ancestor_id, distance)``: every community above each one, itself at distance 0.

    Paths double each round, so the rounds are the logarithm of the depth; a parent that leads
    back to its child raises ``ValueError``.
    """
    n = tree.count()
    step = cut_lineage(tree.filter("parent_id IS NOT NULL").select("community_id", F.col("parent_id").alias("ancestor_id"),
                                                                   F.lit(1).cast("long").alias("distance")))
    closure, jump, reach = step, step, 1
    while True:
        # paths of `reach` exactly, put together with everything up to `reach`
        longer = (jump.select("community_id", F.col("ancestor_id").alias("via"), F.col("distance").alias("d"))
                  .join(closure.select(F.col("community_id").alias("via"), "ancestor_id", "distance"), "via")
                  .select("community_id", "ancestor_id", (F.col("d") + F.col("distance")).alias("distance")))
        more = cut_lineage(longer)
        if more.isEmpty():
            release(more)
            break
        reach *= 2
        if reach > 2 * n:
            raise ValueError("a community is its own ancestor")
        closure = closure.unionByName(more)
        jump = more.filter(F.col("distance") == reach)
    own = tree.select("community_id", F.col("community_id").alias("ancestor_id"), F.lit(0).cast("long").alias("distance"))
    return own.unionByName(closure)


def rolled_up(closure: DataFrame, values: DataFrame, *measures: str) -> DataFrame:
    """Sums of additive ``measures`` of ``values(community_id, ...)`` over every community and all below it."""
    at = values.groupBy("community_id").agg(*[F.sum(m).alias(m) for m in measures])
    return (closure.join(at, "community_id").groupBy(F.col("ancestor_id").alias("community_id"))
            .agg(*[F.sum(m).alias(m) for m in measures]))


def louvain_levels(edges: DataFrame, nodes: DataFrame | None = None, **kw) -> DataFrame:
    """Membership ``(id, community, level)`` at every level of Louvain, level 0 the finest."""
    from graphloom.operators.louvain import louvain_hierarchy
    return louvain_hierarchy(edges, nodes, **kw)[0]
