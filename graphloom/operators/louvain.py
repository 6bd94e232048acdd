"""Distributed Louvain community detection (GR5) on DataFrames.

Synchronous local moves (Blondel et al. 2008; parallel variant after Lu,
Halappanavar and Kalyanaraman 2015):

* with ``follow``, first every node without a self-loop that has one neighbour follows it
  ("vertex following" there): no partition of greatest modularity parts the two.  Where there
  are such nodes, the followed nodes are level 0, and only they take part in the rounds;
* state ``labels(id, comm)``, node strength ``k_i`` (a self-loop adds twice
  its weight), community totals ``tot_C``, total weight ``2m``;
* every movable node scores each neighbouring community ``C`` (its own
  included, with itself removed from ``tot``) with the integer
  ``2m * k_i,C - k_i * tot_C`` and moves to the best one only if that is
  strictly better than staying; ties go to the smaller community id;
* rounds alternate between two halves of the nodes (a hash bit of the id), and a singleton joins another
  singleton only when the target id is smaller (with ``follow``: when the target is stronger, or
  as strong and of smaller id), so two nodes never swap;
* a round is kept only if modularity does not fall; a level ends after two
  successive rounds without a kept move, then the graph is contracted
  (communities become nodes, inner edges self-loops) and the next level
  starts.  No randomness: the result depends on the ids only.

Every round is one set of joins and aggregations; the driver reads three
scalars per round (moves, modularity) and nothing else.  State is written
to the shared checkpoint folder every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, release

DEC = "decimal(38,0)"
#: Tables that grow with the graph are never sent to every task: each round would pass them through the driver again.
SPREAD = "merge"


def _strength(arcs: DataFrame, loops: DataFrame) -> DataFrame:
    a = arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("ka"))
    return (loops.hint(SPREAD).join(a, "id", "full")
            .select("id", (F.coalesce("ka", F.lit(0)) + 2 * F.coalesce("wl", F.lit(0)))
                    .cast("long").alias("k")))


def _modularity(arcs: DataFrame, loops: DataFrame, k: DataFrame, labels: DataFrame,
                two_m: int) -> tuple[int, int]:
    """Modularity of ``labels(id, comm, k[, moved])`` times (2m)^2, an exact integer, and the moved nodes; one job."""
    if "moved" not in labels.columns:
        labels = labels.withColumn("moved", F.lit(0))
    lab_s = labels.select(F.col("id").alias("src"), F.col("comm").alias("cs"))
    lab_d = labels.select(F.col("id").alias("dst"), F.col("comm").alias("cd"))
    zero = F.lit(0).cast("long")
    inner = (arcs.join(lab_s.hint(SPREAD), "src").join(lab_d.hint(SPREAD), "dst")
             .filter(F.col("cs") == F.col("cd"))
             .select(F.col("cs").alias("comm"), F.col("w").cast("long").alias("inw"),
                     zero.alias("kw"), zero.alias("mv")))
    loop_rows = (loops.hint(SPREAD).join(labels, "id")
                 .select("comm", (2 * F.col("wl")).cast("long").alias("inw"),
                         zero.alias("kw"), zero.alias("mv")))
    k_rows = labels.select("comm", zero.alias("inw"), F.col("k").alias("kw"),
                           F.col("moved").cast("long").alias("mv"))
    per = (inner.unionByName(loop_rows).unionByName(k_rows)
           .groupBy("comm").agg(F.sum("inw").alias("inw"), F.sum("kw").alias("tot"),
                                F.sum("mv").alias("mv")))
    square = F.col("tot").cast("decimal(19,0)") * F.col("tot").cast("decimal(19,0)")
    row = per.agg(F.sum("inw").alias("inw"), F.sum(square.cast(DEC)).alias("squares"), F.sum("mv").alias("mv")).first()
    return int(row["inw"] or 0) * two_m - int(row["squares"] or 0), int(row["mv"] or 0)


def _round(arcs: DataFrame, k: DataFrame, labels: DataFrame, two_m: int, parity: int,
           sample_bits: int = 0, salt: int = 0, by_strength: bool = False) -> DataFrame:
    """One synchronous move round; returns new labels (lazy).

    Only nodes of the given id parity may move, and with ``sample_bits > 0``
    only the ``1 / 2**sample_bits`` of them selected by a hash of (id, salt):
    after a rejected round fewer nodes move at once, so conflicting moves
    become rare and the next round can be kept.
    """
    lab_d = labels.select(F.col("id").alias("dst"), F.col("comm").alias("c"))
    kin = (arcs.join(lab_d.hint(SPREAD), "dst").groupBy(F.col("src").alias("id"), "c")
           .agg(F.sum("w").alias("kic")))
    # labels carry each node's strength k, so no join with the strength table
    tot = labels.groupBy("comm").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
    me = (labels
          .filter(F.pmod(F.xxhash64(F.col("id"), F.lit("side")), F.lit(2)) == parity)
          .filter(F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(1 << sample_bits)) == 0)
          .join(tot.select(F.col("comm"), F.col("tot").alias("tot_own"),
                           F.col("size").alias("size_own")).hint(SPREAD), "comm"))
    cand = (kin.join(me.hint(SPREAD), "id")
            .join(tot.select(F.col("comm").alias("c"), F.col("tot").alias("tot_c"),
                             F.col("size").alias("size_c")).hint(SPREAD), "c"))
    own = F.col("c") == F.col("comm")
    tot_eff = F.when(own, F.col("tot_c") - F.col("k")).otherwise(F.col("tot_c"))
    score = (F.lit(two_m).cast(DEC) * F.col("kic").cast(DEC)
             - F.col("k").cast(DEC) * tot_eff.cast(DEC))
    later = F.col("c") > F.col("comm")
    if by_strength:  # the lighter joins the heavier, so a hub does not leave while its neighbours come to it
        later = (F.col("tot_c") < F.col("k")) | ((F.col("tot_c") == F.col("k")) & later)
    allowed = own | ~((F.col("size_own") == 1) & (F.col("size_c") == 1) & later)
    cand = cand.withColumn("score", score).filter(allowed)
    best = (cand.groupBy("id")
            .agg(F.max_by(F.struct(F.col("score"), (-F.col("c")).alias("neg_c")),
                          F.struct(F.col("score"), (-F.col("c")).alias("neg_c"))).alias("b"),
                 F.max(F.when(own, F.col("score"))).alias("own_score"),
                 F.first(F.col("k")).alias("k"), F.first("tot_own").alias("tot_own"))
            .select("id", F.col("b.score").alias("best_score"),
                    (-F.col("b.neg_c")).alias("best_c"),
                    # staying where the node has no neighbour: k_i,own = 0
                    F.coalesce("own_score",
                               -(F.col("k").cast(DEC) * (F.col("tot_own") - F.col("k")).cast(DEC)))
                    .alias("own_score")))
    moves = best.filter(F.col("best_score") > F.col("own_score")).select(
        "id", F.col("best_c").alias("new_comm"))
    return (labels.join(moves.hint(SPREAD), "id", "left")
            .select("id", F.coalesce("new_comm", "comm").alias("comm"), "k",
                    F.col("new_comm").isNotNull().cast("int").alias("moved")))


def _contracted(arcs: DataFrame, loops: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs and loops of the graph whose nodes are the communities of ``labels(id, comm)``."""
    lab_s = labels.select(F.col("id").alias("src"), F.col("comm").alias("cs"))
    lab_d = labels.select(F.col("id").alias("dst"), F.col("comm").alias("cd"))
    moved = arcs.join(lab_s.hint(SPREAD), "src").join(lab_d.hint(SPREAD), "dst")
    new_arcs = (moved.filter(F.col("cs") != F.col("cd"))
                .groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst"))
                .agg(F.sum("w").alias("w")))
    inner_loops = (moved.filter(F.col("cs") == F.col("cd"))
                   .groupBy(F.col("cs").alias("id")).agg((F.sum("w") / 2).cast("long").alias("wl")))
    old_loops = loops.hint(SPREAD).join(labels, "id").select(F.col("comm").alias("id"), "wl")
    new_loops = (inner_loops.unionByName(old_loops).groupBy("id")
                 .agg(F.sum("wl").cast("long").alias("wl")))
    return new_arcs, new_loops


def _followers(arcs: DataFrame, loops: DataFrame) -> DataFrame:
    """``(id, comm)`` of every node without a loop that has one neighbour only, and that neighbour.

    Of two such nodes that are linked with each other the larger id follows the smaller.
    """
    ends = arcs.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("comm"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    leaves = cut_lineage(ends.join(loops.select("id").hint(SPREAD), "id", "left_anti").select("id", "comm"))
    back = leaves.select(F.col("comm").alias("id"), F.col("id").alias("comm"))
    both = leaves.hint(SPREAD).join(back.hint(SPREAD), ["id", "comm"]).filter("id < comm")
    out = cut_lineage(leaves.join(both.select("id").hint(SPREAD), "id", "left_anti"))
    release(leaves)
    return out


def louvain(edges: DataFrame, nodes: DataFrame | None = None, max_levels: int | None = None,
            max_rounds: int | None = None, return_levels: bool = False, min_gain: float = 1e-9,
            max_sample_bits: int = 8, follow: bool = False):
    """Communities of an undirected graph given as ``edges(src, dst)`` (long ids).

    ``nodes(id)`` adds isolated nodes (each stays alone).  Returns
    ``(membership(id, community, level), history)`` where ``history`` holds
    per level the number of communities and the modularity (scalars only).
    ``community`` is the id of one member (the community's seed node).

    A level ends when neither parity yields a kept move any more (rejected
    rounds are retried with 1/2, 1/4, ... of the movers, down to
    ``2 ** -max_sample_bits``), and the run when a level moves nothing.  A bound on
    levels or rounds may be passed; it raises when it is hit.  ``follow`` is for graphs of
    hubs and many nodes of one neighbour, where rounds over all nodes take long to settle.
    """
    e = edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    # the input may be an expensive lazy plan (e.g. a KNN join): compute it once
    pairs = cut_lineage(e.select(F.least("a", "b").alias("a"),
                                 F.greatest("a", "b").alias("b")).distinct())
    loops = pairs.filter(F.col("a") == F.col("b")).select(
        F.col("a").alias("id"), F.lit(1).cast("long").alias("wl"))
    und = pairs.filter(F.col("a") != F.col("b"))
    arcs = (und.select(F.col("a").alias("src"), F.col("b").alias("dst"))
            .unionByName(und.select(F.col("b").alias("src"), F.col("a").alias("dst")))
            .withColumn("w", F.lit(1).cast("long")))
    ids = arcs.select(F.col("src").alias("id")).unionByName(loops.select("id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.select(F.col("id").cast("long")))
    ids = cut_lineage(ids.distinct())
    # membership of every original node in the current level's node ids
    member = cut_lineage(ids.select("id", F.col("id").alias("node")))
    arcs, loops = cut_lineage(arcs), cut_lineage(loops)
    history: list[dict] = []
    levels: list[DataFrame] = []
    cur_ids = ids

    leaves = _followers(arcs, loops) if follow else None
    n_follow = leaves.count() if follow else 0
    if n_follow:
        labels = (ids.join(leaves.hint(SPREAD), "id", "left")
                  .select("id", F.coalesce("comm", "id").alias("comm")))
        old = [member, arcs, loops, leaves]
        member = cut_lineage(labels.select("id", F.col("comm").alias("node")))
        labels = member.select("id", F.col("node").alias("comm"))
        levels.append(member.select("id", F.col("node").alias("community"), F.lit(0).alias("level")))
        new_arcs, new_loops = _contracted(arcs, loops, labels)
        arcs, loops = cut_lineage(new_arcs), cut_lineage(new_loops)
        cur_ids = cut_lineage(labels.select(F.col("comm").alias("id")).distinct())
        for t in old:
            release(t)

    level = len(levels) - 1
    while True:
        level += 1
        if max_levels is not None and level == max_levels:
            raise RuntimeError(f"communities not settled after {max_levels} levels")
        k = cut_lineage(_strength(arcs, loops).hint(SPREAD).join(cur_ids, "id", "right")
                        .select("id", F.coalesce("k", F.lit(0)).cast("long").alias("k")))
        two_m = int(k.agg(F.sum("k")).first()[0] or 0)
        labels = k.select("id", F.col("id").alias("comm"), "k")
        if two_m == 0:
            break
        q, _ = _modularity(arcs, loops, k, labels, two_m)
        if levels and not history:
            history.append({"level": 0, "rounds": 0, "moves": n_follow,
                            "communities": cur_ids.count(), "modularity": round(q / two_m ** 2, 6)})
        quiet, moved_level, rnd = 0, 0, 0
        bits_by_parity = [0, 0]
        state = None  # the written table behind labels
        while quiet < 2:
            if max_rounds is not None and rnd == max_rounds:
                raise RuntimeError(f"level {level} not settled after {max_rounds} rounds")
            parity = rnd % 2
            bits = bits_by_parity[parity]
            cand = cut_lineage(_round(arcs, k, labels, two_m, parity, bits, rnd, follow))
            q_new, n_moved = _modularity(arcs, loops, k, cand, two_m)
            accepted = bool(n_moved) and q_new >= q  # exact integers: no order of sums can change the result
            if accepted:
                progress = (q_new - q) / two_m ** 2 > min_gain
                old, state = state, cand
                labels, q = cand.select("id", "comm", "k"), q_new
                if old is not None:
                    release(old)
                moved_level += n_moved
                quiet = 0 if progress else quiet + 1
            elif n_moved and bits < max_sample_bits:
                # too many simultaneous moves in this parity class: fewer movers from now on
                bits_by_parity[parity] = bits + 1
            else:
                quiet += 1
            if cand is not state:
                release(cand)
            rnd += 1
        n_comm = labels.select("comm").distinct().count()
        history.append({"level": level, "rounds": rnd, "moves": moved_level,
                        "communities": n_comm, "modularity": round(q / two_m ** 2, 6)})
        if moved_level == 0:
            break
        # contract: communities become nodes, inner edges become self-loops
        member = cut_lineage(member.join(labels.withColumnRenamed("id", "node").hint(SPREAD), "node")
                             .select("id", F.col("comm").alias("node")))
        levels.append(member.select("id", F.col("node").alias("community"),
                                    F.lit(level).alias("level")))
        new_arcs, new_loops = _contracted(arcs, loops, labels)
        old = [arcs, loops, k, cur_ids]
        arcs, loops = cut_lineage(new_arcs), cut_lineage(new_loops)
        cur_ids = cut_lineage(labels.select(F.col("comm").alias("id")).distinct())
        for t in [*old, *([state] if state is not None else [])]:  # the level below is in the new tables
            release(t)

    out = member.select("id", F.col("node").alias("community"),
                        F.lit(len(levels)).alias("level"))
    if return_levels:
        all_levels = levels[0] if levels else out
        for lv in levels[1:]:
            all_levels = all_levels.unionByName(lv)
        return out, history, all_levels
    return out, history


def louvain_hierarchy(edges: DataFrame, nodes: DataFrame | None = None, **kw):
    """GR7: membership at every level ``(id, community, level)``, level 0 the finest;
    each level's communities are unions of the previous level's."""
    _, hist, levels = louvain(edges, nodes, return_levels=True, **kw)
    return levels, hist
