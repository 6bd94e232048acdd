"""Approximate top-k by angle or dot product (K3): sign hashes of random planes, with multi-probe.

Each of ``TABLES`` tables gives a vector a code of signs; near vectors agree in most signs.  A query looks up its own
code and then the codes that differ in the signs it is least sure of.  How many codes are looked up is measured: the
true neighbours (K1) of a bounded sample of queries tell at which probe each would be found, and the fewest probes that find
the target share are used.  Where even all probes do not, and for queries with fewer than k candidates, the
exact search answers, so no query is missing.

For dot products a coordinate is added that makes all items equally long (queries get 0 there), which turns
them into angles.  Equal vectors are one entry with its k + 1 smallest ids, so copies never fill a bucket.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.retrieval import best
from graphloom.operators.vectors import _usable, dot, topk
from graphloom.session import cut_lineage, release

TABLES, MAX_PROBES, SAMPLE = 10, 64, 64
#: Entries that a code should have on average.
PER_CODE = 24


def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(TABLES * bits, dim))


def probe_order(margins: np.ndarray, probes: int) -> list[int]:
    """Codes to look up, best first: the own code, then sets of flipped signs by rising sum of squared margins."""
    bits = len(margins)
    own = int(sum(1 << i for i in range(bits) if margins[i] >= 0))
    order = np.argsort(np.abs(margins), kind="stable")
    cost = np.abs(margins[order]) ** 2
    out, heap = [own], [(cost[0], (0,))] if bits else []
    while heap and len(out) < probes:
        total, flips = heapq.heappop(heap)
        out.append(own ^ sum(1 << int(order[i]) for i in flips))
        last = flips[-1]
        if last + 1 < bits:  # the next set with the last flip moved on, and with one more flip
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*flips[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*flips, last + 1)))
    return out


def _codes(rows: DataFrame, name: str, planes: np.ndarray, bits: int, probes: int, longest: float | None, is_query: bool) -> DataFrame:
    """``(name, t, code, place)``: the codes of every vector in each table, ``probes`` of them for queries."""
    id_type = rows.schema[name].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.array(list(frame["vec"]), dtype=np.float64)
            if longest is not None:
                rest = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(longest ** 2 - (x * x).sum(axis=1), 0))
                x = np.hstack([x, rest[:, None]])
            margins = (x @ planes.T).reshape(len(x), TABLES, bits)
            if not is_query:
                codes = ((margins >= 0) << np.arange(bits)).sum(axis=2)
                yield pd.DataFrame({name: np.repeat(frame[name].to_numpy(), TABLES), "t": np.tile(np.arange(TABLES, dtype=np.int32), len(x)),
                                    "code": codes.ravel().astype(np.int64), "place": np.zeros(codes.size, np.int32)})
                continue
            found = [(i, t, c, p) for i, row in zip(frame[name], margins, strict=True) for t in range(TABLES)
                     for p, c in enumerate(probe_order(row[t], probes))]
            yield pd.DataFrame(found, columns=[name, "t", "code", "place"]).astype({"t": "int32", "code": "int64", "place": "int32"})

    return rows.select(name, "vec").mapInPandas(run, f"{name} {id_type}, t int, code long, place int")


def approx_topk(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", target: float = 0.95,
                exclude_self: bool = False, seed: int = 42, max_probes: int = MAX_PROBES) -> DataFrame:
    """The (approximately) ``k`` best items for every query: ``query_id, item_id, score, rank`` as in K1's ``topk``.

    ``queries(query_id, vec)``, ``corpus(item_id, vec)``, metric ``cosine`` or ``dot``; ids are unique.  Vectors that are null or
    hold nulls are skipped.  Scores are exact; the share of true neighbours among the rows is ``target`` or more on the sample.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError("metric must be cosine or dot")
    vec = F.col("vec").cast("array<double>").alias("vec")
    q = cut_lineage(queries.filter(_usable("vec")).select("query_id", vec))
    c = cut_lineage(corpus.filter(_usable("vec")).select("item_id", vec))
    norm2 = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    dim, longest2 = c.agg(F.max(F.size("vec")), F.max(norm2)).first()
    if dim is None:
        return topk(q, c, k, metric, exclude_self)
    # one entry per distinct vector, with its smallest ids
    same = F.sha2(F.to_json("vec"), 256)
    ids = cut_lineage(best(c.select(same.alias("entry"), "item_id"), ["entry"], [F.col("item_id")], k + 1).select("entry", "item_id"))
    entries = cut_lineage(c.withColumn("entry", same).groupBy("entry").agg(F.any_value("vec").alias("vec")))
    n = entries.count()
    bits = max(1, min(40, round(math.log2(max(2, n / PER_CODE)))))
    longest = math.sqrt(longest2) if metric == "dot" else None
    planes = _planes(dim + (longest is not None), bits, seed)
    codes = cut_lineage(_codes(entries, "entry", planes, bits, 1, longest, False).drop("place"))
    probes = cut_lineage(_codes(q, "query_id", planes, bits, min(max_probes, 1 << bits), longest, True))

    # at which probe the true neighbours of some queries would be found
    some = cut_lineage(q.orderBy(F.xxhash64("query_id")).limit(SAMPLE))
    true = (topk(some, c, k, metric, exclude_self).select("query_id", "item_id")
            .join(c.select("item_id", same.alias("entry")), "item_id"))
    asked = probes.join(some.select("query_id"), "query_id", "left_semi")
    at = (true.join(codes, "entry").join(asked, ["query_id", "t", "code"], "left").groupBy("query_id", "item_id")
          .agg(F.min("place").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a probe
    total, found, enough = sum(r.n for r in at), 0, None
    for place, hits in sorted((r.place, r.n) for r in at if r.place is not None):
        found += hits
        if found >= target * total:
            enough = place
            break
    if total and enough is None:  # no number of probes is enough
        return topk(q, c, k, metric, exclude_self)
    pairs = (probes.filter(F.col("place") <= (enough or 0)).join(codes, ["t", "code"]).select("query_id", "entry").distinct())
    score = dot("qv", "cv")
    if metric == "cosine":
        length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        lengths = length(F.col("qv")) * length(F.col("cv"))
        score = F.when(lengths > 0, score / lengths).otherwise(F.lit(0.0))
    scored = (pairs.join(q.withColumnRenamed("vec", "qv"), "query_id").join(entries.withColumnRenamed("vec", "cv"), "entry")
              .select("query_id", "entry", score.alias("score")).join(ids, "entry"))
    if exclude_self:
        scored = scored.filter(~F.col("query_id").eqNullSafe(F.col("item_id")))
    got = cut_lineage(best(scored.select("query_id", "item_id", "score"), ["query_id"], [F.desc("score"), F.col("item_id")], k))
    full = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, c.count() - bool(exclude_self)))
    rest = cut_lineage(q.join(full, "query_id", "left_anti"))
    got = got.join(rest, "query_id", "left_anti").unionByName(topk(rest, c, k, metric, exclude_self))
    for t in (codes, probes, some):  # the result reads written rows only
        release(t)
    return got


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, n_exact, n_found, recall)`` of each query of the exact result."""
    hit = exact.select("query_id", "item_id").join(found.select("query_id", "item_id").withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left")
    return hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"),
                                       (F.count("hit") / F.count(F.lit(1))).alias("recall"))
