"""Exact vector top-k for a whole table of queries (K1, K2, F11) and the KNN graph.

The reference does an exact flat scan per question.  Here a smaller side of at most
``BLOCK_BYTES`` is sent to every task and the other side is scanned in
parallel, batch by batch.  Where both sides are larger, both are cut into blocks of
bounded bytes and each pair of blocks meets in a task; neither passes through the driver.
A task keeps at most ``k`` candidates per query, and a window keeps the best
``k``.  The work is the inherent ``|Q| x |C| x dim`` (``approx_topk`` is for node x node).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

METRICS = ("dot", "cosine", "l2")
BLOCK_BYTES = 32 << 20  # of vectors sent to every task at a time
TASK_PAIRS = 1 << 29  # of vectors that a task compares, about: some seconds
SAMPLE = 4096  # items that give each query a distance to begin with; the search itself is exact


def _stack(vectors, metric: str) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    return x


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Larger is better: dot product, cosine, or the negative distance (exact differences for ties near 0)."""
    if metric != "l2":
        return q @ c.T
    out = np.empty((len(q), len(c)))
    for i, x in enumerate(q):
        d = c - x
        out[i] = -np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _best(scores: np.ndarray, items: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the places of the k best, ties at the border resolved to the smaller item."""
    out = []
    for row in scores:
        place = np.flatnonzero(row > -np.inf)
        if len(place) > k:
            edge = np.partition(row[place], len(place) - k)[len(place) - k]
            place = place[row[place] >= edge]
        out.append(place[np.lexsort((items[place], -row[place]))[:k]])
    return out


def _matched(q: np.ndarray, c: np.ndarray, items: np.ndarray, k: int, self_pairs: np.ndarray | None = None,
             most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q`` and of ``c``, distance and place from 0 of the k nearest rows of ``c`` for each row of finite ``q``, ordered by it.

    One matrix product gives each squared distance up to rounding; the exact differences are taken of those pairs only that
    the rounding leaves in question.  ``most``: squared distances; rows of ``c`` that are farther may be left out.
    """
    size = max(np.abs(q).max(initial=0.0), np.abs(c).max(initial=0.0))
    kind = np.float32 if size == 0 or 1e-10 < size < 1e15 else np.float64
    eps = float(np.finfo(kind).eps)
    qq, cc = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
    slack = 8.0 * (q.shape[1] + 8) * eps  # of a sum of n products, whatever its order
    # each squared distance without qq: more than `low`, less than `low` and twice the slack of cc and qq
    low = np.hstack([q, np.ones((len(q), 1))]).astype(kind) @ np.hstack([-2.0 * c, (cc * (1.0 - slack))[:, None]]).astype(kind).T
    tiny = 1e-30 if kind == np.float32 else 0.0
    if self_pairs is not None:
        low[self_pairs] = np.inf
    limit = np.full(len(q), np.inf) if most is None else most - qq * (1.0 - slack)
    if most is None and low.shape[1] > k:
        up = low + (2.0 * slack * cc).astype(kind)
        limit = np.partition(up, k - 1, axis=1)[:, k - 1] + 2.0 * slack * qq
    limit = limit + 8.0 * eps * (np.where(np.isfinite(limit), np.abs(limit), 0) + qq) + tiny
    at, place = np.nonzero((low <= limit.astype(kind)[:, None]) & (low < np.inf))
    far = np.empty(len(at))
    for lo in range(0, len(at), 65_536):
        d = c[place[lo:lo + 65_536]] - q[at[lo:lo + 65_536]]
        far[lo:lo + 65_536] = np.sqrt(np.einsum("ij,ij->i", d, d))
    order = np.lexsort((far, at))
    at, place, far = at[order], place[order], far[order]
    starts = np.searchsorted(at, np.arange(len(q) + 1))
    if len(at):
        # the k-th distance of each row; ties are ordered by item, which is slow, so what is farther goes first
        edge = np.full(len(q), np.inf)
        full = np.diff(starts) >= k
        edge[full] = far[starts[:-1][full] + k - 1]
        keep = far <= edge[at]
        at, place, far = at[keep], place[keep], far[keep]
        order = np.lexsort((items[place], far, at))
        at, place, far = at[order], place[order], far[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    keep = nth < k
    return at[keep], place[keep], far[keep], nth[keep]


def _nearest(q: np.ndarray, c: np.ndarray, items: np.ndarray, k: int, self_pairs: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places and scores of the k nearest rows of ``c`` for each row of finite ``q``, as ``_best`` finds them among ``_scores``."""
    at, place, far, _ = _matched(q, c, items, k, self_pairs)
    cuts = np.searchsorted(at, np.arange(1, len(q)))
    return np.split(place, cuts), np.split(-far, cuts)


def _far_at_most(some: np.ndarray, k: int):
    """For tasks: each vector's squared distance to the k-th of some of the other side, a little more for rounding."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cc = np.einsum("ij,ij->i", some, some)
        for frame in frames:
            if len(frame):
                x = _stack(frame["vec"], "l2")
                out = np.empty(len(x))
                for lo in range(0, len(x), 1024):
                    y = x[lo:lo + 1024]
                    qq = np.einsum("ij,ij->i", y, y)
                    up = (cc + qq[:, None]) * (1.0 + 8.0 * (x.shape[1] + 8) * np.finfo(float).eps) - 2.0 * (y @ some.T)
                    out[lo:lo + 1024] = np.partition(up, k - 1, axis=1)[:, k - 1]
                yield frame.assign(most=out)
    return run


def _usable(vec: str):
    v = F.col(vec)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull())


def topk(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "dot",
         exclude_self: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """K1: the ``k`` best corpus items for every query.

    ``queries(query_id, vec array)``, ``corpus(item_id, vec array)``; ids of any
    orderable type.  Rows whose vector is null or holds a null are skipped on either
    side.  Returns ``query_id, item_id, score, rank``; ``score`` is the
    dot product, cosine similarity (larger is better) or Euclidean distance
    (smaller is better), in double precision.  Ties go to the smaller ``item_id``.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    vec = F.col("vec").cast("array<double>").alias("vec")
    q = cut_lineage(queries.filter(_usable("vec")).select("query_id", vec))
    c = cut_lineage(corpus.filter(_usable("vec")).select("item_id", vec))
    size = lambda d: d.agg(F.coalesce(F.sum(8 * F.size("vec")), F.lit(0)), F.count(F.lit(1))).first()
    (q_bytes, n_q), (c_bytes, n_c) = size(q), size(c)
    tasks = math.ceil(n_q * n_c / TASK_PAIRS)  # more vectors make more tasks, not longer ones
    send_queries = q_bytes <= c_bytes
    sent, scanned, name = (q, c, "query_id") if send_queries else (c, q, "item_id")
    q_type, c_type = (d.schema[n].dataType.simpleString() for d, n in ((q, "query_id"), (c, "item_id")))
    schema = f"query_id {q_type}, item_id {c_type}, score double"
    sign = -1.0 if metric == "l2" else 1.0

    finite = lambda x: np.abs(x).max(initial=0.0) < 1e100

    def match(qi, qx, ci, cx) -> pd.DataFrame:
        if metric == "l2" and finite(qx) and finite(cx):
            at, place, score, _ = _matched(qx, cx, ci, k, qi[:, None] == ci[None, :] if exclude_self else None)
            return pd.DataFrame({"query_id": qi[at], "item_id": ci[place], "score": score})
        # also l2 of values that are not finite or whose squares are not
        s = _scores(qx, cx, metric)
        if exclude_self:
            s[qi[:, None] == ci[None, :]] = -np.inf
        found = _best(s, ci, k)
        best = [s[i, f] for i, f in enumerate(found)]
        n = [len(f) for f in found]
        at, score = (np.concatenate(a) if a else np.zeros(0, t) for a, t in ((found, int), (best, float)))
        return pd.DataFrame({"query_id": np.repeat(qi, n), "item_id": ci[at], "score": sign * score})

    def scan(rows: pd.DataFrame):
        ids, x = rows[name].to_numpy(), _stack(rows["vec"], metric)
        known = rows["most"].to_numpy(dtype=float) if "most" in rows else None
        # queries that meet every batch of a task look for what is nearer than what the batches before gave
        narrowing = metric == "l2" and send_queries and not exclude_self and finite(x)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nearest = np.full((len(x), k), np.inf) if narrowing else None
            for frame in batches:
                if not len(frame):
                    continue
                step = max(1, 8_000_000 // max(1, len(ids)))
                for lo in range(0, len(frame), step):
                    part = frame.iloc[lo:lo + step]
                    y = _stack(part["vec"], metric)
                    own = part["item_id" if send_queries else "query_id"].to_numpy()
                    if not narrowing or not finite(y):
                        yield match(*((ids, x, own, y) if send_queries else (own, y, ids, x)))
                        continue
                    most = nearest[:, k - 1] ** 2 * (1.0 + 1e-12)
                    if known is not None:
                        most = np.minimum(most, known)
                    at, place, far, nth = _matched(x, y, own, k, most=most if np.isfinite(most).any() else None)
                    yield pd.DataFrame({"query_id": ids[at], "item_id": own[place], "score": far})
                    new = np.full((len(x), k), np.inf)
                    new[at, nth] = far
                    some = np.unique(at)
                    nearest[some] = np.sort(np.hstack([nearest[some], new[some]]), axis=1)[:, :k]
        return run

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        ci, cx = right["item_id"].to_numpy(), _stack(right["vec"], metric)
        step = max(1, 8_000_000 // len(ci))
        parts = [match(left["query_id"].to_numpy()[lo:lo + step], _stack(left["vec"].iloc[lo:lo + step], metric), ci, cx)
                 for lo in range(0, len(left), step)]
        return pd.concat(parts, ignore_index=True)

    if min(q_bytes, c_bytes) <= block_bytes:
        if metric == "l2" and send_queries and not exclude_self and tasks > 1 and n_c > max(SAMPLE, k):
            # what is farther than the k-th of some items is not among the k nearest of all
            some = _stack(c.orderBy(F.xxhash64("item_id")).limit(max(SAMPLE, k)).toPandas()["vec"], metric)
            if finite(some):
                sent = q.repartition(min(tasks, 64)).mapInPandas(_far_at_most(some, k), f"query_id {q_type}, vec array<double>, most double")
        rows = sent.toPandas()  # at most block_bytes of vectors
        if not len(rows):
            return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
        if tasks > scanned.rdd.getNumPartitions():
            scanned = scanned.repartition(tasks)
        found = scanned.mapInPandas(scan(rows), schema)
    else:
        # every row knows its block by a hash of its id and goes to each block of the other side
        nq, nc = (math.ceil(b / block_bytes) for b in (q_bytes, c_bytes))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = q.select("*", own("query_id", nq).alias("bq"), every(nc).alias("bc"))
        right = c.select("*", every(nq).alias("bq"), own("item_id", nc).alias("bc"))
        left, right = (d.repartition(nq * nc, "bq", "bc") for d in (left, right))
        found = left.groupBy("bq", "bc").cogroup(right.groupBy("bq", "bc")).applyInPandas(pair, schema)
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("item_id").asc())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "vec") -> DataFrame:
    """Mean vector per group (JVM-side ``Summarizer``), e.g. K2's community vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    return (vectors.groupBy(group_col)
            .agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_m"))
            .select(group_col, vector_to_array("_m", "float64").alias(vec_col)))


def knn_graph(vectors: DataFrame, k: int = 5, metric: str = "dot") -> DataFrame:
    """Undirected k-nearest-neighbour graph: ``(src, dst, score)`` with src < dst, one row per pair."""
    nn = topk(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")),
              vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec")),
              k, metric, exclude_self=True)
    return (nn.groupBy(F.least("query_id", "item_id").alias("src"),
                       F.greatest("query_id", "item_id").alias("dst"))
            .agg(F.max("score").alias("score")))


def dot(a, b) -> F.Column:
    """F11 as a column expression (double precision), no Python."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def approx_topk(queries: DataFrame, corpus: DataFrame, k: int, bucket_length: float | None = None,
                num_hash_tables: int = 8) -> DataFrame:
    """K3: approximate nearest neighbours by Euclidean distance (L2).

    Candidates share a bucket of ``BucketedRandomProjectionLSH`` in at least one of
    the hash tables; each is ranked by its exact distance and the best ``k`` per query are
    kept, without a distance limit.  The default bucket length shrinks with the corpus
    (``n ** (-1 / dim)`` of the vectors' spread), as Spark's documentation recommends, so buckets
    do not fill up as the table grows.  Recall is measured against ``topk(..., "l2")``.
    Queries without a candidate get no row; ``missing_queries`` lists them.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    vec = array_to_vector(F.col("vec").cast("array<double>")).alias("features")
    q = queries.filter(_usable("vec")).select(F.col("query_id").alias("id"), vec)
    c = corpus.filter(_usable("vec")).select(F.col("item_id").alias("id"), vec)
    if bucket_length is None:
        n, dim, spread = corpus.filter(_usable("vec")).agg(
            F.count(F.lit(1)), F.max(F.size("vec")),
            F.avg(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))).first()
        bucket_length = 2.0 * math.sqrt(spread or 1.0) * max(1, n) ** (-1.0 / max(1, dim or 1)) / 4
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes",
                                        bucketLength=bucket_length, numHashTables=num_hash_tables,
                                        seed=42).fit(c)
    pairs = model.approxSimilarityJoin(q, c, float("inf"), distCol="score").select(
        F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("item_id"), "score")
    w = Window.partitionBy("query_id").orderBy(F.col("score").asc(), F.col("item_id").asc())
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def missing_queries(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Queries that ``approx_topk`` has no row for."""
    return queries.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")


def embed_text(df: DataFrame, text_col: str, dim: int = 64, out_col: str = "vec") -> DataFrame:
    """EM1 default: feature hashing of lower-cased word tokens, L2-normalised
    (``RegexTokenizer`` -> ``HashingTF`` -> ``Normalizer``, all JVM-side).
    A real embedding model is plugged in by replacing this column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    tmp = "_tok", "_tf", "_norm"
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol=tmp[0], pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol=tmp[0], outputCol=tmp[1], numFeatures=dim),
        Normalizer(inputCol=tmp[1], outputCol=tmp[2], p=2.0)])
    out = pipe.fit(df).transform(df)
    return out.withColumn(out_col, vector_to_array(tmp[2], "float32")).drop(*tmp)
