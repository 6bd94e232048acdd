"""Embedding near-dedup over an inverted multi-index.

Unit vectors are cut into halves, each half has a codebook of its own (k-means
on a bounded sample), and the pair of nearest codes is a vector's cell in the product
grid.  A vector looks for neighbours in the cells nearest to it, in the order
of the multi-sequence traversal (rising sum of the two halves' distances to the codes).
How many cells are visited is measured, not guessed: for a bounded sample of
vectors all true links in the whole table are counted by the rank of the
neighbour's cell, and the least number of cells that reaches the target recall is taken.
Where few of them have links, as many neighbours at exactly the threshold are made from the
vectors by noise, and the number of cells must reach the target for these as well.
Every candidate is verified by cosine in double precision.

Copies (equal label and vector) are one class with a multiplicity.  Candidates never
become rows: a cell's members and its visitors meet in blocks of bounded size, in
which links are counted and reduced to the edges of a spanning forest.  A cell with very
many members or visitors is dealt over many blocks.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import connected
from graphloom.session import cut_lineage

log = logging.getLogger(__name__)

#: Bounds: vectors the codebooks are fitted on, vectors whose links measure the recall, of which
#: so many must have links or made neighbours are measured too, codes of a half, cells that a vector may visit, rows of a side in a block.
FIT_ROWS, PROBE_ROWS, LINKED, MAX_CODES, MAX_CELLS, BLOCK = 8192, 256, 64, 1024, 2048, 2048
PER_CELL, MIN_CELLS = 16, 8
THRESHOLD, RECALL = 0.93, 0.99


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squares(x, c).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]


class Grid:
    """Codebooks of the two halves of vectors of one length."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, :self.half], codes), kmeans(sample[:, self.half:], codes, seed=6)]
        self.shape = tuple(len(b) for b in self.books)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squares(unit[:, :self.half], self.books[0]), squares(unit[:, self.half:], self.books[1])

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(axis=1) * np.int64(self.shape[1]) + b.argmin(axis=1)

    def nearest(self, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``n`` nearest cells of every vector and their distances, nearest first (multi-sequence order).

        The cell of the i-th and j-th nearest codes (from 0) comes after (i + 1) * (j + 1) - 1
        others, so only cells below that staircase need to be compared.
        """
        a, b = self.distances(unit)
        n = min(n, self.shape[0] * self.shape[1])
        i, j = np.divmod(np.arange(self.shape[0] * self.shape[1]), self.shape[1]) if n * 4 > self.shape[0] * self.shape[1] else _staircase(n)
        inside = (i < self.shape[0]) & (j < self.shape[1])
        i, j = i[inside], j[inside]
        oa, ob = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        sums = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
        best = sums.argsort(axis=1, kind="stable")[:, :n]
        return (np.take_along_axis(oa[:, i] * np.int64(self.shape[1]) + ob[:, j], best, 1), np.take_along_axis(sums, best, 1))


def _staircase(n: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(i, j) for i in range(n) for j in range(n // (i + 1))]
    return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def vectors(table: DataFrame) -> DataFrame:
    """``vec_id, label, v (doubles), ok, h1, h2``; ``ok``: the vector may link."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound & (size > 0) & (size != float("inf")), F.lit(False))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                        v.alias("v"), ok.alias("ok"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("v"), v).alias("h2"))


def _stream(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of equal key from batches sorted by it; holds one group at a time."""
    rest = None
    for batch in batches:
        frame = batch.to_pandas()
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        change = (frame[key] != frame[key].shift()).any(axis=1).to_numpy()
        cuts = np.flatnonzero(change)
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield frame.iloc[a:b]
        rest = frame.iloc[cuts[-1]:]
    if rest is not None:
        yield rest


def fit(classes: DataFrame, n: int, fit_rows: int = FIT_ROWS) -> dict[int, Grid]:
    """A grid for every length of vectors, from about ``fit_rows`` classes drawn by hash."""
    share = min(1.0, fit_rows / max(1, n))
    codes = max(2, min(MAX_CODES, round(math.sqrt(n / PER_CELL))))
    draw = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    got = classes.filter(draw).select("h1", "h2", "v").toPandas().sort_values(["h1", "h2"], kind="stable")
    grids = {}
    for dim, part in got.groupby(got["v"].map(len)):
        grids[int(dim)] = Grid(_unit(part["v"].tolist()), min(codes, len(part)))
    return grids


def made_ranks(grid: Grid, unit: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector and a neighbour at cosine ``threshold``, made by noise in a random direction, the lesser of
    the ranks of the one's cell for the other (a link is found from either side); ``MAX_CELLS`` if beyond."""
    noise = np.random.default_rng(7).normal(size=unit.shape)
    noise -= (noise * unit).sum(axis=1)[:, None] * unit
    size = np.sqrt((noise * noise).sum(axis=1))[:, None]
    # in one dimension nothing but the vector itself is that near
    other = np.where(size > 1e-9, threshold * unit + math.sqrt(max(0.0, 1 - threshold * threshold)) * noise / np.maximum(size, 1e-9), unit)
    ranks = np.full(len(unit), MAX_CELLS)
    for a, b in ((unit, other), (other, unit)):
        for lo in range(0, len(a), 64):
            found = grid.nearest(a[lo:lo + 64], MAX_CELLS)[0] == grid.cells(b[lo:lo + 64])[:, None]
            ranks[lo:lo + 64] = np.minimum(ranks[lo:lo + 64], np.where(found.any(axis=1), found.argmax(axis=1), MAX_CELLS))
    return ranks


def _least(reached: np.ndarray, target: float) -> tuple[int, float]:
    """The least number of cells whose recall is ``target`` or more, else all, and the recall; ``reached``: by rank."""
    enough = np.flatnonzero(reached >= target - 1e-9)
    cells = max(MIN_CELLS, int(enough[0]) + 1) if len(enough) else len(reached)
    return cells, float(reached[min(cells, len(reached)) - 1])


def visits_needed(classes: DataFrame, grids: dict[int, Grid], n: int, threshold: float = THRESHOLD,
                  target: float = RECALL, probe_rows: int = PROBE_ROWS) -> tuple[int, float]:
    """Cells to visit and the recall that this number reaches, as a mean over probes.

    About ``probe_rows`` probes, drawn by hash, meet every class of the table by brute force; tasks
    return how many links of which probe have their cell at which rank.  Each probe counts
    alike, so that large groups do not hide the small ones.  If fewer than ``LINKED`` probes have
    links, made neighbours of all probes are measured too; the larger number of cells and the
    lesser recall hold.  Without any probe the recall is not a number.
    """
    share = min(1.0, probe_rows / max(1, n))
    draw = F.pmod(F.xxhash64(F.lit("probe"), "h1", "h2"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    probes = classes.filter(draw).select("node", "label", "v").toPandas().sort_values("node", kind="stable")
    by: dict = {}
    for (label, dim), part in probes.groupby([probes["label"], probes["v"].map(len)]):
        if dim in grids:
            unit = _unit(part["v"].tolist())
            by[label, int(dim)] = (part["node"].to_numpy(), unit, grids[dim].nearest(unit, MAX_CELLS)[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for (label, dim), part in frame.groupby([frame["label"], frame["v"].map(len)]):
                if (label, int(dim)) not in by:
                    continue
                nodes, unit, order = by[label, int(dim)]
                own = _unit(part["v"].tolist())
                cells = grids[dim].cells(own)
                hit = (unit @ own.T >= threshold) & (nodes[:, None] != part["node"].to_numpy()[None, :])
                for q in np.flatnonzero(hit.any(axis=1)):
                    rank = np.full(int(hit[q].sum()), MAX_CELLS)
                    found = order[q][None, :] == cells[hit[q]][:, None]
                    rank[found.any(axis=1)] = found.argmax(axis=1)[found.any(axis=1)]
                    rows += [(int(nodes[q]), int(r), int(c)) for r, c in zip(*np.unique(rank, return_counts=True), strict=True)]
            yield pd.DataFrame(rows, columns=["probe", "rank", "n"]).astype("int64")

    # at most PROBE_ROWS * (MAX_CELLS + 1) rows, as a rule a few for each probe
    got = (classes.select("node", "label", "v").mapInPandas(run, "probe long, rank long, n long")
           .groupBy("probe", "rank").agg(F.sum("n").alias("n")).toPandas())
    measured = []
    if len(got):
        got["part"] = got["n"] / got.groupby("probe")["n"].transform("sum") / got["probe"].nunique()
        measured.append(np.cumsum(np.bincount(got["rank"], got["part"], MAX_CELLS + 1)[:MAX_CELLS]))
    if got["probe"].nunique() < LINKED and by:
        ranks = np.concatenate([made_ranks(grids[dim], unit, threshold) for (_, dim), (_, unit, _) in by.items()])
        measured.append(np.cumsum(np.bincount(ranks, minlength=MAX_CELLS + 1)[:MAX_CELLS]) / len(ranks))
    if not measured:
        return MIN_CELLS, math.nan
    cells = max(_least(x, target)[0] for x in measured)
    return cells, float(min(x[min(cells, MAX_CELLS) - 1] for x in measured))


def near_dedup(table: DataFrame, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and the cosine is at least
    ``threshold``; if ``MAX_CELLS`` cells do not reach the recall ``target``, all vectors of a
    label are compared in blocks.  A vector that is null, zero or holds a null or non-finite
    component, and a row without vec_id or label, links with nothing; its component is
    its own id.  Vectors of different lengths do not link.  Equal vectors link with
    each other; rows that repeat a vec_id are vectors of their own with one id.  No rows give no rows.
    """
    rows = vectors(table)
    key = ["label", "h1", "h2"]
    classes = cut_lineage(rows.filter("ok").groupBy(*key).agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id()))
    n = classes.count()
    grids = fit(classes, n)
    cells, recall = visits_needed(classes, grids, n, threshold, target)
    if recall < target - 1e-9:
        log.warning("recall %.4f with %d cells is below %.2f: all vectors of a label are compared", recall, cells, target)
        grids = {}  # one cell: exact, in blocks
    else:
        log.info("recall %.4f with %d cells", recall, cells)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame = frame.reset_index(drop=True)
            out = []
            for dim, part in frame.groupby(frame["v"].map(len)):
                if dim not in grids:  # a length the sample did not hold, or no grid is good enough: one cell
                    out.append(part[["node", "label", "copies", "v"]].assign(cell=0, visits=[[0]] * len(part)))
                    continue
                for lo in range(0, len(part), 256):
                    sub = part.iloc[lo:lo + 256]
                    unit = _unit(sub["v"].tolist())
                    order = grids[dim].nearest(unit, cells)[0]
                    out.append(sub[["node", "label", "copies", "v"]].assign(cell=grids[dim].cells(unit), visits=list(order)))
            if out:
                yield pd.concat(out, ignore_index=True)

    placed = cut_lineage(classes.select("node", "label", "copies", "v").mapInPandas(
        place, "node long, label string, copies long, v array<double>, cell long, visits array<long>")
        .withColumn("dim", F.size("v")))
    cell = ["label", "dim", "cell"]
    full = cut_lineage(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("members")))
    visitors = cut_lineage(placed.select("node", "label", "dim", F.col("cell").alias("home"), F.explode("visits").alias("cell"))
                           .join(full, cell).filter("cell <> home OR members > 1")
                           .select("node", *cell))
    # blocks of a cell: 1 x 1 but for the few cells with more than BLOCK rows on a side
    sides = cut_lineage(visitors.groupBy(*cell).agg(F.count(F.lit(1)).alias("guests")).join(full, cell)
                        .select(*cell, F.ceil(F.col("guests") / BLOCK).cast("int").alias("gb"), F.ceil(F.col("members") / BLOCK).cast("int").alias("mb")))
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    turn = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    guests = (visitors.join(placed.select("node", "copies", "v", F.col("cell").alias("home"), F.lit(None).cast("array<long>").alias("visits")), "node")
              .join(sides, cell).select(*cell, "node", "copies", "v", "home", "visits", F.lit(True).alias("guest"),
                                        turn("gb").alias("g"), F.explode(spread("mb")).alias("m")))
    members = (placed.select(*cell, "node", "copies", "v", F.col("cell").alias("home"), "visits").join(sides, cell)
               .select(*cell, "node", "copies", "v", "home", "visits", F.lit(False).alias("guest"),
                       F.explode(spread("gb")).alias("g"), turn("mb").alias("m")))
    group = [*cell, "g", "m"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, links, tops = [], [], []

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (nodes, links, tops)], ["node", "links", "top"])
            for x in (nodes, links, tops):
                x.clear()
            return batch

        for frame in _stream(batches, group):
            flag = frame["guest"].to_numpy(dtype=bool)
            if flag.all() or not flag.any():
                continue
            q, m = frame[flag], frame[~flag]
            qn, mn = q["node"].to_numpy(), m["node"].to_numpy()
            hit = (_unit(q["v"].tolist()) @ _unit(m["v"].tolist()).T >= threshold) & (qn[:, None] != mn[None, :])
            if not hit.any():
                continue
            # a visitor counts what it finds; a member counts a visitor only where it does not visit it itself
            homes, home = np.unique(q["home"].to_numpy(), return_inverse=True)
            sees = np.stack([np.isin(homes, x) for x in m["visits"]])
            unseen = hit & ~sees[:, home].T
            nodes += [qn, mn]
            links += [hit @ m["copies"].to_numpy(), unseen.T @ q["copies"].to_numpy()]
            # spanning edges: each node with the least node of its part of this block
            every, where = np.unique(np.concatenate([qn, mn]), return_inverse=True)
            qi, mi = where[:len(qn)], where[len(qn):]
            label = np.arange(len(every))
            while True:
                low = np.where(hit, label[mi][None, :], len(every)).min(axis=1)
                new = label.copy()
                np.minimum.at(new, qi, low)
                np.minimum.at(new, mi, np.where(hit, new[qi][:, None], len(every)).min(axis=0))
                if (new == label).all():
                    break
                label = new
            tops += [every[label[qi]], every[label[mi]]]
            if sum(map(len, nodes)) > 50_000:
                yield out()
        if nodes:
            yield out()

    met = cut_lineage(guests.unionByName(members).repartition(*group).sortWithinPartitions(*group)
                      .mapInArrow(meet, "node long, links long, top long"))
    # a node's own links; blocks of one cell hold different members, and a cell is visited once
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected(classes, met.select(F.col("node").alias("a"), F.col("top").alias("b")))
    best = (classes.select("node", "first_id").join(parts, "node").groupBy("component").agg(F.min("first_id").alias("component_id")))
    answer = cut_lineage(classes.select("node", *key, "copies").join(parts, "node").join(best, "component").join(counts, "node", "left")
                         .select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    plain = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = cut_lineage(rows.filter("ok").select("vec_id", *key)).join(answer, key).select("vec_id", "n_links", "component_id")
    return found.unionByName(plain).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
