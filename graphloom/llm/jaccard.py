r"""N-gram Jaccard join by multiple global orders.

A document is its set of distinct word shingles, as 64-bit hashes.  If two sets reach the
threshold, then under any global order of the tokens their prefixes (the first
``n - ceil(t * n) + 1`` tokens) share one.  Candidates are found under a first order and
must share prefix tokens under two further orders, before whole sets are compared.

* Order 1: rare tokens first (by a counting sketch of the whole corpus, a fixed 2 ** 22
  counters), then by hash.  A passage on a third of all pages is so frequent that it is in
  hardly any prefix.
* Order 2: rare first, another hash.  Order 3: a third hash alone.

Equal sets are one class, found by a 128-bit fingerprint, so copies never meet.  Large groups of
near copies never form all their pairs either.  First every class is compared with one centre
for each prefix token it shares (the class that has the token earliest); the links found make components.  Only
classes of different components that share a token are then joined by it,
with the size and position filters, so no link between components is lost.  A pair that shares the
preceding tokens too is emitted there already.  A parity bitmap of 256 bits bounds the
symmetric difference of a pair from below and drops more pairs without loss.

All joins are equi-joins of written tables, which AQE splits when a token, class or
document is frequent; counts are combined before they are shuffled; nothing is grouped into a list.
Texts are never shuffled: tasks find the rows concerned by a bitmap of ids (16 MB at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bitmap, connected, lean
from graphloom.session import cut_lineage, release

COUNTERS, CHUNK, PARITY = 1 << 22, 1 << 12, 256
#: Bytes of text that are hashed at a time, and rows that are looked at together.
BATCH_BYTES, SLICE = 1 << 18, 128

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FACTOR = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * _U(2) + _U(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUE[65:91] = _VALUE[97:123]  # A-Z counts as a-z


def mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, a different one for every ``k``."""
    x = (x ^ _FACTOR[k]) * _FACTOR[(k + 5) % 16]
    x ^= x >> _U(31)
    x *= _FACTOR[(k + 9) % 16]
    return x ^ (x >> _U(29))


def shingles(raw: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """Shingle hashes of each text in order of place, repeats included.

    ``raw`` holds the texts' bytes one after another, text i from ``bounds[i]`` to ``bounds[i + 1]``.
    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered.  A text with fewer words is one shingle of all of them.
    """
    blank = _BLANK[raw]
    before = np.empty(len(raw), dtype=bool)
    before[1:] = blank[:-1]
    before[bounds[:-1][bounds[:-1] < len(raw)]] = True  # a text's first word begins with it
    starts = np.flatnonzero(~blank & before)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(bounds) - 1)
    size = np.diff(np.concatenate([starts, [len(raw)]]))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, size)
    power = np.multiply.accumulate(np.full(int(size.max()), _FACTOR[15]))
    part = _VALUE[raw[starts[0]:]] * power[place]
    part[blank[starts[0]:]] = 0
    word = mix(np.add.reduceat(part, starts - starts[0]))
    first = np.searchsorted(starts, bounds)
    every = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
    for j in range(words):
        every += word[j:len(word) - words + 1 + j] * _FACTOR[j]
    every = mix(every, 1)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        n = int(b - a)
        if n >= words:
            out.append(every[a:b - words + 1])
        elif n:
            out.append(mix((word[a:b] * _FACTOR[:n]).sum(keepdims=True, dtype=np.uint64) + _FACTOR[n + 8], 2))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges (lo, hi) of texts of some BATCH_BYTES together, with their bytes and bounds, straight from Arrow."""
    for begin in range(0, len(column), SLICE):  # a slice is copied, never the whole batch
        part = pc.fill_null(column.slice(begin, SLICE), "").cast(pa.large_string())
        _, places, data = part.buffers()
        at = np.frombuffer(places, dtype=np.int64)[part.offset:part.offset + len(part) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BATCH_BYTES, side="right")) - 1)
            yield begin + lo, begin + hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
            lo = hi


def survey(docs: DataFrame, words: int) -> DataFrame:
    """Set size and fingerprint of every row, and each task's shingle counters in chunks.

    Rows with a null ``chunk`` are documents; the others hold CHUNK counters each, of one
    byte that stops at 255.  The counts only order the tokens, and any order is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "f1", "f2", "chunk", "counts"]
        total = np.zeros(COUNTERS, dtype=np.int32)
        for batch in batches:
            for lo, hi, raw, bounds in _texts(batch.column(1)):
                n, f1, f2 = [], [], []
                every = shingles(raw, bounds, words)
                for s in every:
                    t = np.unique(s)
                    n.append(len(t))
                    f1.append(mix(t, 3).sum(dtype=np.uint64))
                    f2.append(np.bitwise_xor.reduce(mix(t, 4)) if len(t) else _U(0))
                at, times = np.unique(np.concatenate(every) & _U(COUNTERS - 1), return_counts=True)
                total[at.astype(np.int64)] += times.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int32()), _signed(f1), _signed(f2),
                     pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names)
        parts = np.minimum(total, 255).astype(np.uint8).reshape(-1, CHUNK)
        full = np.flatnonzero(parts.any(axis=1))
        k = len(full)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
             pa.array(full, pa.int32()), pa.array([parts[i].tobytes() for i in full], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n int, f1 long, f2 long, chunk int, counts binary")


def rarity(surveyed: DataFrame) -> np.ndarray:
    """Class (bits of the count) of each of the COUNTERS counters, summed over all tasks.

    Counters are summed in chunks, streaming, and come to the driver as one byte each (4 MB).
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, dtype=np.uint8).astype(np.int64)
        bits = [np.ceil(np.log2(t + 1)).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(bits, pa.binary())], ["chunk", "bits"])

    rows = (surveyed.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
            .mapInArrow(lean(add), "chunk int, bits binary").collect())  # COUNTERS bytes in all
    out = np.zeros((COUNTERS // CHUNK, CHUNK), dtype=np.uint8)
    for chunk, bits in rows:
        out[chunk] = np.frombuffer(bits, dtype=np.uint8)
    return out.ravel()


def _signed(values: list) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _ragged(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def _head(keys: np.ndarray, percent: int) -> np.ndarray:
    """Places of the prefix under the order of the keys, in no order."""
    n = len(keys)
    head = n - -(-percent * n // 100) + 1
    return np.argpartition(keys, head - 1)[:head] if head < n else np.arange(n)


def _rare(t: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[(t & _U(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << _U(58)


class IdSet:
    """A bitmap of a column of longs: tells surely which values are not in it, and of few others that they may be.

    Some 16 bits for each value, 16 MB at most; beyond that more values pass, and what follows stays exact.
    """

    def __init__(self, values: DataFrame):
        bits = 1 << min(27, max(16, int(16 * values.count()).bit_length()))
        self.modulus = bits - 1
        self.flags = bitmap(values.select(F.pmod(F.col(values.columns[0]), F.lit(self.modulus)).alias("p")), bits)

    def holds(self, values: np.ndarray) -> np.ndarray:
        p = np.mod(values, self.modulus)
        flags = np.frombuffer(self.flags, dtype=np.uint8)
        return (flags[p >> 3] >> (p & 7).astype(np.uint8) & 1) > 0

    def may_hold(self, ids: pa.Array) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return known & self.holds(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))


def profiles(docs: DataFrame, classes: np.ndarray, words: int, percent: int, copies: IdSet | None = None) -> DataFrame:
    """Set size, fingerprint and prefix under order 1 of rows with an id and a set; ``copy``: may be in ``copies``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = copies.may_hold(batch.column(0)) if copies else np.zeros(batch.num_rows, dtype=bool)
            for lo, hi, raw, bounds in _texts(batch.column(1)):
                n, f1, f2, p1 = [], [], [], []
                for s in shingles(raw, bounds, words):
                    t = np.unique(s)
                    n.append(len(t))
                    f1.append(mix(t, 3).sum(dtype=np.uint64))
                    f2.append(np.bitwise_xor.reduce(mix(t, 4)) if len(t) else _U(0))
                    keys = _rare(t, classes) | mix(t, 5) >> _U(6)
                    first = _head(keys, percent) if len(t) else np.zeros(0, np.int64)
                    p1.append(t[first[np.argsort(keys[first], kind="stable")]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int32()), _signed(f1), _signed(f2),
                     _ragged(p1, pa.int64()), pa.array(copy[lo:hi])], ["doc", "n", "f1", "f2", "p1", "copy"])

    return (docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
            .mapInArrow(lean(run), "doc long, n int, f1 long, f2 long, p1 array<long>, copy boolean").filter("n > 0"))


_DETAIL = "doc long, n int, tokens array<long>, p2 array<int>, p3 array<int>, b0 long, b1 long, b2 long, b3 long"


def details(docs: DataFrame, classes: np.ndarray, words: int, percent: int, wanted: IdSet) -> DataFrame:
    """Whole sets, prefixes under orders 2 and 3 and parity bitmaps of the wanted rows (and a few others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.may_hold(batch.column(0))))
            for lo, hi, raw, bounds in _texts(batch.column(1)):
                sets, p2, p3, bits = [], [], [], []
                for s in shingles(raw, bounds, words):
                    t = np.unique(s)
                    sets.append(t.view(np.int64))
                    for keys, into in ((_rare(t, classes) | mix(t, 6) >> _U(6), p2), (mix(t, 7), p3)):
                        into.append(t[_head(keys, percent)].astype(np.uint32).view(np.int32) if len(t) else np.zeros(0, np.int32))
                    odd = np.bincount((mix(t, 8) >> _U(56)).astype(np.int64), minlength=PARITY) & 1
                    bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                b = np.stack(bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in sets], pa.int32()), _ragged(sets, pa.int64()),
                     _ragged(p2, pa.int32()), _ragged(p3, pa.int32()), *[pa.array(b[:, i]) for i in range(4)]],
                    ["doc", "n", "tokens", "p2", "p3", "b0", "b1", "b2", "b3"])

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(lean(run), _DETAIL)


def need(na: str, nb: str, percent: int):
    """Tokens that sets of these sizes must share to link."""
    return F.expr(f"({percent}L * ({na} + {nb}) + {99 + percent}) div {100 + percent}")


def postings(reps: DataFrame) -> DataFrame:
    """``(token, doc, n, pos, prev)`` of the prefix tokens that two classes or more have.

    Most prefix tokens are one class's own.  Only the bare tokens are shuffled to be counted;
    a bitmap of those found twice then tells tasks which postings to emit (and lets a few others through, which meet
    nothing).
    """
    twice = cut_lineage(reps.select(F.explode("p1").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
                        .filter("docs > 1").select("token"))
    known = IdSet(twice)
    release(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(flat)) - first[row]
            keep = np.flatnonzero(known.holds(flat))
            prev = pa.array(flat[keep - 1], mask=pos[keep] == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[keep]), batch.column(0).take(pa.array(row[keep])), batch.column(1).take(pa.array(row[keep])),
                 pa.array(pos[keep].astype(np.int32)), prev], ["token", "doc", "n", "pos", "prev"])

    return cut_lineage(reps.select("doc", "n", "p1").mapInArrow(lean(run), "token long, doc long, n int, pos int, prev long"))


def shared(post: DataFrame) -> DataFrame:
    """Postings with their token's centre: the class that has the token earliest."""
    centres = cut_lineage(post.groupBy("token").agg(F.min(F.struct("pos", "doc", "n")).alias("c"), F.count(F.lit(1)).alias("docs"))
                          .filter("docs > 1").select("token", F.col("c.doc").alias("cdoc"), F.col("c.n").alias("cn"), F.col("c.pos").alias("cpos")))
    common = cut_lineage(post.join(centres, "token"))
    release(centres)
    return common


def star_pairs(common: DataFrame, percent: int) -> DataFrame:
    """``(a, na, b, nb, times)``: each class with the centres of its tokens, as far as sizes and positions allow.

    ``times`` counts the tokens that led to the pair.
    """
    least = need("n", "cn", percent)
    return (common.filter("doc <> cdoc").filter((F.col("n") - F.col("pos") >= least) & (F.col("cn") - F.col("cpos") >= least))
            .groupBy(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("cdoc").alias("b"), F.col("cn").alias("nb"))
            .agg(F.count(F.lit(1)).alias("times")))


def cross_pairs(common: DataFrame, percent: int) -> DataFrame:
    """``(a, na, b, nb)``: all classes of different ``part`` that share a token, sizes and positions allowing."""
    side = lambda s: common.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("doc", "n", "pos", "prev", "part")])
    least = need("a_n", "b_n", percent)
    return (side("a").join(side("b"), "token")
            .filter((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_doc") < F.col("b_doc"))))
            .filter("a_part <> b_part").filter((F.col("a_n") - F.col("a_pos") >= least) & (F.col("b_n") - F.col("b_pos") >= least))
            .filter(~F.coalesce(F.col("a_prev") == F.col("b_prev"), F.lit(False)))
            .select(F.col("a_doc").alias("a"), F.col("a_n").alias("na"), F.col("b_doc").alias("b"), F.col("b_n").alias("nb")).distinct())


def facts_of(docs: DataFrame, pairs: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """Details of the documents of the pairs (and of a few others)."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    facts = cut_lineage(details(docs, classes, words, percent, IdSet(ids)))
    release(ids)
    return facts


def _picked(facts: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """doc, n and some columns of the documents of the pairs (and of a few others), so only these are sent to them."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    chosen = IdSet(ids)
    release(ids)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(chosen.may_hold(batch.column(0))))

    part = facts.select("doc", "n", *columns)
    return part.mapInArrow(lean(pick), part.schema)


def verified(facts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of the pairs that pass the other orders' filters and link; ``facts`` has their documents."""
    light = ["p2", "p3", "b0", "b1", "b2", "b3"]
    pairs = cut_lineage(pairs.select("a", "na", "b", "nb", need("na", "nb", percent).alias("need")))
    side = lambda rows, s: rows.select(*[F.col(c).alias(s if c == "doc" else f"{s}_{c}" if c != "n" else f"n{s}") for c in rows.columns])
    some = _picked(facts, pairs, light)
    differ = sum((F.bit_count(F.col(f"a_b{i}").bitwiseXOR(F.col(f"b_b{i}"))) for i in range(4)), F.lit(0))
    left = cut_lineage(pairs.join(side(some, "a"), ["a", "na"]).join(side(some, "b"), ["b", "nb"])
                       .filter(differ <= F.col("na") + F.col("nb") - 2 * F.col("need"))
                       .filter(F.arrays_overlap("a_p2", "b_p2") & F.arrays_overlap("a_p3", "b_p3")).select("a", "na", "b", "nb", "need"))
    # whole sets are sent only for the documents of pairs that are left
    sets = _picked(facts, left, ["tokens"])
    links = cut_lineage(left.join(side(sets, "a"), ["a", "na"]).join(side(sets, "b"), ["b", "nb"])
                        .filter(F.size(F.array_intersect("a_tokens", "b_tokens")) >= F.col("need")).select("a", "b"))
    release(pairs)
    release(left)
    return links


def star_links(docs: DataFrame, common: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """Links of classes with their centres, each class with its most frequent centre first.

    Most classes are then in their component, and of the other pairs only those between components are left.
    """
    pairs = cut_lineage(star_pairs(common, percent))
    facts = facts_of(docs, pairs, classes, words, percent)
    nearest = pairs.groupBy("a", "na").agg(F.max(F.struct("times", -F.col("b"), "b", "nb")).alias("c")).select("a", "na", "c.b", "c.nb")
    first = verified(facts, nearest, percent)
    parts = _parts(first)
    of = lambda s: parts.select(F.col("node").alias(s), F.col("component").alias(f"p{s}"))
    others = (pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
              .filter(F.coalesce("pa", "a") != F.coalesce("pb", "b")).join(nearest.select("a", "b"), ["a", "b"], "left_anti"))
    links = cut_lineage(first.unionByName(verified(facts, others, percent)))
    for t in (pairs, facts, first, parts):
        release(t)
    return links


def _parts(links: DataFrame) -> DataFrame:
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return cut_lineage(connected(nodes, links))


def jaccard_groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest doc_id reachable by links, itself included.
    A null, empty or blank text has an empty set and links with nothing.  Rows that repeat a
    doc_id are one document: links of any of them count for all.  A row
    without doc_id links with nothing and has a null component.  No rows give no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    surveyed = cut_lineage(survey(base, words))
    classes = rarity(surveyed)
    every = surveyed.filter("chunk IS NULL").select("doc_id", "n", "f1", "f2")
    key = ["n", "f1", "f2"]
    own = every.filter("doc_id IS NOT NULL")
    groups = cut_lineage(own.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                         .filter("copies > 1").drop("copies"))
    members = cut_lineage(own.join(groups, key, "left").select("doc_id", *key, F.coalesce("rep", "doc_id").alias("rep")))
    copies = cut_lineage(members.filter("doc_id <> rep").select(F.col("doc_id").alias("doc"), *key))
    release(groups)
    found = cut_lineage(profiles(base, classes, words, percent, IdSet(copies)))
    # rows that the bitmap clears are representatives; only the others take part in the exact join
    reps = found.filter("NOT copy").unionByName(found.filter("copy").join(copies, ["doc", *key], "left_anti").select(*found.columns))
    post = postings(reps)
    release(found)  # each table goes when the next is written
    release(copies)
    common = shared(post)
    release(post)
    stars = star_links(base, common, classes, words, percent)
    rest = cut_lineage(common.join(_parts(stars), F.col("doc") == F.col("node"), "left")
                       .select("token", "doc", "n", "pos", "prev", F.coalesce("component", "doc").alias("part")))
    release(common)
    several = cut_lineage(rest.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("token"))
    rest, whole = cut_lineage(rest.join(several, "token", "left_semi")), rest
    release(whole)
    release(several)
    cross = cut_lineage(cross_pairs(rest, percent))
    release(rest)
    facts = facts_of(base, cross, classes, words, percent)
    links = stars.unionByName(verified(facts, cross, percent))
    release(facts)
    release(cross)
    answer = (members.join(_parts(links), F.col("rep") == F.col("node"), "left")
              .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")))
    unnamed = every.filter("doc_id IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return answer.unionByName(unnamed)
