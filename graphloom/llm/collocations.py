r"""Phrase collocation mining by SETM: sorted occurrence relations, merge-joined at adjacent positions.

1. *Words.*  Texts are cut to pieces and words; a word of a language gets a 64-bit id (a hash).  Words are
   counted by id and text, and where two texts share an id everything starts again with another hash, so
   ids are exact.
2. *R1*, the occurrences (piece, position, word) sorted by piece and position, is written as a table,
   without words that are too rare to be in a phrase.  Its rows are blocks of ``BLOCK`` words.  A
   block also has the next few words of its stream, and only phrases that begin in its own part are counted there.
3. For each length k the relation of k - 1 words is merge-joined with itself at adjacent positions of
   a piece, the joined rows are counted by phrase, and phrases that occur often enough are kept.  Before the next length the
   relation is semi-joined with them and written.

The occurrences never move between tasks: only counts do, added up before each shuffle.  The semi-join is a
bitmap (16 MB at most) that loses no frequent phrase and may let a few others pass, which the exact counts of the next
length then drop.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.jaccard import IdSet, mix
from graphloom.session import cut_lineage, release

#: Bytes of text that are cut to words at a time, words of a block (so that 16 bits number those of a block and the
#: few behind it), bytes of a word that are hashed by place.
PART, BLOCK, PLACES = 1 << 20, (1 << 16) - 256, 64
#: A scale of scores: 1 counts as this.
SCALE = 1_000_000
#: Candidates of which the best are found apart before they are ranked together.
SHARE = 100_000

_U = np.uint64
_WORD_BYTE, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Part:
    """Some texts (or a part of a long one) as bytes, with their words.

    ``text`` is the number of each word's text, ``first`` tells words that begin a piece.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, number: int, broken: bool):
        self.raw = raw = _LOWER[raw]
        kind = _KIND[raw]
        inside = kind == _WORD_BYTE
        edge = bounds[:-1][bounds[:-1] < len(raw)]
        before = np.zeros(len(raw), dtype=bool)
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.zeros(len(raw), dtype=bool)
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        breaks = np.cumsum(kind == _BREAK, dtype=np.int32)
        at = np.searchsorted(bounds, self.starts, side="right") - 1
        self.text = at + number
        piece = breaks[self.starts] + at
        self.first = np.ones(len(piece), dtype=bool)
        self.first[1:] = piece[1:] != piece[:-1]
        if len(piece):
            self.first[0] = broken or breaks[self.starts[0]] > 0
            self.broken = bool(breaks[-1] > breaks[self.ends[-1] - 1])
        else:
            self.broken = broken or bool(len(raw) and breaks[-1])

    def words(self, places: np.ndarray) -> Iterator[str]:
        data = self.raw.tobytes()
        for s, e in zip(self.starts[places].tolist(), self.ends[places].tolist(), strict=True):
            yield data[s:e].decode()

    def ids(self, langs: np.ndarray, seed: int) -> np.ndarray:
        """Id of each word, by its bytes and the hash of its text's language."""
        rng = np.random.default_rng(seed)
        value = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        power = rng.integers(0, 1 << 63, PLACES, dtype=np.uint64) * _U(2) + _U(1)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        short = np.minimum(size, PLACES)
        total = np.cumsum(short)
        place = np.arange(total[-1]) - np.repeat(total - short, short)
        part = value[self.raw[np.repeat(self.starts, short) + place]] * power[place]
        word = np.add.reduceat(part, total - short) + mix(size.astype(np.uint64))
        for i in np.flatnonzero(size > PLACES):
            whole = self.raw[self.starts[i]:self.ends[i]].tobytes()
            word[i] = np.frombuffer(hashlib.blake2b(whole, digest_size=8, key=b"%d" % seed).digest(), np.uint64)[0]
        return mix(mix(word, 1) + langs[self.text], 2)


def _parts(column: pa.Array) -> Iterator[Part]:
    """The texts of an Arrow column as parts of some ``PART`` bytes; longer texts are cut between words."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, places, data = column.buffers()
    at = np.frombuffer(places, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PART, side="right")) - 1)
        if at[hi] - at[lo] <= PART:
            yield Part(raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], lo, True)
        else:
            a, end, broken = int(at[lo]), int(at[hi]), True
            while a < end:
                b = min(a + PART, end)
                while b < end:  # on to the end of a word
                    gap = np.flatnonzero(_KIND[raw[b:b + PART]] != _WORD_BYTE)
                    b = min(end, b + (int(gap[0]) if len(gap) else PART))
                    if len(gap):
                        break
                part = Part(raw[a:b], np.array([0, b - a]), lo, broken)
                yield part
                a, broken = b, part.broken
        lo = hi


def _lang_hashes(column: pa.Array, seed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of a batch, the number of each row's language and the hash of each row's language."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    each = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, key=b"%d" % seed).digest(), "little")
                     for x in names], dtype=np.uint64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    return names, at, each[at] if len(names) else np.zeros(0, np.uint64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(id, lang, word, f) of all words of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lang, hashes = _lang_hashes(batch.column(0), seed)
            for part in _parts(batch.column(1)):
                ids, place, f = np.unique(part.ids(hashes, seed), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [_long(ids), pa.DictionaryArray.from_arrays(pa.array(lang[part.text[place]], pa.int32()), pa.array(names, pa.string()))
                     .cast(pa.string()), pa.array(part.words(place), pa.string()), pa.array(f.astype(np.int64))],
                    ["id", "lang", "word", "f"])

    return (texts.mapInArrow(run, "id long, lang string, word string, f long")
            .groupBy("id", "lang", "word").agg(F.sum("f").alias("f")))


_RELATION = "own int, words binary, codes binary, first binary, alive binary"


def _row(own: int, words: np.ndarray, first: np.ndarray, alive: np.ndarray) -> pa.RecordBatch:
    """A block: its distinct ids and each word's number among them (2 bytes), so common words cost little."""
    ids, codes = np.unique(words, return_inverse=True)
    parts = [ids.tobytes(), codes.astype(np.uint16).tobytes(), np.packbits(first).tobytes(), np.packbits(alive).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]],
                                      ["own", "words", "codes", "first", "alive"])


def occurrences(texts: DataFrame, frequent: IdSet, seed: int, longest: int) -> DataFrame:
    """Blocks of words in order of piece and position; a word that is left out ends its piece.

    ``codes`` number each word among the distinct ``words`` (ids), ``first`` has a bit for each that begins a
    piece, ``alive`` a bit for each where a phrase of the relation begins; ``own`` words are the block's own.
    """
    halo = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, gone = np.zeros(0, np.uint64), np.zeros(0, bool), True
        for batch in batches:
            _, _, hashes = _lang_hashes(batch.column(0), seed)
            for part in _parts(batch.column(1)):
                ids = part.ids(hashes, seed)
                if not len(ids):
                    continue
                keep = frequent.holds(ids.view(np.int64))
                begins = part.first.copy()
                begins[1:] |= ~keep[:-1]
                begins[0] |= gone
                gone = not keep[-1]
                words, first = np.concatenate([words, ids[keep]]), np.concatenate([first, begins[keep]])
                while len(words) >= BLOCK + halo:
                    n = BLOCK + halo
                    yield _row(BLOCK, words[:n], first[:n], np.ones(n, bool))
                    words, first = words[BLOCK:], first[BLOCK:]
        if len(words):
            yield _row(len(words), words, first, np.ones(len(words), bool))

    return texts.mapInArrow(run, _RELATION)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Own words, ids, codes, places (piece * 2 ** 32 + position) and alive flags of the blocks of a batch."""
    for i in range(batch.num_rows):
        own, ids, codes, first, alive = (c[i].as_py() for c in batch.columns)
        ids, codes = np.frombuffer(ids, np.uint64), np.frombuffer(codes, np.uint16)
        bits = [np.unpackbits(np.frombuffer(x, np.uint8))[:len(codes)].astype(bool) for x in (first, alive)]
        starts = np.flatnonzero(bits[0])
        piece = np.cumsum(bits[0])
        begin = np.concatenate([[0], starts])[piece]
        yield own, ids, codes, (piece.astype(np.int64) << 32) + np.arange(len(codes)) - begin, bits[1]


def _merge_join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the sorted places ``left`` have the next position of their piece in the sorted places ``right``."""
    at = np.searchsorted(right, left + 1)
    return np.append(right, -1)[at] == left + 1


def _joined(places: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Indexes where the phrase of the relation and the one a position later are both there."""
    index = np.flatnonzero(alive)
    return index[_merge_join(places[index], places[index])]


def _phrase_key(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for i, c in enumerate(columns):
        key = mix(key * _U(3) + c, i)
    return key


def phrase_counts(relation: DataFrame, k: int, least: int) -> DataFrame:
    """(w1 .. wk, f) of the phrases of k words with f >= least, from the relation of k - 1 words."""
    names = [f"w{i + 1}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ids, codes, places, alive in _blocks(batch):
                at = _joined(places, alive)
                at = at[at < own]
                key = codes[at].astype(np.uint64)
                for i in range(1, k):
                    if i > 2:  # as ranks, two more bytes always fit
                        key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
                    key = (key << _U(16)) + codes[at + i]
                _, where, f = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[_long(ids[codes[at[where] + i]]) for i in range(k)], pa.array(f.astype(np.int64))],
                                                 [*names, "f"])

    return (relation.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "f"]))
            .groupBy(*names).agg(F.sum("f").alias("f")).filter(F.col("f") >= least))


def _keys(counts: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([_long(_phrase_key(columns))], ["key"])

    return counts.select(*[f"w{i + 1}" for i in range(k)]).mapInArrow(run, "key long")


def kept_occurrences(relation: DataFrame, frequent: IdSet, k: int) -> DataFrame:
    """The relation of k words: those phrases of the relation of k - 1 words, joined, that may be frequent.

    Words in no such phrase are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ids, codes, places, alive in _blocks(batch):
                words = ids[codes]
                at = _joined(places, alive)
                at = at[frequent.holds(_phrase_key([words[at + i] for i in range(k)]).view(np.int64))] if len(at) else at
                now, covered = np.zeros(len(words), bool), np.zeros(len(words), bool)
                now[at] = True
                for i in range(k):
                    covered[at + i] = True
                keep = np.flatnonzero(covered)
                if len(keep):
                    first = np.ones(len(keep), bool)
                    first[1:] = places[keep[1:]] != places[keep[:-1]] + 1
                    yield _row(int(np.searchsorted(keep, own)), words[keep], first, now[keep])

    return relation.mapInArrow(run, _RELATION)


def _decimal(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _best_cut(counts: dict[int, DataFrame], k: int) -> DataFrame:
    """Phrases of k words with f and their lowest-scoring cut (score, cut, l, r)."""
    names = [f"w{i + 1}" for i in range(k)]
    rows = counts[k]
    cuts = []
    for j in range(1, k):
        l = counts[j].toDF(*names[:j], f"l{j}")
        r = counts[k - j].toDF(*names[j:], f"r{j}")
        rows = rows.join(l, names[:j]).join(r, names[j:])
        square = _decimal(F.lit(SCALE)) * F.col("f").cast("decimal(16,0)") * F.col("f").cast("decimal(16,0)")
        rows = rows.withColumns({f"top{j}": square, f"below{j}": F.col(f"l{j}").cast("decimal(19,0)") * F.col(f"r{j}").cast("decimal(19,0)")})
        cuts.append(F.struct(F.expr(f"top{j} div below{j}").cast("long").alias("score"), F.lit(j).alias("cut"),
                             F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
    return rows.select(*names, "f", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("c"))


def _contained(counts: dict[int, DataFrame], k: int, longest: int, percent: int) -> DataFrame:
    """Phrases of k words that a longer candidate with ``percent`` of their occurrences contains."""
    names = [f"w{i + 1}" for i in range(k)]
    inside = None
    for m in range(k + 1, longest + 1):
        spans = F.array(*[F.struct(*[F.col(f"w{i + j + 1}").alias(f"w{j + 1}") for j in range(k)]) for i in range(m - k + 1)])
        part = counts[m].select(F.explode(spans).alias("s"), "f").groupBy("s").agg(F.max("f").alias("longer"))
        part = part.select("s.*", "longer")
        inside = part if inside is None else inside.unionByName(part)
    return (inside.join(counts[k], names).filter(100 * F.col("longer") >= percent * F.col("f")).select(*names).distinct())


def mine(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50) -> DataFrame:
    """All collocations of 2 to ``longest`` words: lang, phrase, a, l, r, n, score.

    ``docs`` has text and lang; null texts are empty, a null lang is ``und``, other columns are ignored, repeated rows
    count each time, an empty table has no phrase.  Per lang: n are all word occurrences, a those of the phrase (``least``
    or more), l and r those of the two sides of its lowest-scoring cut, score floor(10 ** 6 * a * a / (l * r)).  Phrases inside a
    longer one that has ``percent`` per cent of their occurrences or more are dropped.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    for seed in itertools.count(1):
        words = cut_lineage(word_counts(texts, seed))
        if words.groupBy("id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").isEmpty():
            break
        release(words)
    common = words.filter(F.col("f") >= least)
    relation = cut_lineage(occurrences(texts, IdSet(common.select("id")), seed, longest))
    counts = {1: common.select(F.col("id").alias("w1"), "f")}
    for k in range(2, longest + 1):
        counts[k] = cut_lineage(phrase_counts(relation, k, least))
        if k < longest:
            kept = cut_lineage(kept_occurrences(relation, IdSet(_keys(counts[k], k)), k))
            release(relation)
            relation = kept
    release(relation)
    word = common.select("id", "lang", "word")
    out = None
    for k in range(2, longest + 1):
        names = [f"w{i + 1}" for i in range(k)]
        rows = _best_cut(counts, k)
        if k < longest:
            rows = rows.join(_contained(counts, k, longest, percent), names, "left_anti")
        for i, name in enumerate(names):
            text = word.select(F.col("id").alias(name), F.col("word").alias(f"t{i}"), *(["lang"] if i == 0 else []))
            rows = rows.join(text, name)
        rows = rows.select("lang", F.concat_ws(" ", *[f"t{i}" for i in range(k)]).alias("phrase"), F.col("f").alias("a"),
                           F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return out.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_phrases(docs: DataFrame, top: int = 2000, **how) -> DataFrame:
    """The first ``top`` collocations of each lang by falling score, then falling a, then phrase, with their rank.

    A lang may hold any share of the candidates, so the first ``top`` of each of many parts are found before
    the parts meet.
    """
    found = cut_lineage(mine(docs, **how))
    parts = found.count() // SHARE + 1
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    place = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = (found.withColumn("part", place)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
            .filter(F.col("rank") <= top).drop("part"))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
