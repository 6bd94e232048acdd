r"""Spelling variants: words one edit apart, found with a bit-sliced position index.

Of the words of a block the index has one bitset per (position, letter): the words that have this
letter there.  A word is read letter by letter against all words of its block at once; per position a few
word-parallel operations update

* the set of words that agree so far (no error), and
* three sets of words with exactly one error so far: replaced (same position), longer (position
  shifted by one to the right) and shorter (shifted by one to the left).

Blocks.  A pair of lengths t and t or t + 1 with one error keeps either the first half or the last
half of its t letters, so words meet in groups of equal (t, first half) and (t, last half).  A group of more than
``GROUP`` words is split again in the same way: half of the part that may still hold the error becomes a part
of the key.  With one letter left a group is as large as the alphabet allows, so no group grows with the corpus
for ever, whatever beginning a third of the words share.  Every pair belongs to exactly one group (the common
beginning of its words tells which half is kept), so counts of near words add up and no pair is ever a row.
Within a block the words are sorted by falling frequency, so the first set bit is the most frequent near word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, release

#: Words of a group beyond which it is split, and words that small groups are put together to.
GROUP, BLOCK = 8192, 1024
#: Machine words of one set of states at a time (1 MB).
STATE = 1 << 17
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_PART = 1 << 20


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of a text, A-Z lowered, some million characters at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _PART) if len(text) - at > _PART else None
        end = gap.start() if gap else len(text)
        yield _RUN.findall(text[at:end].encode().lower().decode())  # bytes.lower() changes A-Z only
        at = end


def word_counts(docs: DataFrame, misspell_every: int = 0) -> DataFrame:
    """(word, n) of all maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of doc_id and text, A-Z lowered.

    With ``misspell_every`` m > 0 one letter is lost where m divides h, the crc32 of ``<doc_id>:<run>``: the
    one at place h mod length.  Null texts have no run, a null doc_id counts as empty text.  Runs that lose their
    only letter are the empty word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for found in _runs(text or ""):
                    for word, times in Counter(found).items():
                        if misspell_every:
                            h = zlib.crc32(word.encode(), seed)
                            if h % misspell_every == 0:
                                h %= len(word)
                                word = word[:h] + word[h + 1:]
                        total[word] += times
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                             ["word", "n"])

    return (docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _refined(rows: DataFrame) -> DataFrame:
    """Each row (word, n, t, a, b) as two: the first or the last half of the open part [a, t - b) is kept."""
    half = F.expr("(t - a - b) div 2")
    sides = F.array(F.struct((F.col("a") + half).cast("int").alias("a"), F.col("b")),
                    F.struct(F.col("a"), (F.col("t") - F.col("a") - half).cast("int").alias("b")))
    out = rows.select("word", "n", "t", F.explode(sides).alias("s")).select("word", "n", "t", "s.a", "s.b")
    # nothing is left open where both halves would be kept
    return out.filter("t - a - b > 0").withColumn("k", F.concat_ws(
        ":", "t", "a", "b", F.concat(F.expr("left(word, a)"), F.lit("\x00"), F.expr("right(word, b)"))))


def _groups(words: DataFrame, shortest: int, group: int) -> DataFrame:
    """Rows (k, word, n, t, a, b) whose groups (of equal k) have at most ``group`` words or one open letter."""
    size = F.length("word").cast("int")
    rows = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda t: t >= shortest)).alias("t"))
    rows = cut_lineage(_refined(rows.withColumns({"a": F.lit(0), "b": F.lit(0)})))
    done = []
    while True:
        large = cut_lineage(rows.groupBy("k", "t", "a", "b").agg(F.count(F.lit(1)).alias("m"))
                            .filter((F.col("m") > group) & (F.expr("t - a - b") > 1)).select("k"))
        if large.isEmpty():
            break
        done.append(rows.join(large, "k", "left_anti"))
        rows = cut_lineage(_refined(rows.join(large, "k", "left_semi")))
    for part in done:
        rows = rows.unionByName(part.select(*rows.columns))
    return rows


class Index:
    """Bit-sliced index of one block: the words' open letters, and per position a bitset for each letter."""

    def __init__(self, words: list[str], t: int, a: int, b: int):
        self.open = t - a - b
        n = self.size = len(words)
        self.width = -(-n // 64)
        self.longer = np.array([len(w) > t for w in words])
        parts = [w[a:len(w) - b].ljust(self.open + 1, "\x00") for w in words]
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32).reshape(n, self.open + 1)
        letters, codes = np.unique(codes, return_inverse=True)
        self.codes, self.letters = codes.reshape(n, self.open + 1), len(letters)

    def bits(self, flags: np.ndarray) -> np.ndarray:
        """Rows of flags over the block's words as rows of 64-bit words."""
        out = np.zeros((len(flags), self.width * 8), dtype=np.uint8)
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[:, :packed.shape[1]] = packed
        return out.view(np.uint64)

    def slice(self, position: int) -> np.ndarray:
        """The bitsets of all letters at a position."""
        return self.bits(self.codes[:, position][None, :] == np.arange(self.letters)[:, None])

    def near(self, rows: np.ndarray, within: np.ndarray, last_half: bool) -> np.ndarray:
        """Sets of words one edit from each word of ``rows``, out of the words in its set ``within``.

        ``last_half``: the end of the words is a part of their key; then pairs that agree in all open letters
        belong to another group.
        """
        none, sub, ins, out = within, np.zeros_like(within), np.zeros_like(within), np.zeros_like(within)
        long_words = self.bits(self.longer[None, :])
        same = short = agreed = None
        left, here = None, self.slice(0)
        for i in range(self.open + 1):
            if i == self.open:  # words of length t are read
                agreed = none
                same = (sub & ~long_words) | (ins & ~none if last_half else ins | none) & long_words
            right = self.slice(i + 1) if i < self.open else None
            x = self.codes[rows, i]
            match = here[x]
            out = none if left is None else (out & left[x]) | none
            if right is not None:
                ins = (ins | none) & right[x]
                sub = (sub & match) | (none & ~match)
            none = none & match
            left, here = here, right
        short = (out & ~agreed if last_half else out) & ~long_words
        return np.where(self.longer[rows][:, None], short, same)


def _block(k: list[str], words: list[str], n: np.ndarray) -> tuple[list, list, list, list]:
    """(word, near words, frequency and text of the most frequent one) of the words that have any.

    ``k`` are the groups (of one t, a and b) in a row, their words by falling frequency.
    """
    t, a, b = map(int, k[0].split(":", 3)[:3])
    index = Index(words, t, a, b)
    first = np.array([i for i in range(len(k)) if i == 0 or k[i] != k[i - 1]])
    group = np.searchsorted(first, np.arange(len(k)), side="right") - 1
    masks = index.bits(group[None, :] == np.arange(len(first))[:, None])
    chunk = max(1, STATE // index.width)
    got: tuple[list, list, list, list] = ([], [], [], [])
    for lo in range(0, len(words), chunk):
        rows = np.arange(lo, min(lo + chunk, len(words)))
        near = index.near(rows, masks[group[rows]], b > 0)
        count = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(count)
        near = near[hit]
        place = (near != 0).argmax(axis=1)
        word = near[np.arange(len(hit)), place]
        best = place * 64 + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        got[0].extend(words[i] for i in rows[hit])
        got[1].extend(count[hit].tolist())
        got[2].extend(n[best].tolist())
        got[3].extend(words[i] for i in best)
    return got


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups in a row (sorted by k) to blocks of equal (t, a, b); the last group waits for the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        k = table.column("k").to_pylist()
        ends = [i for i in range(1, len(k)) if k[i] != k[i - 1]]
        keep = ends[-1] if ends else 0
        yield from _blocks(table.slice(0, keep))
        rest = table.slice(keep)
    if rest is not None:
        yield from _blocks(rest)


def _blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
    k, words, n = table.column("k").to_pylist(), table.column("word").to_pylist(), table.column("n").to_numpy()
    shape = [key.split(":", 3)[:3] for key in k]
    lo = 0
    while lo < len(k):
        hi = end = lo
        while end < len(k) and shape[end] == shape[lo]:
            group = end
            while group < len(k) and k[group] == k[end]:
                group += 1
            if hi > lo and group - lo > BLOCK:
                break
            hi = end = group
        if hi - lo > 1:
            found = _block(k[lo:hi], words[lo:hi], n[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.string()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()),
                 pa.array(found[3], pa.string())], ["word", "near", "best_n", "best"])
        lo = hi


def near_words(words: DataFrame, shortest: int = 1, group: int = GROUP) -> DataFrame:
    """(word, n_near, form, form_n) of words with a near word: how many there are, and the most frequent one.

    ``words`` are distinct words with their frequency n; ties of the most frequent one go to the smallest in
    code-point order.
    """
    rows = _groups(words, shortest, group).select("k", "word", "n")
    found = (rows.repartition("k").sortWithinPartitions("k", F.desc("n"), "word")
             .mapInArrow(_match, "word string, near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best")))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("m"))
            .select("word", "n_near", F.col("m.best").alias("form"), (-F.col("m.n")).alias("form_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): every word's last form, by pointer doubling; ``forms`` has word and form, no cycles."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                F.col("next").isNotNull().alias("moved")))
        release(now)
        now = step.select("word", "root")
        now._table_path = step._table_path
        if step.filter("moved").isEmpty():
            return now


def group_variants(counts: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2,
                   group: int = GROUP) -> DataFrame:
    """One row per word of at least ``min_length`` letters and ``min_count`` occurrences.

    ``counts`` has word and n; repeated rows of a word add up, null words are left out, other columns are ignored,
    an empty table gives no row.  Returns word, form (the near word of largest n, the smallest of several, if its
    n is ``ratio`` times the word's or more, else null), root (the last of the forms from the word on, the word
    itself if it has none), n, n_near (near words: exactly one letter inserted, deleted or replaced) and form_n.
    """
    words = (counts.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
             .filter((F.length("word") >= min_length) & (F.col("n") >= min_count)))
    words = cut_lineage(words)
    near = words.join(near_words(words, min_length, group), "word", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    near = cut_lineage(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    last = roots(near.filter("form IS NOT NULL"))
    return (near.join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
