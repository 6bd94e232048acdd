"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix array (as deep
as the longest piece).  Every piece of the vocabulary is looked up in it by binary search; the ranges
found are the occurrences, that is the edges of a lattice over the text.  The edges are
sorted by position and relaxed from left to right.

The vocabularies served here are BPE models with byte fallback, so a path is not
the cheapest by summed scores.  Relaxing keeps, for every position, the one last piece that
BPE would leave there: a piece may follow another only if no merge across their
border would have come first (``Vocabulary.joined``).  Each position has at most one such
predecessor, hence the path is the same as that of merging, and the ids equal those of the
public library (tested).  Characters outside the vocabulary become byte pieces.

Work is by batch inside tasks; nothing is shuffled, and a lost executor repeats its batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of distinct words that are indexed at a time, of documents that are put together, and of words kept.
INDEX_CHARS, TEXT_CHARS, KEPT_CHARS = 150_000, 1_000_000, 1_500_000


class Vocabulary:
    """Pieces, their merge order and the rules of a BPE model; plain data, read on the driver."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [bytes([int(self.pieces[i][3:5], 16)]) if sp.is_byte(i) else b"" if special[i]
                    else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        normal = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        if len(self.bytes) != 256 or any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("not a BPE vocabulary with byte fallback whose pieces stay inside words")
        self.rank = {self.pieces[i]: (-sp.get_score(i), i) for i in normal}
        self.ids = {p: i for p, (_, i) in self.rank.items()}
        # a merge's halves: needed to know which symbols stand at a piece's ends while it grows
        self.split: dict[int, tuple[int, int]] = {}
        self.usable = []
        for p, i in self.ids.items():
            if len(p) == 1:
                self.usable.append(i)
            elif set(p) != {SPACE}:
                done, last = self.merge(p)
                if len(done) == 1:
                    self.split[i] = (self.ids[last[0]], self.ids[last[1]])
                    self.usable.append(i)
        self.usable.sort()
        self.runs: dict[int, list[int]] = {}

    def merge(self, word: str) -> tuple[list[str], tuple[str, str]]:
        """BPE by definition: join the best-ranked neighbours, leftmost first; also the last two joined."""
        s, last = list(word), ("", "")
        while True:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(s, s[1:])) if a + b in self.rank), default=None)
            if best is None:
                return s, last
            k = best[1]
            last = (s[k], s[k + 1])
            s[k:k + 2] = [s[k] + s[k + 1]]

    def run(self, n: int) -> list[int]:
        """Ids of ``n`` blanks in a row: their merges come after all others, and their scores tie.

        Equal scores merge leftmost first, so the first blanks grow to the longest piece there is, then the next.
        """
        if n not in self.runs:
            most = 1
            while SPACE * (most + 1) in self.ids:
                most += 1
            if n <= 2 * most or any(len(p) > most and set(p) == {SPACE} for p in self.ids):
                self.runs[n] = [self.ids[x] for x in self.merge(SPACE * n)[0]]
            else:
                self.runs[n] = [self.ids[SPACE * most]] + self.run(n - most)
        return self.runs[n]

    def joined(self, a: int, b: int) -> bool:
        """Whether a merge across the border of pieces ``a b`` comes before both are whole.

        The symbols at the border are walked in order of time: the right ends of ``a`` from its last
        character up, the left ends of ``b`` likewise; at each moment two of them face each other.
        """
        never = float("inf")
        order = lambda i: self.rank[self.pieces[i]][0]
        left, right = [a], [b]
        while left[-1] in self.split:
            left.append(self.split[left[-1]][1])
        while right[-1] in self.split:
            right.append(self.split[right[-1]][0])
        i, j = len(left) - 1, len(right) - 1
        while True:
            ends_left = order(left[i - 1]) if i else never
            ends_right = order(right[j - 1]) if j else never
            hit = self.rank.get(self.pieces[left[i]] + self.pieces[right[j]])
            # of equal merges the leftmost goes first: those inside a, then this one, then those inside b
            if hit and hit[0] < ends_left and hit[0] <= ends_right:
                return True
            if not i and not j:
                return False
            if ends_left <= ends_right:
                i -= 1
            else:
                j -= 1


class Encoder:
    """Encodes batches of words; lives in a task and remembers checked pairs of pieces and the words of earlier texts."""

    CACHE = 1 << 20

    def __init__(self, v: Vocabulary):
        self.v = v
        self.length = np.ones(v.size + 1, dtype=np.int32)
        self.length[:v.size] = [max(1, len(p)) for p in v.pieces]
        self.depth = max(len(v.pieces[i]) for i in v.usable)
        self.flat = np.frombuffer("".join(v.pieces[i] for i in v.usable).encode("utf-32-le"), dtype=np.uint32)
        self.plen = np.array([len(v.pieces[i]) for i in v.usable])
        self.known = np.full(self.CACHE, -1, dtype=np.int64)
        self.value = np.zeros(self.CACHE, dtype=bool)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}  # words by number; word i's ids are at start[i] in flat_ids, count[i] of them
        self.kept = 0
        self.flat_ids = np.zeros(0, np.int32)
        self.start = self.count = np.zeros(0, np.int64)

    def _apart(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For each pair of neighbours whether BPE leaves both as they are."""
        key = u.astype(np.int64) * (self.v.size + 1) + t
        slot = (key * np.int64(0x9E3779B97F4A7C1 | 1) >> 20) & (self.CACHE - 1)
        new = self.known[slot] != key
        out = self.value[slot]
        if new.any():
            keys, back = np.unique(key[new], return_inverse=True)
            n = self.v.size + 1
            value = np.array([not self.v.joined(int(k) // n, int(k) % n) for k in keys], dtype=bool)
            out[new] = value[back]
            self.known[slot[new]], self.value[slot[new]] = key[new], out[new]
        return out

    def _occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of every occurrence of every piece; 0 in ``text`` parts words."""
        alphabet = np.intersect1d(np.unique(text), np.unique(self.flat))
        code = np.searchsorted(alphabet, text).clip(0, max(0, len(alphabet) - 1))
        code = np.where(alphabet[code] == text, code + 1, 0).astype(np.uint64) if len(alphabet) else np.zeros(len(text), np.uint64)
        bits = max(1, int(len(alphabet) + 1).bit_length())
        per = 64 // bits
        n_keys = -(-self.depth // per)
        padded = np.concatenate([code, np.zeros(n_keys * per, np.uint64)])
        # beyond a code of 0 nothing counts: a suffix ends with its word or at an unknown character
        keys = []
        open_ = np.ones(len(text), dtype=bool)
        for k in range(n_keys):
            key = np.zeros(len(text), np.uint64)
            for j in range(k * per, (k + 1) * per):
                c = padded[j:j + len(text)]
                open_ &= c > 0
                key = (key << np.uint64(bits)) | np.where(open_, c, np.uint64(0))
            keys.append(key)
        starts = np.flatnonzero(code).astype(np.int32)
        suffixes = starts[np.lexsort([k[starts] for k in reversed(keys)])]
        keys = [k[suffixes] for k in keys]
        # the pieces whose characters all occur, as keys: least and greatest continuation
        pc = np.searchsorted(alphabet, self.flat).clip(0, max(0, len(alphabet) - 1))
        good = alphabet[pc] == self.flat if len(alphabet) else np.zeros(len(self.flat), bool)
        begin = np.cumsum(self.plen) - self.plen
        take = np.flatnonzero(np.logical_and.reduceat(good, begin))
        if not len(take) or not len(suffixes):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        pad = np.concatenate([pc.astype(np.uint64) + np.uint64(1), np.zeros(n_keys * per, np.uint64)])
        low, high, top = [], [], np.uint64((1 << bits) - 1)
        for k in range(n_keys):
            a = np.zeros(len(take), np.uint64)
            b = np.zeros(len(take), np.uint64)
            for j in range(k * per, (k + 1) * per):
                inside = j < self.plen[take]
                c = pad[begin[take] + j] if j < self.depth else np.zeros(len(take), np.uint64)
                a = (a << np.uint64(bits)) | np.where(inside, c, np.uint64(0))
                b = (b << np.uint64(bits)) | np.where(inside, c, top)
            low.append(a)
            high.append(b)
        lo = self._search(keys, low, False)
        hi = self._search(keys, high, True)
        n = hi - lo
        at = np.repeat((lo - (np.cumsum(n) - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return suffixes[at], np.repeat(np.array(self.v.usable, dtype=np.int32)[take], n)

    @staticmethod
    def _search(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all wanted keys at once in the sorted suffixes."""
        lo = np.zeros(len(wanted[0]), np.int64)
        hi = np.full(len(wanted[0]), len(keys[0]), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            m = np.minimum(mid, len(keys[0]) - 1)
            less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for k, w in zip(keys, wanted, strict=True):
                less |= equal & (k[m] < w)
                equal &= k[m] == w
            right = (less | equal if after else less) & (lo < hi)
            lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
        return lo

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(w) for w in words], dtype=np.int64)
        begin = np.cumsum(size + 1) - (size + 1)
        end = begin + size
        offset = (np.arange(len(text)) - np.repeat(begin, size + 1)).astype(np.int32)
        inside = np.ones(len(text), dtype=bool)
        inside[end] = False
        pos, piece = self._occurrences(np.where(inside, text, 0))
        covered = np.zeros(len(text), dtype=bool)
        covered[pos[self.length[piece] == 1]] = True
        other = np.flatnonzero(inside & ~covered)  # characters that only bytes can spell
        pos = np.concatenate([pos, other.astype(np.int32)])
        piece = np.concatenate([piece, np.full(len(other), self.v.size, dtype=np.int32)])
        # sorted by where they end in their word, all words are relaxed side by side
        level = offset[pos] + self.length[piece]
        order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 65536 else level, kind="stable")
        pos, piece, level = pos[order], piece[order], level[order]
        del order
        cuts = np.flatnonzero(np.diff(level)) + 1
        last = np.full(len(text), -1, dtype=np.int32)
        last[begin] = -2
        none = self.v.size
        for s, t in zip(np.split(pos, cuts), np.split(piece, cuts), strict=True):
            u = last[s]
            ok = u != -1
            check = (u >= 0) & (u != none) & (t != none)
            ok[check] = self._apart(u[check], t[check])
            last[s[ok] + self.length[t[ok]]] = t[ok]
        # back from every word's end; byte spellings are put in at the end
        mark = np.full(len(text), -1, dtype=np.int32)
        at, word = end[size > 0], np.flatnonzero(size > 0)
        while len(at):
            t = last[at]
            if (t < 0).any():
                raise AssertionError("a position that no piece reaches")
            mark[at] = t
            at = at - self.length[t]
            more = at > begin[word]
            at, word = at[more], word[more]
        ends = np.flatnonzero(mark >= 0)
        ids = mark[ends]
        owner = np.searchsorted(begin, ends - 1, side="right") - 1
        if (ids == none).any():
            spelled = [[int(t)] if t != none else [self.v.bytes[b] for b in chr(text[e - 1]).encode("utf-8", "replace")]
                       for t, e in zip(ids, ends, strict=True)]
            owner = np.repeat(owner, [len(x) for x in spelled])
            ids = np.array([x for xs in spelled for x in xs], dtype=np.int64)
        return ids.astype(np.int32), np.bincount(owner, minlength=len(words))

    CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n\r\t]*|[^{SPACE}\n\r\t]+|[\n\r\t]")

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if self.kept > KEPT_CHARS:
            self._forget()
        index, known = self.index, len(self.index)
        docs = []
        for t in texts:
            chunks = self.CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else []
            docs.append(np.array([index.setdefault(c, len(index)) for c in chunks], dtype=np.int32))
        if len(index) > known:
            self._learn(list(islice(index, known, None)))
        sizes = np.array([int(self.count[d].sum()) for d in docs], dtype=np.int64)
        every = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        n = self.count[every]
        at = np.repeat(self.start[every] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.flat_ids[at], sizes

    def _learn(self, chunks: list[str]) -> None:
        """Encodes words that were not met before and keeps their ids."""
        # a run of blanks only merges when all else is done: its last blank belongs to the word first
        runs = {i: len(c) - len(c.lstrip(SPACE)) for i, c in enumerate(chunks) if c.startswith(SPACE * 2)}
        words = [c[runs[i] - 1:] if i in runs else c for i, c in enumerate(chunks)]
        ids, counts, i = [], [], 0
        while i < len(words):
            j, n = i, 0
            while j < len(words) and (j == i or n + len(words[j]) <= INDEX_CHARS):
                n += len(words[j]) + 1
                j += 1
            x, c = self.words(words[i:j])
            ids.append(x)
            counts.append(c)
            self.kept += n
            i = j
        flat, count = np.concatenate(ids), np.concatenate(counts)
        start = np.cumsum(count) - count
        if runs:
            blank, extra, end = self.v.ids[SPACE], [], len(flat)
            for i, n in runs.items():
                own = flat[start[i]:start[i] + count[i]]
                own = np.concatenate([self.v.run(n), own[1:]]) if own[0] == blank else np.concatenate([self.v.run(n - 1), own])
                start[i], count[i] = end, len(own)
                end += len(own)
                extra.append(own.astype(np.int32))
            flat = np.concatenate([flat, *extra])
        self.start = np.concatenate([self.start, start + len(self.flat_ids)])
        self.count = np.concatenate([self.count, count])
        self.flat_ids = np.concatenate([self.flat_ids, flat])


def decode_ids(v: Vocabulary, ids) -> str:
    """Text of a list of ids: pieces and byte pieces joined, without the blank that encoding puts first."""
    raw = b"".join([v.raw[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``(doc_id, n_tokens, round_trip, ids)``, one row per row of ``docs``.

    ``round_trip``: decoding the ids gives the text again.  Only a text that itself contains
    U+2581, the sign for a blank, does not come back.  Null and empty texts have no ids.  Texts are
    encoded whole.
    """
    v = vocabulary or Vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TEXT_CHARS, side="right")))
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                ids, sizes = encoder.texts(texts)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                same = [decode_ids(v, ids[a:b].tolist()) == t for a, b, t in zip(ends, ends[1:], texts, strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(same, pa.bool_()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))],
                    ["doc_id", "n_tokens", "round_trip", "ids"])
                lo = hi

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(lean(run), "doc_id long, n_tokens long, round_trip boolean, ids array<int>"))


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids give a null text."""
    v = vocabulary or Vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(v, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(run), "doc_id long, text string")
