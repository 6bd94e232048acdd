"""Language ID: a byte convolutional network in numpy.

One-hot bytes meet filters of several widths; each filter's largest response
in a fixed-length window (max pooling) is a feature, and a softmax over the features
names the language.  The network is trained on the driver with Adam on a bounded sample
of labelled windows.  Applying it needs no driver: every whole text is cut into
windows, windows are run in batches, and a document's probabilities are the mean
over all its windows.

Filters of width 2 to 4 are applied as two table look-ups by byte pair, so the
cost is the same for any filter values and linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import give_back

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
#: Bound of the training sample: about so many documents a language, and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 1500, 4


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, zero-padded, and the number of windows of each (1 at least)."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], dtype=np.int64)
    whole = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts, strict=True))
    return _LOWER[np.frombuffer(whole, dtype=np.uint8)].reshape(-1, WINDOW), counts


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Network:
    langs: list[str]
    filters: list[np.ndarray]   # per width: (width, 256, n)
    bias: np.ndarray
    weights: np.ndarray         # (features, langs)
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by the first byte pair (all widths) and by the second (widths 3 and 4)."""
        two, three, four = self.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        none = np.zeros_like(three[0])
        first = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1)
        second = np.concatenate([pair(three[2], none), pair(four[2], four[3])], axis=1)
        return np.ascontiguousarray(first, dtype=np.float32), np.ascontiguousarray(second, dtype=np.float32)

    def probabilities(self, w: np.ndarray, tables: tuple[np.ndarray, np.ndarray], batch: int = 32) -> np.ndarray:
        first, second = tables
        n = self.filters[0].shape[2]
        out = np.empty((len(w), len(self.langs)))
        for i in range(0, len(w), batch):
            part = w[i:i + batch]
            wide = np.zeros((len(part), WINDOW + 3), dtype=np.intp)
            wide[:, :WINDOW] = part
            pairs = wide[:, :-1] * 256 + wide[:, 1:]
            r = np.take(first, pairs[:, :WINDOW], axis=0, mode="clip")
            r[:, :, n:] += np.take(second, pairs[:, 2:], axis=0, mode="clip")
            out[i:i + batch] = _softmax(np.maximum(r.max(axis=1) + self.bias, 0) @ self.weights + self.offset)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(w: np.ndarray, y: np.ndarray, langs: list[str], filters: int = 12, epochs: int = 5,
          rate: float = 0.01, batch: int = 128, seed: int = 7) -> Network:
    """Adam on cross entropy; the same windows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    features = filters * len(WIDTHS)
    params = [rng.normal(0, 0.1, (k, 256, filters)) for k in WIDTHS]
    params += [np.zeros(features), rng.normal(0, 0.1, (features, len(langs))), np.zeros(len(langs))]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(w))
        for i in range(0, len(w), batch):
            rows = order[i:i + batch]
            x = np.zeros((len(rows), WINDOW + 3), dtype=np.int64)
            x[:, :WINDOW] = w[rows]
            # half of the windows are shortened, so short documents are learned too
            cut = np.where(rng.random(len(rows)) < 0.5, rng.integers(16, WINDOW + 1, len(rows)), WINDOW)
            x[np.arange(WINDOW + 3)[None, :] >= cut[:, None]] = 0
            for p in params[:3]:
                p[:, 0, :] = 0  # padding says nothing
            top, at = [], []
            for k, f in zip(WIDTHS, params[:3], strict=True):
                r = sum(f[j][x[:, j:j + WINDOW]] for j in range(k))
                at.append(r.argmax(axis=1))
                top.append(r.max(axis=1))
            z = np.maximum(np.concatenate(top, axis=1) + params[3], 0)
            g = _softmax(z @ params[4] + params[5])
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            dz = (g @ params[4].T) * (z > 0)
            grads = []
            for q, k in enumerate(WIDTHS):
                part, spot = dz[:, q * filters:(q + 1) * filters], at[q]
                d = np.zeros(k * 256 * filters)
                for j in range(k):
                    byte = np.take_along_axis(x, spot + j, axis=1)
                    d += np.bincount(((j * 256 + byte) * filters + np.arange(filters)).ravel(), part.ravel(), len(d))
                grads.append(d.reshape(k, 256, filters))
            grads += [dz.sum(axis=0), z.T @ g, g.sum(axis=0)]
            step += 1
            for p, d, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    for p in params[:3]:
        p[:, 0, :] = 0
    return Network(langs, [p.astype(np.float32) for p in params[:3]], *params[3:])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS,
        max_langs: int = 1000) -> Network:
    """Train on a bounded sample of the rows that are not held out and have a lang and a text.

    Rows are counted by language over the whole table; each language's share is chosen so that about
    ``sample_docs`` of its rows, picked by a hash of id, give ``sample_windows`` windows each,
    spread over the text.  The driver so receives at most about
    ``langs * sample_docs * sample_windows`` windows.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col("lang").cast("string").alias("lang")).count().limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} values in lang")
    if not counts:
        return Network([], [], *[np.zeros(0)] * 3)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == F.lit(lang), F.lit(min(1.0, sample_docs / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    room = F.greatest(F.length("text") - WINDOW, F.lit(0))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(sample_windows - 1)), lambda j: F.substr(
        F.col("text"), (F.floor(room * j / max(1, sample_windows - 1)) + 1).cast("int"), F.lit(WINDOW)))
    got = (rows.filter(draw < share).select("doc_id", "lang", F.array_distinct(cuts).alias("cuts")).toPandas()
           .sort_values(["doc_id", "lang"], kind="stable"))
    langs = sorted(counts)
    texts, y = [], []
    for lang, cut in zip(got["lang"], got["cuts"], strict=True):
        for t in cut:
            if any(map(str.isalpha, t)):
                texts.append(t.encode("utf-8", "replace")[:WINDOW])
                y.append(langs.index(lang))
    if not texts:
        return Network([], [], *[np.zeros(0)] * 3)
    return train(windows(texts)[0], np.array(y), langs)


def predict(text: Column, network: Network) -> Column:
    """Struct (lang_pred, score) of whole texts.

    A null text or one without a letter is ``und`` with score 0, and so is all
    text if nothing could be learned.  Ties go to the language first by name.
    """

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = network  # some 100 kB, sent with the function
        tables = net.tables() if net.langs else None
        for s in batches:
            pred, score = np.full(len(s), UNKNOWN, dtype=object), np.zeros(len(s))
            pos = [i for i, t in enumerate(s) if t and any(map(str.isalpha, t))] if net.langs else []
            lo = 0
            while lo < len(pos):  # windows of some 2 MB of text at a time
                hi, size = lo, 0
                while hi < len(pos) and (hi == lo or size + len(s.iloc[pos[hi]]) <= 2 << 20):
                    size += len(s.iloc[pos[hi]])
                    hi += 1
                w, n = windows([s.iloc[i].encode("utf-8", "replace") for i in pos[lo:hi]])
                p = np.add.reduceat(net.probabilities(w, tables), np.cumsum(n) - n, axis=0) / n[:, None]
                pred[pos[lo:hi]] = np.array(net.langs, dtype=object)[p.argmax(axis=1)]
                score[pos[lo:hi]] = np.minimum(p.max(axis=1), 1.0)
                lo = hi
            yield pd.DataFrame({"lang_pred": pred, "score": score})
        tables = s = w = p = pred = score = None
        give_back()

    return run(text)


def identify(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Only text and lang of rows that are not held out train the network; prediction sees
    the text alone.  A null doc_id counts as the empty text for the split.
    """
    net = network or fit(docs)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), net).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))
