r"""PII: information-theoretic sanitisation.

Personal data found by pattern (email, ip, card, phone) are the protected
entities.  Other words may reveal the entity even when its mentions are
masked.  How strongly is estimated from the corpus: with document counts N,
df(e), df(t) and df(t, e),

    IC(e) = log2(N / df(e)),   PMI(t; e) = log2(N * df(t, e) / (df(t) * df(e)))

and a term that tells at least the share ``DISCLOSED`` of the entity's information
(PMI >= share * IC) is a span wherever it occurs: anywhere in a document that
mentions the entity, and in documents that do not.  No number of documents is asked for:
df(t, e) / df(t), the share of the term's documents that have the entity, is smoothed by
``PRIOR`` documents at the entity's own rate,

    (df(t, e) + PRIOR * df(e) / N) / (df(t) + PRIOR)

so a word of one document tells much of an entity of one document in a large corpus
and little in a small one.

All counts cover the whole corpus and whole documents.  As df(t, e) <= df(e), a term of
too many documents cannot tell enough of an entity; only the others are paired.  Bitmaps of
bounded size tell tasks which words may be in a table of terms, and a join makes it exact.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bitmap, lean
from graphloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
DISCLOSED, PRIOR = 0.9, 1.0
#: Distinct terms that a task counts before it gives them out.
COUNTED = 300_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match never starts inside a run of digits, so the look-behind only saves the search of each run's rest
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
# every ip and card lies in one of these: they begin with a digit and go on as long as any of the two could
_NUMBERS = re.compile(r"[0-9][0-9 .-]*+")
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»„“”‘’¿¡…"


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) by kind, then start; linear in the length of the text."""
    spans: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        part = text[done:at]
        start = done + len(part.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            spans.append(("email", start, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    numbers = [m.span() for m in _NUMBERS.finditer(text) if m.end() - m.start() >= 7]
    for lo, hi in numbers:
        for m in _IP.finditer(text, lo, hi):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                spans.append(("ip", *m.span()))
    for lo, hi in numbers:
        if hi - lo < 13:
            continue
        for m in _CARD.finditer(text, lo, hi):
            if m.end() - m.start() >= 13:
                digits = _NO_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def entity(kind: str, mention: str) -> str:
    """What a mention stands for: addresses in lower case, numbers by their digits."""
    return f"{kind}:{mention.lower() if kind in ('email', 'ip') else _NO_DIGIT.sub('', mention)}"


def term(word: str) -> str:
    return word.lower().strip(_EDGES)


def words(text: str, spans: list[tuple[str, int, int]], only: set[str] | None = None) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words with a letter that touch no base span; ``only``: of these words as they stand."""
    taken = sorted((s, e) for _, s, e in spans)
    k, reach = 0, -1
    for m in _WORD.finditer(text):
        if only is not None and m[0] not in only:
            continue
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach > a:
            continue
        t = term(m[0])
        if any(map(str.isalpha, t)):
            yield t, a, b


class Sketch:
    """Which terms may be in a table of ``n`` terms: a bitmap of some 16 bits a term, 16 MB at most, five bits set for each."""

    def __init__(self, terms: DataFrame, n: int):
        self.bits = min(1 << 27, max(1 << 16, 1 << (16 * n).bit_length()))
        part = [F.pmod(F.crc32("term"), F.lit(self.bits)).cast("long")]
        part += [F.pmod(F.conv(F.substring(F.md5("term"), 8 * i + 1, 8), 16, 10).cast("long"), F.lit(self.bits)) for i in range(4)]
        self.flags = bitmap(terms.select(F.explode(F.array(*part)).alias("p")), self.bits)

    def __contains__(self, term: str) -> bool:
        word, flags, bits = term.encode(), self.flags, self.bits
        p = zlib.crc32(word) % bits
        if not flags[p >> 3] >> (p & 7) & 1:
            return False
        h = hashlib.md5(word, usedforsecurity=False).digest()
        return all(flags[p >> 3] >> (p & 7) & 1 for p in (int.from_bytes(h[i:i + 4], "big") % bits for i in (0, 4, 8, 12)))


class Known:
    """The terms of texts as far as ``terms`` may hold them.

    Words are those of ``_WORD``, which is how bytes are split; what a word was found to be is kept for later texts.
    """

    def __init__(self, terms: Sketch):
        self.terms = terms
        self.full: set[str] = set()  # terms that are no longer asked for
        self.none: set[bytes] = set()
        self.term: dict[bytes, str] = {}

    def words(self, text: str) -> set[bytes]:
        """The text's distinct words whose terms may be held."""
        if len(self.none) + len(self.term) > 500_000:
            self.none.clear()
            self.term.clear()
        out = set(text.encode().split())
        out -= self.none
        for w in out.difference(self.term):
            t = term(w.decode())
            if t in self.full or t not in self.terms:
                self.none.add(w)
                out.discard(w)
            else:
                self.term[w] = t
        return out

    def of(self, text: str) -> set[str]:
        return set(map(self.term.__getitem__, self.words(text)))

    def drop(self, terms: set[str]) -> None:
        """These terms are not asked for from now on."""
        if terms:
            self.full |= terms
            gone = [w for w, t in self.term.items() if t in terms]
            self.none.update(gone)
            for w in gone:
                del self.term[w]


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches and the texts of their last column, some ``size`` characters at a time; null texts are empty."""
    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, "right")))
            part = batch.slice(at, end - at)
            yield part, [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
            at = end


def mentions(docs: DataFrame) -> DataFrame:
    """``(entities, terms)``, each distinct, of every document with an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches):
            who, told = [], []
            for t in texts:
                spans = find(t)
                if spans:
                    who.append(sorted({entity(k, t[s:e]) for k, s, e in spans}))
                    told.append(sorted({w for w, _, _ in words(t, spans)}))
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.list_(pa.string())), pa.array(told, pa.list_(pa.string()))], ["entities", "terms"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "entities array<string>, terms array<string>")


def term_counts(docs: DataFrame, terms: DataFrame, n: int, most: int) -> DataFrame:
    """``(term, df)``: documents that contain each of ``terms`` (``n`` of them), over all ``docs``.

    Terms of more than ``most`` documents are left out; a task stops counting those that it alone finds in more.
    It gives out its counts when they are ``COUNTED`` terms and at its end.
    """
    maybe = Sketch(terms, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(maybe)
        count: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "df"])

        for _, texts in _chunks(batches):
            for t in texts:
                count.update(known.of(t))
            known.drop({t for t, k in count.items() if k > most} - known.full)
            if len(count) > COUNTED:
                yield counted()
                count.clear()
        yield counted()

    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "term string, df long")
    return seen.groupBy("term").agg(F.sum("df").alias("df")).filter(F.col("df") <= most).join(terms, "term", "left_semi")


def disclosing(docs: DataFrame, share: float = DISCLOSED, prior: float = PRIOR) -> DataFrame:
    """The terms that tell ``share`` of the information of some entity or more."""
    total = max(1, docs.count())
    named = cut_lineage(mentions(docs))
    df_entity = cut_lineage(named.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
                            # df(t, e) is at most df(e), so no term of more documents than this can tell enough
                            .withColumn("most", F.ceil((F.col("df_entity") + F.lit(prior / total) * F.col("df_entity"))
                                                       / F.pow(F.col("df_entity") / F.lit(float(total)), F.lit(1.0 - share)) - F.lit(prior))))
    most = df_entity.agg(F.max("most")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], "term string")
    near = cut_lineage(named.select(F.explode("terms").alias("term")).distinct())
    df_term = cut_lineage(term_counts(docs, near, near.count(), most))
    rare = Sketch(df_term.select("term"), df_term.count())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                who, told = [], []
                for es, ts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if len(known) > 200_000:
                        known.clear()
                    for t in ts:
                        if t not in known:
                            known[t] = t in rare
                    few = [t for t in ts if known[t]]
                    who += [e for e in es for _ in few]
                    told += few * len(es)
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(told, pa.string())], ["entity", "term"])

    both = (named.mapInArrow(pairs, "entity string, term string").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_both"))
            .join(df_term, "term").join(df_entity, "entity").filter(F.col("df") <= F.col("most")))
    ic = F.log2(F.lit(float(total)) / F.col("df_entity"))
    told = ic + F.log2((F.col("df_both") + F.lit(prior / total) * F.col("df_entity")) / (F.col("df") + F.lit(float(prior))))
    return both.filter((ic > 0) & (told >= F.lit(share) * ic)).select("term").distinct()


_FOUND = ("row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
          "maybe array<struct<term:string,start:int,end:int>>")
_MAYBE = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Base spans of every row of ``docs`` and the words that may be one of ``terms``, under a row number of its own."""
    marked = Sketch(terms, terms.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(marked)
        for part, texts in _chunks(batches):
            spans = [find(t) for t in texts]
            base = [joined(x) for x in spans]
            counts = [Counter(k for k, _, _ in x) for x in spans]
            own = [{w.decode() for w in known.words(t)} for t in texts]
            maybe = [[{"term": x, "start": a, "end": b} for x, a, b in words(t, s, w)] if w else []
                     for t, s, w in zip(texts, spans, own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS],
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array(base, pa.string()), pa.array(maybe, _MAYBE)],
                ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "maybe"])

    return (docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(lean(run), _FOUND))


def sanitise(docs: DataFrame, share: float = DISCLOSED, prior: float = PRIOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` joins the base spans (kind:start:end, by kind and start) and then the disclosing
    terms (``term:start:end`` by start); offsets are code points, ends exclusive.  A
    null text counts as empty and has no spans; rows that repeat a doc_id count as documents of their own.
    """
    told = cut_lineage(disclosing(docs, share, prior))
    found = cut_lineage(scan(docs, told))
    places = (found.select("row", F.explode("maybe").alias("x")).select("row", "x.*")
              .join(told, "term", "left_semi")
              .groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("terms")))
    more = F.transform("terms", lambda t: F.concat(F.lit(f"{TERM}:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string")))
    base = F.when(F.col("base") != "", F.array(F.col("base"))).otherwise(F.array().cast("array<string>"))
    return (found.drop("maybe").join(places, "row", "left")
            .select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
                    F.array_join(F.concat(base, F.coalesce(more, F.array().cast("array<string>"))), ",").alias("spans")))


def masked(text: Column, spans: Column) -> Column:
    """A text with its spans generalised or removed.

    Addresses and numbers are generalised to their kind (an ip keeps its first part), terms
    are removed.  Where spans overlap, the longest run of them is replaced once, by the kind
    that starts first.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(texts, marks, strict=True):
            if not t or not m:
                out.append(t)
                continue
            parts, at, last = [], 0, -1
            for s, e, k in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in m.split(","))):
                if s >= last:
                    parts += [t[at:s], "" if k == TERM else f"<{k}>" if k != "ip" else f"{t[s:e].split('.')[0]}.x.x.x"]
                    last = at = e
                else:
                    last = at = max(last, e)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return run(text, spans)
