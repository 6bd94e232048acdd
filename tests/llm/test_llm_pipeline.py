"""The corpus pipeline, stage by stage."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from graphloom.llm import sptok

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    vocab = {"en": [f"the{i}" for i in range(200)], "xx": [f"ñandú{i}" for i in range(200)]}
    out = []
    for i in range(160):
        lang = rnd.choice(["en", "xx"])
        body = [" ".join(rnd.choice(vocab[lang]) for _ in range(12)) for _ in range(rnd.randint(1, 5))]
        out.append((i, "\n".join(["site menu line", *body]), lang if rnd.random() < 0.9 else None, rnd.choice(["a", "b", None])))
    out += [(200 + k, out[k][1] + (" tail" if k % 2 and len(out[k][1].split()) > 40 else ""), out[k][2], out[k][3]) for k in range(20)]
    out += [(300, None, "en", "a"), (301, "", "en", "a"), (302, "12 34 !!", "en", "b")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS).withColumn("extra", F.lit("e"))


def test_stages(spark, rows):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "sentencepiece"]
    docs = frame(spark, rows)
    a = pipeline.cut_lineage(pipeline.language_id(spark, docs, ""))
    assert a.columns == docs.columns
    assert {r.doc_id for r in a.collect()} == {i for i, *_ in rows} - {300, 301, 302}
    assert a.filter("lang IS NULL").count() == 0
    b = pipeline.cut_lineage(pipeline.line_dedup(spark, a, ""))
    assert b.columns == docs.columns and b.count() == a.count()
    texts = {r.doc_id: r for r in b.collect()}
    assert all("site menu line" not in r.text and r.n_chars == len(r.text) for r in texts.values())
    c = pipeline.cut_lineage(pipeline.near_dedup(spark, b, ""))
    assert c.columns == docs.columns

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in texts:
        for j in texts:
            x, y = grams(texts[i].text), grams(texts[j].text)
            if i < j and x and 100 * len(x & y) >= 80 * len(x | y):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    assert {r.doc_id for r in c.collect()} == {i for i in texts if top(i) == i}
    d = pipeline.cut_lineage(pipeline.mix_sources(spark, c, ""))
    assert d.columns == docs.columns
    assert max(Counter(r.doc_id for r in d.collect()).values()) <= 2
    e = pipeline.sentencepiece(spark, d, "")
    assert Counter(r.doc_id for r in e.collect()) == Counter(r.doc_id for r in d.collect())
    back = {r.doc_id: r.text for r in sptok.decode(e).collect()}
    assert all(back[r.doc_id] == r.text for r in d.collect())


def test_stages_take_empty_tables(spark, rows):
    none = frame(spark, rows).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_run(spark):
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "round_trip", "ids"] and got.filter("NOT round_trip").count() == 0
