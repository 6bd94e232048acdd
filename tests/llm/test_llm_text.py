"""Language ID, line dedup, exact dedup, SentencePiece, token counts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import digestindex, langid, lengths, linededup, sptok

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


# ---- language ID

def test_network_equals_plain_convolution():
    rng = np.random.default_rng(1)
    n = 3
    net = langid.Network(["a", "b"], [rng.normal(size=(k, 256, n)).astype(np.float32) for k in langid.WIDTHS],
                         rng.normal(size=9), rng.normal(size=(9, 2)), rng.normal(size=2))
    for f in net.filters:
        f[:, 0, :] = 0
    w, counts = langid.windows([b"Hello there", b"", bytes(range(1, 256)) * 3])
    assert counts.tolist() == [1, 1, 3]
    for row, got in zip(w, net.probabilities(w, net.tables(), batch=2), strict=True):
        x = np.concatenate([row, [0, 0, 0]])
        z = []
        for k, f in zip(langid.WIDTHS, net.filters, strict=True):
            z.append(np.max([sum(f[j][x[i + j]] for j in range(k)) for i in range(langid.WINDOW)], axis=0))
        z = np.maximum(np.concatenate(z) + net.bias, 0) @ net.weights + net.offset
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(got, want, atol=1e-4)


def test_language_held_out_accuracy_and_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = docs.select("doc_id", "lang").join(langid.identify(docs), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) > 100
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    import zlib
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_language_edge_rows(spark):
    words = {"aa": "foo bar baz qux ", "bb": "θέλω να πάω "}
    rows = [(i, words[lang] * 30, lang, "s") for i in range(40) for lang in words]
    rows += [(1000, None, "aa", None), (1001, "", None, "s"), (1002, "123 !!", "bb", "s"), (None, words["bb"], None, "s"),
             (1003, words["aa"] * 20_000, None, "s"), (1003, words["aa"] * 20_000, None, "s")]
    clash = docs_of(spark, rows).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(9)).withColumn("p", F.lit(1))
    got = langid.identify(clash).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "bb" and by[1003].lang_pred == "aa"


def test_language_nothing_to_learn(spark):
    none = docs_of(spark, [(1, "some text", None, "s")])
    assert [tuple(r)[2:] for r in langid.identify(none).collect()] == [("und", 0.0)]
    assert langid.identify(none.limit(0)).count() == 0


# ---- line dedup

def lines_by_hand(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, text, host in rows:
        pages[host] += 1
        for line in set((text or "").split("\n")) if text is not None else ():
            if line.strip(" "):
                seen[host, line] += 1
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (seen[host, x] >= least and seen[host, x] > ratio * pages[host])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, "\n".join(rnd.choice(["menu", "foot", f"body {rnd.randint(0, 60)}", "", " "]) for _ in range(rnd.randint(0, 9))),
             rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "a"), (902, "menu", "solo"), (903, "x" * 100_000 + "\nmenu", "a"), (7, "menu\nmenu", "a"), (7, "menu\nmenu", "a")]
    pages = spark.createDataFrame(rows, "id long, body string, site string").withColumns(
        {"lines": F.lit("own"), "bad": F.lit(1), "host": F.lit("z"), "clean_text": F.lit("c")})
    got = linededup.drop_lines(pages, F.col("site"), F.col("body"), ratio=0.3, min_pages=5)
    names = got.columns
    assert names[:len(pages.columns)] == pages.columns
    got = got.toDF(*[f"c{i}" for i in range(len(names))])
    n = len(pages.columns)
    found = sorted((tuple(r) for r in got.select("c0", f"c{n}", f"c{n + 1}", f"c{n + 2}").collect()), key=str)
    assert found == sorted(lines_by_hand(rows, 0.3, 5), key=str)
    assert linededup.drop_lines(pages.limit(0), F.col("site"), F.col("body")).count() == 0


def test_html_lines_and_hosts(spark):
    html = '<html><script>a<b</script><!-- x --><div class="ad"> One <b>two</b></div>\n<p>three</p></html>'
    row = spark.createDataFrame([(html, "HTTPS://user@WWW.Example.org:80/x?y#z")], "h string, u string").select(
        linededup.html_lines(F.col("h")), linededup.url_host(F.col("u"))).first()
    assert tuple(row) == ("One two\nthree", "www.example.org")


# ---- exact dedup

def test_exact_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None, "", "long " * 50_000, f"t{i}", "A", "a "]), "en", "s") for i in range(400)]
    rows += [(400, "twin", "en", "s"), (400, "twin", "en", "s"), (None, "a", "en", "s"), (None, "only null", "en", "s")]
    docs = docs_of(spark, rows).withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit("x"))
    index = digestindex.fresh_index(spark, buckets=8)
    got = digestindex.dedup(spark, docs, index).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    import hashlib
    want = Counter()
    for i, t, *_ in rows:
        ids = groups[t or ""]
        best = max((x for x in ids if x is not None), default=None)
        want[i, best, len(ids), i is not None and i == best, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert index.rows().count() == len(groups)
    assert digestindex.dedup(spark, docs.limit(0), digestindex.fresh_index(spark, 4)).count() == 0
    index.close()


def test_index_persists_and_appends_new_digests_only(spark):
    index = digestindex.fresh_index(spark, buckets=4)
    first = digestindex.digests(docs_of(spark, [(1, "x", None, None), (2, "y", None, None), (3, "x", None, None)]))
    index.add(first)
    index.add(first)  # a repeated batch adds nothing
    again = digestindex.DigestIndex(spark, index.path.rsplit("/", 1)[0], buckets=4)  # opened anew from its folder
    again.add(digestindex.digests(docs_of(spark, [(9, "x", None, None), (10, "z", None, None)])))
    assert sorted(r.keep_id for r in again.rows().collect()) == [2, 3, 10]
    new = first.groupBy("digest").agg(F.max("doc_id").alias("m")).repartition(4, "digest").join(
        again.rows().select("digest").hint("merge"), "digest", "left_anti")
    assert "SortMergeJoin" in new._jdf.queryExecution().toString()


# ---- SentencePiece

@pytest.fixture(scope="module")
def vocabulary():
    return sptok.Vocabulary()


def tricky():
    rnd = random.Random(4)
    out = ["", " ", "  ", "a  b", " a", "a ", "a\tb\n c", "日本語€😀", "é", "   \n   x  ", "\n\n", " " * 40 + "x", " " * 33,
           "a" * 29, "http://foo.bar/baz?x=1&y=2 ", "İstanbul ﬀ", "x" * 3000, "  一", "a　b", "\x00a", "</s><unk>", "<0x41>"]
    return out + ["".join(rnd.choice("abcdefghij éßñ  ..,\n\t01ü<>") for _ in range(rnd.randint(0, 70))) for _ in range(400)]


def test_sentencepiece_equals_the_public_library(spark, vocabulary):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=sptok.MODEL)
    texts = tricky() + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    ids, sizes = sptok.Encoder(vocabulary).texts(texts)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for t, a, b in zip(texts, ends, ends[1:], strict=False):
        if "\0" not in t:
            assert ids[a:b].tolist() == sp.encode(t), repr(t[:60])
        assert sptok.decode_ids(vocabulary, ids[a:b]) == t


def test_sentencepiece_rows(spark, vocabulary):
    rows = [(i, t, None, None) for i, t in enumerate(tricky())] + [(900, None, None, None), (None, "x", None, None), (1, "twice", None, None),
                                                                  (1, "twice", None, None), (901, "y" * 30_000, None, None)]
    docs = docs_of(spark, rows).withColumn("ids", F.lit("clash"))
    coded = sptok.encode(docs, vocabulary)
    got = coded.collect()
    assert len(got) == len(rows) and all(r.round_trip and len(r.ids) == r.n_tokens for r in got)
    back = Counter((r.doc_id, r.text) for r in sptok.decode(coded, vocabulary).collect())
    assert back == Counter((i, t or "") for i, t, *_ in rows)
    assert sptok.encode(docs.limit(0), vocabulary).count() == 0


def test_vocabulary_without_that_sign_round_trips_only_blanks(vocabulary):
    ids, _ = sptok.Encoder(vocabulary).texts(["a" + sptok.SPACE + "b"])
    assert sptok.decode_ids(vocabulary, ids) == "a b"


# ---- token counts

def test_token_counts_equal_brute_force(spark):
    import tiktoken
    with open(lengths.RANKS, "rb") as f:
        code = tiktoken.Encoding("t", pat_str=lengths.PATTERN, mergeable_ranks=lengths.read_ranks(f.read()), special_tokens={})
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", "<|endoftext|>", "word " * 30_000, "word", "word"]
    docs = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)]).withColumn("n_tokens", F.lit("clash"))
    got = lengths.token_counts(docs).cache()
    n = [len(code.encode_ordinary(t)) if t else 0 for t in texts]
    rows = {r.n_tokens: r for r in got.collect()}
    assert set(rows) == set(n)
    for limit, r in rows.items():
        assert r.docs == n.count(limit)
        assert r.docs_over == sum(x > limit for x in n) and r.tokens_over == sum(x for x in n if x > limit)
        assert (r.total_docs, r.total_tokens) == (len(n), sum(n))
        assert r.truncated_total == sum(min(x, limit) for x in n)
    asked = [0, 1, 7, 100, 1024, 10**6]
    cut = {r.limit: r.truncated_total for r in lengths.truncated_totals(got, asked).collect()}
    assert cut == {a: sum(min(x, a) for x in n) for a in asked}
    q = {r.share: r.n_tokens for r in lengths.quantiles(got, [0.5, 0.9, 1.0]).collect()}
    assert q == {s: sorted(n)[int(np.ceil(s * len(n))) - 1] for s in (0.5, 0.9, 1.0)}
    assert lengths.token_counts(docs.limit(0)).count() == 0


def test_words_of_earlier_texts_are_not_encoded_again(vocabulary, monkeypatch):
    texts = ["the cat  sat", "the   cat é漢 sat", "", "a cat\nsat  "]
    alone = [sptok.Encoder(vocabulary).texts([t])[0].tolist() for t in texts]
    encoder, met = sptok.Encoder(vocabulary), []
    words = encoder.words
    monkeypatch.setattr(encoder, "words", lambda w: met.extend(w) or words(w))
    for _ in range(2):
        assert [encoder.texts([t])[0].tolist() for t in texts] == alone
    assert met.count(sptok.SPACE + "the") == 1 and met.count(sptok.SPACE + "a") == 1
    monkeypatch.setattr(sptok, "KEPT_CHARS", 0)
    assert [encoder.texts([t])[0].tolist() for t in texts] == alone and encoder.kept <= max(map(len, texts)) + len(texts)
