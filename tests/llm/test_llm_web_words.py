"""URL filter, spelling variants, phrase mining."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import collocations, queries, sql, urltrie, variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, 0) for i, t, lang in rows], DOCS)


# ---- URL filter

RULES = [(h, p, v) for h, p, v in queries.URL_RULES] + [
    ("", "/robots", "block"), ("a.b", "", "block"), ("a.b", "", "allow"), ("A.B", "/x/y", "allow"), (None, "/n", "allow"),
    ("a.b", "/x/", "block"), ("c", None, "block"), ("very.deep.c", "/1/2/3/", "allow"), ("c", "/1/2/", "allow")]


def plain_verdict(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0].translate(LOWER)
        path = re.match("[^?#]*", rest[len(re.match("[^/?#]*", rest)[0]):])[0]
    fits = []
    for h, p, v in rules:
        h, p = (h or "").translate(LOWER), p or ""
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h), len(p), v == "block", h + p, v))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def url_rows():
    rnd = random.Random(5)
    urls = [None, "", "no scheme", "://", "http://", "x://COM", "http://com/", "http://example.com", "http://example.com/en",
            "http://example.com/en/1?q=http://net/es/", "http://WWW.Example.COM/en/", "http://a.www.example.com/en/x#y", "s://net/es/",
            "s://net/es", "s://a.net/fr/?", "s://.net/fr/", "s://xnet/fr/", "s://a.b", "s://a.b/x/y/z", "s://a.b/x/yy", "s://a.b/x//y",
            "s://q/robots.txt", "s://very.deep.c/1/2/3/4", "s://very.deep.c/1/2/3", "s://c/1/2", "s://é.c/ü/", "s://c\nd/1", "x:y://u@net:80/es/",
            "s://" + "l." * 2000 + "com/" + "p/" * 3000, "s://com." + "/" * 50]
    urls += ["s://" + ".".join(rnd.choices(["a", "b", "c", "net", "com", "example", "www"], k=rnd.randint(1, 4)))
             + rnd.choice(["", "/", "/en/", "/es/", "/x/y", "/1/2/3/4"]) for _ in range(300)]
    return list(enumerate(urls)) + [(0, "s://a.b/"), (None, "s://a.b/"), (7, "s://c/1/2/"), (7, "s://c/1/2/")]


@pytest.mark.parametrize("limit,default", [(urltrie.RULE_BYTES, "allow"), (0, "block")])
def test_url_filter_equals_plain_search(spark, limit, default):
    rows = url_rows()
    pages = (spark.createDataFrame(rows, "page_id long, url string")
             .withColumns({"host": F.lit(1), "rule": F.lit("x"), "verdict": F.lit(2.0), "path": F.lit(None).cast("string")}))
    rules = spark.createDataFrame([(*r, "extra") for r in RULES], "host string, path string, verdict string, rule string")
    got = Counter(map(tuple, urltrie.filter_urls(pages, rules, default, limit).collect()))
    assert got == Counter((i, *plain_verdict(u, RULES, default)) for i, u in rows)


def test_url_filter_empty_tables_and_bad_rules(spark):
    pages = spark.createDataFrame([(1, "s://a/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urltrie.filter_urls(pages, none).collect()] == [(1, "a", "/", None, "allow")]
    assert urltrie.filter_urls(pages.limit(0), none).count() == 0
    for verdict in ("ALLOW", None):
        with pytest.raises(ValueError):
            urltrie.filter_urls(pages, spark.createDataFrame([("a", "/", verdict)], none.schema))


def test_url_query_equals_plain_search(spark):
    got = queries.op11_url_filter(spark, "/root/testdata/sf0.01").collect()
    urls = duckdb.sql("SELECT page_id, url FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert Counter(map(tuple, got)) == Counter((i, *plain_verdict(u, queries.URL_RULES, "allow")) for i, u in urls)


# ---- spelling variants

def plain_counts(rows, every):
    total = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return total


def plain_variants(counts, min_length=5, min_count=3):
    n = {w: c for w, c in counts.items() if len(w) >= min_length and c >= min_count}
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)   # a letter replaced
        for i in range(len(w)):
            if w[:i] + w[i + 1:] in n:       # a letter more
                holes[w, "longer", w[:i] + w[i + 1:]] |= {w, w[:i] + w[i + 1:]}
    near = defaultdict(set)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return out


def as_set(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def word_rows(seed=3):
    """Dense words of few letters: many near ones, ties, doubled letters, common beginnings and ends."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choices("ab", k=rnd.randint(4, 9))) for _ in range(400)}
    words |= {"prefix" + "".join(rnd.choices("abcé", k=rnd.randint(0, 5))) for _ in range(300)}
    words |= {"".join(rnd.choices("xyÿ", k=rnd.randint(1, 4))) + "suffix" for _ in range(100)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1500}
    return [(w, rnd.choice([1, 2, 3, 3, 4, 6, 9, 20, 200])) for w in sorted(words)]


@pytest.mark.parametrize("group", [variants.GROUP, 3])
def test_variants_equal_brute_force(spark, group):
    rows = word_rows()
    got = variants.group_variants(spark.createDataFrame(rows, "word string, n long"), group=group)
    assert as_set(got) == plain_variants(dict(rows))


def test_variants_block_larger_than_states(spark, monkeypatch):
    monkeypatch.setattr(variants, "STATE", 8)
    monkeypatch.setattr(variants, "BLOCK", 100_000)
    rows = word_rows(4)
    index = variants.Index([w for w, _ in rows if len(w) in (6, 7)], 6, 0, 0)
    assert index.width > 1
    assert as_set(variants.group_variants(spark.createDataFrame(rows, "word string, n long"))) == plain_variants(dict(rows))


def test_variants_edge_rows(spark):
    rows = [("größe", 3), ("große", 5), ("große", 2), (None, 9), ("", 50), ("abcd", 99), ("abcde", 2), ("groß", 10), ("größer", 3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "word string, n long, root long, form string")
    want = {("größe", "große", "große", 3, 2, 7), ("große", None, "große", 7, 1, None), ("größer", None, "größer", 3, 1, None)}
    assert as_set(variants.group_variants(df)) == want
    assert variants.group_variants(df.limit(0)).count() == 0


def test_variant_chain_of_forms(spark):
    words = ["aaaaa" + "b" * i for i in range(12)]
    rows = [(w, 3 * 2 ** i) for i, w in enumerate(words)]
    got = {r.word: r.root for r in variants.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1]} and len(got) == 12


def test_run_counts_and_lost_letters(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices(["Straße", "ÉTÉ", "a", "x1y", "don't", "naïve", "×÷", "日本", "ĀB"], k=40)), None) for i in range(60)]
    rows += [(None, "null id", "l"), (5, None, None), (6, "", None), (7, "Word " * 5000 + "w" * 5000, None), (7, "again again", None),
             (8, "x" * (2 << 20) + " " + "tail of it", None)]
    for every in (0, 3):
        got = variants.word_counts(docs_of(spark, rows).withColumn("word", F.lit("c")).withColumn("n", F.lit("c")), every)
        assert {r.word: r.n for r in got.collect()} == dict(plain_counts(rows, every))
    assert variants.word_counts(docs_of(spark, rows[:0]), 97).count() == 0


def test_variant_query_equals_brute_force(spark):
    got = as_set(queries.op12_spelling_variants(spark, "/root/testdata/sf0.01"))
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    assert got == plain_variants(plain_counts(rows, 97)) and any(r[1] for r in got)


# ---- phrase mining

def plain_phrases(rows, longest=3, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][words[i:i + k]] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in cand.items()):
                continue
            score, _, l, r = min((10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), l, r))
        for rank, (s, a, _, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p, -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_rows():
    rnd = random.Random(11)
    vocabulary = ["New", "york", "city", "of", "é", "\U0001f600", "\ufb01", "x-y", "\u00a0", "a\x1cb", "the"]
    rows = []
    for i in range(120):
        text = "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in range(rnd.randint(0, 60)))
        rows.append((i, text, rnd.choice(["en", "fr", None, "und", ""])))
    return rows + [(5, "new york city " * 30, "en"), (5, "new york city " * 30, "en"), (None, "w" * 300 + " end " + "w" * 300, "de"),
                   (7, None, "en"), (8, "", None), (9, ("w" * 200 + " of the ") * 20, "de"), (10, "lone", "xx")]


def run_phrases(spark, rows, **how):
    df = docs_of(spark, rows).withColumn("phrase", F.lit(1)).withColumn("n", F.lit("c"))
    return sorted(map(tuple, collocations.top_phrases(df, **how).collect()))


@pytest.mark.parametrize("how", [{"longest": 2, "least": 3, "top": 3}, {"longest": 4, "least": 4, "percent": 80}])
def test_phrases_equal_brute_force(spark, how):
    assert run_phrases(spark, phrase_rows(), **how) == plain_phrases(phrase_rows(), **how)


def test_phrases_over_small_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 7)
    monkeypatch.setattr(collocations, "PART", 40)
    monkeypatch.setattr(collocations, "SHARE", 5)
    assert run_phrases(spark, phrase_rows()) == plain_phrases(phrase_rows())


def test_shared_word_ids_are_noticed(spark, monkeypatch):
    plain = collocations.Part.ids

    def ids(self, langs, seed):
        return plain(self, langs, seed) & (collocations._U(7) if seed == 1 else ~collocations._U(0))
    monkeypatch.setattr(collocations.Part, "ids", ids)
    assert run_phrases(spark, phrase_rows()) == plain_phrases(phrase_rows())


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    counts = {1: spark.createDataFrame([(1, 2 * big), (2, big + 1)], "w1 long, f long"),
              2: spark.createDataFrame([(1, 2, big)], "w1 long, w2 long, f long")}
    c = collocations._best_cut(counts, 2).first().c
    assert (c.score, c.l, c.r) == (10 ** 6 * big * big // (2 * big * (big + 1)), 2 * big, big + 1)


def test_phrases_of_empty_table(spark):
    assert run_phrases(spark, []) == [] and run_phrases(spark, [(1, "one two", "en")]) == []


@pytest.mark.parametrize("name", ["op11_url_filter", "op13_phrase_mining"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    rel = con.execute(sql.ORACLE[name])
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [d[0] for d in rel.description] == df.columns
    assert Counter(rel.fetchall()) == Counter(map(tuple, df.collect()))
