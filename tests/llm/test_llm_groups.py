"""Jaccard join, embedding near-dedup, mixing, chat, sanitisation."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, imi, jaccard, mixing, queries, sanitise, sql
from graphloom.llm.common import connected

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_connected_paths_stars_and_loners(spark):
    rnd = random.Random(1)
    path = list(range(100, 160))
    rnd.shuffle(path)
    links = list(zip(path, path[1:])) + [(1, x) for x in range(2, 30)] + [(500, 501), (501, 500), (502, 502)]
    nodes = list(range(0, 30)) + path + [500, 501, 502, 503]
    got = connected(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == components(nodes, links)
    none = connected(spark.createDataFrame([(4,)], "node long"), spark.createDataFrame([], "a long, b long"))
    assert [tuple(r) for r in none.collect()] == [(4, 4)]


# ---- Jaccard join

def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def jaccard_by_hand(rows, words, percent):
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    links = []
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                links.append((i, j))
    part = components([i for i, _ in sets if i is not None], links)
    return Counter((i, len(s), part.get(i)) for i, s in sets)


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, words, percent):
    rnd = random.Random(words)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    rows = []
    for g in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([5, 30, 80, 200]))]
        for _ in range(rnd.randint(1, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            if rnd.random() < 0.2:
                own = own[:rnd.randint(1, len(own))]
            text = " ".join(own)
            rows.append((len(rows), passage + " " + text if rnd.random() < 0.3 else text.upper() if rnd.random() < 0.1 else text))
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " \n\t", "one", "ONE", "one two", "one two three", "One  two\nthree", "é É", "a " * 5000, "A " * 4000])]
    rows += [(2000, "same id here now and more"), (2000, "quite another text of this id"), (2001, "quite another text of this id"),
             (None, "one"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "token": F.lit(1), "rep": F.lit(2)})
    got = Counter(tuple(r) for r in jaccard.jaccard_groups(docs, words, percent).collect())
    assert got == jaccard_by_hand(rows, words, percent)
    assert jaccard.jaccard_groups(docs.limit(0), words, percent).count() == 0


def test_filters_lose_no_pair(spark):
    """Every linked pair of classes passes prefix filters of all orders."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rnd.randint(0, 5)):
            own[rnd.randrange(120)] = f"x{rnd.randint(0, 50)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = jaccard.profiles(docs, jaccard.rarity(jaccard.survey(docs, 4)), 4, 85)
    common = jaccard.shared(jaccard.postings(reps)).withColumn("part", F.col("doc"))
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in jaccard.cross_pairs(common, 85).collect()}
    near = {(min(r.a, r.b), max(r.a, r.b)) for r in jaccard.star_pairs(common, 85).collect()}
    assert near and near <= found
    sets = {i: shingle_set(t, 4) for i, t in rows}
    for i in sets:
        for j in range(i):
            if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                assert (j, i) in found


# ---- embeddings

def vectors_by_hand(rows, threshold=0.93):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    links = Counter()
    pairs = []
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    part = components(range(len(rows)), pairs)
    least = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        least[part[k]].append(i)
    out = Counter()
    for k, (i, _, _) in enumerate(rows):
        c = i if k not in good else min(least[part[k]])
        out[i, links[k], c, i is not None and i == c] += 1
    return out


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(30):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.12], int(g % 3)))
    rows += [(len(rows) + k, rows[k % 5][1], rows[k % 5][2]) for k in range(40)]  # copies
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, [float("inf")] * 16, 1),
             (n + 5, rows[0][1], None), (n + 6, rows[0][1][:8], rows[0][2]), (n + 7, [], 1), (None, rows[0][1], 0), (n + 8, rows[1][1], 2)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {"node": F.lit("x"), "cell": F.lit(1), "copies": F.lit(None).cast("string")})
    got = Counter(tuple(r) for r in imi.near_dedup(t).collect())
    assert got == vectors_by_hand(rows)
    assert imi.near_dedup(t.limit(0)).count() == 0


def test_embeddings_recall_and_blocks(spark, monkeypatch):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    want = vectors_by_hand(rows)
    monkeypatch.setattr(imi, "BLOCK", 16)  # many blocks a cell
    got = Counter(tuple(r) for r in imi.near_dedup(t).collect())
    links = lambda c: sum(r[1] * k for r, k in c.items())
    assert links(got) >= 0.9 * links(want) and sum((got - want).values()) <= 0.02 * len(rows)


def test_rare_near_copies_are_found(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12_000, 32))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    noise = rng.normal(size=(40, 32))
    noise -= (noise * x[:40]).sum(axis=1)[:, None] * x[:40]
    noise /= np.sqrt((noise * noise).sum(axis=1))[:, None]
    near = 0.94 * x[:40] + np.sqrt(1 - 0.94 ** 2) * noise
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, near]))]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in imi.near_dedup(t).collect()}
    # fewer than one vector in 256 has a link, so next to no probe has one
    assert sum(got[12_000 + i].component_id == i for i in range(40)) >= 38
    classes = imi.vectors(t).withColumn("node", F.col("vec_id"))
    grids = imi.fit(classes, len(rows))
    cells, recall = imi.visits_needed(classes, grids, len(rows))
    assert cells > imi.MIN_CELLS and 0.99 <= recall <= 1
    none, unknown = imi.visits_needed(classes.limit(0), {}, 0)
    assert np.isnan(unknown)


def test_exact_where_the_cells_do_not_reach_the_recall(spark, monkeypatch, caplog):
    monkeypatch.setattr(imi, "MAX_CELLS", 1)
    monkeypatch.setattr(imi, "MIN_CELLS", 1)
    monkeypatch.setattr(imi, "BLOCK", 64)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base + rng.normal(size=(300, 16)) * 0.3])
    rows = [(i, [float(np.float32(c)) for c in v], i % 2) for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    with caplog.at_level("WARNING", logger=imi.__name__):
        assert Counter(tuple(r) for r in imi.near_dedup(t).collect()) == vectors_by_hand(rows)
    assert "below 0.99" in caplog.text


def test_multi_sequence_order_is_exact():
    rng = np.random.default_rng(2)
    grid = imi.Grid(rng.normal(size=(300, 8)), 12)
    x = rng.normal(size=(20, 8))
    cells, d = grid.nearest(x, 10)
    a, b = grid.distances(x)
    for k in range(20):
        every = np.sort((a[k][:, None] + b[k][None, :]).ravel())
        assert np.allclose(d[k], every[:10])
        assert cells[k, 0] == grid.cells(x[k:k + 1])[0]


# ---- mixing

def mix_rows():
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 40, 300])), None, rnd.choice(["b", "a", "a", "a", "ä", "Z", None]), None) for i in range(500)]
    return rows + [(900, None, None, "a", None), (901, "x " * 50_000, None, "huge", None), (902, "", None, "empty", None), (None, "x y", None, "b", None),
                   (3, "again and again", None, "a", None), (3, "again and again", None, "a", None)]


def test_mix_meets_its_targets(spark):
    docs = spark.createDataFrame(mix_rows(), DOCS).withColumns({"src": F.lit(1), "h": F.lit("x"), "full": F.lit(2), "row": F.lit(0)})
    got = mixing.mix(docs).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(tuple(r) for r in mixing.mix(docs).collect() if r.doc_id is not None)
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    want = {}
    for r in got:
        key = r.target, r.source_size
        by[key][0] += r.taken
        by[key][2] = max(by[key][2], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    for (target, size), (taken, _, most, _) in by.items():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= most
    names = sorted({s for *_, s, _ in mix_rows() if s is not None}) + [None]
    for k, s in enumerate(names):
        want[s] = (sum(len((t or "").split()) for _, t, _, x, _ in mix_rows() if x == s), (5, 2, 1)[k % 3])
    total = 1.5 * sum(n for n, _ in want.values())
    capped = set()
    while True:  # the rule by hand
        rate = (total - sum(2 * want[s][0] for s in capped)) / max(1, sum(w for s, (_, w) in want.items() if s not in capped))
        more = {s for s, (n, w) in want.items() if s not in capped and rate * w > 2 * n}
        if not more:
            break
        capped |= more
    hand = sorted((min(2.0 * n, rate * w), n) for n, w in want.values())
    assert np.allclose(hand, sorted(by), rtol=1e-12)
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    words = whole.select(F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"))))).first()[0]
    assert words == sum(r.taken for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_mix_sql_on_odd_rows(spark):
    docs = spark.createDataFrame(mix_rows(), DOCS)
    documents = docs.toArrow()  # noqa: F841
    want = Counter(map(str, duckdb.sql(sql.OP8).fetchall()))
    got = Counter(str((r.doc_id, r["size"], r.source_size, r.target, r.taken)) for r in mixing.mix(docs).collect())
    assert got == want


# ---- chat

def test_chat_reads_back(spark):
    rnd = random.Random(6)
    marks = ["</s>", "<s>[INST]", "[/INST]", "[SEP]", "\\", "<", "[", "<\\", "[\\\\", "\n", "é😀", "ok ", "", "$1"]
    rows = []
    for c in range(60):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", "assistant", "system", None, "o</s>dd"]),
                         "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 6))) if rnd.random() < 0.9 else None))
    rows += [(70, 0, "user", "same"), (70, 0, "user", "same"), (71, 1, "assistant", "x" * 200_000), (None, 3, "user", "lost"), (72, 5, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"t": F.lit(1), "ts": F.lit("x"), "blocks": F.lit(0), "formatted": F.lit("f")})
    made = chat.format_chat(table)
    text = {r.conv_id: r for r in made.collect()}
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(by) == set(got)
    for c, turns in by.items():
        turns.sort()
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        want = (c, len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text[c].formatted))
        assert tuple(got[c]) == want
        runs = 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
        assert text[c].formatted.count("</s>") == runs  # merged turns share a block, and texts hold no mark
        assert len(text[c].loss_spans) == sum(r == "assistant" for *_, r, _ in turns)
    assert chat.digests(chat.format_chat(table.limit(0))).count() == 0


# ---- sanitisation

def spans_by_hand(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(7)
    for _ in range(20_000):
        t = "".join(rnd.choice("ab.@-+ 012345(%") for _ in range(rnd.randint(0, 40)))
        assert sanitise.find(t) == spans_by_hand(t), t
    for t in ("4111 1111 1111 1111", "x 4111-1111-1111-1111 y", "+1 (212) 555-0199", "a@b.c@d.e", "é a.b@c-d.org.", "001.002.255.256", "1.2.3.4.5.6.7.8"):
        assert sanitise.find(t) == spans_by_hand(t)
    assert sanitise.find("a" * 300_000 + " " + "1" * 300_000 + "@" * 1000) == []


def test_sanitise_adds_disclosing_terms_and_keeps_base_spans(spark):
    rows = [(i, f"the agent Zorblatt wrote from z@corp.org about the plan {i}", None, None, None) for i in range(5)]
    rows += [(10 + i, f"the plan of day {i} is about the weather", None, None, None) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "call +1 212 555 0199 or 10.0.0.1", None, None, None),
             (103, "w " * 100_000 + "q@x.yz", None, None, None), (0, rows[0][1], None, None, None), (None, "lone@mail.net", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit("x"), "base": F.lit(1), "spans": F.lit(0)})
    got = sanitise.sanitise(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, *_ in rows:
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans_by_hand(t or ""))
        want[i, hashlib.sha256(base.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans_by_hand(next(t for i, t, *_ in rows if i == r.doc_id) or ""))
        assert r.spans.startswith(base)
        if r.doc_id in range(5):
            words = {rows[r.doc_id][1][int(s):int(e)] for k, s, e in (x.split(":") for x in r.spans.split(",")) if k == "term"}
            assert "Zorblatt" in words and not words & {"the", "plan", "about"}
        if r.doc_id in range(10, 50):
            assert r.spans == ""
    both = docs.select("doc_id", "text").join(sanitise.sanitise(docs).select("doc_id", "spans"), "doc_id")
    text = {r.doc_id: r.m for r in both.select("doc_id", sanitise.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert "Zorblatt" not in text[1] and "z@corp.org" not in text[1] and "<email>" in text[1] and "the plan 1" in text[1]
    assert text[102] == "call <phone> or 10.x.x.x"
    assert sanitise.sanitise(docs.limit(0)).count() == 0


def term_words(docs, rows):
    """Words marked as terms, by doc_id."""
    text = {i: t or "" for i, t, *_ in rows}
    return {r.doc_id: {text[r.doc_id][int(s):int(e)] for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
            for r in sanitise.sanitise(docs).select("doc_id", "spans").collect()}


def test_terms_tell_entities_of_one_or_two_documents(spark):
    rows = [(i, f"the plan of day {i} is about the weather", None, None, None) for i in range(2000)]
    rows += [(5000, "the plan of Zorblatt is with z@corp.org about the weather", None, None, None)]
    rows += [(5001 + i, f"the plan of Quimby is call +1 212 555 0199 about day {i}", None, None, None) for i in range(2)]
    got = term_words(spark.createDataFrame(rows, DOCS), rows)
    assert got[5000] == {"Zorblatt", "with"} and got[5001] == got[5002] == {"Quimby", "call"}
    assert not any(got[i] for i in range(2000))


def disclosing_by_hand(rows):
    """Every term's share of every entity's information, over whole documents."""
    who, own = [], []
    for _, t, *_ in rows:
        t = t or ""
        spans = spans_by_hand(t)
        who.append({sanitise.entity(k, t[s:e]) for k, s, e in spans})
        own.append({sanitise.term(m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)
                    if not any(s < m.end() and m.start() < e for _, s, e in spans)})
    n, df_e, df_t = len(rows), Counter(e for x in who for e in x), Counter(t for x in own for t in x)
    both = Counter((e, t) for x, y in zip(who, own) for e in x for t in y)
    return {t for (e, t), k in both.items() if df_e[e] < n and any(c.isalpha() for c in t)
            and np.log2((k + df_e[e] / n) / (df_t[t] + 1) * n / df_e[e]) >= 0.9 * np.log2(n / df_e[e])}


def test_terms_far_from_a_mention_and_in_other_documents(spark):
    day = "the plan of day is about the weather "
    rows = [(i, day, None, None, None) for i in range(300)]
    rows += [(1000 + i, f"Zorblatt {day * 5}wrote from z@corp.org {day * 5}Quimby", None, None, None) for i in range(6)]
    rows += [(2000, f"{day}by Zorblatt", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = term_words(docs, rows)
    assert all(got[1000 + i] == {"Zorblatt", "wrote", "from", "Quimby"} for i in range(6))
    assert got[2000] == {"Zorblatt"} and not any(got[i] for i in range(300))


def test_terms_equal_plain_counts(spark):
    rnd = random.Random(3)
    names = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    rows = []
    for i in range(1500):
        text = [rnd.choice(names[:1 + int(400 * rnd.random() ** 2)]) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.1:
            text.insert(rnd.randint(0, len(text)), rnd.choice(["a@b.cd", "10.0.0.1", "(x@y.zz)", f"u{i}@b.cd", f"+1 212 555 0{rnd.randint(100, 130)}"]))
            text.append(rnd.choice(["Odd", "odd,", "rare" + str(i), "few" + chr(97 + i % 20)]))
        rows.append((i, " ".join(text), None, None, None))
    got = term_words(spark.createDataFrame(rows, DOCS).repartition(5), rows)
    want = disclosing_by_hand(rows)
    for i, t, *_ in rows:
        spans = spans_by_hand(t)
        assert got[i] == {m[0] for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if sanitise.term(m[0]) in want
                          and not any(s < m.end() and m.start() < e for _, s, e in spans)}
    assert want


def test_words_are_parted_by_ascii_blanks_in_every_count(spark):
    rows = [(i, f"le plan du jour {i}", None, None, None) for i in range(1100)]
    rows += [(2000, "le plan de Zor\u00a0blatt est a@b.cd\x0bQuim\x1cby le jour", None, None, None)]
    assert term_words(spark.createDataFrame(rows, DOCS), rows)[2000] == {"Zor\u00a0blatt", "Quim\x1cby", "de", "est"}


# ---- SQL and entry

@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(str(tuple(r)) for r in got.select(*columns).collect()) == Counter(str(r) for r in want.fetchall())


def test_queries_are_registered():
    import __spark_entry__
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(found) and "pipeline" in found
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 11))


def test_one_very_long_conversation(spark):
    """50,000 turns: places and read-back texts do not take the square of the turns."""
    import time
    n = 50_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.lit("t\u00e9xt <b> "), F.col("id").cast("string")).alias("text"))
    start = time.time()
    got = chat.digests(chat.format_chat(rows)).first()
    assert time.time() - start < 60
    texts = [f"t\u00e9xt <b> {i}" for i in range(n)]
    loss = "".join(t for i, t in enumerate(texts) if i % 3)
    turns = "".join(f"{'assistant' if i % 3 else 'user'}\n{t}\n" for i, t in enumerate(texts))
    assert (got.n_turns, got.loss_chars) == (n, len(loss))
    assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()


def test_words_are_asked_for_once_and_only_where_marked():
    class Asked:
        n = 0

        def __contains__(self, t):
            self.n += 1
            return t != "none"

    known = sanitise.Known(Asked())
    assert known.of("Ann, (ann) none bob") == {"ann", "bob"} and known.of("none bob Ann,") == {"ann", "bob"}
    assert known.terms.n == 4  # each word as it stands, once
    known.drop({"ann"})
    assert known.words("Ann, bob (ann) ann none") == {b"bob"}
    assert list(sanitise.words("bob Ann, bob x@y.z", [("email", 13, 18)], {"bob", "x@y.z"})) == [("bob", 0, 3), ("bob", 9, 12)]


def test_term_counts_cross_the_parts_of_a_task(spark, monkeypatch):
    rows = [(i, f"often{i % 2} word{i} " + "x" * 50) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    terms = docs.selectExpr("explode(split(text, ' ')) term").distinct()
    for size in (1, 100_000):
        monkeypatch.setattr(sanitise, "COUNTED", size)
        got = {r.term: r.df for r in sanitise.term_counts(docs, terms, 303, 150).collect()}
        assert got == {f"word{i}": 1 for i in range(300)} | {"often0": 150, "often1": 150}


def test_numbers_side_by_side_are_found():
    for t in ("1.2.3.4 4111 1111 1111 1111", "12 4111-1111-1111-1111 5.6.7.8-9.9.9.9", "1.2.3.4.4111111111111111 1-2.3.4.5", "1.2.3.4\n5.6.7.8 . 9.9.9.9"):
        assert sanitise.find(t) == spans_by_hand(t), t


def test_jaccard_drops_tables_it_has_read(spark, monkeypatch):
    """When the pairs are made, only the documents, their classes and the shared postings are still on disk."""
    import os

    from graphloom.session import ensure_checkpoint_dir
    folder = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "graphloom-tables")
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    at_pairs, star_links = [], jaccard.star_links
    monkeypatch.setattr(jaccard, "star_links", lambda *a: at_pairs.append(tables()) or star_links(*a))
    before = tables()
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:59], "x"])), (4, "a b c d e")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert len(at_pairs[0] - before) <= 3
