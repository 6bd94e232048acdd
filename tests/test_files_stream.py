import os
import tempfile
import time

import pytest

from graphloom.sources.extractors import extract_files, register_extractor
from graphloom.sources.files import run_extractors
from graphloom.streaming.files import (compact, current_chunks, current_edges, current_files, drop_old_generations, run_file_stream)


def make_words():
    # a nested function is sent to the workers by value
    def words(path, text):
        """A chunk per word, which belongs to its file; the word BAD is an error."""
        if "BAD" in text:
            raise ValueError("bad word")
        edge = {"target": path, "type": "IN", "confidence": "deterministic", "evidence": ""}
        return [{"chunk_type": "word", "name": w, "raw_cleaned": w.upper(), "edges": [edge]} for w in text.split()]
    return words


words = make_words()


def put(root, drop, files):
    for path, content in files.items():
        p = os.path.join(root, drop, path)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def stream(spark):
    root, sink = tempfile.mkdtemp(prefix="gl-drops-"), tempfile.mkdtemp(prefix="gl-store-")
    calls = []

    def extract(files):
        calls.append(sorted(r.path for r in files.select("path").collect()))
        return run_extractors(files, {"txt": words, "md": words})
    return root, sink, calls, lambda **kw: run_file_stream(spark, root, sink, extract, **kw)


def state(spark, sink):
    chunks = {(r.path, r.name or r.error_class) for r in current_chunks(spark, sink).collect()}
    edges = sorted((r.path, r.target_node_id) for r in current_edges(spark, sink).collect())
    assert len(edges) == len([c for c in chunks if c[1] not in ("ValueError",)])
    return chunks


def test_add_change_delete_revert(spark, stream):
    root, sink, calls, run = stream
    put(root, "d1", {"a.txt": "one two", "sub/b.txt": "three", "c.md": "four", "no.xyz": "skip me"})
    assert run(max_files_per_trigger=2) == 2
    assert state(spark, sink) == {("a.txt", "one"), ("a.txt", "two"), ("sub/b.txt", "three"), ("c.md", "four")}
    put(root, "d2", {"a.txt": "one five", "c.md": "four"})
    run()
    assert state(spark, sink) == {("a.txt", "one"), ("a.txt", "five"), ("sub/b.txt", "three"), ("c.md", "four")}
    assert calls[-1] == ["a.txt"]  # c.md did not change
    put(root, "d4", {"a.txt": "one two", "sub/b.txt.deleted": "x"})
    run()
    assert state(spark, sink) == {("a.txt", "one"), ("a.txt", "two"), ("c.md", "four")}
    assert calls[-1] == []  # its content was known
    # a drop that comes late changes only what no newer drop has touched
    put(root, "d3", {"a.txt": "late", "sub/b.txt": "late", "c.md": "six BAD", "new.txt": "seven"})
    run()
    assert state(spark, sink) == {("a.txt", "one"), ("a.txt", "two"), ("c.md", "ValueError"), ("new.txt", "seven")}
    assert {r.path for r in current_files(spark, sink, deleted=True).collect()} == {"sub/b.txt"}
    before = state(spark, sink)
    assert run() == 0 and state(spark, sink) == before
    # compaction keeps the newest versions and may change the buckets; deletions are still known afterwards
    assert compact(spark, sink, files_per_bucket=1) == (2, 8)
    assert state(spark, sink) == before and drop_old_generations(spark, sink) == ["g0001-8"]
    put(root, "d0", {"sub/b.txt": "older than its deletion"})
    put(root, "d5", {"sub/b.txt": "back", "x1.txt": "x", "x2.txt": "x", "x3.txt": "x", "x4.txt": "x", "x5.txt": "x"})
    run()
    assert state(spark, sink) == before | {("sub/b.txt", "back")} | {(f"x{i}.txt", "x") for i in range(1, 6)}
    before = state(spark, sink)
    assert compact(spark, sink, files_per_bucket=1) == (3, 16) and state(spark, sink) == before


def test_half_written_batch_and_generation_are_not_seen(spark, stream):
    root, sink, calls, run = stream
    put(root, "d1", {"a.txt": "one"})
    run()
    before = state(spark, sink)
    os.makedirs(f"{sink}/g0002-8/files/bucket=0")  # a compaction that died
    assert state(spark, sink) == before
    # chunks of a batch that died before its files were written
    current_chunks(spark, sink).selectExpr("* EXCEPT (content_hash)", "'other' AS content_hash", "0 AS bucket").write.mode("append").partitionBy("bucket").parquet(f"{sink}/g0001-8/chunks")
    assert state(spark, sink) == before
    compact(spark, sink)
    put(root, "d2", {"a.txt": "two"})
    run()
    assert state(spark, sink) == {("a.txt", "two")}


def test_invalid_text_and_automatic_compaction(spark, stream):
    root, sink, calls, run = stream
    for i in range(3):
        put(root, f"d{i}", {"a.txt": f"v{i}", "bin.txt": b"\xff\xfe" + bytes([i])})
        run(compact_every=2)
    assert state(spark, sink) == {("a.txt", "v2"), ("bin.txt", "ValueError")}
    assert sorted(n for n in os.listdir(sink) if n.startswith("g")) == ["g0001-8", "g0002-8"]


def test_user_function_as_table_function(spark):
    def slow(path, text):
        if text == "sleep":
            time.sleep(30)
        if text == "spin":
            while True:
                pass
        return words(path, text)
    name = register_extractor(spark, "slow_words", slow, seconds=0.5)
    rows = [("a", "txt", "one one two", True), ("b", "txt", "sleep", True), ("c", "md", "spin", True), ("d", "txt", "BAD", True), ("e", "txt", "", False),
            ("f", "txt", None, None), ("g", "other", "none", True), ("h", "md", "last", True)]
    files = spark.createDataFrame(rows, "path string, language string, text string, valid_utf8 boolean")
    got = extract_files(files, {"txt": name, "md": name}).collect()
    assert {(r.path, r.name) for r in got if r.error_class is None} == {("a", "one"), ("a", "two"), ("h", "last")}
    assert len({r.node_id for r in got if r.path == "a"}) == 3
    assert {(r.path, r.error_class) for r in got if r.error_class} == {("b", "TimeoutError"), ("c", "TimeoutError"), ("d", "ValueError"), ("e", "ValueError")}
    assert extract_files(files, {}).count() == 0
    # callable from SQL as well
    assert spark.sql("SELECT name FROM VALUES ('p', 'x y') t(path, text), LATERAL slow_words(path, text, true)").count() == 2


def test_table_function_equals_arrow_extractors(spark):
    files = spark.createDataFrame([(f"f{i}", "txt", f"w{i} x x") for i in range(20)] + [("bad", "txt", "BAD")], "path string, language string, text string")
    key = lambda df: sorted((r.path, r.node_id or "", r.name or "", r.raw_cleaned or "", str(r.edges), r.error_class or "") for r in df.collect())
    name = register_extractor(spark, "words_fn", words)
    assert key(extract_files(files, {"txt": name})) == key(run_extractors(files, {"txt": words}))


def test_records_are_given_line_by_line():
    import tracemalloc

    from graphloom.plans.catalog import record_chunks
    for text in ("", "\n", "1\ta\n\n2\tb\tc\n", "x\n3\ta@b.cd", "no tab"):
        want = [(name, body) for name, _, body in (line.partition("\t") for line in text.split("\n") if line)]
        assert [(c["name"], c["raw_cleaned"]) for c in record_chunks("f", text)] == want
    text = "\n".join(f"{i}\t" + "word " * 100 for i in range(20_000))
    tracemalloc.start()
    assert sum(1 for _ in record_chunks("f", text)) == 20_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(text) / 10
