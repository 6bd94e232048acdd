import tempfile

from graphloom.operators.corrections import capture_from_dialogue
from graphloom.streaming.corrections import read_corrections, run_correction_stream


def test_stream_in_several_batches_equals_batch(spark):
    rows = [(1, 0, "assistant", "a0"), (1, 1, "user", "u1"), (2, 0, "assistant", "b0"),
            (1, 2, "assistant", "a2"), (2, 1, "user", "u2"), (1, 3, "user", "u3")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    src = tempfile.mkdtemp(prefix="gl-src-")
    # three files -> three micro-batches; pairs cross batch boundaries
    import pyarrow as pa
    import pyarrow.parquet as pq
    for i, chunk in enumerate([rows[:2], rows[2:4], rows[4:]]):
        cols = list(zip(*chunk))
        t = pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()),
                      "role": pa.array(cols[2]), "text": pa.array(cols[3])})
        pq.write_table(t, f"{src}/part{i}.parquet")
    sink = tempfile.mkdtemp(prefix="gl-sink-")
    run_correction_stream(spark, src, sink, glob="*.parquet", max_files_per_trigger=1)
    # a second run over the same input adds nothing (idempotent)
    run_correction_stream(spark, src, sink, glob="*.parquet")
    got = sorted(r.correction_id for r in read_corrections(spark, sink).collect())
    exp = sorted(r.correction_id for r in capture_from_dialogue(turns).collect())
    assert got == exp == ["1-1", "1-3", "2-1"]


def _turns(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(folder)


def test_late_and_edited_turns_give_the_batch_result(spark):
    src, sink = tempfile.mkdtemp(prefix="gl-src-"), tempfile.mkdtemp(prefix="gl-sink-")
    steps = [[(1, 0, "assistant", "a0"), (1, 2, "user", "u2"), (2, 0, "assistant", "b0"), (2, 2, "user", "v2")],
             [(1, 1, "assistant", "a1"), (2, 1, "user", "v1")],  # late: 1-2 changes its original, 2-2 no longer follows an assistant
             [(1, 2, "user", "u2 edited")]]
    for rows in steps:
        _turns(spark, src, rows)
        run_correction_stream(spark, src, sink)
    got = {(r.correction_id, r.original, r.corrected) for r in read_corrections(spark, sink).collect()}
    assert got == {("1-2", "a1", "u2 edited"), ("2-1", "b0", "v1")}
    turns = {(c, t): (c, t, r, x) for rows in steps for c, t, r, x in rows}
    batch = capture_from_dialogue(spark.createDataFrame(list(turns.values()), "conv_id long, turn long, role string, text string"))
    assert got == {(r.correction_id, r.original, r.corrected) for r in batch.collect()}


def test_ingest_revert_becomes_current_again(spark):
    from graphloom.streaming.ingest import current_nodes, run_ingest_stream
    src, sink = tempfile.mkdtemp(prefix="gl-src-"), tempfile.mkdtemp(prefix="gl-sink-")
    schema = "node_id string, content string, modified_at timestamp"

    def run(rows):
        spark.createDataFrame(rows, "node_id string, content string, at string").selectExpr(
            "node_id", "content", "to_timestamp(at) AS modified_at").coalesce(1).write.mode("append").parquet(src)
        run_ingest_stream(spark, spark.readStream.schema(schema).parquet(src), sink, lambda b: b)
        return {r.node_id: r.content for r in current_nodes(spark, sink).collect()}
    assert run([("n", "A", None), ("m", "x", "2024-01-02")]) == {"n": "A", "m": "x"}
    assert run([("n", "B", None), ("m", "late but older", "2024-01-01")]) == {"n": "B", "m": "x"}
    assert run([("n", "A", None), ("m", "y1", "2024-02-01"), ("m", "y2", "2024-02-02")]) == {"n": "A", "m": "y2"}
    assert run([("n", "A", None)]) == {"n": "A", "m": "y2"}
