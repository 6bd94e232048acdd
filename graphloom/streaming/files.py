"""ST2 over files: a folder of drops as a stream, with changes, deletions and late versions.

Files arrive as ``<root>/<drop>/<path>``, read by the streaming ``binaryFile`` source.  Drops are ordered by name,
whatever order they arrive in, so a late old version never replaces a newer one.  A file ``<path>.deleted`` is a
tombstone: from its drop on the path is gone.  Spark's file sources pass over empty files, so a tombstone needs a byte, and a
file that became empty is dropped as a tombstone.  Of each batch only files whose content was not stored before are extracted.

The store has three tables, partitioned by a hash bucket of the path: ``files`` (every accepted version:
path, drop, content hash, deleted), ``chunks`` (what the extractor found in a content) and ``edges``.  A batch writes
chunks and edges first and ``files`` last, so a batch that died halfway changes nothing that a reader sees, and a replayed batch
adds nothing.  A batch reads only the buckets it touches.

Tables live in generations ``g<number>-<buckets>``.  ``compact`` writes the next one with the newest version of each path,
what was found in it, and as many buckets as the number of files asks for; it counts from the moment its mark is
written.  One writer at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.extract import explode_inline_edges
from graphloom.functions.text import ext_language, extension
from graphloom.session import cut_lineage, release
from graphloom.sources.files import CHUNKS
from graphloom.sources.store import _exists, _fs

FIRST_BUCKETS, FILES_PER_BUCKET, COMPACT_EVERY = 8, 100_000, 16
TOMBSTONE = ".deleted"
_MARK = "_COMPLETE"
_FILES = "path string, drop string, content_hash string, deleted boolean, modified_at timestamp, epoch long, bucket int"
_CHUNKS = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in CHUNKS.fields)}, content_hash string, bucket int"
_EDGES = ("edge_id string, source_node_id string, target_node_id string, type string, confidence string, evidence string, "
          "path string, content_hash string, bucket int")
_SCHEMAS = {"files": _FILES, "chunks": _CHUNKS, "edges": _EDGES}


def _generation(spark: SparkSession, sink: str) -> tuple[int, int]:
    """Number and buckets of the newest complete generation (0: none)."""
    fs, p = _fs(spark, sink)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    found = [re.fullmatch(r"g(\d+)-(\d+)", n) for n in names]
    done = [(int(m[1]), int(m[2])) for m in found if m and _exists(spark, f"{sink}/{m[0]}/{_MARK}")]
    return max(done, default=(0, FIRST_BUCKETS))


def _open(spark: SparkSession, sink: str, number: int, buckets: int) -> str:
    """Folder of a generation, marked complete."""
    folder = f"{sink}/g{number:04d}-{buckets}"
    fs, p = _fs(spark, f"{folder}/{_MARK}")
    fs.mkdirs(p.getParent())
    fs.create(p, True).close()
    return folder


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    path = f"{folder}/{table}"
    if not _exists(spark, path):
        return spark.createDataFrame([], _SCHEMAS[table])
    return spark.read.schema(_SCHEMAS[table]).parquet(path)


def _append(rows: DataFrame, folder: str, table: str) -> None:
    # few files a batch; a large bucket is split over writers
    rows.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{folder}/{table}")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")


def _newest(rows: DataFrame) -> DataFrame:
    """The newest version of each path."""
    names = ["drop", "modified_at", "content_hash", "deleted", "epoch", "bucket"]
    return rows.groupBy("path").agg(F.max(F.struct(*names)).alias("v")).select("path", "v.*")


def events(batch: DataFrame, root: str, logical: Callable[[Column], Column] | None = None) -> DataFrame:
    """``path, drop, deleted, modified_at, content`` of binaryFile rows below ``root``; files outside of a drop are left out.

    ``logical`` maps a file's place in its drop to its path (default: the place itself).
    """
    base = re.escape(root.rstrip("/").split("://")[-1].split(":")[-1])
    place = lambda i: F.regexp_extract("path", f"{base}/([^/]+)/(.+)$", i)
    named = batch.select(place(1).alias("drop"), place(2).alias("place"), F.col("modificationTime").alias("modified_at"), "content")
    named = named.filter(F.length("place") > 0).withColumn("path", logical(F.col("place")) if logical else F.col("place"))
    gone = F.endswith(F.col("path"), F.lit(TOMBSTONE))
    return named.select(F.when(gone, F.regexp_replace("path", f"{re.escape(TOMBSTONE)}$", "")).otherwise(F.col("path")).alias("path"),
                        "drop", gone.alias("deleted"), "modified_at", F.when(~gone, F.col("content")).alias("content"))


def run_file_stream(spark: SparkSession, root: str, sink: str, extract: Callable[[DataFrame], DataFrame],
                    max_files_per_trigger: int | None = None, compact_every: int = COMPACT_EVERY,
                    files_per_bucket: int = FILES_PER_BUCKET, logical: Callable[[Column], Column] | None = None) -> int:
    """Takes in every file that is new under ``root`` (``availableNow``); returns the number of batches.

    ``extract`` maps ``(path, language, text, valid_utf8)`` to ``CHUNKS`` rows, e.g. ``extract_files`` or ``run_extractors``.
    """
    sink = sink.rstrip("/")
    batches = 0

    def per_batch(batch: DataFrame, epoch: int) -> None:
        nonlocal batches
        batches += 1
        number, buckets = _generation(spark, sink)
        folder = _open(spark, sink, max(1, number), buckets)
        found = (events(batch, root, logical).withColumn("content_hash", F.sha2("content", 256)).withColumn("epoch", F.lit(epoch).cast("long"))
                 .withColumn("bucket", _bucket(buckets)))
        new = cut_lineage(_newest(found))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most one per file of the batch
        known = cut_lineage(_read(spark, folder, "files").filter(F.col("bucket").isin(touched))
                            .join(new.select("path"), "path", "left_semi"))
        now = _newest(known).select("path", F.struct("drop", "modified_at", "content_hash", "deleted").alias("now"))
        newer = F.struct("drop", "modified_at", "content_hash", "deleted") > F.col("now")
        accepted = cut_lineage(new.join(now, "path", "left").filter(F.coalesce(newer, F.lit(True))).drop("now"))
        # contents that were stored before need no second extraction
        unseen = (accepted.filter("NOT deleted").select("path", "content_hash", "drop")
                  .join(known.filter("NOT deleted").select("path", "content_hash"), ["path", "content_hash"], "left_anti"))
        text = F.try_validate_utf8(F.col("content").cast("string"))
        files = (found.filter("NOT deleted").join(unseen, ["path", "content_hash", "drop"]).dropDuplicates(["path"])
                 .select("path", ext_language(extension("path")).alias("language"), F.coalesce(text, F.lit("")).alias("text"),
                         text.isNotNull().alias("valid_utf8"), "content_hash"))
        chunks = extract(files.drop("content_hash")).join(unseen.select("path", "content_hash"), "path").withColumn("bucket", _bucket(buckets))
        _append(chunks.select(*[f.name for f in CHUNKS.fields], "content_hash", "bucket"), folder, "chunks")
        # the edges of the batch's chunks as they were written
        mine = (_read(spark, folder, "chunks").filter(F.col("bucket").isin(touched) & F.col("error_class").isNull())
                .join(unseen.select("path", "content_hash"), ["path", "content_hash"], "left_semi").dropDuplicates(["path", "content_hash", "node_id"]))
        edges = explode_inline_edges(mine).join(mine.select(F.col("node_id").alias("source_node_id"), "path", "content_hash", "bucket"), "source_node_id")
        _append(edges, folder, "edges")
        _append(accepted, folder, "files")
        for t in (new, known, accepted):
            release(t)
        if (epoch + 1) % compact_every == 0:
            compact(spark, sink, files_per_bucket)

    source = (spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
              .schema("path string, modificationTime timestamp, length long, content binary"))
    if max_files_per_trigger is not None:
        source = source.option("maxFilesPerTrigger", max_files_per_trigger)
    query = (source.load(root).writeStream.foreachBatch(per_batch).option("checkpointLocation", os.path.join(sink, "_checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return batches


def current_files(spark: SparkSession, sink: str, deleted: bool = False) -> DataFrame:
    """``path, drop, modified_at, content_hash`` of every path that is there (or, with ``deleted``, was deleted)."""
    number, buckets = _generation(spark, sink.rstrip("/"))
    rows = _newest(_read(spark, f"{sink.rstrip('/')}/g{number:04d}-{buckets}", "files"))
    return rows.filter(F.col("deleted") == deleted).select("path", "drop", "modified_at", "content_hash")


def _current(spark: SparkSession, sink: str, table: str, key: str) -> DataFrame:
    number, buckets = _generation(spark, sink.rstrip("/"))
    rows = _read(spark, f"{sink.rstrip('/')}/g{number:04d}-{buckets}", table)
    live = current_files(spark, sink).select("path", "content_hash")
    return rows.join(live, ["path", "content_hash"], "left_semi").dropDuplicates(["path", "content_hash", key])


def current_chunks(spark: SparkSession, sink: str) -> DataFrame:
    """Chunks and rejects of the newest version of every file that is there."""
    return _current(spark, sink, "chunks", "node_id").drop("bucket")


def current_edges(spark: SparkSession, sink: str) -> DataFrame:
    """Edges of those chunks."""
    return _current(spark, sink, "edges", "edge_id").drop("bucket")


def compact(spark: SparkSession, sink: str, files_per_bucket: int = FILES_PER_BUCKET) -> tuple[int, int]:
    """Writes the next generation: newest versions only, tombstones included; returns its number and buckets.

    Old generations are left for readers that have them open; ``drop_old_generations`` deletes them.
    """
    sink = sink.rstrip("/")
    number, buckets = _generation(spark, sink)
    old = f"{sink}/g{number:04d}-{buckets}"
    rows = cut_lineage(_newest(_read(spark, old, "files")))
    n = rows.count()
    while buckets * files_per_bucket < n:
        buckets *= 2
    folder = f"{sink}/g{number + 1:04d}-{buckets}"
    fs, p = _fs(spark, folder)
    if fs.exists(p):  # left by a compaction that died; it has no mark, so nobody reads it
        fs.delete(p, True)
    _append(rows.withColumn("bucket", _bucket(buckets)), folder, "files")
    for table, key in (("chunks", "node_id"), ("edges", "edge_id")):
        kept = _current(spark, sink, table, key).withColumn("bucket", _bucket(buckets))
        _append(kept, folder, table)
    release(rows)
    _open(spark, sink, number + 1, buckets)
    return number + 1, buckets


def drop_old_generations(spark: SparkSession, sink: str) -> list[str]:
    """Deletes every generation before the newest complete one; returns their names."""
    number, _ = _generation(spark, sink.rstrip("/"))
    fs, p = _fs(spark, sink.rstrip("/"))
    old = [f.getPath() for f in fs.listStatus(p) if (m := re.fullmatch(r"g(\d+)-\d+", f.getPath().getName())) and int(m[1]) < number]
    for path in old:
        fs.delete(path, True)
    return sorted(path.getName() for path in old)
