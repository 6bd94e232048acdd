"""ST1: corrections captured from a stream of dialogue turns.

Each micro-batch is joined, in ``foreachBatch``, with the turns already
stored for the same conversations, and the corrections of those
conversations are captured anew.  What differs from the stored state is
appended with the batch's epoch: a new or changed correction as itself, one
that no longer holds (a late turn came between) as a deletion.  Readers take
the newest row of each correction, so late turns and edited turns give what
the batch operator gives, and a batch replayed after a failure adds nothing.
Both stores are partitioned by a hash bucket of the conversation, and a
batch reads only the buckets it touches; ``buckets`` is fixed for the life of a
store and should grow with its size.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.corrections import capture_from_dialogue

TURN_SCHEMA = "conv_id long, turn long, role string, text string"
BUCKETS = 64  # stored turns and corrections are partitioned by a hash of conv_id
_CONTENT = ["session_id", "target_type", "target_id", "original", "corrected", "conv_id", "turn"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def newest_turns(turns: DataFrame) -> DataFrame:
    """One row per (conv_id, turn): the one of the largest epoch, then role and text."""
    return (turns.groupBy("conv_id", "turn").agg(F.max(F.struct("epoch", "role", "text")).alias("t"))
            .select("conv_id", "turn", "t.role", "t.text"))


def newest_corrections(rows: DataFrame) -> DataFrame:
    """The newest row of every correction, deletions included."""
    return (rows.groupBy("correction_id")
            .agg(F.max_by(F.struct(*_CONTENT, "deleted"), F.col("epoch")).alias("c"))
            .select("correction_id", "c.*"))


def run_correction_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                          glob: str = "*.parquet", max_files_per_trigger: int | None = None,
                          buckets: int = BUCKETS) -> None:
    """Process every turn file under ``source_dir`` (``availableNow``) into
    ``sink_dir/corrections``; state lives in ``sink_dir/turns``.

    Without ``max_files_per_trigger`` a backlog is one batch.
    """
    turns_dir = os.path.join(sink_dir, "turns")
    out_dir = os.path.join(sink_dir, "corrections")
    bucket = F.pmod(F.xxhash64(F.col("conv_id")), F.lit(buckets)).cast("int")

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        b = (batch.select("conv_id", "turn", "role", "text")
             .withColumn("epoch", F.lit(epoch_id).cast("long")).withColumn("bucket", bucket))
        convs = b.select("conv_id").distinct()
        # at most ``buckets`` small integers: which stored partitions this batch touches
        touched = [r[0] for r in b.select("bucket").distinct().collect()]
        turns = b
        if _exists(spark, turns_dir):
            turns = (spark.read.parquet(turns_dir).filter(F.col("bucket").isin(touched))
                     .join(convs, "conv_id", "left_semi").unionByName(b))
        new = capture_from_dialogue(newest_turns(turns)).select("correction_id", *_CONTENT)
        if _exists(spark, out_dir):
            old = newest_corrections(spark.read.parquet(out_dir).filter(F.col("bucket").isin(touched))
                                     .join(convs, "conv_id", "left_semi"))
            old = old.select("correction_id", F.struct(*_CONTENT).alias("was"), "deleted")
            both = new.select("correction_id", F.struct(*_CONTENT).alias("now")).join(old, "correction_id", "full")
            gone = F.col("now").isNull()
            same = F.when(gone, F.col("deleted")).otherwise(
                F.coalesce(~F.col("deleted"), F.lit(False)) & F.col("now").eqNullSafe(F.col("was")))
            new = (both.filter(~same).withColumn("c", F.coalesce("now", "was"))
                   .select("correction_id", "c.*", gone.alias("deleted")))
        else:
            new = new.withColumn("deleted", F.lit(False))
        # one writer per bucket, so a batch adds at most one file per bucket
        (new.withColumn("epoch", F.lit(epoch_id).cast("long")).withColumn("bucket", bucket).repartition("bucket")
         .write.mode("append").partitionBy("bucket").parquet(out_dir))
        b.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(turns_dir)

    source = spark.readStream.schema(TURN_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger is not None:
        source = source.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (source.parquet(source_dir).writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", os.path.join(sink_dir, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_corrections(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The corrections that hold now."""
    rows = spark.read.parquet(os.path.join(sink_dir, "corrections"))
    return newest_corrections(rows).filter("NOT deleted").drop("deleted")
