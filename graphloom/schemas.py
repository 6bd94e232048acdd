"""Table schemas, closed domains and write defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The confidence domain, strongest first, and its rank
# (deterministic > probabilistic > inferred).
CONFIDENCE_LEVELS = ["deterministic", "probabilistic", "inferred"]
CONFIDENCE_TIER = {"deterministic": 0, "probabilistic": 1, "inferred": 2}

# Defaults applied when a field is absent on write.
NODE_DEFAULTS = {"language": "unknown", "source_file": "", "chunk_type": "unknown",
                 "raw_cleaned": "", "summary": ""}
EDGE_DEFAULTS = {"type": "UNKNOWN", "confidence": "inferred", "evidence": ""}

VECTOR = T.ArrayType(T.FloatType())

NODES = T.StructType([
    T.StructField("node_id", T.StringType(), False),
    T.StructField("language", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("chunk_type", T.StringType()),
    T.StructField("raw_cleaned", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("community_id", T.StringType()),
    T.StructField("embedding", VECTOR),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

EDGES = T.StructType([
    T.StructField("edge_id", T.StringType(), False),
    T.StructField("source_node_id", T.StringType()),
    T.StructField("target_node_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

COMMUNITIES = T.StructType([
    T.StructField("community_id", T.StringType(), False),
    T.StructField("level", T.IntegerType()),
    T.StructField("member_node_ids", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("embedding", VECTOR),
    T.StructField("updated_at", T.TimestampType()),
])

CORRECTIONS = T.StructType([
    T.StructField("correction_id", T.StringType(), False),
    T.StructField("session_id", T.StringType()),
    T.StructField("target_type", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("original", T.StringType()),
    T.StructField("corrected", T.StringType()),
    T.StructField("captured_at", T.TimestampType()),
])

EDGE_TYPE_SPEC = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.StringType()),
])

# Extractor registry (the reference's skills table without the script column;
# list columns are real arrays instead of JSON text).
REGISTRY = T.StructType([
    T.StructField("skill_id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("file_types", T.ArrayType(T.StringType())),
    T.StructField("chunk_types", T.ArrayType(T.StringType())),
    T.StructField("edge_types", T.ArrayType(EDGE_TYPE_SPEC)),
    T.StructField("limitations", T.ArrayType(T.StringType())),
    T.StructField("tool_name", T.StringType()),
    T.StructField("execution_environment", T.StringType()),
    T.StructField("application_role", T.StringType()),
    T.StructField("summarisation_instructions", T.StringType()),
    T.StructField("handbook", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("version", T.IntegerType()),
])

RUN_LOG = T.StructType([
    T.StructField("run_num", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("sprint", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("skill_name", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("skill_id", T.StringType()),
    T.StructField("nodes", T.LongType()),
    T.StructField("edges", T.LongType()),
    T.StructField("communities", T.LongType()),
    T.StructField("edge_types", T.StringType()),
    T.StructField("duration_s", T.LongType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("prompt_version", T.StringType()),
    T.StructField("suite_version", T.StringType()),
    T.StructField("run_dir", T.StringType()),
    T.StructField("orchestrator_model", T.StringType()),
    T.StructField("skill_model", T.StringType()),
    T.StructField("cost_usd", T.DecimalType(18, 6)),
    T.StructField("in_tokens", T.LongType()),
    T.StructField("out_tokens", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("canonical", T.BooleanType()),
])


def confidence_tier(col: Column | str) -> Column:
    """0 deterministic, 1 probabilistic, 2 anything else (inferred)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(c == "deterministic", F.lit(0))
            .when(c == "probabilistic", F.lit(1))
            .otherwise(F.lit(2)))


def tier_confidence(tier: Column | str) -> Column:
    t = F.col(tier) if isinstance(tier, str) else tier
    return (F.when(t == 0, F.lit("deterministic"))
            .when(t == 1, F.lit("probabilistic"))
            .otherwise(F.lit("inferred")))


def coerce_confidence(col: Column | str) -> Column:
    """Values outside the closed domain become 'inferred'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(*CONFIDENCE_LEVELS), c).otherwise(F.lit("inferred"))
