"""The store: Parquet tables under one base path (S4-S8, S11, S12, P8, P10, P11, GR11).

Writes are appends of whole DataFrames with the reference defaults filled
in by column expressions.  Mutations (community write-back) write a new
version directory of the table and switch to it; a path being read is never
overwritten.  The base path is a shared file system path on a cluster.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import schemas as S

#: GR11: members of communities as rows.
MEMBERS = T.StructType([T.StructField("community_id", T.StringType()), T.StructField("node_id", T.StringType()),
                        T.StructField("level", T.IntegerType())])
#: GR7: one row per community of every level.
TREE = T.StructType([T.StructField("community_id", T.StringType()), T.StructField("level", T.IntegerType()),
                     T.StructField("parent_id", T.StringType()), T.StructField("n_members", T.LongType()),
                     T.StructField("n_children", T.LongType()), T.StructField("inner_weight", T.LongType()),
                     T.StructField("cut_weight", T.LongType())])
TABLES = {"nodes": S.NODES, "edges": S.EDGES, "communities": S.COMMUNITIES,
          "corrections": S.CORRECTIONS, "registry": S.REGISTRY, "community_members": MEMBERS}

#: Tables that a job writes as a whole; empty until then.
DERIVED = {"community_tree": TREE}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _conform(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """Select the schema's columns: absent ones null, defaults for empty values."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c.cast(f.dataType), F.lit(defaults[f.name]))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


@dataclass
class Store:
    spark: SparkSession
    base: str

    # -- layout -------------------------------------------------------------
    def _versions(self, table: str) -> list[str]:
        """Complete versions of a table, oldest first.

        A version folder counts once its job has committed (``_SUCCESS``), so
        there is no pointer to overwrite and a half-written version is never read.
        One writer at a time makes new versions; appends go to the newest one.
        """
        fs, p = _fs(self.spark, f"{self.base.rstrip('/')}/{table}")
        if not fs.exists(p):
            return []
        found = [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()]
        return sorted((v for v in found if re.fullmatch(r"v\d+", v) and self._complete(f"{self.base.rstrip('/')}/{table}/{v}")),
                      key=lambda v: int(v[1:]))

    def _complete(self, folder: str) -> bool:
        """Whether a version's job has committed and, if it belongs to a release, the release has too."""
        fs, p = _fs(self.spark, folder)
        names = {f.getPath().getName() for f in fs.listStatus(p)}
        release = next((n.removeprefix("_RELEASE-") for n in names if n.startswith("_RELEASE-")), None)
        return "_SUCCESS" in names and (release is None or _exists(self.spark, f"{self.base.rstrip('/')}/_releases/{release}"))

    def _next_version(self, table: str) -> str:
        """Folder for the next version of a table, claimed by this writer; another writer that claims it fails."""
        fs, p = _fs(self.spark, f"{self.base.rstrip('/')}/{table}")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        number = max((int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)), default=0) + 1
        folder = f"{self.base.rstrip('/')}/{table}/v{number:04d}"
        fs, claim = _fs(self.spark, f"{folder}/_CLAIMED")
        fs.create(claim, False).close()
        return folder

    def commit_tables(self, tables: dict[str, DataFrame]) -> str:
        """New versions of several tables that become readable together; returns the release's name.

        Every version is marked as part of the release before it is written, and the release counts once all of them are there: a
        job that dies halfway leaves the old versions in force.
        """
        release = uuid.uuid4().hex
        for name, df in tables.items():
            folder = self._next_version(name)
            fs, mark = _fs(self.spark, f"{folder}/_RELEASE-{release}")
            fs.create(mark, False).close()
            _conform(df, (TABLES | DERIVED)[name], {}).write.mode("append").parquet(folder)
        fs, done = _fs(self.spark, f"{self.base.rstrip('/')}/_releases/{release}")
        fs.mkdirs(done.getParent())
        fs.create(done, False).close()
        return release

    def path(self, table: str) -> str:
        """Directory of the current (newest complete) version of a table."""
        versions = self._versions(table)
        return f"{self.base.rstrip('/')}/{table}/{versions[-1] if versions else 'v0001'}"

    # -- S4 -----------------------------------------------------------------
    def ensure_tables(self) -> list[str]:
        """Create every missing table empty; returns the table names."""
        for name, schema in TABLES.items():
            p = self.path(name)
            if not _exists(self.spark, p):
                self.spark.createDataFrame([], schema).write.mode("ignore").parquet(p)
        return sorted(TABLES)

    # -- S8 / P1 --------------------------------------------------------------
    def read(self, table: str, with_vectors: bool = True) -> DataFrame:
        if table in DERIVED and not self._versions(table):
            return self.spark.createDataFrame([], DERIVED[table])
        df = self.spark.read.schema((TABLES | DERIVED)[table]).parquet(self.path(table))
        return df if with_vectors else df.drop("embedding")

    # -- S5 / P10 ------------------------------------------------------------
    def append_nodes(self, nodes: DataFrame) -> DataFrame:
        """Append valid nodes (non-empty summary); returns the rejected rows."""
        n = _conform(nodes, S.NODES, S.NODE_DEFAULTS)
        n = (n.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
             .withColumn("updated_at", F.coalesce("updated_at", F.current_timestamp())))
        ok = F.col("node_id").isNotNull() & (F.length("summary") > 0)
        n.filter(ok).write.mode("append").parquet(self.path("nodes"))
        return n.filter(~ok)

    # -- S6 / P8 ------------------------------------------------------------
    def append_edges(self, edges: DataFrame) -> None:
        e = _conform(edges, S.EDGES, S.EDGE_DEFAULTS)
        e = (e.withColumn("confidence", S.coerce_confidence("confidence"))
             .withColumn("created_at", F.coalesce("created_at", F.current_timestamp())))
        e.filter(F.length(F.coalesce("target_node_id", F.lit(""))) > 0) \
            .write.mode("append").parquet(self.path("edges"))

    # -- S7 / P11 -----------------------------------------------------------
    def append_communities(self, communities: DataFrame) -> DataFrame:
        c = _conform(communities, S.COMMUNITIES, {"level": 0})
        c = c.withColumn("updated_at", F.coalesce("updated_at", F.current_timestamp()))
        ok = F.length(F.coalesce("summary", F.lit(""))) > 0
        c.filter(ok).write.mode("append").parquet(self.path("communities"))
        return c.filter(~ok)

    def append_corrections(self, corrections: DataFrame) -> None:
        c = _conform(corrections, S.CORRECTIONS, {})
        c = c.withColumn("captured_at", F.coalesce("captured_at", F.current_timestamp()))
        c.write.mode("append").parquet(self.path("corrections"))

    def append_registry(self, registry: DataFrame) -> None:
        r = _conform(registry, S.REGISTRY, {"version": 1})
        r = r.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        r.write.mode("append").parquet(self.path("registry"))

    # -- J7 / GR11 ------------------------------------------------------------
    def write_back_membership(self, members: DataFrame) -> str:
        """Set ``community_id`` of member nodes in a new version of ``nodes``."""
        from graphloom.operators.communities import write_back_membership
        current = self.read("nodes")
        new_path = self._next_version("nodes")
        write_back_membership(current, members).write.mode("append").parquet(new_path)
        return new_path

    def store_communities(self, members: DataFrame, summaries: DataFrame, embed=None) -> str:
        """GR11: embed each community summary (EM1), append the communities
        and write the membership back to the nodes (J7), as one batch.

        ``members(community_id, node_id, level)``, ``summaries(community_id, summary)``;
        ``embed`` maps a DataFrame with a ``summary`` column to one with ``vec``
        (default: ``embed_text``).  Members are stored as rows of the
        ``community_members`` table; the communities' ``member_node_ids`` stays
        null, because a community may hold a large share of all nodes.
        """
        from graphloom.operators.vectors import embed_text
        emb = (embed or (lambda d: embed_text(d, "summary")))(summaries)
        ids = members.groupBy("community_id").agg(F.min("level").alias("level"))
        rows = ids.join(emb.select("community_id", "summary", F.col("vec").alias("embedding")),
                        "community_id")
        _conform(members, MEMBERS, {"level": 0}).write.mode("append").parquet(self.path("community_members"))
        self.append_communities(rows)
        return self.write_back_membership(members.select("node_id", "community_id"))

    # -- A5 -----------------------------------------------------------------
    def write_run(self, nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None,
                  calls: DataFrame | None = None) -> DataFrame:
        """A5: appends a run's nodes, edges and communities and returns its summary, one row.

        ``nodes, rejected, edges, n_deterministic, n_probabilistic, n_inferred, coerced, communities, calls, in_tokens, out_tokens, cost_usd,
        duration_s``.  The counts are taken while the rows are written (``observe``), nothing is read again; ``calls`` holds
        the run's model calls (in_tokens, out_tokens, cost_usd).  A retried task may write and count rows twice only where the sink
        itself would keep them twice.
        """
        from pyspark.sql import Observation
        start, one = time.monotonic(), F.count(F.lit(1))
        bad = ~(F.col("node_id").isNotNull() & (F.length(F.coalesce(F.col("summary"), F.lit(""))) > 0))
        seen_nodes, seen_edges, seen_comms, seen_calls = (Observation() for _ in range(4))
        self.append_nodes(nodes.observe(seen_nodes, F.count_if(~bad).alias("nodes"), F.count_if(bad).alias("rejected")))
        kept = F.length(F.coalesce(F.col("target_node_id"), F.lit(""))) > 0
        level = S.coerce_confidence("confidence")
        self.append_edges(edges.observe(
            seen_edges, F.count_if(kept).alias("edges"), *[F.count_if(kept & (level == c)).alias(f"n_{c}") for c in S.CONFIDENCE_LEVELS],
            F.count_if(kept & ~F.coalesce(F.col("confidence").isin(*S.CONFIDENCE_LEVELS), F.lit(False))).alias("coerced")))
        row = {**seen_nodes.get, **seen_edges.get, "communities": 0, "calls": 0, "in_tokens": 0, "out_tokens": 0, "cost_usd": None}
        if communities is not None:
            self.append_communities(communities.observe(seen_comms, F.count_if(F.length(F.coalesce(F.col("summary"), F.lit(""))) > 0).alias("communities")))
            row |= seen_comms.get
        if calls is not None:
            total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
            cost = F.sum(F.coalesce(F.col("cost_usd").cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))).cast("decimal(24,6)").alias("cost_usd")
            calls.observe(seen_calls, one.alias("calls"), total("in_tokens"), total("out_tokens"), cost).write.format("noop").mode("overwrite").save()
            row |= {k: v for k, v in seen_calls.get.items() if v is not None}
        row["duration_s"] = round(time.monotonic() - start, 3)
        kinds = {"cost_usd": "decimal(24,6)", "duration_s": "double"}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'long')}" for k in row))

    # -- S11 ----------------------------------------------------------------
    def export_run(self, out_dir: str, summary: DataFrame | None = None) -> None:
        """Nodes, edges and communities as JSON lines without vectors (gzip: names repeat in every row), plus a one-row meta table.

        ``summary`` is the row that ``write_run`` returned: with it the meta row has the run's duration, tokens and cost
        too.  The store's counts are taken while the files are written.
        """
        from pyspark.sql import Observation

        from graphloom.operators.graph import edge_type_summary
        row: dict = {}
        for name in ("nodes", "edges", "communities"):
            seen = Observation()
            rows = self.read(name, with_vectors=False).observe(seen, F.count(F.lit(1)).alias(name))
            rows.write.mode("overwrite").json(f"{out_dir}/{name}", compression="gzip")
            row |= seen.get
        nodes = self.read("nodes", with_vectors=False)
        row["files"] = nodes.select("source_file").distinct().count()
        row |= edge_type_summary(self.read("edges")).first().asDict()
        if summary is not None:
            run = summary.select("calls", "in_tokens", "out_tokens", F.col("cost_usd").cast("double").alias("cost_usd"), "duration_s")
            row |= run.first().asDict()
        kinds = {"edge_types": "string", "cost_usd": "double", "duration_s": "double"}
        meta = self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'long')}" for k in row))
        meta.coalesce(1).write.mode("overwrite").json(f"{out_dir}/meta")


def registry_from_json_columns(df: DataFrame) -> DataFrame:
    """A registry with JSON-encoded list columns decoded into arrays."""
    out = df
    for c in ("file_types", "chunk_types", "limitations"):
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            out = out.withColumn(c, F.from_json(c, T.ArrayType(T.StringType())))
    if "edge_types" in df.columns and isinstance(df.schema["edge_types"].dataType, T.StringType):
        out = out.withColumn("edge_types", F.from_json("edge_types", T.ArrayType(S.EDGE_TYPE_SPEC)))
    return out


def registry_to_json_columns(df: DataFrame) -> DataFrame:
    """the inverse, for tools that need the JSON-text layout."""
    out = df
    for c in ("file_types", "chunk_types", "limitations", "edge_types"):
        if c in df.columns:
            out = out.withColumn(c, F.to_json(c))
    return out

