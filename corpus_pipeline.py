"""The corpus pipeline: raw documents in, a mixed and encoded training corpus out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of their input.  ``run`` writes each stage's result as a
table in the shared folder and reads it again for the next stage, so a lost executor
repeats a part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard, langid, linededup, mixing, sptok
from graphloom.llm.common import table
from graphloom.session import cut_lineage

#: A document whose best language is less likely than this is no text of a known language.
MIN_SCORE = 0.3


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language; a missing lang is filled with the predicted one.

    Rejected are null texts, texts without a letter and texts whose best language
    scores less than ``MIN_SCORE``.
    """
    network = langid.fit(docs)
    told = docs.select(F.struct(*_columns(docs)).alias("row"), langid.predict(F.col("text"), network).alias("p"))
    kept = told.filter((F.col("p.lang_pred") != langid.UNKNOWN) & (F.col("p.score") >= MIN_SCORE))
    lang = F.coalesce(F.col("row.lang"), F.col("p.lang_pred")).alias("lang")
    return kept.select(*[lang if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are boilerplate of their source; every document stays."""
    names = docs.columns
    done = linededup.drop_lines(docs, F.col("source"), F.col("text"))
    done = done.toDF(*[f"c{i}" for i in range(len(done.columns))])
    clean = F.col(f"c{len(names)}")
    new = {"text": clean, "n_chars": F.coalesce(F.length(clean), F.lit(0)).cast("long")}
    return done.select(*[new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id.

    Five-word shingles, Jaccard similarity of 0.8 or more.  A document without words is in no group and stays.
    """
    groups = jaccard.jaccard_groups(docs, words=5, percent=80)
    gone = cut_lineage(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti").select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its target; a document may come twice."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document: doc_id, n_tokens, round_trip, ids."""
    return sptok.encode(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("sentencepiece", sentencepiece)]

#: A trained network and an encoder are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
