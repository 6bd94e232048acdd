"""User-registered extractors as table functions.

A user's function ``(path, text) -> chunk dicts`` is registered as a Python table
function, which SQL and DataFrames call in a lateral join: one call per file, any number of
rows per call.  A file that fails, is not valid UTF-8 or takes longer than the limit gives
one reject row and none of its chunks; the job goes on.  The chunks of one file are held
until the file is done, and nothing else is.
"""

from __future__ import annotations

import hashlib
import signal
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.sources.files import CHUNKS, EDGE

#: Seconds that an extractor may take for one file.
SECONDS = 30.0
#: What a table function returns for each chunk or reject.
FOUND = T.StructType([f for f in CHUNKS.fields if f.name not in ("path", "language")])

Extract = Callable[[str, str], Iterable[dict]]


def _rows(extract: Extract, path: str, text: str | None, valid: bool | None, seconds: float) -> list[tuple]:
    """The rows of one file: its chunks, or one reject row."""
    def late(*_):
        raise TimeoutError(f"more than {seconds:g} seconds")
    old = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        if valid is False:
            raise ValueError("not valid UTF-8")
        out, seen = [], {}
        for chunk in extract(path, text or ""):
            kind, name = chunk["chunk_type"], chunk["name"]
            # chunks of one type and name are numbered
            seen[kind, name] = k = seen.get((kind, name), 0) + 1
            whole = "\u0001".join([path or "", kind, name, *([str(k)] if k > 1 else [])])
            edges = [tuple(e.get(f.name) for f in EDGE.fields) for e in chunk.get("edges", [])]
            out.append((hashlib.sha256(whole.encode()).hexdigest(), kind, name, chunk.get("raw_cleaned", ""), edges, None, None))
        return out
    except Exception as error:  # noqa: BLE001 - a bad file is a reject row
        return [(None, None, None, None, [], type(error).__name__, str(error))]
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def register_extractor(spark: SparkSession, name: str, extract: Extract, seconds: float = SECONDS) -> str:
    """Registers ``extract`` as table function ``name(path, text, valid_utf8)`` of the session.

    Its dicts hold ``chunk_type`` and ``name`` and may hold ``raw_cleaned`` and ``edges`` (dicts of target, type,
    confidence, evidence).  Returns the name.
    """
    class Extractor:
        def eval(self, path: str, text: str, valid_utf8: bool):
            yield from _rows(extract, path, text, valid_utf8, seconds)

    spark.udtf.register(name, F.udtf(Extractor, returnType=FOUND))
    return name


def extract_files(files: DataFrame, functions: dict[str, str]) -> DataFrame:
    """Chunks and rejects (``CHUNKS``) of the files whose language has a table function.

    ``files(path, language, text[, valid_utf8])``, ``functions``: language to registered name.
    """
    spark = files.sparkSession
    valid = F.coalesce(F.col("valid_utf8"), F.lit(True)) if "valid_utf8" in files.columns else F.lit(True)
    files = files.select("path", "language", "text", valid.alias("valid_utf8"))
    out = spark.createDataFrame([], CHUNKS)
    for name in sorted(set(functions.values())):
        mine = files.filter(F.col("language").isin([lang for lang, f in functions.items() if f == name]))
        found = spark.sql(f"SELECT f.path, f.language, c.* FROM {{files}} f, LATERAL `{name}`(f.path, f.text, f.valid_utf8) c", files=mine)
        out = out.unionByName(found.select(*CHUNKS.fieldNames()))
    return out
