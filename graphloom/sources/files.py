"""File scans and registered extractors.

Files are read with Spark's ``binaryFile`` source (recursive, glob filter),
decoded as UTF-8 in the JVM, and handed in Arrow batches to the extractor
registered for their language (``mapInPandas``).  An extractor is a small
per-file function ``(path, text) -> list of chunk dicts``; an exception
becomes a reject row and the job goes on.  Ids are content-derived
(``sha256(path, chunk_type, qualified name)``), so a re-run agrees.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import ext_language, extension
from graphloom.operators.extract import INFRA_SELECTOR

EDGE = T.StructType([T.StructField("target", T.StringType()), T.StructField("type", T.StringType()),
                     T.StructField("confidence", T.StringType()),
                     T.StructField("evidence", T.StringType())])
CHUNKS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("chunk_type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("raw_cleaned", T.StringType()),
    T.StructField("edges", T.ArrayType(EDGE)),
    T.StructField("error_class", T.StringType()),
    T.StructField("error_message", T.StringType()),
])

Extractor = Callable[[str, str], list[dict]]


# ------------------------------------------------------------------ S1-S3 --

def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every file under ``root`` matching ``glob``: ``path, ext, language, text, valid_utf8``.

    An empty match gives an empty DataFrame, not an error.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).load(root))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select(F.col("path"), extension("path").alias("ext"),
                      ext_language(extension("path")).alias("language"),
                      F.coalesce(text, F.lit("")).alias("text"),
                      text.isNotNull().alias("valid_utf8"))


def sample_heads(files: DataFrame, n_chars: int = 2000) -> DataFrame:
    """S3: per language, the first ``n_chars`` characters of its first file (by path)."""
    first = files.groupBy("language").agg(F.min_by("text", "path").alias("text"),
                                          F.min("path").alias("path"))
    return first.select("language", "path", F.substring("text", 1, n_chars).alias("sample"))


# ------------------------------------------------------------- extractors --

def chunk_id(path: str, chunk_type: str, qualname: str) -> str:
    return hashlib.sha256(f"{path}\u0001{chunk_type}\u0001{qualname}".encode()).hexdigest()


def _edge(target, etype, conf="deterministic", evidence=""):
    return {"target": target, "type": etype, "confidence": conf, "evidence": evidence}


def python_extractor(path: str, text: str) -> list[dict]:
    """Modules, classes, functions and methods with IMPORTS, INHERITS,
    INJECTS (typed constructor parameters) and CALLS (attribute calls) edges.
    Edge targets are symbol names; J8 resolves them to nodes across files."""
    tree = ast.parse(text)
    module = path.rsplit("/", 1)[-1]
    out = []
    imports = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            imports += [_edge(a.name, "IMPORTS", evidence=f"from {node.module} import")
                        for a in node.names]
        elif isinstance(node, ast.Import):
            imports += [_edge(a.name, "IMPORTS", evidence="import") for a in node.names]
    out.append({"chunk_type": "module", "name": module, "raw_cleaned": text,
                "edges": imports})

    def calls(fn):
        seen = []
        for n in ast.walk(fn):
            if isinstance(n, ast.Call) and isinstance(n.func, (ast.Attribute, ast.Name)):
                called = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id
                if called not in seen:
                    seen.append(called)
        return [_edge(c, "CALLS", "probabilistic", "call") for c in seen]

    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def members(body):
        """Definitions of a body, those under if, try, with and loops included."""
        for x in body:
            if isinstance(x, (ast.ClassDef, *functions)):
                yield x
            else:
                for part in ("body", "orelse", "finalbody"):
                    yield from members(getattr(x, part, []))
                for handler in getattr(x, "handlers", []):
                    yield from members(handler.body)

    for node in members(tree.body):
        if isinstance(node, ast.ClassDef):
            edges = [_edge(ast.unparse(b).split(".")[-1], "INHERITS", evidence="base class")
                     for b in node.bases]
            for item in node.body:
                if isinstance(item, functions) and item.name == "__init__":
                    for a in item.args.args[1:]:
                        if a.annotation is not None:
                            edges.append(_edge(ast.unparse(a.annotation), "INJECTS",
                                               evidence=f"constructor parameter {a.arg}"))
            out.append({"chunk_type": "class", "name": node.name,
                        "raw_cleaned": ast.get_source_segment(text, node) or "", "edges": edges})
            for item in members(node.body):
                if isinstance(item, functions):
                    out.append({"chunk_type": "method", "name": f"{node.name}.{item.name}",
                                "raw_cleaned": ast.get_source_segment(text, item) or "",
                                "edges": [_edge(node.name, "BELONGS_TO")] + calls(item)})
        else:
            out.append({"chunk_type": "function", "name": node.name,
                        "raw_cleaned": ast.get_source_segment(text, node) or "",
                        "edges": calls(node)})
    return out


_TS_IMPORT = re.compile(r"import\s*\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]")
_TS_TYPE = re.compile(r"(?:export\s+)?(class|interface)\s+(\w+)(?:<[^{}]*?>)?(?:\s+extends\s+([\w, <>]+?))?"
                      r"(?:\s+implements\s+([\w, <>]+?))?\s*\{")
_TS_FUNCTION = re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", re.M)
_TS_CTOR = re.compile(r"constructor\s*\(([^)]*)\)")
_TS_PARAM = re.compile(r"(?:private|public|protected|readonly|\s)*\s*(\w+)\s*:\s*(\w+)")
_TS_METHOD = re.compile(r"^\s*(?:public |private |protected |async |static )*(\w+)\s*\([^)]*\)\s*(?::\s*[^{]+)?\{",
                        re.M)
_TS_CALL = re.compile(r"\.(\w+)\s*\(")


def _block(text: str, start: int) -> str:
    """Text from ``start`` to the brace closing the first ``{`` after it."""
    i = text.find("{", start)
    depth = 0
    for j in range(i, len(text)):
        if text[j] == "{":
            depth += 1
        elif text[j] == "}":
            depth -= 1
            if depth == 0:
                return text[start:j + 1]
    return text[start:]


def typescript_extractor(path: str, text: str) -> list[dict]:
    """X5 (regex level): classes/interfaces, methods; IMPORTS, INHERITS,
    IMPLEMENTS, INJECTS (constructor parameter types), CALLS.  Limits: no
    nested generics in heritage clauses, no decorators, no overloads."""
    module = path.rsplit("/", 1)[-1]
    imports = [_edge(n.strip(), "IMPORTS", evidence=f"from {m.group(2)}")
               for m in _TS_IMPORT.finditer(text) for n in m.group(1).split(",") if n.strip()]
    out = [{"chunk_type": "module", "name": module, "raw_cleaned": text, "edges": imports}]
    for m in _TS_FUNCTION.finditer(text):
        body = _block(text, m.start())
        out.append({"chunk_type": "function", "name": m.group(1), "raw_cleaned": body,
                    "edges": [_edge(x, "CALLS", "probabilistic", "call")
                              for x in dict.fromkeys(_TS_CALL.findall(body[body.find("{"):]))]})
    for m in _TS_TYPE.finditer(text):
        kind, name = m.group(1), m.group(2)
        body = _block(text, m.start())
        edges = [_edge(re.sub(r"<.*", "", b).strip(), "INHERITS", evidence="extends")
                 for b in (m.group(3) or "").split(",") if b.strip()]
        edges += [_edge(re.sub(r"<.*", "", b).strip(), "IMPLEMENTS", evidence="implements")
                  for b in (m.group(4) or "").split(",") if b.strip()]
        c = _TS_CTOR.search(body)
        if c:
            edges += [_edge(p.group(2), "INJECTS", evidence=f"constructor parameter {p.group(1)}")
                      for p in _TS_PARAM.finditer(c.group(1))]
        out.append({"chunk_type": kind, "name": name, "raw_cleaned": body, "edges": edges})
        if kind == "class":
            inner = body[body.find("{") + 1:]
            for mm in _TS_METHOD.finditer(inner):
                if mm.group(1) in ("if", "for", "while", "switch", "constructor", "catch"):
                    continue
                mb = _block(inner, mm.start())
                called = list(dict.fromkeys(_TS_CALL.findall(mb[mb.find("{"):])))
                out.append({"chunk_type": "method", "name": f"{name}.{mm.group(1)}",
                            "raw_cleaned": mb.strip(),
                            "edges": [_edge(name, "BELONGS_TO")]
                            + [_edge(x, "CALLS", "probabilistic", "call") for x in called]})
    return out


_SCSS_VAR = re.compile(r"^\s*\$([\w-]+)\s*:[^;]*;?", re.M)
_SCSS_MIXIN = re.compile(r"@mixin\s+([\w-]+)")
_SCSS_IMPORT = re.compile(r"@(?:import|use)\s+['\"]([^'\"]+)['\"]")
_SCSS_INCLUDE = re.compile(r"@include\s+([\w-]+)")
_SCSS_EXTEND = re.compile(r"@extend\s+([^;]+);")
_SCSS_VAR_USE = re.compile(r"\$([\w-]+)")
_SCSS_BEM = re.compile(r"&(__[\w-]+|--[\w-]+)\s*\{")


def _top_level_rules(text: str) -> list[tuple[str, str]]:
    """(selector, block) of each top-level style rule (brace matching, comments removed)."""
    clean = re.sub(r"/\*.*?\*/|//[^\n]*", "", text, flags=re.S)
    rules, depth, start = [], 0, 0
    for i, ch in enumerate(clean):
        if ch == "{":
            if depth == 0:
                sel = clean[start:i].strip().split(";")[-1].strip()
                sel_start = i
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                if not sel.startswith("@"):
                    rules.append((sel, clean[sel_start:i + 1]))
                start = i + 1
        elif ch == ";" and depth == 0:
            start = i + 1
    return rules


def scss_extractor(path: str, text: str) -> list[dict]:
    """X3 + X7: variables, mixins, imports, top-level style rules, BEM elements;
    IMPORTS, INCLUDES, EXTENDS (deterministic), STYLES (probabilistic), BELONGS_TO.
    ``*``/``html``/``body``/pseudo-element rules are ``infrastructure-rule``."""
    module = path.rsplit("/", 1)[-1]
    out = [{"chunk_type": "import", "name": m.group(1), "raw_cleaned": m.group(0),
            "edges": [_edge(m.group(1), "IMPORTS", evidence="@import")]}
           for m in _SCSS_IMPORT.finditer(text)]
    out += [{"chunk_type": "variable", "name": f"${m.group(1)}", "raw_cleaned": m.group(0).strip(),
             "edges": [_edge(module, "BELONGS_TO")]} for m in _SCSS_VAR.finditer(text)]
    out += [{"chunk_type": "mixin", "name": m.group(1), "raw_cleaned": _block(text, m.start()),
             "edges": [_edge(module, "BELONGS_TO")]} for m in _SCSS_MIXIN.finditer(text)]
    for sel, block in _top_level_rules(text):
        if re.match(INFRA_SELECTOR, sel):
            out.append({"chunk_type": "infrastructure-rule", "name": sel, "raw_cleaned": block,
                        "edges": []})
            continue
        edges = [_edge(x, "INCLUDES", evidence="@include") for x in _SCSS_INCLUDE.findall(block)]
        edges += [_edge(x.strip(), "EXTENDS", evidence="@extend") for x in _SCSS_EXTEND.findall(block)]
        edges += [_edge(f"${v}", "USES_VARIABLE", "deterministic", "variable")
                  for v in dict.fromkeys(_SCSS_VAR_USE.findall(block))]
        edges += [_edge(c, "STYLES", "probabilistic", "selector")
                  for c in dict.fromkeys(re.findall(r"\.([\w-]+)", sel)) or [sel]]
        out.append({"chunk_type": "style-rule", "name": sel, "raw_cleaned": block, "edges": edges})
        for e in _SCSS_BEM.finditer(block):
            out.append({"chunk_type": "bem-element", "name": sel + e.group(1),
                        "raw_cleaned": _block(block, e.start()),
                        "edges": [_edge(sel, "BELONGS_TO", evidence="BEM")]})
    return out


# Default extractor per language (users register their own).
DEFAULT_EXTRACTORS: dict[str, Extractor] = {
    "python": python_extractor,
    "typescript": typescript_extractor,
    "scss": scss_extractor,
}


def run_extractors(files: DataFrame,
                   extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """X1 + X2: chunk rows for every file whose language has an extractor.

    ``files(path, language, text[, valid_utf8])``; a file that is not valid UTF-8 is
    a reject row.  Output follows ``CHUNKS``: one row per
    chunk, or one reject row (``error_class`` set) per file that failed.
    Files without an extractor are not passed in (see ``match_extractors``).
    """
    ex = dict(DEFAULT_EXTRACTORS if extractors is None else extractors)
    langs = sorted(ex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, lang, text, valid in zip(pdf["path"], pdf["language"], pdf["text"], pdf["valid_utf8"]):
                try:
                    if not valid:
                        raise ValueError("not valid UTF-8")
                    seen: dict[tuple, int] = {}
                    for c in ex[lang](path, text or ""):
                        # chunks of one type and name (a property's getter and setter) are numbered
                        k = seen[c["chunk_type"], c["name"]] = seen.get((c["chunk_type"], c["name"]), 0) + 1
                        rows.append({"path": path,
                                     "node_id": chunk_id(path, c["chunk_type"], c["name"] if k == 1 else f"{c['name']}\u0001{k}"),
                                     "language": lang, "chunk_type": c["chunk_type"],
                                     "name": c["name"], "raw_cleaned": c.get("raw_cleaned", ""),
                                     "edges": c.get("edges", []), "error_class": None,
                                     "error_message": None})
                except Exception as err:  # noqa: BLE001 - a bad file is a reject row
                    rows.append({"path": path, "node_id": None, "language": lang,
                                 "chunk_type": None, "name": None, "raw_cleaned": None,
                                 "edges": [], "error_class": type(err).__name__,
                                 "error_message": str(err)})
            yield pd.DataFrame(rows, columns=CHUNKS.fieldNames())

    valid = F.coalesce(F.col("valid_utf8"), F.lit(True)) if "valid_utf8" in files.columns else F.lit(True)
    return (files.filter(F.col("language").isin(langs))
            .select("path", "language", "text", valid.alias("valid_utf8")).mapInPandas(run, CHUNKS))


def chunks_to_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split extractor output into ``(nodes, symbol references, rejects)``.

    Node rows carry ``source_file``; references ``(node_id, source_file,
    name, kind)`` feed J8 together with the definitions ``(node_id,
    source_file, name)`` taken from the nodes (the last segment of a
    qualified name is also a definition name).
    """
    ok = chunks.filter(F.col("error_class").isNull())
    nodes = ok.select("node_id", "language", F.col("path").alias("source_file"), "chunk_type",
                      "name", "raw_cleaned")
    refs = ok.select("node_id", F.col("path").alias("source_file"),
                     F.explode("edges").alias("e")).select(
        "node_id", "source_file", F.col("e.target").alias("name"), F.col("e.type").alias("kind"))
    rejects = chunks.filter(F.col("error_class").isNotNull()).select("path", "error_class",
                                                                     "error_message")
    return nodes, refs, rejects


def definitions(nodes: DataFrame) -> DataFrame:
    """Names under which a node can be referenced: full name, and a method's own name."""
    full = nodes.select("node_id", "source_file", F.col("name"))
    last = nodes.filter(F.col("chunk_type").isin("method") & F.col("name").contains(".")).select(
        "node_id", "source_file", F.element_at(F.split("name", r"\."), -1).alias("name"))
    return full.unionByName(last).filter(F.col("name").isNotNull())
