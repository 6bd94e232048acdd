"""Column functions for paths, languages, keywords and model-written JSON.

All are built-in Spark expressions (JVM side, whole-stage codegen); none is a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language, as used by the reference.
EXT_LANGUAGE = {
    "cs": "csharp",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "py": "python",
    "html": "html",
    "css": "css",
    "scss": "scss",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "proto": "protobuf",
}

EXT_PATTERN = r"\.([^./]+)$"
URL_PATH_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path) -> Column:
    """extension without the dot ('' when there is none)."""
    return F.regexp_extract(_c(path), EXT_PATTERN, 1)


def ext_language(ext) -> Column:
    """Language of an extension; an unknown extension passes through."""
    m = F.create_map(*[F.lit(x) for kv in EXT_LANGUAGE.items() for x in kv])
    return F.coalesce(m[_c(ext)], _c(ext))


def normalise_path(path) -> Column:
    """drop a ``file:`` scheme and leading ``./`` so paths compare equal."""
    p = F.regexp_replace(_c(path), r"^file:(//)?", "")
    return F.regexp_replace(p, r"^(\./)+", "")


def url_path(url) -> Column:
    """path part of a URL (no query, no fragment)."""
    return F.regexp_extract(_c(url), URL_PATH_PATTERN, 1)


def first_segment(path) -> Column:
    """first non-empty path segment ('' when none)."""
    return F.regexp_extract(_c(path), r"^/*([^/]*)", 1)


def any_keyword(text, keywords: list[str]) -> Column:
    """case-insensitive test whether any keyword occurs in the text."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    arr = F.array(*[F.lit(k.lower()) for k in keywords])
    return F.exists(arr, lambda k: F.contains(low, k))


# F5 -- repair of model-written JSON, as column expressions.
# A JSON string token with its escapes, possessive so long values cannot
# blow the regex stack; anything else is a run of non-quote characters.
JSON_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+\\?+(?:"|\z)|[^"]++'
TRIPLE_TOKEN = r'(?s)""".*?"""|[^"]++|"'


def strip_fence(text) -> Column:
    """Drop a leading ```lang line and a trailing ``` line, then trim."""
    t = F.trim(_c(text))
    lines = F.split(t, r"\r?\n")
    n = F.size(lines)
    last_is_fence = F.trim(F.element_at(lines, -1)) == "```"
    body = F.when(last_is_fence, F.slice(lines, 2, F.greatest(n - 2, F.lit(0))))\
        .otherwise(F.slice(lines, 2, F.greatest(n - 1, F.lit(0))))
    return F.when(t.startswith("```"), F.trim(F.array_join(body, "\n"))).otherwise(t)


def triple_quoted_to_json(text) -> Column:
    """Replace ``\"\"\"...\"\"\"`` by one JSON string with \\, \" and newline escaped."""
    toks = F.regexp_extract_all(_c(text), F.lit(TRIPLE_TOKEN), 0)

    def fix(tok):
        inner = F.substring(tok, 4, F.length(tok) - 6)
        esc = F.replace(F.replace(F.replace(inner, F.lit("\\"), F.lit("\\\\")),
                                  F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        is_triple = tok.startswith('"""') & (F.length(tok) >= 6) & tok.endswith('"""')
        return F.when(is_triple, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(tok)
    return F.array_join(F.transform(toks, fix), "")


def escape_controls_in_strings(text) -> Column:
    """Escape raw newline / CR / tab inside JSON strings, leave escaped pairs alone."""
    toks = F.regexp_extract_all(_c(text), F.lit(JSON_TOKEN), 0)

    def fix(tok):
        esc = F.replace(F.replace(F.replace(tok, F.lit("\n"), F.lit("\\n")),
                                  F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
        return F.when(tok.startswith('"'), esc).otherwise(tok)
    return F.array_join(F.transform(toks, fix), "")


def repair_json(raw) -> Column:
    """fence strip -> triple-quote fix -> control-character escaping."""
    return escape_controls_in_strings(triple_quoted_to_json(strip_fence(raw)))
