r"""Line dedup by site-relative frequency.

For every host the pages that contain a line are counted and divided by the
host's pages; a line above the boilerplate ratio is dropped from all pages of
that host.  Counting carries two 64-bit hashes of a line, not its text, and is
pre-aggregated before the shuffle, so a line on a third of all pages sends one
row per task.  A host has at most (average lines of a page / ratio) boilerplate
lines; they form one array per host, and each page filters its own lines
against its host's array.  The arrays are written first, so the planner knows
their size: it broadcasts a small table and otherwise sort-merge joins, where
AQE splits a host with very many pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

RATIO, MIN_PAGES = 0.1, 5


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(no_host, host, lines)``: the hashes of every host's boilerplate lines.

    ``pages``: no_host, host, lines.  A line counts once a page.  A line is
    boilerplate when it is on at least ``min_pages`` pages of the host and on more
    than ``ratio`` of them; blank lines never are.
    """
    key = ["no_host", "host"]
    line = F.explode(F.array_distinct(F.transform(F.filter("lines", lambda s: F.trim(s) != ""), _hash)))
    counts = (pages.select(*key, line.alias("line")).groupBy(*key, "line").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= min_pages))
    totals = pages.groupBy(*key).agg(F.count(F.lit(1)).alias("pages"))
    return (counts.join(totals, key).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
            .groupBy(*key).agg(F.collect_list("line").alias("lines")))


def drop_lines(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO,
               min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` plus ``clean_text``, ``n_lines`` and ``n_dropped``.

    Lines are parted by ``\n``.  A null text stays null with no lines; a null host
    is a host of its own; repeated rows are pages of their own.  A page that is
    boilerplate altogether stays with an empty text.  Other columns are kept as they are.
    """
    own = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns)}
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()],
                       host.isNull().alias("no_host"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                       F.split(text, "\n", -1).alias("lines"))
    bad = cut_lineage(boilerplate(base, ratio, min_pages)).withColumnRenamed("lines", "bad")
    kept = F.filter("lines", lambda s: ~F.coalesce(F.array_contains(F.col("bad"), _hash(s)), F.lit(False)))
    return (base.join(bad, ["no_host", "host"], "left")
            .withColumn("left", kept)
            .select(*[F.col(f"`{n}`").alias(c) for c, n in own.items()],
                    F.array_join("left", "\n").alias("clean_text"),
                    F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
                    F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("left")).cast("long").alias("n_dropped")))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line per block element.

    Scripts, styles and comments go; every tag becomes a line break, and runs of
    breaks and the blanks around them become one.
    """
    x = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "\n")
    x = F.regexp_replace(x, r"(?i)</?(?:b|i|u|em|strong|span|a|code|sup|sub)(?:\s[^>]*)?>", "")
    x = F.regexp_replace(x, r"<[^>]*>", "\n")
    x = F.regexp_replace(x, r"[ \t\r\n]*\n[ \t\r\n]*", "\n")
    return F.regexp_replace(x, r"^\n|\n$", "")
