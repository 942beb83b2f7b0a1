"""Operator 5: drop lines that are boilerplate of their site (DataFrame
functions only).

A line of a page is boilerplate if, among the pages of the same host, the
share of pages that contain it exceeds ``RATIO`` and at least ``MIN_PAGES``
pages do.  Lines are compared without leading and trailing ASCII white
space; a line counts once a page; blank lines are neither counted nor
dropped.

Plan: pages send (host, 64-bit hash of the line) to one aggregation with
map-side combine, so a line of every page of a hot host arrives as one row
per task.  The boilerplate hashes of a host are an array of at most (lines
per page / RATIO) entries, joined back by host; the text itself is never
shuffled unless the table of hosts outgrows a broadcast, and then a hot host
is split by the adaptive skew join.  A hash is only ever confused with the
few boilerplate lines of its own host.

Defined cases: null text has no lines and stays null; null host is a host;
repeated rows are pages of their own; a page whose lines all go keeps its
row with an empty text; an empty table gives no rows; other columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.sqltext import SPACES
from glossa.llm.stages import staged

RATIO = 0.1
MIN_PAGES = 3


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages``: ``host``, ``lines`` -> ``host``, ``bad`` (hashes of its
    boilerplate lines), only hosts that have any."""
    keys = F.filter(F.array_distinct(F.transform("lines", _key)), lambda x: x != "")
    counts = (pages.select("host", F.explode(keys).alias("line"))
              .groupBy("host", F.xxhash64("line").alias("h")).agg(F.count(F.lit(1)).alias("n")))
    totals = pages.groupBy(F.col("host").alias("_h")).agg(F.count(F.lit(1)).alias("pages"))
    return (counts.filter(F.col("n") >= min_pages)
            .join(totals, F.col("host").eqNullSafe(F.col("_h")))
            .filter(F.col("n") > ratio * F.col("pages"))
            .groupBy("host").agg(F.collect_set("h").alias("bad")))


def drop_site_lines(rows: DataFrame, host: Column, text: Column, ratio: float = RATIO,
                    min_pages: int = MIN_PAGES) -> DataFrame:
    """``row`` (the input row as a struct), ``host``, ``lines`` and ``kept``
    (arrays of lines)."""
    pages = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
                        host.alias("host"), F.split(text, "\n").alias("lines"))
    bad = staged(boilerplate(pages, ratio, min_pages), "boilerplate").withColumnRenamed("host", "_bad_host")
    return (pages.join(bad, F.col("host").eqNullSafe(F.col("_bad_host")), "left")
            .select("row", "host", "lines", F.filter("lines", lambda x: ~F.coalesce(
                F.array_contains(F.col("bad"), F.xxhash64(_key(x))), F.lit(False))).alias("kept")))


def clean_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text",
                    chars_col: str | None = "n_chars", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines of their site gone from the text
    (and ``chars_col``, where there is one, counted anew)."""
    out = drop_site_lines(docs, F.col(host_col), F.col(text_col).cast("string"), ratio, min_pages)
    values = {text_col: F.array_join("kept", "\n")}
    if chars_col in docs.columns:
        values[chars_col] = F.length(values[text_col]).cast(docs.schema[chars_col].dataType)
    return out.select(*[values.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


# --- raw web pages: host and lines of text -----------------------------------

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|nav|header|footer|article|section|title|head|body"
         r"|html|main|aside|blockquote|pre)\b[^>]*>")
TAG = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def page_text(html: Column) -> Column:
    """Visible text of a page, one block element a line."""
    t = F.regexp_replace(html, HIDDEN, " ")
    t = F.regexp_replace(F.regexp_replace(t, BLOCK, "\n"), TAG, "")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    text = staged(pages.select("page_id", page_host(F.col("url")).alias("host"), page_text(F.col("html")).alias("text")),
                  "page_text")
    out = drop_site_lines(text, F.col("host"), F.col("text"))
    filled = lambda c: F.filter(c, lambda x: _key(x) != "")
    return out.select(F.col("row.page_id").alias("page_id"), "host",
                      F.size(filled("lines")).cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
                      F.md5(F.array_join(filled("kept"), "\n").cast("binary")).alias("kept_md5"))


def _sql_text(column: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace({column}, {q(HIDDEN)}, ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, {q(BLOCK)}, chr(10), 'g'), {q(TAG)}, '', 'g')"
    for entity, char in ENTITIES:
        t = f"replace({t}, {q(entity)}, {q(char)})"
    return t


_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP5_SQL = f"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host,
         string_split({_sql_text("html")}, chr(10)) AS lines
  FROM pages
),
k AS (SELECT DISTINCT page_id, host, {_TRIM.format("line")} AS line
      FROM (SELECT page_id, host, unnest(lines) AS line FROM p)),
c AS (SELECT host, line, count(*) AS n FROM k WHERE line <> '' GROUP BY ALL),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
bad AS (SELECT c.host, list(c.line) AS bad FROM c JOIN h USING (host)
        WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * h.pages GROUP BY c.host),
f AS (SELECT page_id, p.host, list_filter(lines, lambda x: {_TRIM.format("x")} <> '') AS filled,
             coalesce(bad, []) AS bad
      FROM p LEFT JOIN bad ON p.host = bad.host)
SELECT page_id, host, len(filled)::BIGINT AS n_lines,
       (len(filled) - len(list_filter(filled, lambda x: NOT list_contains(bad, {_TRIM.format("x")}))))::BIGINT AS n_dropped,
       md5(array_to_string(list_filter(filled, lambda x: NOT list_contains(bad, {_TRIM.format("x")})), chr(10))) AS kept_md5
FROM f
"""
