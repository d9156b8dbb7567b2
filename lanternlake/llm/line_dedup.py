"""Site-relative line frequency.

Documents are grouped by host; a line is boilerplate of its host if over `ratio` of the host's pages hold it (and at least
`min_pages` do).  Boilerplate lines are dropped from every page of that host.  Pages that hold a line are counted once each,
as two 64-bit hashes of the line.

Defined results: a null host has no site, so its documents stay whole; a null text stays null; lines without a word are never
boilerplate; a document of boilerplate only stays whole (it is a copy, which near-duplicate removal judges, not page
furniture).  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialize, table

RATIO = 0.1
MIN_PAGES = 4


def _has_word(x: Column) -> Column:
    return F.translate(x, SPACES, "") != ""


def _key(x: Column) -> Column:
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))


def boilerplate_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row a host that has boilerplate: __host and the hashes of its boilerplate lines.

    A host's array is bounded: at most (mean lines of a page) / ratio lines can exceed the ratio.
    """
    pages = docs.filter(F.col(host).isNotNull()).select(F.col(host).alias("__host"), F.col(text).alias("__t"))
    totals = pages.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    keys = F.array_distinct(F.transform(F.filter(F.split(F.coalesce("__t", F.lit("")), "\n", -1), _has_word), _key))
    counts = pages.select("__host", F.explode(keys).alias("k")).groupBy("__host", "k").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_pages)
    found = counts.join(totals, "__host").filter(F.col("__n") > ratio * F.col("__pages"))
    return found.groupBy("__host").agg(F.collect_list("k").alias("__boiler"))


def drop_lines(docs: DataFrame, boiler: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """docs with their text cut, and with n_lines and n_dropped (long)."""
    out = docs.join(boiler, docs[host] == F.col("__host"), "left").drop("__host")
    lines = out.withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    keep = F.when(F.col("__boiler").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~(_has_word(x) & F.array_contains(F.col("__boiler"), _key(x)))))
    lines = lines.withColumn("__keep", keep)
    lines = lines.withColumn("__whole", ~F.exists("__keep", _has_word) | (F.size("__keep") == F.size("__lines")))
    n = F.size("__lines").cast("long")
    return lines.withColumns(
        {
            text: F.when(F.col("__whole"), F.col(text)).otherwise(F.array_join("__keep", "\n")),
            "n_lines": n,
            "n_dropped": F.when(F.col("__whole"), F.lit(0).cast("long")).otherwise(n - F.size("__keep")),
        }
    ).drop("__boiler", "__lines", "__keep", "__whole")


def dedup_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs without their hosts' boilerplate lines, with n_lines and n_dropped."""
    boiler = materialize(boilerplate_lines(docs, text, host, ratio, min_pages), "boiler")
    return drop_lines(docs, boiler, text, host)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
totals AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY source),
l AS (SELECT DISTINCT rid, source, line FROM (SELECT rid, source, unnest(ls) AS line FROM d WHERE source IS NOT NULL) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT source, line, count(*) AS n FROM l GROUP BY source, line HAVING count(*) >= 4),
b AS (SELECT c.source, list(line) AS boiler FROM c JOIN totals USING (source) WHERE n > 0.1 * pages GROUP BY c.source),
k AS (SELECT d.*, CASE WHEN boiler IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(boiler, x)) END AS keep FROM d LEFT JOIN b USING (source)),
j AS (SELECT *, (NOT regexp_matches(array_to_string(keep, chr(10)), '[^\x20\x09-\x0D]') OR len(keep) = len(ls)) AS whole FROM k)
SELECT doc_id, source, CAST(len(ls) AS BIGINT) AS n_lines, CAST(CASE WHEN whole THEN 0 ELSE len(ls) - len(keep) END AS BIGINT) AS n_dropped,
       CASE WHEN whole THEN text ELSE array_to_string(keep, chr(10)) END AS text FROM j
"""
