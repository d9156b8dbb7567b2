"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash; a document's virtual finish time is the source's cumulative size up to
it over the source's target.  A source is gone through up to three times.  All copies are sorted globally by finish time and
the mix takes them until the budget, the sum of all sizes, is spent.  DataFrame functions only.

Nothing is sorted in one task: cumulative sizes are sums over 4096 hash buckets of a source plus a window within the bucket,
and the global cut is found from the totals of finish-time buckets, then of buckets within the one that holds the cut.

Defined results: null texts have size 0 and are never taken; a null source is a source of its own and is the last in order;
null or repeated ids and repeated rows are separate documents; equal shuffle keys are ordered by size; an empty table gives
an empty result.  Reruns agree, as every order is by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_count, materialize, scratch, table, words

SEED = 17
MAX_REPEATS = 3
#: Weights of sources by position, repeating (fixed by the contract).
WEIGHTS = (1, 2, 3)
BUCKETS = 4096


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: one row a source (source, source_size).  Adds src_rank, weight and target.

    A target is min(cap, level * weight) with cap three times the source's size; the level is the one at which targets sum up
    to all sizes, which is where capping and resharing by weight ends.  The table has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("src_rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src_rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (MAX_REPEATS * F.col("source_size")).cast("long"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.withColumns({"__capped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "__open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)), "__total": F.sum("source_size").over(whole)})
    # the sources before a row in ratio order are capped; the first row whose level stays within its cap is where capping ends
    ranked = ranked.withColumn("__level", (F.col("__total") - F.col("__capped")) / F.col("__open"))
    ranked = ranked.withColumn("__at", F.min(F.when(F.col("__level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "src_rank", "__level"))).over(whole)["__level"])
    return ranked.select("source", "source_size", "src_rank", "weight", F.least(F.col("cap").cast("double"), F.col("__at") * F.col("weight")).alias("target"))


def shuffle_key(doc_id: Column, source: Column, text: Column) -> Column:
    """Seeded shuffle key of a document, equal for equal (id, source, text) only."""
    null = F.lit("null")
    parts = [F.coalesce(doc_id.cast("string"), null), F.coalesce(source.cast("string"), null), F.md5(F.coalesce(text, F.lit("")).cast("binary"))]
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *parts).cast("binary"))


def cumulative(rows: DataFrame) -> DataFrame:
    """rows (source, key, size, ...) with cum, the source's cumulative size in order of (key, size)."""
    rows = rows.withColumn("__b", F.substring("key", 1, 3))
    totals = rows.groupBy("source", "__b").agg(F.sum("size").alias("__n"))
    before = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("__s"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("source", "__b").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(offsets, rows["source"].eqNullSafe(F.col("__s")) & (rows["__b"] == F.col("__c")))
    return out.withColumn("cum", F.col("__before") + F.sum("size").over(inner)).drop("__s", "__c", "__before", "__b")


def virtual_times(rows: DataFrame) -> DataFrame:
    """rows with epoch (0, 1, 2) and finish; one row a copy.  Documents of size 0 have none."""
    copies = rows.filter(F.col("size") > 0).withColumn("epoch", F.explode(F.array(*map(F.lit, range(MAX_REPEATS)))))
    return copies.withColumn("finish", (F.col("cum") + F.col("epoch") * F.col("source_size")) / F.col("target"))


def cut(rows: DataFrame, budget: int) -> tuple[float, int] | None:
    """(finish, src_rank) of the last copy in global order with which the total stays within the budget."""
    copies = virtual_times(rows).select("finish", "src_rank", "size")
    span, low, spent = 4.0, 0.0, 0  # finish times of 4 and over share the last bucket
    for _ in range(2):
        bucket = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(span / BUCKETS)), F.lit(BUCKETS - 1))
        totals = copies.groupBy(bucket.alias("b")).agg(F.sum("size").alias("n"))
        running = totals.withColumn("end", F.sum("n").over(Window.orderBy("b")))
        at = running.filter(F.col("end") + spent > budget).orderBy("b").select("b", (F.col("end") - F.col("n")).alias("before")).first()
        if at is None:
            break
        copies = copies.filter(bucket == at["b"])
        spent += at["before"]
        low, span = low + at["b"] * (span / BUCKETS), span / BUCKETS
    order = Window.orderBy("finish", "src_rank")
    fits = copies.withColumn("end", F.sum("size").over(order)).filter(F.col("end") + spent <= budget)
    last = fits.agg(F.max(F.struct("finish", "src_rank")).alias("m")).first()["m"]
    if last is None:  # the cut is at the bucket's start
        return (low, -1)
    return (last["finish"], last["src_rank"])


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: its id as doc_id, source, size, source_size, target and taken (words that the mix takes)."""
    key = shuffle_key(F.col(doc_id), F.col(source), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), key.alias("key"))
    with scratch(docs.sparkSession, file_count(docs)):
        rows = materialize(rows, "sizes")
        goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
        goal = goal.withColumnRenamed("source", "__src")
        rows = rows.join(goal, rows["source"].eqNullSafe(F.col("__src"))).drop("__src")
        rows = materialize(cumulative(rows), "virtual", keep=True)
    budget = rows.agg(F.sum("size")).first()[0] or 0
    at, rank = cut(rows, budget) if budget else (0.0, -1)
    finish = lambda e: (F.col("cum") + e * F.col("source_size")) / F.col("target")
    within = lambda e: ((finish(e) < F.lit(at)) | ((finish(e) == F.lit(at)) & (F.col("src_rank") <= rank))).cast("int")
    times = F.when(F.col("size") > 0, sum((within(e) for e in range(1, MAX_REPEATS)), within(0))).otherwise(F.lit(0))
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with each row as often as the mix takes it (0 to 3 times).

    Rows of one key are equal in id, source and text: of m such rows that are taken t times in all, each comes t // m times
    and the first t % m once more.
    """
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("__row"), shuffle_key(F.col(doc_id), F.col(source), F.col(text)).alias("__key"))
    takes = mix(docs, text, source, doc_id).groupBy("key").agg(F.sum("times").alias("__t"), F.count(F.lit(1)).alias("__m"))
    joined = rows.join(takes.filter("__t > 0"), rows["__key"] == F.col("key"))
    rest = F.col("__t") % F.col("__m")
    even = joined.filter(rest == 0).withColumn("__n", (F.col("__t") / F.col("__m")).cast("int"))
    odd = joined.filter(rest > 0).withColumn("__i", F.row_number().over(Window.partitionBy("__key").orderBy("__t")))
    odd = odd.withColumn("__n", F.floor(F.col("__t") / F.col("__m")).cast("int") + (F.col("__i") <= rest).cast("int")).drop("__i")
    both = even.unionByName(odd).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__n"))))
    return both.select("__row.*")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
                  md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(source, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src_rank FROM s0),
s2 AS (SELECT *, CAST(1 + src_rank % 3 AS BIGINT) AS weight, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, CAST(coalesce(sum(cap) OVER w, 0) AS DOUBLE) AS capped, CAST((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS open, CAST(sum(source_size) OVER () AS DOUBLE) AS total
       FROM s2 WINDOW w AS (ORDER BY cap / weight, src_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - capped) / open AS lvl FROM s3),
goal AS (SELECT source, source_size, src_rank, least(CAST(cap AS DOUBLE), (SELECT lvl FROM s4 WHERE lvl * weight <= cap ORDER BY cap / weight, src_rank LIMIT 1) * weight) AS target FROM s4),
c AS (SELECT d.*, source_size, src_rank, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source),
copies AS (SELECT c.*, e, (cum + e * source_size) / target AS finish FROM c, (VALUES (0), (1), (2)) AS v(e) WHERE size > 0),
fit AS (SELECT *, sum(size) OVER (ORDER BY finish, src_rank) AS ends FROM copies),
mixed AS (SELECT doc_id, source, key, size, cum, count(*) AS times FROM fit WHERE ends <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * coalesce(times, 0) AS BIGINT) AS taken
FROM c LEFT JOIN mixed m ON c.doc_id IS NOT DISTINCT FROM m.doc_id AND c.source IS NOT DISTINCT FROM m.source AND c.key = m.key AND c.size = m.size AND c.cum = m.cum
"""
