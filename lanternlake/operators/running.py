"""Running sums and places within groups of any size, without a task that holds a whole group.

A group's rows are parted into buckets that follow the order.  Buckets' totals are few: what lies before a bucket is a window
over them, and what lies before a row in its bucket is a window over the bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group, about.
BUCKETS = 4096


def of_hash(hex_text: Column) -> Column:
    """Bucket of a hexadecimal hash, in its order."""
    return F.conv(F.substring(hex_text, 1, 3), 16, 10).cast("int")


def of_score(score: Column) -> Column:
    """Bucket of a score, falling; those under 0 and over 1 are in the end buckets."""
    return F.floor((1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))) * (BUCKETS - 1)).cast("int")


def running(rows: DataFrame, by: list[str], bucket: Column, order: list, sums: dict[str, Column], totals: dict[str, str] | None = None, ties: bool = False) -> DataFrame:
    """rows with running sums (up to and with each row) within by, in order; equal places count together if ties.

    bucket: a small whole number that doesn't fall in that order, equal for ties.  totals: name of a sum's total over by, by the sum's name.
    """
    totals = totals or {}
    keyed = rows.withColumns({"__b": bucket, **{f"__v_{k}": v for k, v in sums.items()}})
    per = keyed.groupBy(*by, "__b").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    found = {f"__o_{k}": F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)) for k in sums} | {out: F.sum(f"__t_{k}").over(group) for k, out in totals.items()}
    offsets = per.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__b").alias("__kb"), *[v.alias(k) for k, v in found.items()])
    on = reduce(lambda a, b: a & b, [keyed[c].eqNullSafe(offsets[f"__k_{c}"]) for c in by], keyed["__b"] == offsets["__kb"])
    w = Window.partitionBy(*by, "__b").orderBy(*order)
    inner = w.rangeBetween(Window.unboundedPreceding, 0) if ties else w.rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(offsets, on).withColumns({k: F.col(f"__o_{k}") + F.sum(f"__v_{k}").over(inner) for k in sums})
    return out.select(*rows.columns, *sums, *totals.values())


#: Bytes of a plan's estimate (of compressed columns) that one part of by_size() gets, and an estimate that is none.
PART, UNKNOWN = 1 << 22, 1 << 50


def by_size(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over parts by keys, one for PART bytes of what they are estimated at; left alone where the session's shuffle
    partitions are enough, or nothing is known of the size."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(1 << 14, size // PART)
    return rows.repartition(parts, *keys) if size < UNKNOWN and parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
