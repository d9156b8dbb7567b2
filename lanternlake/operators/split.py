"""Gold and silver splits: anti and semi joins, round-robin order, quotas, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .running import of_hash, running


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among keys."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def within(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def keep_first(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The first row of each key.  A partial aggregate, not a sort of each key's rows."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, "__row.*").select(*rows.columns)


def round_robin(rows: DataFrame, source: str, order: str) -> DataFrame:
    """rows with turn: the n-th rows of all sources come before the n+1-th; take them by (turn, source)."""
    name = F.coalesce(F.trim(F.col(source).cast("string")), F.lit("UNKNOWN_SOURCE"))
    return rows.withColumn(source, name).withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(order)))


def first_in_turn(rows: DataFrame, n: int, source: str, order: str) -> DataFrame:
    """The first n rows in round-robin order: sources are cut to n rows first, and the rest is a top-n, not a full sort."""
    return round_robin(rows, source, order).filter(F.col("turn") <= n).orderBy("turn", source).limit(n)


def legit_group(account: Column) -> Column:
    a = F.lower(F.coalesce(F.trim(account), F.lit("UNKNOWN_SOURCE")))
    return (
        F.when(a.isin(fixed.OFFICIAL_ACCOUNTS), "official_public")
        .when(a.isin(fixed.PRIVATE_ACCOUNTS), "private_university")
        .when(a.rlike("|".join(fixed.OFFICIAL_PARTS)), "official_public")
        .otherwise("private_university_unmapped")
    )


def quota_fill(rows: DataFrame, official: int, private: int, source: str, order: str, strict: bool = False) -> DataFrame:
    """Official accounts up to their quota (those without 'daad' first, each part in round-robin order); what is missing
    spills over to the private ones unless strict.  Adds legit_group."""
    rows = rows.withColumn("legit_group", legit_group(F.col(source)))
    is_official = F.col("legit_group") == "official_public"
    daad = F.contains(F.lower(F.col(source)), F.lit("daad")).cast("int")
    chosen = round_robin(rows.filter(is_official & (daad == 0)), source, order).withColumn("part", F.lit(0)).unionByName(round_robin(rows.filter(is_official & (daad == 1)), source, order).withColumn("part", F.lit(1)))
    chosen = chosen.filter(F.col("turn") <= official).orderBy("part", "turn", source).limit(official)
    missing = 0 if strict else max(0, official - chosen.count())  # a count of at most the quota
    return chosen.drop("part", "turn").unionByName(first_in_turn(rows.filter(~is_official), private + missing, source, order).drop("turn"))


def quota_stop(decisions: DataFrame, normal: int, suspicious: int, order: str, label: str = "label", group: str | None = None) -> DataFrame:
    """Decisions in order until both quotas are met; either may be exceeded meanwhile."""
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(1))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda x: F.coalesce(F.sum((F.col(label) == x).cast("int")).over(w), F.lit(0))
    return decisions.withColumns({"__a": seen("normal"), "__b": seen("suspicious")}).filter((F.col("__a") < normal) | (F.col("__b") < suspicious)).drop("__a", "__b")


def fold_decisions(log: DataFrame, order: str = "seq") -> DataFrame:
    """Decisions of a review log with undo: 'back' takes away the latest decision before it that still stands.

    Levels are running sums; a decision stands if its level isn't taken back later before it is passed again.
    """
    step = F.when(F.col("command") == "back", -1).when(F.col("command").startswith("label_") | (F.col("command") == "skip"), 1).otherwise(0)
    w = Window.partitionBy("reviewer").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    raw = F.sum(step).over(w)
    # backs on an empty stack do nothing: the lowest level so far is added back
    leveled = log.withColumn("__s", step).withColumn("__raw", raw).withColumn("__lvl", F.col("__raw") - F.least(F.lit(0), F.min("__raw").over(w)))
    later = Window.partitionBy("reviewer").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return leveled.withColumn("__low", F.min("__lvl").over(later)).filter((F.col("__s") == 1) & (F.coalesce("__low", "__lvl") >= F.col("__lvl"))).drop("__s", "__raw", "__lvl", "__low")


def subset_audit(gold: DataFrame, silver: DataFrame, key: str = "post_id") -> DataFrame:
    """One row: sizes, duplicates, shared and missing keys, and whether all gold keys are in silver."""
    g = gold.groupBy(key).agg(F.count(F.lit(1)).alias("g"))
    s = silver.groupBy(key).agg(F.count(F.lit(1)).alias("s"))
    both = g.join(s, key, "full_outer")
    some = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = both.agg(n("g").alias("gold_rows"), n("s").alias("silver_rows"), (n("g") - some(F.col("g").isNotNull())).alias("gold_duplicates"), (n("s") - some(F.col("s").isNotNull())).alias("silver_duplicates"), some(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("shared"), some(F.col("g").isNotNull() & F.col("s").isNull()).alias("missing"))
    return out.withColumn("is_subset", F.col("missing") == 0)


def fingerprint_stats(rows: DataFrame, fp: str) -> DataFrame:
    per = rows.groupBy(fp).agg(F.count(F.lit(1)).alias("n"))
    many = lambda x: F.coalesce(F.sum(F.when(F.col("n") > 1, x)), F.lit(0)).cast("long")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.count(F.lit(1)).alias("distinct_texts"), many(F.lit(1)).alias("duplicate_groups"), many(F.col("n")).alias("duplicate_rows"))


def fingerprint_overlap(left: DataFrame, right: DataFrame, fp: str, key: str, n: int = 20) -> DataFrame:
    """The first n shared fingerprints with both sides' keys.  Keys are gathered for those n only."""
    first = left.select(fp).distinct().join(right.select(fp).distinct(), fp).orderBy(fp).limit(n)
    ids = lambda d, name: d.join(F.broadcast(first), fp, "left_semi").groupBy(fp).agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias(name))
    return ids(left, "left_ids").join(ids(right, "right_ids"), fp)


def stratified_split(rows: DataFrame, label: str, order: str, share: float) -> DataFrame:
    """rows with is_validation: the first share of each class in order of a hash of the key."""
    h = F.md5(F.col(order).cast("string").cast("binary"))
    placed = running(rows.withColumn("__h", h), [label], of_hash(F.col("__h")), ["__h", order], {"__place": F.lit(1)}, {"__place": "__all"})
    return placed.withColumn("is_validation", (F.col("__place") <= F.ceil(share * F.col("__all"))).cast("int")).drop("__h", "__place", "__all")
