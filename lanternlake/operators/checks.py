"""Validations, fallbacks of cells and columns, and summaries of predictions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import null_safe

# ---------------------------------------------------------------------------------------------------- validations


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unknown_labels(rows: DataFrame, label: str, allowed: tuple[str, ...] = ("normal", "suspicious")) -> DataFrame:
    """Labels beyond the allowed ones, null included, and how often they occur."""
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("label").isNull() | ~F.col("label").isin(*allowed))


def small_classes(rows: DataFrame, label: str, folds: int) -> DataFrame:
    """Labels with fewer rows than folds."""
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < folds)


def require_none(found: DataFrame, what: str) -> None:
    """Raise ValueError, with up to five of them, if found has rows."""
    some = found.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {', '.join(str(tuple(r)) for r in some)}")


# ---------------------------------------------------------------------------------------------------- cells and columns


def decoded(content: Column) -> Column:
    """Text of a file's bytes: UTF-8, with or without a mark in front, else Latin-1."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\\ufeff", "")


def parsed_list(cell: Column) -> Column:
    """Parts of a list that is written with commas, semicolons or white space."""
    return F.filter(F.split(null_safe(cell), r"[,;\s]+"), lambda x: x != "")


def labels_in(cell: Column) -> Column:
    """Labels of entities in a cell that holds JSON, or the same with single quotes; none for other texts."""
    schema = "array<struct<label:string,labels:array<string>>>"
    read = lambda x: F.from_json(x, schema)
    rows = F.coalesce(read(cell), read(F.translate(cell, "'", '"')))
    found = F.flatten(F.transform(rows, lambda e: F.concat(F.coalesce(e["labels"], F.array().cast("array<string>")), F.when(e["label"].isNotNull(), F.array(e["label"])).otherwise(F.array().cast("array<string>")))))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def has_label(rows: DataFrame, label: str, entities: str = "ner_entities") -> Column:
    """0/1: has_<label> where that column exists, else whether the entities hold the label, else 0."""
    if f"has_{label}" in rows.columns:
        return (F.coalesce(F.col(f"has_{label}").cast("double"), F.lit(0.0)) >= 0.5).cast("int")
    return F.array_contains(labels_in(F.col(entities)), label).cast("int") if entities in rows.columns else F.lit(0)


def relation_score(rows: DataFrame, label: str) -> Column:
    """p_<label> where that column exists, else 1 where re_<label> is at least 0.5, else 0."""
    if f"p_{label}" in rows.columns:
        return F.coalesce(F.col(f"p_{label}").cast("double"), F.lit(0.0))
    return (F.coalesce(F.col(f"re_{label}").cast("double"), F.lit(0.0)) >= 0.5).cast("double") if f"re_{label}" in rows.columns else F.lit(0.0)


def first_column(columns: list[str], wanted: list[str]) -> str | None:
    """The first of wanted that a table has."""
    return next((c for c in wanted if c in columns), None)


def unseen(rows: DataFrame, ids: DataFrame, urls: DataFrame, key: str = "post_id", url: str = "post_url") -> DataFrame:
    """Rows whose key is not among ids and whose link is not among urls."""
    return rows.join(ids.select(key).distinct(), key, "left_anti").join(urls.select(url).distinct(), url, "left_anti").select(*rows.columns)


def payload(rows: DataFrame, columns: list[str]) -> Column:
    """JSON of those of columns that the table has, nulls included."""
    return F.to_json(F.struct(*[F.col(c) for c in columns if c in rows.columns]), {"ignoreNullFields": "false"})


def multi_hot(labels: Column, kinds: list[str]) -> Column:
    return F.array(*[F.array_contains(labels, k).cast("int") for k in kinds])


def bio_labels(kinds: list[str] = fixed.NER_LABELS) -> list[str]:
    """O, then B- and I- of each kind; a label's place is its number."""
    return ["O", *[f"{p}-{k}" for k in kinds for p in ("B", "I")]]


# ---------------------------------------------------------------------------------------------------- links


def post_id_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(null_safe(url), "/(?:p|reel)/([A-Za-z0-9_-]+)", 1), F.lit(""))


def shortcode(url: Column) -> Column:
    """Last part of a link's path."""
    return F.element_at(F.split(F.rtrim(F.regexp_replace(null_safe(url), r"\?.*$", ""), F.lit("/")), "/"), -1)


def first_link(text: Column) -> Column:
    return F.get(F.regexp_extract_all(null_safe(text), F.lit(r"https?://[^\s]+"), F.lit(0)), F.lit(0))


def raw_hashtags(text: Column) -> Column:
    """Tags with letters of any script, as they stand, each once."""
    return F.array_distinct(F.regexp_extract_all(null_safe(text), F.lit(r"(?U)#(\w+)"), F.lit(1)))


# ---------------------------------------------------------------------------------------------------- predictions and runs


def mean_relations(predictions: DataFrame, labels: list[str], key: str = "post_id", threshold: float = 0.5, order: str = "model") -> DataFrame:
    """One row a key of several models' p_<label>: the mean, and re_<label> where it reaches the threshold.

    A key's scores are added one after the other, in order: a mean that is the threshold itself falls to either side with the order
    in which its parts are rounded.
    """
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    each = predictions.select(key, F.count(F.lit(1)).over(so_far).alias("n_models"), *[F.avg(f"p_{x}").over(so_far).alias(f"p_{x}") for x in labels], F.lead(F.lit(1)).over(w).alias("__more"))
    return each.filter("__more IS NULL").drop("__more").withColumns({f"re_{x}": (F.col(f"p_{x}") >= threshold).cast("int") for x in labels})


def prediction_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name and total of 0/1 columns, in one pass."""
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in columns])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("total")) for c in ("rows", *columns)])))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """One row: n_pos, n_neg, and the weight of positives, at least 1."""
    n = lambda x: F.coalesce(F.sum((F.col(label) == x).cast("long")), F.lit(0))
    return rows.agg(n(1).alias("n_pos"), n(0).alias("n_neg")).withColumn("pos_weight", F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")), F.lit(1.0))))


def ranked(summary: DataFrame, by: tuple[str, ...] = ("f1", "macro_f1", "pr_auc"), within: str | None = None) -> DataFrame:
    """summary with place: falling metrics one after the other, nulls last; within a phase if given.  A row a model: a small table."""
    order = [F.col(c).desc_nulls_last() for c in by] + [F.col("model")]
    return summary.withColumn("place", F.row_number().over((Window.partitionBy(within) if within else Window.partitionBy(F.lit(1))).orderBy(*order)))


def best_epochs(epochs: DataFrame, run: str = "run", patience: int = 8) -> DataFrame:
    """One row a run of (run, epoch, f1, recall): the epoch at which training with patience stops, and the best one until then.

    An epoch is better if f1 + recall / 100 exceeds all before it; training stops after patience epochs without a better one.
    """
    w = Window.partitionBy(run).orderBy("epoch")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = epochs.withColumn("__s", F.col("f1") + F.col("recall") / 100)
    s = s.withColumn("__better", F.coalesce(F.col("__s") > F.max("__s").over(before), F.lit(True)))
    s = s.withColumn("__last", F.max(F.when(F.col("__better"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stops = s.groupBy(run).agg(F.coalesce(F.min(F.when(F.col("epoch") - F.col("__last") >= patience, F.col("epoch"))), F.max("epoch")).alias("stopped_at"))
    return s.join(stops, run).filter(F.col("__better") & (F.col("epoch") <= F.col("stopped_at"))).groupBy(run).agg(F.max("epoch").alias("best_epoch"), F.max("__s").alias("best_score"), F.first("stopped_at").alias("stopped_at"))


def stagnant_from(rounds: DataFrame, n: int, key: str = "account", order: str = "round", new: str = "new_links") -> DataFrame:
    """One row a key: the first round that ends n rounds without a new link; null if there is none."""
    w = Window.partitionBy(key).orderBy(order)
    last = rounds.withColumn("__sum", F.sum(new).over(w.rowsBetween(-(n - 1), 0))).withColumn("__i", F.row_number().over(w))
    return last.groupBy(key).agg(F.min(F.when((F.col("__sum") == 0) & (F.col("__i") >= n), F.col(order))).alias("stops_at"))

