"""Evaluation of binary scores: one pass of tied scores, then cumulative windows over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .running import of_score, running

NAMES = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "macro_f1", "weighted_f1"]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def bundle(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Metrics of a confusion matrix; a class without truth and predictions doesn't count in the macro mean."""
    n = tp + fp + fn + tn
    p, r, r0 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    there1, there0 = ((tp + fp + fn) > 0).cast("int"), ((tn + fp + fn) > 0).cast("int")
    classes = ((tp + fn) > 0).cast("int") + ((tn + fp) > 0).cast("int")
    return {
        "accuracy": ratio(tp + tn, n),
        "balanced_accuracy": ratio(r * ((tp + fn) > 0).cast("int") + r0 * ((tn + fp) > 0).cast("int"), classes),
        "precision": p,
        "recall": r,
        "f1": f1,
        "macro_f1": ratio(f1 + f0, there1 + there0),
        "weighted_f1": ratio(f1 * (tp + fn) + f0 * (tn + fp), n),
    }


def confusion(rows: DataFrame, by: list[str], y: str, predicted: Column) -> DataFrame:
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    pos, hit = F.col(y) == 1, predicted
    return rows.groupBy(*by).agg(count(pos & hit, "tp"), count(~pos & hit, "fp"), count(pos & ~hit, "fn"), count(~pos & ~hit, "tn"))


def metric_bundle(rows: DataFrame, by: list[str], y: str, score: str, threshold: float = 0.5) -> DataFrame:
    c = confusion(rows, by, y, F.col(score) >= threshold)
    return c.withColumns(bundle(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


def by_score(rows: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """One row a distinct score: n and pos, and the sums of those at or above it (cn, cp) and of all (n_all, p_all)."""
    ties = rows.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    return running(ties, by, of_score(F.col("s")), [F.desc("s")], {"cn": F.col("n"), "cp": F.col("pos")}, {"cn": "n_all", "cp": "p_all"})


def roc_auc(rows: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Area under ROC with ties counted half; null with one class only."""
    t = by_score(rows, by, y, score)
    neg = F.col("n") - F.col("pos")
    below = F.col("n_all") - F.col("cn") - (F.col("p_all") - F.col("cp"))  # negatives under the score
    out = t.groupBy(*by).agg(F.sum(F.col("pos") * (below + neg / 2.0)).alias("u"), F.max("p_all").alias("p"), F.max("n_all").alias("m"))
    return out.select(*by, F.try_divide(F.col("u"), F.col("p").cast("double") * (F.col("m") - F.col("p"))).alias("roc_auc"))


def average_precision(rows: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Step sum of precision over recall."""
    t = by_score(rows, by, y, score)
    return t.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("cp") / F.col("cn")), F.max("p_all").cast("double")).alias("average_precision"))


def threshold_grid(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """Distinct scores within [0, 1], 91 steps from 0.05 to 0.95, and 0.5."""
    lo, hi, n = fixed.THRESHOLD_GRID
    own = rows.select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))).alias("threshold"))
    steps = F.explode(F.concat(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(lo + i * ((hi - lo) / (n - 1)), 10)), F.array(F.lit(0.5))))
    return own.union(rows.select(*by).distinct().select(*by, steps.alias("threshold"))).distinct()


def threshold_sweep(rows: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Metrics at every candidate threshold: thresholds and scores are sorted together once, no threshold meets every row."""
    marks = threshold_grid(rows, by, score).select(*by, F.col("threshold").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.lit(1).alias("mark"))
    ties = rows.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos")).withColumn("mark", F.lit(0))
    both = running(ties.unionByName(marks), by, of_score(F.col("s")), [F.desc("s")], {"cn": F.col("n"), "tp": F.col("pos")}, {"cn": "n_all", "tp": "p_all"}, ties=True).filter("mark = 1")
    both = both.withColumns({"fp": F.col("cn") - F.col("tp"), "fn": F.col("p_all") - F.col("tp")})
    both = both.withColumn("tn", F.col("n_all") - F.col("cn") - F.col("fn"))
    return both.select(*by, F.col("s").alias("threshold"), "tp", "fp", "fn", "tn").withColumns(bundle(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


def choose_threshold(sweep: DataFrame, by: list[str], mode: str = "val_f1", min_precision: float = fixed.MIN_PRECISION) -> DataFrame:
    """The best threshold of each group; the lowest one wins ties."""
    c = F.col
    keys = {
        "fixed_05": [-F.abs(c("threshold") - 0.5)],
        "val_f1": [c("f1"), c("recall"), c("precision")],
        "balanced_accuracy": [c("balanced_accuracy"), c("f1"), c("recall")],
        "recall_at_precision": [F.when(c("precision") >= min_precision, c("recall")).otherwise(-1.0), c("f1"), c("precision")],
    }[mode]
    rounded = [F.round(k, 12) for k in keys]
    best = sweep.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct(*rounded, -c("threshold"))).alias("b"))
    return best.select(*by, "b.*")


def error_by_group(rows: DataFrame, by: list[str], y: str, predicted: Column, groups: list[str]) -> DataFrame:
    """Metrics by model and content group, ALL included; a row counts in each group whose column is 1."""
    flag = lambda g: F.coalesce(F.col(g).try_cast("int"), F.lit(0)) == 1
    each = F.array_compact(F.array(F.lit("ALL"), *[F.when(flag(g), F.lit(g)) for g in groups]))
    long = rows.withColumn("__hit", predicted).withColumn("content_group", F.explode(each))
    c = confusion(long, [*by, "content_group"], y, F.col("__hit"))
    return c.withColumn("support", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).withColumns(bundle(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


def summary(runs: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Runs, means and population deviations."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), *[f(c).alias(f"{c}_{k}") for c in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))])


def majority(train: DataFrame, y: str) -> DataFrame:
    """One row: the class that at least half of the training rows have, and its name as always."""
    return train.agg((F.avg(F.col(y).cast("double")) >= 0.5).cast("int").alias("prediction")).select(F.lit("majority_normal").alias("model"), "prediction")
