"""Spans: overlap resolution, token labels to spans and back, votes over models, routing, exact-match metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .running import by_size, of_hash, running


def resolve_overlaps(spans: Column) -> Column:
    """Non-overlapping spans of array<struct<start,end,label,origin>>: higher priority of origin first, then longer ones; a
    span that is there twice keeps its best origin.  Ordered by start, end, label."""
    priority = lambda o: F.when(o == "manual", 4).when(o == "prediction-changed", 3).when(o == "prediction", 2).otherwise(1)
    keyed = F.array_sort(F.transform(spans, lambda s, i: F.struct((-priority(s["origin"])).alias("p"), (s["start"] - s["end"]).alias("n"), i.alias("i"), s.alias("s"))))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    kept = F.aggregate(keyed, F.slice(spans, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: meets(k, x["s"])), acc).otherwise(F.array_append(acc, x["s"])))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["label"].alias("c"), s.alias("s"))))
    return F.transform(ordered, lambda x: x["s"])


def valid_spans(spans: Column, text: Column, labels: list[str]) -> Column:
    return F.filter(spans, lambda s: s["label"].isin(labels) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)))


def decode_bio(tokens: DataFrame, keys: list[str], order: str = "tok_ix") -> DataFrame:
    """Tokens (start, end, bio, prob) to spans: gaps and islands.  A span begins at B- or where the label changes, and ends at O;
    tokens of no width count for nothing."""
    t = tokens.filter(F.col("start") < F.col("end")).withColumn("label", F.when(F.col("bio") != "O", F.substring("bio", 3, 1000)))
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.col("label").isNotNull() & (F.col("bio").startswith("B-") | ~F.col("label").eqNullSafe(F.lag("label").over(w)))
    t = t.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w)).filter("label IS NOT NULL")
    return t.groupBy(*keys, "island", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("prob").alias("score")).drop("island")


def encode_bio(tokens: DataFrame, spans: DataFrame, keys: list[str], order: str = "tok_ix") -> DataFrame:
    """Tokens with bio: the first span that overlaps a token; B- where the token begins with or before the span, or the token
    before has another span.  The join is on keys, the overlap a condition on top of them."""
    s = spans.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("label").alias("__l"))
    joined = tokens.join(s, keys).filter((F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")))
    first = joined.groupBy(*keys, order).agg(F.min_by(F.struct("__s", "__e", "__l"), F.struct("__s", "__e", "__l")).alias("span"))
    out = tokens.join(first, [*keys, order], "left")
    w = Window.partitionBy(*keys).orderBy(order)
    begins = (F.col("start") <= F.col("span.__s")) | ~F.col("span").eqNullSafe(F.lag("span").over(w))
    return out.withColumn("bio", F.when(F.col("span").isNull(), "O").otherwise(F.concat(F.when(begins, "B-").otherwise("I-"), F.col("span.__l")))).drop("span")


def vote_labels(spans: DataFrame, key: str, models: int, threshold: int | None = None) -> DataFrame:
    """key, label, votes (models with a span of the label), has, vote_rate, count_mean, texts."""
    need = models // 2 + 1 if threshold is None else threshold
    out = spans.groupBy(key, "label").agg(F.count_distinct("model").alias("votes"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.lower(F.trim("text")))).alias("texts"))
    return out.select(key, "label", "votes", (F.col("votes") >= need).cast("int").alias("has"), (F.col("votes") / models).alias("vote_rate"), (F.col("n") / models).alias("count_mean"), F.array_join("texts", "|").alias("texts"))


def vote_spans(spans: DataFrame, key: str, models: int, threshold: int | None = None) -> DataFrame:
    """Spans (start, end of the first model's) by label and normalised text that enough models found."""
    need = models // 2 + 1 if threshold is None else threshold
    norm = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    out = spans.groupBy(key, "label", norm.alias("norm")).agg(F.count_distinct("model").alias("vote_count"), F.min_by(F.struct("start", "end"), F.struct("model", "start", "end")).alias("first"))
    return out.filter(F.col("vote_count") >= need).select(key, "label", "norm", "first.start", "first.end", "vote_count", (F.col("vote_count") / models).alias("vote_rate"))


def feature_columns(votes: DataFrame, key: str) -> DataFrame:
    """One row a key with has_, ner_vote_rate_, ner_count_ and ner_ columns of all labels, from vote_labels()."""
    out = votes.groupBy(key).pivot("label", fixed.NER_LABELS).agg(F.max("has").alias("has"), F.max("vote_rate").alias("rate"), F.max("count_mean").alias("mean"), F.max("texts").alias("texts"))
    names = [(f"{x}_{a}", b.format(x), z) for x in fixed.NER_LABELS for a, b, z in (("has", "has_{}", 0), ("rate", "ner_vote_rate_{}", 0.0), ("mean", "ner_count_{}_mean", 0.0), ("texts", "ner_{}", ""))]
    return out.select(key, *[F.coalesce(F.col(a), F.lit(z)).alias(b) for a, b, z in names])


def route_predictions(silver: DataFrame, gold: DataFrame, held_out: DataFrame, ensemble: DataFrame, key: str = "post_id") -> DataFrame:
    """silver with prediction and its source: held-out for gold posts that have one, else the ensemble."""
    last = held_out.groupBy(key).agg(F.max_by("prediction", "fold").alias("oof"), F.max("fold").alias("fold"))
    g = gold.select(key).distinct().withColumn("in_gold", F.lit(True))
    out = silver.join(g, key, "left").join(last, key, "left").join(ensemble.withColumnRenamed("prediction", "ens"), key, "left")
    source = F.when(F.col("in_gold") & F.col("oof").isNotNull(), "oof_heldout_fold").when(F.col("in_gold"), "ensemble_fallback_for_missing_oof").otherwise("caption_5fold_ensemble")
    return out.withColumn("source", source).withColumn("prediction", F.when(F.col("source") == "oof_heldout_fold", F.col("oof")).otherwise(F.col("ens"))).drop("in_gold", "oof", "ens").withColumn("fold", F.when(F.col("source") == "oof_heldout_fold", F.col("fold")))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def span_metrics(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """By label and for MICRO and MACRO: tp, fp, fn, precision, recall, f1 of exact spans.  Spans with a null are nobody's match.

    Both sides are grouped together, in as many parts as their size asks for, so that a task's memory doesn't grow with them.
    """
    on = [key, "start", "end", "label"]
    side = lambda rows, g: rows.select(*on, F.lit(g).alias("g"), F.lit(1 - g).alias("p"), F.when(F.greatest(*[F.col(c).isNull() for c in on]), F.lit(g)).alias("__of"))
    both = by_size(side(gold, 1).union(side(predicted, 0)), *on).groupBy(*on, "__of").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    g, p = F.col("g") == 1, F.col("p") == 1
    names = ["tp", "fp", "fn", "precision", "recall", "f1"]
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = both.groupBy("label").agg(count(g & p, "tp"), count(~g & p, "fp"), count(g & ~p, "fn")).withColumns(prf(tp, fp, fn)).select("label", *names)
    one = rows.agg(F.collect_list(F.struct("label", *names)).alias("rows"), *[F.sum(c).alias(c) for c in names[:3]], *[F.avg(c).alias(f"mean_{c}") for c in names[3:]]).withColumns(prf(tp, fp, fn))
    micro = F.struct(F.lit("MICRO").alias("label"), *names)
    macro = F.struct(F.lit("MACRO").alias("label"), *names[:3], *[F.col(f"mean_{c}").alias(c) for c in names[3:]])
    return one.select(F.inline(F.concat("rows", F.array(micro, macro))))


def relation_metrics(rows: DataFrame, labels: list[str], threshold: float = 0.5) -> DataFrame:
    """rows with true_<label> (0/1) and p_<label>: P/R/F1 and support by label."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"true_{x}").alias("y"), (F.col(f"p_{x}") >= threshold).cast("int").alias("h")) for x in labels]))
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    y, h = F.col("y") == 1, F.col("h") == 1
    per = rows.select(each.alias("x")).select("x.*").groupBy("label").agg(count(y & h, "tp"), count(~y & h, "fp"), count(y & ~h, "fn"), count(y, "support"))
    return per.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def group_folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """rows with fold: all rows of a group in one fold, folds balanced by rows.

    Groups are dealt in falling order of size (equal ones by hash), back and forth over the folds: not a driver loop.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    hashed = sizes.withColumn("__h", F.md5(F.col(group).cast("string").cast("binary")))
    per_size = running(hashed, ["n"], of_hash(F.coalesce("__h", F.lit("000"))), ["__h", group], {"i": F.lit(1)}).withColumn("i", F.col("i") - 1)
    # groups of equal size are dealt in turn; where each size begins is a running count over distinct sizes, which are few
    starts = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("n", "before")
    place = F.col("before") + F.col("i")
    turn = place % (2 * k)
    dealt = per_size.join(starts, "n").select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
    return rows.join(dealt, group)


def fold_average(metrics: DataFrame, by: str = "label") -> DataFrame:
    return metrics.groupBy(by).agg(F.avg("support").alias("support_mean"), F.sum("support").alias("support_sum"), *[F.avg(c).alias(f"{c}_mean") for c in ("precision", "recall", "f1")], F.stddev_samp("f1").alias("f1_std"))
