"""Queries of spans, votes, folds, metrics, features, models and event state, with their SQL.

Events stand for tokens, order lines for spans and scored rows: many rows, ties, and a key with several rows each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as T
from ..operators import metrics as M
from ..operators import spans as N
from ..operators import split as S
from ..streaming import state as ST

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle is not None:
            O[name] = oracle
        return f

    return add


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------------------------------------------- spans

_TOK = "t AS (SELECT user_id AS id, event_id AS tok_ix, CAST(event_id * 10 AS INT) AS start, CAST(event_id * 10 + CASE WHEN event_id % 7 = 0 THEN 0 ELSE 8 END AS INT) AS \"end\", CASE (event_id * event_id + user_id) % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'B-COST_CLAIM' WHEN 2 THEN 'I-COST_CLAIM' WHEN 3 THEN 'I-OUTCOME' ELSE 'B-OUTCOME' END AS bio, value AS prob FROM events)"


def tokens(spark, sf):
    n = F.col("event_id")
    k = (n * n + F.col("user_id")) % 5
    bio = F.when(k == 0, "O").when(k == 1, "B-COST_CLAIM").when(k == 2, "I-COST_CLAIM").when(k == 3, "I-OUTCOME").otherwise("B-OUTCOME")
    width = F.when(n % 7 == 0, 0).otherwise(8)
    return read(spark, sf, "events").select(F.col("user_id").alias("id"), n.alias("tok_ix"), (n * 10).cast("int").alias("start"), (n * 10 + width).cast("int").alias("end"), bio.alias("bio"), F.col("value").alias("prob"))


_BIO = f"""{_TOK}, v AS (SELECT *, CASE WHEN bio <> 'O' THEN substring(bio, 3) END AS label FROM t WHERE start < "end"), w AS (SELECT *, CAST(label IS NOT NULL AND (starts_with(bio, 'B-') OR label IS DISTINCT FROM lag(label) OVER (PARTITION BY id ORDER BY tok_ix)) AS INT) AS nw FROM v), i AS (SELECT *, sum(nw) OVER (PARTITION BY id ORDER BY tok_ix) AS island FROM w), b AS (SELECT id, label, min(start) AS start, max("end") AS "end", avg(prob) AS score FROM i WHERE label IS NOT NULL GROUP BY id, island, label)"""


@query("bio_islands", f'WITH {_BIO} SELECT id, label, start, "end", round(score, 6) AS score FROM b')
def bio_islands(spark, sf):
    return N.decode_bio(tokens(spark, sf), ["id"]).withColumn("score", F.round("score", 6))


@query(
    "bio_encode",
    f"""WITH {_BIO}, g AS (SELECT id, start + 3 AS start, "end" AS "end", label FROM b), f AS (SELECT t.id, t.tok_ix, min({{'s': g.start, 'e': g."end", 'l': g.label}}) AS sp FROM t JOIN g ON t.id = g.id AND t.start < g."end" AND g.start < t."end" GROUP BY 1, 2), o AS (SELECT t.id, t.tok_ix, t.start, f.sp, lag(f.sp) OVER (PARTITION BY t.id ORDER BY t.tok_ix) AS before FROM t LEFT JOIN f ON t.id = f.id AND t.tok_ix = f.tok_ix) SELECT id, tok_ix, CASE WHEN sp IS NULL THEN 'O' ELSE (CASE WHEN start <= sp.s OR sp IS DISTINCT FROM before THEN 'B-' ELSE 'I-' END) || sp.l END AS bio FROM o""",
)
def bio_encode(spark, sf):
    t = tokens(spark, sf)
    spans = N.decode_bio(t, ["id"]).withColumn("start", F.col("start") + 3)
    return N.encode_bio(t.drop("bio"), spans, ["id"]).select("id", "tok_ix", "bio")


@query("span_overlap_greedy")
def span_overlap_greedy(spark, sf):
    """Spans of order lines that overlap in many ways; tests hold the result against a plain loop."""
    n = F.col("l_quantity").cast("int")
    origin = F.when(F.col("l_partkey") % 3 == 0, "manual").when(F.col("l_partkey") % 3 == 1, "prediction")
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(n.alias("start"), (n + 5 + F.col("l_linenumber")).cast("int").alias("end"), F.concat(F.lit("L"), F.col("l_suppkey") % 3).alias("label"), origin.alias("origin")))).alias("spans"))
    return rows.select("id", F.inline(N.resolve_overlaps(F.col("spans"))))


_MODELS = "m AS (SELECT l_orderkey AS id, CAST(l_linenumber % 5 AS INT) AS model, CASE l_suppkey % 3 WHEN 0 THEN 'COST_CLAIM' WHEN 1 THEN 'OUTCOME' ELSE 'DESTINATION' END AS label, CASE l_partkey % 2 WHEN 0 THEN ' Free Tuition' ELSE 'visa' END AS text, CAST(l_quantity AS INT) AS start, CAST(l_quantity + 7 AS INT) AS \"end\" FROM lineitem)"


def model_spans(spark, sf):
    k = F.col("l_suppkey") % 3
    n = F.col("l_quantity")
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_linenumber") % 5).cast("int").alias("model"),
        F.when(k == 0, "COST_CLAIM").when(k == 1, "OUTCOME").otherwise("DESTINATION").alias("label"),
        F.when(F.col("l_partkey") % 2 == 0, " Free Tuition").otherwise("visa").alias("text"),
        n.cast("int").alias("start"),
        (n + 7).cast("int").alias("end"),
    )


@query("vote_aggregate", f"WITH {_MODELS} SELECT id, label, count(DISTINCT model) AS votes, CAST(count(DISTINCT model) >= 2 AS INT) AS has, count(DISTINCT model) / 5 AS vote_rate, count(*) / 5 AS count_mean, array_to_string(list_sort(list(DISTINCT lower(trim(text)))), '|') AS texts FROM m GROUP BY id, label")
def vote_aggregate(spark, sf):
    return N.vote_labels(model_spans(spark, sf), "id", 5, 2)


@query("span_votes", f"WITH {_MODELS}, g AS (SELECT id, label, lower(trim(text)) AS norm, count(DISTINCT model) AS vote_count, min({{'m': model, 's': start, 'e': \"end\"}}) AS f FROM m GROUP BY ALL) SELECT id, label, norm, f.s AS start, f.e AS \"end\", vote_count, vote_count / 5 AS vote_rate FROM g WHERE vote_count >= 2")
def span_votes(spark, sf):
    return N.vote_spans(model_spans(spark, sf), "id", 5, 2)


@query("ner_features", f"WITH {_MODELS}, v AS (SELECT id, label, count(DISTINCT model) AS votes, count(*) AS n FROM m GROUP BY ALL) SELECT id, coalesce(max(CASE WHEN label = 'COST_CLAIM' THEN CAST(votes >= 2 AS INT) END), 0) AS \"has_COST_CLAIM\", coalesce(max(CASE WHEN label = 'OUTCOME' THEN votes / 5 END), 0.0) AS \"ner_vote_rate_OUTCOME\", coalesce(max(CASE WHEN label = 'DESTINATION' THEN n / 5 END), 0.0) AS \"ner_count_DESTINATION_mean\" FROM v GROUP BY id")
def ner_features(spark, sf):
    votes = N.vote_labels(model_spans(spark, sf), "id", 5, 2)
    return N.feature_columns(votes, "id").select("id", "has_COST_CLAIM", "ner_vote_rate_OUTCOME", "ner_count_DESTINATION_mean")


_PAIR = f"""{_MODELS}, gold AS (SELECT DISTINCT id, start, "end", label FROM m WHERE model <> 1), pred AS (SELECT DISTINCT id, start, "end", label FROM m WHERE model <> 2), fo AS (SELECT coalesce(g.label, p.label) AS label, g.id IS NOT NULL AS g, p.id IS NOT NULL AS p FROM gold g FULL JOIN pred p ON g.id = p.id AND g.start = p.start AND g."end" = p."end" AND g.label = p.label),
c AS (SELECT label, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM fo GROUP BY label), x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c), y AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM x)"""


@query(
    "span_metrics",
    f"WITH {_PAIR}, mi AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c), mj AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM mi), al AS (SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, precision, recall, f1 FROM y UNION ALL SELECT 'MICRO', CAST(tp AS BIGINT), CAST(fp AS BIGINT), CAST(fn AS BIGINT), precision, recall, 2 * precision * recall / (precision + recall) FROM mj UNION ALL SELECT 'MACRO', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), avg(precision), avg(recall), avg(f1) FROM y) SELECT label, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM al",
)
def span_metrics(spark, sf):
    m = model_spans(spark, sf)
    out = N.span_metrics(m.filter("model <> 1"), m.filter("model <> 2"), "id")
    return out.select("label", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "relation_metrics",
    "WITH r AS (SELECT 'A' AS label, CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_discount * 10 >= 0.5 AS INT) AS h FROM lineitem UNION ALL SELECT 'B', CAST(l_linestatus = 'O' AS INT), CAST(l_tax * 10 >= 0.5 AS INT) FROM lineitem), c AS (SELECT label, sum(y * h) AS tp, sum((1 - y) * h) AS fp, sum(y * (1 - h)) AS fn, sum(y) AS support FROM r GROUP BY label), p AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c) SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(support AS BIGINT) AS support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall), 9) AS f1 FROM p",
)
def relation_metrics(spark, sf):
    rows = read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("true_A"), (F.col("l_linestatus") == "O").cast("int").alias("true_B"), (F.col("l_discount") * 10).alias("p_A"), (F.col("l_tax") * 10).alias("p_B"))
    out = N.relation_metrics(rows, ["A", "B"])
    return out.select("label", "tp", "fp", "fn", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "oof_routing",
    "WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS post_id FROM documents), g AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS post_id FROM labels), o AS (SELECT CAST(doc_id AS VARCHAR) AS post_id, arg_max('oof' || f, f) AS oof, max(f) AS fold FROM (SELECT doc_id, CAST(doc_id % 5 AS INT) AS f FROM labels WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, CAST(doc_id % 5 + 5 AS INT) FROM labels WHERE doc_id % 8 = 1) GROUP BY doc_id) SELECT s.post_id, CASE WHEN g.post_id IS NOT NULL AND oof IS NOT NULL THEN 'oof_heldout_fold' WHEN g.post_id IS NOT NULL THEN 'ensemble_fallback_for_missing_oof' ELSE 'caption_5fold_ensemble' END AS source, CASE WHEN g.post_id IS NOT NULL AND oof IS NOT NULL THEN oof ELSE 'ens' || s.post_id END AS prediction, CASE WHEN g.post_id IS NOT NULL AND oof IS NOT NULL THEN fold END AS fold FROM s LEFT JOIN g USING (post_id) LEFT JOIN o USING (post_id)",
)
def oof_routing(spark, sf):
    key = F.col("doc_id").cast("string").alias("post_id")
    silver, labels = read(spark, sf, "documents").select(key), read(spark, sf, "labels").select("doc_id", key)
    fold = (F.col("doc_id") % 5).cast("int")
    oof = labels.filter("doc_id % 4 <> 0").select("post_id", fold.alias("fold")).union(labels.filter("doc_id % 8 = 1").select("post_id", (fold + 5).alias("fold")))
    oof = oof.withColumn("prediction", F.concat(F.lit("oof"), "fold"))
    return N.route_predictions(silver, labels.select("post_id"), oof, silver.withColumn("prediction", F.concat(F.lit("ens"), "post_id")))


@query("fold_assign")
def fold_assign(spark, sf):
    """Documents by fold, all of a source in one; tests hold balance and grouping."""
    return N.group_folds(read(spark, sf, "documents").select("doc_id", "source"), "source", 5)


@query(
    "fold_average",
    "WITH r AS (SELECT l_returnflag AS label, l_linenumber AS fold, count(*) AS support, avg(l_discount) AS precision, avg(l_tax) AS recall, avg(l_quantity) AS f1 FROM lineitem GROUP BY ALL) SELECT label, avg(support) AS support_mean, CAST(sum(support) AS BIGINT) AS support_sum, round(avg(precision), 9) AS precision_mean, round(avg(recall), 9) AS recall_mean, round(avg(f1), 7) AS f1_mean, round(stddev_samp(f1), 7) AS f1_std FROM r GROUP BY label",
)
def fold_average(spark, sf):
    r = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("label"), "l_linenumber").agg(F.count(F.lit(1)).alias("support"), F.avg("l_discount").alias("precision"), F.avg("l_tax").alias("recall"), F.avg("l_quantity").alias("f1"))
    out = N.fold_average(r)
    return out.select("label", "support_mean", "support_sum", F.round("precision_mean", 9).alias("precision_mean"), F.round("recall_mean", 9).alias("recall_mean"), F.round("f1_mean", 7).alias("f1_mean"), F.round("f1_std", 7).alias("f1_std"))


# ---------------------------------------------------------------------------------------------------- metrics

_SC = "r AS (SELECT l_linestatus AS model, CAST(l_linenumber AS INT) AS seed, CAST(l_returnflag = 'R' AS INT) AS y, round(l_discount * 10, 2) AS score, CAST(l_partkey % 2 AS VARCHAR) AS g1, CASE WHEN l_suppkey % 3 = 0 THEN '1' ELSE 'x' END AS g2 FROM lineitem)"


def scored_rows(spark, sf):
    return read(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("model"),
        F.col("l_linenumber").cast("int").alias("seed"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.round(F.col("l_discount") * 10, 2).alias("score"),
        (F.col("l_partkey") % 2).cast("string").alias("g1"),
        F.when(F.col("l_suppkey") % 3 == 0, "1").otherwise("x").alias("g2"),
    )


def _bundle(by: str, frm: str, extra: str = "") -> str:
    return f"""SELECT {by}, tp, fp, fn, tn{extra}, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / (CAST(tp + fn > 0 AS INT) + CAST(tn + fp > 0 AS INT)), 9) AS balanced_accuracy,
round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / (CAST(tp + fp + fn > 0 AS INT) + CAST(tn + fp + fn > 0 AS INT)), 9) AS macro_f1,
round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) * (tn + fp)) / (tp + fp + fn + tn), 9) AS weighted_f1 FROM {frm}"""


_CONF = "CAST(sum(y * h) AS BIGINT) AS tp, CAST(sum((1 - y) * h) AS BIGINT) AS fp, CAST(sum(y * (1 - h)) AS BIGINT) AS fn, CAST(sum((1 - y) * (1 - h)) AS BIGINT) AS tn"


def _r9(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in M.NAMES else F.col(c) for c in names])


@query("metric_bundle", f"WITH {_SC}, h AS (SELECT *, CAST(score >= 0.5 AS INT) AS h FROM r), c AS (SELECT model, seed, {_CONF} FROM h GROUP BY model, seed) " + _bundle("model, seed", "c"))
def metric_bundle(spark, sf):
    return _r9(M.metric_bundle(scored_rows(spark, sf), ["model", "seed"], "y", "score"), "model", "seed", "tp", "fp", "fn", "tn", *M.NAMES)


@query("roc_auc", f"WITH {_SC}, t AS (SELECT model, score, count(*) AS n, sum(y) AS p FROM r GROUP BY ALL), w AS (SELECT *, coalesce(sum(n - p) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t) SELECT model, round(sum(p * (below + (n - p) / 2)) / (CAST(sum(p) AS DOUBLE) * sum(n - p)), 9) AS roc_auc FROM w GROUP BY model")
def roc_auc(spark, sf):
    return M.roc_auc(scored_rows(spark, sf), ["model"], "y", "score").withColumn("roc_auc", F.round("roc_auc", 9))


@query("avg_precision", f"WITH {_SC}, t AS (SELECT model, score, count(*) AS n, sum(y) AS p FROM r GROUP BY ALL), w AS (SELECT *, sum(n) OVER x AS cn, sum(p) OVER x AS cp FROM t WINDOW x AS (PARTITION BY model ORDER BY score DESC)) SELECT model, round(sum(p * cp / cn) / sum(p), 9) AS average_precision FROM w GROUP BY model")
def avg_precision(spark, sf):
    return M.average_precision(scored_rows(spark, sf), ["model"], "y", "score").withColumn("average_precision", F.round("average_precision", 9))


_SWEEP = f"{_SC}, g AS (SELECT DISTINCT model, least(1.0, greatest(0.0, score))::DOUBLE AS threshold FROM r UNION SELECT model, round(0.05 + i * ((0.95 - 0.05) / 90), 10)::DOUBLE FROM (SELECT DISTINCT model FROM r), range(0, 91) AS z(i) UNION SELECT DISTINCT model, 0.5::DOUBLE FROM r), h AS (SELECT g.model, threshold, y, CAST(score >= threshold AS INT) AS h, n FROM g JOIN (SELECT model, score, y, count(*) AS n FROM r GROUP BY ALL) q ON g.model = q.model), c AS (SELECT model, threshold, CAST(sum(n * y * h) AS BIGINT) AS tp, CAST(sum(n * (1 - y) * h) AS BIGINT) AS fp, CAST(sum(n * y * (1 - h)) AS BIGINT) AS fn, CAST(sum(n * (1 - y) * (1 - h)) AS BIGINT) AS tn FROM h GROUP BY ALL)"


@query("threshold_sweep", f"WITH {_SWEEP} " + _bundle("model, threshold", "c"))
def threshold_sweep(spark, sf):
    return _r9(M.threshold_sweep(scored_rows(spark, sf), ["model"], "y", "score"), "model", "threshold", "tp", "fp", "fn", "tn", *M.NAMES)


_CHOICES = {"val_f1": "f1 DESC, recall DESC, precision DESC", "balanced_accuracy": "balanced_accuracy DESC, f1 DESC, recall DESC", "recall_at_precision": "CASE WHEN precision >= 0.6 THEN recall ELSE -1 END DESC, f1 DESC, precision DESC", "fixed_05": "abs(threshold - 0.5)"}


@query("choose_threshold", f"WITH {_SWEEP}, b AS ({_bundle('model, threshold', 'c')}) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS mode, model, threshold, f1 FROM b QUALIFY row_number() OVER (PARTITION BY model ORDER BY {o}, threshold) = 1)" for m, o in _CHOICES.items()))
def choose_threshold(spark, sf):
    sweep = _r9(M.threshold_sweep(scored_rows(spark, sf), ["model"], "y", "score"), "model", "threshold", *M.NAMES)
    parts = [M.choose_threshold(sweep, ["model"], m).select(F.lit(m).alias("mode"), "model", "threshold", "f1") for m in _CHOICES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("error_by_group", f"WITH {_SC}, x AS (SELECT model, y, CAST(score >= 0.5 AS INT) AS h, unnest(list_filter(['ALL', CASE WHEN g1 = '1' THEN 'g1' END, CASE WHEN g2 = '1' THEN 'g2' END], lambda z: z IS NOT NULL)) AS content_group FROM r), c AS (SELECT model, content_group, {_CONF} FROM x GROUP BY ALL) " + _bundle("model, content_group", "c", ", tp + fp + fn + tn AS support"))
def error_by_group(spark, sf):
    out = M.error_by_group(scored_rows(spark, sf), ["model"], "y", F.col("score") >= 0.5, ["g1", "g2"])
    return _r9(out, "model", "content_group", "tp", "fp", "fn", "tn", "support", *M.NAMES)


@query("metric_summary", f"WITH {_SC}, h AS (SELECT *, CAST(score >= 0.5 AS INT) AS h FROM r), c AS (SELECT model, seed, {_CONF} FROM h GROUP BY model, seed), b AS ({_bundle('model, seed', 'c')}) SELECT model, count(*) AS n_runs, " + ", ".join(f"round(avg({x}), 7) AS {x}_mean, round(stddev_pop({x}), 7) AS {x}_std" for x in M.NAMES) + " FROM b GROUP BY model")
def metric_summary(spark, sf):
    runs = M.metric_bundle(scored_rows(spark, sf), ["model", "seed"], "y", "score")
    out = M.summary(runs, ["model"], M.NAMES)
    return out.select("model", "n_runs", *[F.round(f"{x}_{k}", 7).alias(f"{x}_{k}") for x in M.NAMES for k in ("mean", "std")])


@query("majority", f"WITH {_SC} SELECT 'majority_normal' AS model, CAST(avg(y) >= 0.5 AS INT) AS prediction FROM r")
def majority(spark, sf):
    return M.majority(scored_rows(spark, sf), "y")


# ---------------------------------------------------------------------------------------------------- features and models


@query(
    "tfidf",
    r"""WITH d AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_]+') AS w FROM benchmark), t AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d), c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark), v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n) ORDER BY total DESC, term LIMIT 30000), x AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM c JOIN v USING (term), n) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 7) AS weight FROM x""",
)
def tfidf(spark, sf):
    return T.tfidf(read(spark, sf, "benchmark"), "item_id", "text").withColumn("weight", F.round("weight", 7))


@query(
    "impute_scale",
    "WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS a, CAST(c_nationkey AS DOUBLE) AS b, CAST(3 AS DOUBLE) AS k FROM customer), t AS (SELECT * FROM r WHERE id % 4 <> 0), m AS (SELECT quantile_cont(a, 0.5) AS med, quantile_cont(b, 0.5) AS medb FROM t), s AS (SELECT avg(coalesce(a, med)) AS mu, stddev_pop(coalesce(a, med)) AS sd, avg(b) AS mub, stddev_pop(b) AS sdb FROM t, m) SELECT id, round((coalesce(a, med) - mu) / sd, 7) AS a, round((b - mub) / sdb, 7) AS b, 0.0::DOUBLE AS k FROM r, m, s",
)
def impute_scale(spark, sf):
    r = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("a"), F.col("c_nationkey").cast("double").alias("b"), F.lit(3.0).alias("k"))
    fitted = T.scaler(r.filter("id % 4 <> 0"), ["a", "b", "k"])
    out = T.apply_scaler(r, fitted, ["a", "b", "k"])
    return out.select("id", *[F.round(c, 7).alias(c) for c in ("a", "b", "k")])


@query("mean_pool", "WITH t AS (SELECT label AS id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings WHERE vec_id % 3 <> 0), m AS (SELECT id, i, avg(CAST(x AS DOUBLE)) AS x FROM t GROUP BY ALL) SELECT id, round(sum(x), 6) AS total, count(*) AS n FROM m GROUP BY id")
def mean_pool(spark, sf):
    t = read(spark, sf, "embeddings").select(F.col("label").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))
    p = T.mean_pool(t, "id", "v", "mask")
    return p.select("id", F.round(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("pooled").cast("long").alias("n"))


def _vectors(spark, sf):
    from pyspark.ml.functions import array_to_vector

    e = read(spark, sf, "embeddings")
    return e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") % 2).cast("double").alias("y"))


@query("logreg")
def logreg(spark, sf):
    rows = _vectors(spark, sf)
    return T.logistic(rows.filter("vec_id % 5 <> 0"), rows.filter("vec_id % 5 = 0"), "features", "y").select("vec_id", "y", "score")


@query("mlp")
def mlp(spark, sf):
    rows = _vectors(spark, sf)
    return T.perceptron(rows.filter("vec_id % 5 <> 0"), rows.filter("vec_id % 5 = 0"), "features", "y").select("vec_id", "y", "score")


# ---------------------------------------------------------------------------------------------------- events


@query("event_dedup", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def event_dedup(spark, sf):
    return S.keep_first(read(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("event_state", "WITH w AS (SELECT user_id, count(*) AS seen, count(*) FILTER (value > 50) AS saved FROM events GROUP BY user_id) SELECT user_id, seen, saved, CASE WHEN saved > 0 THEN 'active' ELSE 'scanned_no_relevant_posts' END AS status FROM w")
def event_state(spark, sf):
    return ST.account_state(read(spark, sf, "events"), F.col("value") > 50)


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return ST.windowed_counts(read(spark, sf, "events"), "1 day").select(F.col("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
