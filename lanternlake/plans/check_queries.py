"""Queries of validations, fallbacks, ensembles, rankings and stops, with their SQL.

Customers stand for posts, orders for model runs and crawl rounds, events for predictions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import checks as K

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        Q[name] = f
        O[name] = oracle
        return f

    return add


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


_LINKS = "l AS (SELECT c_custkey, 'https://www.instagram.com/' || CASE c_custkey % 4 WHEN 0 THEN 'p/A_' WHEN 1 THEN 'reel/b-' WHEN 2 THEN 'name' ELSE 'name/p/Cx' END || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '/?x=1' WHEN 1 THEN '/' ELSE '' END AS url FROM customer)"


def links(spark, sf):
    n = F.col("c_custkey")
    mid = F.when(n % 4 == 0, "p/A_").when(n % 4 == 1, "reel/b-").when(n % 4 == 2, "name").otherwise("name/p/Cx")
    end = F.when(n % 3 == 0, "/?x=1").when(n % 3 == 1, "/").otherwise("")
    return read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("https://www.instagram.com/"), mid, n.cast("string"), end).alias("url"))


@query("post_ids", f"WITH {_LINKS} SELECT c_custkey, nullif(regexp_extract(url, '/(?:p|reel)/([A-Za-z0-9_-]+)', 1), '') AS post_id, list_last(string_split(rtrim(regexp_replace(url, '\\?.*$', ''), '/'), '/')) AS shortcode, regexp_extract('see ' || url || ' now', 'https?://[^\\s]+') AS first_link FROM l")
def post_ids(spark, sf):
    u = F.col("url")
    return links(spark, sf).select("c_custkey", K.post_id_of(u).alias("post_id"), K.shortcode(u).alias("shortcode"), K.first_link(F.concat(F.lit("see "), u, F.lit(" now"))).alias("first_link"))


@query("post_links", "WITH l AS (SELECT page_id, list_distinct(list_transform(list_filter(regexp_extract_all(replace(html, 'href=\"/t', 'href=\"/p/t'), '<a\\b[^>]*?href=[\"'']([^\"''#]+)', 1), lambda u: contains(u, '/p/')), lambda u: rtrim(regexp_replace(CASE WHEN starts_with(u, '/') THEN 'https://example.org' || u ELSE u END, '\\?.*$', ''), '/'))) AS links FROM pages) SELECT page_id, array_to_string(list_sort(links), ' ') AS links FROM l")
def post_links(spark, sf):
    from ..operators.crawl import page_links

    html = F.replace("html", F.lit('href="/t'), F.lit('href="/p/t'))
    return read(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(page_links(html, part="/p/")), " ").alias("links"))


@query("seen_posts", f"WITH {_LINKS}, ids AS (SELECT * FROM l WHERE c_custkey % 5 = 0), urls AS (SELECT * FROM l WHERE c_custkey % 7 = 0) SELECT c_custkey, url FROM l WHERE c_custkey NOT IN (SELECT c_custkey FROM ids) AND url NOT IN (SELECT url FROM urls)")
def seen_posts(spark, sf):
    rows = links(spark, sf)
    return K.unseen(rows, rows.filter("c_custkey % 5 = 0"), rows.filter("c_custkey % 7 = 0"), "c_custkey", "url")


_CELLS = "cell AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 5 WHEN 0 THEN '[{\"label\": \"OUTCOME\"}]' WHEN 1 THEN '[{''labels'': [''REQUIREMENT'', ''OUTCOME'']}]' WHEN 2 THEN 'OUTCOME' WHEN 3 THEN NULL ELSE '[]' END AS ner_entities FROM customer)"


def cells(spark, sf):
    n = F.col("c_custkey")
    cell = F.when(n % 5 == 0, '[{"label": "OUTCOME"}]').when(n % 5 == 1, "[{'labels': ['REQUIREMENT', 'OUTCOME']}]").when(n % 5 == 2, "OUTCOME").when(n % 5 == 4, "[]")
    return read(spark, sf, "customer").select("c_custkey", "c_nationkey", cell.alias("ner_entities"))


@query("entity_fallback", f"WITH {_CELLS} SELECT c_custkey, CAST(c_custkey % 5 IN (0, 1) AS INT) AS has_outcome, CAST(c_custkey % 5 = 1 AS INT) AS has_requirement, CAST(c_nationkey % 2 = 0 AS INT) AS has_cost, CAST(c_nationkey % 3 = 0 AS DOUBLE) AS re_score, CAST(c_nationkey AS DOUBLE) / 25 AS p_score, CAST(0 AS DOUBLE) AS no_score FROM cell")
def entity_fallback(spark, sf):
    rows = cells(spark, sf).withColumns({"has_COST_CLAIM": (F.col("c_nationkey") % 2 == 0).cast("double"), "re_A": (F.col("c_nationkey") % 3 == 0).cast("int"), "p_B": F.col("c_nationkey") / 25})
    return rows.select("c_custkey", K.has_label(rows, "OUTCOME").alias("has_outcome"), K.has_label(rows, "REQUIREMENT").alias("has_requirement"), K.has_label(rows, "COST_CLAIM").alias("has_cost"), K.relation_score(rows, "A").alias("re_score"), K.relation_score(rows, "B").alias("p_score"), K.relation_score(rows, "C").alias("no_score"))


@query("list_cells", "SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(c_name || ', ' || c_mktsegment || '; ' || c_nationkey || ' ', '[,;\\s]+'), lambda x: x <> ''), '|') AS parts, len(list_filter(['MACHINERY', 'BUILDING'], lambda k: k = c_mktsegment)) AS hot, CAST(c_mktsegment = 'MACHINERY' AS INT) AS first_hot FROM customer")
def list_cells(spark, sf):
    text = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit("; "), F.col("c_nationkey").cast("string"), F.lit(" "))
    hot = K.multi_hot(F.array("c_mktsegment"), ["MACHINERY", "BUILDING"])
    return read(spark, sf, "customer").select("c_custkey", F.array_join(K.parsed_list(text), "|").alias("parts"), F.aggregate(hot, F.lit(0), lambda a, x: a + x).cast("long").alias("hot"), hot[0].alias("first_hot"))


@query("bio_label_map", " UNION ALL ".join(f"SELECT {i} AS number, '{x}' AS label" for i, x in enumerate(K.bio_labels())))
def bio_label_map(spark, sf):
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, K.bio_labels())))).select(F.col("pos").alias("number"), F.col("col").alias("label"))


@query("duplicate_keys", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return K.duplicate_keys(read(spark, sf, "events"), "user_id")


_GIVEN = "g AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'uncertain' END AS label FROM customer)"


@query("label_checks", f"WITH {_GIVEN} SELECT 'unknown' AS kind, label, count(*) AS n FROM g WHERE label IS NULL OR label NOT IN ('normal', 'suspicious') GROUP BY label UNION ALL SELECT 'small', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment HAVING count(*) < 40")
def label_checks(spark, sf):
    c = read(spark, sf, "customer")
    n = F.col("c_custkey")
    given = c.select(F.when(n % 4 == 0, "normal").when(n % 4 == 1, "suspicious").when(n % 4 == 2, "uncertain").alias("label"))
    return K.unknown_labels(given, "label").select(F.lit("unknown").alias("kind"), "label", "n").unionByName(K.small_classes(c, "c_mktsegment", 40).select(F.lit("small").alias("kind"), "label", "n"))


_P = ", ".join(f"avg(CAST((event_id * 13 + {29 * i}) % 101 AS DOUBLE) / 101) AS p{i}" for i in range(4))


@query("ensemble_relations", f"WITH m AS (SELECT user_id, count(*) AS n_models, {_P} FROM events GROUP BY user_id) SELECT user_id, n_models, {', '.join(f'round(p{i}, 9) AS p_{x}, CAST(p{i} >= 0.5 AS INT) AS re_{x}' for i, x in enumerate(fixed.RE_LABELS))} FROM m")
def ensemble_relations(spark, sf):
    p = {f"p_{x}": (F.col("event_id") * 13 + 29 * i) % 101 / F.lit(101.0) for i, x in enumerate(fixed.RE_LABELS)}
    out = K.mean_relations(read(spark, sf, "events").select("user_id", "event_id", *[v.alias(k) for k, v in p.items()]), fixed.RE_LABELS, "user_id", order="event_id")
    return out.withColumns({k: F.round(k, 9) for k in p})


@query("prediction_stats", "SELECT 'rows' AS name, count(*) AS total FROM events UNION ALL SELECT 'has_click', CAST(sum(CAST(event_type = 'click' AS INT)) AS BIGINT) FROM events UNION ALL SELECT 'has_error', CAST(sum(CAST(event_type = 'error' AS INT)) AS BIGINT) FROM events")
def prediction_stats(spark, sf):
    rows = read(spark, sf, "events").select(*[(F.col("event_type") == x).cast("int").alias(f"has_{x}") for x in ("click", "error")])
    return K.prediction_stats(rows, ["has_click", "has_error"])


@query("class_weights", "SELECT sum(CAST(event_type = 'error' AS BIGINT))::BIGINT AS n_pos, sum(CAST(event_type <> 'error' AS BIGINT))::BIGINT AS n_neg, greatest(1.0::DOUBLE, sum(CAST(event_type <> 'error' AS BIGINT))::DOUBLE / sum(CAST(event_type = 'error' AS BIGINT))::DOUBLE) AS pos_weight FROM events")
def class_weights(spark, sf):
    return K.class_weights(read(spark, sf, "events").select((F.col("event_type") == "error").cast("int").alias("y")), "y")


@query("source_counts", "SELECT lang, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def source_counts(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"))


_SUMMARY = "s AS (SELECT c_mktsegment AS phase, c_nationkey AS model, CAST(count(*) % 7 AS DOUBLE) AS f1, CAST(count(*) % 3 AS DOUBLE) AS macro_f1, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS pr_auc FROM customer GROUP BY c_mktsegment, c_nationkey)"


@query("metric_ranking", f"WITH {_SUMMARY} SELECT *, CAST(row_number() OVER (PARTITION BY phase ORDER BY f1 DESC NULLS LAST, macro_f1 DESC NULLS LAST, pr_auc DESC NULLS LAST, model) AS INT) AS place FROM s")
def metric_ranking(spark, sf):
    n = F.count(F.lit(1))
    s = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("phase"), F.col("c_nationkey").alias("model")).agg((n % 7).cast("double").alias("f1"), (n % 3).cast("double").alias("macro_f1"))
    return K.ranked(s.withColumn("pr_auc", F.when(F.col("model") % 4 != 0, F.col("model").cast("double"))), within="phase")


_EPOCHS = "e AS (SELECT o_custkey AS run, o_orderkey AS epoch, CAST(o_orderkey * 37 % 101 AS DOUBLE) / 101 AS f1, CAST(o_orderkey * 11 % 7 AS DOUBLE) / 7 AS recall FROM orders)"


@query(
    "best_epochs",
    f"WITH {_EPOCHS}, s AS (SELECT *, f1 + recall / 100 AS s FROM e), b AS (SELECT *, coalesce(s > max(s) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM s), l AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last FROM b), st AS (SELECT run, coalesce(min(CASE WHEN epoch - last >= 900 THEN epoch END), max(epoch)) AS stopped_at FROM l GROUP BY run) SELECT run, max(epoch) AS best_epoch, round(max(s), 9) AS best_score, any_value(stopped_at) AS stopped_at FROM l JOIN st USING (run) WHERE better AND epoch <= stopped_at GROUP BY run",
)
def best_epochs(spark, sf):
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("run"), k.alias("epoch"), ((k * 37 % 101) / F.lit(101.0)).alias("f1"), ((k * 11 % 7) / F.lit(7.0)).alias("recall"))
    return K.best_epochs(rows, patience=900).withColumn("best_score", F.round("best_score", 9))


@query("stagnant_from", "WITH r AS (SELECT o_custkey AS account, o_orderkey AS round, CAST(o_orderkey % 3 = 0 AS INT) AS new_links FROM orders), w AS (SELECT *, sum(new_links) OVER (PARTITION BY account ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, row_number() OVER (PARTITION BY account ORDER BY round) AS i FROM r) SELECT account, min(CASE WHEN s = 0 AND i >= 3 THEN round END) AS stops_at FROM w GROUP BY account")
def stagnant_from(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("round"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("new_links"))
    return K.stagnant_from(rows, 3)
