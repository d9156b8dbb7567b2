"""Features and models: TF-IDF, imputing and scaling fitted on training rows, logistic regression, perceptron, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf of words of two or more characters and of pairs of them."""
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    words = rows.select(key, w.alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return words.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_vocabulary(counts: DataFrame, n: int, min_df: int = 2, max_df: float = 0.95, max_terms: int = 30000) -> DataFrame:
    """term and idf of the most frequent terms within the bounds of document frequency."""
    v = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    top = v.orderBy(F.desc("total"), "term").limit(max_terms)
    return top.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf(rows: DataFrame, key: str, text: str, **bounds) -> DataFrame:
    """key, term, weight: (1 + ln tf) * idf, of length 1 by key."""
    counts = terms(rows, key, text)
    vocabulary = tfidf_vocabulary(counts, rows.count(), **bounds)
    w = counts.join(vocabulary, "term").withColumn("w", (1.0 + F.log("tf")) * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: med_, mu_ and sd_ of each column: exact median, then mean and population deviation of the imputed column."""
    med = train.agg(*[F.percentile(F.nanvl(F.col(c), F.lit(None)), F.lit(0.5)).alias(f"med_{c}") for c in columns]).first()
    filled = {c: F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(med[f"med_{c}"])) for c in columns}
    return train.agg(*[F.lit(med[f"med_{c}"]).alias(f"med_{c}") for c in columns], *[F.avg(filled[c]).alias(f"mu_{c}") for c in columns], *[F.stddev_pop(filled[c]).alias(f"sd_{c}") for c in columns])


def apply_scaler(rows: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """rows with imputed, standardised columns; deviation 0 divides by 1; a column that was all null is 0."""
    m = fitted.first()
    out = {}
    for c in columns:
        med, mu, sd = m[f"med_{c}"], m[f"mu_{c}"], m[f"sd_{c}"]
        out[c] = F.lit(0.0) if med is None else (F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(med)) - F.lit(mu)) / F.lit(sd if sd else 1.0)
    return rows.withColumns(out)


def class_weights(rows: DataFrame, y: str) -> DataFrame:
    """rows with weight n / (2 * n of the class)."""
    n = {r[y]: r["n"] for r in rows.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    weight = F.coalesce(*[F.when(F.col(y) == k, total / (len(n) * v)) for k, v in n.items()])
    return rows.withColumn("weight", weight)


def low_level_features() -> list[str]:
    """Names of the 58 entity and relation features."""
    return ["has_NER", "has_RE"] + [f"{a}{x}{b}" for x in fixed.NER_LABELS for a, b in (("has_", ""), ("ner_vote_rate_", ""), ("ner_count_", "_mean"))] + [f"{a}{x}" for x in fixed.RE_LABELS for a in ("p_", "re_")]


def ensure_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Missing columns are 0; missing values stay null for the imputer."""
    return rows.withColumns({c: F.lit(0.0) for c in columns if c not in rows.columns})


def logistic(train: DataFrame, test: DataFrame, features: str, y: str, iterations: int = 50) -> DataFrame:
    """test with score, from a class-balanced logistic regression with C = 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    weighted = class_weights(train, y)
    n = weighted.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(featuresCol=features, labelCol=y, weightCol="weight", regParam=1.0 / n, standardization=False, maxIter=iterations).fit(weighted)
    return model.transform(test).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def perceptron(train: DataFrame, test: DataFrame, features: str, y: str, hidden: int = 32, seed: int = 42, iterations: int = 30) -> DataFrame:
    """test with score, from a network of two hidden layers (hidden, hidden / 2); hidden units are sigmoid."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import vector_to_array

    size = len(train.select(features).first()[0])
    model = MultilayerPerceptronClassifier(featuresCol=features, labelCol=y, layers=[size, hidden, max(2, hidden // 2), 2], seed=seed, maxIter=iterations).fit(train)
    return model.transform(test).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Mean of the vectors of tokens whose mask is 1, by key: sums by component, so no group is gathered."""
    each = tokens.filter(F.col(mask) == 1).select(key, F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy(key, "i").agg(F.avg("x").alias("x"))
    return mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("pooled"))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__i", F.row_number().over(w)).filter("__i = 1").drop("__i")
