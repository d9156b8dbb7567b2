"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into segments; for each, the mean and the deviation are kept.  For two vectors the segment statistics bound
the squared distance from below, which is the same as a bound of the inner product from above:

    x.y <= sum over segments of m * (mean_x * mean_y + dev_x * dev_y)          (m: segment length)

A candidate is passed on from the coarse statistics to the finer ones, and from those to the exact product, only where its bound
reaches the query's k-th best score so far; each step computes for the survivors of the one before only.  Bounds are lower
bounds of distance, so results are exact.

Queries come in rounds of a bounded size that is sent to every task; candidates stay where they are, are read in blocks, and
each task hands on its best k a query, which are ranked by query and written: one round's plan doesn't grow with their number.

Defined results: vectors that are null or hold a null or non-finite component take no part; a null id takes no part; a
candidate with the query's own id is left out; rows that repeat an id are candidates of their own, and queries whose pairs are
ranked together; only vectors of equal length are compared; ties go to the smaller id; fewer than k candidates give all; scores beyond the range of long are
held at its ends (where the order is by the held score); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, table

K = 20
#: Queries sent to the tasks at once: of 64 components each, 32 MB.
ROUND = 65_536
#: Rows of a block of candidates, of queries held against it, and pairs computed at once.
BLOCK, PAIRS = 2048, 100_000
#: Products of components up to this size are exact in floating point for up to 8192 of them; others are computed as integers.
EXACT = float(1 << 20)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Segment lengths, coarse to fine.
LEVELS = (16, 4)


def statistics(x: np.ndarray, m: int) -> np.ndarray:
    """Segment means and deviations, scaled by sqrt(m), side by side: the dot product of two such rows is the bound."""
    pad = -x.shape[1] % m
    parts = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, m)
    mean = parts.mean(axis=2)
    dev = np.sqrt(np.maximum((parts * parts).mean(axis=2) - mean * mean, 0))
    return np.concatenate([mean, dev], axis=1) * np.sqrt(m)


def integer_product(x: np.ndarray, y: np.ndarray) -> int:
    """Exact inner product of whole numbers of any size, held within the range of long."""
    return max(LOW, min(HIGH, sum(int(p) * int(q) for p, q in zip(x, y, strict=True))))


class Side:
    """Vectors with their statistics by level, lengths and sizes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors.astype(np.float64)
        self.scale = np.maximum(np.abs(self.x).max(axis=1, initial=0), 1.0)
        self.large = (self.scale > EXACT) | (self.x.shape[1] > 8192)
        # bounds are compared in units of each vector's largest component, so that no square overflows
        self.unit = self.x / self.scale[:, None]
        self.stats = [statistics(self.unit, m) for m in LEVELS]
        self.length = np.sqrt((self.unit * self.unit).sum(axis=1))

    def rows(self, a: int, b: int) -> "Side":
        part = object.__new__(Side)
        part.ids, part.x, part.scale, part.large, part.unit, part.length = (v[a:b] for v in (self.ids, self.x, self.scale, self.large, self.unit, self.length))
        part.stats = [v[a:b] for v in self.stats]
        return part


def paired(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j) of rows; by one matrix product where they are much of the block, which is cheaper."""
    if 4 * len(i) > len(x) * len(y):
        return (x @ y.T)[i, j]
    out = np.empty(len(i))
    for a in range(0, len(i), PAIRS):
        p = slice(a, a + PAIRS)
        out[p] = np.einsum("ij,ij->i", x[i[p]], y[j[p]])
    return out


class Best:
    """The k best (score, id) of each query so far; n: how many there are."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.q, self.k = Side(ids, vectors), k
        self.score = np.full((len(ids), k), LOW, np.int64)
        self.found = np.full((len(ids), k), HIGH, np.int64)
        self.n = np.zeros(len(ids), np.int64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        y = Side(ids, vectors)
        for a in range(0, len(self.q.ids), BLOCK):
            q = self.q.rows(a, a + BLOCK)
            # the first few candidates fill the queries' places, so that the others meet a floor
            first = 0 if (self.n[a : a + BLOCK] >= self.k).all() else min(len(ids), 8 * self.k)
            if first:
                self.judge(a, q, y.rows(0, first), np.not_equal.outer(q.ids, ids[:first]))
            rest = y.rows(first, len(ids)) if first else y
            if len(rest.ids):
                self.judge(a, q, rest, np.not_equal.outer(q.ids, rest.ids))

    def judge(self, a: int, q: Side, y: Side, keep: np.ndarray) -> None:
        """Take what of the pairs in keep belongs to the best: coarse bound, finer bounds, exact product."""
        full = self.n[a : a + len(q.ids)] >= self.k
        floor = np.where(full, self.score[a : a + len(q.ids), -1].astype(float), -np.inf)

        def open_(bound: np.ndarray, i, j) -> np.ndarray:
            slack = 1e-9 * q.length[i] * y.length[j] + 1e-12
            with np.errstate(over="ignore"):
                return (bound + slack) * q.scale[i] * y.scale[j] >= floor[i] - 1e-12 * np.abs(np.where(np.isfinite(floor[i]), floor[i], 0))

        if full.any():
            every = np.arange(len(q.ids))[:, None], np.arange(len(y.ids))[None, :]
            keep = keep & open_(q.stats[0] @ y.stats[0].T, *every)
        i, j = np.nonzero(keep)
        if full.any():
            for mine, other in zip(q.stats[1:], y.stats[1:], strict=True):
                some = open_(paired(mine, other, i, j), i, j)
                i, j = i[some], j[some]
        large = q.large[i] | y.large[j]
        score = np.zeros(len(i), np.int64)
        score[~large] = np.rint(paired(q.x, y.x, i[~large], j[~large])).astype(np.int64)
        for p in np.flatnonzero(large):
            score[p] = integer_product(q.x[i[p]], y.x[j[p]])
        good = ~full[i] | (score >= self.score[a + i, -1])
        if good.any():
            self.merge(a, i[good], score[good], y.ids[j[good]])

    def merge(self, a: int, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(rows)
        held = np.arange(self.k)[None, :] < self.n[a + touched][:, None]
        rows = np.concatenate([rows, np.repeat(touched, held.sum(axis=1))])
        score = np.concatenate([score, self.score[a + touched][held]])
        ids = np.concatenate([ids, self.found[a + touched][held]])
        order = np.lexsort((ids, ~score, rows))  # ~x = -x - 1: falling scores without overflow
        rows, score, ids = rows[order], score[order], ids[order]
        first = np.searchsorted(rows, touched)
        place = np.arange(len(rows)) - first[np.searchsorted(touched, rows)]
        top = place < self.k
        self.score[a + rows[top], place[top]], self.found[a + rows[top], place[top]] = score[top], ids[top]
        self.n[a + touched] = np.minimum(np.diff(np.append(first, len(rows))), self.k)

    def rows(self) -> pd.DataFrame:
        some = np.arange(self.k)[None, :] < self.n[:, None]
        return pd.DataFrame({"query_id": np.repeat(self.q.ids, self.n), "vec_id": self.found[some], "score": self.score[some]})


def search(vectors: DataFrame, is_query, vector_id: str = "vec_id", vector: str = "vector", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row for which is_query (a Column of vector_id) holds.

    vectors: finite whole numbers in an array of any numeric type, ready to be compared.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vector_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    with scratch(spark):
        rows = materialize(rows.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))), "vectors")
        asked = rows.filter(is_query(F.col("id")))
        rounds = -(-asked.count() // ROUND)
        found = []
        for r in range(rounds):
            mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r) if rounds > 1 else asked
            got = mine.toPandas()  # one round: about ROUND rows
            by_length = {n: (g["id"].to_numpy(np.int64), np.stack(g["x"].map(np.asarray).to_list())) for n, g in got.groupby(got["x"].map(len)) if n}
            sent = spark.sparkContext.broadcast(by_length)

            def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                best = {n: Best(ids, x, k) for n, (ids, x) in sent.value.items()}
                for batch in batches:
                    for n, g in batch.groupby(batch["x"].map(len)):
                        if n in best:
                            ids, x = g["id"].to_numpy(np.int64), np.stack(g["x"].to_list())
                            for a in range(0, len(ids), BLOCK):
                                best[n].offer(ids[a : a + BLOCK], x[a : a + BLOCK])
                yield from (b.rows() for b in best.values())

            part = rows.mapInPandas(run, "query_id long, vec_id long, score long")
            found.append(materialize(best_of(part, k), "best", keep=True))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(found[0].schema).parquet(*[f for x in found for f in x.inputFiles()]) if len(found) > 1 else found[0]


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, vec_id, score) of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # floor() of a double is a long, so numbers of that range and over, which are whole, stay as they are
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 1e15, F.floor(x.cast("double") * 64).cast("double")).otherwise(x.cast("double") * 64))
    return search(rows.select("vec_id", whole.alias("vector")), lambda i: i % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
