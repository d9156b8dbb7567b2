"""Host-level quality rules.

Every document gets rule failures of its own; failures are summed by host, each host's failure rate is shrunk towards the
mean of all hosts with a beta prior fitted to the hosts' rates (by moments), and the host's verdict is joined back to its
documents: of a host whose shrunk rate reaches REJECTED no document is kept; of one under TRUSTED a document may fail one soft
rule; of all others none.  DataFrame functions only.

Defined results: a null text has no words and fails; a null host is a host like any other; equal rows get equal verdicts; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, materialize, table, words

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Shrunk failure rates under which a host is trusted, and from which all its documents go: most of its pages fail.
TRUSTED, REJECTED = 0.02, 0.5


def repeated_words(ws: Column) -> Column:
    """Words that lie in a window of five words which the array holds twice or more."""

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            same = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda x: x["p"]))

        def total(p: Column) -> Column:
            gains = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(p, i + 1) - x), F.lit(WINDOW)))
            return F.aggregate(gains, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(by_hash, positions), total))

    def windows(w: Column) -> Column:
        # xxhash64 of five word hashes stands for the window: two different windows of one text agree with odds of about n*n/2^65
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(let(let(F.transform(ws, lambda x: F.xxhash64(x)), windows), covered))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    full = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    out = docs.withColumn("__ws", words(F.col(text))).withColumns(
        {
            "n_words": F.size("__ws").cast("long"),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__ws")).cast("long"),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.drop("__ws").withColumn("base_failed", failed)


def rule_failures() -> Column:
    """Number of soft rules that a row of text_statistics() fails; all are ratios of its counts."""
    n, chars = F.col("n_words"), F.col("word_chars")
    rules = [
        10 * F.col("n_symbols") > n,  # symbols: over one for ten words
        3 * F.col("n_dup_lines") > F.col("__n_lines"),  # lines: over a third repeat an earlier one
        (chars < 2 * n) | (chars > 15 * n),  # mean word length outside 2..15
    ]
    return sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules), F.lit(0))


def with_failures(docs: DataFrame, text: str = "text") -> DataFrame:
    lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.translate(x, SPACES, "") != ""))
    stats = text_statistics(docs, text).withColumn("__n_lines", lines)
    return stats.withColumn("n_failed_rules", rule_failures()).drop("__n_lines")


def host_verdicts(stats: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: n_docs, n_failed, rate (shrunk) and allowed, the number of soft failures that its documents may have; -1
    for hosts whose documents all go.

    The beta prior has the mean and the variance of the hosts' raw rates (method of moments; its weight is held within 1 and
    1000 documents).  Hosts are counted, never collected.
    """
    failed = F.col("base_failed") | (F.col("n_failed_rules") > 0)
    hosts = stats.groupBy(F.col(host).alias("__host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "hosts")
    raw = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(raw), F.var_pop(raw)).first()  # two numbers
    m = 0.0 if m is None else m
    weight = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v and 0 < m < 1 else 1000.0
    hosts = hosts.withColumn("rate", (F.col("n_failed") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight)))
    return hosts.withColumn("allowed", F.when(F.col("rate") < TRUSTED, 1).when(F.col("rate") >= REJECTED, -1).otherwise(0)).select("__host", "n_docs", "n_failed", "rate", "allowed")


def judge(stats: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """stats with host_rate and kept: not base_failed, and no more soft failures than the host is allowed (none pass where that is -1)."""
    small = hosts.select("__host", F.col("rate").alias("host_rate"), F.col("allowed").alias("__allowed"))
    out = stats.join(small, stats[host].eqNullSafe(F.col("__host")), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_failed_rules") <= F.col("__allowed"))).drop("__allowed")


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that the rules keep, with the columns of docs.  The texts are read twice and shuffled never, unless the hosts outgrow a broadcast."""
    names = docs.columns
    inner = docs.select(F.struct(*names).alias("__row"))
    judged = with_failures(inner.select("__row", F.col("__row")[text].alias("__text"), F.col("__row")[host].alias("__src")), "__text").select("__row", "__src", "base_failed", "n_failed_rules")
    hosts = host_verdicts(judged.drop("__row"), "__src")
    return judge(judged, hosts, "__src").filter("kept").select("__row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    stats = materialize(with_failures(docs).drop("text"), "rules")
    hosts = host_verdicts(stats)
    return judge(stats, hosts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_rules", F.round("host_rate", 9).alias("host_rate"))


#: A window of five words is compared as text here.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS s FROM g),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, s) AS c FROM h) WHERE c > 1),
q AS (SELECT rid, sum(least(5, coalesce(nx - p, 5))) AS n_repeat FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nx FROM r) GROUP BY rid),
s AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(q.n_repeat, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN q USING (rid)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             CAST((10 * n_symbols > n_words) AS INT) + CAST((3 * n_dup_lines > n_lines) AS INT) + CAST((word_chars < 2 * n_words OR word_chars > 15 * n_words) AS INT) AS n_failed_rules FROM s),
hosts AS (SELECT source, count(*) AS n_docs, sum(CAST((base_failed OR n_failed_rules > 0) AS INT)) AS n_failed FROM f GROUP BY source),
prior AS (SELECT m, least(1000.0, greatest(1.0, CASE WHEN v > 0 AND m > 0 AND m < 1 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS k
          FROM (SELECT avg(n_failed / n_docs) AS m, var_pop(n_failed / n_docs) AS v FROM hosts)),
rates AS (SELECT source, (n_failed + m * k) / (n_docs + k) AS host_rate FROM hosts, prior)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_failed_rules <= CASE WHEN host_rate < 0.02 THEN 1 WHEN host_rate >= 0.5 THEN -1 ELSE 0 END) AS kept, n_failed_rules, round(host_rate, 9) AS host_rate
FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source
"""
