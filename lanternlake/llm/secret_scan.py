"""Secret scan: pattern matches, and candidate strings whose sliding-window entropy is high.

Base kinds are regular expressions (leftmost, non-overlapping; too short matches are dropped afterwards).  The method adds two
kinds: a candidate string is scanned by a window of 20 characters whose Shannon entropy is kept up to date from the counts
of the one character that enters and the one that leaves; if the largest entropy reaches the threshold of the string's
character class and no allow-list rule suppresses it, its span is added.  Spans that meet a base span are not added again.
DataFrame functions only; no shuffle.

Defined results: null and empty texts have no spans; every text is read whole; repeated rows get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: kind, pattern, group that is measured, least length (fixed by the contract).
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: A matching text has one of these; it spares most texts the scans.
HINTS = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}

WINDOW = 20
#: Candidate strings: whole runs of these characters, at least a window long.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Entropy of a window, bits a character, from which each character class counts as random.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_base64": 3.7}
HEX_CLASS = r"^([0-9a-f]+|[0-9A-F]+)$"
#: Allow-list: strings that are not secrets though they look random.
ALLOWED = [
    r"^[0-9]+$",  # numbers
    r"^[A-Za-z+/_=-]+$",  # words, paths and rules without a digit
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"0123456789|abcdefghij",  # counting sequences
    r"^[a-z]+([_/-][a-z]+)*[_/-]?[0-9]{1,4}$",  # slugs with a number
]


def match_spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """array<struct<s,e,k,v>>: code-point spans of the matches whose group is `least` long; v is the matched text."""
    matches, groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    empty = F.expr("struct(0 AS at, array_repeat(struct(0 AS s, 0 AS e, '' AS k, '' AS v), 0) AS out)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("s"), end.alias("e"), F.lit(kind).alias("k"), x["m"].alias("v"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zipped = F.zip_with(F.arrays_zip(matches.alias("m"), groups.alias("g")), gaps, lambda a, b: F.struct(a["m"].alias("m"), a["g"].alias("g"), b.alias("gap")))
    return F.aggregate(F.filter(zipped, lambda x: x["m"].isNotNull()), empty, step, lambda acc: acc["out"])


def _term(c: Column) -> Column:
    """c * log2(c), 0 for 0."""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(s: Column) -> Column:
    """Largest Shannon entropy (bits) of a window of WINDOW characters of s, which has at least that many.

    The sum of c*log2(c) over the window's character counts changes in two terms as the window moves by one.
    """
    first = F.substring(s, 1, WINDOW)
    total = F.aggregate(F.array_distinct(F.split(first, "")), F.lit(0.0), lambda a, ch: a + F.when(ch != "", _term(F.lit(WINDOW) - F.length(F.replace(first, ch, F.lit(""))))).otherwise(0.0))

    def count(window: Column, ch: Column) -> Column:
        return F.length(window) - F.length(F.replace(window, ch, F.lit("")))

    def step(acc: Column, i: Column) -> Column:
        inner = F.substring(s, i + 1, F.lit(WINDOW - 1))  # what the old and the new window share
        gone, new = count(inner, F.substring(s, i, F.lit(1))), count(inner, F.substring(s, i + WINDOW, F.lit(1)))
        now = acc["sum"] + _term(gone) - _term(gone + 1) + _term(new + 1) - _term(new)
        return F.struct(now.alias("sum"), F.least(acc["low"], now).alias("low"))

    moves = F.when(F.length(s) > WINDOW, F.sequence(F.lit(1), F.length(s) - WINDOW)).otherwise(F.array().cast("array<int>"))
    low = let(total, lambda t: F.aggregate(moves, F.struct(t.alias("sum"), t.alias("low")), step, lambda acc: acc["low"]))
    return F.lit(math.log2(WINDOW)) - low / WINDOW


def entropy_spans(text: Column) -> Column:
    """Spans of the random-looking candidate strings of a text."""

    def kind(v: Column) -> Column:
        return F.when(v.rlike(HEX_CLASS), F.lit("entropy_hex")).otherwise(F.lit("entropy_base64"))

    allowed = lambda v: v.rlike("|".join(f"(?:{x})" for x in ALLOWED))
    limit = lambda v: F.when(v.rlike(HEX_CLASS), F.lit(THRESHOLDS["entropy_hex"])).otherwise(F.lit(THRESHOLDS["entropy_base64"]))
    found = F.filter(match_spans(text, "", CANDIDATE, 0, WINDOW), lambda x: ~allowed(x["v"]) & (window_entropy(x["v"]) >= limit(x["v"])))
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), kind(x["v"]).alias("k"), x["v"].alias("v")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with secrets: array<struct<s:int,e:int,k:string,v:string>> in order of start, base kinds first where starts are equal; v is the text found."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("array_repeat(struct(0 AS s, 0 AS e, '' AS k, '' AS v), 0)")
    out = docs.withColumns({f"__{k}": F.when(t.rlike(HINTS[k]), match_spans(t, k, rx, g, n)).otherwise(none) for k, rx, g, n in BASE})
    base = F.concat(*[f"__{k}" for k, *_ in BASE])
    extra = F.when(t.rlike(CANDIDATE), entropy_spans(t)).otherwise(none)
    meets = lambda b, x: F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    both = let(base, lambda b: F.concat(b, F.filter(extra, lambda x: ~meets(b, x))))
    rank = {k: i for i, k in enumerate([*(k for k, *_ in BASE), *THRESHOLDS])}
    order = lambda x: sum((F.when(x["k"] == k, i).otherwise(0) for k, i in rank.items()), F.lit(0))

    def ordered(spans: Column) -> Column:
        keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), order(x).alias("o"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v"))))
        return F.transform(keyed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v")))

    return out.withColumn("secrets", ordered(both)).drop(*[f"__{k}" for k, *_ in BASE])


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["k"].isin(*[k for k, *_ in BASE]))
    return found.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"))
