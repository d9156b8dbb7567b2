"""Text functions as Columns.  Patterns run with Unicode classes and case folding, as flags in front of them say."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import fixed
from .clean import clean_text, model_text  # noqa: F401
from .search import ORGANISATION_HINT, WHITE  # noqa: F401

FLAGS = "(?iuUd)"


def rx(pattern: str) -> str:
    """Pattern that ignores case and knows Unicode classes."""
    return FLAGS + pattern


def any_of(patterns: list[str]) -> str:
    """One alternation: cheaper than a test for each pattern.  A word boundary that all begin with is tested once a place."""
    if all(p.startswith(r"\b") for p in patterns):
        return r"\b(?:" + "|".join(f"(?:{p[2:]})" for p in patterns) + ")"
    return "|".join(f"(?:{p})" for p in patterns)


def plain_words(text: Column) -> Column:
    """text with letters and digits outside ASCII as '_' and spaces as ' ': on it, ASCII patterns find what Unicode ones find in
    text, at a fraction of the cost, unless a pattern itself has letters outside ASCII.  The four letters that are i, s and k to
    patterns which ignore case become those."""
    t = F.regexp_replace(F.translate(null_safe(text), "İıſ\u212a", "iisk"), r"[\p{L}\p{N}\p{M}&&[^\x00-\x7F]]", "_")
    return F.regexp_replace(t, r"[\p{Z}\u0085&&[^\x00-\x7F]]", " ")


def plain_rx(pattern: str) -> str:
    """Pattern for plain_words()."""
    return "(?id)" + pattern


def flag(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern)).cast("int")


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with columns that come out of a generator: later filters and projections aren't merged into it, so that each
    expression runs once a row however often its column is used."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def unpacked(rows: DataFrame, packed: Column) -> DataFrame:
    """rows with the fields of a struct as columns, behind a generator as in once(): the struct is computed once a row."""
    return rows.withColumn("__packed", packed).select("*", F.inline(F.array("__packed"))).drop("__packed")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def null_safe(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def first_text(*columns: str) -> Column:
    """The first of columns that isn't blank, by row."""
    return F.coalesce(*[F.when(strip(F.col(c)) != "", F.col(c)) for c in columns], F.lit(""))


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def unify(text: Column, compose: bool = True) -> Column:
    """Plain punctuation: no-break space, curly quotes, dashes and dots; NFKC in between unless the text is known to be stable."""
    t = F.translate(null_safe(text), " ", " ")
    t = nfkc(t) if compose else t
    return F.replace(F.translate(t, "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))


def strip_ui(text: Column, compose: bool = True) -> Column:
    """Without the likes-and-comments prefix and the quotation marks that it leaves."""
    t = strip(F.regexp_replace(unify(text, compose), "(?s)" + rx(fixed.LIKES_PREFIX), ""))
    t = F.when(t.startswith('"'), strip(F.substring(t, F.lit(2), F.length(t)))).otherwise(t)
    cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    return F.when(t.endswith('".'), F.concat(F.regexp_replace(cut(2), r"(?U)\s+$", ""), F.lit("."))).when(t.endswith('"'), strip(cut(1))).otherwise(t)


def url_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rx(fixed.URL)))


def emoji_runs(text: Column) -> Column:
    """Runs of emoji: neighbours count once."""
    return F.regexp_count(text, F.lit(fixed.EMOJI))


def mentions(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(fixed.MENTION), F.lit(1)), lambda m: F.trim(F.lower(m), F.lit(".")))
    return F.array_distinct(F.filter(found, lambda m: m != ""))


def hashtags(field: Column, text: Column) -> Column:
    """Tags of the field (a list in text form) and of the text, lower-case, each once."""
    both = F.concat(F.split(null_safe(field), r"[|,\s\[\]'\"]+"), F.regexp_extract_all(text, F.lit(fixed.HASHTAG), F.lit(1)))
    plain = F.transform(both, lambda t: F.lower(F.regexp_replace(t, "[^A-Za-z0-9_]", "")))
    return F.array_distinct(F.filter(plain, lambda t: t != ""))


def seed_label(value: Column, file: Column, missing: str = "none") -> Column:
    raw = F.when(strip(null_safe(value)) == "", F.lit(missing)).otherwise(F.lower(strip(value)))
    known = F.create_map(*[F.lit(x) for pair in fixed.LABEL_ALIASES.items() for x in pair])
    label = F.coalesce(F.element_at(known, raw), F.lit("none"))
    return F.when((label == "none") & F.contains(F.lower(file), F.lit("legitimate")), F.lit("legitimate")).otherwise(label)


def iso_time(value: Column) -> Column:
    """ISO time in UTC, or an empty text."""
    at = F.try_to_timestamp(value)
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(at, "SSSSSS")
    return F.coalesce(F.concat(whole, F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(F.lit("")), F.lit("+00:00")), F.lit(""))


def match_text(text: Column) -> Column:
    """Caption text for exact matching: no marker, no links, lower-case, plain quotes, single spaces."""
    t = F.regexp_replace(null_safe(text), r"(?i)^\s*\[CAPTION\]\s*", "")
    t = F.regexp_replace(t, r"https?://\S+|www\.\S+", " ")
    t = F.lower(F.translate(t, "​ ", "  "))
    return squeeze(F.translate(t, "‘’“”", "''\"\""))


def fingerprint(text: Column) -> Column:
    return F.sha1(match_text(text).cast("binary"))


def _replaced(t: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def crawl_text(text: Column) -> Column:
    """Normalised for the suspicious-post filter: degrees first, then spaces."""
    t = _replaced(F.lower(null_safe(text)), fixed.DEGREES_A)
    return squeeze(F.translate(t, " ", " "))


def binary_label(value: Column) -> Column:
    """1 suspicious, 0 normal, null for all else."""
    s = F.lower(strip(value.cast("string")))
    has = lambda x: F.contains(s, F.lit(x))
    return F.when(s.isin(fixed.POSITIVE_LABELS), 1).when(s.isin(fixed.NEGATIVE_LABELS), 0).when(s.isin(fixed.DROPPED_LABELS), None).when(has("suspicious"), 1).when(has("normal") | has("legit"), 0)


def number(value: Column) -> Column:
    """Numbers out of booleans and texts: empty ones are 0."""
    s = F.lower(strip(value.cast("string")))
    return F.when(s == "true", 1.0).when(s.isin("false", "[]", "none", "", "nan"), 0.0).otherwise(s.try_cast("double"))


def handle_of(url: Column) -> Column:
    """Account name in a profile link; null for other links and excluded names."""
    query = F.try_parse_url(url, F.lit("QUERY"), F.lit("q"))
    wrapped = url.startswith("/url?") | F.contains(url, F.lit("google.com/url"))
    inner = F.try_parse_url(F.concat(F.lit("https://google.com"), url), F.lit("QUERY"), F.lit("q"))
    target = F.coalesce(F.when(wrapped, F.try_url_decode(F.coalesce(query, inner))), F.try_url_decode(url), url)
    name = F.trim(F.lower(F.regexp_extract(target, fixed.HANDLE_IN_URL, 1)), F.lit("/."))
    return F.when((name != "") & ~excluded_handle(name), name)


def excluded_handle(handle: Column) -> Column:
    h = F.trim(F.trim(F.lower(null_safe(handle))), F.lit("/."))
    return h.isin("", *fixed.KNOWN_ACCOUNTS) | ~h.rlike(fixed.HANDLE) | F.contains(h, F.lit("..")) | h.rlike("|".join(fixed.BAD_HANDLES))


def valid_handle(handle: Column) -> Column:
    h = F.lower(F.trim(null_safe(handle)))
    return h.rlike(fixed.HANDLE) & ~h.isin(fixed.RESERVED_HANDLES)
