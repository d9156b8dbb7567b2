"""Crawl filters: trigger score, scope, language, legitimate keywords, caps by account."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, search
from ..functions import text as X


def looks_english(text: Column) -> Column:
    """At least 40 characters, three quarters of the letters ASCII, and a common word."""
    return search.english(text)


#: Alternations that score_posts() and with_skip_reason() test.
TESTS = {f"hit_{g}": ps for g, (_, ps) in fixed.TRIGGERS.items()} | {"scope": fixed.SCOPE, "bad": fixed.BAD_CONTENT}
SKIP_TESTS = {"relevant": [p for ps in fixed.LEGITIMATE.values() for p in ps], "excluded": fixed.EXCLUDED_CONTENT}


def with_tests(rows: DataFrame, text: Column, normal: Callable[[str], str], tests: dict[str, list[str]]) -> DataFrame:
    """rows with english_like and a boolean column for each of tests: whether one of its patterns is found in normal(text)."""
    return X.unpacked(rows, search.tests(text, normal, {k: X.any_of(ps) for k, ps in tests.items()}))


def score_posts(posts: DataFrame, text: str = "caption_text") -> DataFrame:
    """posts with group flags (hit_*), score, groups (array), high_risk, target_scope, english_like, save_candidate.

    One alternation a group; each pattern runs once a row.
    """
    out = with_tests(posts, F.col(text), search.crawl_text, TESTS)
    out = out.withColumns({f"hit_{g}": F.col(f"hit_{g}").cast("int") for g in fixed.TRIGGERS})
    score = sum((F.col(f"hit_{g}") * F.lit(float(w)) for g, (w, _) in fixed.TRIGGERS.items()), F.lit(0.0))
    groups = F.filter(F.array(*[F.when(F.col(f"hit_{g}") == 1, F.lit(g)) for g in fixed.TRIGGERS]), lambda g: g.isNotNull())
    out = out.withColumns({"score": F.round(score, 3), "groups": groups, "high_risk": F.greatest(*[F.col(f"hit_{g}") for g in fixed.HIGH_RISK]) == 1})
    out = out.withColumns({"target_scope": F.col("scope") & ~F.col("bad")})
    enough = (F.col("score") >= fixed.MIN_SCORE) & (F.size("groups") >= fixed.MIN_GROUPS)
    return out.withColumn("save_candidate", F.col("target_scope") & F.col("english_like") & (F.col("high_risk") | enough)).drop("scope", "bad")


def matched_patterns(text: Column) -> Column:
    """array<struct<group,pattern>> of all trigger patterns that a text meets."""
    t = X.plain_words(X.crawl_text(text))
    each = [F.when(t.rlike(X.plain_rx(p)), F.struct(F.lit(g).alias("group"), F.lit(p).alias("pattern"))) for g, (_, ps) in fixed.TRIGGERS.items() for p in ps]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def cap_by_account(rows: DataFrame, cap: int, order: str, account: str = "account_name", saved: Column | None = None) -> DataFrame:
    """Rows up to and with the cap-th saved one of each account, in order."""
    saved = F.lit(1) if saved is None else saved.cast("int")
    w = Window.partitionBy(account).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("__n", F.sum(saved).over(w)).withColumn("__s", saved)
    return kept.filter((F.col("__n") < cap) | ((F.col("__n") == cap) & (F.col("__s") == 1))).drop("__n", "__s")


def account_cap(*columns: str, default: int) -> Column:
    """The first of columns that is a number, cut to a whole number of at least 0; else the default."""
    number = lambda c: F.greatest(F.lit(0), F.col(c).try_cast("double").cast("int"))
    return F.coalesce(*[F.when(F.col(c).try_cast("double").isNotNull(), number(c)) for c in columns], F.lit(default))


def with_skip_reason(posts: DataFrame, text: str, seen: Column, name: str = "reason") -> DataFrame:
    """posts with the first reason to skip a legitimate-account post, or null.  Patterns are tried last, and only where a word of
    theirs occurs."""
    out = with_tests(posts, F.col(text), search.legit_text, SKIP_TESTS)
    reason = F.when(seen, "existing").when(X.strip(X.null_safe(F.col(text))) == "", "no_caption").when(~F.col("english_like"), "non_english").when(~F.col("relevant"), "irrelevant").when(F.col("excluded"), "excluded")
    return X.once(out, {name: reason}).drop(*SKIP_TESTS, "english_like")


def external_link(text: Column) -> Column:
    """First link that is not on the platform, without marks at its end."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"https?://[^\s]+"), F.lit(0)), lambda u: ~F.contains(u, F.lit("instagram.com")))
    return F.rtrim(F.get(found, F.lit(0)), F.lit(".,);]"))


def page_links(html: Column, base: str = "https://example.org", part: str | None = None) -> Column:
    """Targets of links, absolute, without query and last slash, each once in order; with part, of those that hold it."""
    raw = F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*?href=["']([^"'#]+)"""), F.lit(1))
    raw = F.filter(raw, lambda u: F.contains(u, F.lit(part))) if part else raw
    full = F.transform(raw, lambda u: F.when(u.startswith("/"), F.concat(F.lit(base), u)).otherwise(u))
    return F.array_distinct(F.transform(full, lambda u: F.rtrim(F.regexp_replace(u, r"\?.*$", ""), F.lit("/"))))


def page_caption(html: Column) -> Column:
    """First non-empty of h1, og:description and the post's own block."""
    part = lambda rx: X.squeeze(F.regexp_replace(F.regexp_extract(html, rx, 1), "<[^>]+>", " "))
    tries = [r"(?is)<h1[^>]*>(.*?)</h1>", r"""(?is)<meta[^>]*property=["']og:description["'][^>]*content=["']([^"']*)["']""", r"""(?is)<div[^>]*class=["']_a9zs["'][^>]*>(.*?)</div>"""]
    return F.coalesce(*[F.nullif(part(t), F.lit("")) for t in tries], F.lit(""))


def longest_caption(html: Column) -> Column:
    """og:description of over 40 characters, else the longest text of headings and spans."""
    meta = X.squeeze(F.regexp_extract(html, r"""(?is)<meta[^>]*property=["']og:description["'][^>]*content=["']([^"']*)["']""", 1))
    texts = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<(?:h1|span)[^>]*>(.*?)</(?:h1|span)>"), F.lit(1)), lambda t: X.squeeze(F.regexp_replace(t, "<[^>]+>", " ")))
    best = F.get(F.array_sort(F.transform(texts, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), F.lit(0))["t"]
    return F.when(F.length(meta) > 40, meta).otherwise(F.coalesce(best, meta))
