"""Queries of sources, text normalisation, crawl filters and splits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..operators import crawl as C
from ..operators import split as S
from ..sources.posts import posts, quote, sql

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle is not None:
            O[name] = oracle
        return f

    return add


def alt(patterns: list[str]) -> str:
    return quote("|".join(f"(?:{p})" for p in patterns))


#: Non-ASCII letters as word characters for the SQL side, whose \b knows ASCII only.
def ascii_words(x: str) -> str:
    return f"regexp_replace(translate({x}, 'İıſ\u212a', 'iisk'), '[^\\x00-\\x7F]', '_', 'g')"


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SQUEEZE = "regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
EMOJI_SQL = fixed.EMOJI


@query(
    "scan_project_posts",
    sql() + "SELECT post_id, 'https://example.org/p/' || post_id AS post_url, 'instagram' AS platform, lower(ltrim(trim(account_name), '@')) AS account_name, caption_text, coalesce(nullif(lower(trim(language)), ''), 'en') AS language FROM posts",
)
def scan_project_posts(spark, sf):
    p = posts(spark, sf)
    return p.select("post_id", F.concat(F.lit("https://example.org/p/"), "post_id").alias("post_url"), F.lit("instagram").alias("platform"), F.lower(F.ltrim(F.trim("account_name"), F.lit("@"))).alias("account_name"), "caption_text", F.coalesce(F.nullif(F.lower(F.trim("language")), F.lit("")), F.lit("en")).alias("language"))


def _clean_sql() -> str:
    def chain(x: str, steps: list[tuple[str, str, str]]) -> str:
        for pattern, by, opts in steps:
            x = f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, {quote(opts)})"
        return x

    unquote = "CASE WHEN starts_with({0}, '\"') THEN " + STRIP.format("substring({0}, 2)") + " ELSE {0} END"
    tail = "CASE WHEN ends_with({0}, '\".') THEN rtrim(left({0}, length({0}) - 2), E' \\n\\t\\r') || '.' WHEN ends_with({0}, '\"') THEN " + STRIP.format("left({0}, length({0}) - 1)") + " ELSE {0} END"
    unified = "replace(translate(replace(caption_text, chr(160), ' '), '‘’“”–—', '''''\"\"--'), '…', '...')"
    steps = [
        f"u0 AS (SELECT *, {STRIP.format(chain(unified, [(fixed.LIKES_PREFIX, '', 'is')]))} AS t FROM posts)",
        f"u1 AS (SELECT * REPLACE ({unquote.format('t')} AS t) FROM u0)",
        f"u2 AS (SELECT * REPLACE ({tail.format('t')} AS t) FROM u1)",
        "u3 AS (SELECT *, '^\\s*@?' || regexp_replace(lower(ltrim(trim(account_name), '@')), '([^A-Za-z0-9_])', '\\\\\\1', 'g') AS head FROM u2)",
        f"u4 AS (SELECT * REPLACE ({STRIP.format(f'regexp_replace(t, head || {quote(fixed.ON_DATE)}, {quote("")}, {quote("i")})')} AS t) FROM u3)",
        "u5 AS (SELECT * REPLACE (" + STRIP.format("regexp_replace(t, head || " + quote("\\s+" + fixed.AGE) + ", '', 'i')") + " AS t) FROM u4)",
        "u6 AS (SELECT * REPLACE (" + STRIP.format(chain("t", [("^\\s*@?" + fixed.ANY_ACCOUNT + "\\s+" + fixed.AGE, "", "i")])) + " AS t) FROM u5)",
        "u7 AS (SELECT * REPLACE (" + STRIP.format(chain("t", [(fixed.TRAILING_TAGS, "", "")])) + " AS t) FROM u6)",
        "u8 AS (SELECT * REPLACE (" + chain("t", [(fixed.URL, " ", "gi"), (fixed.MENTION, " ", "g"), (fixed.HASHTAG, " ", "g"), ("#", " ", "g"), (fixed.EMOJI, " ", "g"), (fixed.UI_NOISE, " ", "gi"), ("\\s*[|•·]+\\s*", " ", "g"), ("\\s+", " ", "g"), ("\\s+([,.;:!?])", "\\1", "g")]) + " AS t) FROM u7)",
    ]
    return ", ".join(steps)


@query("clean_text", sql(_clean_sql()) + "SELECT post_id, trim(t, E' \\t\\n\\r\"''.,;:-–—') AS clean_text FROM u8")
def clean_text(spark, sf):
    return posts(spark, sf).select("post_id", X.clean_text(F.col("caption_text"), F.col("account_name")).alias("clean_text"))


@query(
    "model_text",
    sql(
        "m0 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(translate(caption_text, '‘’“”–—', '''''\"\"--'), '…', '...'), "
        + f"{quote(fixed.URL)}, ' [URL] ', 'gi'), {quote(fixed.MENTION)}, ' [MENTION] ', 'g'), {quote(fixed.HASHTAG)}, ' \\1 ', 'g'), {quote(fixed.EMOJI)}, ' [EMOJI] ', 'g') AS t, "
        + f"array_to_string(list_transform(regexp_extract_all(caption_text, {quote(fixed.HASHTAG)}, 1), lambda x: lower(x)), ' ') AS tags, "
        + "CASE WHEN ord % 3 = 0 THEN 'https://a.org' ELSE '' END AS link FROM posts), "
        + "m1 AS (SELECT * REPLACE ("
        + SQUEEZE.format("regexp_replace(regexp_replace(regexp_replace(t, '(?:\\[URL\\]\\s*){2,}', '[URL] ', 'g'), '(?:\\[MENTION\\]\\s*){2,}', '[MENTION] ', 'g'), '(?:\\[EMOJI\\]\\s*){2,}', '[EMOJI] ', 'g')")
        + " AS t) FROM m0), m2 AS (SELECT *, concat_ws(' ', CASE WHEN t <> '' THEN '[CAPTION] ' || t END, CASE WHEN tags <> '' THEN '[HASHTAGS] ' || tags END) AS parts FROM m1)"
    )
    + "SELECT post_id, concat_ws(' ', nullif(parts, ''), CASE WHEN link <> '' AND NOT contains(parts, '[URL]') THEN '[EXTERNAL_LINK] [URL]' END) AS model_text FROM m2",
)
def model_text(spark, sf):
    p = posts(spark, sf).withColumn("link", F.when(F.col("ord") % 3 == 0, "https://a.org").otherwise(""))
    tags = F.array_join(X.hashtags(F.lit(""), F.col("caption_text")), " ")
    return p.select("post_id", X.model_text(F.col("caption_text"), tags, F.col("link")).alias("model_text"))


@query(
    "mentions_hashtags",
    sql(f"m AS (SELECT post_id, list_filter(list_transform(regexp_extract_all(caption_text, {quote(fixed.MENTION)}, 1), lambda x: trim(lower(x), '.')), lambda x: x <> '') AS m, list_transform(regexp_extract_all(caption_text, {quote(fixed.HASHTAG)}, 1), lambda x: lower(x)) AS h, caption_text FROM posts)")
    + f"SELECT post_id, array_to_string(list_sort(list_distinct(m)), '|') AS mentions, array_to_string(list_sort(list_distinct(h)), '|') AS hashtags, CAST(len(regexp_extract_all(caption_text, {quote(fixed.URL)}, 0, 'i')) AS INT) AS url_count FROM m",
)
def mentions_hashtags(spark, sf):
    t = F.col("caption_text")
    return posts(spark, sf).select("post_id", F.array_join(F.array_sort(X.mentions(t)), "|").alias("mentions"), F.array_join(F.array_sort(X.hashtags(F.lit(None).cast("string"), t)), "|").alias("hashtags"), X.url_count(t).alias("url_count"))


@query("emoji_runs", sql() + f"SELECT post_id, CAST(len(regexp_extract_all(caption_text, {quote(EMOJI_SQL)})) AS INT) AS emoji_count FROM posts")
def emoji_runs(spark, sf):
    return posts(spark, sf).select("post_id", X.emoji_runs(F.col("caption_text")).alias("emoji_count"))


def _label_case(x: str) -> str:
    return f"CASE {' '.join(f'WHEN {x} = {quote(k)} THEN {quote(v)}' for k, v in fixed.LABEL_ALIASES.items())} ELSE 'none' END"


@query(
    "seed_label_map",
    sql(f"l AS (SELECT post_id, CASE WHEN ord % 7 = 0 THEN 'legitimate_posts.json' ELSE 'posts.json' END AS f, {_label_case('lower(trim(given_label))')} AS x FROM posts)") + "SELECT post_id, CASE WHEN x = 'none' AND contains(lower(f), 'legitimate') THEN 'legitimate' ELSE x END AS seed_label FROM l",
)
def seed_label_map(spark, sf):
    file = F.when(F.col("ord") % 7 == 0, "legitimate_posts.json").otherwise("posts.json")
    return posts(spark, sf).select("post_id", X.seed_label(F.col("given_label"), file).alias("seed_label"))


@query("dedup_first", sql() + "SELECT phrase, min(ord) AS ord, arg_min(account_name, ord) AS account_name FROM posts GROUP BY phrase")
def dedup_first(spark, sf):
    return S.keep_first(posts(spark, sf).select("phrase", "ord", "account_name"), "phrase", "ord")


@query("quality_filter", sql() + f"SELECT language, {_label_case('lower(trim(given_label))')} AS seed_label, count(*) AS n FROM posts WHERE language = 'en' AND trim(caption_text) <> '' AND post_id <> '' GROUP BY 1, 2")
def quality_filter(spark, sf):
    p = posts(spark, sf).filter((F.col("language") == "en") & (X.strip(F.col("caption_text")) != "") & (F.col("post_id") != ""))
    return p.groupBy("language", X.seed_label(F.col("given_label"), F.lit("posts.json")).alias("seed_label")).agg(F.count(F.lit(1)).alias("n"))


_MATCH_SQL = SQUEEZE.format("translate(lower(translate(regexp_replace(regexp_replace(caption_text, '^\\s*\\[CAPTION\\]\\s*', '', 'i'), 'https?://\\S+|www\\.\\S+', ' ', 'g'), chr(8203) || chr(160), '  ')), '‘’“”', '''''\"\"')")
_FP = f"f AS (SELECT *, sha1({_MATCH_SQL}) AS fp FROM posts)"


@query("fingerprint_sha1", sql(_FP) + "SELECT post_id, fp FROM f")
def fingerprint_sha1(spark, sf):
    return posts(spark, sf).select("post_id", X.fingerprint(F.col("caption_text")).alias("fp"))


@query("fingerprint_stats", sql(_FP + ", g AS (SELECT fp, count(*) AS n FROM f GROUP BY fp)") + "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_texts, CAST(coalesce(sum(CASE WHEN n > 1 THEN 1 END), 0) AS BIGINT) AS duplicate_groups, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS duplicate_rows FROM g")
def fingerprint_stats(spark, sf):
    return S.fingerprint_stats(posts(spark, sf).select(X.fingerprint(F.col("caption_text")).alias("fp")), "fp")


@query(
    "fingerprint_overlap",
    "WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, sha1(" + _MATCH_SQL.replace("caption_text", "text") + ") AS fp FROM documents), l AS (SELECT fp, array_to_string(list_sort(list(DISTINCT id)), ',') AS left_ids FROM d WHERE doc_id % 2 = 0 GROUP BY fp), r AS (SELECT fp, array_to_string(list_sort(list(DISTINCT id)), ',') AS right_ids FROM d WHERE doc_id % 2 = 1 GROUP BY fp) SELECT fp, left_ids, right_ids FROM l JOIN r USING (fp) ORDER BY fp LIMIT 20",
)
def fingerprint_overlap(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("id"), X.fingerprint(F.col("text")).alias("fp"))
    return S.fingerprint_overlap(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "fp", "id")


_ENGLISH = f"(length({STRIP.format('caption_text')}) >= 40 AND length(regexp_replace(caption_text, '[^\\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace(caption_text, '[^A-Za-z]', '', 'g')) >= 0.75 * length(regexp_replace(caption_text, '[^\\p{{L}}]', '', 'g')) AND regexp_matches({ascii_words('lower(caption_text)')}, {quote(fixed.ENGLISH_WORDS)}))"


@query("english_heuristic", sql() + f"SELECT post_id, {_ENGLISH} AS english_like FROM posts")
def english_heuristic(spark, sf):
    return posts(spark, sf).select("post_id", C.looks_english(F.col("caption_text")).alias("english_like"))


def _degrees(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {quote(a)}, {quote(b)})"
    return x


_CRAWL = f"c0 AS (SELECT *, {ascii_words(SQUEEZE.format(_degrees('lower(caption_text)', fixed.DEGREES_A)))} AS t FROM posts)"
_HITS = ", ".join(f"CAST(regexp_matches(t, {alt(ps)}, 'i') AS INT) AS hit_{g}" for g, (_, ps) in fixed.TRIGGERS.items())
_SCORE = " + ".join(f"hit_{g} * {float(w)}" for g, (w, _) in fixed.TRIGGERS.items())
_NHITS = " + ".join(f"hit_{g}" for g in fixed.TRIGGERS)
_C = f"{_CRAWL}, c1 AS (SELECT *, {_HITS} FROM c0), c2 AS (SELECT *, round(CAST({_SCORE} AS DOUBLE), 3) AS score, (NOT regexp_matches(t, {alt(fixed.BAD_CONTENT)}) AND regexp_matches(t, {alt(fixed.SCOPE)})) AS target_scope, {_ENGLISH} AS english_like, (hit_guaranteed_outcome = 1 OR hit_requirement_waived = 1) AS high_risk FROM c1), c3 AS (SELECT *, (target_scope AND english_like AND (high_risk OR (score >= 2.5 AND {_NHITS} >= 2))) AS save_candidate FROM c2)"


@query("crawl_score", sql(_C) + f"SELECT post_id, score, high_risk, target_scope, english_like, {', '.join(f'hit_{g}' for g in fixed.TRIGGERS)} FROM c3")
def crawl_score(spark, sf):
    return C.score_posts(posts(spark, sf)).select("post_id", "score", "high_risk", "target_scope", "english_like", *[f"hit_{g}" for g in fixed.TRIGGERS])


@query("crawl_candidates", sql(_C) + "SELECT post_id, account_name, score FROM c3 WHERE save_candidate")
def crawl_candidates(spark, sf):
    return C.score_posts(posts(spark, sf)).filter("save_candidate").select("post_id", "account_name", "score")


@query("crawl_cap_per_account", sql(_C + ", n AS (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY ord) AS i FROM c3 WHERE save_candidate)") + "SELECT post_id, account_name, score FROM n WHERE i <= 3")
def crawl_cap_per_account(spark, sf):
    found = C.score_posts(posts(spark, sf)).filter("save_candidate")
    return C.cap_by_account(found, 3, "ord").select("post_id", "account_name", "score")


_LEGIT_TEXT = STRIP.format(_degrees("regexp_replace(regexp_replace(regexp_replace(lower(caption_text), '[‐-–—]', '-', 'g'), '\\s+', ' ', 'g'), '[!?.]{2,}', ' ', 'g')", fixed.DEGREES_B))


@query(
    "legit_filter_reasons",
    sql(
        f"g0 AS (SELECT *, {ascii_words(_LEGIT_TEXT)} AS t FROM posts), g1 AS (SELECT CASE WHEN ord % 11 = 0 THEN 'existing' WHEN trim(caption_text) = '' THEN 'no_caption' WHEN NOT {_ENGLISH} THEN 'non_english' WHEN NOT regexp_matches(t, {alt([p for ps in fixed.LEGITIMATE.values() for p in ps])}) THEN 'irrelevant' WHEN regexp_matches(t, {alt(fixed.EXCLUDED_CONTENT)}) THEN 'excluded' ELSE 'saved' END AS reason FROM g0)"
    )
    + "SELECT reason, count(*) AS n FROM g1 GROUP BY reason",
)
def legit_filter_reasons(spark, sf):
    rows = C.with_skip_reason(posts(spark, sf), "caption_text", F.col("ord") % 11 == 0)
    return rows.groupBy(F.coalesce("reason", F.lit("saved")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_HANDLES = "h AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'explore' WHEN 1 THEN '.bad' || c_custkey WHEN 2 THEN 'Name_' || c_custkey WHEN 3 THEN 'fu_berlin' WHEN 4 THEN 'two..dots' ELSE 'ok.' || c_custkey || '/' END AS handle FROM customer)"


def _handles(spark, sf):
    k = F.col("c_custkey")
    names = ["explore", F.concat(F.lit(".bad"), k), F.concat(F.lit("Name_"), k), "fu_berlin", "two..dots"]
    case = F.when(k % 6 == 0, names[0])
    for i in range(1, 5):
        case = case.when(k % 6 == i, names[i])
    return spark.read.parquet(f"{sf}/customer.parquet").select(k, case.otherwise(F.concat(F.lit("ok."), k, F.lit("/"))).alias("handle"))


_EXCLUDED = f"(h IN ('', {', '.join(map(quote, fixed.KNOWN_ACCOUNTS))}) OR NOT regexp_matches(h, {quote(fixed.HANDLE)}) OR contains(h, '..') OR regexp_matches(h, {alt(fixed.BAD_HANDLES)}))"


@query("handle_validity", f"WITH {_HANDLES}, n AS (SELECT *, trim(trim(lower(handle)), '/.') AS h FROM h) SELECT c_custkey, (regexp_matches(lower(trim(handle)), {quote(fixed.HANDLE)}) AND lower(trim(handle)) NOT IN ({', '.join(map(quote, fixed.RESERVED_HANDLES))})) AS valid, {_EXCLUDED} AS excluded FROM n")
def handle_validity(spark, sf):
    return _handles(spark, sf).select("c_custkey", X.valid_handle(F.col("handle")).alias("valid"), X.excluded_handle(F.col("handle")).alias("excluded"))


@query(
    "handle_from_url",
    f"WITH {_HANDLES}, u AS (SELECT c_custkey, regexp_extract('https://www.instagram.com/' || rtrim(handle, '/') || '/?hl=en', 'instagram\\.com/([A-Za-z0-9._]{{2,30}})(?:[/?#]|$)', 1) AS raw FROM h), n AS (SELECT *, trim(lower(raw), '/.') AS h FROM u) SELECT c_custkey, CASE WHEN h <> '' AND NOT regexp_matches(raw, '^(p|reel|reels|explore|stories|tv|tags)$') AND NOT {_EXCLUDED} THEN h END AS found FROM n",
)
def handle_from_url(spark, sf):
    url = F.concat(F.lit("https://www.instagram.com/"), F.rtrim("handle", F.lit("/")), F.lit("/?hl=en"))
    return _handles(spark, sf).select("c_custkey", X.handle_of(url).alias("found"))


@query("search_queries", None)
def search_queries(spark, sf):
    """Seeds by suffixes, and combinations of terms in a seeded order; each once, at most 120.  The lists are fixed and small."""
    rows = lambda xs, name: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"{name}_i int, {name} string")
    seeds = rows([f"{a} {b}" for a in fixed.QUERY_SEEDS for b in fixed.QUERY_SUFFIXES], "q").select(F.lit(0).alias("part"), F.col("q_i").cast("string").alias("o"), F.col("q").alias("query"))
    terms = [" ".join(x) for x in ((a, b, c, d) for a in fixed.QUERY_SCOPES for b in fixed.QUERY_RISKS for c in fixed.QUERY_SERVICES for d in fixed.QUERY_SUFFIXES)]
    more = rows(terms, "q").select(F.lit(1).alias("part"), F.md5(F.col("q").cast("binary")).alias("o"), F.col("q").alias("query")).orderBy("o").limit(80)
    both = S.keep_first(seeds.union(more).withColumn("k", F.lower("query")).withColumn("at", F.struct("part", "o")), "k", "at")
    return both.orderBy("part", "o").limit(fixed.MAX_QUERIES).select("query")


@query(
    "page_links",
    "WITH l AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, '<a\\b[^>]*?href=[\"'']([^\"''#]+)', 1), lambda u: rtrim(regexp_replace(CASE WHEN starts_with(u, '/') THEN 'https://example.org' || u ELSE u END, '\\?.*$', ''), '/'))) AS links FROM pages) SELECT page_id, array_to_string(list_sort(links), ' ') AS links FROM l",
)
def page_links(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.array_join(F.array_sort(C.page_links(F.col("html"))), " ").alias("links"))


@query(
    "page_caption",
    "WITH p AS (SELECT page_id, " + SQUEEZE.format("regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is'), '<[^>]+>', ' ', 'g')") + " AS a, " + SQUEEZE.format("regexp_extract(html, '<meta[^>]*property=[\"'']og:description[\"''][^>]*content=[\"'']([^\"'']*)[\"'']', 1, 'is')") + " AS b FROM pages) SELECT page_id, coalesce(nullif(a, ''), nullif(b, ''), '') AS caption FROM p",
)
def page_caption(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", C.page_caption(F.col("html")).alias("caption"))


@query("external_link", sql() + "SELECT post_id, rtrim(list_filter(regexp_extract_all(caption_text, 'https?://[^\\s]+'), lambda u: NOT contains(u, 'instagram.com'))[1], '.,);]') AS link FROM posts")
def external_link(spark, sf):
    return posts(spark, sf).select("post_id", C.external_link(F.col("caption_text")).alias("link"))


# ---------------------------------------------------------------------------------------------------- joins and splits


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("post_id"), "source", "lang")


def _labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").cast("string").alias("post_id"), "quality", "toxic")


_D = "d AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS post_id, source, lang FROM documents), l AS (SELECT CAST(doc_id AS VARCHAR) AS post_id, quality, toxic FROM labels)"


@query("candidates_anti", f"WITH {_D} SELECT * FROM d WHERE post_id NOT IN (SELECT post_id FROM l)")
def candidates_anti(spark, sf):
    return S.without(_docs(spark, sf), _labels(spark, sf), "post_id")


@query("gold_semi", f"WITH {_D} SELECT d.*, quality, CASE WHEN toxic = 1 THEN 'suspicious' ELSE 'normal' END AS seed_label FROM d JOIN l USING (post_id)")
def gold_semi(spark, sf):
    chosen = _labels(spark, sf).select("post_id", "quality", F.when(F.col("toxic") == 1, "suspicious").otherwise("normal").alias("seed_label"))
    return _docs(spark, sf).join(chosen, "post_id")


@query("silver_anti", f"WITH {_D} SELECT source, lang, count(*) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.post_id = d.post_id AND toxic = 1) GROUP BY source, lang")
def silver_anti(spark, sf):
    return S.without(_docs(spark, sf), _labels(spark, sf).filter("toxic = 1"), "post_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("leakage_anti", f"WITH {_D}, k AS (SELECT *, CASE WHEN post_id IN (SELECT post_id FROM l WHERE quality = 0) THEN 1 ELSE 0 END AS hit FROM l) SELECT CAST(sum(1 - hit) AS BIGINT) AS kept, CAST(sum(hit) AS BIGINT) AS removed FROM k")
def leakage_anti(spark, sf):
    l = _labels(spark, sf)
    kept = S.without(l, l.filter("quality = 0"), "post_id").agg(F.count(F.lit(1)).alias("kept"))
    return kept.withColumn("removed", F.lit(l.count()) - F.col("kept"))


@query("subset_audit", f"WITH {_D}, g AS (SELECT post_id, count(*) AS g FROM l GROUP BY 1), s AS (SELECT post_id, count(*) AS s FROM d WHERE lang = 'en' GROUP BY 1), b AS (SELECT * FROM g FULL JOIN s USING (post_id)) SELECT CAST(sum(g) AS BIGINT) AS gold_rows, CAST(sum(s) AS BIGINT) AS silver_rows, CAST(sum(g) - count(g) AS BIGINT) AS gold_duplicates, CAST(sum(s) - count(s) AS BIGINT) AS silver_duplicates, CAST(count(CASE WHEN g IS NOT NULL AND s IS NOT NULL THEN 1 END) AS BIGINT) AS shared, CAST(count(CASE WHEN g IS NOT NULL AND s IS NULL THEN 1 END) AS BIGINT) AS missing, count(CASE WHEN g IS NOT NULL AND s IS NULL THEN 1 END) = 0 AS is_subset FROM b")
def subset_audit(spark, sf):
    return S.subset_audit(_labels(spark, sf), _docs(spark, sf).filter("lang = 'en'"))


@query("round_robin", f"WITH {_D}, t AS (SELECT post_id, source, row_number() OVER (PARTITION BY source ORDER BY ord) AS turn FROM d) SELECT post_id, source, CAST(turn AS INT) AS turn FROM t ORDER BY turn, source LIMIT 150")
def round_robin(spark, sf):
    return S.first_in_turn(_docs(spark, sf), 150, "source", "ord").select("post_id", "source", "turn")


_RENAMED = "r AS (SELECT ord, post_id, CASE source WHEN 'src1' THEN 'fu_berlin' WHEN 'src2' THEN 'daad_worldwide' WHEN 'src3' THEN 'gisma_university' WHEN 'src4' THEN 'goethe_x' ELSE source END AS source FROM d)"


@query(
    "quota_fill",
    f"WITH {_D}, {_RENAMED}, g AS (SELECT *, CASE WHEN source IN ({', '.join(map(quote, fixed.OFFICIAL_ACCOUNTS))}) THEN 'official_public' WHEN source IN ({', '.join(map(quote, fixed.PRIVATE_ACCOUNTS))}) THEN 'private_university' WHEN regexp_matches(source, {alt(fixed.OFFICIAL_PARTS)}) THEN 'official_public' ELSE 'private_university_unmapped' END AS legit_group FROM r), "
    "o AS (SELECT *, CAST(contains(source, 'daad') AS INT) AS part, row_number() OVER (PARTITION BY source ORDER BY ord) AS turn FROM g), a AS (SELECT * FROM o WHERE legit_group = 'official_public' ORDER BY part, turn, source LIMIT 20), b AS (SELECT * FROM o WHERE legit_group <> 'official_public' ORDER BY turn, source LIMIT (30 + 20 - (SELECT count(*) FROM a))) SELECT post_id, source, legit_group FROM a UNION ALL SELECT post_id, source, legit_group FROM b",
)
def quota_fill(spark, sf):
    s = F.col("source")
    named = F.when(s == "src1", "fu_berlin").when(s == "src2", "daad_worldwide").when(s == "src3", "gisma_university").when(s == "src4", "goethe_x").otherwise(s)
    return S.quota_fill(_docs(spark, sf).withColumn("source", named), 20, 30, "source", "ord").select("post_id", "source", "legit_group")


@query("quota_stop", f"WITH {_D}, j AS (SELECT ord, source, CASE WHEN toxic = 1 THEN 'suspicious' ELSE 'normal' END AS label FROM d JOIN l USING (post_id)), w AS (SELECT *, coalesce(sum(CAST(label = 'normal' AS INT)) OVER x, 0) AS a, coalesce(sum(CAST(label = 'suspicious' AS INT)) OVER x, 0) AS b FROM j WINDOW x AS (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT ord, source, label FROM w WHERE a < 5 OR b < 2")
def quota_stop(spark, sf):
    j = _docs(spark, sf).join(_labels(spark, sf), "post_id").select("ord", "source", F.when(F.col("toxic") == 1, "suspicious").otherwise("normal").alias("label"))
    return S.quota_stop(j, 5, 2, "ord", group="source")


@query("label_counts", sql() + "SELECT given_label AS label, account_name, count(*) AS n FROM posts GROUP BY 1, 2 ORDER BY n DESC, label, account_name LIMIT 20")
def label_counts(spark, sf):
    return posts(spark, sf).groupBy(F.col("given_label").alias("label"), "account_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label", "account_name").limit(20)


@query("fold_decisions", None)
def fold_decisions(spark, sf):
    """Review log made of events: purchase-like ones are decisions, every fifth takes one back."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    command = F.when(F.col("event_id") % 5 == 0, "back").when(F.col("event_id") % 3 == 0, "label_suspicious").otherwise("label_normal")
    log = e.select(F.col("user_id").alias("reviewer"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("key"), command.alias("command"))
    return S.fold_decisions(log)


@query("stratified_split", f"WITH {_D}, w AS (SELECT post_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(post_id), post_id) AS i, count(*) OVER (PARTITION BY quality) AS n FROM l) SELECT post_id, quality, CAST(i <= ceil(0.2 * n) AS INT) AS is_validation FROM w")
def stratified_split(spark, sf):
    return S.stratified_split(_labels(spark, sf).drop("toxic"), "quality", "post_id", 0.2)
