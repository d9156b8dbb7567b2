"""Operators against plain restatements of what they mean."""

import hashlib
import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternlake.functions import fixed
from lanternlake.functions import text as X
from lanternlake.operators import checks as K
from lanternlake.operators import rules as R
from lanternlake.operators import spans as N
from lanternlake.operators import split as S
from lanternlake.sources import files
from lanternlake.sources.posts import PHRASES
from lanternlake.streaming import state as ST


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_text_examples(spark):
    core = lambda t, a="acct": spark.createDataFrame([(t, a)], "t string, a string").select(X.clean_text(F.col("t"), F.col("a"))).first()[0]
    assert core('47 likes, 1 comments - acct on October 5, 2023: "Study now".') == "Study now"
    assert core("acct Edited • 157w Study now #a #b") == "Study now"
    assert core("other_name 15w  Hello @x see https://a.b \U0001f600 now!") == "Hello see now!"
    assert one(spark, "ﬁne “quote” – x…", X.unify) == 'fine "quote" - x...'
    assert one(spark, "\U0001f600\U0001f600 a ☀", X.emoji_runs) == 2
    assert one(spark, "@A.b. @a.b @", X.mentions) == ["a.b"]
    assert one(spark, "2024-03-01 10:00:00", X.iso_time) == "2024-03-01T10:00:00+00:00"
    assert one(spark, "nonsense", X.iso_time) == "" and one(spark, None, X.iso_time) == ""
    assert one(spark, "non-suspicious", X.binary_label) == 1 and one(spark, "abnormal", X.binary_label) == 0 and one(spark, "1.0", X.binary_label) is None
    assert one(spark, "job scholarship m.sc.", X.crawl_text) == "jobscholarship msc."
    assert one(spark, "/url?q=https%3A%2F%2Finstagram.com%2Fsome.name%2F", X.handle_of) == "some.name"
    assert one(spark, "https://instagram.com/p/abc", X.handle_of) is None


def test_guards_allow_what_patterns_find():
    """Texts of a pattern's own words in odd case and spacing: where it is found, its needs are met."""
    import random

    from lanternlake.functions import guards

    def met(need, low, words):
        if need is None:
            return True
        if need[0] == "any":
            return any(m[1:] in low if m[0] == "~" else m in words for m in need[1])
        return (all if need[0] == "all" else any)(met(n, low, words) for n in need[1])

    rnd = random.Random(1)
    patterns = {r: R.pattern_of(r) for r, *_ in fixed.RULES if r != "RULE_ORG_LINK"} | {"org": X.ORGANISATION_HINT}
    found = 0
    for name, pattern in patterns.items():
        need = guards.needs_of(pattern)
        bits = re.findall(r"[A-Za-z]+|\d+", pattern.replace("\\b", " ").replace("\\s", " ").replace("\\d", "7"))
        for _ in range(400):
            t = "".join(rnd.choice([str.upper, str.lower, str.title])(rnd.choice(bits)) + rnd.choice([" ", " ", "  ", "-", "", ". ", "'s ", " 5 ", "% "]) for _ in range(rnd.randint(2, 12)))
            t = rnd.choice(PHRASES).translate(str.maketrans("İıſ\u212a", "iisk")) + " " + t
            if re.search(pattern, t, re.I):
                found += 1
                assert met(need, t.lower(), set(re.split("[^a-z0-9_]+", t.lower()))), (name, t)
    assert found > 1000


def test_rules_match_python(spark):
    """All rule patterns mean in Spark what they mean in Python, Unicode included."""
    texts = [*PHRASES, "no été visa", "éno tuition", "100 % visa", "Guaranteed admission", "ÄNO IELTS", "İELTS waived", "we got admission for Ann Lee", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord int, t string")
    got = {r["ord"]: r for r in R.rule_flags(rows, "t").collect()}
    for rule, *_ in fixed.RULES:
        if rule == "RULE_ORG_LINK":
            named, term = re.compile(fixed.NAMED_ORGANISATION, re.I), re.compile(fixed.PROGRAM_OR_OUTCOME, re.I)
            for i, t in enumerate(texts):
                t = re.sub(r"\s+", " ", t).strip()
                want = any(term.search(t[max(0, m.start() - 120) : m.end() + 120]) for m in named.finditer(t))
                assert got[i][rule] == int(want), (rule, t)
            continue
        p = re.compile(R.pattern_of(rule), re.I)
        for i, t in enumerate(texts):
            assert got[i][rule] == int(bool(p.search(t))), (rule, t)


def greedy(spans):
    rank = {"manual": 4, "prediction-changed": 3, "prediction": 2}
    kept = []
    for s in sorted(spans, key=lambda s: (-rank.get(s[3], 1), s[0] - s[1])):
        if not any(s[0] < k[1] and k[0] < s[1] for k in kept):
            kept.append(s)
    return sorted(k[:3] for k in kept)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9), st.sampled_from("AB"), st.sampled_from(["manual", "prediction", None])), max_size=12))
def test_resolve_overlaps(spark, raw):
    spans = [(a, a + n, label, o) for a, n, label, o in raw]
    df = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int,label:string,origin:string>>")
    got = df.select(N.resolve_overlaps(F.col("s"))).first()[0]
    assert sorted((x["start"], x["end"], x["label"]) for x in got) == greedy(spans)


def test_folds_and_decisions(spark):
    rows = spark.createDataFrame([(i, f"g{min(i % 17, i % 5)}") for i in range(300)], "id int, g string")
    got = N.group_folds(rows, "g", 3).collect()
    assert len(got) == 300 and all(len({r["fold"] for r in got if r["g"] == g}) == 1 for g in {r["g"] for r in got})
    sizes = {g: sum(r["g"] == g for r in got) for g in {r["g"] for r in got}}
    dealt = sorted(sizes, key=lambda g: (-sizes[g], hashlib.md5(g.encode()).hexdigest()))
    assert {r["g"]: r["fold"] for r in got} == {g: (0, 1, 2, 2, 1, 0)[i % 6] for i, g in enumerate(dealt)}
    rnd = random.Random(4)
    log = [(u, i, f"{u}-{i}", rnd.choice(["label_normal", "skip", "back", "back"])) for u in range(6) for i in range(40)]
    want = []
    for u in range(6):
        stack = []
        for _, i, key, c in (x for x in log if x[0] == u):
            if c == "back":
                stack[-1:] = []
            else:
                stack.append(key)
        want += stack
    got = S.fold_decisions(spark.createDataFrame(log, "reviewer int, seq int, key string, command string"))
    assert sorted(r["key"] for r in got.collect()) == sorted(want)


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"post_id": "1", "post_url": "u", "caption_text": "x", "hashtags": ["A", "b"]}, 5]}')
    (tmp_path / "b_legitimate.json").write_text('[{"post_id": "1", "account_name": "@N", "caption_text": "y #T", "language": "en"}]')
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "registry.json").write_text('[{"handle": "h", "status": "active"}]')
    raw = files.read_post_dir(spark, str(tmp_path))
    assert sorted((r["source_file"], r["post_id"]) for r in raw.collect()) == [("a.json", "1"), ("b_legitimate.json", "1")]
    done = files.normalize(raw).collect()
    assert [(r["post_id"], r["seed_label"], r["hashtags"], r["clean_text"]) for r in done] == [("1", "none", "a|b", "x")]
    out = str(tmp_path / "csv")
    files.write_csv(files.normalize(raw), out)
    assert files.read_csv_text(spark, out).first()["post_id"] == "1"
    tasks = '[{"data": {"post_id": "7", "text": "free visa"}, "annotations": [{"was_cancelled": true, "updated_at": "3", "result": []}, {"updated_at": "2", "result": [{"type": "labels", "value": {"start": 0, "end": 4, "text": "free", "labels": ["COST_CLAIM"]}}, {"type": "labels", "value": {"start": 5, "end": 99, "text": "visa", "labels": ["OUTCOME"]}}, {"type": "choices", "value": {"choices": ["REQUIREMENT_WAIVED"]}}]}]}]'
    (tmp_path / "tasks").mkdir()
    (tmp_path / "tasks" / "t.json").write_text(tasks)
    r = files.read_annotations(spark, str(tmp_path / "tasks" / "t.json")).first()
    assert [s["label"] for s in r["spans"]] == ["COST_CLAIM"] and r["relation_labels"] == ["REQUIREMENT_WAIVED"]


def test_stages(spark, tmp_path):
    from lanternlake.operators.crawl import account_cap
    from lanternlake.plans import stages

    posts = [{"post_id": str(i), "post_url": "u", "account_name": "a", "caption_text": t, "language": "en"} for i, t in enumerate(PHRASES) if t]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "p.json").write_text(json.dumps(posts))
    (tmp_path / "keys.json").write_text(json.dumps([{"data": {"post_id": "1"}}, {"post_id": "2"}]))
    cfg = stages.Config(raw=str(tmp_path / "raw"), annotations=str(tmp_path / "keys.json"))
    rows = stages.run(spark, cfg).collect()
    assert rows and {r["post_id"] for r in rows}.isdisjoint({"1", "2"}) and {r["seed_label"] for r in rows} <= {"normal", "suspicious"}
    caps = spark.createDataFrame([("7.9", None), ("x", "-3"), (None, None)], "a string, b string").select(account_cap("a", "b", default=5).alias("n"))
    assert [r["n"] for r in caps.collect()] == [7, 0, 5]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("saved", (F.col("value") > 50).cast("int"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ST.account_stream(stream.select("user_id", "saved")).writeStream.format("memory").queryName("accounts").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    want = {r["user_id"]: (r["seen"], r["saved"]) for r in ST.account_state(events, F.col("value") > 50).collect()}
    got = {r["user_id"]: (r["seen"], r["saved"]) for r in spark.sql("SELECT user_id, max(seen) AS seen, max(saved) AS saved FROM accounts GROUP BY user_id").collect()}
    assert got == want
    q = ST.capture_once(stream, ["user_id"]).writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) AS n FROM once").first()["n"] == events.select("user_id").distinct().count()


def test_checks_raise(spark):
    """Validations name what they find; cells and bytes fall back."""
    from lanternlake.operators import checks

    rows = spark.createDataFrame([("a", "normal"), ("a", "odd"), ("b", None)], "k string, label string")
    with pytest.raises(ValueError, match="'a', 2"):
        checks.require_none(checks.duplicate_keys(rows, "k"), "selected twice")
    assert {r["label"] for r in checks.unknown_labels(rows, "label").collect()} == {"odd", None}
    checks.require_none(checks.small_classes(rows, "k", 1), "too few")
    assert checks.first_column(["b", "c"], ["a", "c", "b"]) == "c" and checks.first_column([], ["a"]) is None
    assert len(checks.bio_labels()) == 33
    raw = spark.createDataFrame([(bytearray("\ufeffé".encode()),), (bytearray("é".encode()),), (bytearray("é".encode("latin1")),), (bytearray(),)], "b binary")
    assert [r[0] for r in raw.select(checks.decoded(F.col("b"))).collect()] == ["é", "é", "é", ""]
    both = rows.select(checks.payload(rows, ["k", "label", "missing"]).alias("j")).collect()
    assert [r["j"] for r in both] == ['{"k":"a","label":"normal"}', '{"k":"a","label":"odd"}', '{"k":"b","label":null}']
    tags = spark.createDataFrame([("#été #a_b #été x",)], "t string").select(checks.raw_hashtags(F.col("t"))).first()[0]
    assert tags == ["été", "a_b"]


def test_means_at_the_threshold(spark):
    rng, want, rows = random.Random(3), {}, []
    for k in range(300):  # means of 1/2, whose parts are rounded: the sum depends on the order
        half = [rng.randrange(101) for _ in range(5)]
        scores = [x / 101 for x in half + [101 - x for x in half]]
        rng.shuffle(scores)
        total = 0.0
        for m, p in enumerate(scores):
            total += p
            rows.append((k, m, p))
        want[k] = (10, total / 10, int(total / 10 >= 0.5))
    assert len({r for *_, r in want.values()}) == 2
    rng.shuffle(rows)
    out = K.mean_relations(spark.createDataFrame(rows, "post_id int, model int, p_A double").repartition(7), ["A"])
    assert {r["post_id"]: (r["n_models"], r["p_A"], r["re_A"]) for r in out.collect()} == want


def test_patterns_run_in_batches(spark):
    """Rules, crawl tests and spans are found by one pass to Python, and as their patterns have it."""
    from lanternlake.functions import search
    from lanternlake.operators import crawl as C
    from lanternlake.operators import predict as P

    rnd = random.Random(5)
    words = ["University", "of", "Berlin", "Uni-Assist", "uni assist", "the", "TU-Berlin", "School", "x/Hoch", "Institute", "x1", "IU International University", "SRH University", "costume", "a", "admission", "master", "B-C", ", ", "TUM", "no", "IELTS", "été", "received", "Top universities", "free tuition", "\n"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 30))) for _ in range(400)] + ["", None]
    named = re.compile(fixed.NAMED_ORGANISATION, re.I)
    for t in filter(None, texts):
        t = search.squeeze(t)
        assert search.organisations(t) == [m.span() for m in named.finditer(t)], t
    rows = spark.createDataFrame(list(enumerate(texts)), "ord int, t string").withColumn("caption_text", F.col("t"))
    got = {r["ord"]: r["s"] for r in rows.select("ord", P.lexical_spans(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = sorted((*m.span(), x) for x in P.LEXICAL for m in re.finditer(R.pattern_of(f"LEX_{x}"), t or "", re.I))
        assert [(s["start"], s["end"], s["label"]) for s in got[i]] == want and all(s["text"] == t[s["start"] : s["end"]] for s in got[i])
    flags = R.rule_flags(rows, "t", ["RULE_TESTIMONIAL_SUCCESS", "RULE_REQUIREMENT_WAIVED"])
    for r in flags.collect():
        for x in ("RULE_TESTIMONIAL_SUCCESS", "RULE_REQUIREMENT_WAIVED"):
            assert r[x] == int(bool(re.search(R.pattern_of(x), r["t"] or "", re.I))), (x, r["t"])
    for df in (flags, C.score_posts(rows), C.with_skip_reason(rows, "t", F.lit(False)), rows.select(P.lexical_spans(F.col("t")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "RLIKE" not in plan and "regexp_extract_all" not in plan


def test_cleaning_is_one_pass(spark):
    rows = spark.createDataFrame([(' 47 likes, 1 comments - acct on May 5, 2023: "acct 15w Study ’now’ | see translation,  a b #x https://a.b　c".', "@acct", None)], "t string, a string, l string")
    out = rows.select(X.clean_text(F.col("t"), F.col("a")).alias("c"), X.model_text(F.col("t"), F.lit("x"), F.col("l")).alias("m"))
    assert out.first()["c"] == "Study 'now', a b c" and out.first()["m"].endswith("a b x [URL] c\". [HASHTAGS] x")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan


def test_span_metrics_by_size(spark, tmp_path, monkeypatch):
    """One grouping of both sides, in more parts for larger inputs; a span with a null is nobody's match."""
    from lanternlake.operators import running

    names = ["id", "start", "end", "label"]
    gold = spark.createDataFrame([(1, 0, 3, "A"), (1, 0, 3, "A"), (1, 4, 6, "B"), (2, None, 3, "A")], "id int, start int, end int, label string")
    predicted = spark.createDataFrame([(1, 0, 3, "A"), (1, 4, 7, "B"), (2, None, 3, "A")], "id int, start int, end int, label string")
    want = {("A", 1, 1, 1), ("B", 0, 1, 1), ("MICRO", 1, 2, 2), ("MACRO", 1, 2, 2)}
    gold.coalesce(1).write.parquet(f"file://{tmp_path}/g")
    predicted.coalesce(1).write.parquet(f"file://{tmp_path}/p")
    gold, predicted = (spark.read.parquet(f"file://{tmp_path}/{x}") for x in "gp")
    for part in (running.PART, 100):
        monkeypatch.setattr(running, "PART", part)
        out = N.span_metrics(gold.select(*names), predicted.select(*names), "id")
        assert {tuple(r)[:4] for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and ("RepartitionByExpression" in plan) == (part == 100)
