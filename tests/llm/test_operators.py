"""The operators against brute force, and their defined results for odd input."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanternlake import llm
from lanternlake.llm import common, license_scan, line_dedup, lm_scoring, lm_words, near_dedup, packing, quality_classifier, quality_rules, source_mixing, topk_search
from lanternlake.llm.common import fold_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def odd_documents(spark):
    rnd = random.Random(3)
    long = prose(rnd, 30000)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n ", None, None), (4, "one two", "en", None), (None, prose(rnd, 40), "en", "b"), (None, None, "en", "b"), (5, long, "en", "b"), (6, long, "en", "b"), (7, "x" * 70000, "en", "c")]
    rows += [(8, "same words here again and again in this very row so it is kept", "en", "a")] * 3
    rows += [(100 + i, prose(rnd, 60) + "\nShared footer of the site", "en", "d") for i in range(12)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)


OPERATORS = {
    1: lambda d: llm.secret_scan.scan(d),
    2: lambda d: lm_scoring.score(d, fold_of(F.col("doc_id"), 5) == 1),
    3: lambda d: near_dedup.near_duplicates(d),
    6: lambda d: source_mixing.mix(d),
    7: lambda d: quality_rules.judge(s := quality_rules.with_failures(d), quality_rules.host_verdicts(s)),
    8: lambda d: packing.pack(d),
    9: lambda d: license_scan.scan(d),
    10: lambda d: line_dedup.dedup_lines(d),
}


@pytest.mark.parametrize("n", OPERATORS)
def test_odd_input(spark, n):
    """Nulls, empty and long texts, repeated rows, clashing extra columns: every document has its rows."""
    docs = odd_documents(spark)
    clash = docs.withColumns({"n_words": F.lit("x"), "size": F.lit("y"), "length": F.lit(1), "bands": F.lit(0), "id": F.lit("z"), "t": F.lit(2), "rank": F.lit(9)})
    rows = OPERATORS[n](clash).collect()
    got = Counter(r["doc_id"] for r in rows)
    want = Counter(r["doc_id"] for r in docs.collect())
    assert set(got) == set(want)
    if n != 8:
        assert got == want


@pytest.mark.parametrize("n", OPERATORS)
def test_empty_table(spark, n):
    assert OPERATORS[n](spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(8)
    texts = {}
    for g in range(12):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(30, 300))]
        for k in range(rnd.randint(1, 12)):
            w = list(base)
            for _ in range(k % 4):
                w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(10**6)
            texts[len(texts)] = " ".join(w)
    for _ in range(80):
        texts[len(texts)] = prose(rnd, rnd.randint(0, 200))
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], DOCS)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}

    def shingles(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets = {i: shingles(t) for i, t in texts.items()}
    df_of = Counter(s for c in sets.values() for s in c)
    n = len(texts)
    weight = lambda s: max(near_dedup.IDF_FLOOR, min(1.0, np.log(n / df_of[s]) / np.log(1 / near_dedup.COMMON))) if df_of[s] >= max(near_dedup.COMMON * n, near_dedup.LEAST_COMMON) else 1.0

    def jaccard(a, b):
        low = sum(min(a[s], b[s]) * weight(s) for s in a.keys() & b.keys())
        high = sum(max(a[s], b[s]) * weight(s) for s in a.keys() | b.keys())
        return low / high if high else 1.0

    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and (sets[i].keys() & sets[j].keys() or not (sets[i] or sets[j])) and jaccard(sets[i], sets[j]) >= near_dedup.SIMILARITY:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in texts}


def test_star_of_copies_is_one_class(spark):
    """Copies that are alike only through their original, which centres of buckets miss."""
    rnd = random.Random(5)
    base = [rnd.choice(WORDS) for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        w = list(base)
        for at in rnd.sample(range(0, 400, 5), 5):
            w[at] = "edit%d" % rnd.randrange(10**9)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(rnd, 50)) for i in range(100)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(301) if got[i]] == []


def test_pairs_without_centres_are_all_judged(spark, monkeypatch):
    """open_links() alone, of buckets in several pieces, joins what verifying every pair joins."""
    monkeypatch.setattr(near_dedup, "PIECE", 7)
    rnd = random.Random(6)
    base = [rnd.choice(WORDS) for _ in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rnd.sample(range(0, 100, 5), 1 + i % 3):
            w[at] = "edit%d" % rnd.randrange(10**9)
        rows.append((" ".join(w),))
    docs = spark.createDataFrame(rows, "t string")
    common = (np.zeros(0, np.uint64), np.zeros(0))
    classes = near_dedup.materialize(near_dedup.signatures(docs.select(F.lit("1").alias("id"), "t"), common), "classes")
    sets = near_dedup.shingle_sets(docs)
    members = near_dedup.buckets(classes)
    got = near_dedup.open_links(members.withColumn("comp", F.col("fp")), classes, sets, common)
    pairs = classes.select(F.col("fp").alias("a")).crossJoin(classes.select(F.col("fp").alias("b"))).filter("a < b")
    want = near_dedup.verified(pairs, sets, common)
    parts = lambda links: sorted(map(tuple, near_dedup.components(links).collect()))
    assert parts(got) == parts(want) != []


def test_common_shingles_do_not_depend_on_the_candidate_bound(spark, monkeypatch):
    """Also where each document is a partition, whose chunk names all its shingles."""
    rnd = random.Random(9)
    line = [prose(rnd, 8) for _ in range(6)]
    rows = [(" ".join([prose(rnd, 9)] + [x for k, x in enumerate(line) if i % (8 << k) == 0]),) for i in range(640)]
    docs = spark.createDataFrame(rows, "t string")
    total, (keys, idf) = near_dedup.common_shingles(docs.coalesce(1))
    assert len(keys) and idf.max() > 0.9
    monkeypatch.setattr(near_dedup, "MOST_COMMON", 3)
    again, (same, also) = near_dedup.common_shingles(docs.repartition(40))
    assert (total, keys.tolist(), idf.tolist()) == (again, same.tolist(), also.tolist())


def test_documents_without_own_ids_are_told_apart(spark):
    """Near-copies without ids are one class, and keep one document; texts that share an id keep one each."""
    rnd = random.Random(4)
    base, other, first = prose(rnd, 200), prose(rnd, 100), prose(rnd, 100)
    rows = [(None, base), (None, base), (None, base + " extra"), (5, other), (5, first), (6, other + " extra"), (5, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_copies"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == {(None, 3): 3, (5, 2): 3, (6, 2): 1}
    kept = near_dedup.one_of_each(docs).collect()
    assert sorted(r["text"] for r in kept if r["doc_id"] == 5) == sorted([other, first])
    assert len(kept) == 3 and sum(r["doc_id"] is None for r in kept) == 1


def test_icws_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    s = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    w = rng.choice([0.5, 1.0, 2.0], 3000)
    a, b = slice(0, 2000), slice(800, 3000)
    sampler = near_dedup.Sampler()
    x, y = sampler.draw(s[a], w[a], np.array([0]))[0], sampler.draw(s[b], w[b], np.array([0]))[0]
    true = near_dedup.weighted_jaccard((s[a], w[a]), (s[b], w[b]))
    assert abs((x == y).mean() - true) < 0.2


def test_topk_matches_brute_force(spark, monkeypatch):
    """Ties, odd rows, components beyond 64-bit products, several rounds and blocks."""
    monkeypatch.setattr(topk_search, "ROUND", 15)
    monkeypatch.setattr(topk_search, "BLOCK", 64)
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 9, (700, 16))).astype(int)
    x[50:90] = x[50]
    vectors = {i: [float(c) for c in v] for i, v in enumerate(x)}
    vectors |= {700: [1e30] + [1.0] * 15, 701: [-1e30] + [3.0] * 15, 702: [3e9] * 16, 720: [2e9] * 16, 703: [float(2**52 + 1)] + [1.0] * 15}
    rows = [*vectors.items(), (900, None), (901, [1.0] * 15 + [None]), (902, [1.0] * 15 + [float("nan")]), (903, [1.0] * 15 + [float("inf")]), (None, [1.0] * 16), (920, [2.0, 3.0]), (940, [])]
    got = topk_search.search(spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumns({"x": F.lit(1), "id": F.lit("z"), "rank": F.lit(2), "score": F.lit(3)}), lambda i: i % 20 == 0, k=7).collect()
    want = []
    for q in (i for i in vectors if i % 20 == 0):
        score = {i: topk_search.integer_product(np.asarray(vectors[q]), np.asarray(vectors[i])) for i in vectors if i != q}
        order = sorted(score, key=lambda i: (-score[i], i))[:7]
        want += [(q, r + 1, i, score[i]) for r, i in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.search(spark.createDataFrame([], "vec_id long, vector array<int>"), lambda i: i % 20 == 0).count() == 0


def test_topk_query_on_odd_components(spark, tmp_path):
    rows = [(0, [1e30, 0.5]), (20, [0.015, -0.015]), (21, [float("nan"), 1.0]), (22, [2.0, 2.0]), (23, None), (None, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, topk_search.op4_topk_search(spark, f"file://{tmp_path}").collect()))
    assert got == [(0, 1, 22, 2**63 - 1), (0, 2, 20, -32), (20, 1, 0, -32), (20, 2, 22, -128)]


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 5, (40, 64)), rng.normal(0, 5, (60, 64))
    exact = x @ y.T
    for m in topk_search.LEVELS:
        assert (topk_search.statistics(x, m) @ topk_search.statistics(y, m).T >= exact - 1e-9).all()


def test_encoder_matches_tokenizer():
    rnd = random.Random(1)
    e = packing.Encoder(None)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "!", "'s", "<|endoftext|>", " ", "　", "the", " foo", "\0", "\x1c", "😀"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_matches_tokenizer_on_documents():
    """Whole documents of all languages, long and non-Latin texts, chunks that look like special tokens; also as chunks are forgotten."""
    import duckdb

    texts = [r[0] or "" for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["漢字かな交じり文 と 空白　全角 " * 50, "слова на кириллице " * 300, "עברית ועוד <|endoftext|> x<|endoftext|> <|endoftext|>", "a" * 20000, "é " * 5000, "🙂🙃 🙂 👩‍👩‍👧 " * 40, " lead", "trail ", "\n\n x \n y"]
    e, small = packing.Encoder(None), packing.Encoder(None)
    want = [e.ids(t) for t in texts]
    assert list(map(e.encode, texts)) == want
    before, packing.CACHE = packing.CACHE, 500
    try:
        assert list(map(small.encode, texts)) == want
    finally:
        packing.CACHE = before


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    e = packing.Encoder(None)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, ps in by_doc.items():
        ps.sort(key=lambda r: r["piece"])
        ids = b"".join(bytes(p["ids"]) for p in ps)
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(texts[i], add_special_tokens=False).ids + [2]
        assert [p["length"] for p in ps[1:]] == [1024] * (len(ps) - 1)
        assert [p["start"] for p in ps] == np.cumsum([0] + [p["length"] for p in ps[:-1]]).tolist()
    for ps in by_sequence.values():
        ps.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in ps] == np.cumsum([0] + [p["length"] for p in ps[:-1]]).tolist() and sum(p["length"] for p in ps) <= 1024
    assert len(by_sequence) <= 1.05 * sum(r["length"] for r in rows) / 1024 + 1


def test_plan_holds_every_length():
    rnd = random.Random(5)
    for _ in range(8):
        counts = Counter(rnd.randint(1, 1023) for _ in range(rnd.randint(0, 3000)))
        got = Counter()
        for n, used in packing.plan(dict(counts)):
            assert sum(used) <= 1024
            for u in used:
                got[u] += n
        assert got == counts


def test_lm_scores(spark):
    rows = lm_scoring.op2_lm_scoring(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in [*lm_scoring.tokens(t), b""])
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = [*lm_scoring.tokens(texts[r["doc_id"]]), b""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r["score"] < 0 and np.isfinite(r["score"])


def test_lm_is_a_distribution():
    """Bytes of one place share a probability of 1: no set of words that none begins another exceeds it."""
    counts = np.zeros(2 * lm_scoring.STARTS[-1], np.float32)
    ws = [b"the", b"then", b"a", b"", b"of"]
    lm_scoring.add_counts(ws, np.array([50, 5, 20, 10, 30]), counts)
    mixer = lm_scoring.Mixer(counts)
    mixer.learn(ws, np.array([50, 5, 20, 10, 30]))
    model = lm_scoring.Mixer(counts, mixer.weights, lm_scoring.refined_cells(mixer.ones, mixer.all))
    single = [bytes([b]) for b in range(33, 256)] + [b""]
    assert 0 < (10 ** model.log10(single)).sum() <= 1
    p = 10 ** model.log10([b"the", b"zqx", b"of" * 40])
    assert p[0] > p[1] > p[2] >= 0


def test_lm_word_shares_add_up_to_one():
    """After any two words the shares of all known words and the share of all others are 1, learned weights and map included."""
    rnd = random.Random(5)
    words = [min(rnd.randint(2, 40), rnd.randint(2, 40)) for _ in range(3000)]
    c = Counter(words)
    seen = Counter(zip([0, *words], [0, 0, *words], words))  # noqa: B905
    some = [np.array(x) for x in zip(*((*k, n, c[k[2]]) for k, n in seen.items()), strict=True)]
    sizes = (len(words), len(c), sum(n == 1 for n in c.values()))
    learned = lm_words.WordMixer(*sizes)
    learned.learn(lm_words.merged(*some)[0])
    model = lm_words.WordMixer(*sizes, learned.weights, lm_scoring.refined_cells(learned.hits, learned.all))
    assert not np.array_equal(learned.weights, lm_words.start_weights())
    for w1, w2 in [(words[0], 0), (words[50], words[49]), (words[7], 999), (998, 999)]:
        every = [np.array(x) for x in zip(*((w1, w2, w, seen[w1, w2, w], c[w]) for w in [1, *c]), strict=True)]
        others = [x[(some[0] == w1) & (some[1] != w2)] for x in some]
        got, place = lm_words.merged(*(np.concatenate(x) for x in zip(every, others, strict=True)))
        assert (10 ** model.log10(got))[place[: len(c) + 1]].sum() == pytest.approx(1)


def test_lm_knows_the_order_of_words(spark):
    """Prose scores above its shuffled words and above the base; neither the dealing nor the order of rows changes scores."""
    rnd = random.Random(4)
    follow = {w: rnd.sample(WORDS, 2) for w in WORDS}

    def chain(n):
        out = [rnd.choice(WORDS)]
        while len(out) < n:
            out.append(rnd.choice(follow[out[-1]]))
        return out

    rows = [(i, " ".join(chain(60)), False) for i in range(300)]
    for i in range(300, 320):
        words = chain(60)
        rows += [(i, " ".join(words), True), (i + 1000, " ".join(rnd.sample(words, 60)), True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r["doc_id"]: r for r in lm_scoring.score(docs.repartition(1), F.col("held")).collect()}
    for i in range(300, 320):
        assert got[i]["score"] > got[i + 1000]["score"] + 10
        assert got[i]["base_score"] == pytest.approx(got[i + 1000]["base_score"])
        assert got[i]["score"] > got[i]["base_score"]
    for r in lm_scoring.score(docs.repartition(5, "text").orderBy("text"), F.col("held")).collect():
        assert r["score"] == pytest.approx(got[r["doc_id"]]["score"], rel=1e-5)


def test_lm_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    """Triples, chunks and words are off the disk before the result is read; what is left is read again, so it is whole."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = lm_scoring.op2_lm_scoring(spark, SF)
    left = [spark.read.schema(lm_scoring.SCHEMA).parquet(str(p)) for p in (tmp_path / "lanternlake").iterdir()]
    assert {r["kind"] for x in left for r in x.select("kind").distinct().collect()} == {"texts", "shares", "spelled"}
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_lm_split_is_tokens():
    """Words split by Arrow are those of tokens(): six spaces part words, none is lost, other spaces and capitals stay."""
    texts = ["", " ", "\na  B\t\x0b\x0cc\r ", "\x1c x\x85y \u00c9 z\u3000Q", "one", "\x00 \u00a0"]
    found, length = lm_scoring.split(pa.array(texts))
    assert [x.encode() for x in found.to_pylist()] == [w for t in texts for w in lm_scoring.tokens(t)]
    assert length.tolist() == [len(lm_scoring.tokens(t)) + 1 for t in texts]


def test_lm_calls_dont_grow_with_words(monkeypatch):
    """Chunks, numbers and spelling handle words as arrays: with 20 times the words there are as many calls from Python."""
    import cProfile

    class Table:  # hands out what it is given to run
        columns = ()

        def __getattr__(self, name):
            return (lambda run, schema: run) if name.startswith(("map", "apply")) else lambda *_: self

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)

    def calls(work):
        profile = cProfile.Profile()
        out = profile.runcall(work)
        return out, sum(x.callcount for x in profile.getstats())

    monkeypatch.setattr(lm_scoring, "TaskContext", Task)
    seen = defaultdict(list)
    for n in (1000, 1000, 20_000):  # the first warms up
        words = [b"w%05d" % i for i in range(n)]
        texts = [b" ".join(words).decode(), b" ".join(words[: n // 2]).decode(), "x"]
        docs = pa.RecordBatch.from_pydict({"id": ["a", "b", "c"], "held_out": [False, False, True], "t": texts})
        out, k = calls(lambda docs=docs: list(lm_scoring.chunked(Table(), 4)(iter([docs]))))
        seen["chunks"].append(k)
        rows = out[0].to_pandas()
        rows = rows[(rows["kind"] == "words") & (rows["bucket"] == zlib.crc32(b"x") % 4)]
        out, k = calls(lambda rows=rows: lm_scoring.numbered(Table(), 4)((zlib.crc32(b"x") % 4,), rows))
        seen["numbers"].append(k)
        found = {r["kind"]: r for r in out.to_dict("records")}
        mine = [w for w in words if zlib.crc32(w) % 4 == zlib.crc32(b"x") % 4]
        assert [w for w in lm_scoring.parted(lm_scoring.unpack(found["known"]["x"])) if w] == mine
        assert lm_scoring.parted(lm_scoring.unpack(found["unknown"]["x"])) == [b"x"]
        assert found["known"]["ones"] == sum(w in set(words[n // 2 :]) for w in mine)
        seen["spelling"].append(calls(lambda words=words: lm_scoring.Coded(words))[1])
    assert all(more - few < 200 for _, few, more in seen.values()), seen


def test_lm_words_as_arrays():
    """Sums of words, and words packed and back, whatever they are."""
    rnd = random.Random(7)
    words = [b"", b"a", b"\x00\xff", b"x" * 47, b"y" * 48, b"z" * 49, b"q" * 5000, *(rnd.randbytes(rnd.randint(0, 90)) for _ in range(300))]
    for some in (words, words[:1], words[6:7], []):
        array = pa.array(some, pa.large_binary())
        assert lm_scoring.crcs(array).tolist() == [zlib.crc32(w) for w in some]
        x = lm_scoring.unpack(lm_scoring.pack(lm_scoring.joined(array)))
        assert lm_scoring.arrayed(x).to_pylist() == lm_scoring.parted(x) == some
    assert lm_scoring.parted(lm_scoring.joined(pa.array(words, pa.large_binary()).slice(3, 9))) == words[3:12]
    coded = lm_scoring.Coded(words)
    parts = defaultdict(bytes)
    for size, owner, row in sorted(zip(coded.size.tolist(), coded.owner.tolist(), coded.bytes, strict=True), key=lambda x: -x[0]):
        parts[owner] += row[:size].tobytes()
        assert not row[size:].any()
    assert [parts[i] for i in range(len(words))] == [w + b" " if w else b"\n" for w in words]


def test_lm_order_and_lookup():
    """Rows are sorted as their columns, whether these fit one number as they are, by rank or not at all."""
    rnd = random.Random(8)
    for most, columns in ((300, 3), (1 << 31, 3), (200, 12), (0, 3)):
        some = [np.array([rnd.randint(0, most) for _ in range(600)]) for _ in range(columns)]
        some = [np.append(x, x[:50]) for x in some]
        rows = list(zip(*(x.tolist() for x in some), strict=True))
        order, new = lm_words.ordered(*some)
        assert sorted(order.tolist()) == list(range(650))
        assert [rows[i] for i in order] == sorted(rows)
        assert [rows[i] for i in order[new]] == sorted(set(rows))
    assert [len(x) for x in lm_words.ordered(*[np.zeros(0, np.int64)] * 3)] == [0, 0]
    for most in (500, 1 << 31):
        keys = np.array(rnd.sample(range(most), 200))
        assert lm_words.looked_up(keys, keys * 3, keys[::-1]).tolist() == (keys[::-1] * 3).tolist()
    assert lm_words.kinds_of(np.array([5, 2, 5, 0])).tolist() == [0, 2, 5]


def test_lm_words_step_by_step(monkeypatch):
    """Stretches end where a word's entries end, none is over-long but for one word's own."""
    monkeypatch.setattr(lm_words, "STEP", 10)
    w1 = np.repeat(np.arange(7), [3, 3, 9, 25, 1, 10, 4])
    assert lm_words.steps(w1) == [(0, 15), (15, 40), (40, 51), (51, 55)]
    assert lm_words.steps(w1[:0]) == []


def test_lm_packed_triples_come_back():
    """Packed triples are the same again, and smaller than their columns."""
    rnd = random.Random(6)
    for n in (1, 2, 5000):
        c = [0, 0, *(rnd.randint(1, 9**5) for _ in range(300))]
        rows = sorted({(rnd.choice([0, 1, rnd.randint(2, 300)]), rnd.randint(0, 300), min(rnd.randint(1, 301), rnd.randint(1, 301))) for _ in range(n)})
        w1, w2, w = np.array(rows).T
        some = [w1, w2, w, np.array([rnd.randint(0, 3) for _ in rows]), np.array(c)[w]]
        x = lm_scoring.packed_triples(*some)
        assert all(np.array_equal(a, b) for a, b in zip(some, lm_scoring.unpacked_triples(x), strict=True))
    assert len(x) < 0.8 * len(lm_scoring.pack(dict(zip(["w1", "w2", "w", "n", "c"], some, strict=True))))


def test_classifier(spark):
    found = quality_classifier.op5_quality_classifier(spark, "/root/testdata/sf0.01")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    share = np.mean([r["quality"] for r in rows])
    assert right > max(share, 1 - share)
    none = quality_classifier.fit(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert quality_classifier.score(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), none).agg(F.min("score")).first()[0] == 0.5


def test_classifier_score_is_softmax_of_mean_vector(spark, monkeypatch):
    """Each score again, from the vectors: mean by document, output, softmax; text ids, odd rows and clashing columns included."""
    kept = {}

    def train(samples):  # the same descent, with its vectors kept
        rng = np.random.default_rng(quality_classifier.SEED)
        d = quality_classifier.DIMENSIONS
        vectors, out, bias, steps = rng.uniform(-1 / d, 1 / d, (quality_classifier.BUCKETS, d)), np.zeros((d, 2)), np.zeros(2), 0
        for _ in range(quality_classifier.EPOCHS):
            for i in rng.permutation(len(samples)):
                rows, shares, y = samples[i]
                rate = quality_classifier.RATE * (1 - steps / (quality_classifier.EPOCHS * len(samples)))
                steps += 1
                hidden = sum(s * vectors[r] for r, s in zip(rows, shares))
                p = np.exp(hidden @ out + bias)
                p = p / p.sum() - np.eye(2)[y]
                back = out @ p
                out, bias = out - rate * np.outer(hidden, p), bias - 0.1 * rate * p
                for r, s in zip(rows, shares):
                    vectors[r] -= rate * np.sqrt(len(rows)) * s * back
        kept.update(vectors=vectors, out=out, bias=bias)
        return real(samples)

    real = quality_classifier.train
    monkeypatch.setattr(quality_classifier, "train", train)
    rnd = random.Random(12)
    good, bad = WORDS[:70], WORDS[50:]
    rows = [(f"d{i}", " ".join(rnd.choice(good if i % 2 else bad) for _ in range(20)), i % 2) for i in range(80)]
    rows += [("n", None, None), ("e", "", None), (None, "some text", None), ("s", " \n ", None), ("r", "bal bal bal", None), ("r", "bal bal bal", None), ("l", "bal dem " * 40_000, None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id string, text string").withColumns({"t": F.lit(1), "y": F.lit(0), "id": F.lit("q"), "score": F.lit("x"), "__id": F.lit(5)})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None] + [("d0", 1), ("d2", 7)], "doc_id string, quality int")
    model = quality_classifier.fit(docs, labels, F.lit(True))
    got = sorted(((r["doc_id"] or "", r["score"]) for r in quality_classifier.score(docs, model).collect()))
    want = []
    for i, t, _ in rows:
        found, shares = quality_classifier.document_features(t or "", {})
        z = (shares @ kept["vectors"][found] if len(found) else np.zeros(quality_classifier.DIMENSIONS)) @ kept["out"] + kept["bias"]
        want.append((i or "", np.exp(z[1]) / np.exp(z).sum()))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)] and np.allclose([p for _, p in got], [p for _, p in sorted(want)], atol=1e-5)
    assert quality_classifier.score(spark.createDataFrame([], docs.schema), model).count() == 0


def test_mixing_meets_targets(spark):
    rows = source_mixing.op6_source_mixing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, target, most = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert all(abs(taken[s] - target[s]) <= 2 * most[s] + 1 for s in target)
    total = sum(r["size"] for r in rows)
    assert sum(target.values()) == pytest.approx(total)


def license_texts():
    """(text, licences) of whole, wrapped, repeated and adjacent licence texts."""
    import textwrap

    of = {v: k for k, v in license_scan.SENTENCES.items()}
    owner = "Copyright (c) 2020 A. Person"
    mit = ["MIT License", owner, of["mit_grant"] + ":", of["mit_notice"] + "."]
    bsd = [of["bsd_head"] + ":", "1. " + of["bsd_1"] + ".", "2. " + of["bsd_2"] + ".", "3. " + of["bsd_3"] + "."]
    gpl = [owner, "This program is free software: " + of["gpl3_terms"] + "."]
    isc = [owner, of["isc_grant"] + "."]
    apache = [owner, of["apache_head"] + ";", of["apache_comply"] + ".", of["apache_copy"], "    http://www.apache.org/licenses/LICENSE-2.0"]
    want = [(mit, ["MIT"]), (bsd, ["BSD-3-Clause"]), (bsd[:3], ["BSD-2-Clause"]), (gpl, ["GPL-3.0-or-later"]), (isc, ["ISC"]), (apache, ["Apache-2.0"])]
    want += [(bsd + bsd, ["BSD-3-Clause"]), (gpl + gpl, ["GPL-3.0-or-later"]), (bsd[:3] + bsd, ["BSD-3-Clause", "BSD-2-Clause"]), (mit + gpl + mit, ["MIT", "GPL-3.0-or-later"])]
    out = []
    for paragraphs, names in want:
        for lead in ("", "# ", " * ", "// ", ";; "):
            for gap in ("\n\n", "\n"):
                lines = gap.join(textwrap.fill(x, 72) for x in paragraphs).split("\n")
                out += [(end.join((lead + x).rstrip() for x in lines), names) for end in ("\n", "\r\n")]
    out += [("Some words. " + k + ". More words.", None) for k in license_scan.sentences()]
    out += [("// SPDX-License-Identifier: Apache-2.0\nint x;", ["Apache-2.0"]), ("subject to the terms of the x.\nThis Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]), ("SPDX-License-Identifier:\nMIT", []), ("MIT License\nMIT License", ["MIT"]), ("We talk of the MIT License here.", []), ("", []), (None, [])]
    out += [("Released under the MIT License. All rights reserved.\nMIT\nLicense", ["MIT", "proprietary"]), ("All rights\nreserved", ["proprietary"])]
    return out


def test_licenses(spark):
    texts = license_texts()
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, text string")).collect()
    assert [(r["text"], r["licenses"], texts[r["i"]][1]) for r in got if texts[r["i"]][1] is not None and r["licenses"] != texts[r["i"]][1]] == []
    known = license_scan.sentences()
    assert [r["text"] for r in got if texts[r["i"]][1] is None and len(r["license_ids"]) != 1] == []
    import re

    assert all(re.search(license_scan.HINT, s) for s in known) and set(known.values()) >= {x for _, qs in license_scan.RULES for q in qs for x in q.split()}


def test_licenses_match_sql(spark, tmp_path):
    """The registered query and its SQL, on licence texts."""
    import duckdb

    rows = [(i, t) for i, (t, _) in enumerate(license_texts())]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(map(tuple, license_scan.op9_license_scan(spark, f"file://{tmp_path}").collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(license_scan.oracle()).fetchall()) == got


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stats = {r["doc_id"]: r for r in quality_rules.op7_quality_rules(spark, SF).collect()}
    first = corpus_pipeline.keep_by_rules(spark, docs, SF)
    assert first.columns == names and {r["doc_id"] for r in first.collect()} == {i for i, r in stats.items() if r["kept"]}
    second = corpus_pipeline.drop_boilerplate(spark, first, SF)
    assert second.columns == names and second.count() == first.count()
    third = corpus_pipeline.one_of_each_group(spark, second, SF)
    classes = {r["class_id"] for r in near_dedup.near_duplicates(second).collect()}
    assert third.columns == names and sorted(r["doc_id"] for r in third.collect()) == sorted(classes)
    fourth = corpus_pipeline.mix_sources(spark, third, SF)
    times = {r["doc_id"]: r["times"] for r in source_mixing.mix(third).collect()}
    assert fourth.columns == names and Counter(r["doc_id"] for r in fourth.collect()) == Counter({i: n for i, n in times.items() if n})
    packed = corpus_pipeline.pack_sequences(spark, fourth, SF)
    assert packed.filter("piece = 0").count() == fourth.count()


def test_host_verdicts_act(spark):
    """A host that fails mostly loses its clean documents, too; a trusted one may fail one soft rule; nothing of others changes."""
    rnd = random.Random(2)
    clean = lambda: prose(rnd, 40)
    symbols = lambda: prose(rnd, 40) + " ###### ******"
    rows = [("bad", "x x")] * 90 + [("bad", clean())] * 10 + [("good", clean()) for _ in range(400)] + [("good", symbols())] + [("mid", clean()) for _ in range(90)] + [("mid", symbols()) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    stats = quality_rules.with_failures(docs)
    kept = Counter(r["source"] for r in quality_rules.judge(stats, quality_rules.host_verdicts(stats)).filter("kept").collect())
    assert kept == {"good": 401, "mid": 90}
    assert Counter(r["source"] for r in quality_rules.filter_documents(docs).collect()) == kept


def test_scratch_deletes_its_own_paths_only(spark):
    """Results of two queries that live at once stay readable."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, second = near_dedup.near_duplicates(docs), source_mixing.mix(docs)
    n = first.count()
    third = line_dedup.dedup_lines(docs)
    with common.scratch(spark):
        inner = common.materialize(docs.select("doc_id"), "inner")
        kept = common.materialize(docs.select("doc_id"), "kept", keep=True)
    assert first.count() == second.count() == third.count() == kept.count() == n
    with pytest.raises(Exception, match="(?i)exist"):
        inner.count()


def test_shared_folder():
    """The session's own setting; without one, a temporary folder where Spark is local, and an error on a cluster."""

    class Session:
        def __init__(self, folder, master):
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder)})
            self.sparkContext = type("Context", (), {"master": master})

    assert common.shared_dir(Session("hdfs://x/y", "yarn")) == "hdfs://x/y"
    local = common.shared_dir(Session(None, "local[2]"))
    assert local.startswith("file:///") and common.shared_dir(Session(None, "local[2]")) == local
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(None, "spark://host:7077"))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_input(spark, stage):
    """Each stage takes nulls, empty and long texts, repeated rows, clashing columns, and an empty table."""
    function = dict(corpus_pipeline.STAGES)[stage]
    docs = odd_documents(spark).withColumns({"n_words": F.lit("x"), "size": F.lit("y"), "length": F.lit(1), "id": F.lit("z"), "rank": F.lit(9), "kept": F.lit(True), "key": F.lit("k"), "n_lines": F.lit(0)})
    out = function(spark, docs, SF)
    ids = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in out.collect()} <= ids
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert function(spark, spark.createDataFrame([], docs.schema), SF).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
