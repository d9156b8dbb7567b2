"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Texts of equal words (case and spacing apart) form a class; one text of each class goes on.
2. A text's shingles of five words are weighted by their count times idf, where
       idf = max(IDF_FLOOR, ln(N / df) / ln(1 / COMMON)), at most 1:
   shingles in up to COMMON of all documents weigh 1, commoner ones less.  The few commoner ones are found exactly in two
   passes: what is common in the corpus is common in some chunk of it, so chunks name candidates, which are then counted.
3. ICWS draws one shingle a hash in proportion to its weight; ROWS draws form a band, BANDS bands a signature.  Two texts of
   weighted Jaccard similarity 0.8 share a band with odds of over 99.9 %.
4. Texts that share a band are verified by their exact weighted Jaccard similarity, against centres of the bucket first (see
   link()); links form components.  Then all pairs of a bucket that are still in different components are compared, so that
   no bucket is capped and no link between components is lost.

Components are found by alternating star contraction on tables; nothing of the corpus's size reaches the driver.

Defined results: null and empty texts are one class; a text of one to four words is one shingle; a null id gets the class of
its text, and if all ids of that text are null, its class id is null; repeated rows get equal classes; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import clean_shuffles, file_count, materialize, scratch, table

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 14
SEED = 5
#: Further centres of a bucket in several components, and draws of ROWS * BANDS that agree at least where the similarity is
#: SIMILARITY, but for odds of 2 in 10 million.
CENTRES, LEAST_DRAWS = 4, 28
#: Texts of a bucket that a task compares with as many others.
PIECE = 256
#: Share of documents from which a shingle is common, and the least weight of a shingle.
COMMON, IDF_FLOOR = 0.01, 0.5
#: A shingle is common in this many documents at least.
LEAST_COMMON = 5
#: Documents and shingles of a chunk that names candidates, and the most candidates that are sent to tasks to be counted; more
#: are counted by the cluster.
CHUNK, CHUNK_SHINGLES = 4000, 1_500_000
MOST_COMMON = 1_000_000
#: Random triples of a hash; elements that share one are told apart by their own hash.
TRIPLES = 4096
#: Bytes of text handled at once.
BLOCK_BYTES = 1 << 18


class Shingler:
    """Shingles of many texts at once: words are hashed as polynomials of their bytes, taken from one running sum."""

    def __init__(self):
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.grow(BLOCK_BYTES)

    def grow(self, n: int) -> None:
        base = np.uint64(0x9E3779B97F4A7C55)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.powers = np.cumprod(np.full(n, base, np.uint64))
        self.inverses = np.cumprod(np.full(n, inverse, np.uint64))

    @staticmethod
    def plain(text: str | None) -> bytes:
        return (text or "").lower().encode("utf-8", "surrogatepass")

    def sets(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of plain() texts, its distinct shingles in order of hash, and their counts."""
        out = []
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) < BLOCK_BYTES):
                size += len(texts[b]) + 1
                b += 1
            out += self.block(texts[a:b])
            a = b
        return out

    def block(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        if len(data) > len(self.powers):
            self.grow(len(data))
        edges = np.flatnonzero(np.diff(~self.space[data]))
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        h = (h ^ (ends - starts).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        places = np.cumsum([1] + [len(t) + 1 for t in texts])
        first = np.searchsorted(starts, places)  # each text's first word, and the end
        n = max(0, len(h) - WORDS + 1)
        five = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
        for k in range(WORDS):
            five = (five ^ h[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
            five ^= five >> np.uint64(32)
        out = []
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= WORDS:
                s = np.sort(five[i : j - WORDS + 1])
            elif j > i:  # one shingle of all words
                s = np.full(1, 0x9E3779B97F4A7C15 + j - i, np.uint64)
                for k in range(i, j):
                    s = (s ^ h[k]) * np.uint64(0xFF51AFD7ED558CCD)
                    s ^= s >> np.uint64(32)
            else:
                s = np.zeros(0, np.uint64)
            new = np.flatnonzero(np.diff(s)) + 1
            at = np.concatenate([[0], new]) if len(s) else new
            out.append((s[at], np.diff(np.append(at, len(s)))))
        return out


def slices(texts: pa.Array) -> Iterator[list[bytes]]:
    """plain() texts of an Arrow column, about BLOCK_BYTES at a time: a worker never holds a whole batch as Python objects."""
    held, size = [], 0
    for x in texts:
        held.append(Shingler.plain(x.as_py()))
        size += len(held[-1])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def record(**columns) -> pa.RecordBatch:
    """A batch of columns; binary and text columns are lists, others arrays."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def fingerprint(text: bytes) -> str:
    """Of the words of a plain() text."""
    return hashlib.md5(b" ".join(text.split())).hexdigest()


def idf_of(df: np.ndarray, total: int) -> np.ndarray:
    return np.clip(np.log(total / df) / np.log(1 / COMMON), IDF_FLOOR, 1.0)


class Weights:
    """Weights of shingles: count times idf; common holds the shingles whose idf is below 1."""

    def __init__(self, common: tuple[np.ndarray, np.ndarray]):
        self.keys, self.idf = common  # sorted by key

    def of(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = counts.astype(np.float64)
        if len(self.keys):
            at = np.searchsorted(self.keys, shingles)
            at[at == len(self.keys)] = 0
            w *= np.where(self.keys[at] == shingles, self.idf[at], 1.0)
        return w


class Sampler:
    """ICWS: for hash k and element e with weight S, t = floor(ln S / r + b) and ln a = ln c - r * (t - b + 1), with r and c
    drawn from Gamma(2, 1) and b uniformly by (e, k); the draw is the element (and t) of least a."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        n = ROWS * BANDS
        self.r, self.b = rng.gamma(2, 1, (n, TRIPLES)), rng.random((n, TRIPLES))
        self.lnc = np.log(rng.gamma(2, 1, (n, TRIPLES)))
        self.salt = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        self.unit = self.ordered(self.lnc - self.r * (np.floor(self.b) - self.b + 1))  # S = 1

    @staticmethod
    def ordered(a: np.ndarray) -> np.ndarray:
        """ln a as the upper half of a number of the same order."""
        return np.maximum(a + 64, 0).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)

    def draw(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of draws a document; documents begin at starts."""
        odd = np.flatnonzero(weights != 1.0)
        lns = np.log(weights[odd])
        out = np.empty((len(starts), len(self.salt)), np.uint32)
        for k, salt in enumerate(self.salt):
            h = (shingles ^ salt) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            at = (h & np.uint64(TRIPLES - 1)).astype(np.int64)
            key = self.unit[k][at] | (h >> np.uint64(32))
            if len(odd):
                i = at[odd]
                r, b = self.r[k][i], self.b[k][i]
                t = np.floor(lns / r + b)
                mixed = ((h[odd] >> np.uint64(32)) ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x85EBCA6B))) & np.uint64(0xFFFFFFFF)
                key[odd] = self.ordered(self.lnc[k][i] - r * (t - b + 1)) | mixed
            out[:, k] = (np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out

    def bands(self, draws: np.ndarray) -> np.ndarray:
        h = np.full((len(draws), BANDS), 0x243F6A8885A308D3, np.uint64)
        for r in range(ROWS):
            h = (h ^ draws[:, r::ROWS]) * np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(31)
        return h.view(np.int64)


# ---------------------------------------------------------------------------------------------------- shingle statistics


def common_shingles(docs: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """Number of documents, and (sorted shingles, idf) of all shingles in at least COMMON of them.  docs: t.

    There are at most 1 / COMMON times as many of those as a document has shingles on average, whatever the number of documents.
    """
    schema = "s long, n long, docs long"

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, n, size = Shingler(), [], 0, 0

        def chunk() -> pa.RecordBatch:
            s, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            many = c >= COMMON * n
            s, c = np.append(s[many].view(np.int64), 0), np.append(c[many], -1)
            return record(s=s, n=c, docs=np.full(len(s), n))

        for batch in batches:
            for texts in slices(batch.column("t")):
                for s, _ in shingler.sets(texts):
                    held.append(s)
                    n, size = n + 1, size + len(held[-1])
                    if n >= CHUNK or size >= CHUNK_SHINGLES:
                        yield chunk()
                        held, n, size = [], 0, 0
        yield chunk()

    named = materialize(docs.mapInArrow(name, schema), "common")
    total = named.filter("n = -1").agg(F.sum("docs")).first()[0] or 0
    least = max(COMMON * total, LEAST_COMMON)

    def result(counted: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
        exact = counted.groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()
        s = exact["s"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(s)
        return total, (s[order], idf_of(exact["n"].to_numpy(np.float64)[order], total))

    some = named.filter("n > 0").select("s").distinct()
    if some.count() > MOST_COMMON:  # small chunks name nearly all their shingles: counted by the cluster, no list is sent

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler()
            for batch in batches:
                for texts in slices(batch.column("t")):
                    s, n = np.unique(np.concatenate([s for s, _ in shingler.sets(texts)]), return_counts=True)
                    yield record(s=s.view(np.int64), n=n)

        return result(docs.mapInArrow(each, "s long, n long"))
    keys = np.sort(some.toPandas()["s"].to_numpy(np.int64).view(np.uint64))
    if not len(keys):
        return total, (keys, np.zeros(0))
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, keys = Shingler(), sent.value
        n = np.zeros(len(keys), np.int64)
        for batch in batches:
            for texts in slices(batch.column("t")):
                for s, _ in shingler.sets(texts):
                    at = np.searchsorted(keys, s)
                    at[at == len(keys)] = 0
                    n[at[keys[at] == s]] += 1
        yield record(s=keys[n > 0].view(np.int64), n=n[n > 0])

    return result(docs.mapInArrow(count, "s long, n long"))


def signatures(docs: DataFrame, common) -> DataFrame:
    """docs (id, t): id, fp (of the words), bands (array<long>) and draws (array<int>), empty for texts without words, and weight
    (of all shingles)."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler, weights = Shingler(), Sampler(), Weights(sent.value)
        n = ROWS * BANDS

        def block(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
            parts = shingler.sets(texts)
            sizes = np.asarray([len(s) for s, _ in parts])
            full = np.flatnonzero(sizes)
            bands, draws, total = np.zeros((0, BANDS), np.int64), np.zeros((0, n), np.int32), np.zeros(len(texts))
            if len(full):
                s, c = (np.concatenate([parts[i][k] for i in full]) for k in (0, 1))
                starts = np.cumsum(np.append(0, sizes[full][:-1]))
                w = weights.of(s, c)
                total[full] = np.add.reduceat(w, starts)
                drawn = sampler.draw(s, w, starts)
                bands, draws = sampler.bands(drawn), drawn.view(np.int32)
            ends = np.cumsum(np.append(0, sizes > 0)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends * m, x.reshape(-1)) for m, x in ((BANDS, bands), (n, draws))]
            return record(id=ids, fp=list(map(fingerprint, texts)), bands=lists[0], draws=lists[1], weight=total)

        for batch in batches:
            at = 0
            for texts in slices(batch.column("t")):
                yield block(batch.column("id").slice(at, len(texts)), texts)
                at += len(texts)

    return docs.mapInArrow(run, "id string, fp string, bands array<long>, draws array<int>, weight double")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs (t): fp and the text's shingles (sorted, distinct; uint64) and their counts (uint32), as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for texts in slices(batch.column("t")):
                keys, counts = [], []
                for s, c in shingler.sets(texts):
                    odd = np.flatnonzero(c > 1)  # counts above one only: place and count
                    keys.append(s.astype("<u8").tobytes())
                    counts.append(np.stack([odd, c[odd]]).astype("<u4").tobytes())
                yield record(fp=list(map(fingerprint, texts)), s=pa.array(keys, pa.binary()), c=pa.array(counts, pa.binary()))

    return docs.mapInArrow(run, "fp string, s binary, c binary")


def unpack(s: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(s, "<u8")
    counts = np.ones(len(keys), np.int64)
    odd = np.frombuffer(c, "<u4").reshape(2, -1)
    counts[odd[0]] = odd[1]
    return keys, counts


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted keys, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high > 0 else 1.0


def verified(pairs: DataFrame, sets: DataFrame, common) -> DataFrame:
    """The pairs (a, b) of fingerprints whose weighted Jaccard similarity reaches SIMILARITY.  A centre with many partners is a
    skewed join key, which adaptive execution splits."""
    sent = pairs.sparkSession.sparkContext.broadcast(common)
    left = sets.select(F.col("fp").alias("a"), F.col("s").alias("sa"), F.col("c").alias("ca"))
    right = sets.select(F.col("fp").alias("b"), F.col("s").alias("sb"), F.col("c").alias("cb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ca", "sb", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(sent.value)
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for b, *packed in zip(*(batch.column(k) for k in ("b", "sa", "ca", "sb", "cb")), strict=True):
                sa, ca, sb, cb = (x.as_py() for x in packed)
                x = unpack(sa, ca)
                if last[0] != b:  # one centre's rows stand together
                    y = unpack(sb, cb)
                    last = (b, (y[0], weights.of(*y)))
                keep.append(weighted_jaccard((x[0], weights.of(*x)), last[1]) >= SIMILARITY)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a string, b string")


# ---------------------------------------------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's least node) for every node of edges (a, b): alternating large-star and small-star."""
    pairs = materialize(edges.filter("a <> b").distinct(), "edges")
    while True:
        # large star: every greater neighbour is linked with the least node around
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: every lesser neighbour, and the node itself, are linked with the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = materialize(small, "edges")
        # done when the links are stars: no node is both a leaf and a centre, and no leaf has two centres
        leaves = after.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        loose = leaves.filter("n > 1").limit(1).count() or after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        pairs = after
        if not loose:
            break
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.union(stars.select(F.col("comp").alias("node"), "comp").distinct())


def buckets(classes: DataFrame) -> DataFrame:
    """key and fp of every text in a band bucket with others.  The band is part of the key."""
    rows = classes.select("fp", F.posexplode("bands").alias("band", "h")).select("fp", F.struct("band", "h").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return rows.join(shared, "key", "left_semi")


def alike() -> Column:
    """Whether a pair with draws da, db and weights wa, wb can reach SIMILARITY: no similarity is above the ratio of the weights."""
    same = F.size(F.filter(F.zip_with("da", "db", lambda p, q: p == q), lambda e: e))
    return (F.least("wa", "wb") >= (SIMILARITY - 1e-9) * F.greatest("wa", "wb")) & (same >= LEAST_DRAWS)


def weighted_jaccards(a: tuple[np.ndarray, np.ndarray], ids: np.ndarray, weights: np.ndarray, starts: np.ndarray, totals: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Of a (ids, weights) with each of many: their ids and weights in a row, where each starts, and its weight.  dense: zeros."""
    dense[a[0]] = a[1]
    low = np.add.reduceat(np.minimum(dense[ids], weights), starts)
    dense[a[0]] = 0
    return low / (a[1].sum() + totals - low)


def open_links(several: DataFrame, classes: DataFrame, sets: DataFrame, common) -> DataFrame:
    """Links (a, b) among all pairs of texts that share a bucket, are in different components and pass alike(): enough of them
    to join whatever such pairs join.  several: key, fp, comp.

    A bucket is dealt into pieces of about PIECE texts, and a task gets two pieces with their shingles: no bucket is one task,
    and pairs aren't rows.  Texts without such a partner are left out first.
    """
    sent = several.sparkSession.sparkContext.broadcast(common)
    pieces = several.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    rows = several.join(pieces, "key").join(classes.select("fp", "bands", "draws", "weight"), "fp")
    rows = materialize(rows.withColumn("at", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")), "several")
    each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    x = rows.select("key", each.alias("j"), "fp", "at", "pieces", F.col("comp").alias("ca"), F.col("bands").alias("ba"), F.col("draws").alias("da"), F.col("weight").alias("wa")).alias("x")
    y = rows.select("key", F.col("at").alias("j"), F.col("comp").alias("cb"), F.col("bands").alias("bb"), F.col("draws").alias("db"), F.col("weight").alias("wb")).alias("y")
    band = F.col("x.key.band")
    earlier = F.exists(F.zip_with(F.slice("ba", F.lit(1), band), F.slice("bb", F.lit(1), band), lambda p, q: p == q), lambda e: e)
    met = x.join(y, [F.col("x.key") == F.col("y.key"), F.col("x.j") == F.col("y.j"), (F.col("ca") != F.col("cb")) & alike() & ~earlier], "left_semi")
    wanted = met.select("key", "fp", "at", "pieces", F.col("ca").alias("comp"), F.col("ba").alias("bands"), F.col("da").alias("draws")).dropDuplicates(["key", "fp"])
    cells = wanted.withColumn("other", each).withColumns({"i": F.least("at", "other"), "j": F.greatest("at", "other")}).drop("other", "pieces")

    def judge(key: tuple, part: pa.Table) -> pa.Table:
        weights, band = Weights(sent.value), key[0].as_py()["band"]
        part = part.sort_by("fp").combine_chunks()
        raw = [unpack(p.as_py(), q.as_py()) for p, q in zip(part["s"], part["c"], strict=True)]
        size = [len(k) for k, _ in raw]
        flat = np.concatenate([k for k, _ in raw])
        w = weights.of(flat, np.concatenate([n for _, n in raw]))
        kinds, ids = np.unique(flat, return_inverse=True)
        dense, starts = np.zeros(len(kinds)), np.cumsum([0, *size])
        totals = np.add.reduceat(w, starts[:-1])
        draws, bands = (part[k].combine_chunks().flatten().to_numpy().reshape(len(part), -1) for k in ("draws", "bands"))
        comp = np.unique(part["comp"].to_pylist(), return_inverse=True)[1]
        fp, at, found = part["fp"].to_pylist(), part["at"].to_numpy(), []
        for r in range(len(part) - 1):
            ok = comp[r + 1 :] != comp[r]
            if key[1] != key[2]:
                ok &= at[r + 1 :] != at[r]
            ok &= np.minimum(totals[r + 1 :], totals[r]) >= (SIMILARITY - 1e-9) * np.maximum(totals[r + 1 :], totals[r])
            to = np.flatnonzero(ok) + r + 1
            to = to[((draws[to] == draws[r]).sum(1) >= LEAST_DRAWS) & ~(bands[to, :band] == bands[r, :band]).any(1)]
            if not len(to):
                continue
            at_all = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in to])
            own = slice(starts[r], starts[r + 1])
            near = weighted_jaccards((ids[own], w[own]), ids[at_all], w[at_all], np.cumsum([0, *(size[k] for k in to[:-1])]), totals[to], dense)
            for k in to[near >= SIMILARITY]:
                if comp[k] != comp[r]:
                    found.append((fp[r], fp[k]))
                    comp[comp == comp[k]] = comp[r]
        return pa.table({k: pa.array([x[n] for x in found], pa.string()) for n, k in enumerate("ab")})

    return cells.join(sets, "fp").groupBy("key", "i", "j").applyInArrow(judge, "a string, b string")


def link(members: DataFrame, classes: DataFrame, sets: DataFrame, common) -> DataFrame:
    """node, comp of all texts that have links.  members: key, fp of buckets.

    Each text is compared with its buckets' centres first: the least one; where a bucket is then still in several components,
    with CENTRES more, least by other orders, and twice with the text of most links so far, which is the original where many
    copies of one are alike only through it.  What is then still in different components of a bucket is compared in full.
    Pairs that can't reach the threshold (see alike()) aren't verified.
    """
    spark = members.sparkSession

    def probable(pairs: DataFrame) -> DataFrame:
        x = classes.select(F.col("fp").alias("a"), F.col("draws").alias("da"), F.col("weight").alias("wa"))
        y = classes.select(F.col("fp").alias("b"), F.col("draws").alias("db"), F.col("weight").alias("wb"))
        return pairs.join(x, "a").join(y, "b").filter(alike()).select("a", "b")

    def test(pairs: DataFrame) -> DataFrame:
        out = materialize(verified(pairs, sets, common), "links")
        clean_shuffles(spark)
        return out

    def undecided(comps: DataFrame) -> DataFrame:
        placed = members.join(comps, members["fp"] == comps["node"], "left").select("key", "fp", F.coalesce("comp", "fp").alias("comp"))
        several = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
        return materialize(placed.join(several, "key"), "several")

    centres = members.groupBy("key").agg(F.min("fp").alias("b"))
    ordered = [F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")]
    tested = materialize(probable(members.join(centres, "key").filter("fp <> b").select(*ordered).distinct()), "pairs")
    edges = test(tested)
    comps = materialize(components(edges), "components")
    for more in (CENTRES, 0):
        several = undecided(comps)
        degrees = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
        by = [F.xxhash64("fp", F.lit(i)) for i in range(more)] + [F.struct(-F.coalesce("links", F.lit(0)), "fp")]
        chosen = several.join(degrees, "fp", "left").groupBy("key").agg(*[F.min_by(F.struct("fp", "comp"), x).alias(f"c{i}") for i, x in enumerate(by)])
        chosen = chosen.select("key", F.explode(F.array(*[f"c{i}" for i in range(len(by))])).alias("c")).select("key", F.col("c.fp").alias("b"), F.col("c.comp").alias("other")).distinct()
        pairs = several.join(chosen, "key").filter("comp <> other").select(*ordered).distinct()
        pairs = materialize(probable(pairs).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested, new = tested.union(pairs), test(pairs)
        if not new.isEmpty():
            edges = edges.union(new)
            comps = materialize(components(edges), "components")
    new = materialize(open_links(undecided(comps), classes, sets, common), "links")
    clean_shuffles(spark)
    return comps if new.isEmpty() else materialize(components(edges.union(new)), "components")


def classed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row a document: id (string), fp, comp (the fp that names its class), class_id and n_copies.  Written: all that led to
    it is deleted."""
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    number = F.col("id").cast(id_type)
    with scratch(docs.sparkSession, file_count(docs)):
        _, common = common_shingles(rows.select("t"))
        signed = materialize(signatures(rows, common), "signatures")
        classes = materialize(signed.groupBy("fp").agg(F.min(number).alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("draws").alias("draws"), F.first("weight").alias("weight")), "classes")
        members = materialize(buckets(classes), "buckets")
        wanted = members.select("fp").distinct().join(classes, "fp").select("fp", F.col("rep").cast("string").alias("id"))
        texts = rows.join(wanted.filter("id IS NOT NULL").select("id"), "id", "left_semi").unionByName(rows.filter("id IS NULL"))  # a text may have null ids only
        sets = shingle_sets(texts.select("t")).join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])
        comps = link(members, classes, materialize(sets, "shingles"), common)
        named = classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "rep", "n", F.coalesce("comp", "fp").alias("comp"))
        heads = named.groupBy("comp").agg(F.min("rep").alias("class_id"), F.sum("n").alias("n_copies"))
        place = named.join(heads, "comp").select("fp", "comp", "class_id", "n_copies")
        return materialize(signed.select("id", "fp").join(place, "fp"), "classed", keep=True)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, class_id (the least id of its class) and n_copies, the number of its class's documents.

    Documents whose classes have the same least id (repeated ids of different texts) share a class_id; one_of_each() tells
    them apart."""
    return classed(docs, text, doc_id).select(F.col("id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "class_id", "n_copies")


@F.arrow_udf(StringType())
def printed(texts: pa.Array) -> pa.Array:
    """fingerprint() of each text."""
    return pa.array([fingerprint(Shingler.plain(x.as_py())) for x in texts], pa.string())


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each class: that of the least id, or any where no document of the class has one.  Documents
    are told apart by id and words, so that classes whose least ids are equal keep a document each."""
    number = F.col("id").cast(docs.schema[doc_id].dataType)
    with scratch(docs.sparkSession, file_count(docs)):
        alike = classed(docs, text, doc_id).groupBy("comp", "fp", "id").agg(F.count(F.lit(1)).alias("n"))
        heads = alike.groupBy("comp").agg(F.min_by(F.struct("id", "fp", "n"), F.struct(F.col("id").isNull(), number, "fp")).alias("k"))
        heads = materialize(heads.select(F.col("k.id").alias("__id"), F.col("k.fp").alias("__head"), F.col("k.n").alias("__n")), "kept", keep=True)
    own = docs.withColumn("__fp", printed(F.coalesce(F.col(text), F.lit(""))))
    out = own.join(heads, (F.col(doc_id).cast("string") == F.col("__id")) & (F.col("__fp") == F.col("__head")))
    once, repeated = out.filter("__n = 1"), out.filter("__n > 1").dropDuplicates(["__id", "__head"])
    nameless = own.filter(F.col(doc_id).isNull()).dropDuplicates(["__fp"]).join(heads.filter("__id IS NULL").select("__head"), F.col("__fp") == F.col("__head"), "left_semi")
    return once.select(*docs.columns).unionByName(repeated.select(*docs.columns)).unionByName(nameless.select(*docs.columns))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
