"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words and one end, coded in order.  A word that training texts have is coded by mixing contexts over
words: the last two, the last one, none (lm_words.py).  Any other word is spelled out: its bytes and a closing byte are coded
bit by bit.  Hashed contexts (the last one, two and four bytes of the word, and all of it so far) each predict the next bit from
the distinct training words; a mixer adds their logits with weights gated by each predictor's confidence, and an adaptive
probability map refines the result by what it was worth.  The costs add up to the text's probability and to bits per byte.

Counts of words, pairs and triples of words are exact and complete, however many there are: they stay dealt over buckets.

1. Texts become chunks of about CHUNK words.  A chunk sends its distinct words to buckets by word, which count them in all
   training texts, number them, and send back numbers and counts.
2. Spelling: bit counts of all contexts, summed by slot over all distinct training words; mixer and map learn online over them.
   Only words that no training text has are spelled, each once.
3. A chunk sends its distinct triples of words to buckets by the middle one, where all that follow a word meet, and are written
   together.  In a first pass over them mixer and map learn online, leaving one occurrence of the triple at hand out of the
   counts; the buckets' weights are averaged, the maps' sums are added.  In a second pass the triples get their log10 probability
   and go back to their chunk.
4. A chunk adds up its texts' words.

Numbers of buckets follow the input's size and a word's number its spelling, so that neither reruns nor the dealing of texts over
tasks changes what is learned from words, but for the order in which floating-point numbers are added up.

Defined results: null and empty texts have the end only; null ids fold as the empty text; repeated rows are documents of
their own; words of over SEGMENT bytes are spelled in stretches; with no training text, counts are 0 and V is 0.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_words
from .common import clean_shuffles, fold_of, materialize, scratch, table

#: Bytes of history of each context; the last takes all of the word.
ORDERS = (1, 2, 4, 99)
#: log2 of each context's slots, and where each context's slots start in the one table of all.
SLOT_BITS = (16, 20, 21, 22)
STARTS = tuple(sum(1 << b for b in SLOT_BITS[:k]) for k in range(5))
SEGMENT = 48
CLOSE, END = 0x20, 0x0A
CONFIDENCE = 16
CELLS = 33
STEP, RATE = 16384, 0.1
#: Gates: sets of weights by the confidence of the context of all bytes so far.
GATES, GATE_STEP = 5, 3
#: Words spelled at once, and words of a chunk (more where one text has more).
BLOCK, CHUNK = 50_000, 1 << 19
#: Texts split at once.
SLICE = 256
#: log2 of the bytes of input for one bucket of words and of triples.
WORD_BYTES, TRIPLE_BYTES = 22, 24
#: log2 of the training words for one bucket of triples, where these ask for more buckets.
TRIPLE_WORDS = 19
#: Parts in which triples are made and in which they meet, so that only one part's shuffle is on disk beside the tables.
MAKE_ROUNDS, MEET_ROUNDS = 2, 2
#: Numbers of what stands before a text, and of words that no training text has; the others follow.
START, UNKNOWN, FIRST = 0, 1, 2
MAP_SHARE = np.float32(0.5)
#: Evidence that each side of a bit has from the start.
LEAST = np.float32(0.05)
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[bytes]:
    """Words of a text: ASCII letters lowered, parted by space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Coded:
    """Words as rows of bytes, longest first; b"" stands for the end of a text."""

    def __init__(self, words: list[bytes]):
        flat = np.frombuffer(b"".join([w + b"%c" % (CLOSE if w else END) for w in words]), np.uint8)
        long = np.fromiter(map(len, words), np.int64, len(words)) + 1
        parts = -(-long // SEGMENT)
        owner = np.repeat(np.arange(len(words)), parts)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(long[owner] - part * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        self.size, self.owner, self.n = size[order], owner[order], len(words)
        self.later = (part[order] > 0).astype(np.uint64)
        rows = np.zeros((len(size), int(size.max(initial=0))), np.uint8)
        rows[np.arange(rows.shape[1]) < size[:, None]] = flat
        self.bytes = rows[order]

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each bit: rows in it, partial byte, bit, slot by order."""
        n = len(self.size)
        past = [self.later + np.uint64(1)] + [np.zeros(n, np.uint64) for _ in range(3)]
        whole = self.later + np.uint64(1)
        for j in range(self.bytes.shape[1]):
            m = int(np.searchsorted(-self.size, -j, side="left"))
            now = self.bytes[:m, j].astype(np.uint64)
            short = [past[0][:m], past[0][:m] | past[1][:m] << np.uint64(9), past[0][:m] | past[1][:m] << np.uint64(9) | past[2][:m] << np.uint64(18) | past[3][:m] << np.uint64(27), whole[:m]]
            heads = [(h + np.uint64(k + 1)) * MIX for k, h in enumerate(short)]
            heads = [h ^ h >> np.uint64(29) for h in heads]
            part = np.ones(m, np.uint64)
            for bit in range(7, -1, -1):
                y = now >> np.uint64(bit) & np.uint64(1)
                slots, tail = [], part * np.uint64(0xD6E8FEB86659FD93)
                for k, h in enumerate(heads):
                    s = (h + tail) * MIX
                    slots.append((s >> np.uint64(64 - SLOT_BITS[k])).astype(np.int64) + STARTS[k])
                yield m, part, y.astype(np.int64), slots
                part = part << np.uint64(1) | y
            for k in (3, 2, 1):
                past[k][:m] = past[k - 1][:m]
            past[0][:m] = now + np.uint64(2)
            whole[:m] = (whole[:m] ^ now + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
            whole[:m] ^= whole[:m] >> np.uint64(32)


def add_counts(words: list[bytes], times: np.ndarray, counts: np.ndarray) -> None:
    """Add the bits of words to counts (slot * 2 + bit)."""
    coded = Coded(words)
    weight = times[coded.owner].astype(np.float32)
    for m, _, y, slots in coded.steps():
        for s in slots:
            np.add.at(counts, s * 2 + y, weight[:m])


class Mixer:
    """Weights by predictor, gate and confidence, and the map: sums of bits and of weights by partial byte and cell."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray | None = None, cells: np.ndarray | None = None):
        self.counts = counts
        self.weights = np.full((len(ORDERS), GATES * CONFIDENCE), 1 / len(ORDERS)) if weights is None else weights
        self.slopes = np.zeros_like(self.weights)
        self.ones = np.zeros((256, CELLS))
        self.all = np.zeros((256, CELLS))
        self.cells = cells

    def inputs(self, slots: list[np.ndarray], y: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Logit and confidence of each predictor; with y, one occurrence of it is left out."""
        logits, levels = [], []
        table = self.counts.view(np.uint64)  # both counts of a slot at once
        own = [] if y is None else [(1 - y).astype(np.float32), y.astype(np.float32)]
        for s in slots:
            pair = table.take(s).view(np.float32)
            n0, n1 = pair[::2], pair[1::2]
            if own:
                n0, n1 = np.maximum(n0 - own[0], 0), np.maximum(n1 - own[1], 0)
            logits.append(np.log((n1 + LEAST) / (n0 + LEAST)))
            # the exponent of the evidence, out of the number's own bits
            levels.append(np.minimum(np.maximum((n0 + n1).view(np.int32) >> 23, 126), 125 + CONFIDENCE) - 126)
        gate = np.minimum(levels[-1] // GATE_STEP, GATES - 1) * CONFIDENCE
        return logits, [x + gate for x in levels]

    def mixed(self, logits: list[np.ndarray], levels: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(logits[0]), np.float32)
        weights = self.weights.astype(np.float32)
        for k, (x, c) in enumerate(zip(logits, levels, strict=True)):
            out += weights[k].take(c) * x
        return np.clip(out, -16, 16)

    def learn(self, words: list[bytes], times: np.ndarray) -> None:
        """One online pass, in steps of STEP words."""
        for a in range(0, len(words), STEP):
            coded = Coded(words[a : a + STEP])
            weight = times[a : a + STEP].astype(float)[coded.owner]
            for m, part, y, slots in coded.steps():
                logits, levels = self.inputs(slots, y)
                z = self.mixed(logits, levels)
                w = weight[:m]
                miss = (w / w.sum()) * (y - 1 / (1 + np.exp(-z)))
                for k, (x, c) in enumerate(zip(logits, levels, strict=True)):
                    slope = np.bincount(c, miss * x, GATES * CONFIDENCE)
                    self.slopes[k] += slope * slope
                    self.weights[k] += RATE * slope / np.sqrt(self.slopes[k] + 1e-12)
                at = part.astype(np.int64) * CELLS + np.rint((z + 16) * ((CELLS - 1) / 32)).astype(np.int64)
                self.all += np.bincount(at, w, 256 * CELLS).reshape(256, CELLS)
                self.ones += np.bincount(at, w * y, 256 * CELLS).reshape(256, CELLS)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word."""
        coded = Coded(words)
        cells = self.cells.astype(np.float32).reshape(-1)
        cost = np.zeros(len(coded.size))
        for m, part, y, slots in coded.steps():
            z = self.mixed(*self.inputs(slots, None))
            place = (z + np.float32(16)) * np.float32((CELLS - 1) / 32)
            low = np.minimum(place.astype(np.int32), CELLS - 2)
            at = part.astype(np.int32) * CELLS + low
            lower = cells[at]
            z = (1 - MAP_SHARE) * z + MAP_SHARE * (lower + (cells[at + 1] - lower) * (place - low))
            cost[:m] -= np.log1p(np.exp(np.where(y == 1, -z, z)))
        return np.bincount(coded.owner, cost, coded.n) / np.log(10)


def refined_cells(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Logits of the map's cells; a cell holds its own middle as two pieces of evidence."""
    middle = np.linspace(-16, 16, CELLS)[None, :]
    p = (ones + 2 / (1 + np.exp(-middle))) / (total + 2)
    p = np.clip(p, 1e-7, 1 - 1e-7)
    return np.log(p / (1 - p))


# ---------------------------------------------------------------------------------------------------- spelling, on tables


def pack(columns: dict) -> bytes:
    """Arrays of whole numbers from 0 as planes of bytes; the rest as it is; all compressed."""

    def planes(a: np.ndarray) -> tuple[str, bytes]:
        a = np.ascontiguousarray(a, np.min_scalar_type(int(a.max()) if len(a) else 0))
        return a.dtype.str, b"".join([a.view(np.uint8)[k :: a.itemsize].tobytes() for k in range(a.itemsize)])

    flat = pickle.dumps({k: planes(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})
    return len(flat).to_bytes(8, "little") + pa.compress(flat, "zstd", asbytes=True)


def unpack(x: bytes) -> dict:
    def array(kind: str, flat: bytes) -> np.ndarray:
        size = np.dtype(kind).itemsize
        whole = np.empty(len(flat), np.uint8)
        for k, plane in enumerate(np.frombuffer(flat, np.uint8).reshape(size, -1)):
            whole[k::size] = plane
        return whole.view(kind).astype(np.int64)

    return {k: array(*v) if isinstance(v, tuple) else v for k, v in pickle.loads(pa.decompress(bytes(x[8:]), int.from_bytes(x[:8], "little"), "zstd")).items()}


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
    """Words out of packed rows (x), BLOCK at a time whatever the size of rows."""
    words = []
    for batch in batches:
        for x in batch["x"]:
            words += parted(unpack(x))
            while len(words) >= BLOCK:
                yield words[:BLOCK]
                del words[:BLOCK]
    if words:
        yield words


#: Slots times two of a packed stretch of the table of bit counts.
STRETCH = 1 << 16


def slots_of(stretches: dict[int, bytes]) -> np.ndarray:
    """The table of bit counts (slot * 2 + bit) out of its packed stretches."""
    counts = np.zeros(2 * STARTS[-1], np.float32)
    for p, x in stretches.items():
        counts[p * STRETCH : (p + 1) * STRETCH] = unpack(x)["n"]
    return counts


def bit_counts(words: DataFrame) -> dict[int, bytes]:
    """Counts of all contexts over words (packed in x): a table of fixed size, added up and fetched in packed stretches."""
    size, stretch = 2 * STARTS[-1], STRETCH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size, np.float32)
        for ws in blocks(batches):
            add_counts(ws, np.ones(len(ws)), counts)
        for a in range(0, size, stretch):
            if (part := counts[a : a + stretch]).any():
                yield pd.DataFrame({"p": [a // stretch], "x": [pack({"n": part.astype(np.int64)})]})

    def added(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p": [key[0]], "x": [pack({"n": sum(unpack(x)["n"] for x in part["x"])})]})

    return {r["p"]: bytes(r["x"]) for r in words.mapInPandas(run, "p int, x binary").groupBy("p").applyInPandas(added, "p int, x binary").collect()}


def fit(words: DataFrame) -> tuple:
    """Broadcast bit counts, weights and cells of the spelling, learned from all of words (packed in x)."""
    spark = words.sparkSession
    counts = bit_counts(words)
    sent = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, seen = Mixer(slots_of(sent.value)), 0.0
        for ws in blocks(batches):
            mixer.learn(ws, np.ones(len(ws)))
            seen += len(ws)
        w = mixer.weights.reshape(-1)
        keys = np.arange(len(w) + mixer.all.size)
        yield pd.DataFrame({"k": keys, "x": np.concatenate([w * seen, mixer.ones.reshape(-1)]), "n": np.concatenate([np.full(len(w), seen), mixer.all.reshape(-1)])})

    got = words.mapInPandas(run, "k long, x double, n double").groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("k").toPandas()
    weights = np.full((len(ORDERS), GATES * CONFIDENCE), 1 / len(ORDERS))
    ones, total = np.zeros((256, CELLS)), np.zeros((256, CELLS))
    if len(got):
        x, n = got["x"].to_numpy(), got["n"].to_numpy()
        m = weights.size
        if n[0] > 0:
            weights = (x[:m] / n[:m]).reshape(weights.shape)
        ones, total = x[m:].reshape(ones.shape), n[m:].reshape(total.shape)
    return sent, weights, refined_cells(ones, total)


# ---------------------------------------------------------------------------------------------------- texts, on tables


def joined(words: pa.Array) -> dict:
    """Words (large_binary) as their sizes and bytes."""
    at, flat = bounds(words)
    return {"size": np.diff(at), "flat": flat[at[0] : at[-1]].tobytes()}


def bounds(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where words (large_binary) begin and end, and the bytes in which they do."""
    _, at, flat = words.buffers()
    at = np.zeros(1, np.int64) if not len(words) else np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
    return at, np.frombuffer(flat or b"", np.uint8)


def arrayed(x: dict) -> pa.Array:
    """The words (large_binary) again that joined() was given."""
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(x["size"])])
    return pa.Array.from_buffers(pa.large_binary(), len(x["size"]), [None, pa.py_buffer(at), pa.py_buffer(x["flat"])])


def parted(x: dict) -> list[bytes]:
    ends = np.cumsum(x["size"]).tolist()
    flat = x["flat"]
    return [flat[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crcs(words: pa.Array) -> np.ndarray:
    """zlib.crc32 of words (large_binary): a byte of all of them at a time, but for the few that are over SEGMENT bytes."""
    at, flat = bounds(words)
    size = np.diff(at)
    order = np.argsort(-size)
    starts, sizes = at[:-1][order], size[order]
    found = np.full(len(words), 0xFFFFFFFF, np.uint32)
    few = int(np.searchsorted(-sizes, -SEGMENT))
    for j in range(int(sizes[few:].max(initial=0))):
        end = few + int(np.searchsorted(-sizes[few:], -j))
        crc = found[few:end]
        crc[:] = CRC.take(crc & np.uint32(255) ^ flat.take(starts[few:end] + j)) ^ crc >> np.uint32(8)
    found ^= np.uint32(0xFFFFFFFF)
    for k in range(few):
        found[k] = zlib.crc32(flat[starts[k] : starts[k] + sizes[k]])
    out = np.empty_like(found)
    out[order] = found
    return out


SCHEMA = "kind string, chunk long, bucket int, x binary"


def rows_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "x"])


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """tokens() of texts, one text's after the other's, and how many each has, its end included."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(found), 0)
    return found.filter(some), np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(texts)) + 1


def dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by bucket, in their order within one, and where each bucket begins and ends."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def chunked(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (id, held_out, t): of each chunk its texts ('texts') and, by bucket, its distinct words ('words')."""

    def chunk(number: int, rows: pa.Table, words: list[pa.Array], length: np.ndarray) -> pa.RecordBatch:
        coded = pa.concat_arrays(words).dictionary_encode()
        known = pa.concat_arrays([coded.dictionary.cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
        places = np.full(length.sum(), len(known) - 1)
        held = np.array(rows["held_out"].to_pylist(), bool)
        inner = np.ones(len(places), bool)
        inner[np.cumsum(length) - 1] = False
        places[inner] = coded.indices.to_numpy()
        count = np.bincount(places[np.repeat(~held, length)], minlength=len(known))
        bucket = crcs(known).astype(np.int64) % buckets
        order, ends = dealt(bucket, buckets)
        known, count = known.take(pa.array(order)), count[order]
        size = pc.binary_length(rows["t"]).to_numpy()
        out = [("texts", number, -1, pack({"ids": rows["id"].to_pylist(), "held": held.astype(np.int64), "size": size, "length": length, "tok": places, "bucket": bucket}))]
        for b in np.flatnonzero(np.diff(ends)).tolist():
            out.append(("words", number, b, pack({**joined(known.slice(ends[b], ends[b + 1] - ends[b])), "count": count[ends[b] : ends[b + 1]]})))
        return pa.RecordBatch.from_pandas(rows_of(out), pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("x", pa.binary())]), preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows, words, lengths, waiting = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return chunk(number, pa.Table.from_batches(rows), words, np.concatenate(lengths))

        for batch in batches:
            for a in range(0, len(batch), SLICE):
                part = batch.slice(a, SLICE)
                found, length = split(part["t"])
                starts = np.concatenate([[0], np.cumsum(length - 1)])
                a = 0
                while a < len(part):
                    # up to the text with which the chunk is full
                    b = min(len(part), a + 1 + int(np.searchsorted(np.cumsum(length[a:]), CHUNK - waiting)))
                    rows.append(part.slice(a, b - a))
                    words.append(found.slice(starts[a], starts[b] - starts[a]))
                    lengths.append(length[a:b])
                    waiting, a = waiting + int(length[a:b].sum()), b
                    if waiting >= CHUNK:
                        yield flush()
                        number, waiting = number + 1, 0
                        for x in (rows, words, lengths):
                            x.clear()
        if waiting:
            yield flush()

    return docs.mapInArrow(run, SCHEMA)


def numbered(chunks: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk and bucket the words' numbers and counts ('counts') and which unknown words they are ('places'); of each bucket
    its known words ('known', with n: their count, v: how many, ones: how many that occur once) and unknown ones ('unknown')."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        given = [unpack(x) for x in part["x"]]
        coded = pa.concat_arrays([arrayed(x) for x in given]).dictionary_encode()
        words, sizes = coded.dictionary, [len(x["size"]) for x in given]
        places, counts = coded.indices.to_numpy(), np.concatenate([x["count"] for x in given])
        total = np.zeros(len(words), np.int64)
        np.add.at(total, places, counts)
        known = pc.sort_indices(pa.table({"n": total, "w": words}), [("n", "descending"), ("w", "ascending")]).to_numpy()
        known, unknown = np.split(known, [int((total > 0).sum())])
        number = np.full(len(words), UNKNOWN, np.int64)
        number[known] = FIRST + key[0] + buckets * np.arange(len(known))
        rank = np.zeros(len(words), np.int64)
        rank[unknown] = np.arange(len(unknown))
        out = []
        for chunk, p in zip(part["chunk"], np.split(places, np.cumsum(sizes)[:-1]), strict=True):
            out.append(("counts", chunk, key[0], pack({"number": number[p], "count": total[p]})))
            out.append(("places", chunk, key[0], pack({"rank": rank[p[total[p] == 0]]})))
        out.append(("known", -1, key[0], pack(joined(words.take(pa.array(known))))))
        out.append(("unknown", -1, key[0], pack(joined(words.take(pa.array(unknown))))))
        got = rows_of(out).assign(n=0, v=0, ones=0)
        got.loc[got["kind"] == "known", ["n", "v", "ones"]] = [int(total.sum()), len(known), int((total == 1).sum())]
        return got

    return chunks.filter("kind = 'words'").groupBy("bucket").applyInPandas(run, SCHEMA + ", n long, v long, ones long")


def differences(a: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Whole numbers that don't fall but where new ones begin, as what they rise by, and themselves where new."""
    out = np.diff(a, prepend=a[:1])
    out[new] = a[new]
    return out


def summed(rises: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The numbers again that differences() was given."""
    out, at = np.cumsum(rises), np.flatnonzero(new)
    return out - np.repeat(out[at] - rises[at], np.diff(at, append=len(rises)))


def begins(sizes: np.ndarray) -> np.ndarray:
    """Where stretches of these sizes (from 1) begin."""
    new = np.zeros(sizes.sum(), bool)
    new[np.cumsum(sizes) - sizes] = True
    return new


def packed_triples(w1: np.ndarray, w2: np.ndarray, w: np.ndarray, n: np.ndarray, c: np.ndarray) -> bytes:
    """Distinct triples in order of w1, w2, w, as rises, and c, which follows from w, once a w."""
    w1, w2, w = (x.astype(np.int64) for x in (w1, w2, w))
    new, new1, new2 = np.arange(len(w)) == 0, lm_words.changes(w1), lm_words.changes(w1, w2)
    return pack({"w1": differences(w1, new), "w2": differences(w2, new1), "w": differences(w, new2), "n": n, "c": lm_words.looked_up(w, c, lm_words.kinds_of(w.astype(np.uint32)))})


def triples_of(x: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """w1, w2, w and n of packed triples, and c of each w that they have, in order."""
    x = unpack(x)
    w1 = summed(x["w1"], np.arange(len(x["w1"])) == 0).astype(np.uint32)
    w2 = summed(x.pop("w2"), lm_words.changes(w1)).astype(np.uint32)
    w = summed(x.pop("w"), lm_words.changes(w1, w2)).astype(np.uint32)
    return [w1, w2, w, x["n"]], x["c"]


def unpacked_triples(x: bytes) -> list[np.ndarray]:
    some, c = triples_of(x)
    return [*some, lm_words.looked_up(lm_words.kinds_of(some[2]), c, some[2])]


def triples(chunks: DataFrame, found: DataFrame, buckets: int, total: int, distinct: int) -> DataFrame:
    """Of each chunk its texts with all but the score ('texts') and, by bucket, its distinct triples ('triples0' and so on, by round)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = unpack(part.loc[part["kind"] == "texts", "x"].iloc[0])
        order = np.argsort(x["bucket"], kind="stable")
        replies = [unpack(r) for r in part[part["kind"] == "counts"].sort_values("bucket")["x"]]
        number, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        number[order] = np.concatenate([r["number"] for r in replies])
        count[order] = np.concatenate([r["count"] for r in replies])
        unknown = np.zeros(len(order), np.int64)
        unknown[order] = np.cumsum(count[order] == 0) - 1
        length, tok = x["length"], x["tok"]
        doc = np.repeat(np.arange(len(length)), length)
        starts = np.cumsum(length) - length
        # words by their place among the chunk's numbers, START the first
        kinds = lm_words.kinds_of(np.append(number, START))
        w = lm_words.looked_up(kinds, np.arange(len(kinds)), number)[tok]
        w1 = np.concatenate([w[:1], w[:-1]])
        w1[starts] = 0
        w2 = np.concatenate([w1[:1], w1[:-1]])
        w2[starts] = 0
        order, new = lm_words.ordered(w1, w2, w)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        n = np.bincount(place, ~x["held"].astype(bool)[doc], len(first)).astype(np.int64)
        # nothing follows an unknown word in training texts: such triples need not meet
        w1, w2, w, c = kinds[w1[first]], kinds[w2[first]], kinds[w[first]], count[tok[first]]
        middle = np.where(w1 == UNKNOWN, w, w1).astype(np.uint64) * MIX >> np.uint64(32)
        by, ends = dealt((middle % np.uint64(buckets)).astype(np.int64), buckets)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        w1, w2, w, n, c = (v[by] for v in (w1, w2, w, n, c))
        base = np.bincount(doc, np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))[tok], len(length))
        some = (count == 0)[tok]
        known = np.bincount(doc[~some], minlength=len(length))
        texts = {"ids": x["ids"], "held": x["held"], "size": x["size"], "length": length, "known": known, "base": base.tolist(), "place": rank[place], "doc": doc[some], "unknown": unknown[tok[some]]}
        out = [("texts", key[0], -1, pack(texts))]
        for b in np.flatnonzero(np.diff(ends)).tolist():
            out.append((f"triples{b % MEET_ROUNDS}", key[0], b, packed_triples(*(v[ends[b] : ends[b + 1]] for v in (w1, w2, w, n, c)))))
        return rows_of(out)

    both = chunks.filter("kind = 'texts'").unionByName(found.filter("kind = 'counts'").select(*chunks.columns))
    return both.groupBy("chunk").applyInPandas(run, SCHEMA)


def entries(blobs) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct triples of a bucket, the places of all given ones, and how many each blob gave."""
    columns, words, counts = [[], [], [], []], [], []
    for some, c in map(triples_of, blobs):
        some[3] = some[3].astype(np.uint32)
        for column, x in zip(columns, some, strict=True):
            column.append(x)
        words.append(lm_words.kinds_of(some[2]))
        counts.append(c)
    sizes = np.array([len(x) for x in columns[0]])
    w1, w2, w, n = (np.concatenate(columns.pop(0)) for _ in range(4))
    got, place = lm_words.merged(w1, w2, w, n, w)
    got[4] = lm_words.looked_up(np.concatenate(words), np.concatenate(counts), got[2])
    return got, place, sizes


TOGETHER = "bucket int, x binary, y binary"


def together(made: DataFrame) -> DataFrame:
    """Of each bucket its distinct triples (x) and the places of each chunk's among them (y)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        got, place, sizes = entries(part["x"])
        y = {"chunk": part["chunk"].to_numpy(np.int64), "size": sizes, "place": differences(place, begins(sizes))}
        return pd.DataFrame({"bucket": [key[0]], "x": [packed_triples(*got)], "y": [pack(y)]})

    return made.groupBy("bucket").applyInPandas(run, TOGETHER)


def fit_words(met: DataFrame, total: int, distinct: int, ones: int) -> tuple:
    """Weights and cells of the mixing over words: learned by bucket, averaged by the buckets' counts."""
    shape = (3 * lm_words.GATES, lm_words.CELLS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summed, seen = np.zeros(lm_words.SIZE + 2 * shape[0] * shape[1]), 0.0
        for batch in batches:
            for x in batch["x"]:
                got = unpacked_triples(x)
                if n := float(got[3].sum()):
                    mixer = lm_words.WordMixer(total, distinct, ones)
                    mixer.learn(got)
                    summed += np.concatenate([mixer.weights * n, mixer.hits.reshape(-1), mixer.all.reshape(-1)])
                    seen += n
        if seen:
            yield pd.DataFrame({"seen": [seen], "x": [summed.tobytes()]})

    parts = met.select("x").mapInPandas(run, "seen double, x binary").collect()
    if not parts:
        return lm_words.start_weights(), refined_cells(np.zeros(shape), np.zeros(shape))
    weights, hits, tries = np.split(sum(np.frombuffer(r["x"]) for r in parts), [lm_words.SIZE, lm_words.SIZE + shape[0] * shape[1]])
    return weights / sum(r["seen"] for r in parts), refined_cells(hits.reshape(shape), tries.reshape(shape))


def triple_scores(met: DataFrame, model: tuple, total: int, distinct: int, ones: int) -> DataFrame:
    """Of each chunk and bucket the triples' log10 shares ('shares')."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, x, y in zip(batch["bucket"], batch["x"], batch["y"], strict=True):
                shares = lm_words.WordMixer(total, distinct, ones, *model).log10(unpacked_triples(x)).astype("<f4").view("<u4")
                y = unpack(y)
                parts = np.split(shares[summed(y["place"], begins(y["size"]))], np.cumsum(y["size"])[:-1])
                yield rows_of([("shares", chunk, bucket, pack({"share": p})) for chunk, p in zip(y["chunk"], parts, strict=True)])

    return met.mapInPandas(run, SCHEMA)


def spelled(found: DataFrame, model: tuple, tasks: int) -> DataFrame:
    """Of each chunk and bucket the log10 probabilities of its unknown words ('spelled')."""
    sent, weights, cells = model
    mixers = []  # a task's own

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        words = parted(unpack(part.loc[part["kind"] == "unknown", "x"].iloc[0]))
        if words and not mixers:
            mixers.append(Mixer(slots_of(sent.value), weights, cells))
        costs = np.concatenate([np.zeros(0), *(mixers[0].log10(words[a : a + BLOCK]) for a in range(0, len(words), BLOCK))])
        mine = part[part["kind"] == "places"]
        return rows_of([("spelled", chunk, key[0], costs[unpack(x)["rank"]].tobytes()) for chunk, x in zip(mine["chunk"], mine["x"], strict=True)])

    mine = found.filter("kind in ('unknown', 'places')").select("kind", "chunk", "bucket", "x")
    return mine.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(run, SCHEMA)


def text_scores(made: DataFrame, shares: DataFrame, spellings: DataFrame, total: int, id_type) -> DataFrame:
    """A row a text: each chunk's texts add up the shares of their words, in order, and the spelling of unknown ones."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bucket")
        x = unpack(part.loc[part["kind"] == "texts", "x"].iloc[0])
        parts = {k: part.loc[part["kind"] == k, "x"] for k in ("shares", "spelled")}
        share = np.concatenate([unpack(r)["share"].astype("<u4").view("<f4") for r in parts["shares"]]).astype(float)
        spelling = np.concatenate([np.zeros(0), *(np.frombuffer(r) for r in parts["spelled"])])
        length = x["length"]
        doc = np.repeat(np.arange(len(length)), length)
        score = np.bincount(doc, share[x["place"]], len(length)) + np.bincount(x["doc"], spelling[x["unknown"]], len(length))
        return pd.DataFrame({"id": x["ids"], "held_out": x["held"].astype(bool), "n_tokens": length, "n_known": x["known"], "n_bytes": x["size"], "base_score": x["base"], "score": score})

    every = made.filter("kind = 'texts'").unionByName(shares).unionByName(spellings)
    out = every.groupBy("chunk").applyInPandas(run, "id string, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double")
    return out.select(F.col("id").cast(id_type).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))


def in_rounds(n: int, table: Callable[[int], DataFrame]) -> DataFrame:
    """Tables 0 to n - 1 as one; what one shuffled goes before the next is made."""
    found = []
    for k in range(n):
        found.append(table(k))
        clean_shuffles(found[0].sparkSession)
    return functools.reduce(DataFrame.unionByName, found)


def score(docs: DataFrame, held_out, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document; the model learns from those for which the Column held_out is false."""
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    docs = docs.select(F.col(doc_id).cast("string").alias("id"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = min(1 << 50, int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    word_buckets, triple_buckets = (min(1 << 16, max(8, size >> b)) for b in (WORD_BYTES, TRIPLE_BYTES))

    with scratch(spark) as drop:
        chunks = materialize(chunked(docs, word_buckets), "chunks", by="kind")
        found = materialize(numbered(chunks, word_buckets), "words")
        drop("chunks", "kind=words")
        total, distinct, ones = found.agg(*(F.coalesce(F.sum(k), F.lit(0)) for k in ("n", "v", "ones"))).first()
        triple_buckets = max(triple_buckets, total >> TRIPLE_WORDS)

        def make(k: int) -> DataFrame:
            mine = f"chunk % {MAKE_ROUNDS} = {k}"
            return materialize(triples(chunks.filter(mine), found.filter(mine), triple_buckets, total, distinct), "triples", keep=True, by="kind")

        made = in_rounds(MAKE_ROUNDS, make)
        drop("chunks")
        spelling = fit(found.filter("kind = 'known'").select("x"))
        tasks = max(spark.sparkContext.defaultParallelism, word_buckets >> 3)
        spellings = materialize(spelled(found, spelling, tasks), "spelled", keep=True)
        spelling[0].destroy()
        drop("words")

        def meet(k: int) -> DataFrame:
            met = materialize(together(made.filter(f"kind = 'triples{k}'")), "met")
            drop("triples", f"kind=triples{k}")
            return met

        met = in_rounds(MEET_ROUNDS, meet)
        model = fit_words(met, total, distinct, ones)
        shares = materialize(triple_scores(met, model, total, distinct, ones), "shares", keep=True)
    return text_scores(made, shares, spellings, total, id_type)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fold_of(F.col("doc_id"), 5) == 1)
