"""Packing documents into training sequences by the linear grouping scheme.

Documents become token ids and an end id; those longer than a sequence are cut into full pieces (the first may be shorter).
Full pieces are sequences of their own.  The others are packed by their lengths alone, of which there are fewer than the
capacity, so that the plan's size doesn't grow with the corpus:

1. lengths over SMALL are sorted and cut into groups of equal cardinality, each length rounded up to its group's largest;
2. configurations of the few rounded sizes are optimised (column generation on the bin-packing relaxation);
3. actual lengths take the places of the rounded ones;
4. what is left, and the small ones, go best-fit into the gaps, then into new sequences.

Pieces then find their places by their rank among the pieces of equal length.

Defined results: a null text is empty and gives the end id only; repeated rows and null ids are documents of their own; texts
are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

CAPACITY = 1024
END_ID = 2
#: Lengths up to this part of the capacity count as small.
SMALL = 0.25
GROUPS = 96
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Encoded chunks that a worker remembers, and bytes of ids in a batch that it hands on.
CACHE = 200_000
BATCH_BYTES = 4_000_000
BUCKETS = 1024

# ---------------------------------------------------------------------------------------------------- encoding

#: White space around a space, or before a last space: there, the pieces that the tokenizer forms reach over spaces.
ACROSS = re.compile(r"\s (?:\s|\Z)")


class Encoder:
    """Ids of texts as little-endian uint32 bytes.

    The tokenizer never joins what a single space parts (a space starts the piece that follows it), so chunks between spaces
    are encoded once and remembered.  Texts for which that doesn't hold are encoded as they are.  With the default tokenizer,
    chunks are encoded from the rank file of the same vocabulary, which gives the same ids (tested on whole corpora) in a third
    of the time; through the tokenizer itself the operator takes over its budget of CPU seconds.
    """

    def __init__(self, path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import base64

            import public_tokenizers
            import tiktoken

            with open(public_tokenizers.path(RANKS), "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            fast = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
            self.chunk = lambda c: fast.encode_ordinary(c) if SPECIAL not in c else fast.encode(c, allowed_special="all")
            path = public_tokenizers.path(TOKENIZER)
        else:
            self.chunk = lambda c: self.tokenizer.encode(c, add_special_tokens=False).ids
        self.path = path
        self.known: dict[str, bytes] = {"": b""}

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if ACROSS.search(text):
            return self.ids(text)
        # the separator stays with the chunk that it starts
        chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else re.findall(r" ?[^ ]+|^| ", text)
        got = list(map(self.known.get, chunks))
        if None in got:
            if len(self.known) > CACHE:
                self.known = {"": b""}
            for c in {c for c in chunks if c not in self.known}:
                ids = self.chunk(c)
                self.known[c] = struct.pack(f"<{len(ids)}I", *ids)
            got = list(map(self.known.__getitem__, chunks))
        return b"".join(got)


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, s + capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids (binary, little-endian uint32)."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)

        def block(rows: list) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

        rows, held = [], 0
        for batch in batches:
            for i, t in zip(batch.column("id"), batch.column("t"), strict=True):
                ids, i = encoder.encode(t.as_py()) + end, i.as_py()
                rows += [(i, p, a, b - a, ids[4 * a : 4 * b]) for p, (a, b) in enumerate(piece_bounds(len(ids) // 4, capacity))]
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield block(rows)
                    rows, held = [], 0
        if rows:
            yield block(rows)

    id_text = F.col(doc_id).cast("string").alias("id")
    named = T.StructType([T.StructField("doc_id", T.StringType()), *schema.fields[1:]])
    out = docs.select(id_text, F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, named)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


# ---------------------------------------------------------------------------------------------------- planning


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) in falling order, cut into groups of equal cardinality; a group's first length is its largest."""
    total = sum(n for _, n in lengths)
    size = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = size
            k = min(n, room)
            out[-1].append((length, k))
            n, room = n - k, room - k
    return out


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of largest value: unbounded knapsack over the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        v = best[c - sizes[fits]] + values[fits]
        k = int(v.argmax())
        best[c], last[c] = (v[k], fits[k]) if v[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    counts, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """(counts by size, times used) of a relaxed optimum, by column generation on a revised simplex."""
    s, d = np.asarray(sizes), np.asarray(demand, float)
    basis = np.diag((capacity // s).astype(float))
    x = d / np.diag(basis)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(len(s)))
        value, counts = best_pattern(s, duals, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, counts.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = counts
    return [(basis[:, j].astype(int), float(x[j])) for j in range(len(s))]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Classes (sequences, lengths in them) that hold every counted length below the capacity."""
    order = sorted(((n, c) for n, c in histogram.items() if c and n < capacity), reverse=True)
    large, rest = [x for x in order if x[0] > small * capacity], {n: c for n, c in order if n <= small * capacity}
    classes: list[tuple[int, list[int]]] = []
    if large:
        parts: dict[int, list[tuple[int, int]]] = {}
        for part in grouped(large, groups):
            parts.setdefault(part[0][0], []).extend(part)
        sizes = list(parts)
        for counts, times in configurations(sizes, [sum(c for _, c in parts[n]) for n in sizes], capacity):
            slots = [n for n, k in zip(sizes, counts, strict=True) for _ in range(k)]
            times = int(times + 1e-6)
            while times and slots and all(parts[n] for n in slots):
                # as many sequences as take the same actual lengths
                used, run, stock = [], times, {n: list(parts[n]) for n in set(slots)}
                for n in slots:
                    length, left = stock[n][0]
                    used.append(length)
                    stock[n] = stock[n][1:] or [(length, 0)]
                for n in set(slots):
                    taken = [u for u, x in zip(used, slots, strict=True) if x == n]
                    if len(set(taken)) < len(taken) or len(parts[n]) < len(taken):  # slots of one size share what there is of a length
                        used = [parts[n][0][0] if x == n else u for u, x in zip(used, slots, strict=True)]
                    for length in set(u for u, x in zip(used, slots, strict=True) if x == n):
                        have = next(c for m, c in parts[n] if m == length)
                        run = min(run, have // sum(u == length and x == n for u, x in zip(used, slots, strict=True)))
                if run == 0:  # fewer than one sequence takes: leave them to best fit
                    for n in set(slots):
                        if parts[n][0][1] < slots.count(n):
                            length, c = parts[n].pop(0)
                            rest[length] = rest.get(length, 0) + c
                    continue
                classes.append((run, used))
                times -= run
                for u, n in zip(used, slots, strict=True):
                    at = next(i for i, (m, _) in enumerate(parts[n]) if m == u)
                    parts[n][at] = (u, parts[n][at][1] - run)
                for n in set(slots):
                    parts[n] = [(m, c) for m, c in parts[n] if c]
        for left in parts.values():
            for length, c in left:
                rest[length] = rest.get(length, 0) + c
    return best_fit(classes, rest, capacity)


def best_fit(classes: list[tuple[int, list[int]]], rest: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """classes with the lengths of rest added, longest first, each into the fullest sequences that have room."""
    by_room: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    for n, used in classes:
        by_room[capacity - sum(used)].append((n, used))

    def add(n: int, used: list[int]) -> None:
        if n:
            by_room[capacity - sum(used)].append((n, used))

    for length in sorted(rest, reverse=True):
        left = rest[length]
        room = length
        while left and room <= capacity:
            if not by_room[room]:
                room += 1
                continue
            n, used = by_room[room].pop()
            fit = room // length
            full = min(n, left // fit)
            add(full, used + [length] * fit)
            left, n = left - full * fit, n - full
            if n and left:  # fewer than one sequence takes
                add(1, used + [length] * left)
                left, n = 0, n - 1
            add(n, used)
        if left:
            fit = capacity // length
            add(left // fit, [length] * fit)
            add(int(left % fit > 0), [length] * (left % fit))
    return [x for same in by_room for x in same]


def places(classes: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of runs, the sequence of each run's first piece, and the offset in the sequence."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for n, used in classes:
        offset = 0
        for length in used:
            found.setdefault(length, []).append((ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + n
            offset += length
        sequence += n
    return {k: tuple(np.asarray(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


# ---------------------------------------------------------------------------------------------------- the operator


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank (from 0) among those of equal length: bucket totals before, and a window within the bucket."""
    from pyspark.sql import Window

    columns = [F.col(c) for c in ("doc_id", "piece", "start")]
    rows = rows.withColumn("__h", F.xxhash64(*columns)).withColumn("__b", F.pmod("__h", F.lit(BUCKETS)))
    counts = rows.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n")).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("__b", "n"))).alias("all"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<b:bigint,before:bigint>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.array_append(a["out"], F.struct(x["__b"].alias("b"), a["at"].alias("before"))).alias("out"))
    before = counts.select(F.col("length").alias("__len"), F.inline(F.aggregate("all", zero, step, lambda a: a["out"])))
    out = rows.join(before, (F.col("length") == F.col("__len")) & (F.col("__b") == F.col("b")))
    place = F.row_number().over(Window.partitionBy("__len", "b").orderBy("__h"))
    return out.withColumn("rank", F.col("before") + place - 1).drop("__h", "__b", "__len", "b", "before")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, tokenizer: str | None = None, carry: dict | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, what carry makes of ids (the ids themselves by default), sequence_id and offset.

    Sequences of one full piece have negative ids, the others the plan's, from 0.
    """
    carry = {"ids": F.col("ids")} if carry is None else carry
    cut = pieces(docs, text, doc_id, capacity, tokenizer).select("doc_id", "piece", "start", "length", *[c.alias(k) for k, c in carry.items()])
    cut = materialize(cut, "pieces")
    names = cut.columns
    # at most capacity - 1 rows
    histogram = {r["length"]: r["n"] for r in cut.filter(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = cut.filter(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    runs = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.arrow_udf("sequence_id long, offset long")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(n)), np.int64)
        for size in np.unique(n):
            at = n == size
            first, sequence, offset = runs.value[int(size)]
            k = np.searchsorted(first, r[at], side="right") - 1
            out[0, at], out[1, at] = sequence[k] + r[at] - first[k], offset[k]
        return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["sequence_id", "offset"])

    part = ranked(cut.filter(F.col("length") < capacity)).withColumn("__at", placed("length", "rank"))
    part = part.select(*names, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))
    return full.unionByName(part).select(*schema.names)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), carry={"ids_crc32": F.crc32("ids")})
