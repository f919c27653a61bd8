"""Best-fit packing of token sequences.

Lengths are whole numbers up to the capacity, so the plan is made on the histogram of lengths, which has as many rows as
the capacity at most, however large the corpus. Items above a third of the capacity are matched greedily, the largest with
the largest that fits beside it, two to a bin at most; smaller items go, the largest first, to the tightest gap. The plan
is a list of runs: items of one length, numbered from ``rank``, go ``per_bin`` to a bin from ``bin`` on. Every item gets
its number within its length from a count by salt and a window inside the salt, so a length that a third of all items have
is spread over many tasks.

Cases: a null text is empty and has the end id alone. Repeated rows are packed each. Longer documents are cut into pieces
of the capacity, of which the first may be shorter. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.subwords import block_encoder
from strandlake.llm.tables import stored
from strandlake.llm.textblocks import blocks, trimmed

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: The vocabulary's added tokens; they are found inside texts.
ADDED = (("<|endoftext|>", 50_256),)
#: Items that one window task numbers at most, about.
SALT_ITEMS = 200_000


@dataclass(frozen=True)
class Run:
    """``count`` items of ``length``, numbered from ``rank``, ``per_bin`` to a bin from ``bin`` on, the first of each bin at ``offset``."""

    length: int
    rank: int
    count: int
    bin: int
    per_bin: int
    offset: int


def plan_bins(counts: dict[int, int], capacity: int) -> list[Run]:
    """The runs that pack ``counts[length]`` items of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    done = dict.fromkeys(left, 0)
    runs: list[Run] = []
    open_bins: dict[int, deque[tuple[int, int]]] = {}
    gaps: list[int] = []
    bins = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in open_bins:
                open_bins[gap] = deque()
                bisect.insort(gaps, gap)
            open_bins[gap].append((first, count))

    def put(length: int, count: int, first: int, per_bin: int, offset: int) -> None:
        runs.append(Run(length, done[length], count, first, per_bin, offset))
        done[length] += count
        left[length] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - n) - 1
        while at >= 0 and left[large[at]] < (2 if large[at] == n else 1):
            at -= 1
        if at < 0:
            count = left[n]
            put(n, count, bins, 1, 0)
            leave(capacity - n, bins, count)
        elif large[at] == n:
            count = left[n] // 2
            put(n, 2 * count, bins, 2, 0)
            leave(capacity - 2 * n, bins, count)
        else:
            count = min(left[n], left[large[at]])
            put(n, count, bins, 1, 0)
            put(large[at], count, bins, 1, n)
            leave(capacity - n - large[at], bins, count)
        bins += count

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                per_bin = capacity // n
                gap, first, count = capacity, bins, -(-left[n] // per_bin)
                bins += count
            else:
                gap = gaps[at]
                first, count = open_bins[gap].popleft()
                if not open_bins[gap]:
                    del open_bins[gap], gaps[at]
            per_bin = gap // n
            full = min(count, left[n] // per_bin)
            if full:
                put(n, full * per_bin, first, per_bin, capacity - gap)
                leave(gap - per_bin * n, first, full)
            if full < count:
                rest = left[n]
                if rest:
                    put(n, rest, first + full, per_bin, capacity - gap)
                    leave(gap - rest * n, first + full, 1)
                    full += 1
                leave(gap, first + full, count - full)
    return runs


def tokenized(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut from the end into pieces of ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = block_encoder(vocabulary, ADDED)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows: list[tuple] = []
                flat, bounds = encoder.encode(block)
                raw, bounds = memoryview(flat.astype("<u4").tobytes()), bounds.tolist()
                for i, doc in enumerate(batch.column(0).slice(block.first, block.rows).to_pylist()):
                    own = raw[4 * bounds[i] : 4 * bounds[i + 1]]
                    n = len(own) // 4 + 1
                    start, piece, stop = 0, 0, n % capacity or capacity
                    while start < n:
                        crc = zlib.crc32(own[4 * start : 4 * stop])
                        rows.append((doc, piece, start, stop - start, zlib.crc32(end, crc) if stop == n else crc))
                        start, stop, piece = stop, stop + capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """The columns of ``PIECES``, ``sequence_id`` and ``offset`` for a stored table of items with a ``length`` of 1 to ``capacity``."""
    # at most ``capacity`` rows reach the driver
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(counts, capacity)
    salts = max(16, -(-max(counts.values(), default=1) // SALT_ITEMS))
    items = items.select("doc_id", "piece", "start", "length", "ids_crc32")
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    per_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = per_salt.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order)).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_salt", "_before")

    grouped: dict[int, list[tuple[int, int, int, int]]] = {}
    for r in plan:
        grouped.setdefault(r.length, []).append((r.rank, r.bin, r.per_bin, r.offset))
    by_length = {n: np.array(rows, np.int64).T for n, rows in grouped.items()}
    names = ranked.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(names.index("length")).to_numpy(), batch.column(names.index("_rank")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, bin_, per_bin, start = by_length[int(n)]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                k = rank[rows] - first[run]
                sequence[rows] = bin_[run] + k // per_bin[run]
                offset[rows] = start[run] + k % per_bin[run] * n
            kept = [batch.column(i) for i, x in enumerate(names) if x != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*(x for x in names if x != "_rank"), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """Tokenises, stores the pieces (numbers only) once, and packs them."""
    return pack(stored(tokenized(docs, capacity), "pieces"), capacity).select(*PIECES.names, "sequence_id", "offset")
