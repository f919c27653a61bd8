"""Near-duplicate documents by SimHash fingerprints.

A fingerprint has a bit set where more than half of the XXH64 values of the document's three-word shingles have it. Two fingerprints
that differ in three bits at most differ in three bytes at most, so they share five of their eight positional bytes, and
three of the first six. The inverted index has a posting for each choice of three positions of those six and the bytes
that stand there, so a list holds what shares three positional bytes instead of one, a 2^24th of unrelated fingerprints
instead of a 256th. For a pair that meets in a list the shared positional bytes of all eight are tallied, pairs under five are left, and
the differing bits of the others are counted. No pair with three differing bits or fewer misses all lists: the filter is exact.

Equal fingerprints are one item, so copies are never paired; items of a list are joined as in ``grouping``: no pairs leave a task.

Cases: null and empty texts and those without words have fingerprint zero and are linked like any other; a text of one or two words
has its whole sequence as its one shingle. A null doc_id has a fingerprint, no links, and a null component. Repeated rows are copies and come back each;
rows that share a doc_id share links, whatever their texts. Texts of any length are read whole, in bounded pieces. An empty table gives none.
Columns of ``docs`` other than doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.grouping import BAND_BITS, Group, Joined, document_components, labelled, linked_groups, spanning
from strandlake.llm.tables import stored
from strandlake.llm.textblocks import LOWER, blocks, trimmed

SHINGLE, SEED, MOST_BITS, BYTES = 3, 42, 3, 8
#: Positional bytes that linked fingerprints share at least.
LEAST_SHARED = BYTES - MOST_BITS
#: Positions of a posting, of the first ``FIRST`` ones: whoever shares five of eight positions shares three of any six.
POSTED, FIRST = 3, 6
#: Shingles whose bits are summed at once, and pairs that are tested at once.
SUMMED, TESTS = 1 << 17, 200_000
#: Bytes from which on the library's function hashes a shingle by itself.
LONG = 256
#: Primes of XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the byte ranges, all at once but the long ones."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, 0, (1,))
    seed = np.array([seed], np.uint64)
    out = np.repeat(seed + _P5, len(starts))
    at, end = starts.copy(), starts + sizes
    wide = np.flatnonzero((sizes >= 32) & (sizes < LONG))
    if len(wide):
        acc = [np.repeat(x, len(wide)) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        some = np.arange(len(wide))
        while len(some):
            for k in range(4):
                acc[k][some] = _lane(acc[k][some], eight[at[wide[some]] + 8 * k])
            at[wide[some]] += 32
            some = some[end[wide[some]] - at[wide[some]] >= 32]
        total = _turned(acc[0], 1) + _turned(acc[1], 7) + _turned(acc[2], 12) + _turned(acc[3], 18)
        for x in acc:
            total = (total ^ _lane(np.zeros(1, np.uint64), x)) * _P1 + _P4
        out[wide] = total
    out += sizes.astype(np.uint64)
    some = np.flatnonzero((sizes >= 8) & (sizes < LONG))
    while len(some := some[end[some] - at[some] >= 8]):
        out[some] = _turned(out[some] ^ _lane(np.zeros(1, np.uint64), eight[at[some]]), 27) * _P1 + _P4
        at[some] += 8
    some = np.flatnonzero((end - at >= 4) & (sizes < LONG))
    out[some] = _turned(out[some] ^ four[at[some]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    at[some] += 4
    some = np.flatnonzero(sizes < LONG)
    while len(some := some[at[some] < end[some]]):
        out[some] = _turned(out[some] ^ padded[at[some]].astype(np.uint64) * _P5, 11) * _P1
        at[some] += 1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    out ^= out >> np.uint64(32)
    for k in np.flatnonzero(sizes >= LONG):
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]].tobytes(), int(seed[0]))
    return out


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words in lower case with one space before each, and where they start and end there."""
    size = ends - starts
    to = np.cumsum(size + 1)
    at = to - size
    source = np.repeat(starts - at, size + 1) + np.arange(to[-1] if len(to) else 0)
    text = LOWER[data[np.maximum(source, 0)]] if len(to) else np.zeros(0, np.uint8)
    text[at - 1] = 32
    return text, at, to


def _majority(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes (``counts`` from ``first`` on, one behind another, none empty) the bits that over half of them have."""
    ones = np.zeros((len(first), 64), np.int64)
    for low in range(0, len(hashes), SUMMED):
        part = hashes[low : low + SUMMED]
        a, b = np.searchsorted(first, low, side="right") - 1, np.searchsorted(first, low + len(part), side="left")
        bits = np.unpackbits(part.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[a:b] += np.add.reduceat(bits, np.maximum(first[a:b], low) - low, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _block_fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int, shingle: int) -> np.ndarray:
    out = np.zeros(rows, np.uint64)
    text, at, to = _spaced(data, starts, ends)
    n = np.bincount(row, minlength=rows)
    full = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[full]
    times = np.maximum(1, n[full] - shingle + 1)
    run = np.cumsum(times) - times
    i = np.arange(times.sum()) + np.repeat(first - run, times)
    last = np.minimum(i + shingle, np.repeat(first + n[full], times)) - 1
    out[full] = _majority(xxh64(text, at[i], to[last] - at[i]), run, times)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row of ``docs``."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                starts, ends, row = block.spans()
                found = _block_fingerprints(block.data, starts, ends, row, block.rows, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(found.view(np.int64))], schema=FINGERPRINTS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(hash_texts), "doc_id long, fp long")


def postings(fps: DataFrame) -> DataFrame:
    """(bucket, id) of each fingerprint ``id``: a list for each choice of ``POSTED`` of the first ``FIRST`` positions and their bytes."""
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(FIRST), POSTED)]
    lists = [(F.xxhash64(F.lit(k), F.col("id").bitwiseAND(F.lit(m).cast("long"))).bitwiseAND(-(1 << BAND_BITS))).bitwiseOR(k) for k, m in enumerate(masks)]
    return fps.select(F.explode(F.array(*lists)).alias("bucket"), "id")


def _numbers(payload: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(payload.to_pylist()), ">u8").astype(np.uint64)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are linked: shared positional bytes are tallied first, differing bits counted for those that have enough."""
    differ = a ^ b
    out = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(1) >= LEAST_SHARED
    out[out] = np.bitwise_count(differ[out]) <= MOST_BITS
    return out


def _pair_links(a: pa.Array, b: pa.Array) -> np.ndarray:
    return near(_numbers(a), _numbers(b))


def _block_links(group: Group) -> tuple[np.ndarray, np.ndarray]:
    fps, joined, xs, ys = _numbers(group.payload), Joined(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y, _ in group.pairs(TESTS):
        some = near(fps[x], fps[y])
        x, y = spanning(x[some], y[some], group.component, joined)
        xs.append(x)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable by links), a row for each row of ``docs``."""
    table = stored(fingerprints(docs, shingle), "fingerprints")
    filled = table.where("doc_id is not null")
    classes = stored(filled.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "fingerprint-classes")
    ids = classes.select(F.col("fp").alias("id"))
    weights = classes.where("n > 1").select(F.col("fp").alias("id"), F.col("n").alias("weight"))
    groups = linked_groups(postings(ids), weights, lambda some: some.select("id", F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("payload")), _pair_links, _block_links, "simhash")
    labels = document_components(filled, classes, groups, "fp", "simhash")
    out = labelled(table, labels, "fp")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. Rows with a null doc_id stay."""
    name = "gone_id"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = near_duplicates(docs, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
