"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct five-word shingles. Register i of its sketch keeps the smallest of the shingles'
exponentially distributed hashes, truncated to the grid of powers of ``BASE``: registers of a union are the larger of the
two, and equal registers become likelier with the overlap. Bands of registers propose pairs, the likelihood of the
numbers of larger, equal and smaller registers (set sizes are known) estimates the overlap of a pair, and what may be
similar enough is verified on the full sets.

With 28 bands of 5 registers a pair at Jaccard 0.85 shares no band with probability (1 - 0.85^5)^28, about 7e-8.
Documents of equal sets form a class first, so copies are never paired. Sets are of 64-bit hashes of shingles.

Cases: null and empty texts have no shingles and are linked with nothing; a text of one to four words has one shingle. A
null doc_id has no links, a null component, and is kept. Repeated rows are copies and come back each; rows that share a
doc_id share links, whatever their texts. Columns of ``docs`` other than doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.grouping import Group, Joined, document_components, intersections, labelled, linked_groups, numbered, spanning
from strandlake.llm.tables import split_by_ids, stored
from strandlake.llm.textblocks import blocks, mix, shingle_sets, trimmed

BANDS, BAND_SIZE = 28, 5
REGISTERS = BANDS * BAND_SIZE
BASE, RATE, TOP = 1.001, 20.0, 65_534
WIDTH = 2 * REGISTERS
#: Pairs of a block that are tested at once.
TESTS = 20_000
#: Standard errors below the threshold at which an estimate rules a pair out.
SLACK = 5.0

_SEED = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = mix(_SEED ^ np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("bands", pa.list_(pa.int64()))])


def registers(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The registers of each non-empty set; set k is shingles[bounds[k]:bounds[k + 1]]. Row k of the result is for set k."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, REGISTERS), np.uint16)
    if not len(full):
        return out
    least = np.empty((REGISTERS, len(full)), np.uint64)
    work = np.empty_like(shingles)
    for i in range(REGISTERS):
        np.bitwise_xor(shingles, _SEED[i], out=work)
        np.multiply(work, _FACTOR[i], out=work)
        least[i] = np.minimum.reduceat(work, bounds[full])
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-u) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16).T
    return out


def jaccard_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity given both sketches and set sizes, on a grid of 1/200."""
    plus, minus = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - plus - minus
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = np.clip(chance(u - v * grid), 1e-9, 1), np.clip(chance(v - u * grid), 1e-9, 1)
    fit = plus * np.log(p) + minus * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-9, 1))
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


def _set_ids(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """An id of each set from two sums over its shingles and its size."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(found)])
    total2 = np.concatenate([[np.uint64(0)], np.cumsum(mix(found ^ np.uint64(0x94D049BB133111EB)))])
    one, two = (t[bounds[1:]] - t[bounds[:-1]] for t in (total, total2))
    return mix(mix(one) + mix(two ^ np.uint64(0xD6E8FEB86659FD93)) + np.diff(bounds).astype(np.uint64))


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Set size, set id and band keys of each row of (doc_id, text)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found, bounds = shingle_sets(block, shingle)
                regs = registers(found, bounds)
                keys = np.zeros((block.rows, BANDS), np.uint64)
                for j in range(BANDS):
                    key = np.full(block.rows, np.uint64(j + 1))
                    for k in range(BAND_SIZE):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, j * BAND_SIZE + k])
                    keys[:, j] = numbered(key, j)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, block.rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(np.diff(bounds).astype(np.int64)), pa.array(_set_ids(found, bounds).view(np.int64)), listed], schema=SKETCH)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(sketch), "doc_id long, n_shingles long, set_id long, bands array<long>")


def _payloads(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, payload) of each row of (doc_id, text): the registers and then the whole sorted set."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found, bounds = shingle_sets(block, shingle)
                regs = registers(found, bounds)
                both = [regs[i].tobytes() + found[bounds[i] : bounds[i + 1]].tobytes() for i in range(block.rows)]
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(found, bounds).view(np.int64)), pa.array(both, pa.binary())], names=["id", "payload"])

    return docs.mapInArrow(trimmed(gather), "id long, payload binary")


def _unpacked(payload: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Registers, sets and set sizes."""
    raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in payload]
    regs = np.stack([x[:WIDTH] for x in raw]).view(np.uint16) if raw else np.zeros((0, REGISTERS), np.uint16)
    sets = [x[WIDTH:].copy().view(np.uint64) for x in raw]
    return regs, sets, np.array([len(x) for x in sets], np.float64)


@dataclass(frozen=True)
class Likeness:
    """Which sets are linked: those with 100 * intersection >= ``percent`` * union."""

    percent: int

    def likely(self, regs_a: np.ndarray, regs_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """What the likelihood of both sketches does not rule out."""
        share = self.percent / 100
        least = share - SLACK * (share * (1 - share) / REGISTERS) ** 0.5
        hit = np.minimum(size_a, size_b) * 100 >= self.percent * np.maximum(size_a, size_b)
        at = np.flatnonzero(hit)
        for k in range(0, len(at), 2_000):
            rows = at[k : k + 2_000]
            hit[rows] = jaccard_estimate(regs_a[rows], regs_b[rows], size_a[rows], size_b[rows]) >= least
        return hit

    def enough(self, both: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (size_a + size_b - both)

    def pairs(self, a: pa.Array, b: pa.Array) -> np.ndarray:
        (regs_a, sets_a, size_a), (regs_b, sets_b, size_b) = _unpacked(a), _unpacked(b)
        hit = self.likely(regs_a, regs_b, size_a, size_b)
        for k in np.flatnonzero(hit):
            both = len(np.intersect1d(sets_a[k], sets_b[k], assume_unique=True))
            hit[k] = self.enough(np.float64(both), size_a[k], size_b[k])
        return hit

    def block(self, group: Group) -> tuple[np.ndarray, np.ndarray]:
        regs, sets, size = _unpacked(group.payload)
        joined, xs, ys = Joined(), [], []
        for x, y, bucket in group.pairs(TESTS):
            some = np.minimum(size[x], size[y]) * 100 >= self.percent * np.maximum(size[x], size[y])
            x, y, bucket = x[some], y[some], bucket[some]
            some = group.fresh(x, y, bucket)
            x, y = x[some], y[some]
            some = self.likely(regs[x], regs[y], size[x], size[y])
            x, y = x[some], y[some]
            if not len(x):
                continue
            if group.listed:
                both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y, strict=True)], np.float64)
            else:
                rows, cols = np.unique(x), np.unique(y)
                both = intersections([sets[r] for r in rows], [sets[c] for c in cols])[np.searchsorted(rows, x), np.searchsorted(cols, y)]
            some = self.enough(both, size[x], size[y])
            x, y = spanning(x[some], y[some], group.component, joined)
            xs.append(x)
            ys.append(y)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *xs]), np.concatenate([none, *ys])


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, a row for each row of ``docs``."""
    table = stored(sketches(docs, shingle), "sketches")
    filled = table.where("n_shingles > 0 and doc_id is not null")
    classes = stored(filled.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "sets")
    members = filled.select(F.explode("bands").alias("bucket"), F.col("set_id").alias("id"))
    weights = classes.where("n > 1").select(F.col("set_id").alias("id"), F.col("n").alias("weight"))

    def payload_of(ids: DataFrame) -> DataFrame:
        wanted = stored(classes.join(ids.withColumnRenamed("id", "set_id"), "set_id").select("rep"), "wanted-sets")
        texts, _ = split_by_ids(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), wanted)
        # a document that only seems wanted does no harm
        return _payloads(texts.select("doc_id", "text"), shingle).dropDuplicates(["id"])

    like = Likeness(percent)
    groups = linked_groups(members, weights, payload_of, like.pairs, like.block, "near")
    label = document_components(filled, classes, groups, "set_id", "near")
    own = F.col("n_shingles") > 0
    rows = table.select("doc_id", "n_shingles", "set_id")
    out = labelled(rows.where(own), label, "set_id").unionByName(rows.where(~own), allowMissingColumns=True)
    out = out.withColumn("component_id", F.when(own & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id."""
    dropped = stored(near_duplicates(docs, percent, shingle).where("not kept").select("doc_id").distinct(), "near-dropped")
    maybe, others = split_by_ids(docs, dropped)
    return others.union(maybe.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns))
