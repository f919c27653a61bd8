"""Connected groups of items that share buckets, without emitting all pairs of a bucket.

First every item is compared with the heaviest member of its buckets (the one that stands for most copies), one pair an
item, and the links found are joined into components. Then only buckets whose members still belong to different components
are looked at, one of those that have the same members, and in them only pairs from different components: members are dealt into
blocks of bounded size, two blocks meet in one task with all that is needed to decide there, and a task returns links that
span what it has joined, fewer than it has members. Blocks of a bucket's largest component never meet each other, so a bucket
in which one component has nearly all members costs about one row a member. A link inside a component changes no component, so no component misses
a link between bucket members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.tables import cut, stored
from strandlake.llm.textblocks import trimmed

#: Members and bytes of a block; two blocks are compared in one step.
BLOCK, BLOCK_BYTES = 1_024, 8 << 20
#: Members of a bucket up to which many buckets are looked at together.
SMALL = 32
#: Columns of the matrix by which a block's sets are intersected, at once.
COLUMNS = 4_096
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Given the payloads of two equally long columns, which pairs are links.
PairTest = Callable[[pa.Array, pa.Array], np.ndarray]
#: Bits of a bucket that number its band, so that two items are compared in one of the buckets they share.
BAND_BITS = 5


def numbered(keys: np.ndarray, band: int) -> np.ndarray:
    """Bucket keys with the band's number in the lowest bits."""
    return keys >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | np.uint64(band)


@dataclass
class Group:
    """Members of two blocks of a bucket, or of many small buckets: their payloads, components, and open buckets by band.

    ``blocks`` are the places of both blocks and the bucket, ``listed`` the pairs of small buckets and the bucket of each.
    """

    payload: pa.Array
    component: np.ndarray
    open_: np.ndarray
    blocks: tuple[np.ndarray, np.ndarray, int] | None = None
    listed: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of different components and their buckets, about ``most`` at once."""
        if self.listed:
            x, y, bucket = self.listed
            some = self.component[x] != self.component[y]
            x, y, bucket = x[some], y[some], bucket[some]
            for at in range(0, len(x), most):
                yield x[at : at + most], y[at : at + most], bucket[at : at + most]
            return
        left, right, bucket = self.blocks
        step = max(1, most // len(right))
        for at in range(0, len(left), step):
            x, y = (m.ravel() for m in np.meshgrid(left[at : at + step], right, indexing="ij"))
            some = self.component[x] != self.component[y]
            if left[0] == right[0]:
                some &= x < y
            yield x[some], y[some], np.full(int(some.sum()), bucket)

    def fresh(self, x: np.ndarray, y: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Whether this is the first of the open buckets that a pair shares."""
        out = np.zeros(len(x), bool)
        for k in range(0, len(x), 20_000):
            a, b = self.open_[x[k : k + 20_000]], self.open_[y[k : k + 20_000]]
            out[k : k + 20_000] = ~((a == b) & (a < bucket[k : k + 20_000, None])).any(1)
        return out


#: Given a group, links of it as two arrays of places.
BlockTest = Callable[[Group], tuple[np.ndarray, np.ndarray]]


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id) for all ids in ``edges`` (a, b), by alternating large-star and small-star steps."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v"), F.col("v")).distinct())


class Joined:
    """Components under union, by their labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (above := self.up.get(top, top)) != top:
            top = above
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def union(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def spanning(x: np.ndarray, y: np.ndarray, comps: np.ndarray, joined: Joined) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (x, y) that join what the ones before them left apart."""
    some = np.array([joined.union(a, b) for a, b in zip(comps[x].tolist(), comps[y].tolist(), strict=True)], bool)
    return x[some], y[some]


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, by products of 0/1 matrices over ``COLUMNS`` common shingles at once."""
    out = np.zeros((len(a), len(b)), np.float32)
    of_a, of_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (a, b))
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(all_a, all_b)
    at_a, at_b = (np.minimum(np.searchsorted(common, x), max(0, len(common) - 1)) for x in (all_a, all_b))
    if not len(common):
        return out
    keep_a, keep_b = common[at_a] == all_a, common[at_b] == all_b
    for first in range(0, len(common), COLUMNS):
        parts = []
        for n, of, at, keep in ((len(a), of_a, at_a, keep_a), (len(b), of_b, at_b, keep_b)):
            here = keep & (at >= first) & (at < first + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(common) - first)), np.float32)
            m[of[here], at[here] - first] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _star_links(multi: DataFrame, weights: DataFrame, payload: DataFrame, test: PairTest, name: str) -> DataFrame:
    weighed = multi.join(weights, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    centers = stored(weighed.groupBy("bucket").agg(F.max_by("id", "weight").alias("center"), F.max("weight").alias("w")), f"{name}-centers")
    pairs = multi.join(centers, "bucket").where("center <> id").groupBy(F.col("id").alias("b")).agg(F.max_by("center", "w").alias("a"))
    left, right = payload.select(F.col("id").alias("a"), F.col("payload").alias("pa")), payload.select(F.col("id").alias("b"), F.col("payload").alias("pb"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(test(batch.column(2), batch.column(3))))

    return stored(pairs.join(right, "b").join(left, "a").select("a", "b", "pa", "pb").mapInArrow(trimmed(linked), "a long, b long"), f"{name}-links")


def _block_links(rows: DataFrame, test: BlockTest) -> DataFrame:
    """Spanning links between different components; rows: (bucket, i, j, blk, id, component, open, payload), a group for each bucket and pair of blocks."""

    def group_of(part: pa.Table, **pairs) -> Group:
        listed = part.column(6).combine_chunks()
        open_ = np.repeat(np.arange(part.num_rows)[:, None], 1 << BAND_BITS, 1)
        shared = listed.flatten().to_numpy()
        open_[np.repeat(np.arange(part.num_rows), np.diff(listed.offsets.to_numpy())), shared & ((1 << BAND_BITS) - 1)] = shared
        return Group(part.column(7).combine_chunks(), part.column(5).to_numpy(), open_, **pairs)

    def links(part: pa.Table, group: Group) -> Iterator[pa.RecordBatch]:
        x, y = test(group)
        if len(x):
            ids = part.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], schema=PAIRS)

    def large(part: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, blk = (part.column(k).to_numpy() for k in (1, 2, 3))
        left, right = np.flatnonzero(blk == i[0]), np.flatnonzero(blk == j[0])
        if len(left) and len(right):
            yield from links(part, group_of(part, blocks=(left, right, part.column(0)[0].as_py())))

    def small(part: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All pairs of groups that have one block and few members, together."""
        xs, ys = [], []
        for n in np.unique(sizes):
            x, y = np.triu_indices(n, 1)
            first = starts[sizes == n][:, None]
            xs.append((first + x).ravel())
            ys.append((first + y).ravel())
        x, y = np.concatenate(xs), np.concatenate(ys)
        yield from links(part, group_of(part, listed=(x, y, part.column(0).to_numpy()[x])))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            keys = np.stack([part.column(k).to_numpy() for k in range(3)], 1)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            sizes = np.diff(edge)
            # the last group may go on in the next batch
            few = (sizes <= SMALL) & (keys[edge[:-1], 1] == keys[edge[:-1], 2])
            if few.any():
                yield from small(part.slice(0, edge[-1]), edge[:-1][few], sizes[few])
            for s, n in zip(edge[:-1][~few], sizes[~few], strict=True):
                yield from large(part.slice(s, n))
            held = [part.slice(edge[-1])]
        if held:
            yield from large(held[0])

    return rows.repartition(_tasks(rows), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(trimmed(compare), "a long, b long")


def dealt_out(here: DataFrame) -> DataFrame:
    """A row (bucket, i, j, blk, id, component) for each pair (i, j) of blocks that the block of a member of ``here`` is looked at in.

    here: (bucket, id, component, _top, _tops, _rest): the largest component or null, its blocks, and those of all other members, which come first.
    """
    top = F.coalesce(F.col("component") == F.col("_top"), F.lit(False))
    own = F.when(top, F.col("_rest") + F.pmod(F.xxhash64("id"), "_tops")).otherwise(F.pmod(F.xxhash64("id"), "_rest"))
    met = F.sequence(F.lit(0).cast("long"), F.col("_rest") - 1 + F.when(top, 0).otherwise(F.col("_tops")))
    pairs = here.select("bucket", "id", "component", own.alias("blk"), met.alias("met")).withColumn("_other", F.explode("met"))
    return pairs.select("bucket", F.least("blk", "_other").alias("i"), F.greatest("blk", "_other").alias("j"), "blk", "id", "component")


#: A key with over a ``HEAVY``-th of all rows is looked up in memory; there are fewer than ``HEAVY`` of them.
HEAVY = 1_000


def labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``labels``: unique keys, ``n`` (the number of rows that have the key), and columns to add.

    Labels of heavy keys are broadcast and their rows are spread over all tasks, so no task gets what one key holds.
    """
    more = [c for c in labels.columns if c not in (key, "n")]
    total = labels.agg(F.sum("n")).first()[0] or 0
    packed = labels.select(F.col(key).alias("_key"), "n", F.struct(*more).alias("_label"))
    heavy = F.broadcast(packed.where(F.col("n") * HEAVY > total).select("_key", F.col("_label").alias("_heavy")))
    light = packed.where(F.col("n") * HEAVY <= total).select("_key", F.col("_label").alias("_light"), F.lit(-1).cast("long").alias("_slot"))
    some = rows.join(heavy, rows[key] == heavy["_key"], "left").drop("_key")
    some = some.withColumn("_at", F.when(F.col("_heavy").isNull(), -1).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))))
    both = some.join(light, (some[key] == light["_key"]) & (some["_at"] == light["_slot"]), "left")
    return both.select(*rows.columns, *(F.coalesce(f"_heavy.{c}", f"_light.{c}").alias(c) for c in more))


def document_components(table: DataFrame, classes: DataFrame, groups: DataFrame, key: str, name: str) -> DataFrame:
    """(key, component_id, n) of the items that stand for several rows or have links: the smallest doc_id of their component.

    table: (doc_id, key), a row a document; classes: (key, rep, n), the smallest doc_id and the number of rows of each key; groups: (id, component) of linked keys.
    Rows that share a doc_id link their keys.
    """
    several = table.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id")
    shared = stored(table.select("doc_id", key).join(several, "doc_id").groupBy("doc_id").agg(F.collect_set(key).alias("s")).select(F.array_min("s").alias("b"), F.explode("s").alias("a")).where("a <> b"), f"{name}-shared-ids")
    if not shared.isEmpty():
        groups = cut(connected_components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(shared.select("a", "b"))))
    grouped = classes.join(groups.withColumnRenamed("id", key), key, "left").where("n > 1 or component is not null")
    grouped = stored(grouped.select(key, "rep", F.col("n").alias("times"), F.coalesce("component", key).alias("component")), f"{name}-groups")
    least = stored(grouped.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), f"{name}-least")
    return stored(labelled(grouped, least, "component").select(key, "component_id", F.col("times").alias("n")), f"{name}-labels")


def shared_members(members: DataFrame) -> DataFrame:
    """The distinct rows (bucket, id) of the buckets that several ids have. Every row is moved once; a task reads its rows by bucket and keeps one back."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = np.zeros((2, 0), np.int64), False  # the last row, and whether it has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, id_ = np.concatenate([last, [c.to_numpy() for c in batch.columns]], 1)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            several = np.minimum.reduceat(id_, edge) != np.maximum.reduceat(id_, edge)
            several[0] |= told
            keep = np.repeat(several, np.diff(np.append(edge, len(bucket))))
            if told:
                keep[0] = False
            # rows like the first one of their bucket wait with it
            last, told = np.array([bucket[-1:], id_[-1:]]), bool(several[-1])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(id_[keep])], names=["bucket", "id"])

    rows = members.select(F.col("bucket").cast("long"), F.col("id").cast("long"))
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(shared), "bucket long, id long").distinct()


def linked_groups(members: DataFrame, weights: DataFrame, payload_of: Callable[[DataFrame], DataFrame], pair_test: PairTest, block_test: BlockTest, name: str) -> DataFrame:
    """``id, component`` of the items that have a link.

    members: (bucket, id), repeated rows allowed; weights: (id, weight), 1 where missing; payload_of: (id, payload) of all
    ids that it is given (others do no harm).
    """
    multi = stored(shared_members(members), f"{name}-buckets")
    payload = stored(payload_of(multi.select("id").distinct()), f"{name}-payload")
    groups = cut(connected_components(_star_links(multi, weights, payload, pair_test, name)))

    labels = stored(multi.join(groups, "id", "left").join(payload.select("id", F.octet_length("payload").alias("size")), "id").select("bucket", "id", F.coalesce("component", "id").alias("component"), "size"), f"{name}-labelled")
    parts = labels.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2"))
    mixed = parts.groupBy("bucket").agg(
        F.count("*").alias("components"), F.max(F.struct("n", "size", "component")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")
    )
    # buckets of the same members need one look
    once = mixed.where("components > 1").groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket"), F.first("top").alias("top"), F.first("size").alias("size"))
    one = (F.col("n") <= BLOCK) & (F.col("size") <= BLOCK_BYTES)
    blocks_of = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("long")
    # the largest component has blocks of its own, behind those of the rest
    open_ = stored(
        once.select(
            "bucket", F.when(~one, F.col("top.component")).alias("_top"), F.when(one, 0).otherwise(blocks_of(F.col("top.n"), F.col("top.size"))).cast("long").alias("_tops"),
            F.when(one, 1).otherwise(blocks_of(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"))).cast("long").alias("_rest"),
        ), f"{name}-open")
    here = stored(labels.join(open_, "bucket").select("bucket", "id", "component", "_top", "_tops", "_rest"), f"{name}-dealt")
    with_open = payload.join(here.groupBy("id").agg(F.collect_set("bucket").alias("open")), "id").select("id", "open", "payload")
    rows = dealt_out(here).join(with_open, "id").select("bucket", "i", "j", "blk", "id", "component", "open", "payload")
    more = stored(_block_links(rows, block_test), f"{name}-links2")
    if more.isEmpty():
        return groups
    return cut(connected_components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)))
