"""Files whose lines depend on those before them, read in many splits: consecutive groups, and headers that hold until the next.

A task sees the lines of a file split in their order. What reaches over a split's edge is settled from a small table with a few rows a split;
only lines of groups that touch an edge are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.ranking import use_checkpoints

#: Lines of one group that a task holds at most; the lines of larger groups are counted by a shuffle like those at edges.
MOST_HELD = 1 << 16
_AT = ("_file", "_block", "_key", "_valid")
_FOUND = "_run long, _first boolean, _last boolean, group_size long, group_valid long, first_valid boolean"


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and the file and split it comes from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each line its group's run in the split; for groups inside a split also their sizes, for others null."""
    held: pa.Table | None = None
    before: tuple | None = None  # file and block of the run before, its number, and whether its lines have left already
    number, gone = 0, False

    def out(part: pa.Table, run: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray, valid: np.ndarray, lead: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        more = [pa.array(run), pa.array(first), pa.array(last), pa.array(size, mask=edge), pa.array(valid, mask=edge), pa.array(lead, mask=edge)]
        names = [*part.column_names, *(x.split(" ")[0] for x in _FOUND.split(", "))]
        for batch in pa.table([*part.columns, *more], names=names).combine_chunks().to_batches():
            yield batch

    def close(part: pa.Table, end: bool) -> Iterator[pa.RecordBatch]:
        """The runs of ``part``, of which the last is over too."""
        nonlocal before, number, gone
        file, block, key = (part.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in _AT[:3])
        new = np.concatenate([[True], (file[1:] != file[:-1]) | (block[1:] != block[:-1]) | (key[1:] != key[:-1])])
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        split = np.concatenate([[True], (file[starts][1:] != file[starts][:-1]) | (block[starts][1:] != block[starts][:-1])])
        place = (part.column("_file")[0].as_py(), part.column("_block")[0].as_py())
        going_on = gone and before == place and held_key == part.column("_key")[0].as_py()
        split[0] = before != place
        order = np.arange(len(starts))
        first_of = np.maximum.accumulate(np.where(split, order, -1))
        run = np.where(first_of >= 0, order - first_of, number + order + (0 if going_on else 1))
        last = np.concatenate([split[1:], [end]])
        size = np.diff(np.append(starts, len(new)))
        ok = part.column("_valid").combine_chunks().to_numpy(zero_copy_only=False)
        valid = np.add.reduceat(ok.astype(np.int64), starts)
        seen = np.cumsum(ok)
        lead = ok & (seen - np.repeat(seen[starts] - ok[starts], size) == 1)
        edge = split | last
        edge[0] |= going_on
        first = split.copy()
        if going_on:
            first[0] = first_gone
        yield from out(part, run[of], first[of], last[of], size[of], valid[of], lead, edge[of])
        before, number, gone = (part.column("_file")[-1].as_py(), part.column("_block")[-1].as_py()), int(run[-1]), False

    held_key, first_gone = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        part = table if held is None else pa.concat_tables([held, table])
        key = [part.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in _AT[:3]]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) if part.num_rows > 1 else np.zeros(0, int)
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            follows = part.slice(cut, 1)
            same = all(part.column(c)[cut - 1].as_py() == follows.column(c)[0].as_py() for c in _AT[:2])
            yield from close(part.slice(0, cut), not same)
        held = part.slice(cut)
        if held.num_rows > MOST_HELD:
            place = (held.column("_file")[0].as_py(), held.column("_block")[0].as_py())
            going_on = gone and before == place and held_key == held.column("_key")[0].as_py()
            first_gone = first_gone if going_on else before != place
            number = number if going_on else (0 if before != place else number + 1)
            n = held.num_rows
            no, none = np.zeros(n, bool), np.zeros(n, np.int64)
            yield from out(held, np.full(n, number), np.full(n, first_gone), no, none, none, no, ~no)
            before, gone, held_key, held = place, True, held.column("_key")[0].as_py(), None
    if held is not None:
        yield from close(held, True)


def consecutive_groups(lines: DataFrame, key: Column, valid: Column | None = None) -> DataFrame:
    """``lines`` of ``placed_lines`` (with more columns, if any) in groups of consecutive lines of equal ``key``.

    Adds group_size, group_valid (its lines for which ``valid`` holds) and first_valid (whether a line is the first of those). A name
    that comes again later is another group. Lines with a null key are a group too, an empty one. Groups that lie inside a split are
    counted there; the others are stitched from one row a run at a split's edge.
    """
    own = lines.columns
    marked = lines.select(*own, F.coalesce(key, F.lit("")).alias("_key"), (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))).alias("_valid"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
    use_checkpoints(lines.sparkSession)
    found = marked.mapInArrow(_runs, f"{kinds}, {_FOUND}").checkpoint(eager=True)
    inside = found.where("group_size is not null").select(*own, "group_size", "group_valid", "first_valid")
    run = ["_file", "_block", "_run"]
    # the order of lines within a run does not matter but for which valid one is the first
    shared = found.where("group_size is null").withColumn("_line", F.monotonically_increasing_id())
    parts = shared.groupBy(*run).agg(F.first("_key").alias("k"), F.bool_or("_first").alias("f"), F.bool_or("_last").alias("l"), F.count("*").alias("n"), F.count_if("_valid").alias("v"), F.min(F.when(F.col("_valid"), F.col("_line"))).alias("_lead"))
    along = Window.partitionBy("_file").orderBy("_block", "_run")
    goes_on = F.col("f") & F.lag("l").over(along) & (F.lag("k").over(along) == F.col("k"))
    numbered = parts.withColumn("_group", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(along))
    whole = Window.partitionBy("_file", "_group")
    earlier = F.sum(F.col("v")).over(whole.orderBy("_block", "_run").rowsBetween(Window.unboundedPreceding, -1))
    sizes = numbered.select(*run, F.sum("n").over(whole).alias("_n"), F.sum("v").over(whole).alias("_v"), "_lead", (F.coalesce(earlier, F.lit(0)) == 0).alias("_begins"))
    edge = shared.drop("group_size", "group_valid", "first_valid").join(F.broadcast(sizes), run)  # a few rows for each split of 128 MB
    lead = F.col("_begins") & F.coalesce(F.col("_line") == F.col("_lead"), F.lit(False))
    return inside.unionByName(edge.select(*own, F.col("_n").alias("group_size"), F.col("_v").alias("group_valid"), lead.alias("first_valid")))


def carried_headers(lines: DataFrame, header: Column, keep: Column) -> DataFrame:
    """The lines of ``placed_lines`` for which ``keep`` holds, with ``header``: the last non-null value before each or of it, over all splits of its file.

    Within a split the value is carried by the task; what holds at a split's start is the last one of the splits before, of which there is a row each.
    """
    own = lines.columns
    marked = lines.select(*own, header.cast("string").alias("_header"), F.coalesce(keep, F.lit(False)).alias("_keep"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            file, block, value = (batch.column(names.index(c)) for c in ("_file", "_block", "_header"))
            a, b = file.dictionary_encode().indices.to_numpy(zero_copy_only=False), block.to_numpy(zero_copy_only=False)
            new = np.concatenate([[(file[0].as_py(), block[0].as_py()) != place], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            at = np.arange(batch.num_rows)
            known = value.is_valid().to_numpy(zero_copy_only=False)
            source, begin = np.maximum.accumulate(np.where(known, at, -1)), np.maximum.accumulate(np.where(new, at, -1))
            here = source >= np.maximum(begin, 0)
            filled = value.take(pa.array(np.where(here, source, 0), mask=~here))
            if held is not None and (begin < 0).any():
                filled = pa.compute.if_else(pa.array((begin < 0) & ~here), pa.scalar(held, pa.string()), filled)
            place, held = (file[-1].as_py(), block[-1].as_py()), filled[-1].as_py()
            arrays = [filled if n == "_header" else c for n, c in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(batch.column(names.index("_keep")))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
    found = marked.mapInArrow(carry, kinds)
    numbered = marked.where("_header is not null").withColumn("_id", F.monotonically_increasing_id())
    splits = marked.select("_file", "_block").distinct().join(numbered.groupBy("_file", "_block").agg(F.max_by("_header", "_id").alias("_own")), ["_file", "_block"], "left")
    before = F.last("_own", ignorenulls=True).over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = splits.select("_file", "_block", before.alias("_before"))
    return found.join(F.broadcast(carried), ["_file", "_block"]).select(*own, F.coalesce("_header", "_before").alias("header"))
