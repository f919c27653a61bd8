"""Exact and near matching of sequences: seeds looked up in reference sequences, containment, duplicates.

References may be far larger than what is looked up in them. They are cut into overlapping pieces, so a long contig is walked by many
tasks. Up to ``MOST_SEEDS`` seeds go to every task, which compares the whole sequences where it finds one: only true places leave it, and
nothing is shuffled or stored on the way. Of more, a bitmap sized by their number goes to every task and refutes most places; what is
left is shuffled to the join that decides, and seeds that repeat too often there are dealt over slots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from strandlake.functions.sequences import reverse_complement
from strandlake.operators.ranking import use_checkpoints
from strandlake.operators.skew import salted_join

#: Letters of a piece of a reference, and places of a batch that leaves a task.
CHUNK, ROWS = 1 << 18, 1 << 14
#: Bits of the address in the bitmap of seeds: 16 for each seed, from 128 KB to 64 MB. Beyond 2^25 seeds it lets more places through.
LEAST_BITS, MOST_BITS = 20, 29
#: Seeds that a task holds with their sequences (some 100 MB with their marks), marks a seed, and comparisons made at once.
MOST_SEEDS, MARKS, PAIRS = 1 << 22, 32, 1 << 18
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Parts of a seed: offset and size of each, looked up together.
Kind = tuple[tuple[int, int], ...]
#: What a task makes of its batches.
Walk = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def packed(letters: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (32 at most) letters from each place on along the last axis, two bits a letter; other letters than A, C, G, T share the bits of one of them."""
    n = letters.shape[-1] - size + 1
    run, width, out, done = ((letters >> 1) & 3).astype(np.uint64), 1, None, 0
    while done < size:
        if size & width:
            part = run[..., done : done + n]
            out = part.copy() if out is None else out | (part << np.uint64(2 * done))
            done += width
        if done < size:
            run, width = run[..., :-width] | (run[..., width:] << np.uint64(2 * width)), 2 * width
    return out


def _run_hashes(letters: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` letters along the last axis."""
    n = letters.shape[-1] - size + 1
    h = np.zeros((*letters.shape[:-1], max(0, n)), np.uint64)
    for j in range(size):
        h *= _ODD
        h += letters[..., j : j + n]
    return (h ^ (h >> np.uint64(29))) * _MIX


def seed_hashes(letters: np.ndarray, kinds: list[Kind], places: int) -> Iterator[np.ndarray]:
    """For each kind the hashes of its parts at the first ``places`` places along the last axis."""
    least = max(offset + size for kind in kinds for offset, size in kind)
    if least <= 32:
        runs = packed(letters, least)[..., :places]
        for number, kind in enumerate(kinds):
            h = runs & np.uint64(sum(((1 << 2 * size) - 1) << 2 * offset for offset, size in kind))
            h += np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h *= _ODD
            h ^= h >> np.uint64(29)
            h *= _MIX
            yield h
        return
    runs = {size: _run_hashes(letters, size) for size in {size for kind in kinds for _, size in kind}}
    for number, kind in enumerate(kinds):
        h = np.full((*letters.shape[:-1], places), np.uint64(number + 1))
        for offset, size in kind:
            h = (h ^ runs[size][..., offset : offset + places]) * _ODD
            h ^= h >> np.uint64(32)
        yield h * _MIX


def mismatch_kinds(size: int, mismatches: int) -> list[Kind]:
    """Seeds one of which is without a mismatch in any ``size`` letters with ``mismatches`` at most.

    The letters are cut into 1, 3, 5 or 6 parts (2k for more), of which 1, 2, 3 or 3 (k) stay whole: every choice of so many is a seed, of about
    half the letters, so that few places of a large reference have it by chance.
    """
    parts, whole = {0: (1, 1), 1: (3, 2), 2: (5, 3), 3: (6, 3)}.get(mismatches, (2 * mismatches, mismatches))
    if size < parts:
        raise ValueError("too short for so many mismatches")
    edges = [size * k // parts for k in range(parts + 1)]
    return list(combinations([(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], whole))


def with_seeds(rows: DataFrame, letters: str, kinds: list[Kind], least: int) -> DataFrame:
    """``rows`` once for each kind, with its number ``kind`` and ``seed``, the hash in the first ``least`` letters; shorter rows have none."""

    @F.arrow_udf("array<long>")
    def seeds(text: pa.Array) -> pa.Array:
        rows_ = text.to_pylist()
        some = [k for k, x in enumerate(rows_) if x is not None and len(x) >= least]
        found = np.zeros((len(some), len(kinds)), np.uint64)
        if some:
            raw = np.frombuffer("".join(rows_[k][:least] for k in some).encode("ascii", "replace"), np.uint8).reshape(-1, least)
            for j, h in enumerate(seed_hashes(raw, kinds, 1)):
                found[:, j] = h[:, 0]
        count = np.zeros(len(rows_), np.int32)
        count[some] = len(kinds)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(found.view(np.int64).ravel()))

    return rows.select("*", F.posexplode(seeds(letters)).alias("kind", "seed"))


def _bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (16 * max(n, 1) - 1).bit_length()))


def seed_bitmap(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """The bitmap of the column ``seed`` and the bits of its addresses."""
    size = _bits_for(seeds.agg(F.approx_count_distinct("seed")).first()[0])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - size)).astype(np.int64)
                word, first = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "bits"])

    found = seeds.select("seed").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out, size


def reference_pieces(refs: DataFrame, longest: int, chunk: int = CHUNK, walk: Walk | None = None, schema: str = "contig string, start long, seq string") -> DataFrame:
    """contig, start (from 0) and seq: pieces of (contig, seq) that overlap by ``longest`` - 1 letters; those of long contigs are dealt over all tasks.

    ``walk`` makes something else of the pieces, of ``schema``.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # null where the sequence is
            batch = batch.filter(pa.compute.less_equal(pa.compute.binary_length(batch.column(1)), chunk))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(batch), np.int64)), batch.column(1)], names=["contig", "start", "seq"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.greater(pa.compute.binary_length(batch.column(1)), chunk))
            for contig, seq in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = seq.as_py()
                for start in range(0, max(1, len(text)), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([contig], pa.string()), pa.array([start], pa.int64()), pa.array([text[start : start + chunk + longest - 1]])], names=["contig", "start", "seq"])

    # no filter in front: Spark would work out the sequences for it once more
    some = refs.select(F.col("contig").cast("string").alias("contig"), F.col("seq").cast("string").alias("seq"))
    long = some.mapInArrow(cut, "contig string, start long, seq string").repartition(F.col("contig"), F.col("start"))
    if walk is None:
        return some.mapInArrow(whole, schema).union(long)
    return some.mapInArrow(lambda batches: walk(whole(batches)), schema).union(long.mapInArrow(walk, schema))


PLACES = pa.schema([("contig", pa.string()), ("pos", pa.int32()), ("kind", pa.int32()), ("seed", pa.int64()), ("piece", pa.string())])


def seed_places(refs: DataFrame, kinds: list[Kind], seeds: DataFrame, least: int, longest: int, chunk: int = CHUNK) -> DataFrame:
    """contig, pos (from 0), kind, seed, piece: places of (contig, seq) that ``least`` letters follow and whose hash of a kind may be among ``seeds``.

    ``seeds`` are hashes as ``with_seeds`` gives them. ``piece`` holds up to ``longest`` letters from pos on. Null sequences have no places.
    """
    shared = refs.sparkSession.sparkContext.broadcast(seed_bitmap(seeds))

    def rows(letters: np.ndarray, contig: str, start: int, at: np.ndarray, kind: np.ndarray, seed: np.ndarray) -> pa.RecordBatch:
        size = np.minimum(longest, len(letters) - at)
        end = np.cumsum(size)
        text = letters[np.repeat(at - (end - size), size) + np.arange(end[-1])]
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], end]).astype(np.int32)), pa.py_buffer(text))
        return pa.RecordBatch.from_arrays([pa.array([contig] * len(at), pa.string()), pa.array((start + at).astype(np.int32)), pa.array(kind), pa.array(seed.view(np.int64)), pieces], schema=PLACES)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = shared.value
        for batch in batches:
            for contig, start, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = min(chunk, len(seq) - least + 1)
                if n <= 0:
                    continue
                letters = np.frombuffer(seq.encode("ascii", "replace"), np.uint8)
                for number, h in enumerate(seed_hashes(letters, kinds, n)):
                    at = (h >> np.uint64(64 - size)).astype(np.int64)
                    found = np.flatnonzero((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
                    for k in range(0, len(found), ROWS):
                        part = found[k : k + ROWS]
                        yield rows(letters, contig, start, part, np.full(len(part), number, np.int32), h[part])

    return reference_pieces(refs, longest, chunk, walk, "contig string, pos int, kind int, seed long, piece string")


def _kept(rows: DataFrame) -> DataFrame:
    use_checkpoints(rows.sparkSession)
    return rows.checkpoint(eager=True)


def _met(short: DataFrame, refs: DataFrame, kinds: list[Kind], least: int, longest: int, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``short`` (with kind and seed) at the places whose seeds they have."""
    places = _kept(seed_places(refs, kinds, short, least, longest, chunk))
    return salted_join(places, short, ["kind", "seed"]).drop("kind", "seed")


@F.arrow_udf(IntegerType())
def mismatches_of(read: pa.Array, piece: pa.Array) -> pa.Array:
    """Letters of ``read`` that differ from those ``piece`` begins with; null where that is shorter."""
    out = np.full(len(read), -1, np.int32)
    size = pa.compute.binary_length(read).to_numpy(zero_copy_only=False)
    fits = pa.compute.binary_length(piece).to_numpy(zero_copy_only=False) >= size
    for n in np.unique(size[fits]):
        some = np.flatnonzero(fits & (size == n))
        a, b = ("".join(x[:n] for x in c.take(pa.array(some)).to_pylist()).encode("ascii", "replace") for c in (read, piece))
        out[some] = (np.frombuffer(a, np.uint8).reshape(-1, n) != np.frombuffer(b, np.uint8).reshape(-1, n)).sum(1)
    return pa.array(out, mask=out < 0)


class Held:
    """Sequences and their seeds as a task looks them up: all are as long as the seeds' letters or longer."""

    def __init__(self, sequences: list[str], kinds: list[Kind], least: int, mismatches: int):
        self.kinds, self.least, self.mismatches = kinds, least, mismatches
        self.sizes = np.array([len(x) for x in sequences], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer("".join(sequences).encode("ascii", "replace"), np.uint8)
        first = self.letters[self.starts[:, None] + np.arange(least)]
        seeds = np.concatenate([h[:, 0] for h in seed_hashes(first, kinds, 1)])
        # sequences by the first bits of their seeds: what a bucket holds besides the seed looked up, the comparison refutes
        own = max(10, (4 * len(seeds) - 1).bit_length())
        self.shift = np.uint64(64 - own)
        bucket = (seeds >> self.shift).view(np.int64)
        self.members = (np.argsort(bucket, kind="stable") % len(sequences)).astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1 << own))]).astype(np.int32)
        self.short = packed(first, least)[:, 0] if least <= 32 else None
        # each kind has its own marks, so that those in use stay in a core's cache
        self.bits = min(26 - (len(kinds) - 1).bit_length(), max(12, (MARKS * len(sequences) - 1).bit_length()))
        self.marks = np.zeros((len(kinds), 1 << self.bits), bool)
        for marks, h in zip(self.marks, seeds.reshape(len(kinds), -1), strict=True):
            marks[(h >> np.uint64(64 - self.bits)).view(np.int64)] = True

    def _compared(self, letters: np.ndarray, room: np.ndarray, runs: np.ndarray | None, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Places, sequences and mismatches of those pairs that differ little enough, each pair as one number; ``room``: letters of the reference from each place on."""
        if runs is not None:
            # letters that differ in their bits are a lower bound
            differ = runs[at] ^ self.short[which]
            near = np.bitwise_count((differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)) <= self.mismatches
            at, which = at[near], which[near]
        near = room[at] >= self.sizes[which]
        at, which = at[near], which[near]
        size = self.sizes[which]
        end = np.cumsum(size)
        along = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)
        off = letters[np.repeat(at, size) + along] != self.letters[np.repeat(self.starts[which], size) + along]
        total = np.concatenate([[0], np.cumsum(off)])
        nm = total[end] - total[end - size]
        few = nm <= self.mismatches
        return (at[few] * len(self.sizes) + which[few]) * (self.mismatches + 1) + nm[few]

    def places(self, letters: np.ndarray, room: np.ndarray) -> Iterator[np.ndarray]:
        """Place, sequence and mismatches, each once, of all that is in ``letters``."""
        n = len(letters) - self.least + 1
        if n <= 0:
            return
        runs = packed(letters, self.least) if self.short is not None else None
        shift, found = np.uint64(64 - self.bits), []
        for marks, h in zip(self.marks, seed_hashes(letters, self.kinds, n), strict=True):
            maybe = np.flatnonzero(marks.take((h >> shift).view(np.int64)))
            k = (h[maybe] >> self.shift).view(np.int64)
            begin = self.begin[k]
            times = self.begin[k + 1] - begin
            until = np.cumsum(times, dtype=np.int64)
            first = 0
            while first < len(maybe):
                last = max(first + 1, int(np.searchsorted(until, until[first] - times[first] + PAIRS, side="right")))
                t = times[first:last]
                within = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                which = self.members[np.repeat(begin[first:last], t) + within]
                found.append(self._compared(letters, room, runs, np.repeat(maybe[first:last], t), which))
                first = last
        if found:
            pair, nm = np.divmod(np.unique(np.concatenate(found)), self.mismatches + 1)
            yield np.stack([*np.divmod(pair, len(self.sizes)), nm])


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of an ASCII string column and the bounds of its rows in them."""
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    letters = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return letters, bounds - bounds[0]


def _placed(rows: DataFrame, refs: DataFrame, least: int, longest: int, mismatches: int, chunk: int = CHUNK, most: int | None = None) -> DataFrame:
    """The strings ``rows``, of which ``kmer`` has ``least`` to ``longest`` letters, at all places (contig, pos from 0) where it has ``mismatches`` (nm) at most.

    Seeds of up to ``most`` are held by each task; more are joined.
    """
    kinds, names = mismatch_kinds(least, mismatches), rows.columns
    rows = _kept(rows)
    if rows.count() * len(kinds) > (MOST_SEEDS if most is None else most):
        met = _met(with_seeds(rows, "kmer", kinds, least), refs, kinds, least, longest, chunk)
        return met.withColumn("nm", mismatches_of("kmer", "piece")).where(F.col("nm") <= mismatches).select(*names, "contig", "pos", "nm").distinct()
    few = rows.toArrow().combine_chunks().to_batches()
    if not few:
        return rows.select("*", F.lit(None).cast("string").alias("contig"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("nm")).where("false")
    shared = refs.sparkSession.sparkContext.broadcast((few[0], Held(few[0].column(names.index("kmer")).to_pylist(), kinds, least, mismatches)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = shared.value
        for batch in batches:
            seqs = batch.column(2)
            letters, bounds = _texts(seqs)
            # a letter that is not ASCII is one place
            if len(letters) and letters.max() > 127:
                letters, bounds = _texts(pa.array([x.encode("ascii", "replace").decode() for x in seqs.to_pylist()]))
            starts = batch.column(1).to_numpy()
            for first in range(0, max(1, len(letters)), CHUNK):
                some = letters[first : first + CHUNK + longest - 1]
                row = np.searchsorted(bounds, np.arange(first, first + len(some)), side="right") - 1
                room = np.minimum(bounds[row + 1], first + len(some)) - np.arange(first, first + len(some))
                for at, which, nm in held.places(some, room):
                    own = row[at]
                    pos = first + at - bounds[own]
                    # what a piece shares with the next belongs to that one, and so do the letters that two walks share
                    keep = (pos < chunk) & (at < CHUNK)
                    at, which, nm, own, pos = (x[keep] for x in (at, which, nm, own, pos))
                    for k in range(0, len(at), ROWS):
                        s = slice(k, k + ROWS)
                        out = [c.take(pa.array(which[s])) for c in table.columns]
                        yield pa.RecordBatch.from_arrays([*out, batch.column(0).take(pa.array(own[s])), pa.array((starts[own[s]] + pos[s]).astype(np.int32)), pa.array(nm[s].astype(np.int32))], names=[*names, "contig", "pos", "nm"])

    return reference_pieces(refs, longest, chunk, walk, f"{', '.join(f'{n} string' for n in names)}, contig string, pos int, nm int")


def _both_strands(short: DataFrame, palindromes_once: bool) -> DataFrame:
    back = short.withColumn("kmer", reverse_complement(F.col("sequence"))).withColumn("direction", F.lit("-"))
    if palindromes_once:
        back = back.where("kmer <> sequence")
    return short.withColumn("kmer", F.col("sequence")).withColumn("direction", F.lit("+")).unionByName(back)


def exact_places(sequences: DataFrame, refs: DataFrame, size: int, longest: int | None = None) -> DataFrame:
    """All places of the distinct ``sequence``s of ``size`` to ``longest`` letters on either strand of the references; palindromes once, forward."""
    longest = longest or size
    some = sequences.select("sequence").where(F.char_length("sequence").between(size, longest)).distinct()
    found = _placed(_both_strands(some, True), refs, size, longest, 0)
    return found.select("sequence", "contig", (F.col("pos") + 1).alias("start_1based"), (F.col("pos") + F.char_length("kmer")).alias("end_1based"), "direction")


def exact_annotations(short: DataFrame, refs: DataFrame, size: int, longest: int | None = None) -> DataFrame:
    """``exact_places`` of (id, sequence). Shorter and longer sequences have no places. Rows that repeat an id and sequence repeat its places."""
    some = short.select("id", "sequence").where(F.char_length("sequence").between(size, longest or size))
    # a sequence of few letters has many places and may have many ids
    return salted_join(_kept(exact_places(some, refs, size, longest)), some, ["sequence"]).select("id", "sequence", "contig", "start_1based", "end_1based", "direction")


def not_found(short: DataFrame, refs: DataFrame, size: int) -> DataFrame:
    """Rows of (id, sequence) of ``size`` letters that no reference holds on its forward strand."""
    found = _placed(short.select(F.col("sequence").alias("kmer")).where(F.char_length("kmer") == size).distinct(), refs, size, size, 0).select(F.col("kmer").alias("sequence")).distinct()
    return short.join(found, "sequence", "left_anti").select("id", "sequence")


def ungapped_mapping(reads: DataFrame, refs: DataFrame, size: int, mismatches: int, longest: int | None = None, chunk: int = CHUNK, most: int | None = None) -> DataFrame:
    """All places of reads (sequence) of ``size`` to ``longest`` letters with ``mismatches`` at most, on both strands.

    The first ``size`` letters of a read are cut into parts, some of which match exactly together (``mismatch_kinds``): these are looked
    up in the references, and the whole read is compared. Other reads have no places. ``most``: see ``_placed``.
    """
    return _mapped(reads, refs, size, mismatches, longest, chunk, most).distinct()


def _mapped(reads: DataFrame, refs: DataFrame, size: int, mismatches: int, longest: int | None, chunk: int = CHUNK, most: int | None = None) -> DataFrame:
    """``ungapped_mapping``, where references of one name may repeat a place."""
    longest = longest or size
    both = _both_strands(reads.select("sequence").where(F.char_length("sequence").between(size, longest)).distinct(), False)
    found = _placed(both, refs, size, longest, mismatches, chunk, most)
    strand = F.when(F.col("direction") == "+", "sense").otherwise("antisense")
    return found.select("sequence", "contig", F.col("pos").alias("start0"), strand.alias("strand"), "nm")


def best_mapping(reads: DataFrame, refs: DataFrame, size: int, mismatches: int, longest: int | None = None, one: bool = False) -> DataFrame:
    """The places of each read with the fewest mismatches it has anywhere; with ``one`` only the first of them by contig, start0 and strand.

    Reads are mapped with no mismatch first, and only those without a place with one more, so a read's worse places are not even made.
    With ``one`` a row a read is stored, not its places.
    """
    left, parts = _kept(reads.select("sequence").distinct()), []
    for k in range(mismatches + 1):
        # those with fewer mismatches have been found before
        found = _mapped(left, refs, size, k, longest)
        if one:
            first = found.groupBy("sequence").agg(F.min(F.struct("contig", "start0", "strand", "nm")).alias("p"))
            found = first.select("sequence", "p.contig", "p.start0", "p.strand", "p.nm")
        found = _kept(found if one else found.distinct())
        parts.append(found)
        if k < mismatches:
            left = _kept(left.join(found.select("sequence").distinct(), "sequence", "left_anti"))
    return reduce(DataFrame.union, parts)


def first_of_duplicates(records: DataFrame) -> DataFrame:
    """(sequence, id, n) of distinct sequences: the first record by idx."""
    return records.groupBy("sequence").agg(F.min_by("id", "idx").alias("id"), F.min("idx").alias("idx"), F.count("*").alias("n"))


def contained(records: DataFrame, least: int, longest: int) -> DataFrame:
    """Distinct sequences (id, idx, sequence) that a longer one contains: the parent is of the shortest such length, the first by idx.

    Sequences have ``least`` letters or more, parents ``longest`` at most; ``idx`` is of any type that has an order.
    ``more_parents`` counts the other parents of that length.
    """
    inner = records.select(F.col("id").cast("string").alias("id"), "sequence", F.col("sequence").alias("kmer")).where(F.char_length("kmer") >= least)
    parents = records.where(F.char_length("sequence") > least).select(F.col("id").alias("contig"), F.col("sequence").alias("seq"), F.col("idx").alias("parent_idx"))
    hit = _placed(inner, parents, least, longest, 0).join(parents.select("contig", "parent_idx", F.char_length("seq").alias("parent_length")), "contig")
    hit = hit.where(F.col("parent_length") > F.char_length("sequence"))
    parent = hit.groupBy("id", "sequence", "parent_length", "parent_idx", F.col("contig").alias("parent_id")).agg(F.min("pos").alias("pos"))
    length = parent.groupBy("id", "sequence", "parent_length").agg(F.min(F.struct("parent_idx", "parent_id", "pos")).alias("p"), F.count("*").alias("n"))
    best = length.groupBy("id", "sequence").agg(F.min(F.struct("parent_length", "p", "n")).alias("b"))
    return best.select("id", "sequence", F.col("b.p.parent_id").alias("parent_id"), F.col("b.parent_length").alias("parent_length"), (F.col("b.p.pos") + 1).alias("start_1based"), (F.col("b.n") - 1).alias("more_parents"))


def collapsed(records: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """What is kept of (id, idx, sequence), and what goes with its reason and parent: repeats of a sequence, then sequences in longer ones."""
    first = records.groupBy("sequence").agg(F.min(F.struct("idx", "id")).alias("f"), F.count("*").alias("n"))
    again = records.join(first.where("n > 1").select("sequence", F.col("f.idx").alias("first_idx"), F.col("f.id").alias("parent_id")), "sequence").where(F.col("idx") != F.col("first_idx"))
    size = F.char_length("sequence")
    copies = again.select(F.col("id").alias("removed_id"), "sequence", F.lit("exact_duplicate").alias("removal_reason"), "parent_id", size.alias("parent_length"), F.lit(1).alias("start_1based"), F.lit(None).cast("long").alias("more_parents"))
    unique = first.select(F.col("f.id").alias("id"), F.col("f.idx").alias("idx"), "sequence")
    inner = contained(unique, least, longest)
    within = inner.select(F.col("id").alias("removed_id"), "sequence", F.lit("shorter_exact_substring").alias("removal_reason"), "parent_id", "parent_length", "start_1based", "more_parents")
    kept = unique.join(inner.select("id"), "id", "left_anti").select("id", "sequence")
    gone = copies.unionByName(within)
    return kept, gone.select("removed_id", "sequence", size.alias("removed_length"), "removal_reason", "parent_id", "parent_length", "start_1based", (F.col("start_1based") + size - 1).alias("end_1based"), "more_parents")


def collapse_summary(records: DataFrame, kept: DataFrame, gone: DataFrame) -> DataFrame:
    """(metric, value, detail): totals, and what came, stayed and went of each length."""
    size = F.char_length("sequence")
    each = records.select(size.alias("length"), F.lit("input").alias("kind")).unionByName(kept.select(size.alias("length"), F.lit("kept").alias("kind"))).unionByName(gone.select(F.col("removed_length").alias("length"), F.col("removal_reason").alias("kind")))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    per = each.groupBy("length").agg(*(count(k).alias(k) for k in ("input", "kept", "exact_duplicate", "shorter_exact_substring")))
    detail = F.format_string("input=%d; kept=%d; duplicate_removed=%d; shorter_contained_removed=%d", "input", "kept", "exact_duplicate", "shorter_exact_substring")
    total = per.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(n) for k, n in (("input", "input_records_after_other_filters"), ("kept", "kept_records_after_collapse"), ("exact_duplicate", "removed_exact_duplicate_records"), ("shorter_exact_substring", "removed_shorter_contained_records"))))
    lengths = per.select(F.lit("length_breakdown").alias("metric"), F.col("length").cast("long").alias("value"), detail.alias("detail"))
    return total.unpivot([], total.columns, "metric", "value").withColumn("detail", F.lit("")).unionByName(lengths)


def cluster_sizes(members: DataFrame) -> DataFrame:
    """cluster_no, size, members (joined by ``;`` in the order of idx) and the representative of (cluster_no, idx, member, is_representative).

    A cell holds a cluster's members, as the table does; ``cluster_counts`` does without.
    """
    listed = F.array_sort(F.collect_list(F.struct("idx", "member")))
    first = F.coalesce(F.min(F.when(F.col("is_representative"), F.struct("idx", "member"))), F.min(F.struct("idx", "member")))
    per = members.groupBy("cluster_no").agg(F.count("*").alias("size"), F.array_join(F.transform(listed, lambda x: x.member), ";").alias("members"), first.alias("first"))
    return per.select("cluster_no", "size", "members", F.col("first.member").alias("representative"))


def cluster_counts(members: DataFrame) -> DataFrame:
    """Each member with the size and the representative of its cluster, as rows."""
    per = members.groupBy("cluster_no").agg(F.count("*").alias("size"), F.coalesce(F.min(F.when(F.col("is_representative"), F.struct("idx", "member"))), F.min(F.struct("idx", "member"))).alias("first"))
    return members.join(per.select("cluster_no", "size", F.col("first.member").alias("representative")), "cluster_no")
