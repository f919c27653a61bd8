"""Operators on alignment rows: (sample_id, grp, qname, contig, start0, end0, strand, nm, mapq), half-open places from 0.

Coverage is never enumerated per read: each alignment adds its weight at its start and takes it away at its end, and
running sums, cut into ranges of a contig (``axis``), give the depth. Weights are whole numbers of 1 / ``UNIT``, so sums do not depend
on their order; the shares of a read at any number of places add up to it within that number of units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequences import aligned_blocks
from strandlake.operators import axis
from strandlake.operators.ranking import numbered

UNIT = 10**18
LANE = ("sample_id", "contig", "strand")
#: Rows of a part that one task sorts where a table may be large.
PART_ROWS = 2_000_000


def library_sizes(aln: DataFrame) -> DataFrame:
    return aln.groupBy("sample_id", "grp").agg(F.count("*").alias("n_reads"))


def weighted(aln: DataFrame, mode: str = "fractional", perfect: bool = True) -> DataFrame:
    """Perfect alignments (or all) with ``w``: a read's unit shared by its places, one for each, or one if it has a single place."""
    some = aln.where("nm = 0") if perfect else aln
    n = F.count("*").over(Window.partitionBy("sample_id", "qname"))
    # the nearest whole number of units
    share = F.expr(f"({UNIT} + n_places div 2) div n_places")
    w = {"fractional": share, "all": F.lit(UNIT), "unique": F.when(F.col("n_places") == 1, UNIT).otherwise(0)}[mode]
    return some.withColumn("n_places", n).withColumn("w", w.cast("decimal(19,0)"))


def in_reads(units: Column) -> Column:
    """A sum of weights as a number of reads."""
    return units.cast("double") / UNIT


def depth(rows: DataFrame, weight: Column | None = None, keys: tuple[str, ...] = LANE) -> DataFrame:
    """keys, pos, depth where the depth changes: the depth holds from pos to the next pos of the same keys."""
    w = F.lit(1).cast("long") if weight is None else weight
    return axis.levels(axis.steps(rows, keys, {"depth": w}), keys, ("depth",)).drop("stop")


def depth_runs(steps: DataFrame, keys: tuple[str, ...] = LANE) -> DataFrame:
    """The steps of ``depth`` as runs start0, end0, depth with depth > 0."""
    return axis.running(steps, keys, "pos", following="end0").where("depth > 0").select(*keys, F.col("pos").alias("start0"), "end0", "depth")


def hit_summary(aln: DataFrame, mode: str = "fractional") -> DataFrame:
    """Per sample and contig: weighted reads, peak depth and covered bases of each strand; contigs without reads are left out."""
    key = ("sample_id", "contig")
    rows = weighted(aln, mode).where("w > 0")
    side = lambda s: F.when(F.col("strand") == s, F.col("w")).otherwise(F.lit(0).cast("decimal(19,0)"))
    both = axis.runs(rows, key, {"sense": side("sense"), "antisense": side("antisense")})
    reads = rows.groupBy(*key).agg(in_reads(F.sum(side("sense"))).alias("sense_reads"), in_reads(F.sum(side("antisense"))).alias("antisense_reads"), in_reads(F.sum("w")).alias("total_reads"))
    peaks = both.groupBy(*key).agg(in_reads(F.max("sense")).alias("peak_sense"), in_reads(F.max("antisense")).alias("peak_antisense"), F.sum(F.col("end0") - F.col("start0")).cast("long").alias("covered_bases"))
    return reads.join(peaks, list(key))


def merge_intervals(rows: DataFrame, keys: tuple[str, ...], part_rows: int = 0) -> DataFrame:
    """Unions of intervals that overlap or touch, of keys with few intervals each, such as the blocks of a read pair; ``axis.union_of`` is for long axes.

    With ``part_rows`` the rows are counted and dealt over parts of about so many.
    """
    if part_rows:
        # parts grow in number, not in size: each is sorted and grouped in the memory of one task
        rows = rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // part_rows)), *keys)
    order = Window.partitionBy(*keys).orderBy("start0", "end0")
    before = F.max("end0").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col("start0") <= before, 0).otherwise(1)).withColumn("_block", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_block").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0")).drop("_block")


def bin_area(rows: DataFrame, size: int, weight: Column | None = None, keys: tuple[str, ...] = LANE, exact: bool = False) -> DataFrame:
    """keys, bin, area: the bases that rows put into bins of ``size``; an empty interval has none. ``exact`` leaves decimal weights decimal."""
    w = F.lit(1).cast("long") if weight is None else weight
    bins = F.sequence(F.expr(f"start0 div {size}").cast("int"), F.expr(f"(end0 - 1) div {size}").cast("int"))
    each = rows.where("end0 > start0").withColumn("bin", F.explode(bins))
    part = F.least("end0", (F.col("bin") + 1) * size) - F.greatest("start0", F.col("bin") * size)
    area = F.sum(part.cast("decimal(10,0)") * w) if exact else F.sum(part * w).cast("long")
    return each.groupBy(*keys, "bin").agg(area.alias("area"))


def strand_bins(aln: DataFrame, libraries: DataFrame, size: int, keys: tuple[str, ...]) -> DataFrame:
    """Mean CPM area of both strands of each bin over all samples (those without it count as 0)."""
    area = bin_area(aln, size).join(F.broadcast(libraries), "sample_id")
    n = F.lit(libraries.select("sample_id").distinct().count()).cast("double")
    cpm = F.col("area") * F.lit(1e6) / F.col("n_reads")
    side = lambda s: F.sum(F.when(F.col("strand") == s, cpm).otherwise(0.0)) / n
    return area.groupBy(*keys, "bin").agg(side("sense").alias("sense_area"), side("antisense").alias("antisense_area"))


def genome_bin_scores(bins: DataFrame, size: int) -> DataFrame:
    total, duplex = F.col("sense_area") + F.col("antisense_area"), F.least("sense_area", "antisense_area")
    out = bins.withColumn("duplex_depth", duplex / size).withColumn("balance", F.when(total > 0, 200 * duplex / total).otherwise(0.0))
    out = out.withColumn("coverage_score", 100 * F.col("duplex_depth") / (F.col("duplex_depth") + 100))
    return out.withColumn("candidate_score", F.col("balance") * F.col("coverage_score") / 100)


def prefix_windows(aln: DataFrame, length: int, width: int, step: int, keys: tuple[str, ...] = ("sample_id", "contig")) -> DataFrame:
    """Sums over sliding windows from prefix sums: s, a, duplex (least of both strands) and two_sided (bases with both strands)."""
    side = lambda name: F.when(F.col("strand") == name, 1).otherwise(0).cast("long")
    changes = axis.steps(aln, keys, {"s": side("sense"), "a": side("antisense")})
    levels = axis.levels(changes, keys, ("s", "a")).select(*keys, "pos", "s", "a", F.coalesce("stop", F.lit(length)).alias("stop"))
    starts = [w for w in range(0, max(length - width, 0) + 1, step)]
    width = min(width, length)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - width) / step).cast("int") + 1)
    last = F.least(F.lit(len(starts) - 1), F.expr(f"(stop - 1) div {step}").cast("int"))
    each = levels.where("stop > pos and (s > 0 or a > 0)").withColumn("_f", first).withColumn("_l", last).where("_f <= _l").withColumn("w", F.explode(F.sequence("_f", "_l")))
    part = (F.least("stop", F.col("w") * step + width) - F.greatest("pos", F.col("w") * step)).cast("long")
    sums = each.where(part > 0).groupBy(*keys, (F.col("w") * step).alias("start0")).agg(*(F.sum(part * x).cast("long").alias(n) for n, x in (("s", F.col("s")), ("a", F.col("a")), ("duplex", F.least("s", "a")), ("two_sided", F.when((F.col("s") > 0) & (F.col("a") > 0), 1).otherwise(0)))))
    return sums.withColumn("width", F.lit(width))


def window_scores(sums: DataFrame, scale: Column) -> DataFrame:
    n, total = F.col("width"), F.col("s") + F.col("a")
    out = sums.withColumn("balance", F.when(total > 0, 200.0 * F.col("duplex") / total).otherwise(0.0)).withColumn("bidirectional", 100.0 * F.col("two_sided") / n)
    out = out.withColumn("dsrnaness", F.col("balance") * F.sqrt(F.col("bidirectional") / 100))
    out = out.withColumn("mean_duplex", F.col("duplex") * scale / n).withColumn("mean_sense", F.col("s") * scale / n).withColumn("mean_antisense", F.col("a") * scale / n)
    return out.withColumn("score", F.col("mean_duplex") * F.col("dsrnaness") / 100)


def compared_windows(scored: DataFrame, reference: str, comparison: str, least: float, required: bool = True) -> DataFrame:
    """Reference windows ranked by their score and by how much less the comparison sample has."""
    key = ["contig", "start0"]
    other = scored.where(F.col("sample_id") == comparison).select(*key, *(F.col(c).alias(f"o_{c}") for c in ("mean_sense", "mean_antisense")))
    both = scored.where(F.col("sample_id") == reference).join(other, key, "left").na.fill(0.0, ["o_mean_sense", "o_mean_antisense"])
    less = [F.when(F.col(c) > 0, 1 - F.col(f"o_{c}") / F.col(c)).otherwise(0.0) for c in ("mean_sense", "mean_antisense")]
    both = both.withColumn("max_reduction", F.greatest(*less)).withColumn("passes", F.col("max_reduction") >= least)
    rank = F.col("score") * (1 + F.greatest(F.lit(0.0), F.col("max_reduction")))
    return both.withColumn("rank_score", F.when(F.lit(required) & ~F.col("passes"), 0.0).otherwise(rank)).where("duplex > 0 and dsrnaness > 0 and rank_score > 0")


def non_overlapping(ranked: DataFrame, most: float = 0.5) -> DataFrame:
    """Greedy choice of windows by rank_score within each contig; the overlap with what was kept is ``most`` at most.

    Windows that overlap no other do not touch each other's fate: the choice is made in runs of overlapping windows. Bound the
    candidates first, as ``best_windows`` does; a run that spans a contig is one task.
    """
    import bisect

    import pandas as pd

    along = Window.partitionBy("contig").orderBy("start0", "width")
    reach = F.max(F.col("start0") + F.col("width")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranked.withColumn("_new", F.when(F.col("start0") < reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank_score", "start0"], ascending=[False, True])
        widest = int(rows["width"].max())
        kept: list[tuple[int, int]] = []  # by start
        flags = []
        for s, n in zip(rows["start0"].tolist(), rows["width"].tolist(), strict=True):
            near = kept[bisect.bisect_left(kept, (s - widest, 0)) : bisect.bisect_left(kept, (s + n, 0))]
            flags.append(all(max(0, min(s + n, e) - max(s, b)) <= most * min(n, e - b) for b, e in near))
            if flags[-1]:
                bisect.insort(kept, (s, s + n))
        return rows[flags].drop(columns="_run")

    return marked.groupBy("contig", "_run").applyInPandas(choose, ranked.schema)


def best_windows(ranked: DataFrame, top: int = 100, buffer: int = 5_000, most: float = 0.5) -> DataFrame:
    """The report of the ``top`` windows, ranked: a greedy choice among the best ``buffer`` (limits that are the feature)."""
    some = ranked.orderBy(F.desc("rank_score"), "contig", "start0").limit(max(top, buffer))
    best = non_overlapping(some, most).orderBy(F.desc("rank_score"), "contig", "start0").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rank_score"), "contig", "start0")))  # ``top`` rows


def fragments(reads: DataFrame, min_mapq: int = 10, direction_source: str = "read1") -> DataFrame:
    """Merged blocks of read pairs: sample_id, qname, contig, strand, start0, end0.

    ``reads`` has flag, mapq, cigar, contig and start0. Secondary, supplementary and unmapped rows and those of a lower mapq go;
    a pair needs both mates, all on one contig. The strand is that of the named mate, of its row with the highest mapq.
    """
    source = 64 if direction_source == "read1" else 128
    usable = reads.where((F.col("flag").bitwiseAND(0x90C) == 0) & (F.col("mapq") >= min_mapq))
    has = lambda bit: F.col("flag").bitwiseAND(bit) != 0
    first = F.min(F.when(has(source), F.struct((-F.col("mapq")).alias("m"), "start0", "flag"))).alias("first")
    pair = usable.groupBy("sample_id", "qname").agg(F.bool_or(has(64)).alias("r1"), F.bool_or(has(128)).alias("r2"), F.min("contig").alias("lo"), F.max("contig").alias("hi"), first)
    pair = pair.where("r1 and r2 and lo = hi").select("sample_id", "qname", F.when(F.col("first.flag").bitwiseAND(16) != 0, "antisense").otherwise("sense").alias("strand"))
    each = usable.drop("strand").join(pair, ["sample_id", "qname"]).select("sample_id", "qname", "contig", "strand", F.explode(aligned_blocks(F.col("cigar"), F.col("start0"))).alias("b"))
    return merge_intervals(each.select("sample_id", "qname", "contig", "strand", "b.start0", "b.end0"), ("sample_id", "qname", "contig", "strand"))


def pair_stats(reads: DataFrame, merged: DataFrame) -> DataFrame:
    """Per sample: pairs used, by strand, and pairs with both mates that are not used."""
    key = ["sample_id", "qname"]
    has = lambda bit: F.bool_or(F.col("flag").bitwiseAND(bit) != 0)
    pairs = reads.where(F.col("flag").bitwiseAND(0x904) == 0).groupBy(*key).agg(has(64).alias("r1"), has(128).alias("r2")).where("r1 and r2")
    used = merged.select(*key, "strand").distinct()
    n = lambda s: F.count_if(F.col("strand") == s).alias(f"{s}_pairs")
    return pairs.join(used, key, "left").groupBy("sample_id").agg(F.count("strand").alias("collapsed_pairs"), n("sense"), n("antisense"), F.count_if(F.col("strand").isNull()).alias("discarded_pairs"))


def moving_average(aln: DataFrame, window: int, keys: tuple[str, ...], length: int) -> DataFrame:
    """The depth's sums over ``window`` places around each, zero outside, as pieces (``axis.moving_sums``); divide by ``window`` for the mean."""
    return axis.moving_sums(axis.steps(aln, keys, {"window_sum": F.lit(1).cast("long")}), keys, ("window_sum",), window, F.lit(length))


def at_places(pieces: DataFrame, lanes: DataFrame, keys: tuple[str, ...], length: int, name: str) -> DataFrame:
    """keys, pos and ``name`` at each of ``length`` places of all ``lanes``, from the evenly changing ``pieces`` of ``moving_average``; 0 outside them."""
    each = pieces.withColumn("pos", F.explode(F.sequence("start0", F.col("end0") - 1))).select(*keys, F.col("pos").cast("int").alias("pos"), (F.col(name) + F.col(f"{name}_slope") * (F.col("pos") - F.col("start0"))).alias(name))
    every = lanes.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return every.join(each, [*keys, "pos"], "left").na.fill(0, [name])


def smoothed_contigs(aln: DataFrame, samples: DataFrame, lengths: DataFrame, window: int = 25) -> DataFrame:
    """Per group and contig: the means over all places of the smoothed mean CPM of both strands and of the lesser of the two, and their balance.

    samples: (sample_id, grp, n_reads), a row a sample; means are over all samples of a group. lengths: (contig, length).
    Sums over places come from evenly changing pieces, so no place is enumerated. A contig without depth has no row.
    """
    key = ("grp", "contig")
    sizes = samples.groupBy("grp").agg(F.count("*").alias("_n"))  # a row a group
    share = F.broadcast(samples.join(sizes, "grp").select("sample_id", (F.lit(1e6) / F.col("n_reads") / F.col("_n") / window).alias("_cpm")))
    side = lambda s: F.when(F.col("strand") == s, F.col("_cpm")).otherwise(F.lit(0.0))
    changes = axis.steps(aln.join(share, "sample_id"), key, {"sense": side("sense"), "antisense": side("antisense")})
    everywhere = axis.moving_sums(changes, key, ("sense", "antisense"), window, F.lit(1 << 40))
    pieces = everywhere.join(lengths, "contig").withColumn("end0", F.least("end0", "length")).where("end0 > start0")
    n = F.col("end0") - F.col("start0")
    total = lambda c: F.sum(axis.even_sum(F.col(c), F.col(f"{c}_slope"), n))
    least = F.sum(axis.least_sum(F.col("sense"), F.col("sense_slope"), F.col("antisense"), F.col("antisense_slope"), n))
    sums = pieces.groupBy(*key, "length").agg(total("sense").alias("_s"), total("antisense").alias("_a"), least.alias("_d"))
    out = sums.withColumn("balance", F.when(F.col("_s") + F.col("_a") > 0, 200 * F.col("_d") / (F.col("_s") + F.col("_a"))).otherwise(0.0))
    return out.select(*key, "length", *((F.col(c) / F.col("length")).alias(name) for c, name in (("_s", "mean_sense"), ("_a", "mean_antisense"), ("_d", "mean_duplex"))), "balance")


def group_tracks(assays: dict[str, DataFrame], samples: DataFrame) -> DataFrame:
    """The mean CPM of each group (over all its samples, 0 where one has none) of several assays on common breakpoints.

    assays: intervals (sample_id, contig, strand, start0, end0) by name; samples: (sample_id, grp, n_reads), a row a sample. The result has contig, grp,
    start0, end0 and for each assay its sense and antisense value (``axis.overlay``); places where all are zero are left out.
    """
    key = ("contig", "grp")
    sizes = samples.groupBy("grp").agg(F.count("*").alias("_k"))
    share = F.broadcast(samples.join(sizes, "grp").select("sample_id", "grp", F.round(F.lit(1e6) / F.col("n_reads") / F.col("_k"), 9).cast("decimal(24,9)").alias("value")))
    side = {}
    for name, rows in assays.items():
        valued = rows.select("sample_id", "contig", "strand", "start0", "end0").join(share, "sample_id")
        side |= {f"{name}_{s}": valued.where(F.col("strand") == s) for s in ("sense", "antisense")}
    return axis.overlay(side, key)


def proper_pairs(aln: DataFrame) -> DataFrame:
    """Read names both of whose mates have an alignment, all on one contig."""
    g = aln.groupBy("sample_id", "qname").agg(F.bool_or(F.col("mate") == 1).alias("r1"), F.bool_or(F.col("mate") == 0).alias("r2"), F.min("contig").alias("lo"), F.max("contig").alias("hi"))
    return g.where("r1 and r2 and lo = hi").select("sample_id", "qname", F.col("lo").alias("contig"))


def best_mismatches(aln: DataFrame) -> DataFrame:
    """Per sample and k: reads whose best alignment has k mismatches, and k at most."""
    best = aln.groupBy("sample_id", "qname").agg(F.min("nm").alias("nm")).groupBy("sample_id", "nm").agg(F.count("*").alias("reads"))
    return best.withColumn("reads_le", F.sum("reads").over(Window.partitionBy("sample_id").orderBy("nm")))


def contig_group_summary(aln: DataFrame, libraries: DataFrame) -> DataFrame:
    """Mean and standard error of CPM over the samples present on each contig, and places covered by either."""
    key = ["grp", "contig"]
    per = aln.groupBy("sample_id", *key, "strand").agg(F.count("*").alias("n")).join(F.broadcast(libraries.select("sample_id", "n_reads")), "sample_id")
    side = lambda s: F.sum(F.when(F.col("strand") == s, F.col("n")).otherwise(0)) * F.lit(1e6) / F.first("n_reads")
    sample = per.groupBy("sample_id", *key).agg(side("sense").alias("sense"), side("antisense").alias("antisense"))
    sem = lambda c: F.coalesce(F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0))
    means = sample.groupBy(*key).agg(F.count("*").alias("replicates"), *(f.alias(n) for c in ("sense", "antisense") for f, n in ((F.avg(c), f"{c}_mean"), (sem(c), f"{c}_sem"))))
    merged = axis.union_of(aln.select(*key, "strand", "start0", "end0"), (*key, "strand"))
    covered = merged.groupBy(*key).agg(*(F.coalesce(F.sum(F.when(F.col("strand") == s, F.col("end0") - F.col("start0"))), F.lit(0)).cast("long").alias(f"{s}_covered") for s in ("sense", "antisense")))
    return means.join(covered, key)


def best_stratum(aln: DataFrame, most: int = 50, keys: tuple[str, ...] = ("sample_id", "qname")) -> DataFrame:
    """Per read: the least mismatches, up to ``most`` places that have them (a limit that is the feature), and their contigs.

    Places are ranked before they are listed, so a task keeps ``most`` of a read at most.
    """
    order = Window.partitionBy(*keys).orderBy("nm", "contig", "start0", "end0", "strand")
    first = aln.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    text = F.concat("contig", F.lit(":"), (F.col("start0") + 1).cast("string"), F.lit("-"), F.col("end0").cast("string"), F.lit(":"), "strand", F.lit(":"), F.col("nm").cast("string"))
    listed = first.groupBy(*keys, "nm").agg(F.array_sort(F.collect_list(F.struct("_r", text.alias("t")))).alias("p"))
    best = listed.groupBy(*keys).agg(F.min("nm").alias("nm"), F.min_by("p", "nm").alias("p"))
    contigs = aln.groupBy(*keys, "nm").agg(F.collect_set("contig").alias("c"), F.count("*").alias("hits")).groupBy(*keys).agg(F.min_by(F.struct("c", "hits"), "nm").alias("x"))
    return best.join(contigs, list(keys)).select(*keys, "nm", F.array_join(F.array_sort("x.c"), ";").alias("contigs"), F.array_join(F.transform("p", lambda x: x.t), ";").alias("places"), F.col("x.hits").alias("hits"))


def ranked_bins(aln: DataFrame, libraries: DataFrame, size: int, length: int, around: int) -> DataFrame:
    """All bins of a scoring group (the samples of ``libraries``) with a depth, ranked by product, duplex and total depth, with their context."""
    bins = strand_bins(aln.join(F.broadcast(libraries.select("sample_id")), "sample_id"), libraries, size, ("contig",))
    bins = bins.withColumn("bin_length", F.least(F.lit(size), length - F.col("bin") * size)).where("bin_length > 0 and sense_area + antisense_area > 0")
    s, a = F.round("sense_area", 4), F.round("antisense_area", 4)
    bins = bins.withColumn("sense_area", s).withColumn("antisense_area", a)
    n, first = F.col("bin_length"), F.col("bin") * size
    duplex, total = F.least("sense_area", "antisense_area"), F.col("sense_area") + F.col("antisense_area")
    out = bins.withColumn("product_score", F.round(F.col("sense_area") * F.col("antisense_area"), 3)).withColumn("duplex_depth", F.round(duplex / n, 6)).withColumn("total_depth", F.round(total / n, 6))
    out = out.withColumn("balance", F.round(200.0 * duplex / total, 6)).withColumn("replicates", F.lit(libraries.count()))  # a row a sample
    out = out.withColumn("target_bin", F.concat_ws("_", "contig", (first + 1).cast("string"), (first + n).cast("string")))
    out = out.withColumn("context_start_1based", F.greatest(F.lit(0), first - around) + 1).withColumn("context_end_1based", F.least(F.lit(length), first + n + around))
    return numbered(out, F.desc("product_score"), F.desc("duplex_depth"), F.desc("total_depth"), "contig", "bin")


def vector_mean(rows: DataFrame, samples: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Mean and standard error of ``value`` over all ``samples`` at each place; a sample without a row has 0. One sample has no error."""
    n = samples.count()  # a row a sample
    mean = F.sum(value) / n
    spread = F.greatest(F.lit(0.0), (F.sum(F.col(value) * F.col(value)).cast("double") - n * mean * mean) / (n - 1)) if n > 1 else F.lit(None)
    return rows.groupBy(*keys).agg(F.round(mean, 4).alias(f"mean_{value}"), F.round(F.sqrt(spread / n), 3).alias(f"sem_{value}"))


def replicate_numbers(samples: DataFrame, group: str, order: str) -> DataFrame:
    """Running numbers within each group of a sample sheet."""
    return samples.withColumn("replicate", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def on_contexts(aln: DataFrame, loci: DataFrame) -> DataFrame:
    """Alignments cut to the contexts of a report (target_bin, contig, cs, ce) and placed from their start, with target_bin as contig.

    The report bounds the contexts; an alignment in several comes once for each.
    """
    both = aln.join(F.broadcast(loci.select("target_bin", "contig", "cs", "ce")), "contig").where("start0 < ce and end0 > cs")
    cut = both.withColumn("start0", F.greatest("start0", "cs") - F.col("cs")).withColumn("end0", F.least("end0", "ce") - F.col("cs"))
    return cut.withColumn("contig", F.col("target_bin")).drop("target_bin", "cs", "ce")


def contexts(top: DataFrame, refs: DataFrame, size: int, around: int) -> DataFrame:
    """The letters of a report's bins (contig, bin) with ``around`` letters on both sides; a contig that is not there raises an error."""
    found = refs.join(F.broadcast(top.select("contig").distinct()), "contig", "left_semi")
    rows = top.join(found, "contig", "left")
    seq = F.coalesce("seq", F.raise_error(F.concat(F.lit("no sequence of "), "contig")))
    first, last = F.greatest(F.lit(0), F.col("bin") * size - around) + 1, F.least(F.char_length(seq), (F.col("bin") + 1) * size + around)
    return rows.select("contig", "bin", first.alias("context_start"), last.alias("context_end"), F.substring(seq, first, last - first + 1).alias("sequence"))
