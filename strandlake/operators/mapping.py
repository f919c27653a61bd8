"""Small-RNA mapping: reads on references as alignment rows, and the tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import export_name, low_complexity_reason, simple_sequence_reason
from strandlake.operators import axis
from strandlake.operators.matching import best_mapping, exact_places, ungapped_mapping
from strandlake.operators.ranking import use_checkpoints
from strandlake.operators.skew import salted_join

PLACE = ("contig", "start", "end", "strand", "sequence")


def passing_reads(reads: DataFrame, **limits: float) -> DataFrame:
    """Reads (sequence and others) that the complexity filter keeps, each judged where it stands: a shuffle of the reads costs more than to judge equal ones again."""
    return reads.where(low_complexity_reason(F.col("sequence"), **limits).isNull())


def filter_stats(reads: DataFrame, **limits: float) -> DataFrame:
    """metric, n: the reads there are, those that the complexity filter keeps, and those it takes for each reason; without reads an error."""
    per = reads.groupBy("sequence").agg(F.count("*").alias("n")).select("n", low_complexity_reason(F.col("sequence"), **limits).alias("reason")).groupBy("reason").agg(F.sum("n").alias("n"))  # a row a reason
    every = per.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("reason").isNull(), F.col("n"))).alias("kept"))
    total = F.when(F.col("n").isNull(), F.raise_error(F.lit("no reads"))).otherwise(F.col("n"))
    named = every.select(F.explode(F.array(F.struct(F.lit("original_reads").alias("metric"), total.alias("n")), F.struct(F.lit("reads_passing_complexity_filter").alias("metric"), F.coalesce("kept", F.lit(0)).alias("n")))).alias("x")).select("x.*")
    return named.unionByName(per.where("reason is not null").select(F.concat(F.lit("filtered_"), "reason").alias("metric"), "n"))


def mapped_reads(reads: DataFrame, refs: DataFrame, least: int, longest: int, mismatches: int = 0, report: str = "all") -> DataFrame:
    """Places of reads (sample_id, grp, sequence, copies) on both strands, with the sequence's simple reason, null if it has none.

    ``report``: all places with ``mismatches`` at most, the best of each sequence (those with the fewest), or one of the best, the first by contig, place and strand.
    Equal sequences are looked up once; ``copies`` are reads of one sequence in one sample. Palindromes without a mismatch have one place, forward, where all exact ones are asked for.
    """
    use_checkpoints(reads.sparkSession)
    # stored: a filter by the reason would else be worked out again for each place, which the join's key brings it to
    judged = reads.select("sequence").distinct().withColumn("reason", simple_sequence_reason(F.col("sequence"))).checkpoint(eager=True)
    seqs = judged.select("sequence")
    if mismatches == 0 and report == "all":
        exact = exact_places(seqs, refs, least, longest)
        places = exact.select("sequence", "contig", (F.col("start_1based") - 1).alias("start0"), F.when(F.col("direction") == "+", "sense").otherwise("antisense").alias("strand"), F.lit(0).alias("nm")).checkpoint(eager=True)
    elif report == "all":
        places = ungapped_mapping(seqs, refs, least, mismatches, longest).checkpoint(eager=True)
    else:
        places = best_mapping(seqs, refs, least, mismatches, longest, report == "one")
    size = F.char_length("sequence")
    # a sequence of few letters has many places
    return salted_join(places, reads.join(judged, "sequence"), ["sequence"]).select("sample_id", "grp", "contig", (F.col("start0") + 1).alias("start"), (F.col("start0") + size).alias("end"), size.alias("length"), "strand", F.col("nm").alias("mismatches"), "sequence", "copies", "reason")


def sample_summary(mapped: DataFrame, libraries: DataFrame, focus: int = 0) -> DataFrame:
    """Per sample: alignments mapped, filtered as simple, filtered by length, and retained."""
    simple = F.col("reason").isNotNull()
    off = ~simple & (F.col("length") != focus) if focus else F.lit(False)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("copies"))), F.lit(0))
    per = mapped.groupBy("sample_id").agg(n(F.lit(True)).alias("raw_mapped_alignments"), n(simple).alias("simple_filtered_alignments"), n(off).alias("focus_length_filtered_alignments"), n(~simple & ~off).alias("retained_alignments"))
    out = libraries.join(per, "sample_id", "left").na.fill(0)
    percent = F.when(F.col("raw_mapped_alignments") > 0, F.col("simple_filtered_alignments") * 100.0 / F.col("raw_mapped_alignments")).otherwise(0.0)
    return out.withColumn("simple_filtered_percent", percent)


def retained(mapped: DataFrame, libraries: DataFrame, focus: int = 0) -> DataFrame:
    """Alignments that no filter takes, each read with its share of a million reads of its sample (``libraries``: a row a sample)."""
    kept = mapped.where("reason is null").drop("reason")
    if focus:
        kept = kept.where(F.col("length") == focus)
    return kept.join(F.broadcast(libraries.select("sample_id", "n_reads")), "sample_id").withColumn("cpm", F.col("copies") * F.lit(1e6) / F.col("n_reads"))


def group_means(kept: DataFrame, libraries: DataFrame, least_cpm: float = 0.0) -> DataFrame:
    """Per group and place: the mean CPM over all samples of the group, those that have it, and the export name."""
    sizes = libraries.groupBy("grp").agg(F.count("*").alias("replicates"))  # a row a group
    per = kept.groupBy("grp", *PLACE, "mismatches").agg(F.sum("cpm").alias("_sum"), F.count_distinct("sample_id").alias("samples_present")).join(F.broadcast(sizes), "grp")
    mean = F.round(F.col("_sum") / F.col("replicates"), 6)
    out = per.withColumn("mean_cpm", mean).where(F.col("mean_cpm") >= least_cpm).drop("_sum")
    return out.withColumn("name", export_name(F.col("contig"), F.col("start"), F.char_length("sequence"), F.col("strand"), F.col("mismatches"), F.col("mean_cpm")))


def exported(kept: DataFrame, length: int = 0, most_mismatches: int | None = None) -> DataFrame:
    """Alignments of an export: of one read length if it is not 0, and with ``most_mismatches`` at most."""
    if length:
        kept = kept.where(F.col("length") == length)
    return kept if most_mismatches is None else kept.where(F.col("mismatches") <= most_mismatches)


def sample_counts(kept: DataFrame, libraries: DataFrame, least_cpm: float = 0.0) -> DataFrame:
    """Each sample's reads at each place, their CPM and its share of the sample's, with the mean of the place's group.

    Places whose group mean is under ``least_cpm`` are left out; the shares are of all that is kept.
    """
    key = ["grp", *PLACE, "mismatches"]
    per = kept.groupBy("sample_id", *key).agg(F.sum("copies").alias("raw_count"), F.sum("cpm").alias("cpm"))
    totals = kept.groupBy("sample_id").agg(F.sum("cpm").alias("_total"))  # a row a sample
    means = group_means(kept, libraries, least_cpm).select(*key, "name", "mean_cpm", "replicates", "samples_present")
    out = per.join(means, key).join(F.broadcast(totals), "sample_id")
    return out.withColumn("percent_of_sample", F.when(F.col("_total") > 0, F.col("cpm") * 100.0 / F.col("_total")).otherwise(0.0)).drop("_total")


def contig_summary(kept: DataFrame) -> DataFrame:
    """Per group and contig: mean and standard error of each strand's CPM over the samples present there, the places each strand covers, and the last place any read reaches."""
    side = lambda s: F.sum(F.when(F.col("strand") == s, F.col("cpm")).otherwise(0.0))
    per = kept.groupBy("grp", "contig", "sample_id").agg(side("sense").alias("sense"), side("antisense").alias("antisense"))
    sem = lambda c: F.coalesce(F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0))
    means = per.groupBy("grp", "contig").agg(F.count("*").alias("replicates"), *(f.alias(n) for c in ("sense", "antisense") for f, n in ((F.avg(c), f"{c}_mean"), (sem(c), f"{c}_sem"))), F.avg(F.col("sense") + F.col("antisense")).alias("total_mean"))
    lanes = axis.union_of(kept.select("grp", "contig", "strand", (F.col("start") - 1).alias("start0"), F.col("end").alias("end0")), ("grp", "contig", "strand"))
    places = lambda s: F.coalesce(F.sum(F.when(F.col("strand") == s, F.col("end0") - F.col("start0"))), F.lit(0)).cast("long")
    covered = lanes.groupBy("grp", "contig").agg(places("sense").alias("sense_covered"), places("antisense").alias("antisense_covered"))
    reached = kept.groupBy("contig").agg(F.max("end").alias("inferred_length"))
    return means.join(covered, ["grp", "contig"]).join(reached, "contig")


def length_distribution(mapped: DataFrame, libraries: DataFrame, focus: int = 0) -> DataFrame:
    """CPM by sample, length and strand, over all contigs before the focus filter (scope all), and of each contig after it (scope contig)."""
    kept = retained(mapped, libraries)
    key = ["sample_id", "length", "strand"]
    every = kept.groupBy(*key).agg(F.sum("cpm").alias("cpm")).select(*key, F.lit(None).cast("string").alias("contig"), "cpm", F.lit("all").alias("scope"))
    each = kept.where(F.col("length") == focus) if focus else kept
    return every.unionByName(each.groupBy(*key, "contig").agg(F.sum("cpm").alias("cpm")).withColumn("scope", F.lit("contig")))
