"""A genome screen by fixed bins: areas with shared weights, counters of a mapping, ranks, and reports with forced members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.alignments import UNIT, bin_area, in_reads
from strandlake.operators.ranking import numbered


def grouped_reads(aln: DataFrame, min_mapq: int = 0) -> DataFrame:
    """``aln`` (sample_id, qname, mapq and others) with group_valid, the rows of a read that reach ``min_mapq``, and first_valid, one of them.

    Like the readers of name-ordered files, but for rows in any order: all rows of a name are one read's.
    """
    read = Window.partitionBy("sample_id", "qname")
    valid = F.col("mapq") >= min_mapq
    first = F.row_number().over(read.orderBy(F.when(valid, 0).otherwise(1), *(c for c in aln.columns if c not in ("sample_id", "qname")))) == 1
    return aln.withColumn("group_valid", F.count_if(valid).over(read)).withColumn("first_valid", first & valid)


def counters(min_mapq: int = 0, most_secondary: int | None = None) -> dict[str, Column]:
    """Aggregates of rows with mapq, group_valid and first_valid; for ``observe``, so that they come with the pass that makes the bins, or ``agg``."""
    valid, one = F.coalesce(F.col("mapq") >= min_mapq, F.lit(False)), F.col("first_valid")
    out = {
        "low_mapq": F.count_if(~valid), "mapped_reads": F.count_if(one), "kept_alignments": F.count_if(valid),
        "max_valid_mappings_per_read": F.coalesce(F.max(F.when(valid, F.col("group_valid"))), F.lit(0)), "multimapped_reads": F.count_if(one & (F.col("group_valid") > 1)),
    }
    if most_secondary is not None:
        out["reads_at_secondary_cap"] = F.count_if(one & (F.col("group_valid") >= most_secondary + 1))
    return out


def screen_bins(rows: DataFrame, size: int, min_mapq: int = 0, shared: bool = True) -> DataFrame:
    """sample_id, contig, bin and the area of both strands, of rows with group_valid: each valid place weighs 1 / group_valid, or 1 if not ``shared``."""
    share = F.expr(f"({UNIT} + group_valid div 2) div group_valid") if shared else F.lit(UNIT)
    kept = rows.where((F.col("mapq") >= min_mapq) & (F.col("group_valid") > 0))
    area = bin_area(kept, size, share.cast("decimal(19,0)"), exact=True)
    side = lambda s: in_reads(F.coalesce(F.sum(F.when(F.col("strand") == s, F.col("area"))), F.lit(0)))
    return area.groupBy("sample_id", "contig", "bin").agg(side("sense").alias("sense_area"), side("antisense").alias("antisense_area"))




def overridden(rows: DataFrame, by: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of ``by`` in place of the ones that have the same keys."""
    return rows.join(by.select(*keys).distinct(), keys, "left_anti").unionByName(by)


def mean_bins(bins: DataFrame, samples: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """Scores of each bin from the mean of its CPM areas over all ``samples`` (sample_id, n_reads; a row a sample), 0 where one has none.

    lengths: (contig, length, description); bins of other contigs or behind their end are left out.
    """
    n = samples.count()
    cpm = bins.join(F.broadcast(samples.select("sample_id", "n_reads")), "sample_id")
    scale = F.lit(1e6) / F.col("n_reads") / n
    sums = cpm.groupBy("contig", "bin").agg(F.sum(F.col("sense_area") * scale).alias("s"), F.sum(F.col("antisense_area") * scale).alias("a"))
    first = F.col("bin") * size
    cut = sums.join(lengths, "contig").withColumn("nt", F.least(first + size, F.col("length")) - first).where("nt > 0")
    duplex, total = F.least("s", "a"), F.col("s") + F.col("a")
    balance, depth = F.when(total > 0, 200 * duplex / total).otherwise(0.0), duplex / F.col("nt")
    coverage = 100 * depth / (depth + 100)
    return cut.select(
        F.concat_ws("_", "contig", (first + 1).cast("string"), (first + F.col("nt")).cast("string")).alias("target_bin"), F.col("contig").alias("source_contig"), "description", (first + 1).alias("start_1based"), (first + F.col("nt")).alias("end_1based"), F.col("nt").alias("bin_length_nt"),
        F.col("s").alias("sense_area_cpm_bp"), F.col("a").alias("antisense_area_cpm_bp"), (F.col("s") / F.col("nt")).alias("sense_depth_cpm"), (F.col("a") / F.col("nt")).alias("antisense_depth_cpm"), depth.alias("duplex_depth_cpm"),
        balance.alias("strand_balance_percent"), coverage.alias("coverage_score_percent"), (balance * coverage / 100).alias("candidate_score_percent"),
    )


def ranked_candidates(scored: DataFrame) -> DataFrame:
    """All bins ranked by candidate score and duplex depth, ties by contig and place."""
    return numbered(scored, F.desc("candidate_score_percent"), F.desc("duplex_depth_cpm"), "source_contig", "start_1based")


def best_of_each(rows: DataFrame, keys: list[str], order: list[Column | str], n: int, forced: Column | None = None) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` (which should leave no ties), and its first row that is ``forced`` if it is not among them.

    Both are ranks within the group with a limit, so a task sends ``n`` rows of a group at most to where the group is ranked.
    """
    along = Window.partitionBy(*keys).orderBy(*order)
    head = rows.withColumn("_rank", F.row_number().over(along)).where(F.col("_rank") <= n).drop("_rank")
    if forced is None:
        return head
    first = rows.where(forced).withColumn("_rank", F.row_number().over(along)).where("_rank = 1").drop("_rank")
    return reduce(DataFrame.unionByName, [head, first]).distinct()
