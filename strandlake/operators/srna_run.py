"""Small-RNA reads of samples against template contigs and a control, as one job with its result tables.

Every stage works on distinct sequences: their places are found once, flags of a sequence (best mismatches, perfect places, complexity) are
kept in one stored table, and reads take part as copies of a sequence in a sample. So no table grows with reads and places at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequences import low_complexity_reason
from strandlake.operators import axis
from strandlake.operators.alignments import UNIT, in_reads
from strandlake.operators.matching import ungapped_mapping
from strandlake.operators.ranking import use_checkpoints


@dataclass(frozen=True)
class Settings:
    """Mismatches against template and control, the rule for reads with several perfect places (fractional, all, unique), where simple
    reads are filtered (mapped, pre), and whether only reads with a perfect template place are mapped to the control. Reads have ``shortest`` to
    ``longest`` letters; others have no places. ``top`` contigs have a coverage table."""

    mismatches: int = 3
    control_mismatches: int = 3
    multi_hit_mode: str = "fractional"
    filter_stage: str = "mapped"
    control_from_perfect: bool = False
    shortest: int = 18
    longest: int = 30
    top: int = 100


def _kept(rows: DataFrame) -> DataFrame:
    use_checkpoints(rows.sparkSession)
    return rows.checkpoint(eager=True)


def long_counts(rows: DataFrame, of: dict[str, Column], *keys: str) -> DataFrame:
    """keys, metric, value of named aggregates of ``rows``; zeros are left out."""
    wide = rows.groupBy(*keys).agg(*(F.coalesce(c, F.lit(0)).cast("double").alias(n) for n, c in of.items()))
    return wide.unpivot(list(keys), list(of), "metric", "value").where("value <> 0")


def best_strata(counted: DataFrame, totals: DataFrame, target: str, mismatches: int) -> DataFrame:
    """sample_id, target, category, reads, percent_of_denominator, denominator_reads: mapped_total, unmapped, and best_nm_k and best_nm_le_k for each k.

    counted: (sample_id, best_nm, copies) of the reads mapped; totals: (sample_id, n_reads), all reads asked for. unmapped is what the
    two differ by.
    """
    per = counted.groupBy("sample_id").agg(*(F.coalesce(F.sum(F.when(F.col("best_nm") == k, F.col("copies"))), F.lit(0)).alias(f"nm{k}") for k in range(mismatches + 1)), F.sum("copies").alias("mapped"))
    rows = totals.join(per, "sample_id", "left").na.fill(0)
    upto = [reduce(lambda a, b: a + b, (F.col(f"nm{j}") for j in range(k + 1))) for k in range(mismatches + 1)]
    cells = {"mapped_total": F.col("mapped"), "unmapped": F.col("n_reads") - F.col("mapped")} | {f"best_nm_{k}": F.col(f"nm{k}") for k in range(mismatches + 1)} | {f"best_nm_le_{k}": upto[k] for k in range(mismatches + 1)}
    long = rows.select("sample_id", "n_reads", F.explode(F.array(*(F.struct(F.lit(n).alias("category"), c.alias("reads")) for n, c in cells.items()))).alias("x"))
    percent = F.when(F.col("n_reads") > 0, F.col("x.reads") * 100.0 / F.col("n_reads")).otherwise(0.0)
    return long.select("sample_id", F.lit(target).alias("target"), "x.category", "x.reads", percent.alias("percent_of_denominator"), F.col("n_reads").alias("denominator_reads"))


#: The tables of a run.
TABLES = ("filter_stats", "mismatch_summary", "analysis_stats", "hits", "top_hits", "top_coverage")


def run(reads: DataFrame, template: DataFrame, control: DataFrame | None = None, settings: Settings | None = None, tables: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The ``tables`` (others are not worked out) of a run over reads (sample_id, sequence; one row a read), template and control (contig, seq; contigs may have a ``description``).

    filter_stats: reads by what the complexity filter says (stage pre), or how many there are. mismatch_summary: see ``best_strata``, for
    template and control. analysis_stats: counters (sample_id, metric, value). hits: the perfect places of reads that pass, a row a sample and
    contig, ranked by total CPM, then the sum of both peaks, then contig. top_coverage: runs of the CPM of both strands of the first ``top`` contigs.
    """
    s = settings or Settings()
    rna = F.replace(F.upper("sequence"), F.lit("U"), F.lit("T"))
    copies = _kept(reads.select("sample_id", rna.alias("sequence")).groupBy("sample_id", "sequence").agg(F.count("*").alias("copies")))
    totals = _kept(copies.groupBy("sample_id").agg(F.sum("copies").alias("n_reads")))  # a row a sample
    sequences = copies.select("sequence").distinct()
    if s.filter_stage == "pre":
        judged = _kept(sequences.withColumn("reason", low_complexity_reason(F.col("sequence"), s.shortest, s.longest)))
        per = copies.join(judged, "sequence").groupBy("sample_id", "reason").agg(F.sum("copies").cast("double").alias("value"))
        named = F.when(F.col("reason").isNull(), "reads_passing_complexity_filter").otherwise(F.concat(F.lit("filtered_"), "reason"))
        filter_stats = per.select("sample_id", named.alias("metric"), "value").unionByName(totals.select("sample_id", F.lit("original_reads").alias("metric"), F.col("n_reads").cast("double").alias("value")))
        sequences = judged.where("reason is null").select("sequence")
    else:
        filter_stats = totals.select("sample_id", F.lit("original_reads").alias("metric"), F.col("n_reads").cast("double").alias("value"))

    if set(tables) <= {"filter_stats"}:
        return {"filter_stats": filter_stats}
    places = _kept(ungapped_mapping(sequences, template.select("contig", "seq"), s.shortest, s.mismatches, s.longest))
    figures = places.groupBy("sequence").agg(F.min("nm").alias("best_nm"), F.count("*").alias("records"), F.count_if(F.col("nm") == 0).alias("perfect"))
    flags = _kept(figures.withColumn("reason", low_complexity_reason(F.col("sequence"), s.shortest, s.longest)))
    mapped = _kept(copies.join(flags, "sequence"))
    passing = F.col("reason").isNull()
    counted_once = F.col("perfect") == 1 if s.multi_hit_mode == "unique" else F.col("perfect") > 0
    each = lambda c, by="copies": F.sum(F.when(c, F.expr(by)))
    weight = "copies" if s.multi_hit_mode != "all" else "copies * perfect"
    stats = long_counts(
        mapped,
        {
            "sam_mapped_records_up_to_mismatch_limit": F.sum(F.col("copies") * F.col("records")),
            "template_mapped_reads_before_complexity_filter": F.sum("copies"),
            "template_mapped_reads_passing_complexity_filter": each(passing),
            "reads_with_perfect_alignment": each(passing & (F.col("perfect") > 0)),
            "perfect_multimapper_reads_suppressed": each(passing & (F.col("perfect") > 1) & F.lit(s.multi_hit_mode == "unique")),
            "perfect_alignments_counted": each(passing & counted_once, weight),
        },
        "sample_id",
    )
    reasons = mapped.where(~passing).groupBy("sample_id", F.concat(F.lit("mapped_filtered_"), "reason").alias("metric")).agg(F.sum("copies").cast("double").alias("value"))
    summary = best_strata(mapped, totals, "template", s.mismatches)
    stats = filter_stats.unionByName(stats).unionByName(reasons)

    counted = bool({"mismatch_summary", "analysis_stats"} & set(tables))
    if control is not None and counted:
        asked = mapped.where(passing & (F.col("perfect") > 0)) if s.control_from_perfect else mapped.where(passing)
        asked = _kept(asked.select("sample_id", "sequence", "copies"))
        best = ungapped_mapping(asked.select("sequence").distinct(), control.select("contig", "seq"), s.shortest, s.control_mismatches, s.longest).groupBy("sequence").agg(F.min("nm").alias("best_nm"))
        held = _kept(asked.join(best, "sequence"))
        given = asked.groupBy("sample_id").agg(F.sum("copies").alias("n_reads"))
        summary = summary.unionByName(best_strata(held, given, "control", s.control_mismatches))
        found = given.join(held.groupBy("sample_id").agg(F.sum("copies").alias("hit")), "sample_id", "left").na.fill(0)
        stats = stats.unionByName(long_counts(found, {"template_mapped_reads_for_control": F.sum("n_reads"), "control_mapped_reads": F.sum("hit"), "control_mapped_percent_of_template_mapped": F.sum("hit") * 100.0 / F.sum("n_reads")}, "sample_id"))

    done = {"filter_stats": filter_stats, "mismatch_summary": summary, "analysis_stats": stats}
    if not {"hits", "top_hits", "top_coverage"} & set(tables):
        return {n: done[n] for n in tables}
    share = {"fractional": F.expr(f"({UNIT} + perfect div 2) div perfect"), "all": F.lit(UNIT), "unique": F.when(F.col("perfect") == 1, UNIT)}[s.multi_hit_mode]
    units = mapped.where(passing & counted_once).select("sample_id", "sequence", (share.cast("decimal(19,0)") * F.col("copies").cast("decimal(12,0)")).alias("w"))
    lengths = template.select("contig", F.char_length("seq").alias("length"), (F.col("description") if "description" in template.columns else F.col("contig")).alias("description"))
    perfect = places.where("nm = 0").select("sequence", "contig", "start0", "strand", (F.col("start0") + F.char_length("sequence")).alias("end0"))
    placed = _kept(units.join(perfect, "sequence").select("sample_id", "contig", "strand", "start0", "end0", "w"))
    side = lambda name: F.when(F.col("strand") == name, F.col("w")).otherwise(F.lit(0).cast("decimal(31,0)"))
    key = ("sample_id", "contig")
    runs = _kept(axis.runs(placed, key, {"sense": side("sense"), "antisense": side("antisense")}))
    sums = placed.groupBy(*key).agg(in_reads(F.sum(side("sense"))).alias("sense"), in_reads(F.sum(side("antisense"))).alias("antisense"), in_reads(F.sum("w")).alias("total"))
    peaks = runs.groupBy(*key).agg(in_reads(F.max("sense")).alias("peak_sense"), in_reads(F.max("antisense")).alias("peak_antisense"), F.sum(F.col("end0") - F.col("start0")).cast("long").alias("covered_bases"))
    scale = F.lit(1e6) / F.col("n_reads")
    hits = sums.join(peaks, list(key)).join(F.broadcast(totals), "sample_id").join(lengths, "contig").select(
        *key, "description", "length", *(F.col(c).alias(f"{c}_perfect_reads_weighted") for c in ("sense", "antisense", "total")), *((F.col(c) * scale).alias(f"{c}_cpm") for c in ("sense", "antisense", "total", "peak_sense", "peak_antisense")), "covered_bases",
    )
    # sums of shares differ in the last digit by the order of adding: ranks are by what a report shows
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.round("total_cpm", 6)), F.desc(F.round(F.col("peak_sense_cpm") + F.col("peak_antisense_cpm"), 6)), "contig")
    hits = _kept(hits)
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top)  # a row limit: only the first of each task are sorted together
    coverage = runs.join(F.broadcast(top.select(*key, "rank")), list(key)).join(F.broadcast(totals), "sample_id")
    coverage = coverage.select(*key, "rank", "start0", "end0", (in_reads(F.col("sense")) * scale).alias("sense_cpm"), (in_reads(F.col("antisense")) * scale).alias("antisense_cpm"))
    done |= {"hits": hits, "top_hits": top, "top_coverage": coverage}
    return {n: done[n] for n in tables}


def selected_reads(records: DataFrame, names: DataFrame, mapped: str = "qname") -> DataFrame:
    """Records (name and others) whose name up to the first space is among the column ``mapped`` of ``names``."""
    return records.join(names.select(F.col(mapped).alias("_name")).distinct(), F.substring_index("name", " ", 1) == F.col("_name"), "left_semi")
