"""The control filter: short sequences against three sets of references, their complexity, and what stays clean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import complexity, cpm_from_name, name_strand
from strandlake.operators import axis
from strandlake.operators.alignments import best_stratum
from strandlake.operators.matching import exact_places, ungapped_mapping
from strandlake.operators.ranking import use_checkpoints
from strandlake.operators.skew import salted_join

KINDS = ("dsrna", "genome", "control")


def sequence_places(records: DataFrame, refs: DataFrame, least: int, longest: int) -> DataFrame:
    """kind and places of each distinct sequence of ``records`` in the references (kind, contig, seq), stored."""
    named = refs.select(F.concat_ws("|", "kind", "contig").alias("contig"), "seq")
    found = exact_places(records, named, least, longest)
    use_checkpoints(records.sparkSession)
    return found.select(F.substring_index("contig", "|", 1).alias("kind"), "sequence", F.expr("substring(contig, instr(contig, '|') + 1)").alias("contig"), "start_1based", "end_1based", "direction").checkpoint(eager=True)


def reference_places(records: DataFrame, refs: DataFrame, least: int, longest: int) -> DataFrame:
    """kind and places of (id, sequence) in the references (kind, contig, seq), each sequence looked up once for all its ids."""
    out = salted_join(sequence_places(records, refs, least, longest), records.select("id", "sequence"), ["sequence"])
    return out.select("kind", "id", "sequence", "contig", "start_1based", "end_1based", "direction")


def reference_cells(records: DataFrame, refs: DataFrame, least: int, longest: int, mismatches: int = 3, most: int = 50) -> DataFrame:
    """kind, id: the fewest mismatches that a record (id, sequence) has anywhere in the references of a kind, how many places have so many, their contigs and up to ``most`` places."""
    named = refs.select(F.concat_ws("|", "kind", "contig").alias("contig"), "seq")
    found = ungapped_mapping(records.select("sequence").distinct(), named, least, mismatches, longest)
    kind, contig = F.substring_index("contig", "|", 1), F.expr("substring(contig, instr(contig, '|') + 1)")
    use_checkpoints(records.sparkSession)
    places = found.select("sequence", kind.alias("kind"), contig.alias("contig"), "start0", (F.col("start0") + F.char_length("sequence")).alias("end0"), "strand", "nm").checkpoint(eager=True)
    # worse places go before any are listed
    least_nm = places.groupBy("kind", "sequence").agg(F.min("nm").alias("nm"))
    best = best_stratum(places.join(least_nm, ["kind", "sequence", "nm"], "left_semi"), most, ("kind", "sequence"))
    return records.select("id", "sequence").join(best, "sequence").select("kind", "id", F.col("nm").alias("best_mismatches"), "hits", "contigs", F.col("places").alias("locations"))


def control_summary(records: DataFrame, places: DataFrame, length_filter: int = 0) -> DataFrame:
    """A row a record (idx, id, sequence): its length, name's CPM, places and contigs of each kind, and complexity.

    Places (``sequence_places``) are rows of their own table, so no cell grows with a sequence's hits; records of one sequence share them.
    """
    use_checkpoints(records.sparkSession)
    # a row a contig first: distinct contigs of three kinds at once would take each place four times
    per = places.groupBy("sequence", "kind", "contig").agg(F.count("*").alias("n"))
    own = lambda k: F.col("kind") == k
    hits = per.groupBy("sequence").agg(*(x for k in KINDS for x in (F.coalesce(F.sum(F.when(own(k), F.col("n"))), F.lit(0)).alias(f"{k}_hits"), F.count_if(own(k)).alias(f"{k}_contigs"))))
    figures = complexity(F.col("sequence"))
    names = [f"{k}_{c}" for k in KINDS for c in ("hits", "contigs")]
    # stored: a filter by complexity would else be worked out again for each place, which the join's key brings it to
    judged = records.select("sequence").distinct().join(hits, "sequence", "left").na.fill(0, names).select("sequence", *names, *(figures[n].alias(n) for n in ("low_complexity", "complexity_flags"))).checkpoint(eager=True)
    size = F.char_length("sequence")
    return records.join(judged, "sequence").select(
        "idx", F.col("id").alias("srna_id"), "sequence", size.alias("length"), (size == length_filter if length_filter else F.lit(True)).alias("passes_length_filter"), F.round(cpm_from_name(F.col("id")), 6).alias("cpm_from_name"),
        *(x for k in KINDS for x in ((F.col(f"{k}_hits") > 0).alias(f"{k}_maps"), f"{k}_hits", f"{k}_contigs")), "low_complexity", "complexity_flags",
    )


def clean_records(summary: DataFrame, remove_low_complexity: bool = True, remove_control_mappers: bool = True) -> DataFrame:
    """(idx, id, sequence) of what passes the length, complexity and control filters."""
    kept = summary.where("passes_length_filter")
    if remove_low_complexity:
        kept = kept.where("not low_complexity")
    if remove_control_mappers:
        kept = kept.where("not genome_maps and not control_maps")
    return kept.select("idx", F.col("srna_id").alias("id"), "sequence")


def overview(summary: DataFrame, places: DataFrame) -> DataFrame:
    """Runs contig, strand, start0, end0 of the CPM that records (``control_summary``) put on the contigs of kind dsrna.

    A record's CPM, 1 if its name has none, is shared by its places on a contig (``cpm``), of which ``genome_cpm`` and ``control_cpm`` are those of
    records that also map there; ``whole_cpm`` gives each place the whole of it, as an overview does that draws a record once for each of its places.
    The strand is the one in the record's name, else that of its first place on the contig.
    """
    own = places.where("kind = 'dsrna'").select("sequence", "contig", (F.col("start_1based") - 1).alias("start0"), F.col("end_1based").alias("end0"), F.when(F.col("direction") == "+", "sense").otherwise("antisense").alias("side"))
    per = own.groupBy("sequence", "contig").agg(F.count("*").alias("n"), F.min(F.struct("start0", "end0", "side"))["side"].alias("first"))
    # what all records of a sequence put on each of its places is added up before any place is taken
    value = F.when(F.col("cpm_from_name") > 0, F.col("cpm_from_name")).otherwise(1.0)
    named = summary.groupBy("sequence", name_strand(F.col("srna_id"), F.lit(None).cast("string")).alias("named"), value.alias("v"), "genome_maps", "control_maps").agg(F.count("*").cast("decimal(12,0)").alias("ids"))
    share = F.round(F.col("v") / F.col("n"), 9).cast("decimal(24,9)") * F.col("ids")
    of = lambda c, some=F.lit(True): F.sum(F.when(some, c).otherwise(F.lit(0).cast("decimal(24,9)"))).cast("decimal(24,9)")
    whole = F.col("v").cast("decimal(24,9)") * F.col("ids")
    sums = per.join(named, "sequence").groupBy("sequence", "contig", F.coalesce("named", "first").alias("strand")).agg(of(share).alias("cpm"), of(share, F.col("genome_maps")).alias("genome_cpm"), of(share, F.col("control_maps")).alias("control_cpm"), of(whole).alias("whole_cpm"))
    names = ("cpm", "genome_cpm", "control_cpm", "whole_cpm")
    found = axis.runs(own.join(sums, ["sequence", "contig"]), ("contig", "strand"), {n: F.col(n) for n in names})
    return found.select("contig", "strand", "start0", "end0", *(F.col(n).cast("double").alias(n) for n in names))
