"""Hand-computed cases of functions, readers and operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators import alignments as A
from strandlake.operators import evidence as E
from strandlake.operators import matching as M
from strandlake.sources import readers as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sequence_functions(spark):
    assert one(spark, S.reverse_complement(F.lit("AACGTN"))) == "NACGTT"
    assert one(spark, S.repeated_unit(F.lit("ATATAT"))) == "AT"
    assert one(spark, S.repeated_unit(F.lit("ATATA"))) == ""
    assert one(spark, S.repeated_unit(F.lit("AAAA"))) == "A"
    assert one(spark, S.cigar_reference_length(F.lit("10M2D3S5N1=1X"), F.lit(""))) == 19
    assert one(spark, S.md_mismatches(F.lit("10A5^AC6"))) == 1
    assert one(spark, S.cpm_from_name(F.lit("x_1/2CPM"))) == 0.5
    assert one(spark, S.cpm_from_name(F.lit("x_1/2CPM"), False)) == 0.0
    assert abs(one(spark, S.binomial_at_least_one(F.lit(5), F.lit(0.1))) - 0.40951) < 1e-9
    assert one(spark, S.normalize_rna(F.lit("ac gt"))) == "ACGU"
    assert one(spark, S.normalize_rna(F.lit("acx"))) is None


def test_merge_and_weights(spark):
    rows = spark.createDataFrame([("s", "c", 1, 5), ("s", "c", 5, 8), ("s", "c", 10, 12)], "sample_id string, contig string, start0 int, end0 int")
    assert sorted((r.start0, r.end0) for r in A.merge_intervals(rows, ("sample_id", "contig")).collect()) == [(1, 8), (10, 12)]
    aln = spark.createDataFrame([("s", "g", "r1", "c", 0, 5, "sense", 0), ("s", "g", "r1", "c", 10, 15, "antisense", 0), ("s", "g", "r2", "c", 2, 7, "sense", 0), ("s", "g", "r3", "c", 2, 7, "sense", 1)], "sample_id string, grp string, qname string, contig string, start0 int, end0 int, strand string, nm int")
    r = A.hit_summary(aln).first()
    assert (r.sense_reads, r.antisense_reads, r.total_reads, r.peak_sense, r.peak_antisense, r.covered_bases) == (1.5, 0.5, 2.0, 1.5, 0.5, 12)
    unique = A.weighted(aln, "unique").groupBy("strand").agg(A.in_reads(F.sum("w")).alias("n")).collect()
    assert {x.strand: x.n for x in unique} == {"sense": 1.0, "antisense": 0.0}


def test_window_metrics(spark):
    aln = spark.createDataFrame([("s", "c", 0, 2, "sense")] * 2 + [("s", "c", 0, 3, "antisense")], "sample_id string, contig string, start0 int, end0 int, strand string")
    r = A.window_scores(A.prefix_windows(aln, 4, 4, 1), F.lit(1.0)).first()
    assert [round(x, 6) for x in (r.balance, r.bidirectional, r.dsrnaness, r.mean_duplex, r.score)] == [57.142857, 50.0, 40.406102, 0.5, 0.202031]


def test_categories(spark):
    rows = [("a", "t", p, n) for p, n in {10: 5, 20: 2, 30: 1, 40: 2}.items()] + [("a", "u", p, n) for p, n in {1: 4, 2: 4, 3: 3, 4: 1}.items()]
    out = E.categories(spark.createDataFrame(rows, "sample_id string, transcript string, pos int, count long"))
    assert {(r.transcript, r.pos): r.category for r in out.collect()} == {("t", 10): 0, ("t", 20): 3, ("t", 30): 4, ("t", 40): 3, ("u", 1): 1, ("u", 2): 1, ("u", 3): 3, ("u", 4): 4}


def test_matching(spark):
    refs = spark.createDataFrame([("c", "AAACGTAAACGT")], "contig string, seq string")
    found = M.exact_annotations(spark.createDataFrame([("i", "ACGT")], "id string, sequence string"), refs, 4).collect()
    assert sorted((r.start_1based, r.end_1based, r.direction) for r in found) == [(3, 6, "+"), (9, 12, "+")]
    near = M.ungapped_mapping(spark.createDataFrame([("AACGTT",)], "sequence string"), refs, 6, 1).collect()
    assert ("c", 1, "sense", 1) in {(r.contig, r.start0, r.strand, r.nm) for r in near}
    records = spark.createDataFrame([("a", "ACGTACGT", 0), ("b", "ACGT", 1), ("d", "CGTA", 3)], "id string, sequence string, idx long")
    assert {(r.id, r.parent_id, r.start_1based) for r in M.contained(records, 4, 8).collect()} == {("b", "a", 1), ("d", "a", 2)}


def test_readers(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one > two\nacg\nt\n>b\nGG\n")
    assert [tuple(r) for r in R.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("name").collect()] == [("a", "a one > two", "ACGT"), ("b", "b", "GG")]
    (tmp_path / "x.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nAC\n+\nII\n")
    assert R.count_fastq(spark, str(tmp_path / "x.fq")) == 2
    assert [r.sequence for r in R.read_fastq(spark, str(tmp_path / "x.fq")).orderBy("name").collect()] == ["ACGT", "AC"]
    (tmp_path / "x.sam").write_text("@HD\tx\nq\t0\tc\t5\t9\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tMD:Z:4\nu\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    r = R.read_sam(spark, str(tmp_path / "x.sam")).collect()
    assert [(x.qname, x.pos, x.tags["NM"]) for x in r] == [("q", 5, "1")]
    (tmp_path / "x.clstr").write_text(">Cluster 0\n0\t9nt, >a... *\n1\t8nt, >b... at +/99%\n>Cluster 1\n0\t7nt, >c... *\n")
    assert sorted((x.cluster_no, x.member, x.length, x.is_representative) for x in R.read_clusters(spark, str(tmp_path / "x.clstr")).collect()) == [(0, "a", 9, True), (0, "b", 8, False), (1, "c", 7, True)]


def test_fastq_in_many_splits(spark, tmp_path):
    wanted = [(f"r{i}", "ACGTN"[: 1 + i % 5] * (1 + i % 7), "@" * ((1 + i % 5) * (1 + i % 7))) for i in range(500)]
    for part in range(2):
        (tmp_path / f"{part}.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in wanted[part::2]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        found = R.read_fastq(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 8
        assert sorted(map(tuple, found.select("name", "sequence", "quality").collect())) == sorted(wanted)
        assert {r.name for r in R.read_fastq(spark, str(tmp_path), first=3).collect()} == {f"r{i}" for i in range(6)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])


def test_malformed_fastq(spark, tmp_path):
    import pytest

    (tmp_path / "x.fq").write_text("@r1\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="malformed"):
        R.read_fastq(spark, str(tmp_path / "x.fq")).collect()


def test_more_readers(spark, tmp_path):
    (tmp_path / "x.fa").write_text("\ufeff>a one\nac\n>b\nGG\n>a two\nt\n")
    assert {(r.name, r.description, r.sequence, r.length) for r in R.read_fasta_last(spark, str(tmp_path / "x.fa")).collect()} == {("a", "a two", "T", 1), ("b", "b", "GG", 2)}
    assert R.read_sequences(spark, str(tmp_path / "x.fa")).count() == 3
    (tmp_path / "f.csv").write_text("Contig,start,end,label\nc,1,5,x\nc,7,7,y\n*,0,3,\n")
    assert sorted(map(tuple, R.read_features(spark, str(tmp_path / "f.csv")).collect())) == [("c", 1, 5, "x", "span"), ("c", 7, 7, "y", "span")]
    assert [tuple(r) for r in R.features_of(spark, ["c:1:5:x", "*:0:9:y:line"]).collect()] == [("c", 1, 5, "x", "span"), ("*", 0, 9, "y", "line")]
    (tmp_path / "p.paf").write_text("q\t10\t0\t9\t+\tt\t100\t5\t14\t9\t9\t60\nshort\n")
    assert [(r.target, r.tstart, r.mapq) for r in R.read_paf(spark, str(tmp_path / "p.paf")).collect()] == [("t", 5, 60)]
    (tmp_path / "m.csv").write_text("Sample,condition,R1,R2,library_pairs\ns,g,a,b,\"1,000\"\nt,g,a,,\n")
    assert [tuple(r) for r in R.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("s", "g", "1", "a", "b", 1000)]


def test_sample_sheets(spark, tmp_path):
    import pytest

    (tmp_path / "m.csv").write_text("sample,group,rep,r1,r2\na,g,,x1,x2\nb,g,,y1,y2\nc,,7,z1,z2\n")
    sheet = R.read_manifest(spark, str(tmp_path / "m.csv"))
    assert sorted((r.sample_id, r.group, r.replicate) for r in sheet.collect()) == [("a", "g", "1"), ("b", "g", "2"), ("c", "c", "7")]
    more = spark.createDataFrame([("a", "h", "1", "x1", "x2", None), ("a", "h", "1", "w1", "w2", None), ("d", "h", "2", "v1", "v2", None)], sheet.schema)
    assert sorted((r.sample_id, r.read1) for r in R.added_samples(sheet, more).collect()) == [("a", "x1"), ("a_2", "w1"), ("b", "y1"), ("c", "z1"), ("d", "v1")]
    assert [r.sample_id for r in R.chosen_samples(sheet, ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError, match="no samples"):
        R.chosen_samples(sheet, ["b", "q"])
    (tmp_path / "n.csv").write_text("sample,r1\na,x1\n")
    with pytest.raises(ValueError, match="read2"):
        R.read_manifest(spark, str(tmp_path / "n.csv"))
    (tmp_path / "e.fq").write_text("")
    with pytest.raises(ValueError, match="no reads"):
        R.count_reads(spark, str(tmp_path / "e.fq"))


def test_names_blocks_and_tags(spark):
    assert [one(spark, S.cpm_token(F.lit(v))) for v in (0.0, 2.5, 0.5, 0.004, 1 / 3)] == ["0", "2", "1/2", "0/1", "1/3"]
    assert [tuple(b) for b in one(spark, S.aligned_blocks(F.lit("3S4M2D5M1I2=3N1X"), F.lit(10)))] == [(10, 14), (16, 21), (21, 23), (26, 27)]
    tags = lambda *f: S.mismatch_count(S.parse_tags(F.array(*map(F.lit, f))))
    assert [one(spark, tags(*f)) for f in (("XM:i:2", "NM:i:1"), ("XA:i:3", "MD:Z:4"), ("MD:Z:1A2",), ("NM:i:x", "MD:Z:1A2"), ("ZZ:i:1",))] == [1, 3, 1, None, None]
    assert [one(spark, S.pvalue_method(F.lit(m))) for m in ("cleaveland", "x")] == ["cleaveland_category_rank", "transcript_peak_empirical"]
    r = spark.createDataFrame([("",), (None,), ("ACGTTTTTTTTT",)], "s string").select(*(c.alias(n) for n, c in S.complexity(F.col("s")).items())).collect()
    assert (r[0].length, r[0].low_complexity, r[0].dominant_dinucleotide) == (0, True, "")
    assert r[1].length is None and (r[2].longest_homopolymer_base, r[2].longest_homopolymer_length, r[2].dominant_trinucleotide) == ("T", 9, "TTT")


def test_collapse(spark):
    records = spark.createDataFrame([(0, "a", "ACGTACGT"), (1, "b", "ACGT"), (2, "c", "ACGTACGT"), (3, "d", "CGTA")], "idx long, id string, sequence string")
    kept, gone = M.collapsed(records, 4, 8)
    assert [r.id for r in kept.collect()] == ["a"]
    assert {(r.removed_id, r.removal_reason, r.parent_id, r.start_1based, r.end_1based) for r in gone.collect()} == {("c", "exact_duplicate", "a", 1, 8), ("b", "shorter_exact_substring", "a", 1, 4), ("d", "shorter_exact_substring", "a", 2, 5)}
    assert {r.metric: r.value for r in M.collapse_summary(records, kept, gone).where("metric <> 'length_breakdown'").collect()}["kept_records_after_collapse"] == 1


def test_numbered_over_many_parts(spark):
    from strandlake.operators.ranking import numbered

    rows = numbered(spark.range(0, 5000, 1, 16).select((F.col("id") * 7919 % 5000).alias("x")), "x").collect()
    assert len(rows) == 5000 and all(r["rank"] == r["x"] + 1 for r in rows)


def test_choices_within_runs(spark):
    rows = spark.createDataFrame([("c", s, 200, v) for s, v in ((0, 4.0), (100, 3.0), (150, 2.0), (400, 1.0))], "contig string, start0 int, width int, rank_score double")
    assert sorted(r.start0 for r in A.non_overlapping(rows).collect()) == [0, 100, 400]
    assert [(r.start0, r["rank"]) for r in A.best_windows(rows, top=2).orderBy("rank").collect()] == [(0, 1), (100, 2)]


def test_profiles_come_as_columns(spark):
    """figures are arrays over many rows, not a record made for each; letters that are not ASCII stay what they are. Reads are judged without a join."""
    import pyarrow as pa

    from strandlake.functions.profiles import _figures, _profile
    from strandlake.operators import mapping as P

    assert isinstance(_figures(np.frombuffer(b"ACGTACGA", np.uint8).reshape(2, 4)), pa.StructArray)
    got = _profile(pa.array(["AéèACé", None, "", "ACACAC"])).to_pylist()
    assert got[1] is None and (got[0]["base"], got[0]["motif2"], got[0]["acgt_motif2"]) == ("è", "Aé", "AC")
    assert (got[2]["base"], got[2]["run"], got[2]["motif2"]) == ("", 0, "") and (got[3]["motif2"], got[3]["top2"], got[3]["all2"]) == ("AC", 3, 5)
    reads = spark.createDataFrame([("ACGGTTACGATTACAGCA", 1), ("ACGGTTACGATTACAGCA", 2), ("A" * 18, 3)], "sequence string, k int")
    kept = P.passing_reads(reads)
    assert sorted(r.k for r in kept.collect()) == [1, 2] and "Join" not in kept._jdf.queryExecution().toString()
