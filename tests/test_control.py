"""The control tables where many records share one sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import control as C


def test_records_of_one_sequence_share_its_places(spark):
    """places are stored once a sequence, however many records have it, and the overview is what single records would add up to."""
    seq, other = "ACGGTTACGATTACAGCA", "TTGACCATTGACCAGGAT"
    names = [f"r{k}_{k % 3}p5CPM" for k in range(40)] + ["x_antisense_1_2CPM", "y"]
    records = spark.createDataFrame([(k, n, seq if k % 4 else other) for k, n in enumerate(names)], "idx long, id string, sequence string")
    refs = spark.createDataFrame([("dsrna", "a", seq + "GG" + seq + other), ("genome", "g", "T" + seq)], "kind string, contig string, seq string")
    places = C.sequence_places(records, refs, 18, 24)
    assert places.count() == 4
    assert C.reference_places(records, refs, 18, 24).count() == sum(3 if k % 4 else 1 for k in range(42))
    summary = C.control_summary(records, places)
    assert summary.where("dsrna_hits = 2 and genome_hits = 1").count() == 31
    runs = C.overview(summary, places)
    value = lambda n: {"x_antisense_1_2CPM": 2.0, "y": 1.0}.get(n) or (int(n.split("_")[1][0]) + 0.5)
    mine = [(n, k) for k, n in enumerate(names) if k % 4]
    got = {(r.strand, r.start0): (r.cpm, r.genome_cpm, r.whole_cpm) for r in runs.where(F.col("start0") == 0).collect()}
    sense = sum(value(n) for n, _ in mine if "antisense" not in n)
    anti = sum(value(n) for n, _ in mine if "antisense" in n)
    assert got[("sense", 0)] == (sense / 2, sense / 2, sense)
    assert (("antisense", 0) in got) == (anti > 0) and (not anti or got[("antisense", 0)] == (anti / 2, anti / 2, anti))


def test_cells_list_the_best_places_only(spark):
    """F2."""
    seq = "ACGGTTACGATTACAGCA"
    near = "T" + seq[1:]
    records = spark.createDataFrame([(0, "a", seq), (1, "b", seq)], "idx long, id string, sequence string")
    refs = spark.createDataFrame([("dsrna", "a", seq), ("dsrna", "b", near), ("genome", "g", near + near)], "kind string, contig string, seq string")
    got = {(r.kind, r.id): (r.best_mismatches, r.hits, r.contigs) for r in C.reference_cells(records, refs, 18, 24, 2).collect()}
    assert got == {(k, i): v for i in "ab" for k, v in (("dsrna", (0, 1, "a")), ("genome", (1, 2, "g")))}


def test_every_place_has_a_moving_sum(spark):
    """places without depth are rows, too."""
    from strandlake.operators import alignments as A

    aln = spark.createDataFrame([("c", "sense", 3, 5)], "contig string, strand string, start0 int, end0 int")
    lanes = spark.createDataFrame([("c", "sense"), ("c", "antisense")], "contig string, strand string")
    keys = ("contig", "strand")
    rows = A.at_places(A.moving_average(aln, 3, keys, 9), lanes, keys, 9, "window_sum").orderBy("strand", "pos").collect()
    assert [r.window_sum for r in rows] == [0] * 9 + [0, 0, 1, 2, 2, 1, 0, 0, 0]


def test_catalogue_tables_are_whole():
    """neither table leaves out places without depth or lengths beside one."""
    from strandlake.plans import catalogue, pipelines, results  # noqa: F401

    assert "window_sum > 0" not in catalogue.ORACLES["w02_moving_average"]
    assert "length = 21" not in catalogue.ORACLES["m08_length_distribution"]


def test_filter_counts_need_no_mapping(spark, monkeypatch):
    """a run works out the tables it is asked for."""
    from strandlake.operators import srna_run as R

    def never(*_):
        raise AssertionError("mapped")

    monkeypatch.setattr(R, "ungapped_mapping", never)
    reads = spark.createDataFrame([("s", "ACGGTTACGATTACAGCA"), ("s", "A" * 18)], "sample_id string, sequence string")
    refs = spark.createDataFrame([("c", "ACGGTTACGATTACAGCA")], "contig string, seq string")
    got = R.run(reads, refs, settings=R.Settings(filter_stage="pre"), tables=("filter_stats",))["filter_stats"]
    assert {(r.metric, r.value) for r in got.collect()} == {("original_reads", 2.0), ("reads_passing_complexity_filter", 1.0), ("filtered_one_or_two_base_alphabet", 1.0)}


def test_merged_intervals_come_in_bounded_parts(spark):
    """more rows make more parts, not larger ones."""
    from strandlake.operators import alignments as A

    rows = spark.range(1000).selectExpr("id % 500 as k", "cast(id div 500 * 5 as int) as start0", "cast(id div 500 * 5 + 5 as int) as end0")
    merged = A.merge_intervals(rows, ("k",), 50)
    assert merged.rdd.getNumPartitions() == 20
    assert {(r.k, r.start0, r.end0) for r in merged.collect()} == {(k, 0, 10) for k in range(500)}
