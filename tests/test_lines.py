"""Readers of files whose lines depend on those before them, in many splits; writers; axis operators, against plain Python."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators import alignments as A
from strandlake.operators import axis
from strandlake.operators.skew import salted_join
from strandlake.sources import lines as L
from strandlake.sources import readers as R


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("700", "100", "5"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def paf_lines(rng, n):
    out = []
    for i in range(n):
        name = f"q{rng.randrange(4) if rng.random() < 0.2 else i}"
        for _ in range(rng.choice([1, 1, 2, 3, 40 if i % 30 == 0 else 1])):
            out.append((name, rng.choice("+-"), f"t{rng.randrange(3)}", start := rng.randrange(900), start + rng.randrange(1, 60), rng.choice([0, 3, 20, 60])))
    return out


@pytest.mark.parametrize("most_held", [L.MOST_HELD, 7])
def test_paf_groups_that_cross_splits(spark, tmp_path, small_splits, monkeypatch, most_held):
    monkeypatch.setattr(L, "MOST_HELD", most_held)
    rng = random.Random(4)
    files = [paf_lines(rng, 120), paf_lines(rng, 3), [("one", "+", "t1", 1, 5, 20)] * 90]
    for k, rows in enumerate(files):
        text = "".join(f"{q}\t50\t0\t9\t{s}\t{t}\t1000\t{a}\t{b}\t9\t9\t{m}\n" + ("short\tline\n" if a % 50 == 0 else "") for q, s, t, a, b, m in rows)
        (tmp_path / f"{k}.paf").write_text(text)
    want = []
    for rows in files:
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            group = list(group)
            valid = sum(r[5] >= 10 for r in group)
            want += [(*r, len(group), valid) for r in group]
    found = R.read_paf_groups(spark, str(tmp_path), 10)
    assert found.rdd.getNumPartitions() > 4
    rows = found.collect()
    assert sorted((r.qname, r.strand, r.target, r.tstart, r.tend, r.mapq, r.group_size, r.group_valid) for r in rows) == sorted(want)
    # one first valid line a group that has a valid one
    groups = [list(g) for rows_ in files for _, g in itertools.groupby(rows_, key=lambda r: r[0])]
    assert sum(r.first_valid for r in rows) == sum(any(x[5] >= 10 for x in g) for g in groups)


def test_sam_groups(spark, tmp_path, small_splits):
    lines = ["@HD\tVN:1"]
    want = {}
    for i in range(150):
        n = 1 + i % 4
        for k in range(n):
            lines.append(f"r{i}\t{16 if k % 2 else 0}\tc\t{5 + k}\t9\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:{0 if k != 1 else 2}")
        want[f"r{i}"] = n - (n > 1)
    lines += ["u\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI"]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    found = R.read_sam_groups(spark, str(tmp_path / "x.sam")).collect()
    assert {r.qname: r.group_valid for r in found} == want | {"u": 0}
    assert sum(r.first_valid for r in found) == 150


def test_duplex_file_in_many_splits(spark, tmp_path, small_splits):
    want, text = [], "  ((.&.))  1,2 : 3,4 (-1.5)\n"
    want.append((None, 1, -1.5))
    for i in range(60):
        text += f">t{i} and more\n>q\n" if i % 7 == 0 else ""
        for k in range(i % 5):
            text += f"((.&.))  {i},{i + 5} : 3,4 (-{k}.25)\nnoise\n"
            want.append(("q" if i >= 0 else None, i, -(k + 0.25)))
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(text)
    found = [(r.transcript, r.t_start, r.mfe) for r in R.read_rnaplex(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(want * 2, key=str)


def test_headers_hold_over_splits_without_one(spark, tmp_path, small_splits):
    rows, now = [], None
    for i in range(400):
        if i % 90 == 10:
            now = f"h{i}"
            rows.append((f">{now}", now))
        rows.append((f"line {i}", now))
    (tmp_path / "x.txt").write_text("\n".join(r for r, _ in rows) + "\n")
    value = F.col("value")
    found = L.carried_headers(L.placed_lines(spark, str(tmp_path / "x.txt")), F.when(value.startswith(">"), F.substring(value, 2, 99)), ~value.startswith(">"))
    assert sorted((r.value, r.header or "") for r in found.collect()) == sorted((v, h or "") for v, h in rows if not v.startswith(">"))


def test_union_of_keys_and_writers(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1L, map('b', '1', 'a', 'x')), (0L, map('c', '0')), (2L, map('a', 'y', 'd', '2')), (3L, map('c', 'z')) AS t(idx, fields)").repartition(3)
    wide = R.union_of_keys(rows, "fields", "idx")
    assert wide.columns == ["idx", "c", "b", "a", "d"]
    R.write_rows(rows, str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), sep="\t", header=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("0", None, None, None), (None, "1", "x", None), (None, None, "y", "2"), ("z", None, None, None)], key=str)
    R.write_rows(rows.limit(0), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0
    seqs = spark.createDataFrame([("a", "ACGT" * 30, "+", "I" * 120)], "name string, sequence string, plus string, quality string")
    R.write_fasta(seqs, str(tmp_path / "f"))
    assert R.read_fasta(spark, str(tmp_path / "f")).first().sequence == "ACGT" * 30
    assert max(len(r.value) for r in spark.read.text(str(tmp_path / "f")).collect()) == 80
    R.write_fastq(seqs, str(tmp_path / "q"))
    assert tuple(R.read_fastq(spark, str(tmp_path / "q")).first()) == tuple(seqs.first())
    R.write_stats(spark.createDataFrame([("b", 2), ("a", 1)], "metric string, value long"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["metric,value", "a,1", "b,2"]


def intervals(seed, n=400, top=3_000):
    rng = random.Random(seed)
    return [(rng.choice("xy"), s, s + rng.choice([1, 3, 20, 400 if rng.random() < 0.02 else 5]), rng.randint(1, 4)) for s in (rng.randrange(top) for _ in range(n))]


@pytest.mark.parametrize("span", [1, 16, 1_000, 1 << 16])
def test_runs_unions_and_moving_sums_do_not_depend_on_ranges(spark, span):
    rows = intervals(span)
    df = spark.createDataFrame(rows, "k string, start0 long, end0 long, w long")
    depth = {k: [0] * 4_000 for k in "xy"}
    for k, s, e, w in rows:
        for p in range(s, e):
            depth[k][p] += w
    runs = axis.runs(df, ("k",), {"d": F.col("w")}, span).collect()
    found = {k: [0] * 4_000 for k in "xy"}
    for r in runs:
        for p in range(r.start0, r.end0):
            assert found[r.k][p] == 0
            found[r.k][p] = r.d
    assert found == depth
    blocks = sorted((r.k, r.start0, r.end0) for r in axis.union_of(df, ("k",), span).collect())
    want = []
    for k, s, e, _ in sorted(rows):
        if want and want[-1][0] == k and s <= want[-1][2]:
            want[-1] = (k, want[-1][1], max(e, want[-1][2]))
        else:
            want.append((k, s, e))
    assert blocks == want
    for window in (1, 2, 5, 24):
        pieces = axis.moving_sums(axis.steps(df, ("k",), {"d": F.col("w")}), ("k",), ("d",), window, F.lit(2_900), span).collect()
        sums = {k: [0] * 2_900 for k in "xy"}
        for r in pieces:
            for p in range(r.start0, r.end0):
                sums[r.k][p] = r.d + r.d_slope * (p - r.start0)
        left = window // 2
        assert sums == {k: [sum(v[max(0, p - left) : p - left + window]) if p >= left else sum(v[: max(0, p - left + window)]) for p in range(2_900)] for k, v in depth.items()}


def test_sum_of_the_lesser_of_two_slopes(spark):
    rng = random.Random(9)
    rows = [(float(rng.randint(-9, 9)), float(rng.randint(-4, 4)), float(rng.randint(-9, 9)), float(rng.randint(-4, 4)), rng.randint(1, 12)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, sa double, b double, sb double, n long")
    found = df.select("*", axis.least_sum(*(F.col(c) for c in ("a", "sa", "b", "sb", "n"))).alias("x")).collect()
    assert [r.x for r in found] == [sum(min(r.a + r.sa * k, r.b + r.sb * k) for k in range(r.n)) for r in found]


def test_overlay_of_step_functions(spark):
    one = spark.createDataFrame([("c", 0, 10, 1.5), ("c", 10, 20, 3.0), ("d", 5, 6, 1.0)], "k string, start0 int, end0 int, value double")
    two = spark.createDataFrame([("c", 5, 12, 0.1), ("e", 1, 3, 2.0)], "k string, start0 int, end0 int, value double")
    found = sorted(map(tuple, axis.overlay({"one": one, "two": two}, ("k",), span=8).collect()))
    assert found == [("c", 0, 5, 1.5, 0.0), ("c", 5, 10, 1.5, 0.1), ("c", 10, 12, 3.0, 0.1), ("c", 12, 20, 3.0, 0.0), ("d", 5, 6, 1.0, 0.0), ("e", 1, 3, 0.0, 2.0)]


def test_features_meet_windows_once(spark):
    rng = random.Random(6)
    features = [(rng.choice(["a", "b", "*", "all", "z"]), s := rng.randrange(500), s + rng.choice([1, 30, 400]), f"f{i}") for i in range(60)] + [("a", 5, 5, "empty")]
    windows = [("a" if rng.random() < 0.9 else "b", s := rng.randrange(700), s + rng.choice([1, 50, 300])) for _ in range(200)]
    want = sorted((f[3], *w) for f in features for w in windows if f[0] in (w[0], "*", "all") and max(f[1], w[1]) < min(f[2], w[2]))
    for size in (10, 250):
        found = axis.overlapping(spark.createDataFrame(features, "contig string, start long, end long, label string"), spark.createDataFrame(windows, "contig string, start0 long, end0 long"), size)
        assert sorted((r.f_label, r.contig, r.start0, r.end0) for r in found.collect()) == want


def test_shares_of_a_read_at_many_places_add_up(spark):
    places = {"r1": 13, "r2": 17, "r3": 40_000, "r4": 3}
    rows = [("s", q, "c", 10 * i, 10 * i + 5, "sense", 0) for q, n in places.items() for i in range(n)]
    aln = spark.createDataFrame(rows, "sample_id string, qname string, contig string, start0 int, end0 int, strand string, nm int")
    by_read = {r.qname: r.n for r in A.weighted(aln).groupBy("qname").agg(A.in_reads(F.sum("w")).alias("n")).collect()}
    assert all(abs(n - 1) < 1e-12 for n in by_read.values())
    (r,) = A.hit_summary(aln).collect()
    assert round(r.total_reads, 9) == 4 and r.covered_bases == 5 * 40_000
    assert round(r.peak_sense, 9) == round(1 / 13 + 1 / 17 + 1 / 40_000 + 1 / 3, 9)


def test_salted_join_finds_the_same_rows(spark):
    many = spark.range(3_000).selectExpr("id % 7 + CASE WHEN id < 2000 THEN 0 ELSE 10 END * 0 AS k", "id")
    few = spark.range(20).selectExpr("id % 9 AS k", "id AS other")
    want = sorted(map(tuple, many.join(few, "k").select("k", "id", "other").collect()))
    assert sorted(map(tuple, salted_join(many, few, ["k"], hot=50).select("k", "id", "other").collect())) == want


def test_names_and_bounds(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert one(S.safe_name(F.lit("a b/c"))) == "a_b_c"
    assert [one(c) for c in S.context_bounds(F.lit(5), F.lit(9), F.lit(12), F.lit(6))] == [0, 12]


def test_screen_counters_come_with_the_pass(spark):
    from pyspark.sql import Observation

    from strandlake.operators import screen

    rows = [("s", "q1", "c", 0, 10, "sense", 30), ("s", "q1", "c", 300, 310, "antisense", 30), ("s", "q1", "c", 5, 9, "sense", 3), ("s", "q2", "c", 0, 4, "sense", 0)]
    aln = screen.grouped_reads(spark.createDataFrame(rows, "sample_id string, qname string, contig string, start0 int, end0 int, strand string, mapq int"), 10)
    seen = Observation()
    bins = screen.screen_bins(aln.observe(seen, *(c.alias(n) for n, c in screen.counters(10, 1).items())), 250, 10).collect()
    assert {(r.bin, r.sense_area, r.antisense_area) for r in bins} == {(0, 5.0, 0.0), (1, 0.0, 5.0)}
    assert seen.get == {"low_mapq": 2, "mapped_reads": 1, "kept_alignments": 2, "max_valid_mappings_per_read": 2, "multimapped_reads": 1, "reads_at_secondary_cap": 1}


def test_long_contig_is_walked_in_pieces(spark):
    from strandlake.operators import matching as M

    rng = random.Random(3)
    seq = "".join(rng.choices("ACGT", k=5_000))
    refs = spark.createDataFrame([("long", seq), ("short", seq[40:90]), ("none", None), ("empty", "")], "contig string, seq string")
    reads, want = [], set()
    for n, at, changes in [(18, 0, ()), (18, 4_982, (3,)), (24, 999, (0, 20)), (21, 1_010, (2, 9, 17)), (18, 50, ()), (30, 4_970, (1,))]:
        read = list(seq[at : at + n])
        for k in changes:
            read[k] = {"A": "C", "C": "G", "G": "T", "T": "A"}[read[k]]
        reads.append("".join(read))
        want.add((reads[-1], "long", at, "sense", len(changes)))
        if 40 <= at and at + n <= 90:
            want.add((reads[-1], "short", at - 40, "sense", len(changes)))
    rows = spark.createDataFrame([(r,) for r in reads], "sequence string")
    assert M.reference_pieces(refs, 30, 700).count() == 10
    for chunk in (700, 1 << 18):
        found = {tuple(r) for r in M.ungapped_mapping(rows, refs, 18, 3, 30, chunk).collect()}
        assert want <= found and all(r[4] <= 3 for r in found)
        brute = {(q, c, i, s, d) for q in reads for s, k in (("sense", q), ("antisense", q[::-1].translate(str.maketrans("ACGT", "TGCA")))) for c, t in (("long", seq), ("short", seq[40:90])) for i in range(len(t) - len(q) + 1) if (d := sum(a != b for a, b in zip(k, t[i:], strict=False))) <= 3}
        assert found == brute
    best = {r.sequence: r.nm for r in M.best_mapping(rows, refs, 18, 3, 30, one=True).collect()}
    assert best == {q: min(r[4] for r in brute if r[0] == q) for q in reads}


def test_the_run_of_a_small_sample(spark):
    from strandlake.operators import srna_run as Q

    rng = random.Random(1)
    contig, control = ("".join(rng.choices("ACGT", k=300)) for _ in range(2))
    contig = contig[:200] + contig[:60]  # places twice
    reads = [("s", contig[100:120])] * 3 + [("s", contig[10:30].replace("T", "U"))] + [("s", "A" * 20)] * 2 + [("s", control[5:25])]
    template = spark.createDataFrame([("t", contig), ("aa", "A" * 40)], "contig string, seq string")
    tables = Q.run(spark.createDataFrame(reads, "sample_id string, sequence string"), template, spark.createDataFrame([("k", control + contig[100:120])], "contig string, seq string"), Q.Settings(mismatches=1, control_mismatches=0))
    stats = {r.metric: r.value for r in tables["analysis_stats"].collect()}
    assert stats["original_reads"] == 7 and stats["template_mapped_reads_before_complexity_filter"] == 6
    assert stats["mapped_filtered_one_or_two_base_alphabet"] == 2 and stats["perfect_alignments_counted"] == 4 and stats["control_mapped_reads"] == 3
    (hit,) = tables["hits"].collect()
    assert (hit.contig, hit.sense_perfect_reads_weighted, hit.covered_bases) == ("t", 4.0, 60)
    assert {(r.start0, r.end0, round(r.sense_cpm * 7 / 1e6, 6)) for r in tables["top_coverage"].collect()} == {(10, 30, 0.5), (100, 120, 3.0), (210, 230, 0.5)}
    named = spark.createDataFrame([("r1 x",), ("r2",), ("r3 y",)], "name string")
    assert {r.name for r in Q.selected_reads(named, spark.createDataFrame([("r1",), ("r3",)], "qname string")).collect()} == {"r1 x", "r3 y"}


def test_held_and_joined_seeds_find_the_same_places(spark):
    """where tasks hold the sequences nothing but true places leaves the walk; both ways agree, over the edges of pieces, N and letters that are not ASCII too."""
    import random

    from strandlake.operators import matching as M

    rng = random.Random(3)
    long = "".join(rng.choice("ACGT") for _ in range(3000))
    reads = [long[i : i + 18 + i % 7] for i in range(0, 2900, 37)] + ["ACACACACACACACACAC", "A" * 20, long[40:50] + "N" + long[51:60]]
    refs = spark.createDataFrame([("c1", long), ("c2", long[500:600] + "N" + long[601:700] + "\u00e9" + long[701:800]), ("c3", "AC" * 40), ("c4", None), ("c5", "ACG")], "contig string, seq string")
    rows = spark.createDataFrame([(r,) for r in reads], "sequence string")

    def brute(k):
        out = set()
        for contig, seq in ((r.contig, r.seq) for r in refs.collect() if r.seq):
            for r in set(reads):
                for strand, kmer in (("sense", r), ("antisense", r[::-1].translate(str.maketrans("ACGTN", "TGCAN")))):
                    for p in range(len(seq) - len(kmer) + 1):
                        nm = sum(a != b for a, b in zip(kmer, seq[p : p + len(kmer)], strict=True))
                        if nm <= k:
                            out.add((r, contig, p, strand, nm))
        return out

    for k in (0, 2, 3):
        held, joined = ({tuple(r) for r in M.ungapped_mapping(rows, refs, 18, k, 24, 500, most).collect()} for most in (None, 0))
        assert held == joined == brute(k)
    plan = M.ungapped_mapping(rows, refs, 18, 3, 24)._jdf.queryExecution().toString()
    assert "Join" not in plan
