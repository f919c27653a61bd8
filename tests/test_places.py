"""Places: what is worked out once a sequence is not worked out again for each of its places."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import control as C
from strandlake.operators import mapping as P
from strandlake.operators import matching as M
from strandlake.plans import fixtures as X

SEQ, OTHER = "ACGGTTACGATTACAGCA", "TTGACCATTGACCAGGAT"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clean_records_judge_sequences_not_places(spark):
    """the complexity filter was evaluated for each place, not each sequence: the optimizer brought it over the join."""
    records = spark.createDataFrame([(k, f"r{k}_1p5CPM", s) for k, s in enumerate([SEQ, OTHER, "A" * 18, SEQ])], "idx long, id string, sequence string")
    refs = spark.createDataFrame([("dsrna", "a", SEQ + "GG" + SEQ), ("dsrna", "b", SEQ), ("genome", "g", "T" + OTHER)], "kind string, contig string, seq string")
    summary = C.control_summary(records, C.sequence_places(records, refs, 18, 24))
    clean = C.clean_records(summary)
    assert sorted(r.idx for r in clean.collect()) == [0, 3]
    assert {(r.dsrna_hits, r.dsrna_contigs, r.genome_hits) for r in summary.collect()} == {(3, 2, 0), (0, 0, 1), (0, 0, 0)}
    assert "aggregate(" not in _plan(clean) and "regexp" not in _plan(clean).lower() and len(_plan(clean)) < 5000


def test_mapped_reads_judge_sequences_not_places(spark):
    """so was the simple reason of mapped reads."""
    reads = spark.createDataFrame([("s1", "g1", SEQ, 3), ("s2", "g1", SEQ, 1), ("s1", "g1", "AT" * 9, 2)], "sample_id string, grp string, sequence string, copies long")
    refs = spark.createDataFrame([("a", SEQ + "GG" + "AT" * 12)], "contig string, seq string")
    libraries = spark.createDataFrame([("s1", "g1", 5), ("s2", "g1", 1)], "sample_id string, grp string, n_reads long")
    mapped = P.mapped_reads(reads, refs, 18, 24)
    got = {r.sample_id: (r.raw_mapped_alignments, r.simple_filtered_alignments) for r in P.sample_summary(mapped, libraries).collect()}
    # the repeated unit has a place at every second letter, and none of its own on the other strand: it is a palindrome
    assert got == {"s1": (3 + 2 * 4, 2 * 4), "s2": (1, 0)}
    kept = P.retained(mapped, libraries)
    assert kept.count() == 2 and len(_plan(kept)) < 5000


def test_one_best_place(spark):
    """with ``one`` the first place of a read is the least by contig, start and strand of those with the fewest mismatches."""
    reads = spark.createDataFrame([(SEQ,), (OTHER,)], "sequence string")
    changed = OTHER[:5] + "G" + OTHER[6:]
    refs = spark.createDataFrame([("b", SEQ + SEQ), ("a", "G" + SEQ + changed), ("a", "G" + SEQ)], "contig string, seq string")
    assert sorted(map(tuple, M.best_mapping(reads, refs, 18, 2, one=True).collect())) == [(SEQ, "a", 1, "sense", 0), (OTHER, "a", 19, "sense", 1)]
    every = M.best_mapping(reads, refs, 18, 2).where(F.col("sequence") == SEQ)
    assert every.count() == 3


def test_encoded_texts(spark):
    """Encoding by bytes gives what the pattern gave, for texts of any characters."""
    texts = ["", None, "Ab-zZ 09", "éÅngström Straße", "\U0001f600 x\u0000Y\n", "ACGTacgt" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(X.encoded(F.col("text")).alias("a"), F.expr(X._ENCODE.format(clean="regexp_replace(text, '[^A-Za-z]', '')")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_held_sequences_are_found_as_by_comparing_all():
    """The lookup through buckets finds each pair once, also where many sequences share a seed."""
    rng = np.random.default_rng(3)
    letters = rng.choice(np.frombuffer(b"ACGTN", np.uint8), 3000, p=[0.3, 0.3, 0.2, 0.15, 0.05])
    some = [letters[k : k + 18 + k % 7].tobytes().decode() for k in range(0, 2900, 13)] + ["A" * 18, "AC" * 10]
    room = len(letters) - np.arange(len(letters))
    for mismatches in range(4):
        held = M.Held(some, M.mismatch_kinds(18, mismatches), 18, mismatches)
        got = sorted(map(tuple, np.concatenate(list(held.places(letters, room)), 1).T.tolist()))
        wanted = []
        for w, x in enumerate(some):
            windows = np.lib.stride_tricks.sliding_window_view(letters, len(x))
            nm = (windows != np.frombuffer(x.encode(), np.uint8)).sum(1)
            wanted += [(int(p), w, int(nm[p])) for p in np.flatnonzero(nm <= mismatches)]
        assert got == sorted(wanted)
