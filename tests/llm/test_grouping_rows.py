"""Rows of shared buckets, and links found without an edit distance."""

import random

import numpy as np
from strandlake.llm import grouping, line_dedup


def test_shared_members(spark):
    """Buckets that lie in several batches, with rows that stand there more than once."""
    rng = random.Random(8)
    rows = [(b, rng.randrange(3) + 100 * b) for b in range(60) for _ in range(rng.randrange(1, 5))]
    rows += [(7_000, 5)] * 50 + [(8_000, k % 40) for k in range(90)] + [(9_000, 1)] * 20 + [(9_000, 2)]
    ids = {}
    for b, i in rows:
        ids.setdefault(b, set()).add(i)
    want = sorted((b, i) for b, found in ids.items() if len(found) > 1 for i in found)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = grouping.shared_members(spark.createDataFrame(rows, "bucket long, id long").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(tuple, found)) == want


def test_surely_near_links_no_more_than_the_distance():
    rng = random.Random(9)
    texts = []
    for _ in range(400):
        a = " ".join("".join(rng.choices("abcé", k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30)))
        b = list(a)
        for _ in range(rng.randrange(0, 2 + len(a) // 8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choices("abcé ", k=rng.randrange(2))
        texts += [a, "".join(b)]
    size = np.array([len(t) for t in texts])
    x, y = np.arange(0, 800, 2), np.arange(1, 800, 2)
    sure, linked = line_dedup.surely_near(texts, size, x, y), line_dedup._near(texts, size, x, y)
    want = [line_dedup.similar(texts[a], texts[b]) for a, b in zip(x, y, strict=True)]
    assert not (sure & ~linked).any()
    assert sure.sum() > 0.3 * linked.sum() > 0
    assert linked.tolist() == want
