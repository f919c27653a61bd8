"""The fit of the quality rules' bands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import quality


def test_bands_are_fitted_on_all_labelled_rows(spark):
    """the medians are those of all rows, not of a sample of them."""
    n = 20_000
    rng = np.random.default_rng(1)
    values = np.round(4 + rng.normal(0, 0.3, n), 4)
    tokens = rng.integers(50, 3000, n)
    rows = spark.createDataFrame([(i, float(t), float(v)) for i, (t, v) in enumerate(zip(tokens, values, strict=True))], "i long, n double, v double")
    figures = rows.select(F.when(F.col("i") < n - 59, "en").otherwise("xx").alias("lang"), "n", F.col("v").alias("chars_per_token"), F.col("v").alias("chars_per_piece"), F.lit(0.0).alias("fallback_share"))
    bands = quality.fit_bands(figures)
    own = values[: n - 59]
    assert set(bands) == {"en"}  # 59 rows are too few
    assert abs(bands["en"].spreads[0].middle - np.median(own)) < 1e-6
    inside = bands["en"].holds(np.stack([tokens, values, np.ones(n), values, np.zeros(n)], 1)[: n - 59])
    assert inside.mean() >= quality.KEPT


def test_measured_once_and_twice_agree(spark):
    """verdicts from stored figures are those of the rules fitted first."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    once = {tuple(r) for r in quality.fitted_quality(docs, labels).collect()}
    assert once == {tuple(r) for r in quality.quality(docs, quality.fitted_rules(docs, labels)).collect()}
    assert len(once) == docs.count()
