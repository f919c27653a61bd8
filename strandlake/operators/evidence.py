"""Cleavage evidence and target tables: densities of 5' ends, peak categories, hits with their support, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.ranking import numbered

from strandlake.functions.sequences import binomial_at_least_one, clamp_pvalue, pvalue_method


def categories(density: DataFrame) -> DataFrame:
    """Adds the peak category 0-4 of each (sample_id, transcript, pos, count).

    What a transcript needs for it comes from the histogram of its counts, so no window holds all its places.
    """
    key = ["sample_id", "transcript"]
    histogram = density.groupBy(*key, "count").agg(F.count("*").alias("n"))
    peak = histogram.groupBy(*key).agg(F.max(F.struct("count", "n")).alias("top"), (F.sum(F.col("count") * F.col("n")) / F.sum("n")).alias("mean"))
    is_top = F.col("count") == F.col("top.count")
    category = F.when(F.col("count") == 1, 4).when(is_top & (F.col("top.n") == 1), 0).when(is_top, 1).when(F.col("count") > F.col("mean"), 2).otherwise(3)
    return density.join(peak, key).withColumn("category", category).drop("top", "mean")


def category_totals(categorised: DataFrame) -> DataFrame:
    return categorised.groupBy("category").agg(F.count("*").alias("positions"))


def cleavage(hits: DataFrame, categorised: DataFrame) -> DataFrame:
    """Per hit: the slice place (query 9, 10 or 11) with most support, its total count and best category.

    Ties go to the place nearest to 10, then the smaller. Hits without support are left out.
    """
    sites = hits.select("hit_id", "query", "transcript", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"site{q}").alias("pos")) for q in (9, 10, 11)))).alias("s")).select("hit_id", "query", "transcript", "s.q", "s.pos")
    per = categorised.groupBy("transcript", "pos").agg(F.sum("count").alias("total"), F.min("category").alias("best_category"))
    found = sites.join(per, ["transcript", "pos"])
    best = Window.partitionBy("hit_id").orderBy(F.desc("total"), F.abs(F.col("q") - 10), "q")
    return found.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def empirical_counts(density: DataFrame, libraries: dict[str, int]) -> DataFrame:
    """Per (transcript, pos): ``z``, proportional to the mean CPM in whole numbers, and how many places reach it."""
    product = 1
    for n in libraries.values():
        product *= n
    scale = F.lit(0).cast("decimal(38,0)")
    for sample, n in libraries.items():
        scale = F.when(F.col("sample_id") == sample, F.lit(product // n).cast("decimal(38,0)")).otherwise(scale)
    z = density.groupBy("transcript", "pos").agg(F.sum(F.col("count") * scale).cast("decimal(38,0)").alias("z"))
    return places_reaching(z, "z")


def places_reaching(track: DataFrame, value: str) -> DataFrame:
    """Adds ``at_least``: how many places of the transcript reach the value. The running sum goes over distinct values only."""
    histogram = track.groupBy("transcript", value).agg(F.count("*").alias("_n"))
    reach = histogram.select("transcript", value, F.sum("_n").over(Window.partitionBy("transcript").orderBy(F.desc(value))).alias("at_least"))
    return track.join(reach, ["transcript", value])


def dedupe_best(hits: DataFrame, sites: tuple[str, ...] = ("site10",), by: str = "mfe_ratio") -> DataFrame:
    """One hit a query, transcript and ``sites``: the highest ratio, then the lowest penalty (``by`` allen: the other way round), then the first by hit_id."""
    order = [F.struct((-F.col("mfe_ratio")).alias("x"), "allen", "hit_id"), F.struct("allen", (-F.col("mfe_ratio")).alias("x"), "hit_id")][by == "allen"]
    best = hits.groupBy("query", "transcript", *sites).agg(F.min_by(F.struct(*(c for c in hits.columns if c not in ("query", "transcript", *sites))), order).alias("_h"))
    return best.select("query", "transcript", *sites, "_h.*").select(*hits.columns)


def ranked_hits(hits: DataFrame, by: str = "mfe_ratio") -> DataFrame:
    """Hits numbered by ratio and penalty (or penalty and ratio), ties by hit_id."""
    order = [F.desc("mfe_ratio"), "allen"] if by != "allen" else ["allen", F.desc("mfe_ratio")]
    return numbered(hits, *order, "hit_id")


def retained(hits: DataFrame, least_ratio: float | None = None, most_allen: float | None = None, most_mismatches: int | None = None) -> DataFrame:
    for column, bound, low in (("mfe_ratio", least_ratio, True), ("allen", most_allen, False), ("mismatches", most_mismatches, False)):
        if bound is not None:
            hits = hits.where(F.col(column) >= bound if low else F.col(column) <= bound)
    return hits


def target_summary(hits: DataFrame, by: str, other: str) -> DataFrame:
    return hits.groupBy(by).agg(F.count("*").alias("n_pairs"), F.count_distinct(other).alias(f"n_{other}"), F.max("mfe_ratio").alias("best_ratio"), F.min("allen").alias("best_allen"), F.min("mismatches").alias("least_mismatches"))


def marker_suppression(cleaved: DataFrame, around: int = 3) -> DataFrame:
    """Per transcript: the best row of each site, then only sites further than ``around`` from better ones.

    Sites more than ``around`` apart do not touch each other, so the choice is made within runs of near sites. A run holds one
    row a place; a longest run is the whole transcript, and each choice looks at 2 * around + 1 places.
    """
    import numpy as np
    import pandas as pd

    best = cleaved.groupBy("transcript", "pos").agg(F.max_by(F.struct(*(c for c in cleaved.columns if c not in ("transcript", "pos"))), F.struct("total", -F.col("hit_id"))).alias("r"))
    rows = best.select(*(c if c in ("transcript", "pos") else F.col(f"r.{c}").alias(c) for c in cleaved.columns))
    along = Window.partitionBy("transcript").orderBy("pos")
    far = F.col("pos") - F.lag("pos").over(along) > around
    runs = rows.withColumn("_far", F.when(far, 1).otherwise(0)).withColumn("_run", F.sum("_far").over(along)).drop("_far")

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["total", "pos"], ascending=[False, True])
        at = t["pos"].to_numpy() - t["pos"].min() + around
        taken, flags = np.zeros(int(at.max()) + around + 1, bool), np.zeros(len(t), bool)
        for i, p in enumerate(at):
            flags[i] = not taken[p - around : p + around + 1].any()
            taken[p] |= flags[i]
        return t[flags].drop(columns="_run")

    return runs.groupBy("transcript", "_run").applyInPandas(choose, cleaved.schema)


def sample_support(categorised: DataFrame, totals: DataFrame) -> DataFrame:
    """Per (transcript, pos): total, best_category, mean_cpm and sem_cpm over all samples of ``totals`` (sample_id, total_reads), 0 where one has nothing.

    Means are rounded to 6 places, so that equal ones are equal whatever the order of their sums. ``totals`` has a row a sample.
    """
    n = totals.count()
    each = categorised.join(F.broadcast(totals), "sample_id").withColumn("_cpm", F.col("count") * F.lit(1e6) / F.col("total_reads"))
    per = each.groupBy("transcript", "pos").agg(F.sum("count").alias("total"), F.min("category").alias("best_category"), F.sort_array(F.collect_list("_cpm")).alias("_x"))  # a value a sample
    per = per.withColumn("_mean", F.aggregate("_x", F.lit(0.0), lambda a, x: a + x) / n)
    off = F.aggregate(F.transform("_x", lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))), F.lit(0.0), lambda a, x: a + x) + (n - F.size("_x")) * F.col("_mean") * F.col("_mean")
    sem = F.sqrt(off / (n - 1)) / F.sqrt(F.lit(n)) if n > 1 else F.lit(0.0)
    return per.select("transcript", "pos", "total", "best_category", F.round("_mean", 6).alias("mean_cpm"), F.round(sem, 6).alias("sem_cpm"))


def supported_cleavage(ranked: DataFrame, categorised: DataFrame, totals: DataFrame, transcripts: DataFrame, method: str = "transcript_peak_empirical", positions: tuple[int, ...] = (9, 10, 11)) -> DataFrame:
    """Per hit the slice site with most support, and its p-values: by the transcript's peaks, and by category and rank.

    ``ranked`` has hit_id, query, transcript, rank and a column siteQ for each position Q; ``transcripts`` has transcript and
    length. The site of the highest mean wins, then the highest total, the one nearest to 10, the smaller. Hits without any
    support are left out.
    """
    support = places_reaching(sample_support(categorised, totals), "mean_cpm")
    size = transcripts.agg(F.greatest(F.lit(1), F.sum("length") - 20 * F.count("*")).alias("_size"))
    chance = category_totals(categorised).join(F.broadcast(size)).select(F.col("category").alias("best_category"), (F.col("positions") / F.col("_size")).alias("_chance"))  # five rows
    sites = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"site{q}").alias("pos")) for q in positions)))
    found = ranked.select("hit_id", "transcript", sites.alias("s")).select("hit_id", "transcript", "s.q", "s.pos").join(support, ["transcript", "pos"])
    value = F.struct("mean_cpm", "total", (-F.abs(F.col("q") - 10)).alias("near"), (-F.col("q")).alias("first"), "pos", "sem_cpm", "best_category", "at_least")
    best = found.groupBy("hit_id").agg(F.max(value).alias("b"))
    best = best.select("hit_id", (-F.col("b.first")).alias("q"), "b.pos", "b.mean_cpm", "b.sem_cpm", "b.total", "b.best_category", "b.at_least").where("total > 0")
    out = ranked.join(best, "hit_id").join(F.broadcast(chance), "best_category").join(transcripts, "transcript", "left")
    peak = F.when(F.coalesce("length", F.lit(0)) <= 0, 1.0).otherwise(clamp_pvalue((1 + F.col("at_least")) / (1 + F.col("length"))))
    out = out.withColumn("peak_pvalue", peak).withColumn("category_pvalue", binomial_at_least_one(F.col("rank"), F.col("_chance")))
    selected = F.when(pvalue_method(F.lit(method)) == "cleaveland_category_rank", F.col("category_pvalue")).otherwise(F.col("peak_pvalue"))
    return out.withColumn("selected_pvalue", selected).drop("_chance", "at_least", "length")


def support_summary(names: DataFrame, hits: DataFrame, cleaved: DataFrame, by: str, other: str, cutoff: float) -> DataFrame:
    """A row for each of ``names`` (by, length): predicted, supported and significant partners and sites, by query position, and the best figures.

    A selected p-value of 0 counts as 1.
    """
    p = F.when(F.col("selected_pvalue") == 0, 1.0).otherwise(F.col("selected_pvalue"))
    predicted = hits.groupBy(by).agg(F.count_distinct(other).alias("predicted_partners"), F.count("*").alias("predicted_sites"), F.max("mfe_ratio").alias("best_mfe_ratio"))
    marked = cleaved.withColumn("_sure", p < cutoff)
    seen = marked.groupBy(by).agg(
        F.count_distinct(other).alias("supported_partners"), F.count("*").alias("supported_sites"), F.count_distinct(F.when(F.col("_sure"), F.col(other))).alias("significant_partners"), F.count_if("_sure").alias("significant_sites"),
        *(F.count_if(F.col("q") == q).alias(f"q{q}_sites") for q in (10, 9, 11)), F.max("mean_cpm").alias("best_mean_cpm"), F.min("selected_pvalue").alias("best_pvalue"),
    )
    return names.join(predicted, by, "left").join(seen, by, "left").na.fill(1.0, ["best_pvalue"]).na.fill(0)


def overall_summary(transcripts: DataFrame, queries: DataFrame, method: str, cutoff: float) -> DataFrame:
    """(section, metric, value, detail): the settings, then for both summaries their number, and the number and mean of what is predicted, supported and significant."""

    def section(rows: DataFrame, name: str, partner: str) -> DataFrame:
        figures = [F.count("*").cast("double").alias(f"{name}s_in_input")]
        for kind in ("predicted", "supported", "significant"):
            c = F.col(f"{kind}_partners")
            figures += [F.count_if(c > 0).cast("double").alias(f"{name}s_with_{kind}_{partner}"), F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{partner}s_{kind}")]
        one = rows.agg(*figures)
        return one.unpivot([], one.columns, "metric", "value").select(F.lit(name).alias("section"), "metric", "value", F.lit(None).cast("string").alias("detail"))

    both = section(transcripts, "transcript", "srna").unionByName(section(queries, "srna", "transcript"))
    settings = transcripts.sparkSession.createDataFrame([("settings", "pvalue_method", None, method), ("settings", "pvalue_cutoff", cutoff, None)], "section string, metric string, value double, detail string")
    return settings.unionByName(both)
