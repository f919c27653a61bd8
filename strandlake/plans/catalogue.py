"""Queries of the analytics operators over the driver's tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators import alignments as A
from strandlake.operators import evidence as E
from strandlake.operators import mapping as P
from strandlake.operators import matching as M
from strandlake.plans import fixtures as X
from strandlake.plans.fixtures import CONTIG_LENGTH, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql.removeprefix("WITH")


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- sequences

_WORD = "conv_id, turn, p"
_N = {b: f"(length(w) - length(replace(w, '{b}', '')))" for b in "ACGTN"}
_ACGT = f"({_N['A']} + {_N['C']} + {_N['G']} + {_N['T']})"
_ENT = " + ".join(f"CASE WHEN {_N[b]} > 0 THEN -(CAST({_N[b]} AS DOUBLE) / {_ACGT}) * log2(CAST({_N[b]} AS DOUBLE) / {_ACGT}) ELSE 0 END" for b in "ACGT")
_RUNS = """SELECT conv_id, turn, p, w, max(n) AS run FROM (SELECT conv_id, turn, p, w, g, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, p, c ORDER BY i) AS g, c FROM
(SELECT conv_id, turn, p, w, i, substring(w, i, 1) AS c FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM words))) GROUP BY conv_id, turn, p, w, g, c) GROUP BY conv_id, turn, p, w"""


def _kmer_cte(k: int, source: str = "words") -> str:
    return f"SELECT conv_id, turn, p, max(n) AS top FROM (SELECT conv_id, turn, p, m, count(*) AS n FROM (SELECT conv_id, turn, p, substring(w, i, {k}) AS m FROM (SELECT *, unnest(range(1, length(w) - {k} + 2)) AS i FROM {source})) GROUP BY ALL) GROUP BY ALL"


@query("f02_letters_to_rna", oracle("SELECT item_id, replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'T', 'U') AS rna FROM benchmark"))
def _(spark, d):
    return X._table(spark, d, "benchmark").select("item_id", S.letters_to_rna(F.col("text")).alias("rna"))


@query("f04_revcomp", oracle(f"SELECT {_WORD}, reverse(translate(w, 'ACGTN', 'TGCAN')) AS rc FROM words", "words"))
def _(spark, d):
    return X.words(spark, d).select("conv_id", "turn", "p", S.reverse_complement(F.col("w")).alias("rc"))


@query("f06_entropy", oracle(f"SELECT {_WORD}, round({_ENT}, 6) AS entropy FROM words", "words"))
def _(spark, d):
    return X.words(spark, d).select("conv_id", "turn", "p", r6(S.entropy(F.col("w"))).alias("entropy"))


@query("f08_homopolymer", oracle(f"SELECT {_WORD}, CAST(run AS INT) AS run FROM runs", "words", runs=_RUNS))
def _(spark, d):
    return X.words(spark, d).select("conv_id", "turn", "p", S.longest_homopolymer(F.col("w"))["len"].alias("run"))


@query("f10_kmer_fraction", oracle(f"SELECT {_WORD}, round(CAST(top AS DOUBLE) / 20, 6) AS fraction FROM k2", "words", k2=_kmer_cte(2)))
def _(spark, d):
    return X.words(spark, d).select("conv_id", "turn", "p", r6(S.dominant_kmer(F.col("w"), 2, True)["fraction"]).alias("fraction"))


_UNIT = " ".join(f"WHEN {u} * 3 <= length(w) AND substring(repeat(substring(w, 1, {u}), 21), 1, length(w)) = w THEN substring(w, 1, {u})" for u in range(1, 7))


@query("f12_repeated_unit", oracle(f"SELECT {_WORD}, CASE {_UNIT} ELSE '' END AS unit FROM words", "words"))
def _(spark, d):
    return X.words(spark, d).select("conv_id", "turn", "p", S.repeated_unit(F.col("w")).alias("unit"))


_KINDS = "(" + " + ".join(f"CASE WHEN {_N[b]} > 0 THEN 1 ELSE 0 END" for b in "ACGT") + ")"
_TOP = "greatest(" + ", ".join(_N[b] for b in "ACGT") + ")"
_JOINED = f"FROM runs JOIN k2 USING ({_WORD}) JOIN k3 USING ({_WORD})"


@query("f13_simple_reason", oracle(f"""SELECT {_WORD}, CASE WHEN {_ACGT} = 0 THEN 'no_acgt' WHEN {_N['N']} > 0.10 * length(w) THEN 'too_many_n' WHEN {_KINDS} <= 2 THEN 'one_or_two_base_alphabet'
WHEN CAST({_TOP} AS DOUBLE) / {_ACGT} >= 0.80 THEN 'dominant_single_base' WHEN run >= 8 OR CAST(run AS DOUBLE) / length(w) >= 0.60 THEN 'long_homopolymer' WHEN CAST(k2.top AS DOUBLE) / 20 >= 0.70 THEN 'dominant_2mer'
WHEN CAST(k3.top AS DOUBLE) / 19 >= 0.70 THEN 'dominant_3mer' END AS reason {_JOINED}""", "words", runs=_RUNS, k2=_kmer_cte(2), k3=_kmer_cte(3)))  # fmt: skip
def _(spark, d):
    return X.words(spark, d).select("conv_id", "turn", "p", S.simple_sequence_reason(F.col("w")).alias("reason"))


@query("f14_low_complexity", oracle(f"""SELECT {_WORD}, CASE WHEN length(w) < 18 THEN 'too_short' WHEN length(w) > 30 THEN 'too_long' WHEN {_ACGT} = 0 THEN 'no_acgt_bases' WHEN {_KINDS} <= 2 THEN 'one_or_two_base_alphabet'
WHEN CAST({_TOP} AS DOUBLE) / {_ACGT} >= 0.80 THEN 'dominant_single_base' WHEN {_ENT} < 1.25 THEN 'low_shannon_entropy' WHEN run >= 8 OR CAST(run AS DOUBLE) / length(w) >= 0.60 THEN 'long_homopolymer_run'
WHEN CAST(k2.top AS DOUBLE) / 20 >= 0.70 THEN 'dominant_dinucleotide' WHEN CAST(k3.top AS DOUBLE) / 19 >= 0.70 THEN 'dominant_trinucleotide' END AS reason {_JOINED}""", "words", runs=_RUNS, k2=_kmer_cte(2), k3=_kmer_cte(3)))  # fmt: skip
def _(spark, d):
    return X.words(spark, d).select("conv_id", "turn", "p", S.low_complexity_reason(F.col("w")).alias("reason"))


_F14 = f"""SELECT {_WORD}, CASE WHEN length(w) < 18 THEN 'too_short' WHEN length(w) > 30 THEN 'too_long' WHEN {_ACGT} = 0 THEN 'no_acgt_bases' WHEN {_KINDS} <= 2 THEN 'one_or_two_base_alphabet'
WHEN CAST({_TOP} AS DOUBLE) / {_ACGT} >= 0.80 THEN 'dominant_single_base' WHEN {_ENT} < 1.25 THEN 'low_shannon_entropy' WHEN run >= 8 OR CAST(run AS DOUBLE) / length(w) >= 0.60 THEN 'long_homopolymer_run'
WHEN CAST(k2.top AS DOUBLE) / 20 >= 0.70 THEN 'dominant_dinucleotide' WHEN CAST(k3.top AS DOUBLE) / 19 >= 0.70 THEN 'dominant_trinucleotide' END AS reason {_JOINED}"""


@query("a01_filter_stats", oracle("SELECT unnest(['original_reads', 'reads_passing_complexity_filter']) AS metric, unnest([count(*), count(*) FILTER (WHERE reason IS NULL)]) AS n FROM judged UNION ALL SELECT concat('filtered_', reason), count(*) FROM judged WHERE reason IS NOT NULL GROUP BY ALL", "words", runs=_RUNS, k2=_kmer_cte(2), k3=_kmer_cte(3), judged=_F14))
def _(spark, d):
    return P.filter_stats(X.words(spark, d).select(F.col("w").alias("sequence")))


@query("p05_passing_reads", oracle("SELECT conv_id, turn, p, w FROM words JOIN judged USING (conv_id, turn, p) WHERE reason IS NULL", "words", runs=_RUNS, k2=_kmer_cte(2), k3=_kmer_cte(3), judged=_F14))
def _(spark, d):
    return P.passing_reads(X.words(spark, d).withColumnRenamed("w", "sequence")).withColumnRenamed("sequence", "w")


@query("f16_cpm_from_name", oracle("SELECT hit_id, round(CAST(hit_id % 7 + 1 AS DOUBLE) / 2, 6) AS wide, round(CASE WHEN hit_id % 2 = 0 THEN CAST(hit_id % 7 + 1 AS DOUBLE) / 2 ELSE 0 END, 6) AS narrow FROM hits", "hits"))
def _(spark, d):
    h = X.hits(spark, d)
    n = F.col("hit_id") % 7 + 1
    name = F.concat(F.lit("x_"), F.when(F.col("hit_id") % 2 == 0, F.replace((n / 2).cast("decimal(9,1)").cast("string"), F.lit("."), F.lit("p"))).otherwise(F.concat(n.cast("string"), F.lit("/2"))), F.lit("CPM"))
    return h.select("hit_id", r6(S.cpm_from_name(name)).alias("wide"), r6(S.cpm_from_name(name, False)).alias("narrow"))


@query("f36_binomial_p", oracle("SELECT hit_id, round(least(greatest(CASE WHEN mismatches <= 0 THEN 1 ELSE 1 - power(1 - mfe_ratio / 10, mismatches) END, 1e-300), 1), 9) AS p FROM hits", "hits"))
def _(spark, d):
    return X.hits(spark, d).select("hit_id", F.round(S.clamp_pvalue(S.binomial_at_least_one(F.col("mismatches"), F.col("mfe_ratio") / 10)), 9).alias("p"))


# ---------------------------------------------------------------- alignments


@query("s02_library_size", oracle("SELECT * FROM lib", "lib"))
def _(spark, d):
    return A.library_sizes(X.aln(spark, d))


@query("p03_mapq_filter", oracle("SELECT sample_id, contig, strand, CAST(count(*) AS BIGINT) AS n FROM aln WHERE mapq >= 10 GROUP BY ALL", "aln"))
def _(spark, d):
    return X.aln(spark, d).where("mapq >= 10").groupBy("sample_id", "contig", "strand").agg(F.count("*").alias("n"))


@query("p04_perfect", oracle("SELECT sample_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT qname) AS BIGINT) AS reads FROM aln WHERE nm = 0 GROUP BY ALL", "aln"))
def _(spark, d):
    return X.aln(spark, d).where("nm = 0").groupBy("sample_id").agg(F.count("*").alias("n"), F.count_distinct("qname").alias("reads"))


@query("p08_length_filter", oracle("SELECT grp, contig, CAST(count(*) AS BIGINT) AS n FROM aln WHERE end0 - start0 BETWEEN 18 AND 30 GROUP BY ALL", "aln"))
def _(spark, d):
    return X.aln(spark, d).where("end0 - start0 between 18 and 30").groupBy("grp", "contig").agg(F.count("*").alias("n"))


@query("p17_proper_pairs", oracle("SELECT sample_id, qname, min(contig) AS contig FROM aln GROUP BY ALL HAVING bool_or(mate = 1) AND bool_or(mate = 0) AND count(DISTINCT contig) = 1", "aln"))
def _(spark, d):
    return A.proper_pairs(X.aln(spark, d))


_BEST = "SELECT sample_id, nm, CAST(count(*) AS BIGINT) AS reads FROM (SELECT sample_id, qname, min(nm) AS nm FROM aln GROUP BY ALL) GROUP BY ALL"


@query("a02_mismatch_bins", oracle("SELECT sample_id, nm, reads, CAST(sum(reads) OVER (PARTITION BY sample_id ORDER BY nm) AS BIGINT) AS reads_le FROM b", "aln", b=_BEST))
def _(spark, d):
    return A.best_mismatches(X.aln(spark, d))


@query("a03_mismatch_long", oracle("""SELECT sample_id, category, n AS reads, round(100 * CAST(n AS DOUBLE) / sum_, 6) AS percent FROM (SELECT sample_id, concat('best_nm_', CAST(nm AS STRING)) AS category, reads AS n, CAST(sum(reads) OVER (PARTITION BY sample_id) AS BIGINT) AS sum_ FROM b
UNION ALL SELECT sample_id, concat('best_nm_le_', CAST(nm AS STRING)), CAST(sum(reads) OVER (PARTITION BY sample_id ORDER BY nm) AS BIGINT), CAST(sum(reads) OVER (PARTITION BY sample_id) AS BIGINT) FROM b)""", "aln", b=_BEST))
def _(spark, d):
    b = A.best_mismatches(X.aln(spark, d)).withColumn("sum_", F.sum("reads").over(Window.partitionBy("sample_id")))
    long = b.select("sample_id", "sum_", F.explode(F.array(F.struct(F.concat(F.lit("best_nm_"), F.col("nm").cast("string")).alias("category"), F.col("reads").alias("n")), F.struct(F.concat(F.lit("best_nm_le_"), F.col("nm").cast("string")).alias("category"), F.col("reads_le").alias("n")))).alias("x"))
    return long.select("sample_id", "x.category", F.col("x.n").alias("reads"), r6(100 * F.col("x.n").cast("double") / F.col("sum_")).alias("percent"))


_W = {"fractional": "1.0::DOUBLE / count(*) OVER (PARTITION BY sample_id, qname)", "all": "1.0::DOUBLE", "unique": "CASE WHEN count(*) OVER (PARTITION BY sample_id, qname) = 1 THEN 1.0::DOUBLE ELSE 0 END"}
for _mode, _w in _W.items():

    @query(f"a04_multihit_{_mode}", oracle("SELECT sample_id, contig, strand, round(sum(w), 6) AS reads FROM x GROUP BY ALL", "aln", x=f"SELECT *, {_w} AS w FROM aln WHERE nm = 0"))
    def _(spark, d, mode=_mode):
        return A.weighted(X.aln(spark, d), mode).groupBy("sample_id", "contig", "strand").agg(r6(A.in_reads(F.sum("w"))).alias("reads"))


# every third read has 13 places and more: (qname div 48) joins the reads of 48 orders
_MANY = "SELECT * REPLACE (CASE WHEN qname % 3 = 0 THEN qname // 48 ELSE qname END AS qname) FROM aln WHERE nm = 0"


@query("a04_many_places", oracle("SELECT sample_id, strand, CAST(max(n) AS BIGINT) AS most_places, round(sum(1.0::DOUBLE / n), 6) AS reads, CAST(count(DISTINCT qname) FILTER (WHERE n > 12) AS BIGINT) AS names_of_many FROM x GROUP BY ALL", "aln", x=f"SELECT *, count(*) OVER (PARTITION BY sample_id, qname) AS n FROM ({_MANY})"))
def _(spark, d):
    a = X.aln(spark, d).withColumn("qname", F.expr("CASE WHEN qname % 3 = 0 THEN qname div 48 ELSE qname END"))
    g = A.weighted(a).groupBy("sample_id", "strand")
    return g.agg(F.max("n_places").alias("most_places"), r6(A.in_reads(F.sum("w"))).alias("reads"), F.count_distinct(F.when(F.col("n_places") > 12, F.col("qname"))).alias("names_of_many"))


_STEPS = "SELECT {k}, pos, CAST(sum(d) AS BIGINT) AS d FROM (SELECT {k}, start0 AS pos, {w} AS d FROM {t} UNION ALL SELECT {k}, end0, -({w}) FROM {t}) GROUP BY ALL HAVING sum(d) <> 0"
_LANE = "sample_id, contig, strand"


@query("a05_depth", oracle("SELECT sample_id, contig, strand, pos, CAST(sum(d) OVER (PARTITION BY sample_id, contig, strand ORDER BY pos) AS BIGINT) AS depth FROM steps", "aln", steps=_STEPS.format(k=_LANE, w="1", t="aln")))
def _(spark, d):
    return A.depth(X.aln(spark, d))


_BASES = f"SELECT sample_id, contig, strand, w, unnest(range(start0, end0)) AS pos FROM (SELECT *, {_W['fractional']} AS w FROM aln WHERE nm = 0)"


@query("a06_hit_summary", oracle("""SELECT sample_id, contig, round(sense, 6) AS sense_reads, round(antisense, 6) AS antisense_reads, round(total, 6) AS total_reads, round(coalesce(ps, 0), 6) AS peak_sense, round(coalesce(pa, 0), 6) AS peak_antisense, CAST(covered AS BIGINT) AS covered_bases FROM (SELECT sample_id, contig, coalesce(sum(w) FILTER (WHERE strand = 'sense'), 0) AS sense,
coalesce(sum(w) FILTER (WHERE strand = 'antisense'), 0) AS antisense, sum(w) AS total FROM x GROUP BY ALL) r JOIN (SELECT sample_id, contig, max(u) FILTER (WHERE strand = 'sense') AS ps, max(u) FILTER (WHERE strand = 'antisense') AS pa, count(DISTINCT pos) AS covered
FROM (SELECT sample_id, contig, strand, pos, sum(w) AS u FROM bases GROUP BY ALL) GROUP BY ALL) p USING (sample_id, contig)""", "aln", x=f"SELECT *, {_W['fractional']} AS w FROM aln WHERE nm = 0", bases=_BASES))
def _(spark, d):
    return A.hit_summary(X.aln(spark, d)).select("sample_id", "contig", *(r6(F.col(c)).alias(c) for c in ("sense_reads", "antisense_reads", "total_reads", "peak_sense", "peak_antisense")), "covered_bases")


_UNION = "SELECT grp, contig, strand, min(start0) AS start0, max(end0) AS end0 FROM (SELECT *, sum(n) OVER (PARTITION BY grp, contig, strand ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start0 <= max(end0) OVER (PARTITION BY grp, contig, strand ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM part_)) GROUP BY grp, contig, strand, g"


@query("a08_covered_blocks", oracle(_UNION, "aln", part_="SELECT * FROM aln WHERE qname % 40 = 1"))
def _(spark, d):
    # the intervals of every fortieth order leave gaps; all intervals of a lane are one block
    return A.axis.union_of(X.aln(spark, d).where("qname % 40 = 1"), ("grp", "contig", "strand"), span=256)


@query("a08_merge_blocks", oracle("SELECT sample_id, qname, contig, min(start0) AS start0, max(end0) AS end0 FROM (SELECT *, sum(n) OVER (PARTITION BY sample_id, qname, contig ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start0 <= max(end0) OVER (PARTITION BY sample_id, qname, contig ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM aln)) GROUP BY sample_id, qname, contig, g", "aln"))
def _(spark, d):
    return A.merge_intervals(X.aln(spark, d), ("sample_id", "qname", "contig"), A.PART_ROWS)


_DENSE = "SELECT sample_id, contig, pos, coalesce(sum(CASE WHEN strand = 'sense' THEN 1 END), 0) AS s, coalesce(sum(CASE WHEN strand = 'antisense' THEN 1 END), 0) AS a FROM (SELECT sample_id, contig, strand, unnest(range(start0, end0)) AS pos FROM aln) GROUP BY ALL"
_WIN = "SELECT sample_id, contig, w * 50 AS start0, CAST(sum(s) AS BIGINT) AS s, CAST(sum(a) AS BIGINT) AS a, CAST(sum(least(s, a)) AS BIGINT) AS duplex, CAST(sum(CASE WHEN s > 0 AND a > 0 THEN 1 ELSE 0 END) AS BIGINT) AS two_sided FROM dense, (SELECT unnest(range(0, 37)) AS w) WHERE pos >= w * 50 AND pos < w * 50 + 200 GROUP BY sample_id, contig, w"
_SCORES = """SELECT *, CASE WHEN s + a > 0 THEN 200.0 * duplex / (s + a) ELSE 0 END AS balance, 100.0 * two_sided / 200 AS bidir FROM win"""
_RANKED = """SELECT r.contig, r.start0, r.dn, r.score, greatest(CASE WHEN r.ms > 0 THEN 1 - coalesce(o.ms, 0) / r.ms ELSE 0 END, CASE WHEN r.ma > 0 THEN 1 - coalesce(o.ma, 0) / r.ma ELSE 0 END) AS max_red
FROM (SELECT * FROM full_ WHERE sample_id = 's1') r LEFT JOIN (SELECT * FROM full_ WHERE sample_id = 's3') o USING (contig, start0) WHERE r.duplex > 0 AND r.dn > 0"""
_FULL = "SELECT *, balance * sqrt(bidir / 100) AS dn, CAST(s AS DOUBLE) * 1e6 / n_reads / 200 AS ms, CAST(a AS DOUBLE) * 1e6 / n_reads / 200 AS ma, CAST(duplex AS DOUBLE) * 1e6 / n_reads / 200 * balance * sqrt(bidir / 100) / 100 AS score FROM sc JOIN lib USING (sample_id)"


def _scored(spark, d):
    a = X.aln(spark, d)
    sums = A.prefix_windows(a, CONTIG_LENGTH, 200, 50).join(F.broadcast(A.library_sizes(a).select("sample_id", "n_reads")), "sample_id")
    return A.window_scores(sums, F.lit(1e6) / F.col("n_reads"))


@query("a09_window_metrics", oracle("SELECT sample_id, contig, CAST(start0 AS INT) AS start0, s, a, duplex, two_sided, round(balance, 6) AS balance, round(dn, 6) AS dsrnaness, round(score, 6) AS score FROM full_", "lib", dense=_DENSE, win=_WIN, sc=_SCORES, full_=_FULL))
def _(spark, d):
    return _scored(spark, d).select("sample_id", "contig", F.col("start0").cast("int").alias("start0"), "s", "a", "duplex", "two_sided", *(r6(F.col(c)).alias(c) for c in ("balance", "dsrnaness", "score")))


def _ranked(spark, d):
    return A.compared_windows(_scored(spark, d), "s1", "s3", 0.2)


@query("m02_comparison_rank", oracle("SELECT contig, CAST(start0 AS INT) AS start0, round(max_red, 6) AS max_reduction, round(score * (1 + greatest(0, max_red)), 6) AS rank_score FROM rk WHERE max_red >= 0.2 AND score * (1 + greatest(0, max_red)) > 0", "lib", dense=_DENSE, win=_WIN, sc=_SCORES, full_=_FULL, rk=_RANKED))
def _(spark, d):
    return _ranked(spark, d).select("contig", F.col("start0").cast("int").alias("start0"), r6(F.col("max_reduction")).alias("max_reduction"), r6(F.col("rank_score")).alias("rank_score"))


_CAND = "SELECT *, row_number() OVER (PARTITION BY contig ORDER BY rank_score DESC, start0) AS i FROM (SELECT contig, CAST(start0 AS INT) AS start0, round(score * (1 + greatest(0, max_red)), 6) AS rank_score FROM rk WHERE max_red >= 0.2 AND score * (1 + greatest(0, max_red)) > 0) WHERE rank_score > 0"
_CHOSEN = """SELECT contig, 0 AS i, CAST([] AS INT[]) AS kept FROM (SELECT DISTINCT contig FROM cand) UNION ALL SELECT c.contig, CAST(c.i AS INT), CASE WHEN len(list_filter(kept, lambda x: abs(x - c.start0) < 100)) = 0 THEN list_append(kept, c.start0) ELSE kept END
FROM chosen JOIN cand c ON c.contig = chosen.contig AND c.i = chosen.i + 1"""
_KEPT = "SELECT contig, unnest(kept) AS start0 FROM (SELECT contig, arg_max(kept, i) AS kept FROM chosen GROUP BY contig)"


def _candidates(spark, d):
    r = _ranked(spark, d).select("contig", F.col("start0").cast("int").alias("start0"), "width", r6(F.col("rank_score")).alias("rank_score"))
    return r.where("rank_score > 0")


@query("t02_nonredundant", recursive(oracle("SELECT contig, start0, 200 AS width, rank_score FROM cand JOIN kept_ USING (contig, start0)", "lib", dense=_DENSE, win=_WIN, sc=_SCORES, full_=_FULL, rk=_RANKED, cand=_CAND, chosen=_CHOSEN, kept_=_KEPT)))
def _(spark, d):
    return A.non_overlapping(_candidates(spark, d))


@query("m01_window_scan", recursive(oracle("SELECT contig, start0, CAST(row_number() OVER (ORDER BY rank_score DESC, contig, start0) AS INT) AS rank, rank_score, 200 AS width FROM cand JOIN kept_ USING (contig, start0) ORDER BY rank LIMIT 100", "lib", dense=_DENSE, win=_WIN, sc=_SCORES, full_=_FULL, rk=_RANKED, cand=_CAND, chosen=_CHOSEN, kept_=_KEPT)))
def _(spark, d):
    return A.best_windows(_candidates(spark, d))


_DENSE_ALL = "SELECT l.contig, l.strand, p AS pos, coalesce(n, 0) AS depth FROM (SELECT DISTINCT contig, strand FROM aln) l CROSS JOIN (SELECT unnest(range(0, 2000)) AS p) LEFT JOIN (SELECT contig, strand, pos, count(*) AS n FROM (SELECT contig, strand, unnest(range(start0, end0)) AS pos FROM aln) GROUP BY ALL) x ON x.contig = l.contig AND x.strand = l.strand AND x.pos = p"


@query("w02_moving_average", oracle("SELECT contig, strand, CAST(pos AS INT) AS pos, CAST(sum(depth) OVER (PARTITION BY contig, strand ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS BIGINT) AS window_sum FROM dn", "aln", dn=_DENSE_ALL))
def _(spark, d):
    """The report has a row for each place of a contig, those without depth too; the sums come from pieces."""
    keys = ("contig", "strand")
    return A.at_places(A.moving_average(X.aln(spark, d), 25, keys, CONTIG_LENGTH), X.aln(spark, d).select(*keys).distinct(), keys, CONTIG_LENGTH, "window_sum")


_SMOOTH = """SELECT grp, contig, pos, avg(s) AS s, avg(a) AS a FROM (SELECT grp, sample_id, contig, pos, sum(x.s) OVER w / 25 AS s, sum(x.a) OVER w / 25 AS a FROM (SELECT l.grp, l.sample_id, c.contig, p AS pos, coalesce(s, 0) * 1e6 / n_reads AS s, coalesce(a, 0) * 1e6 / n_reads AS a
FROM lib l CROSS JOIN (SELECT DISTINCT contig FROM aln) c CROSS JOIN (SELECT unnest(range(0, 2000)) AS p) LEFT JOIN dense d ON d.sample_id = l.sample_id AND d.contig = c.contig AND d.pos = p) x WINDOW w AS (PARTITION BY sample_id, contig ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) GROUP BY ALL"""


@query("a34_smoothed_contigs", oracle("SELECT grp, contig, 2000 AS length, round(avg(s), 6) AS mean_sense, round(avg(a), 6) AS mean_antisense, round(avg(least(s, a)), 6) AS mean_duplex, round(200 * sum(least(s, a)) / sum(s + a), 6) AS balance FROM sm GROUP BY grp, contig HAVING sum(s + a) > 0", "lib", dense=_DENSE, sm=_SMOOTH))
def _(spark, d):
    a = X.aln(spark, d)
    lengths = a.select("contig").distinct().withColumn("length", F.lit(CONTIG_LENGTH))
    out = A.smoothed_contigs(a, A.library_sizes(a), lengths)
    return out.select("grp", "contig", "length", *(r6(F.col(c)).alias(c) for c in ("mean_sense", "mean_antisense", "mean_duplex", "balance")))


_AREA = "SELECT sample_id, contig, strand, bin, CAST(sum(least(end0, bin * 250 + 250) - greatest(start0, bin * 250)) AS BIGINT) AS area FROM (SELECT *, unnest(range(start0 // 250, (end0 - 1) // 250 + 1)) AS bin FROM aln) GROUP BY ALL"


@query("j04_bin_area", oracle("SELECT sample_id, contig, strand, CAST(bin AS INT) AS bin, area FROM area", "aln", area=_AREA))
def _(spark, d):
    return A.bin_area(X.aln(spark, d), 250)


_MEAN = "SELECT contig, bin, sum(CASE WHEN strand = 'sense' THEN area * 1e6 / n_reads ELSE 0 END) / 3 AS s, sum(CASE WHEN strand = 'antisense' THEN area * 1e6 / n_reads ELSE 0 END) / 3 AS a FROM area JOIN lib USING (sample_id) GROUP BY ALL"


@query("a11_genome_bins", oracle("SELECT contig, CAST(bin AS INT) AS bin, round(s, 6) AS sense_area, round(a, 6) AS antisense_area, round(b, 6) AS balance, round(b * (100 * dd / (dd + 100)) / 100, 6) AS candidate_score FROM (SELECT *, CASE WHEN s + a > 0 THEN 200 * least(s, a) / (s + a) ELSE 0 END AS b, least(s, a) / 250 AS dd FROM m)", "lib", area=_AREA, m=_MEAN))
def _(spark, d):
    a = X.aln(spark, d)
    out = A.genome_bin_scores(A.strand_bins(a, A.library_sizes(a).select("sample_id", "n_reads"), 250, ("contig",)), 250)
    return out.select("contig", "bin", *(r6(F.col(c)).alias(c) for c in ("sense_area", "antisense_area", "balance", "candidate_score")))


_MEAN_G = "SELECT grp, contig, bin, sum(CASE WHEN strand = 'sense' THEN area * 1e6 / n_reads ELSE 0 END) / n AS s, sum(CASE WHEN strand = 'antisense' THEN area * 1e6 / n_reads ELSE 0 END) / n AS a FROM area JOIN lib USING (sample_id) JOIN (SELECT grp, count(*) AS n FROM lib GROUP BY ALL) USING (grp) WHERE grp = 'g1' GROUP BY grp, contig, bin, n"


@query("a12_srna_bins", oracle("SELECT contig, CAST(bin AS INT) AS bin, round(s * a, 3) AS product, round(CASE WHEN s + a > 0 THEN 200 * least(s, a) / (s + a) ELSE 0 END, 6) AS balance, round(least(s, a) / 250, 6) AS duplex_depth FROM m", "lib", area=_AREA, m=_MEAN_G))
def _(spark, d):
    a = X.aln(spark, d).where("grp = 'g1'")
    b = A.genome_bin_scores(A.strand_bins(a, A.library_sizes(a).select("sample_id", "n_reads"), 250, ("contig",)), 250)
    return b.select("contig", "bin", F.round(F.col("sense_area") * F.col("antisense_area"), 3).alias("product"), r6(F.col("balance")).alias("balance"), r6(F.col("duplex_depth")).alias("duplex_depth"))


_TOP_BINS = "SELECT contig, bin, greatest(0, bin * 250 - 500) AS cs, least(2000, bin * 250 + 750) AS ce FROM (SELECT contig, bin, row_number() OVER (ORDER BY sum(area) DESC, contig, bin) AS r FROM area GROUP BY contig, bin) WHERE r <= 20"


@query("j05_context_overlap", oracle("SELECT t.contig, CAST(t.bin AS INT) AS bin, strand, CAST(count(*) AS BIGINT) AS n, CAST(sum(least(end0, ce) - greatest(start0, cs)) AS BIGINT) AS bases FROM aln JOIN tb t ON aln.contig = t.contig AND start0 < ce AND end0 > cs GROUP BY ALL", "aln", area=_AREA, tb=_TOP_BINS))
def _(spark, d):
    a = X.aln(spark, d)
    top = A.bin_area(a, 250).groupBy("contig", "bin").agg(F.sum("area").alias("n")).orderBy(F.desc("n"), "contig", "bin").limit(20)
    ctx = top.select("contig", "bin", F.greatest(F.lit(0), F.col("bin") * 250 - 500).alias("cs"), F.least(F.lit(CONTIG_LENGTH), F.col("bin") * 250 + 750).alias("ce"))
    both = a.join(F.broadcast(ctx), "contig").where("start0 < ce and end0 > cs")  # twenty rows: the top-k report bounds them
    return both.groupBy("contig", "bin", "strand").agg(F.count("*").alias("n"), F.sum(F.least("end0", "ce") - F.greatest("start0", "cs")).alias("bases"))


_PER = "SELECT sample_id, grp, contig, sum(CASE WHEN strand = 'sense' THEN 1 ELSE 0 END) * 1e6 / min(n_reads) AS s, sum(CASE WHEN strand = 'antisense' THEN 1 ELSE 0 END) * 1e6 / min(n_reads) AS a FROM aln JOIN (SELECT sample_id, n_reads FROM lib) USING (sample_id) GROUP BY ALL"
_COVER = "SELECT grp, contig, count(DISTINCT CASE WHEN strand = 'sense' THEN pos END) AS sc, count(DISTINCT CASE WHEN strand = 'antisense' THEN pos END) AS ac FROM (SELECT grp, contig, strand, unnest(range(start0, end0)) AS pos FROM aln) GROUP BY ALL"


@query("a13_srna_contig_summary", oracle("SELECT grp, contig, CAST(count(*) AS BIGINT) AS replicates, round(avg(s), 6) AS sense_mean, round(coalesce(stddev_samp(s) / sqrt(count(*)), 0), 6) AS sense_sem, round(avg(a), 6) AS antisense_mean, round(coalesce(stddev_samp(a) / sqrt(count(*)), 0), 6) AS antisense_sem, CAST(min(sc) AS BIGINT) AS sense_covered, CAST(min(ac) AS BIGINT) AS antisense_covered FROM per JOIN cover USING (grp, contig) GROUP BY grp, contig", "lib", per=_PER, cover=_COVER))
def _(spark, d):
    a = X.aln(spark, d)
    out = A.contig_group_summary(a, A.library_sizes(a))
    return out.select("grp", "contig", "replicates", *(r6(F.col(c)).alias(c) for c in ("sense_mean", "sense_sem", "antisense_mean", "antisense_sem")), "sense_covered", "antisense_covered")


@query("a16_length_grouping_sets", oracle("SELECT sample_id, end0 - start0 AS length, strand, contig, CAST(count(*) AS BIGINT) AS n FROM aln GROUP BY GROUPING SETS ((sample_id, length, strand), (sample_id, length, strand, contig))", "aln"))
def _(spark, d):
    a = X.aln(spark, d).withColumn("length", F.col("end0") - F.col("start0"))
    return a.groupingSets([["sample_id", "length", "strand"], ["sample_id", "length", "strand", "contig"]], "sample_id", "length", "strand", "contig").agg(F.count("*").alias("n"))


@query("a17_sample_summary", oracle("SELECT sample_id, grp, CAST(count(*) AS BIGINT) AS mapped, CAST(count(*) FILTER (WHERE nm = 0) AS BIGINT) AS perfect, CAST(count(*) FILTER (WHERE end0 - start0 = 21) AS BIGINT) AS focus, round(100.0 * count(*) FILTER (WHERE nm = 0) / count(*), 6) AS perfect_percent FROM aln GROUP BY ALL", "aln"))
def _(spark, d):
    g = X.aln(spark, d).groupBy("sample_id", "grp").agg(F.count("*").alias("mapped"), F.count_if(F.expr("nm = 0")).alias("perfect"), F.count_if(F.expr("end0 - start0 = 21")).alias("focus"))
    return g.withColumn("perfect_percent", r6(F.lit(100.0) * F.col("perfect") / F.col("mapped")))


_UNIQ = "SELECT grp, sample_id, contig, start0, end0, strand, nm, CAST(count(*) AS BIGINT) AS n FROM aln GROUP BY ALL"


@query("a18_unique_srna", oracle("SELECT grp, sample_id, contig, start0, end0, strand, nm, n, round(CAST(n AS DOUBLE) * 1e6 / n_reads, 6) AS cpm, round(100.0 * n / sum(n) OVER (PARTITION BY sample_id), 6) AS share FROM u JOIN (SELECT sample_id, n_reads FROM lib) USING (sample_id)", "lib", u=_UNIQ))
def _(spark, d):
    a = X.aln(spark, d)
    u = a.groupBy("grp", "sample_id", "contig", "start0", "end0", "strand", "nm").agg(F.count("*").alias("n"))
    # a sample's total is its library, so no window over the whole sample is needed
    u = u.join(F.broadcast(A.library_sizes(a).select("sample_id", "n_reads")), "sample_id")
    return u.withColumn("cpm", r6(F.col("n").cast("double") * 1e6 / F.col("n_reads"))).withColumn("share", r6(F.lit(100.0) * F.col("n") / F.col("n_reads"))).drop("n_reads")


@query("a19_export_topn", oracle("""SELECT grp, contig, start0, end0, strand, nm, round(mean_, 6) AS mean_cpm, CAST(k AS BIGINT) AS present, samples FROM (SELECT *, row_number() OVER (ORDER BY round(mean_, 6) DESC, grp, contig, start0, end0, strand, nm) AS r FROM
(SELECT grp, contig, start0, end0, strand, nm, sum(CAST(n AS DOUBLE) * 1e6 / n_reads) / min(size_) AS mean_, count(*) AS k, string_agg(sample_id, ';' ORDER BY sample_id) AS samples FROM u JOIN (SELECT sample_id, n_reads FROM lib) USING (sample_id) JOIN (SELECT grp, count(*) AS size_ FROM lib GROUP BY ALL) USING (grp) GROUP BY ALL)) WHERE r <= 20""", "lib", u=_UNIQ))
def _(spark, d):
    a = X.aln(spark, d)
    lib = A.library_sizes(a)
    u = a.groupBy("grp", "sample_id", "contig", "start0", "end0", "strand", "nm").agg(F.count("*").alias("n")).join(F.broadcast(lib.select("sample_id", "n_reads")), "sample_id").join(F.broadcast(lib.groupBy("grp").agg(F.count("*").alias("size_"))), "grp")
    key = ["grp", "contig", "start0", "end0", "strand", "nm"]
    g = u.groupBy(*key).agg(r6(F.sum(F.col("n").cast("double") * 1e6 / F.col("n_reads")) / F.min("size_")).alias("mean_cpm"), F.count("*").alias("present"), F.array_join(F.sort_array(F.collect_list("sample_id")), ";").alias("samples"))
    return g.orderBy(F.desc("mean_cpm"), *key).limit(20)


@query("a20_best_stratum", oracle("SELECT sample_id, qname, nm, string_agg(DISTINCT contig, ';' ORDER BY contig) AS contigs, string_agg(concat(contig, ':', CAST(start0 + 1 AS STRING), '-', CAST(end0 AS STRING), ':', strand, ':', CAST(nm AS STRING)), ';' ORDER BY contig, start0, end0, strand) AS places FROM (SELECT *, rank() OVER (PARTITION BY sample_id, qname ORDER BY nm) AS r FROM aln) WHERE r = 1 GROUP BY sample_id, qname, nm", "aln"))
def _(spark, d):
    return A.best_stratum(X.aln(spark, d)).drop("hits")


@query("a34_contig_summary", oracle("SELECT grp, contig, CAST(sum(s + a) AS BIGINT) AS total, CAST(sum(least(s, a)) AS BIGINT) AS duplex, round(200.0 * sum(least(s, a)) / sum(s + a), 6) AS balance FROM dg GROUP BY ALL", "aln", dg=_DENSE.replace("sample_id", "grp")))
def _(spark, d):
    sums = A.prefix_windows(X.aln(spark, d), CONTIG_LENGTH, CONTIG_LENGTH, CONTIG_LENGTH, ("grp", "contig"))
    return sums.select("grp", "contig", (F.col("s") + F.col("a")).alias("total"), "duplex", r6(F.lit(200.0) * F.col("duplex") / (F.col("s") + F.col("a"))).alias("balance"))


@query("u10_counter_merge", oracle("SELECT contig, CAST(sum(v) AS BIGINT) AS v FROM (SELECT contig, count(*) FILTER (WHERE nm = 0) AS v FROM aln WHERE sample_id = 's1' GROUP BY 1 UNION ALL SELECT contig, count(*) FILTER (WHERE nm = 1) FROM aln WHERE sample_id = 's2' GROUP BY 1) GROUP BY 1 HAVING sum(v) > 0", "aln"))
def _(spark, d):
    a = X.aln(spark, d)
    one = a.where("sample_id = 's1'").groupBy("contig").agg(F.count_if(F.expr("nm = 0")).alias("v"))
    two = a.where("sample_id = 's2'").groupBy("contig").agg(F.count_if(F.expr("nm = 1")).alias("v"))
    return one.unionByName(two).groupBy("contig").agg(F.sum("v").alias("v")).where("v > 0")


@query("u06_removed_except", oracle("SELECT DISTINCT contig, start0, strand FROM aln EXCEPT SELECT contig, start0, strand FROM aln WHERE nm = 0", "aln"))
def _(spark, d):
    a = X.aln(spark, d).select("contig", "start0", "strand", "nm")
    return a.drop("nm").distinct().join(a.where("nm = 0").drop("nm").distinct(), ["contig", "start0", "strand"], "left_anti")


# ---------------------------------------------------------------- matching

_KM = "SELECT contig, i AS pos, substring(seq, i + 1, 21) AS kmer FROM (SELECT contig, seq, unnest(range(0, length(seq) - 20)) AS i FROM refseq WHERE length(seq) >= 21)"
_BOTH = "SELECT id, sequence, sequence AS kmer, '+' AS direction FROM bkm UNION ALL SELECT id, sequence, reverse(translate(sequence, 'ACGTN', 'TGCAN')), '-' FROM bkm WHERE reverse(translate(sequence, 'ACGTN', 'TGCAN')) <> sequence"


@query("j10_exact_annotations", oracle("SELECT id, sequence, contig, CAST(pos + 1 AS INT) AS start_1based, CAST(pos + 21 AS INT) AS end_1based, direction FROM both_ JOIN km USING (kmer)", "bkm", "refseq", both_=_BOTH, km=_KM))
def _(spark, d):
    return M.exact_annotations(X.bench_kmers(spark, d), X.refseq(spark, d), 21)


@query("j01_map_v0", oracle("SELECT DISTINCT sequence, contig, CAST(pos AS INT) AS start0, CASE direction WHEN '+' THEN 'sense' ELSE 'antisense' END AS strand, 0 AS nm FROM both_ JOIN km USING (kmer)", "bkm", "refseq", both_=_BOTH.replace(" WHERE reverse(translate(sequence, 'ACGTN', 'TGCAN')) <> sequence", ""), km=_KM))
def _(spark, d):
    return M.ungapped_mapping(X.bench_kmers(spark, d), X.refseq(spark, d), 21, 0)


_V1 = """SELECT DISTINCT b.sequence, km.contig, CAST(km.pos AS INT) AS start0, CASE b.direction WHEN '+' THEN 'sense' ELSE 'antisense' END AS strand, CAST(hamming(b.kmer, km.kmer) AS INT) AS nm
FROM (SELECT *, 0 AS h, substring(kmer, 1, 10) AS seed FROM both_ UNION ALL SELECT *, 1, substring(kmer, 11, 11) FROM both_) b JOIN (SELECT *, 0 AS h, substring(kmer, 1, 10) AS seed FROM km UNION ALL SELECT *, 1, substring(kmer, 11, 11) FROM km) km USING (h, seed) WHERE hamming(b.kmer, km.kmer) <= 1"""


@query("j01_map_v1", oracle("SELECT * FROM v1", "bkm", "refseq", both_=_BOTH.replace(" WHERE reverse(translate(sequence, 'ACGTN', 'TGCAN')) <> sequence", ""), km=_KM, v1=_V1))
def _(spark, d):
    return M.ungapped_mapping(X.bench_kmers(spark, d), X.refseq(spark, d), 21, 1)


def _mapped_sql(mismatches: int, parts: int, whole: int) -> str:
    """Places of the 21-mers with some mismatches: choices of ``whole`` of ``parts`` pieces are looked up, then all letters are compared."""
    edges = [21 * k // parts for k in range(parts + 1)]
    pieces = [f"substring(kmer, {a + 1}, {b - a})" for a, b in zip(edges, edges[1:], strict=False)]
    seeds = "unnest([" + ", ".join(f"concat('{k}|', {', '.join(c)})" for k, c in enumerate(combinations(pieces, whole))) + "]) AS seed"
    return f"""SELECT DISTINCT b.sequence, km.contig, CAST(km.pos AS INT) AS start0, CASE b.direction WHEN '+' THEN 'sense' ELSE 'antisense' END AS strand, CAST(hamming(b.kmer, km.kmer) AS INT) AS nm
FROM (SELECT *, {seeds} FROM both_) b JOIN (SELECT *, {seeds} FROM km) km USING (seed) WHERE hamming(b.kmer, km.kmer) <= {mismatches}"""


_STRANDS = _BOTH.replace(" WHERE reverse(translate(sequence, 'ACGTN', 'TGCAN')) <> sequence", "")
for _k, (_parts, _whole) in {2: (4, 2), 3: (5, 2)}.items():

    @query(f"j01_map_v{_k}", oracle("SELECT * FROM v", "bkm", "refseq", both_=_STRANDS, km=_KM, v=_mapped_sql(_k, _parts, _whole)))
    def _(spark, d, k=_k):
        return M.ungapped_mapping(X.bench_kmers(spark, d), X.refseq(spark, d), 21, k, chunk=1 << 12)


@query("j01_best_stratum", oracle("SELECT sequence, contig, start0, strand, nm FROM (SELECT *, min(nm) OVER (PARTITION BY sequence) AS least FROM v) WHERE nm = least", "bkm", "refseq", both_=_STRANDS, km=_KM, v=_mapped_sql(2, 4, 2)))
def _(spark, d):
    return M.best_mapping(X.bench_kmers(spark, d), X.refseq(spark, d), 21, 2)


@query("j09_control_anti", oracle("SELECT id, sequence FROM bkm WHERE sequence NOT IN (SELECT kmer FROM km)", "bkm", "refseq", km=_KM))
def _(spark, d):
    return M.not_found(X.bench_kmers(spark, d), X.refseq(spark, d), 21)


_REC = "SELECT DISTINCT substring(seq, s, n) AS sequence FROM (SELECT seq, n, unnest(range(1, length(seq) - n + 2)) AS s FROM bench, (SELECT unnest(range(18, 25)) AS n) WHERE length(seq) >= n)"
_INNER = "SELECT parent, substring(parent, i, k) AS sequence, min(i) AS i FROM (SELECT parent, k, unnest(range(1, length(parent) - k + 2)) AS i FROM (SELECT sequence AS parent, unnest(range(18, length(sequence))) AS k FROM rec)) GROUP BY ALL"


def _records(spark, d):
    """Distinct pieces of 18 to 24 letters at every place of the encoded benchmark; their order is that of their letters."""
    s = X.refseq(spark, d, "benchmark", "item_id", "b").where("length(seq) >= 18")
    parts = F.expr("flatten(transform(sequence(18, least(24, length(seq))), n -> transform(sequence(1, length(seq) - n + 1), s -> substring(seq, s, n))))")
    return s.select(F.explode(parts).alias("sequence")).distinct().select("sequence", F.col("sequence").alias("idx"), F.concat(F.lit("r_"), "sequence").alias("id"))


@query("j11_contained", oracle("SELECT concat('r_', sequence) AS id, sequence, concat('r_', parent) AS parent_id, CAST(length(parent) AS INT) AS parent_length, CAST(i AS INT) AS start_1based, more_parents FROM (SELECT *, count(*) OVER (PARTITION BY sequence, length(parent)) - 1 AS more_parents, row_number() OVER (PARTITION BY sequence ORDER BY length(parent), parent) AS k FROM inner_ JOIN rec USING (sequence)) WHERE k = 1", "bench", rec=_REC, inner_=_INNER))
def _(spark, d):
    return M.contained(_records(spark, d), 18, 24)


@query("a31_first_of_duplicates", oracle("SELECT sequence, min_by(id, id) AS id, CAST(count(*) AS BIGINT) AS n FROM bkm GROUP BY sequence", "bkm"))
def _(spark, d):
    return M.first_of_duplicates(X.bench_kmers(spark, d).withColumn("idx", F.col("id"))).select("sequence", "id", "n")


# ---------------------------------------------------------------- cleavage and targets

_CAT = "SELECT *, CASE WHEN count = 1 THEN 4 WHEN count = top AND tops = 1 THEN 0 WHEN count = top THEN 1 WHEN count > mean THEN 2 ELSE 3 END AS category FROM (SELECT *, count(*) FILTER (WHERE count = top) OVER (PARTITION BY sample_id, transcript) AS tops FROM (SELECT *, max(count) OVER (PARTITION BY sample_id, transcript) AS top, avg(count) OVER (PARTITION BY sample_id, transcript) AS mean FROM dens))"


@query("a23_density", oracle("SELECT * FROM dens", "dens"))
def _(spark, d):
    return X.dens(spark, d)


@query("a24_categories", oracle("SELECT sample_id, transcript, pos, count, category FROM cat", "dens", cat=_CAT))
def _(spark, d):
    return E.categories(X.dens(spark, d))


@query("a25_totals", oracle("SELECT category, CAST(count(*) AS BIGINT) AS positions FROM cat GROUP BY ALL", "dens", cat=_CAT))
def _(spark, d):
    return E.category_totals(E.categories(X.dens(spark, d)))


_CLEAVE = "SELECT hit_id, query, transcript, q, pos, total, best_category FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY total DESC, abs(q - 10), q) AS r FROM (SELECT hit_id, query, transcript, 9 AS q, site9 AS pos FROM hits UNION ALL SELECT hit_id, query, transcript, 10, site10 FROM hits UNION ALL SELECT hit_id, query, transcript, 11, site11 FROM hits) JOIN (SELECT transcript, pos, CAST(sum(count) AS BIGINT) AS total, min(category) AS best_category FROM cat GROUP BY ALL) USING (transcript, pos)) WHERE r = 1"


def _cleaved(spark, d):
    return E.cleavage(X.hits(spark, d), E.categories(X.dens(spark, d)))


@query("a26_cleavage", oracle("SELECT * FROM cl", "hits", "dens", cat=_CAT, cl=_CLEAVE))
def _(spark, d):
    return _cleaved(spark, d)


@query("a28_transcript_summary", oracle("SELECT transcript, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT query) AS BIGINT) AS queries, CAST(count(DISTINCT pos) AS BIGINT) AS sites, CAST(max(total) AS BIGINT) AS best_total, CAST(count(*) FILTER (WHERE best_category <= 1) AS BIGINT) AS strong FROM cl GROUP BY ALL", "hits", "dens", cat=_CAT, cl=_CLEAVE))
def _(spark, d):
    return _cleaved(spark, d).groupBy("transcript").agg(F.count("*").alias("hits"), F.count_distinct("query").alias("queries"), F.count_distinct("pos").alias("sites"), F.max("total").alias("best_total"), F.count_if(F.expr("best_category <= 1")).alias("strong"))


@query("a28_srna_summary", oracle("SELECT query, CAST(count(hit_id) AS BIGINT) AS hits, CAST(count(DISTINCT transcript) AS BIGINT) AS transcripts, CAST(coalesce(max(total), 0) AS BIGINT) AS best_total FROM (SELECT DISTINCT query FROM hits) LEFT JOIN cl USING (query) GROUP BY ALL", "hits", "dens", cat=_CAT, cl=_CLEAVE))
def _(spark, d):
    g = _cleaved(spark, d).groupBy("query").agg(F.count("hit_id").alias("hits"), F.count_distinct("transcript").alias("transcripts"), F.max("total").alias("best_total"))
    return X.hits(spark, d).select("query").distinct().join(g, "query", "left").na.fill(0)


@query("a29_overall", oracle("SELECT unnest(['hits', 'supported', 'transcripts', 'best_total']) AS metric, unnest([(SELECT count(*) FROM hits), (SELECT count(*) FROM cl), (SELECT count(DISTINCT transcript) FROM cl), (SELECT CAST(coalesce(max(total), 0) AS BIGINT) FROM cl)]) AS value", "hits", "dens", cat=_CAT, cl=_CLEAVE))
def _(spark, d):
    c = _cleaved(spark, d).agg(F.count("*").alias("supported"), F.count_distinct("transcript").alias("transcripts"), F.coalesce(F.max("total"), F.lit(0)).cast("long").alias("best_total"))
    h = X.hits(spark, d).agg(F.count("*").alias("hits"))
    return h.unpivot([], ["hits"], "metric", "value").unionByName(c.unpivot([], ["supported", "transcripts", "best_total"], "metric", "value"))


@query("a27_empirical_p", oracle("SELECT transcript, pos, CAST(at_least AS BIGINT) AS at_least, round((1 + at_least) / CAST(501 AS DOUBLE), 9) AS p FROM (SELECT transcript, pos, count(*) OVER (PARTITION BY transcript ORDER BY z DESC RANGE UNBOUNDED PRECEDING) AS at_least FROM (SELECT transcript, pos, sum(count * (SELECT CAST(product(n) AS HUGEINT) FROM tot) // n) AS z FROM dens JOIN tot USING (sample_id) GROUP BY transcript, pos))", "dens", tot="SELECT sample_id, CAST(sum(count) AS HUGEINT) AS n FROM dens GROUP BY ALL"))
def _(spark, d):
    x = X.dens(spark, d)
    sizes = {r["sample_id"]: r["n"] for r in x.groupBy("sample_id").agg(F.sum("count").alias("n")).collect()}  # a row a sample
    return E.empirical_counts(x, sizes).select("transcript", "pos", "at_least", F.round((1 + F.col("at_least")) / F.lit(501.0), 9).alias("p"))


@query("a30_dedupe_best", oracle("SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query, transcript, site10 ORDER BY mfe_ratio DESC, allen, hit_id) AS r FROM hits) WHERE r = 1", "hits"))
def _(spark, d):
    return E.dedupe_best(X.hits(spark, d))


@query("p11_retained_pairs", oracle("SELECT * FROM hits WHERE mfe_ratio >= 0.85 AND allen <= 3 AND mismatches <= 2", "hits"))
def _(spark, d):
    return E.retained(X.hits(spark, d), 0.85, 3, 2)


@query("t09_target_summary", oracle("SELECT transcript, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(DISTINCT query) AS BIGINT) AS n_query, max(mfe_ratio) AS best_ratio, min(allen) AS best_allen, min(mismatches) AS least_mismatches FROM hits GROUP BY ALL", "hits"))
def _(spark, d):
    return E.target_summary(X.hits(spark, d), "transcript", "query")


_SITES = "SELECT *, row_number() OVER (PARTITION BY transcript ORDER BY total DESC, pos) AS i FROM (SELECT *, row_number() OVER (PARTITION BY transcript, pos ORDER BY total DESC, hit_id) AS r FROM cl) WHERE r = 1"
_MARKS = """SELECT transcript, 0 AS i, CAST([] AS INT[]) AS kept FROM (SELECT DISTINCT transcript FROM sites) UNION ALL SELECT c.transcript, CAST(c.i AS INT), CASE WHEN len(list_filter(kept, lambda x: abs(x - c.pos) <= 3)) = 0 THEN list_append(kept, CAST(c.pos AS INT)) ELSE kept END
FROM marks JOIN sites c ON c.transcript = marks.transcript AND c.i = marks.i + 1"""


@query("t15_marker_suppression", recursive(oracle("SELECT hit_id, query, transcript, q, pos, total, best_category FROM sites JOIN (SELECT transcript, unnest(kept) AS pos FROM (SELECT transcript, arg_max(kept, i) AS kept FROM marks GROUP BY transcript)) USING (transcript, pos)", "hits", "dens", cat=_CAT, cl=_CLEAVE, sites=_SITES, marks=_MARKS)))
def _(spark, d):
    return E.marker_suppression(_cleaved(spark, d))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPM of the perfect alignments of each group and contig: mean and standard error over its samples."""
    return QUERIES["a13_srna_contig_summary"](spark, sf_dir)
