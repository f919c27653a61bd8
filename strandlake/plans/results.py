"""Result tables that compose several operators, over the driver's tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators import alignments as A
from strandlake.operators import control as C
from strandlake.operators import evidence as E
from strandlake.operators import mapping as P
from strandlake.operators import matching as M
from strandlake.operators.ranking import numbered, use_checkpoints
from strandlake.plans import fixtures as X
from strandlake.plans.catalogue import _ACGT, _AREA, _CAT, _ENT, _KINDS, _N, _TOP, _UNIT, query, r6
from strandlake.plans.fixtures import CONTIG_LENGTH, oracle

# ---------------------------------------------------------------- complexity


def _complexity_ctes(words: str, key: str) -> dict[str, str]:
    """Common table expressions of the complexity record over (key, w)."""
    letters = f"SELECT {key}, w, i, substring(w, i, 1) AS c FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM {words})"
    motif = lambda k: f"SELECT {key}, m, CAST(n AS DOUBLE) / (length(w) - {k - 1}) AS f FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first) AS r FROM (SELECT {key}, w, m, count(*) AS n, min(i) AS first FROM (SELECT {key}, w, i, substring(w, i, {k}) AS m FROM (SELECT *, unnest(range(1, length(w) - {k} + 2)) AS i FROM {words})) GROUP BY ALL)) WHERE r = 1"
    acgt, kinds, top = f"greatest({_ACGT}, 1)", _KINDS, _TOP
    bits = _ENT.replace(_ACGT, "length(w)")
    gc = f"CAST({_N['G']} + {_N['C']} AS DOUBLE) / {acgt}"
    return {
        "runs_": f"SELECT {key}, c AS base, n AS run FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first) AS r FROM (SELECT {key}, c, g, count(*) AS n, min(i) AS first FROM (SELECT *, i - row_number() OVER (PARTITION BY {key}, c ORDER BY i) AS g FROM ({letters})) GROUP BY ALL)) WHERE r = 1",
        "di": motif(2),
        "tri": motif(3),
        "figures": f"SELECT {key}, w, {kinds} AS kinds, {bits} AS bits, {gc} AS gc, CAST({_N['A']} + {_N['T']} AS DOUBLE) / {acgt} AS at_, CASE {top} WHEN {_N['A']} THEN 'A' WHEN {_N['C']} THEN 'C' WHEN {_N['G']} THEN 'G' ELSE 'T' END AS top_base, CAST({top} AS DOUBLE) / {acgt} AS top_, base, run, CAST(run AS DOUBLE) / length(w) AS run_, di.m AS m2, di.f AS f2, tri.m AS m3, tri.f AS f3, CASE {_UNIT} ELSE '' END AS unit FROM {words} JOIN runs_ USING ({key}) JOIN di USING ({key}) JOIN tri USING ({key})",
        "record": f"""SELECT {key}, CAST(length(w) AS INT) AS length, round(gc, 4) AS gc_fraction, round(at_, 4) AS at_fraction, CAST(kinds AS INT) AS unique_bases, round(bits, 4) AS entropy_bits, top_base AS dominant_base, round(top_, 4) AS dominant_base_fraction, base AS longest_homopolymer_base, CAST(run AS INT) AS longest_homopolymer_length,
round(run_, 4) AS longest_homopolymer_fraction, m2 AS dominant_dinucleotide, round(f2, 4) AS dominant_dinucleotide_fraction, m3 AS dominant_trinucleotide, round(f3, 4) AS dominant_trinucleotide_fraction, unit AS tandem_repeat_unit, flags <> '' AS low_complexity, flags AS complexity_flags FROM (SELECT *, concat_ws(';', CASE WHEN kinds <= 2 THEN 'one_or_two_base_alphabet' END,
CASE WHEN top_ >= 0.80 THEN 'dominant_single_base' END, CASE WHEN run >= 8 OR run_ >= 0.60 THEN 'long_homopolymer' END, CASE WHEN f2 >= 0.70 THEN 'dominant_dinucleotide' END, CASE WHEN f3 >= 0.70 THEN 'dominant_trinucleotide' END, CASE WHEN unit <> '' THEN concat('tandem_repeat_', unit) END,
CASE WHEN bits < 1.25 THEN 'low_entropy' END, CASE WHEN gc >= 0.85 OR gc <= 0.15 THEN 'strong_gc_at_bias' END) AS flags FROM figures)""",
    }


@query("f15_complexity", oracle("SELECT * FROM record", "words", **_complexity_ctes("words", "conv_id, turn, p")))
def _(spark, d):
    return X.words(spark, d).select("conv_id", "turn", "p", *(c.alias(n) for n, c in S.complexity(F.col("w")).items()))


# ---------------------------------------------------------------- control filter

_SRNA_COLUMNS = (
    "item_id * 1000000 + i * 3 + k AS idx",
    "concat('b', CAST(item_id AS STRING), '_', CAST(i AS STRING), '_', CAST(k AS STRING), '_', CAST(i % 5 AS STRING), 'p5CPM') AS id",
    "CASE k WHEN 0 THEN substring(seq, 1 + 10 * i, CAST(18 + (i + item_id) % 7 AS INT)) WHEN 1 THEN substring(seq, CAST(1 + 10 * i + i % 2 AS INT), 18) ELSE substring(repeat(substring(seq, 1 + 10 * i, CAST(1 + i % 3 AS INT)), 24), 1, 18) END AS sequence",
)
_SRNA_SQL = f"SELECT {', '.join(_SRNA_COLUMNS)} FROM (SELECT item_id, seq, i, unnest([0, 1, 2]) AS k FROM (SELECT item_id, seq, CAST(unnest(range(0, (length(seq) - 24) // 10 + 1)) AS INT) AS i FROM (SELECT item_id, {X._DUCK_ENCODE} AS seq FROM benchmark) WHERE length(seq) >= 24))"
_REFS = f"SELECT concat('d', CAST(doc_id AS STRING)) AS contig, {X._DUCK_ENCODE} AS seq, CASE lang WHEN 'en' THEN 'dsrna' WHEN 'es' THEN 'control' ELSE 'genome' END AS kind FROM documents"
_CTX = {
    "srna": _SRNA_SQL,
    "refs": _REFS,
    "sw": "SELECT idx, id, sequence AS w FROM srna",
    **_complexity_ctes("sw", "idx"),
    "strands": "SELECT id, sequence, sequence AS kmer, '+' AS direction FROM srna UNION ALL SELECT id, sequence, reverse(translate(sequence, 'ACGTN', 'TGCAN')), '-' FROM srna WHERE reverse(translate(sequence, 'ACGTN', 'TGCAN')) <> sequence",
    "seeds": "SELECT kind, contig, i, substring(seq, i, 18) AS seed, substring(seq, i, 24) AS piece FROM (SELECT kind, contig, seq, unnest(range(1, length(seq) - 16)) AS i FROM refs WHERE length(seq) >= 18)",
    "places": "SELECT kind, id, sequence, contig, i AS start_1based, i + length(sequence) - 1 AS end_1based, direction FROM strands JOIN seeds ON substring(kmer, 1, 18) = seed AND starts_with(piece, kmer)",
    "summary": "SELECT s.idx, s.id AS srna_id, s.sequence, CAST(length(s.sequence) AS INT) AS length, true AS passes_length_filter, round(CAST(split_part(split_part(s.id, '_', 4), 'p', 1) AS DOUBLE) + 0.5, 6) AS cpm_from_name, "
    + ", ".join(f"coalesce(h.{k}_hits, 0) > 0 AS {k}_maps, CAST(coalesce(h.{k}_hits, 0) AS BIGINT) AS {k}_hits, CAST(coalesce(h.{k}_contigs, 0) AS BIGINT) AS {k}_contigs" for k in ("dsrna", "genome", "control"))
    + ", low_complexity, complexity_flags FROM srna s JOIN record USING (idx) LEFT JOIN (SELECT id, "
    + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_hits, count(DISTINCT contig) FILTER (WHERE kind = '{k}') AS {k}_contigs" for k in ("dsrna", "genome", "control"))
    + " FROM places GROUP BY id) h USING (id)",
    "clean": "SELECT idx, srna_id AS id, sequence FROM summary WHERE NOT low_complexity AND NOT genome_maps AND NOT control_maps",
}
_CLEAN = {
    **_CTX,
    "firsts": "SELECT sequence, min(idx) AS idx, arg_min(id, idx) AS id, count(*) AS n FROM clean GROUP BY sequence",
    "inside": "SELECT c.id, c.sequence, p.id AS parent_id, length(p.sequence) AS parent_length, instr(p.sequence, c.sequence) AS i, count(*) OVER (PARTITION BY c.id, length(p.sequence)) - 1 AS more, row_number() OVER (PARTITION BY c.id ORDER BY length(p.sequence), p.idx) AS r FROM firsts c JOIN firsts p ON length(p.sequence) > length(c.sequence) AND contains(p.sequence, c.sequence)",
    "gone": "SELECT c.id AS removed_id, c.sequence, CAST(length(c.sequence) AS INT) AS removed_length, 'exact_duplicate' AS removal_reason, f.id AS parent_id, CAST(length(c.sequence) AS INT) AS parent_length, 1 AS start_1based, CAST(length(c.sequence) AS INT) AS end_1based, CAST(NULL AS BIGINT) AS more_parents FROM clean c JOIN firsts f USING (sequence) WHERE c.idx <> f.idx "
    "UNION ALL SELECT id, sequence, CAST(length(sequence) AS INT), 'shorter_exact_substring', parent_id, CAST(parent_length AS INT), CAST(i AS INT), CAST(i + length(sequence) - 1 AS INT), more FROM inside WHERE r = 1",
    "kept": "SELECT id, sequence FROM firsts WHERE id NOT IN (SELECT id FROM inside)",
}


def srnas(spark, d):
    """(idx, id, sequence): three sequences at every tenth place of the encoded benchmark items: one of 18 to 24 letters, one of 18 near it, one made of a repeated unit."""
    encoded = X._table(spark, d, "benchmark").select("item_id", X.encoded(F.col("text")).alias("seq")).where("length(seq) >= 24")
    encoded = encoded.select("item_id", "seq", F.explode(F.expr("sequence(0, (length(seq) - 24) div 10)")).alias("i")).select("item_id", "seq", F.col("i").cast("int").alias("i"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return encoded.selectExpr(*_SRNA_COLUMNS)


def references(spark, d):
    """(kind, contig, seq): the documents as three sets of references, parted by language."""
    kind = F.when(F.col("lang") == "en", "dsrna").when(F.col("lang") == "es", "control").otherwise("genome")
    return X._table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("contig"), X.encoded(F.col("text")).alias("seq"), kind.alias("kind"))


def _places(spark, d):
    return C.reference_places(srnas(spark, d), references(spark, d), 18, 24)


def _control(spark, d):
    return C.control_summary(srnas(spark, d), C.sequence_places(srnas(spark, d), references(spark, d), 18, 24))


def _clean(spark, d):
    """The clean records, stored in the checkpoint folder: the collapse reads them several times."""
    use_checkpoints(spark)
    return C.clean_records(_control(spark, d)).checkpoint()


@query("m10_locations", oracle("SELECT kind, id, sequence, contig, CAST(start_1based AS INT) AS start_1based, CAST(end_1based AS INT) AS end_1based, direction FROM places", **_CTX))
def _(spark, d):
    return _places(spark, d)


@query("m10_control_summary", oracle("SELECT * EXCLUDE (idx) FROM summary", **_CTX))
def _(spark, d):
    return _control(spark, d).drop("idx")


@query("m10_clean", oracle("SELECT id, sequence FROM kept", **_CLEAN))
def _(spark, d):
    return M.collapsed(_clean(spark, d), 18, 24)[0]


@query("m10_removed", oracle("SELECT * FROM gone", **_CLEAN))
def _(spark, d):
    return M.collapsed(_clean(spark, d), 18, 24)[1]


_PER = "SELECT length(sequence) AS n, count(*) AS input_, 0 AS kept_, 0 AS dup, 0 AS inner_ FROM clean GROUP BY 1 UNION ALL SELECT length(sequence), 0, count(*), 0, 0 FROM kept GROUP BY 1 UNION ALL SELECT removed_length, 0, 0, count(*) FILTER (WHERE removal_reason = 'exact_duplicate'), count(*) FILTER (WHERE removal_reason <> 'exact_duplicate') FROM gone GROUP BY 1"


@query("a32_collapse_summary", oracle("""SELECT unnest(['input_records_after_other_filters', 'kept_records_after_collapse', 'removed_exact_duplicate_records', 'removed_shorter_contained_records']) AS metric, CAST(unnest([sum(input_), sum(kept_), sum(dup), sum(inner_)]) AS BIGINT) AS value, '' AS detail FROM per
UNION ALL SELECT 'length_breakdown', n, concat('input=', CAST(sum(input_) AS BIGINT), '; kept=', CAST(sum(kept_) AS BIGINT), '; duplicate_removed=', CAST(sum(dup) AS BIGINT), '; shorter_contained_removed=', CAST(sum(inner_) AS BIGINT)) FROM per GROUP BY n""", **_CLEAN, per=_PER))
def _(spark, d):
    records = _clean(spark, d)
    return M.collapse_summary(records, *M.collapsed(records, 18, 24))


# ---------------------------------------------------------------- cleavage and targets in full

_TX = "SELECT DISTINCT event_type AS transcript, CAST(500 + length(event_type) AS INT) AS length FROM events"
_CLEAVED = {
    "cat": _CAT,
    "tx": _TX,
    "totals": "SELECT sample_id, CAST(sum(count) AS BIGINT) AS total_reads FROM dens GROUP BY ALL",
    "track": "SELECT transcript, pos, total, best_category, round(m, 6) AS mean_cpm, round(sqrt(((ss - 2 * m * s + k * m * m) + (n - k) * m * m) / (n - 1)) / sqrt(n), 6) AS sem_cpm FROM (SELECT *, s / n AS m FROM (SELECT transcript, pos, CAST(sum(count) AS BIGINT) AS total, min(category) AS best_category, sum(count * 1e6 / total_reads) AS s, sum((count * 1e6 / total_reads) * (count * 1e6 / total_reads)) AS ss, count(*) AS k FROM cat JOIN totals USING (sample_id) GROUP BY ALL), (SELECT CAST(count(*) AS DOUBLE) AS n FROM totals))",
    "reach": "SELECT *, count(*) OVER (PARTITION BY transcript ORDER BY mean_cpm DESC RANGE UNBOUNDED PRECEDING) AS at_least FROM track",
    "chance": "SELECT category AS best_category, CAST(count(*) AS DOUBLE) / (SELECT greatest(1, sum(length) - 20 * count(*)) FROM tx) AS chance FROM cat GROUP BY 1",
    "ranked": "SELECT *, row_number() OVER (ORDER BY mfe_ratio DESC, allen, hit_id) AS rank FROM hits",
    "sites_": "SELECT hit_id, transcript, 9 AS q, site9 AS pos FROM hits UNION ALL SELECT hit_id, transcript, 10, site10 FROM hits UNION ALL SELECT hit_id, transcript, 11, site11 FROM hits",
    "chosen_": "SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY mean_cpm DESC, total DESC, abs(q - 10), q) AS r FROM sites_ JOIN reach USING (transcript, pos)",
    "full_": """SELECT *, peak_p AS selected_p FROM (SELECT ranked.*, q, c.pos, mean_cpm, sem_cpm, total, c.best_category, least(greatest((1 + at_least) / (1 + length), 1e-300), 1.0) AS peak_p,
CASE WHEN chance >= 1 THEN 1.0 ELSE 1 - power(1 - chance, rank) END AS category_p FROM ranked JOIN (SELECT * FROM chosen_ WHERE r = 1 AND total > 0) c USING (hit_id) JOIN chance USING (best_category) JOIN tx ON tx.transcript = ranked.transcript)""",
}


def _side(by: str, other: str, names: str) -> str:
    return f"""SELECT n.{by}, n.length, coalesce(h.partners, 0) AS predicted_partners, coalesce(h.sites, 0) AS predicted_sites, coalesce(h.best, 0) AS best_mfe_ratio, coalesce(c.partners, 0) AS supported_partners, coalesce(c.sites, 0) AS supported_sites, coalesce(c.sure, 0) AS significant_partners,
coalesce(c.sure_sites, 0) AS significant_sites, coalesce(c.q10, 0) AS q10_sites, coalesce(c.q9, 0) AS q9_sites, coalesce(c.q11, 0) AS q11_sites, coalesce(c.mean_, 0) AS best_mean_cpm, coalesce(c.p, 1) AS best_pvalue FROM ({names}) n
LEFT JOIN (SELECT {by}, count(DISTINCT {other}) AS partners, count(*) AS sites, max(mfe_ratio) AS best FROM hits GROUP BY ALL) h ON h.{by} = n.{by}
LEFT JOIN (SELECT {by}, count(DISTINCT {other}) AS partners, count(*) AS sites, count(DISTINCT CASE WHEN selected_p < 0.05 THEN {other} END) AS sure, count(*) FILTER (WHERE selected_p < 0.05) AS sure_sites, count(*) FILTER (WHERE q = 10) AS q10, count(*) FILTER (WHERE q = 9) AS q9, count(*) FILTER (WHERE q = 11) AS q11, max(mean_cpm) AS mean_, min(selected_p) AS p FROM full_ GROUP BY ALL) c ON c.{by} = n.{by}"""


_SIDES = {**_CLEAVED, "t_side": _side("transcript", "query", "SELECT * FROM tx"), "q_side": _side("query", "transcript", "SELECT query, CAST(18 + length(query) AS INT) AS length FROM (SELECT DISTINCT concat('q', CAST(c_custkey % 45 AS STRING)) AS query FROM customer)")}


def _tx(spark, d):
    return X._table(spark, d, "events").select(F.col("event_type").alias("transcript")).distinct().withColumn("length", 500 + F.char_length("transcript"))


def _queries(spark, d):
    q = X._table(spark, d, "customer").selectExpr("concat('q', CAST(c_custkey % 45 AS STRING)) AS query").distinct()
    return q.withColumn("length", 18 + F.char_length("query"))


def _cleaved_full(spark, d):
    density = X.dens(spark, d)
    totals = density.groupBy("sample_id").agg(F.sum("count").alias("total_reads"))
    ranked = numbered(X.hits(spark, d), F.desc("mfe_ratio"), "allen", "hit_id")
    return E.supported_cleavage(ranked, E.categories(density), totals, _tx(spark, d))


_BEST = ("round(best_mfe_ratio, 6) AS best_mfe_ratio", "round(best_mean_cpm, 4) AS best_mean_cpm", "round(best_pvalue, 9) AS best_pvalue")
_WHOLE = ("predicted_partners", "predicted_sites", "supported_partners", "supported_sites", "significant_partners", "significant_sites", "q10_sites", "q9_sites", "q11_sites")


def _listed(by: str) -> str:
    return f"SELECT {by}, length, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _WHOLE)}, {', '.join(_BEST)}"


@query("a26_cleavage_full", oracle("SELECT hit_id, query, transcript, rank, q, pos, site10, round(mean_cpm, 4) AS mean_cpm, round(sem_cpm, 4) AS sem_cpm, total, best_category, round(peak_p, 9) AS peak_pvalue, round(category_p, 9) AS category_pvalue, round(selected_p, 9) AS selected_pvalue, mfe_ratio, allen, mismatches FROM full_", "hits", "dens", **_CLEAVED))
def _(spark, d):
    f = _cleaved_full(spark, d)
    return f.select("hit_id", "query", "transcript", "rank", "q", "pos", "site10", *(F.round(c, 4).alias(c) for c in ("mean_cpm", "sem_cpm")), "total", "best_category", *(F.round(c, 9).alias(c) for c in ("peak_pvalue", "category_pvalue", "selected_pvalue")), "mfe_ratio", "allen", "mismatches")


@query("a28_transcript_full", oracle(f"{_listed('transcript')} FROM t_side", "hits", "dens", **_SIDES))
def _(spark, d):
    return E.support_summary(_tx(spark, d), X.hits(spark, d), _cleaved_full(spark, d), "transcript", "query", 0.05).selectExpr("transcript", "length", *_WHOLE, *_BEST)


@query("a28_srna_full", oracle(f"{_listed('query')} FROM q_side", "hits", "dens", **_SIDES))
def _(spark, d):
    return E.support_summary(_queries(spark, d), X.hits(spark, d), _cleaved_full(spark, d), "query", "transcript", 0.05).selectExpr("query", "length", *_WHOLE, *_BEST)


def _overall(side: str, name: str, partner: str) -> str:
    kinds = ("predicted", "supported", "significant")
    names = [f"{name}s_in_input", *(x for k in kinds for x in (f"{name}s_with_{k}_{partner}", f"mean_{partner}s_{k}"))]
    values = ["count(*)", *(x for k in kinds for x in (f"count(*) FILTER (WHERE {k}_partners > 0)", f"coalesce(avg({k}_partners), 0)"))]
    return f"SELECT '{name}' AS section, unnest({names}) AS metric, unnest([{', '.join(f'round(CAST({v} AS DOUBLE), 6)' for v in values)}]) AS value, CAST(NULL AS VARCHAR) AS detail FROM {side}"


@query("a29_overall_full", oracle(f"SELECT 'settings' AS section, 'pvalue_method' AS metric, CAST(NULL AS DOUBLE) AS value, 'transcript_peak_empirical' AS detail UNION ALL SELECT 'settings', 'pvalue_cutoff', CAST(0.05 AS DOUBLE), NULL UNION ALL {_overall('t_side', 'transcript', 'srna')} UNION ALL {_overall('q_side', 'srna', 'transcript')}", "hits", "dens", **_SIDES))
def _(spark, d):
    c, h = _cleaved_full(spark, d), X.hits(spark, d)
    both = E.support_summary(_tx(spark, d), h, c, "transcript", "query", 0.05), E.support_summary(_queries(spark, d), h, c, "query", "transcript", 0.05)
    return E.overall_summary(*both, "transcript_peak_empirical", 0.05).withColumn("value", r6(F.col("value")))


# ---------------------------------------------------------------- fragments, ranks, names

_READS = [("flag", "CAST(CASE WHEN mate = 1 THEN 64 ELSE 128 END + CASE WHEN strand = 'antisense' THEN 16 ELSE 0 END + CASE WHEN start0 % 10 = 0 THEN 256 ELSE 0 END AS INT)"), ("cigar", "CASE WHEN end0 - start0 >= 10 THEN concat('3S4M2D', CAST(end0 - start0 - 6 AS STRING), 'M') ELSE concat(CAST(end0 - start0 AS STRING), '=') END")]
_PAIRS = {
    "usable": "SELECT * FROM aln WHERE start0 % 10 <> 0 AND mapq >= 10",
    "pair": "SELECT sample_id, qname, arg_min(strand, (-mapq) * 1000000 + start0 * 10 + CASE strand WHEN 'sense' THEN 0 ELSE 1 END) FILTER (WHERE mate = 1) AS dir FROM usable GROUP BY ALL HAVING bool_or(mate = 1) AND bool_or(mate <> 1) AND min(contig) = max(contig)",
    "bases": "SELECT DISTINCT sample_id, qname, contig, dir AS strand, unnest(CASE WHEN end0 - start0 >= 10 THEN list_concat(range(start0, start0 + 4), range(start0 + 6, end0)) ELSE range(start0, end0) END) AS pos FROM usable JOIN pair USING (sample_id, qname)",
    "frag": "SELECT sample_id, qname, contig, strand, CAST(min(pos) AS INT) AS start0, CAST(max(pos) + 1 AS INT) AS end0 FROM (SELECT *, pos - row_number() OVER (PARTITION BY sample_id, qname ORDER BY pos) AS g FROM bases) GROUP BY sample_id, qname, contig, strand, g",
}


def _reads(spark, d):
    return X.aln(spark, d).selectExpr("*", *(f"{e} AS {n}" for n, e in _READS))


@query("a07_fragment_depth", oracle("SELECT sample_id, contig, strand, pos, CAST(sum(d) OVER (PARTITION BY sample_id, contig, strand ORDER BY pos) AS BIGINT) AS depth FROM (SELECT sample_id, contig, strand, pos, CAST(sum(d) AS BIGINT) AS d FROM (SELECT sample_id, contig, strand, start0 AS pos, 1 AS d FROM frag UNION ALL SELECT sample_id, contig, strand, end0, -1 FROM frag) GROUP BY ALL HAVING sum(d) <> 0)", "aln", **_PAIRS))
def _(spark, d):
    return A.depth(A.fragments(_reads(spark, d)))


@query("a07_pair_stats", oracle("SELECT sample_id, count(dir) AS collapsed_pairs, count(*) FILTER (WHERE dir = 'sense') AS sense_pairs, count(*) FILTER (WHERE dir = 'antisense') AS antisense_pairs, count(*) FILTER (WHERE dir IS NULL) AS discarded_pairs FROM (SELECT sample_id, qname FROM aln WHERE start0 % 10 <> 0 GROUP BY ALL HAVING bool_or(mate = 1) AND bool_or(mate <> 1)) LEFT JOIN pair USING (sample_id, qname) GROUP BY sample_id", "aln", **_PAIRS))
def _(spark, d):
    reads = _reads(spark, d)
    return A.pair_stats(reads, A.fragments(reads))


_GROUP_BINS = "SELECT contig, bin, s / n AS s, a / n AS a, n FROM (SELECT contig, bin, sum(CASE WHEN strand = 'sense' THEN area * 1e6 / n_reads ELSE 0 END) AS s, sum(CASE WHEN strand = 'antisense' THEN area * 1e6 / n_reads ELSE 0 END) AS a FROM area JOIN (SELECT * FROM lib WHERE grp = 'g1') USING (sample_id) GROUP BY ALL), (SELECT CAST(count(*) AS DOUBLE) AS n FROM lib WHERE grp = 'g1')"
_BIN_ROWS = "SELECT concat(contig, '_', CAST(bin * 250 + 1 AS STRING), '_', CAST(least(bin * 250 + 250, 2000) AS STRING)) AS target_bin, contig, bin, CAST(least(250, 2000 - bin * 250) AS INT) AS bin_length, round(s, 4) AS sense_area, round(a, 4) AS antisense_area, CAST(n AS BIGINT) AS replicates FROM bins_ WHERE 2000 - bin * 250 > 0 AND s + a > 0"
_BIN_SCORED = "SELECT *, round(sense_area * antisense_area, 3) AS product_score, round(least(sense_area, antisense_area) / bin_length, 6) AS duplex_depth, round((sense_area + antisense_area) / bin_length, 6) AS total_depth, round(200.0 * least(sense_area, antisense_area) / (sense_area + antisense_area), 6) AS balance FROM bin_rows"


@query("t05_ranked_bins", oracle("SELECT target_bin, contig, CAST(bin AS INT) AS bin, bin_length, sense_area, antisense_area, replicates, product_score, duplex_depth, total_depth, balance, row_number() OVER (ORDER BY product_score DESC, duplex_depth DESC, total_depth DESC, contig, bin) AS rank, CAST(greatest(0, bin * 250 - 500) + 1 AS INT) AS context_start_1based, CAST(least(2000, bin * 250 + bin_length + 500) AS INT) AS context_end_1based FROM bin_scored", "lib", area=_AREA, bins_=_GROUP_BINS, bin_rows=_BIN_ROWS, bin_scored=_BIN_SCORED))
def _(spark, d):
    a = X.aln(spark, d)
    lib = A.library_sizes(a).where("grp = 'g1'").select("sample_id", "n_reads")
    return A.ranked_bins(a, lib, 250, CONTIG_LENGTH, 500)


_NAMED = "SELECT hit_id, query, site10, mismatches, mfe_ratio * (hit_id % 9) / 4 - 0.2 AS v FROM hits"
_TOKEN = "CASE WHEN v <= 0 THEN '0' WHEN v >= 1 THEN CAST(greatest(1, CAST(round_even(v, 0) AS BIGINT)) AS VARCHAR) ELSE (SELECT arg_min(concat(CAST(CAST(round(v * d) AS INT) AS VARCHAR), '/', CAST(d AS VARCHAR)), (abs(v - round(v * d) / d), d)) FROM (SELECT unnest(range(1, 101)) AS d)) END"


@query("f19_export_name", oracle(f"SELECT hit_id, concat(query, '_', CAST(site10 AS VARCHAR), 'pos_21len_sense_', CAST(mismatches AS VARCHAR), 'm_', {_TOKEN}, 'CPM') AS name FROM named", "hits", named=_NAMED))
def _(spark, d):
    h = X.hits(spark, d).withColumn("v", F.col("mfe_ratio") * (F.col("hit_id") % 9) / 4 - 0.2)
    return h.select("hit_id", S.export_name(F.col("query"), F.col("site10"), F.lit(21), F.lit("sense"), F.col("mismatches"), F.col("v")).alias("name"))


@query("f05_restored_read", oracle("SELECT conv_id, turn, p, CASE WHEN p % 2 = 1 THEN reverse(translate(w, 'ACGTN', 'TGCAN')) ELSE w END AS sequence, CASE WHEN p % 2 = 1 THEN reverse(translate(w, 'ACGT', 'FGHI')) ELSE translate(w, 'ACGT', 'FGHI') END AS quality FROM words", "words"))
def _(spark, d):
    w = X.words(spark, d)
    seq, quality = S.restored_read((F.col("p") % 2) * 16, F.col("w"), F.translate("w", "ACGT", "FGHI"))
    return w.select("conv_id", "turn", "p", seq.alias("sequence"), quality.alias("quality"))


@query("f25_aligned_blocks", oracle("SELECT qname, start0, end0, unnest(CASE WHEN end0 - start0 >= 10 THEN [start0, start0 + 6] ELSE [start0] END) AS block_start, unnest(CASE WHEN end0 - start0 >= 10 THEN [start0 + 4, end0] ELSE [end0] END) AS block_end FROM aln", "aln"))
def _(spark, d):
    r = _reads(spark, d).select("qname", "start0", "end0", F.explode(S.aligned_blocks(F.col("cigar"), F.col("start0"))).alias("b"))
    return r.select("qname", "start0", "end0", F.col("b.start0").alias("block_start"), F.col("b.end0").alias("block_end"))


@query("p07_simple_filter", oracle("SELECT reason, count(*) AS rows_, count(DISTINCT w) AS sequences FROM (SELECT w, CASE WHEN low_complexity THEN 'low_complexity' ELSE 'kept' END AS reason FROM words JOIN record USING (conv_id, turn, p)) GROUP BY reason", "words", **_complexity_ctes("words", "conv_id, turn, p")))
def _(spark, d):
    w = X.words(spark, d)
    return w.withColumn("reason", F.when(S.complexity(F.col("w"))["low_complexity"], "low_complexity").otherwise("kept")).groupBy("reason").agg(F.count("*").alias("rows_"), F.count_distinct("w").alias("sequences"))


@query("a15_vector_mean", oracle("SELECT contig, strand, CAST(bin AS INT) AS bin, round(m, 4) AS mean_area, round(CASE WHEN n > 1 THEN sqrt(greatest(0, (ss - n * m * m) / (n - 1)) / n) END, 3) AS sem_area FROM (SELECT contig, strand, bin, sum(area) / min(k) AS m, CAST(sum(area * area) AS DOUBLE) AS ss, min(k) AS n FROM area, (SELECT CAST(count(DISTINCT sample_id) AS DOUBLE) AS k FROM aln) GROUP BY contig, strand, bin)", "aln", area=_AREA))
def _(spark, d):
    return A.vector_mean(A.bin_area(X.aln(spark, d), 250), X.aln(spark, d).select("sample_id").distinct(), ("contig", "strand", "bin"), "area")


@query("w06_replicates", oracle("SELECT n_nationkey AS sample_key, n_name AS sample_id, lower(r_name) AS grp, CAST(row_number() OVER (PARTITION BY lower(r_name) ORDER BY n_nationkey) AS INT) AS replicate FROM nation JOIN region ON n_regionkey = r_regionkey"))
def _(spark, d):
    n = X._table(spark, d, "nation").join(X._table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.replicate_numbers(n.select(F.col("n_nationkey").alias("sample_key"), F.col("n_name").alias("sample_id"), F.lower("r_name").alias("grp")), "grp", "sample_key")


# ---------------------------------------------------------------- small-RNA mapping

_SIMPLE = f"""SELECT sequence, CASE WHEN {_ACGT} = 0 THEN 'no_acgt' WHEN {_N['N']} > 0.10 * length(w) THEN 'too_many_n' WHEN {_KINDS} <= 2 THEN 'one_or_two_base_alphabet' WHEN CAST({_TOP} AS DOUBLE) / {_ACGT} >= 0.80 THEN 'dominant_single_base' WHEN run >= 8 OR run_ >= 0.60 THEN 'long_homopolymer' WHEN f2 >= 0.70 THEN 'dominant_2mer' WHEN f3 >= 0.70 THEN 'dominant_3mer' END AS reason FROM (SELECT DISTINCT w AS sequence, w, run, run_, f2, f3 FROM figures)"""
_MAPPED = {
    **{k: v for k, v in _CTX.items() if k not in ("summary", "clean", "record")},
    "reads_": "SELECT concat('s', CAST(1 + idx % 4 AS STRING)) AS sample_id, CASE WHEN idx % 4 < 2 THEN 'g1' ELSE 'g2' END AS grp, sequence, CAST(count(*) AS BIGINT) AS copies FROM srna GROUP BY ALL",
    "libs": "SELECT sample_id, grp, CAST(sum(copies) AS BIGINT) AS n_reads FROM reads_ GROUP BY ALL",
    "simple_": _SIMPLE,
    "spots": "SELECT DISTINCT sequence, contig, start_1based, end_1based, direction FROM places",
    "mapped": "SELECT sample_id, grp, contig, CAST(start_1based AS INT) AS start, CAST(end_1based AS INT) AS end_, CAST(length(r.sequence) AS INT) AS length, CASE direction WHEN '+' THEN 'sense' ELSE 'antisense' END AS strand, 0 AS mismatches, r.sequence, copies, reason FROM reads_ r JOIN spots USING (sequence) JOIN simple_ USING (sequence)",
    "kept_": "SELECT m.*, copies * 1e6 / n_reads AS cpm FROM mapped m JOIN (SELECT sample_id, n_reads FROM libs) USING (sample_id) WHERE reason IS NULL",
    "sizes_": "SELECT grp, count(*) AS replicates FROM libs GROUP BY ALL",
}


def _sample_reads(spark, d):
    sample = F.concat(F.lit("s"), (1 + F.col("idx") % 4).cast("string")).alias("sample_id")
    reads = srnas(spark, d).select(sample, F.when(F.col("idx") % 4 < 2, "g1").otherwise("g2").alias("grp"), "sequence").groupBy("sample_id", "grp", "sequence").agg(F.count("*").alias("copies"))
    return reads, reads.groupBy("sample_id", "grp").agg(F.sum("copies").alias("n_reads"))


def _mapped(spark, d):
    reads, libraries = _sample_reads(spark, d)
    return P.mapped_reads(reads, references(spark, d).drop("kind"), 18, 24), libraries


@query("m08_alignments", oracle("SELECT sample_id, grp, contig, start, end_ AS \"end\", length, strand, mismatches, sequence, copies, round(cpm, 6) AS cpm FROM kept_", **_MAPPED))
def _(spark, d):
    return P.retained(*_mapped(spark, d)).drop("n_reads").withColumn("cpm", r6(F.col("cpm")))


@query("m08_sample_summary", oracle("SELECT l.sample_id, l.grp, l.n_reads, CAST(coalesce(sum(copies), 0) AS BIGINT) AS raw_mapped_alignments, CAST(coalesce(sum(copies) FILTER (WHERE reason IS NOT NULL), 0) AS BIGINT) AS simple_filtered_alignments, CAST(coalesce(sum(copies) FILTER (WHERE reason IS NULL AND length <> 21), 0) AS BIGINT) AS focus_length_filtered_alignments, CAST(coalesce(sum(copies) FILTER (WHERE reason IS NULL AND length = 21), 0) AS BIGINT) AS retained_alignments, round(coalesce(100.0 * sum(copies) FILTER (WHERE reason IS NOT NULL) / sum(copies), 0), 6) AS simple_filtered_percent FROM libs l LEFT JOIN mapped m ON m.sample_id = l.sample_id GROUP BY l.sample_id, l.grp, l.n_reads", **_MAPPED))
def _(spark, d):
    return P.sample_summary(*_mapped(spark, d), focus=21).withColumn("simple_filtered_percent", r6(F.col("simple_filtered_percent")))


@query("m08_unique", oracle(f"SELECT grp, contig, start, \"end\", strand, sequence, mismatches, samples_present, replicates, v AS mean_cpm, concat(contig, '_', CAST(start AS VARCHAR), 'pos_', CAST(length(sequence) AS VARCHAR), 'len_', strand, '_', CAST(mismatches AS VARCHAR), 'm_', {_TOKEN}, 'CPM') AS name FROM (SELECT grp, contig, start, end_ AS \"end\", strand, sequence, mismatches, count(DISTINCT sample_id) AS samples_present, min(replicates) AS replicates, round(sum(cpm) / min(replicates), 6) AS v FROM kept_ JOIN sizes_ USING (grp) GROUP BY ALL)", **_MAPPED))
def _(spark, d):
    mapped, libraries = _mapped(spark, d)
    return P.group_means(P.retained(mapped, libraries), libraries)


_COVERED = "SELECT grp, contig, count(DISTINCT pos) FILTER (WHERE strand = 'sense') AS sc, count(DISTINCT pos) FILTER (WHERE strand = 'antisense') AS ac FROM (SELECT grp, contig, strand, unnest(range(start, end_ + 1)) AS pos FROM kept_) GROUP BY ALL"


@query("m08_contig_summary", oracle("SELECT grp, contig, CAST(count(*) AS BIGINT) AS replicates, round(avg(s), 4) AS sense_mean, round(coalesce(stddev_samp(s) / sqrt(count(*)), 0), 3) AS sense_sem, round(avg(a), 4) AS antisense_mean, round(coalesce(stddev_samp(a) / sqrt(count(*)), 0), 3) AS antisense_sem, round(avg(s + a), 4) AS total_mean, CAST(min(sc) AS BIGINT) AS sense_covered, CAST(min(ac) AS BIGINT) AS antisense_covered, CAST(min(n) AS INT) AS inferred_length FROM (SELECT grp, contig, sample_id, sum(CASE WHEN strand = 'sense' THEN cpm ELSE 0 END) AS s, sum(CASE WHEN strand = 'antisense' THEN cpm ELSE 0 END) AS a FROM kept_ GROUP BY grp, contig, sample_id) JOIN covered_ USING (grp, contig) JOIN (SELECT contig, max(end_) AS n FROM kept_ GROUP BY ALL) USING (contig) GROUP BY grp, contig", **_MAPPED, covered_=_COVERED))
def _(spark, d):
    c = P.contig_summary(P.retained(*_mapped(spark, d)))
    return c.select("grp", "contig", "replicates", *(F.round(x, 3 if x.endswith("sem") else 4).alias(x) for x in ("sense_mean", "sense_sem", "antisense_mean", "antisense_sem", "total_mean")), "sense_covered", "antisense_covered", "inferred_length")


@query("m08_length_distribution", oracle("SELECT sample_id, length, strand, contig, CASE WHEN contig IS NULL THEN 'all' ELSE 'contig' END AS scope, round(sum(cpm), 4) AS cpm FROM kept_ GROUP BY GROUPING SETS ((sample_id, length, strand), (sample_id, length, strand, contig))", **_MAPPED))
def _(spark, d):
    return P.length_distribution(*_mapped(spark, d)).withColumn("cpm", F.round("cpm", 4))


@query("m08_unique_by_sample", oracle(f"SELECT sample_id, k.grp, k.contig, k.start, k.end_ AS \"end\", k.strand, k.sequence, mismatches, CAST(raw AS BIGINT) AS raw_count, round(c, 6) AS cpm, round(100.0 * c / total, 6) AS percent_of_sample, v AS mean_cpm, replicates, samples_present, concat(k.contig, '_', CAST(k.start AS VARCHAR), 'pos_', CAST(length(k.sequence) AS VARCHAR), 'len_', k.strand, '_', CAST(mismatches AS VARCHAR), 'm_', {_TOKEN}, 'CPM') AS name FROM (SELECT sample_id, grp, contig, start, end_, strand, sequence, sum(copies) AS raw, sum(cpm) AS c FROM some_ GROUP BY ALL) k JOIN (SELECT grp, contig, start, end_, strand, sequence, mismatches, count(DISTINCT sample_id) AS samples_present, min(replicates) AS replicates, round(sum(cpm) / min(replicates), 6) AS v FROM some_ JOIN sizes_ USING (grp) GROUP BY ALL) g USING (grp, contig, start, end_, strand, sequence) JOIN (SELECT sample_id, sum(cpm) AS total FROM some_ GROUP BY ALL) USING (sample_id) WHERE v >= 2", **_MAPPED, some_="SELECT * FROM kept_ WHERE length = 21"))
def _(spark, d):
    mapped, libraries = _mapped(spark, d)
    out = P.sample_counts(P.exported(P.retained(mapped, libraries), 21, 0), libraries, 2.0)
    return out.withColumn("cpm", r6(F.col("cpm"))).withColumn("percent_of_sample", r6(F.col("percent_of_sample")))


_DRAWN = {
    "own": "SELECT id, contig, start_1based - 1 AS start0, end_1based AS end0, CASE direction WHEN '+' THEN 'sense' ELSE 'antisense' END AS side FROM places WHERE kind = 'dsrna'",
    "drawn": "SELECT own.contig, CASE WHEN contains(own.id, '_antisense_') THEN 'antisense' WHEN contains(own.id, '_sense_') THEN 'sense' ELSE f END AS strand, start0, end0, CAST(round(v / n, 9) AS DECIMAL(24, 9)) AS share, CAST(v AS DECIMAL(24, 9)) AS v, genome_maps, control_maps FROM own JOIN (SELECT id, contig, count(*) AS n, first(side ORDER BY start0, end0, side) AS f FROM own GROUP BY id, contig) USING (id, contig) JOIN (SELECT srna_id AS id, CASE WHEN cpm_from_name > 0 THEN cpm_from_name ELSE 1 END AS v, genome_maps, control_maps FROM summary) USING (id)",
    "turns_": "SELECT contig, strand, pos, sum(t) AS t, sum(g) AS g, sum(c) AS c, sum(w) AS w FROM (SELECT contig, strand, unnest([start0, end0]) AS pos, unnest([share, -share]) AS t, unnest([CASE WHEN genome_maps THEN share ELSE 0 END, CASE WHEN genome_maps THEN -share ELSE 0 END]) AS g, unnest([CASE WHEN control_maps THEN share ELSE 0 END, CASE WHEN control_maps THEN -share ELSE 0 END]) AS c, unnest([v, -v]) AS w FROM drawn) GROUP BY ALL HAVING sum(t) <> 0 OR sum(g) <> 0 OR sum(c) <> 0 OR sum(w) <> 0",
}


@query("a35_control_overview", oracle("SELECT contig, strand, CAST(start0 AS INT) AS start0, CAST(end0 AS INT) AS end0, round(CAST(t AS DOUBLE), 6) AS cpm, round(CAST(g AS DOUBLE), 6) AS genome_cpm, round(CAST(c AS DOUBLE), 6) AS control_cpm, round(CAST(w AS DOUBLE), 6) AS whole_cpm FROM (SELECT contig, strand, pos AS start0, lead(pos) OVER o AS end0, sum(t) OVER o AS t, sum(g) OVER o AS g, sum(c) OVER o AS c, sum(w) OVER o AS w FROM turns_ WINDOW o AS (PARTITION BY contig, strand ORDER BY pos)) WHERE t <> 0 OR w <> 0", **_CTX, **_DRAWN))
def _(spark, d):
    places = C.sequence_places(srnas(spark, d), references(spark, d), 18, 24)
    runs = C.overview(C.control_summary(srnas(spark, d), places), places)
    return runs.select("contig", "strand", F.col("start0").cast("int").alias("start0"), F.col("end0").cast("int").alias("end0"), *(r6(F.col(c)).alias(c) for c in ("cpm", "genome_cpm", "control_cpm", "whole_cpm")))


@query("j16_contexts", oracle("SELECT contig, bin, context_start, context_end, substring(seq, context_start, context_end - context_start + 1) AS sequence FROM (SELECT contig, bin, seq, CAST(greatest(0, bin * 250 - 500) + 1 AS INT) AS context_start, CAST(least(length(seq), bin * 250 + 750) AS INT) AS context_end FROM (SELECT contig, CAST((start_1based - 1) // 250 AS INT) AS bin, row_number() OVER (ORDER BY count(*) DESC, contig, (start_1based - 1) // 250) AS r FROM places WHERE kind = 'dsrna' GROUP BY contig, (start_1based - 1) // 250) JOIN refs USING (contig) WHERE r <= 20)", **{k: v for k, v in _CTX.items() if k in ("srna", "refs", "strands", "seeds", "places")}))
def _(spark, d):
    bins = _places(spark, d).where("kind = 'dsrna'").groupBy("contig", F.expr("CAST((start_1based - 1) div 250 AS INT)").alias("bin")).agg(F.count("*").alias("n"))
    top = bins.orderBy(F.desc("n"), "contig", "bin").limit(20)  # the report's length
    return A.contexts(top, references(spark, d).select("contig", "seq"), 250, 500)


# ---------------------------------------------------------------- hits and names


@query("a30_dedupe_sites", oracle("SELECT * EXCLUDE (r), row_number() OVER (ORDER BY allen, mfe_ratio DESC, hit_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, transcript, site9, site10, site11 ORDER BY allen, mfe_ratio DESC, hit_id) AS r FROM hits) WHERE r = 1", "hits"))
def _(spark, d):
    return E.ranked_hits(E.dedupe_best(X.hits(spark, d), ("site9", "site10", "site11"), "allen"), "allen")


_FILE = "concat('/data/', p_name, CASE p_partkey % 4 WHEN 0 THEN '_R1_001.fastq.gz' WHEN 1 THEN '_1_val_1.fq.gz' WHEN 2 THEN '_1.fq' ELSE '.txt' END)"
_SAFE = "coalesce(nullif(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), '{o}')"
_BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(file, '/', -1), '\\.(fq|fastq)(\\.gz)?$', ''), '_R?1(_001)?$', ''), '_1_val_1$', ''), '_1$', '')"


@query("f20_names", oracle(f"SELECT p_partkey, substring({_SAFE.format(x='odd', o='item')}, 1, 9) AS safe, coalesce(nullif(regexp_replace(regexp_replace(trim(odd), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'group') AS slug, {_SAFE.format(x=_BARE, o='sample')} AS sample, CASE WHEN p_partkey % 3 = 0 THEN 'antisense' WHEN p_partkey % 3 = 1 THEN 'sense' ELSE '.' END AS strand, p_partkey % 5 < 2 AS truthy, CAST(CASE WHEN p_size >= 48 THEN 10 WHEN p_size >= 45 THEN 8 WHEN p_size >= 44 THEN 7 WHEN p_size >= 43 THEN 6 WHEN p_size >= 40 THEN 5 ELSE 4 END AS INT) AS word_size, concat('v=', CAST(p_size AS VARCHAR)) AS last_value FROM (SELECT *, {_FILE} AS file, concat('__', p_name, '/#', p_brand, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '--x__' END) AS odd FROM part)"))
def _(spark, d):
    rows = X._table(spark, d, "part").withColumn("file", F.expr(_FILE)).withColumn("odd", F.expr("concat('__', p_name, '/#', p_brand, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '--x__' END)"))
    part = F.col("p_partkey")
    named = F.concat(F.col("p_name"), F.when(part % 3 == 0, "_antisense_1").when(part % 3 == 1, "_sense_1").otherwise("_1"))
    flag = F.when(part % 5 == 0, " Yes ").when(part % 5 == 1, "TRUE").when(part % 5 == 2, "no").otherwise(F.lit(None))
    pairs = S.key_values(F.array(F.lit("k=1"), F.lit("j=2"), F.concat(F.lit("k=v="), F.col("p_size").cast("string"))))
    return rows.select("p_partkey", S.safe_name(F.col("odd"), 9).alias("safe"), S.slug(F.col("odd")).alias("slug"), S.sample_name(F.col("file")).alias("sample"), S.name_strand(named, F.lit(".")).alias("strand"), S.truthy(flag).alias("truthy"), S.word_size(F.col("p_size") / 50.0).alias("word_size"), pairs["k"].alias("last_value"))
