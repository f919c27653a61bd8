"""Column functions on nucleotide sequences, alignment tags, names and numbers; native but for the run and k-mer profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.profiles import sequence_profile


def normalize_rna(s: Column) -> Column:
    """Upper case without white space, T as U; null where another letter than AUCGN remains."""
    out = F.translate(F.upper(F.regexp_replace(s, r"\s+", "")), "T", "U")
    return F.when(out.rlike("^[AUCGN]+$"), out)


def letters_to_rna(s: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(s, "[^A-Za-z]", "")), "T", "U")


def to_dna(s: Column) -> Column:
    return F.translate(F.upper(s), "U", "T")


def reverse_complement(s: Column, rna: bool = False) -> Column:
    return F.reverse(F.translate(s, "AUCG", "UAGC") if rna else F.translate(s, "ACGTN", "TGCAN"))


def count_of(s: Column, base: str) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(base), F.lit("")))


def entropy(s: Column, over_all: bool = False) -> Column:
    """Shannon entropy of A, C, G, T in bits; the denominator is their number, or the full length."""
    counts = [count_of(s, b) for b in "ACGT"]
    total = F.char_length(s) if over_all else sum(counts[1:], counts[0])
    terms = [F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(0.0) for n in counts]
    return F.when(total > 0, sum(terms[1:], terms[0])).otherwise(0.0)


def longest_homopolymer(s: Column) -> Column:
    """(base, len) of the first run that reaches the greatest length."""
    p = sequence_profile(s)
    return F.struct(p["base"].alias("base"), p["run"].alias("len"))


def kmers(s: Column, k: int) -> Column:
    n = F.char_length(s)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def dominant_kmer(s: Column, k: int, acgt_only: bool = False) -> Column:
    """(motif, fraction) of the commonest k-mer, k 2 or 3, the first seen wins ties; empty and 0 without any."""
    p, name = sequence_profile(s), "acgt_" if acgt_only else ""
    top, all_ = p[f"{name}top{k}"], p[f"{name}all{k}"]
    return F.struct(p[f"{name}motif{k}"].alias("motif"), F.when(all_ > 0, top / all_).otherwise(0.0).alias("fraction"))


def repeated_unit(s: Column, longest: int = 6) -> Column:
    """The shortest unit of which the sequence is three or more repeats, the last maybe cut; else empty."""
    n = F.char_length(s)
    fits = lambda u: (u * 3 <= n) & (F.substring(F.repeat(F.substring(s, F.lit(1), u), F.ceil(n / u).cast("int")), F.lit(1), n) == s)
    units = F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda u: (n > 0) & fits(u))
    return F.coalesce(F.substring(s, F.lit(1), F.get(units, F.lit(0))), F.lit(""))


def simple_sequence_reason(s: Column) -> Column:
    """The first reason for which a short read counts as simple, else null."""
    n, acgt = F.char_length(s), sum((count_of(s, b) for b in "CGT"), count_of(s, "A"))
    kinds = sum((F.when(count_of(s, b) > 0, 1).otherwise(0) for b in "CGT"), F.when(count_of(s, "A") > 0, 1).otherwise(0))
    top, run = F.greatest(*(count_of(s, b) for b in "ACGT")), longest_homopolymer(s)["len"]
    return (
        F.when(n == 0, "empty")
        .when(acgt == 0, "no_acgt")
        .when(count_of(s, "N") / n > 0.10, "too_many_n")
        .when(kinds <= 2, "one_or_two_base_alphabet")
        .when(top / acgt >= 0.80, "dominant_single_base")
        .when((run >= 8) | (run / n >= 0.60), "long_homopolymer")
        .when(dominant_kmer(s, 2)["fraction"] >= 0.70, "dominant_2mer")
        .when(dominant_kmer(s, 3)["fraction"] >= 0.70, "dominant_3mer")
    )


def low_complexity_reason(s: Column, shortest: int = 18, longest: int = 30, most_n: float = 0.10, dominant: float = 0.80, least_entropy: float = 1.25, run_fraction: float = 0.60, run_length: int = 8, most_2mer: float = 0.70, most_3mer: float = 0.70) -> Column:
    """The first failed rule of the full complexity filter, else null; a length bound of 0 is off."""
    n, acgt = F.char_length(s), sum((count_of(s, b) for b in "CGT"), count_of(s, "A"))
    kinds = sum((F.when(count_of(s, b) > 0, 1).otherwise(0) for b in "CGT"), F.when(count_of(s, "A") > 0, 1).otherwise(0))
    top, run = F.greatest(*(count_of(s, b) for b in "ACGT")), longest_homopolymer(s)["len"]
    return (
        F.when(F.lit(shortest > 0) & (n < shortest), "too_short")
        .when(F.lit(longest > 0) & (n > longest), "too_long")
        .when(~s.rlike("^[ACGTN]*$"), "non_acgtn")
        .when(count_of(s, "N") / F.greatest(n, F.lit(1)) > most_n, "too_many_n")
        .when(acgt == 0, "no_acgt_bases")
        .when(kinds <= 2, "one_or_two_base_alphabet")
        .when(top / acgt >= dominant, "dominant_single_base")
        .when(entropy(s) < least_entropy, "low_shannon_entropy")
        .when((run >= run_length) | (run / n >= run_fraction), "long_homopolymer_run")
        .when(dominant_kmer(s, 2, True)["fraction"] >= most_2mer, "dominant_dinucleotide")
        .when(dominant_kmer(s, 3, True)["fraction"] >= most_3mer, "dominant_trinucleotide")
    )


def cigar_reference_length(cigar: Column, seq: Column) -> Column:
    sizes = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.when(cigar == "*", F.char_length(seq)).otherwise(F.aggregate(sizes, F.lit(0), lambda a, x: a + x.cast("int")))


def md_mismatches(md: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_replace(md, r"\^[A-Za-z]+", ""), "[^A-Za-z]", ""))


def mismatch_count(tags: Column) -> Column:
    """The first of NM, XM, XA that is present, as a number (null if it is none); else from MD; else null."""
    found = F.lit(None).cast("int")
    found = F.when(F.map_contains_key(tags, "MD"), md_mismatches(F.try_element_at(tags, F.lit("MD")))).otherwise(found)
    for tag in ("XA", "XM", "NM"):
        value = F.try_element_at(tags, F.lit(tag))
        found = F.when(F.map_contains_key(tags, tag), F.when(value.rlike(r"^[+-]?[0-9]{1,9}$"), value.cast("int"))).otherwise(found)
    return found


def parse_tags(fields: Column) -> Column:
    """TAG:TYPE:VALUE fields as a map; the last of equal tags wins."""
    parts = F.transform(F.filter(fields, lambda x: F.size(F.split(x, ":", 3)) == 3), lambda x: F.split(x, ":", 3))
    keys = F.array_distinct(F.transform(parts, lambda p: p[0]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(parts, lambda p: p[0] == k), -1)[2])))


def cpm_from_name(name: Column, fractions: bool = True) -> Column:
    """The value of an ``_…CPM`` token: a decimal (p for the point), or a fraction where those are read."""
    token = F.regexp_extract(name, r"_([0-9]+/[0-9]+|[0-9]+(?:(?:p_?|\.)[0-9]+)?)CPM(?:$|_)", 1)
    top, bottom = (F.try_element_at(F.split(token, "/"), F.lit(k)).try_cast("double") for k in (1, 2))
    plain = F.regexp_replace(F.regexp_replace(token, "p_", "."), "p", ".").try_cast("double")
    whole = F.when(token.contains("/"), F.try_divide(top, bottom) if fractions else F.lit(0.0)).otherwise(plain)
    return F.when(token == "", 0.0).otherwise(F.coalesce(whole, F.lit(0.0)))


def binomial_at_least_one(n: Column, p: Column) -> Column:
    return F.when((n <= 0) | (p <= 0), 1.0).when(p >= 1, 1.0).otherwise(1 - F.pow(1 - p, n))


def clamp_pvalue(p: Column) -> Column:
    return F.when(F.isnan(p) | p.isNull() | (F.abs(p) == float("inf")), 1.0).otherwise(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0)))


def complexity(s: Column) -> dict[str, Column]:
    """The complexity record: 17 figures of a sequence, all flags that hold joined by ``;``, and whether any does."""
    s = F.translate(F.upper(s), "U", "T")
    n, p = F.char_length(s), sequence_profile(s)
    counts = {b: count_of(s, b) for b in "ACGT"}
    acgt = F.greatest(sum((counts[b] for b in "CGT"), counts["A"]), F.lit(1))
    gc, at = (counts["G"] + counts["C"]) / acgt, (counts["A"] + counts["T"]) / acgt
    kinds = sum((F.when(counts[b] > 0, 1).otherwise(0) for b in "CGT"), F.when(counts["A"] > 0, 1).otherwise(0))
    top = F.greatest(*counts.values())
    base = F.when(counts["A"] == top, "A").when(counts["C"] == top, "C").when(counts["G"] == top, "G").otherwise("T")
    run_fraction = F.when(n > 0, p["run"] / n).otherwise(0.0)
    di, tri = (F.when(p[f"all{k}"] > 0, p[f"top{k}"] / p[f"all{k}"]).otherwise(0.0) for k in (2, 3))
    unit, bits = repeated_unit(s), entropy(s, over_all=True)
    # fixed values: names and limits of the flags, in the order in which they are listed
    flags = [
        F.when(kinds <= 2, "one_or_two_base_alphabet"), F.when(top / acgt >= 0.80, "dominant_single_base"), F.when((p["run"] >= 8) | (run_fraction >= 0.60), "long_homopolymer"),
        F.when(di >= 0.70, "dominant_dinucleotide"), F.when(tri >= 0.70, "dominant_trinucleotide"), F.when(unit != "", F.concat(F.lit("tandem_repeat_"), unit)),
        F.when(bits < 1.25, "low_entropy"), F.when((gc >= 0.85) | (gc <= 0.15), "strong_gc_at_bias"), F.when(F.when(n > 0, count_of(s, "N") / n).otherwise(0.0) > 0.10, "many_N"),
    ]
    joined = F.array_join(F.array_compact(F.array(*flags)), ";")
    r4 = lambda c: F.round(c, 4)
    return {
        "length": n, "gc_fraction": r4(gc), "at_fraction": r4(at), "unique_bases": kinds, "entropy_bits": r4(bits), "dominant_base": base, "dominant_base_fraction": r4(top / acgt),
        "longest_homopolymer_base": p["base"], "longest_homopolymer_length": p["run"], "longest_homopolymer_fraction": r4(run_fraction), "dominant_dinucleotide": p["motif2"], "dominant_dinucleotide_fraction": r4(di),
        "dominant_trinucleotide": p["motif3"], "dominant_trinucleotide_fraction": r4(tri), "tandem_repeat_unit": unit, "low_complexity": joined != "", "complexity_flags": joined,
    }


def restored_read(flag: Column, seq: Column, quality: Column) -> tuple[Column, Column]:
    """Sequence and quality as the sequencer gave them: reads that SAM holds reversed are turned back."""
    turned, dna = flag.bitwiseAND(16) != 0, to_dna(seq)
    return F.when(turned, reverse_complement(dna)).otherwise(dna), F.when(turned, F.reverse(quality)).otherwise(quality)


def cpm_token(value: Column) -> Column:
    """0 without any; whole numbers from 1 on (halves to even); below, the nearest fraction with a denominator of 100 at most, the smallest of equals."""
    near = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda d: F.struct(F.abs(value - F.round(value * d) / d).alias("off"), d.alias("d"), F.round(value * d).cast("int").alias("n")))
    best = F.array_min(near)
    return F.when(value <= 0, "0").when(value >= 1, F.greatest(F.lit(1), F.bround(value).cast("long")).cast("string")).otherwise(F.concat(best["n"].cast("string"), F.lit("/"), best["d"].cast("string")))


def export_name(contig: Column, start: Column, length: Column, strand: Column, mismatches: Column, mean_cpm: Column) -> Column:
    return F.concat(contig, F.lit("_"), start.cast("string"), F.lit("pos_"), length.cast("string"), F.lit("len_"), strand, F.lit("_"), mismatches.cast("string"), F.lit("m_"), cpm_token(mean_cpm), F.lit("CPM"))


def aligned_blocks(cigar: Column, start0: Column) -> Column:
    """The reference intervals (start0, end0) that M, = and X cover; D and N part them, I, S, H and P take no reference."""
    sizes, kinds = (F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(k)) for k in (1, 2))
    ops = F.arrays_zip(sizes.alias("n"), kinds.alias("op"))
    none = F.array().cast("array<struct<start0:int,end0:int>>")

    def step(acc: Column, x: Column) -> Column:
        n = x["n"].cast("int")
        block = F.struct(acc["at"].alias("start0"), (acc["at"] + n).alias("end0"))
        return F.struct(
            F.when(x["op"].isin("M", "D", "N", "=", "X"), acc["at"] + n).otherwise(acc["at"]).alias("at"),
            F.when(x["op"].isin("M", "=", "X"), F.concat(acc["blocks"], F.array(block))).otherwise(acc["blocks"]).alias("blocks"),
        )

    return F.aggregate(ops, F.struct(start0.cast("int").alias("at"), none.alias("blocks")), step, lambda a: a["blocks"])


def pvalue_method(name: Column) -> Column:
    """The named method of the p-value: by category and rank, or the empirical one, which stands for unknown names too."""
    return F.when(name.isin("cleaveland_category_rank", "cleaveland"), "cleaveland_category_rank").otherwise("transcript_peak_empirical")


def safe_name(s: Column, longest: int = 140, other: str = "item", kept: str = "A-Za-z0-9_.-") -> Column:
    """Runs of characters but the ``kept`` ones become one underscore; those at both ends go, then what is beyond ``longest`` (0: nothing); ``other`` stands for an empty one."""
    out = F.regexp_replace(F.regexp_replace(s, f"[^{kept}]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(out, 1, longest) if longest else out, F.lit("")), F.lit(other))


def slug(s: Column, other: str = "group") -> Column:
    return safe_name(F.trim(s), 0, other, "A-Za-z0-9")


def sample_name(path: Column) -> Column:
    """The name of a sample from the file of its first reads: without folder, suffix and the marks of read 1."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.(fq|fastq)(\.gz)?$", "")
    for mark in (r"_R?1(_001)?$", r"_1_val_1$", r"_1$"):
        name = F.regexp_replace(name, mark, "")
    return safe_name(name, 0, "sample")


def name_strand(name: Column, other: Column) -> Column:
    """The strand in a name, else ``other``."""
    return F.when(F.contains(name, F.lit("_antisense_")), "antisense").when(F.contains(name, F.lit("_sense_")), "sense").otherwise(other)


def truthy(s: Column) -> Column:
    return F.coalesce(F.lower(F.trim(s)).isin("true", "1", "yes", "y"), F.lit(False))


def word_size(identity: Column) -> Column:
    """Letters of a clustering word by identity."""
    return F.when(identity >= 0.95, 10).when(identity >= 0.90, 8).when(identity >= 0.88, 7).when(identity >= 0.85, 6).when(identity >= 0.80, 5).otherwise(4)


def key_values(items: Column) -> Column:
    """An array of ``key=value`` as a map, the last of equal keys; an item without ``=`` raises an error."""
    good = F.transform(items, lambda x: F.when(F.contains(x, F.lit("=")), x).otherwise(F.raise_error(F.concat(F.lit("not KEY=VALUE: "), x))))
    keys = F.array_distinct(F.transform(good, lambda x: F.substring_index(x, "=", 1)))
    last = lambda k: F.element_at(F.filter(good, lambda x: F.substring_index(x, "=", 1) == k), -1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.regexp_replace(last(k), "^[^=]*=", "")))


def cpm(count: Column, library: Column) -> Column:
    return F.coalesce(F.try_divide(count * F.lit(1e6), library), F.lit(0.0))


def context_bounds(start: Column, end: Column, length: Column, extension: float) -> tuple[Column, Column]:
    by = F.bround((end - start) * F.lit(extension)).cast("int")
    return F.greatest(F.lit(0), start - by), F.least(length, end + by)
