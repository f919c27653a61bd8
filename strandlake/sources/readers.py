"""Readers of sequence and alignment files as DataFrames. Gzipped files are read whole by one task each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequences import mismatch_count, parse_tags
from strandlake.sources.lines import carried_headers, consecutive_groups, placed_lines


def _fasta_records(raw: DataFrame, *more: str) -> DataFrame:
    head = F.split("r", "\n", 2)
    cut = raw.select(F.regexp_replace(F.regexp_replace("value", "^﻿?>", ""), "\r", "").alias("r"), *more)
    named = cut.select(F.trim(head[0]).alias("h"), F.upper(F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s+", "")).alias("sequence"), *more).where("h <> ''")
    return named.select(F.regexp_extract("h", r"^(\S+)", 1).alias("name"), F.col("h").alias("description"), "sequence", *more)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, sequence (upper case). Records are cut at line breaks before ``>``, so files split over tasks."""
    return _fasta_records(spark.read.option("lineSep", "\n>").text(path))


def read_fasta_last(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``read_fasta``, the last of each name where a name repeats, and their length."""
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = _fasta_records(spark.read.option("lineSep", "\n>").text(path).select("value", order.alias("at")), "at")
    last = rows.groupBy("name").agg(F.max_by(F.struct("description", "sequence"), "at").alias("r"))
    return last.select("name", "r.description", "r.sequence", F.char_length("r.sequence").alias("length"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0 in each file) and value of all lines, in their order within each task.

    Lines count within their split of a file, and the splits' sizes, a row for each split, give where each begins. That table
    goes to every task: it has a row for 128 MB of input.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id")]
    lines = spark.read.text(path).select("value", *at)
    splits = lines.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    begins = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(F.broadcast(begins), ["file", "block"]).select("file", (F.col("_id") + F.col("_shift")).alias("number"), F.regexp_replace("value", "\r$", "").alias("value"))


_FIELDS = ("name", "sequence", "plus", "quality")


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whose four lines are in one task, and single lines (file, number, value) of those that two tasks share."""
    names = [*_FIELDS, "file", "number", "value"]
    left = None

    def single(lines: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.nulls(lines.num_rows, pa.string()) for _ in _FIELDS), *lines.columns], names=names)

    for batch in batches:
        rows = batch if left is None else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        number = rows.column(1).to_numpy()
        file = rows.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        n = len(number)
        starts = np.flatnonzero(number[: max(0, n - 3)] % 4 == 0)
        starts = starts[(number[starts + 3] == number[starts] + 3) & (file[starts + 3] == file[starts])]
        used = np.zeros(n, bool)
        for k in range(4):
            used[starts + k] = True
        # the last lines may go on in the next batch
        tail = n
        for k in range(1, min(3, n) + 1):
            if not used[n - k] and number[n - k] % 4 == 0:
                tail = n - k
                break
        if len(starts):
            text = rows.column(2)
            none = [pa.nulls(len(starts), t) for t in (pa.string(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*(text.take(pa.array(starts + k)) for k in range(4)), *none], names=names)
        lone = np.flatnonzero(~used[:tail])
        if len(lone):
            yield single(rows.take(pa.array(lone)))
        left = rows.slice(tail) if tail < n else None
    if left is not None:
        yield single(left)


def read_fastq(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """name, sequence, plus, quality; four lines a record. A record that is not well formed raises an error.

    Files split over tasks: only lines of records that two tasks share are shuffled. Blank lines at the end are left out.
    ``first`` keeps that many records from the start of each file.
    """
    lines = _numbered_lines(spark, path)
    if first is not None:
        lines = lines.where(F.col("number") < 4 * first)
    found = lines.mapInArrow(_whole_records, "name string, sequence string, plus string, quality string, file string, number long, value string")
    line = lambda k: F.max(F.when(F.col("number") % 4 == k, F.col("value")))
    shared = found.where("number is not null").groupBy("file", F.expr("number div 4").alias("record")).agg(*(line(k).alias(n) for k, n in enumerate(_FIELDS)))
    rows = found.where("number is null").select(*_FIELDS).unionByName(shared.select(*_FIELDS)).where(F.concat_ws("", *_FIELDS) != "")
    good = F.col("name").startswith("@") & F.col("plus").startswith("+") & (F.char_length("sequence") == F.char_length("quality"))
    return rows.select(F.when(F.coalesce(good, F.lit(False)), F.substring("name", 2, 1 << 30)).otherwise(F.raise_error(F.lit("malformed FASTQ record"))).alias("name"), "sequence", "plus", "quality")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """name and sequence of FASTA or FASTQ, told apart by the first letter."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    first = head[0]["value"].lstrip("\ufeff")[:1] if head else ">"
    if first not in (">", "@"):
        raise ValueError("neither FASTA nor FASTQ")
    return (read_fasta if first == ">" else read_fastq)(spark, path).select("name", F.upper("sequence").alias("sequence"))


def read_features(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """contig (``*`` where there is none), start, end (places from 0), label and kind (``span``) of a table of features; rows without a label are left out."""
    raw = spark.read.csv(path, header=True, sep=sep)
    have = {c.strip().lower().lstrip("\ufeff"): c for c in raw.columns}

    def text(other: str | None, *names: str) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have]
        return F.coalesce(*found, F.lit(other))

    rows = raw.select(text("*", "contig", "sequence").alias("contig"), _int(text("0", "start")).alias("start"), _int(text("0", "end")).alias("end"), text(None, "label", "name").alias("label"), text("span", "kind").alias("kind"))
    return rows.where("label is not null and start is not null and end is not null")


def features_of(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Features of texts CONTIG:START:END:LABEL[:KIND]."""
    parts = [t.split(":") for t in texts]
    if any(len(p) < 4 for p in parts):
        raise ValueError("a feature is CONTIG:START:END:LABEL[:KIND]")
    rows = [(p[0], int(p[1]), int(p[2]), p[3], p[4] if len(p) > 4 else "span") for p in parts]
    return spark.createDataFrame(rows, "contig string, start int, end int, label string, kind string")


def count_fastq(spark: SparkSession, path: str) -> int:
    lines = spark.read.text(path).count()
    if lines % 4:
        raise ValueError("the number of lines is no multiple of four")
    return lines // 4


def count_reads(spark: SparkSession, path: str) -> int:
    """The records of a FASTA or FASTQ file; none is an error."""
    n = read_sequences(spark, path).count()
    if not n:
        raise ValueError(f"no reads in {path}")
    return n


def _int(c: Column) -> Column:
    return c.try_cast("int")


_SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
_PAF = ("qname", "qlen", "qstart", "qend", "strand", "target", "tlen", "tstart", "tend", "matches", "block_len", "mapq")
_INTS = {"flag", "pos", "mapq", "pnext", "tlen", "qlen", "qstart", "qend", "tstart", "tend", "matches", "block_len"}


def _fields(names: tuple[str, ...]) -> list[Column]:
    return [(_int(F.col("f")[k]) if n in _INTS else F.col("f")[k]).alias(n) for k, n in enumerate(names)]


def read_sam(spark: SparkSession, path: str, mapped_only: bool = True) -> DataFrame:
    """The eleven fields and the tags of alignment lines; lines of under eleven fields and unmapped reads are left out."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@")).select(f.alias("f")).where(F.size("f") >= 11)
    rows = lines.select(*_fields(_SAM), parse_tags(F.slice("f", F.lit(12), F.size("f"))).alias("tags"))
    return rows.where(F.col("flag").bitwiseAND(4) == 0) if mapped_only else rows


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 12)
    return lines.select(*_fields(_PAF))


def read_sam_groups(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of a name-ordered SAM file with ``nm``, and of each read (consecutive lines of one name): group_size, group_valid and first_valid,

    of which valid are the perfect places: mapped and without a mismatch. A read's perfect places share it as 1 / group_valid.
    """
    lines = placed_lines(spark, path).where(~F.col("value").startswith("@")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 11).drop("value")
    nm = mismatch_count(parse_tags(F.slice("f", F.lit(12), F.size("f"))))
    perfect = (_int(F.col("f")[1]).bitwiseAND(4) == 0) & (nm == 0)
    found = consecutive_groups(lines, F.col("f")[0], perfect)
    return found.select(*_fields(_SAM), nm.alias("nm"), "group_size", "group_valid", "first_valid")


def read_paf_groups(spark: SparkSession, path: str, min_mapq: int = 0) -> DataFrame:
    """Lines of a name-ordered PAF file with their read's group_size, group_valid (lines of ``min_mapq``) and first_valid."""
    lines = placed_lines(spark, path).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 12).drop("value")
    found = consecutive_groups(lines, F.col("f")[0], F.coalesce(_int(F.col("f")[11]), F.lit(0)) >= min_mapq)
    return found.select(*_fields(_PAF), "group_size", "group_valid", "first_valid")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster_no, member, length, is_representative of a ``.clstr`` file; a cluster is one record, so nothing is ordered."""
    raw = spark.read.option("lineSep", "\n>Cluster").text(path).select(F.regexp_replace("value", "^>Cluster", "").alias("r"))
    lines = raw.select(F.regexp_extract("r", r"^\s*(\d+)", 1).try_cast("int").alias("cluster_no"), F.slice(F.split("r", "\n"), 2, 1 << 30).alias("l"))
    each = lines.select("cluster_no", F.posexplode("l").alias("i", "x")).where("trim(x) <> ''")
    out = each.select("cluster_no", "i", F.regexp_extract("x", r">(.+?)\.\.\.", 1).alias("member"), F.regexp_extract("x", r"(\d+)(?:nt|aa),", 1).try_cast("int").alias("length"), F.col("x").rlike(r"\*\s*$").alias("star"))
    first = out.groupBy("cluster_no").agg(F.coalesce(F.min(F.when(F.col("star"), F.col("i"))), F.min("i")).alias("r"))
    return out.join(first, "cluster_no").select("cluster_no", "member", "length", (F.col("i") == F.col("r")).alias("is_representative"))


_DUPLEX = r"^\s*([().&]+)\s+(\d+),(\d+)\s*:\s*(\d+),(\d+)\s+\(\s*(-?[0-9.]+)"


def read_rnaplex(spark: SparkSession, path: str) -> DataFrame:
    """transcript (of the last header before a line), structure, t_start, t_end, q_start, q_end, mfe of duplex lines; files split over tasks."""
    value, p = F.col("value"), _DUPLEX
    hit = carried_headers(placed_lines(spark, path), F.when(value.startswith(">"), F.regexp_extract(value, r">\s*(\S+)", 1)), value.rlike(p))
    return hit.select(F.col("header").alias("transcript"), F.regexp_extract("value", p, 1).alias("structure"), *(F.regexp_extract("value", p, k).cast("int").alias(n) for k, n in ((2, "t_start"), (3, "t_end"), (4, "q_start"), (5, "q_end"))), F.regexp_extract("value", p, 6).cast("double").alias("mfe"))


def read_manifest(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Samples of a sheet whose columns may have other names; rows without both reads are left out. A missing column of reads is an error.

    A sample without a replicate gets its number within its group, in the order of the file; without a group, its own id is the group.
    """
    raw = spark.read.csv(path, header=True, sep=sep).withColumn("_at", F.monotonically_increasing_id())
    have = {c.strip().lower(): c for c in raw.columns}

    def first(*names: str) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    reads = [("trimmed_read1", "read1", "r1"), ("trimmed_read2", "read2", "r2")]
    for names in reads:
        if not any(n in have for n in names):
            raise ValueError(f"the sheet has no column {names[1]}")
    rows = raw.select(
        "_at", first("sample_id", "sample", "name").alias("sample_id"), first("group", "condition", "sample_group").alias("group"), first("replicate", "rep").alias("replicate"),
        *(first(*names).alias(names[1]) for names in reads), F.regexp_replace(first("library_pairs", "trimmed_pairs", "read_pairs"), ",", "").try_cast("bigint").alias("library_pairs"),
    )
    rows = rows.where("read1 is not null and read2 is not null").withColumn("group", F.coalesce("group", "sample_id"))
    number = F.row_number().over(Window.partitionBy("group").orderBy("_at"))  # a row a sample
    return rows.withColumn("replicate", F.coalesce("replicate", number.cast("string"))).drop("_at")


def added_samples(samples: DataFrame, more: DataFrame) -> DataFrame:
    """``samples`` with those of ``more`` (sample_id, read1, read2 and the same others) whose pair of files is new; ids that are taken get ``_2``, ``_3``, ..."""
    new = more.join(samples.select("read1", "read2").distinct(), ["read1", "read2"], "left_anti").select(*samples.columns)
    first = Window.partitionBy("read1", "read2").orderBy("sample_id")
    new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    taken = samples.groupBy("sample_id").agg(F.count("*").alias("_taken"))
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("read1", "read2"))
    numbered = new.withColumn("_place", place).join(taken, "sample_id", "left").withColumn("_at", F.col("_place") + F.coalesce("_taken", F.lit(0)))
    named = numbered.withColumn("sample_id", F.when(F.col("_at") > 1, F.concat_ws("_", "sample_id", F.col("_at").cast("string"))).otherwise(F.col("sample_id")))
    return samples.unionByName(named.select(*samples.columns))


def chosen_samples(samples: DataFrame, ids: list[str]) -> DataFrame:
    """The samples of a sheet that are asked for; an id that the sheet does not have is an error."""
    found = samples.where(F.col("sample_id").isin(ids))
    missing = set(ids) - {r["sample_id"] for r in found.select("sample_id").distinct().collect()}  # a row a sample
    if missing:
        raise ValueError(f"no samples {sorted(missing)}")
    return found


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    """name and sequence as FASTA with lines of ``width``; 0 leaves a sequence on one line."""
    body = F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), "\n$", "") if width else F.col("sequence")
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), body)).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), F.concat_ws("\n", "name", "sequence", "plus", "quality"))).write.text(path)


def union_of_keys(rows: DataFrame, fields: str, order: str) -> DataFrame:
    """A column for each key of the map column ``fields`` of any row, in the order in which ``order`` and the maps first have them; missing ones are null.

    The keys come from one aggregate; they are the columns of a table, so there are few.
    """
    each = rows.select(order, F.posexplode(F.map_keys(fields)).alias("_at", "_key"))
    first = each.groupBy("_key").agg(F.min(F.struct(order, "_at")).alias("_first"))
    names = [r["_key"] for r in first.orderBy("_first", "_key").collect()]
    return rows.select(order, *(F.col(fields).getItem(n).alias(n) for n in names))


def write_rows(rows: DataFrame, path: str, fields: str = "fields", order: str = "idx", sep: str = "\t") -> None:
    """Rows of maps as a table with the union of their keys, in the order of ``order`` over the written parts; without rows an empty file."""
    wide = union_of_keys(rows, fields, order).orderBy(order).drop(order)
    if wide.columns:
        wide.write.csv(path, sep=sep, header=True, emptyValue="", nullValue="")
    else:
        rows.sparkSession.createDataFrame([], "value string").coalesce(1).write.text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def write_stats(df: DataFrame, path: str) -> None:
    """(metric, value) rows sorted by metric, one file: such a table has a row a counter."""
    df.orderBy("metric").coalesce(1).write.csv(path, header=True)
