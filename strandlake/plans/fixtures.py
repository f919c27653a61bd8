"""The driver's tables read as alignments, sequences, densities and hits, in Spark and as common table expressions of the oracles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ALN = [
    ("CAST(l_orderkey AS BIGINT)", "qname"),
    ("CASE l_returnflag WHEN 'A' THEN 's1' WHEN 'N' THEN 's2' ELSE 's3' END", "sample_id"),
    ("CASE WHEN l_returnflag = 'R' THEN 'g2' ELSE 'g1' END", "grp"),
    ("concat('c', CAST(l_suppkey % 25 AS STRING))", "contig"),
    ("CAST((l_partkey * 37 + l_orderkey * 11) % 1950 AS INT)", "start0"),
    ("CAST((l_partkey * 37 + l_orderkey * 11) % 1950 + CAST(l_quantity AS INT) AS INT)", "end0"),
    ("CASE l_linestatus WHEN 'O' THEN 'sense' ELSE 'antisense' END", "strand"),
    ("CAST((l_orderkey + l_linenumber) % 4 AS INT)", "nm"),
    ("CAST((l_partkey * 7) % 61 AS INT)", "mapq"),
    ("CAST(l_linenumber % 2 AS INT)", "mate"),
]
_HITS = [
    ("CAST(o_orderkey AS BIGINT)", "hit_id"),
    ("concat('q', CAST(o_custkey % 40 AS STRING))", "query"),
    ("CASE o_orderkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'signup' WHEN 2 THEN 'error' WHEN 3 THEN 'click' ELSE 'purchase' END", "transcript"),
    ("CAST(1 + (o_orderkey * 13) % 500 AS INT)", "site10"),
    ("CAST(2 + (o_orderkey * 13) % 500 AS INT)", "site9"),
    ("CAST((o_orderkey * 13) % 500 AS INT)", "site11"),
    ("CAST(70 + o_orderkey % 31 AS DOUBLE) / CAST(100 AS DOUBLE)", "mfe_ratio"),
    ("CAST(o_custkey % 9 AS DOUBLE) / CAST(2 AS DOUBLE)", "allen"),
    ("CAST(o_orderkey % 5 AS INT)", "mismatches"),
]
_DENS = "SELECT concat('e', CAST(user_id % 3 AS STRING)) AS sample_id, event_type AS transcript, 1 + CAST(floor(value) AS INT) % 500 AS pos, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY 1, 2, 3"
_ENCODE = "upper(translate(lower({clean}), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac'))"
CONTIG_LENGTH = 2000


#: What each byte of a text becomes, and those that go: all but A-Z and a-z, so every part of a longer character, too.
_LETTERS = bytes(b"ACGT"[((b | 32) - 97) % 4] for b in range(256))
_OTHERS = bytes(b for b in range(256) if not 97 <= b | 32 <= 122)


def encoded(text: Column) -> Column:
    """The letters of ``text`` as A, C, G, T in turn, as ``_ENCODE`` gives them: by bytes, as a pattern takes 30 times as long."""

    @F.arrow_udf("string")
    def letters(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.translate(_LETTERS, _OTHERS) for x in texts.cast(pa.binary()).to_pylist()], pa.string())

    return letters(text.cast("string"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listed(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{e} AS {n}" for e, n in columns)


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for e, n in _ALN))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for e, n in _HITS))


def dens(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["concat('e', CAST(user_id % 3 AS STRING)) AS sample_id", "event_type AS transcript", "1 + CAST(floor(value) AS INT) % 500 AS pos"]
    return _table(spark, sf_dir, "events").selectExpr(*key).groupBy("sample_id", "transcript", "pos").agg(F.count("*").alias("count"))


def refseq(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", prefix: str = "d") -> DataFrame:
    return _table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("contig"), encoded(F.col("text")).alias("seq"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, p, w): 21-mers of encoded turns at every 21 places, every tenth made of a repeated unit."""
    s = refseq_turns(spark, sf_dir).where("length(seq) >= 21")
    each = s.select("conv_id", "turn", F.posexplode(F.expr("transform(sequence(1, length(seq) - 20, 21), i -> substring(seq, i, 21))")).alias("p", "w"))
    unit = F.expr("substring(repeat(substring(w, 1, CAST(1 + turn % 6 AS INT)), 21), 1, 21)")
    return each.select("conv_id", "turn", F.col("p").cast("int").alias("p"), F.when(F.col("p") % 10 == 0, unit).otherwise(F.col("w")).alias("w"))


def refseq_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", encoded(F.col("text")).alias("seq"))


def bench_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sequence): 21-mers of the encoded benchmark at every 10 places."""
    s = refseq(spark, sf_dir, "benchmark", "item_id", "b").where("length(seq) >= 21")
    return s.select("contig", F.posexplode(F.expr("transform(sequence(1, length(seq) - 20, 10), i -> substring(seq, i, 21))")).alias("p", "sequence")).select(F.concat("contig", F.lit("_"), F.col("p").cast("string")).alias("id"), "sequence")


_DUCK_ENCODE = _ENCODE.format(clean="regexp_replace(text, '[^A-Za-z]', '', 'g')")
_CTES = {
    "aln": f"SELECT {_listed(_ALN)} FROM lineitem",
    "lib": "SELECT sample_id, grp, CAST(count(*) AS BIGINT) AS n_reads FROM aln GROUP BY 1, 2",
    "hits": f"SELECT {_listed(_HITS)} FROM orders",
    "dens": _DENS,
    "refseq": f"SELECT concat('d', CAST(doc_id AS STRING)) AS contig, {_DUCK_ENCODE} AS seq FROM documents",
    "bench": f"SELECT concat('b', CAST(item_id AS STRING)) AS contig, {_DUCK_ENCODE} AS seq FROM benchmark",
    "bkm": "SELECT concat(contig, '_', CAST(i AS STRING)) AS id, substring(seq, 1 + 10 * i, 21) AS sequence FROM (SELECT contig, seq, unnest(range(0, (length(seq) - 21) // 10 + 1)) AS i FROM bench WHERE length(seq) >= 21)",
    "turns": f"SELECT conv_id, turn, {_DUCK_ENCODE} AS seq FROM conversations",
    "words": "SELECT conv_id, turn, CAST(i AS INT) AS p, CASE WHEN i % 10 = 0 THEN substring(repeat(substring(x, 1, CAST(1 + turn % 6 AS INT)), 21), 1, 21) ELSE x END AS w FROM (SELECT conv_id, turn, i, substring(seq, 1 + 21 * i, 21) AS x FROM (SELECT conv_id, turn, seq, unnest(range(0, (length(seq) - 21) // 21 + 1)) AS i FROM turns WHERE length(seq) >= 21))",
}
_NEEDS = {"lib": ["aln"], "bkm": ["bench"], "words": ["turns"]}


def oracle(sql: str, *ctes: str, **more: str) -> str:
    names: list[str] = []
    for c in ctes:
        names += [x for x in [*_NEEDS.get(c, []), c] if x not in names]
    parts = [f"{n} AS ({_CTES[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
