"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import chat_format, collocations, decontaminate, license_scan, line_dedup, lm_score, near_dup, packing, pii, quality, secret_scan, simhash, spelling
from strandlake.llm.tables import table


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fitted_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": _on_documents(packing.pack_documents),
    "op2_license_scan": _on_documents(license_scan.op2_license_scan),
    "op3_chat_format": lambda spark, sf_dir: chat_format.op3_chat_format(table(spark, sf_dir, "conversations")),
    "op4_secret_scan": _on_documents(secret_scan.op4_secret_scan),
    "op5_minhash_near_dedup": _on_documents(near_dup.near_duplicates),
    "op6_lm_scoring": _on_documents(lm_score.scores),
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": _on_documents(pii.op9_pii),
    "op10_decontamination": lambda spark, sf_dir: decontaminate.op10_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op11_spelling_variants": _on_documents(spelling.spelling_variants),
    "op12_simhash_near_dedup": _on_documents(simhash.near_duplicates),
    "op13_collocations": _on_documents(collocations.collocations),
}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_chat_format": chat_format.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op13_collocations": collocations.ORACLE,
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, iw.n, item_id FROM dw JOIN iw USING (x, n)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
