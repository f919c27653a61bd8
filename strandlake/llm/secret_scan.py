"""Secret scan: fixed patterns and character Markov models.

The patterns find assigned passwords and tokens, access keys and long hex runs. Other strings of 20 characters or more are
scored by two first-order Markov models of characters, one of random strings and one of words and identifiers: the sum of
the log ratios of their transition probabilities over the string. The models are counted from labelled samples of a share of
about ``SAMPLE_DOCS`` documents, by hash: the values that the patterns found (random) and the words of other places (ordinary), each
bounded by ``SAMPLE_ROWS`` rows. A quarter of both is held out and sets the threshold: held-out words joined to identifiers stay
below it but for ``FALSE_SHARE`` of them. Everything is expressions over the row, so no text is shuffled.

Cases: a null text is empty. Spans of the models never overlap spans of the patterns. Repeated rows give repeated rows; an
empty table gives none; without any labelled random string its model is uniform.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.spans import constant_doubles, joined, matches, overlapping, tagged

# fixed values: the base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Rows of each labelled sample, and documents that they are taken from, about.
SAMPLE_ROWS, SAMPLE_DOCS = 5_000, 20_000
#: The share of held-out identifiers that may score as random; the mean log ratio of a transition, in nats, from which a string counts as random where fewer than ``LEAST_HELD`` words are held out, and the least elsewhere.
FALSE_SHARE, PLAIN_RATIO, LEAST_HELD, LEAST_RATIO = 0.002, 0.5, 100, 0.2
_FIRST, _WIDTH = 33, 94  # printable ASCII


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(matches(text, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12)
    access = F.filter(matches(text, ACCESS, text.contains("AKIA")), lambda s: s["end"] - s["start"] >= 18)
    return {"assign": assign, "access": access, "hex": matches(text, HEX)}


@dataclass(frozen=True)
class Markov:
    """The log ratio of each pair of characters, and the mean from which a string counts as random."""

    ratios: list[float]
    threshold: float

    def mean(self, value: str) -> float:
        places = [(ord(a) - _FIRST) * _WIDTH + ord(b) - _FIRST for a, b in zip(value, value[1:], strict=False)]
        return sum(self.ratios[p] for p in places) / max(1, len(places))


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the rows, by a hash of the doc_id; all where there are fewer."""
    share = min(1.0, rows / max(1, docs.count()))
    return docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))


def train(docs: DataFrame) -> Markov:
    """Both models and the threshold; at most ``SAMPLE_ROWS`` strings of a kind reach the driver."""
    some = sample_of(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), SAMPLE_DOCS)
    spans = base_spans(F.col("text"))
    secret = some.select("doc_id", F.explode(F.concat(F.transform(spans["assign"], lambda s: F.regexp_extract(s["value"], ASSIGN, 2)), *(F.transform(spans[k], lambda s: s["value"]) for k in ("access", "hex")))).alias("s"))
    words = some.select("doc_id", F.explode(F.regexp_extract_all(F.regexp_replace("text", ASSIGN, " "), F.lit(r"(?<![!-~])[A-Za-z][A-Za-z_-]{5,}"), F.lit(0))).alias("s"))
    found = [[r["s"] for r in df.orderBy(F.xxhash64("doc_id", "s"), "doc_id", "s").limit(SAMPLE_ROWS).collect()] for df in (words, secret)]
    return fit(*found)


def fit(words: list[str], secrets: list[str]) -> Markov:
    """Strings whose checksum divides by four are held out, with all their repeats."""
    counts: Counter = Counter()
    apart = lambda v: zlib.crc32(v.encode()) % 4 == 0
    for label, values in enumerate((words, secrets)):
        for v in values:
            if not apart(v):
                counts.update((label, v[k : k + 2]) for k in range(len(v) - 1))
    model = Markov(log_ratios(counts), PLAIN_RATIO)
    held, names = sorted({v for v in words if apart(v)}, key=lambda v: zlib.crc32(v.encode())), []
    for i in range(len(held)):
        # identifiers of held-out words, as long as candidates are
        name, k = held[i], i
        while len(name) < 20:
            k += 7
            name += "_-/"[k % 3] + held[k % len(held)]
        names.append(name)
    scores = sorted(model.mean(n) for n in names)
    if len(scores) >= LEAST_HELD:
        model = Markov(model.ratios, max(LEAST_RATIO, scores[min(len(scores) - 1, math.ceil((1 - FALSE_SHARE) * len(scores)))] + 1e-6))
    return model


def log_ratios(counts: dict[tuple[int, str], int], alpha: float = 0.5) -> list[float]:
    n = [[[alpha] * _WIDTH for _ in range(_WIDTH)] for _ in range(2)]
    for (label, two), k in counts.items():
        a, b = (ord(c) - _FIRST for c in two)
        if 0 <= a < _WIDTH and 0 <= b < _WIDTH:
            n[label][a][b] += k
    out = []
    for a in range(_WIDTH):
        rows = [n[k][a] for k in range(2)]
        sums = [sum(r) for r in rows]
        out += [math.log(rows[1][b] / sums[1]) - math.log(rows[0][b] / sums[0]) for b in range(_WIDTH)]
    return out


def mean_ratio(value: Column, table: Column) -> Column:
    code = lambda i: F.ascii(F.substring(value, i, F.lit(1))) - _FIRST
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(value) - 1), F.lit(0.0), lambda s, i: s + F.element_at(table, code(i) * _WIDTH + code(i + 1) + 1))
    return total / (F.char_length(value) - 1)


def secrets(docs: DataFrame, model: Markov) -> DataFrame:
    """doc_id, the number of spans of each base kind, ``base`` and ``spans`` (arrays of start, ord, end, kind)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id"), text.alias("_t"))
    found = found.select("doc_id", "_t", *(c.alias(k) for k, c in base_spans(F.col("_t")).items()))
    base = F.concat(*(tagged(F.col(k), k, i) for i, k in enumerate(("assign", "access", "hex"))))
    found = found.select("doc_id", "_t", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), base.alias("base"))
    table = constant_doubles(model.ratios)
    other = F.filter(matches(F.col("_t"), CANDIDATE), lambda s: ~overlapping(s, F.col("base")) & (mean_ratio(s["value"], table) >= model.threshold))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.concat("base", tagged(other, "random", 3)).alias("spans"))


def op4_secret_scan(docs: DataFrame) -> DataFrame:
    found = secrets(docs, train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
