"""Quality rules with tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated three-word windows. The fertility rules encode each text with two
public vocabularies, a byte-level one and one of pieces with byte fallback, and reject it where characters per token of
either, the share of byte-fallback tokens or the entropy of its tokens leave the band of its language. A language without a
band takes that of its script.

``fitted_rules`` fits the bands: from all labelled rows, the median of the good documents of a language and their spread, which is wider
for short texts; ``KEPT`` of the good documents lie inside all bands. Figures are counted in steps of ``STEP``, so that a language's
medians come from a bounded number of values, exactly.

Cases: a null or empty text has no words and fails. A null language takes the band of the script. Repeated rows give
repeated rows. Columns other than ``doc_id``, ``text`` and ``lang`` are left alone by ``quality`` and kept by ``keep_good``. An empty
table gives none; without labels the bands are ``QualityRules``' wide ones.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.subwords import CACHE_WORDS, BlockEncoder, block_encoder
from strandlake.llm.tables import cut, split_by_ids, stored
from strandlake.llm.textblocks import Block, blocks, mix, trimmed, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Labelled rows a language needs for a band of its own, the share of good ones inside, and the step of figures in the fit.
LEAST_ROWS, KEPT, STEP = 60, 0.998, 1e-4
#: Up to this token count, counts are told apart in a median; above, they are rounded to three digits.
EXACT_TOKENS = 10_000
#: The figures that have fitted bands.
FIGURES = ("chars_per_token", "chars_per_piece", "fallback_share")


@dataclass(frozen=True)
class Spread:
    """A median and the variance about it, of which ``of_one`` is divided by the number of tokens."""

    middle: float
    fixed: float
    of_one: float

    def off(self, value: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standard deviations from the middle."""
        return (value - self.middle) / np.sqrt(self.fixed + self.of_one / np.maximum(n, 1))


@dataclass(frozen=True)
class Band:
    """Accepted ranges; entropy as a share of the most that the text's length allows. ``spreads``, of the figures in order, narrow them."""

    chars_per_token: tuple[float, float] = (0.3, 12.0)
    most_fallback: float = 0.6
    least_entropy: float = 0.40
    spreads: tuple[Spread, ...] = ()
    most_off: float = 4.0

    def holds(self, figures: np.ndarray) -> np.ndarray:
        n, per, entropy, per_piece, fallback = figures.T
        low, high = self.chars_per_token
        out = (per >= low) & (per <= high) & (per_piece >= low) & (per_piece <= high) & (fallback <= self.most_fallback) & (entropy >= self.least_entropy)
        return out & (self.off(figures) <= self.most_off)

    def off(self, figures: np.ndarray) -> np.ndarray:
        """The largest distance of a figure from its middle; more fallback than usual counts, less does not."""
        n, per, _, per_piece, fallback = figures.T
        out = np.zeros(len(figures))
        for k, (spread, value) in enumerate(zip(self.spreads, (per, per_piece, fallback), strict=False)):
            off = spread.off(value, n)
            out = np.maximum(out, off if k == 2 else np.abs(off))
        return out


@dataclass(frozen=True)
class QualityRules:
    least_words: int = 50
    most_repeated_percent: int = 50
    vocabulary: str = "byte_bpe_50k.tiktoken"
    pieces: str = "piece_bpe_32k.model"
    #: By language; scripts (latin, other) serve for languages that are not named.
    bands: dict[str, Band] = field(default_factory=lambda: {"latin": Band(chars_per_token=(1.2, 12.0)), "other": Band()})


OUT = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    + [("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("token_entropy", pa.float64()), ("chars_per_piece", pa.float64()), ("fallback_share", pa.float64())]
)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, token_entropy double, chars_per_piece double, fallback_share double"


@functools.cache
def pieces(name: str) -> tuple:
    """The sentence-piece processor and which of its ids are byte-fallback tokens."""
    import public_tokenizers
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return found, np.array([found.is_byte(i) for i in range(found.get_piece_size())])


def base_counts(block: Block) -> dict[str, np.ndarray]:
    _, _, rows, hashes = block.words()
    ink = ~_SPACE[block.data]
    counts = {"n_words": np.bincount(rows, minlength=block.rows), "word_chars": block.per_row(ink & ((block.data & 0xC0) != 0x80)), "n_symbols": block.per_row(_SYMBOL[block.data])}
    starts, ends, line_rows, line_hashes = block.lines()
    inked = np.concatenate([[0], np.cumsum(ink)])
    worded = inked[ends] > inked[starts]
    own = mix(line_hashes[worded] ^ mix(line_rows[worded].astype(np.uint64)))
    _, first = np.unique(own, return_index=True)
    counts["n_dup_lines"] = np.bincount(line_rows[worded], minlength=block.rows) - np.bincount(line_rows[worded][first], minlength=block.rows)
    at, found = windows(hashes, rows, 3)
    _, which, times = np.unique(mix(found ^ mix(rows[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    covered = np.zeros(len(rows) + 2, bool)
    again = at[times[which] > 1]
    for k in range(3):
        covered[again + k] = True
    counts["n_repeat_words"] = np.bincount(rows[covered[: len(rows)]], minlength=block.rows)
    return counts


def entropy_share(ids: np.ndarray, size: int) -> float:
    """The entropy of the ids as a share of the largest that so many can have."""
    if len(ids) == 0:
        return 0.0
    ordered = np.sort(ids)
    times = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
    share = times / len(ids)
    most = np.log2(min(len(ids), size))
    return float(-(share * np.log2(share)).sum() / most) if most else 1.0


class PieceCounter:
    """Pieces and byte-fallback pieces of words, each taken by itself; those of a bounded number of words are remembered."""

    def __init__(self, name: str):
        self.processor, self.is_byte = pieces(name)
        self.known: dict[int, int] = {}
        self.counts = np.zeros((1 << 14, 2), np.int64)

    def count(self, block: Block) -> np.ndarray:
        """A row's pieces and byte-fallback pieces."""
        starts, ends, rows, hashes = block.words()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        listed, raw = keys.tolist(), block.data.tobytes()
        new = [k for k, x in enumerate(listed) if x not in self.known]
        while len(self.known) + len(new) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        texts = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]]
        found = self.processor.encode(texts) if texts else []
        size = np.array([len(f) for f in found], np.int64)
        fallback = self.is_byte[np.fromiter(itertools.chain.from_iterable(found), np.int64, size.sum())]
        at = len(self.known)
        self.counts[at : at + len(new), 0] = size
        self.counts[at : at + len(new), 1] = np.bincount(np.repeat(np.arange(len(new)), size), fallback, len(new))
        self.known.update(zip([listed[k] for k in new], range(at, at + len(new)), strict=True))
        each = self.counts[[self.known[x] for x in listed]][which] if listed else np.zeros((0, 2), np.int64)
        return np.stack([np.bincount(rows, each[:, k], block.rows) for k in range(2)], 1)


@dataclass
class Measures:
    """What a task measures with."""

    encoder: BlockEncoder
    counter: PieceCounter

    @classmethod
    def of(cls, rules: QualityRules) -> Measures:
        return cls(block_encoder(rules.vocabulary), PieceCounter(rules.pieces))


def fertility(block: Block, by: Measures) -> np.ndarray:
    """Of each row: tokens, characters per token, entropy share, characters per piece and the share of byte-fallback pieces; words alone have pieces."""
    ids, bounds = by.encoder.encode(block)
    chars = block.per_row((block.data & 0xC0) != 0x80)
    found, out = by.counter.count(block), np.zeros((block.rows, 5))
    for i in range(block.rows):
        own = ids[bounds[i] : bounds[i + 1]]
        if len(own) and found[i, 0]:
            out[i] = len(own), chars[i] / len(own), entropy_share(own, by.encoder.words.size), chars[i] / found[i, 0], found[i, 1] / found[i, 0]
    return out


def _judged(block: Block, langs: list[str | None], rules: QualityRules, by: Measures) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base failures, verdicts, and the fertility figures of a block's rows."""
    counts = base_counts(block)
    failed = (counts["n_words"] < rules.least_words) | (100 * counts["n_repeat_words"] > rules.most_repeated_percent * counts["n_words"])
    figures = fertility(block, by)
    return counts, failed, ~failed & _passed(langs, _latin(block), figures, rules), figures


def _latin(block: Block) -> np.ndarray:
    return 1.5 * block.per_row((block.data & 0xC0) != 0x80) > np.diff(block.offsets)


def _passed(langs: list[str | None], latin: np.ndarray, figures: np.ndarray, rules: QualityRules) -> np.ndarray:
    """Whether the figures of rows are in the bands of their languages or scripts."""
    name = np.array([x if x in rules.bands else "latin" if y else "other" for x, y in zip(langs, latin, strict=True)], object)
    passed = np.zeros(len(name), bool)
    for band in set(name.tolist()):
        passed[name == band] = rules.bands[band].holds(figures[name == band])
    return passed


def fit_bands(figures: DataFrame, kept: float = KEPT) -> dict[str, Band]:
    """The bands of good documents by language: figures has lang, n (tokens) and those of ``FIGURES``, and is read four times.

    A row a language reaches the driver in each step.
    """
    stepped = lambda c: F.round(c / STEP) * STEP
    digits = F.when(F.col("n") <= EXACT_TOKENS, F.col("n")).otherwise(F.round(F.col("n") / F.pow(F.lit(10.0), F.floor(F.log10("n")) - 2)) * F.pow(F.lit(10.0), F.floor(F.log10("n")) - 2))
    middles = figures.groupBy("lang").agg(F.count("*").alias("rows"), F.percentile(digits, 0.5).alias("_n"), *(F.percentile(stepped(F.col(c)), 0.5).alias(f"_{c}") for c in FIGURES)).where(F.col("rows") >= LEAST_ROWS)
    middles = cut(middles)
    with_middles = figures.join(F.broadcast(middles), "lang")
    short = F.col("n") <= F.col("_n")
    # variances by median deviations, so that a few odd documents do not widen them
    off = lambda c, some: F.percentile(F.when(some, stepped(F.abs(F.col(c) - F.col(f"_{c}")))), 0.5)
    spread = with_middles.groupBy("lang").agg(
        F.avg(F.when(~short, 1 / F.col("n"))).alias("long_n"), F.avg(F.when(short, 1 / F.col("n"))).alias("short_n"), *(off(c, ~short).alias(f"long_{c}") for c in FIGURES), *(off(c, short).alias(f"short_{c}") for c in FIGURES), *(F.first(f"_{c}").alias(f"_{c}") for c in FIGURES)
    )
    bands = {}
    for r in spread.collect():  # a row a language
        spreads = []
        for c in FIGURES:
            high = max(1e-9, (1.4826 * r[f"short_{c}"]) ** 2)
            low = high if r[f"long_{c}"] is None else max(1e-9, (1.4826 * r[f"long_{c}"]) ** 2)
            n_high, n_low = 1 / r["short_n"], 1 / (r["short_n"] if r["long_n"] is None else r["long_n"])
            of_one = max(0.0, (high - low) / (1 / n_high - 1 / n_low)) if n_low > n_high else 0.0
            spreads.append(Spread(r[f"_{c}"], max(low - of_one / n_low, low / 4), of_one))
        bands[r["lang"]] = Band(spreads=tuple(spreads))
    if not bands:
        return bands

    def distance(band: Band) -> Column:
        by = [(F.col(c) - s.middle) / F.sqrt(s.fixed + s.of_one / F.greatest(F.col("n"), F.lit(1.0))) for c, s in zip(FIGURES, band.spreads, strict=True)]
        return F.greatest(F.lit(0.0), F.abs(by[0]), F.abs(by[1]), by[2])

    # distances beyond 100 count as 100, so that there are a million steps at most
    every = F.coalesce(*(F.when(F.col("lang") == lang, distance(band)) for lang, band in bands.items()))
    most = figures.where(F.col("lang").isin(*bands)).groupBy("lang").agg(F.percentile(stepped(F.least(every, F.lit(100.0))), kept).alias("off")).collect()
    return {r["lang"]: dataclasses.replace(bands[r["lang"]], most_off=max(3.0, r["off"] * 1.05)) for r in most}


def fitted_rules(docs: DataFrame, labels: DataFrame, rules: QualityRules | None = None) -> QualityRules:
    """``rules`` with the bands of each language that has labelled good documents enough; ``labels``: (doc_id, quality), 1 for good.

    All labelled good documents are measured. Five figures of each are stored, and rows of languages reach the driver (``fit_bands``).
    """
    rules = rules or QualityRules()
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    maybe, _ = split_by_ids(texts, good)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Measures.of(rules)
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for block in blocks(batch.column(1)):
                _, failed, _, found = _judged(block, langs[block.first : block.first + block.rows], rules, by)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(failed), *(pa.array(found[:, k]) for k in (0, 1, 3, 4))], names=["doc_id", "lang", "failed", "n", *FIGURES])

    found = maybe.mapInArrow(trimmed(figures), f"doc_id long, lang string, failed boolean, n double, {', '.join(f'{c} double' for c in FIGURES)}").where("not failed and lang is not null and n > 0")
    rows = cut(found.join(good, "doc_id", "left_semi").drop("doc_id", "failed"))
    return dataclasses.replace(rules, bands=rules.bands | fit_bands(rows))


def quality(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """One row a document: the base counts, the fertility figures, ``base_failed`` and ``kept``."""
    rules = rules or QualityRules()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Measures.of(rules)
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for block in blocks(batch.column(1)):
                counts, failed, kept, figures = _judged(block, langs[block.first : block.first + block.rows], rules, by)
                columns = [batch.column(0).slice(block.first, block.rows), *(pa.array(counts[n], pa.int64()) for n in OUT.names[1:6]), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(figures[:, 0].astype(np.int64)), *(pa.array(figures[:, k]) for k in (1, 2, 3, 4))], schema=OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(trimmed(judge), SCHEMA)


def fitted_quality(docs: DataFrame, labels: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """``quality`` under ``fitted_rules``, where each text is measured once: its figures are stored, the bands are fitted on them, and verdicts come from them."""
    rules = rules or QualityRules()
    names = [n for n in OUT.names if n != "kept"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Measures.of(rules)
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for block in blocks(batch.column(1)):
                counts, failed, _, figures = _judged(block, langs[block.first : block.first + block.rows], rules, by)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(counts[n], pa.int64()) for n in OUT.names[1:6]), pa.array(failed), pa.array(figures[:, 0].astype(np.int64)), *(pa.array(figures[:, k]) for k in (1, 2, 3, 4)), part.column(2), pa.array(_latin(block))], names=[*names, "lang", "latin"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                figures = np.stack([of(n).astype(float) for n in ("n_tokens", "chars_per_token", "token_entropy", "chars_per_piece", "fallback_share")], 1)
                kept = ~of("base_failed") & _passed(of("lang").tolist(), of("latin"), figures, fitted)
                yield pa.RecordBatch.from_arrays([pa.array(kept) if n == "kept" else batch.column(batch.schema.get_field_index(n)) for n in OUT.names], schema=OUT)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = stored(texts.mapInArrow(trimmed(measure), SCHEMA.replace(" kept boolean,", "") + ", lang string, latin boolean"), "quality")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    figures = rows.where("not base_failed and lang is not null and n_tokens > 0").join(good, "doc_id", "left_semi")
    fitted = dataclasses.replace(rules, bands=rules.bands | fit_bands(figures.select("lang", F.col("n_tokens").cast("double").alias("n"), *FIGURES)))
    return rows.mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The documents that pass, with their own columns. Each row is judged where it stands, without a join."""
    rules = rules or QualityRules()
    names = docs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Measures.of(rules)
        for batch in batches:
            langs = batch.column(names.index("lang")).to_pylist()
            for b in blocks(batch.column(names.index("text"))):
                yield batch.slice(b.first, b.rows).filter(pa.array(_judged(b, langs[b.first : b.first + b.rows], rules, by)[2]))

    return docs.mapInArrow(trimmed(judge), docs.schema)
