r"""Spelling variants of a corpus' words.

Words are the runs of letters of all texts, in lower case, with their counts. Two words are near if one code point more, less or
other makes one of the other. The shorter one contributes two disjoint chunks, its first and its last ``length // 2`` code
points; the other one all its grams of that size at the places where such a chunk can stand: the same one or, as it may be one longer,
the next. One edit leaves one of the two chunks whole, so near words share a chunk within a shift of one. Pairs that meet are verified by edit distance.

A chunk that very many words share (a common stem) is split: what is left of both words without it is again one edit apart,
so it is cut into chunks and grams in turn (``LEVELS`` times at most), and words meet in the chunk and one of the rest. That is exact too.

A word's form is its near word of largest count, if that is ``times`` as frequent as the word; roots are found by
doubling pointers, since counts grow along a chain of forms by that factor each step.

The contract plants errors: an occurrence loses a code point where the CRC-32 of document and word says so (``planted``); the
library's own functions take any table of words and counts.

Cases: a null text has no words; a null doc_id counts as an empty one in the checksum's text. Repeated rows count each. Runs of any length are read whole. Words
shorter than ``shortest`` code points or rarer than ``least`` are no words. An empty table gives none. Columns of ``docs`` other than doc_id and text are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.tables import stored
from strandlake.llm.textblocks import LOWER, Block, blocks, trimmed

SHORTEST, LEAST, TIMES, ONE_OF = 6, 5, 5, 199
#: Pairs of words that share a chunk from which on it is split, and how often.
SPLIT, LEVELS = 20_000, 4
#: Bytes of a run up to which checksums are taken of all runs at once, and distinct words of a task that are counted together.
AT_ONCE, TOGETHER = 64, 1 << 19
#: Every byte but ASCII letters and those of U+00C0 to U+00FF, which begin with C3.
_OTHER = np.ones(256, bool)
_OTHER[[*range(65, 91), *range(97, 123)]] = False


def _crc_table() -> np.ndarray:
    """The steps of the reflected polynomial EDB88320 by the lowest byte."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


_CRC = _crc_table()


def letter_runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of letters."""
    lead = block.data == 0xC3
    letter = ~_OTHER[block.data] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(letter) + 1, bool)
    edge[block.offsets] = True
    before, after = np.zeros(len(letter), bool), np.zeros(len(letter), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    return starts, np.flatnonzero(letter & (~after | edge[1:])) + 1, block.row_of(starts)


def checksums(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range, continued from the checksum ``before`` it."""
    out = before ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(sizes, AT_ONCE + 1), kind="stable")
    order = order[np.count_nonzero(sizes > AT_ONCE) :]
    at, size, state = starts[order], sizes[order], out[order]
    ends = np.searchsorted(-size, -np.arange(AT_ONCE), side="left")  # how many are longer than k
    for k in range(AT_ONCE):
        n = ends[k]
        if not n:
            break
        part = state[:n]
        state[:n] = _CRC[(part ^ text[at[:n] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out[order] = state
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(sizes > AT_ONCE):
        out[k] = zlib.crc32(text[starts[k] : starts[k] + sizes[k]].tobytes(), int(before[k]))
    return out


def without_one(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def planted_words(docs: DataFrame, one_of: int = ONE_OF, shortest: int = SHORTEST) -> DataFrame:
    """word, n: the runs of letters with the contract's deletions, counted by task; of ``shortest`` code points or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named: dict[int, str] = {}
        counts: dict[int, int] = {}
        lost: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            words = [*(named[k] for k in counts), *lost]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([*counts.values(), *lost.values()], pa.int64())], names=["word", "n"])
            for x in (named, counts, lost):
                x.clear()

        for batch in batches:
            ids = [b"" if x is None else str(x).encode() for x in batch.column(0).to_pylist()]
            for block in blocks(batch.column(1)):
                starts, ends, rows = letter_runs(block)
                if not len(starts):
                    continue
                text, sizes = LOWER[block.data], ends - starts
                begun = np.array([zlib.crc32(x + b":") for x in ids[block.first : block.first + block.rows]], np.uint32)
                h = checksums(text, starts, sizes, begun[rows])
                raw = text.tobytes()
                hit = h % np.uint32(one_of) == 0
                for s, e, c in zip(starts[hit].tolist(), ends[hit].tolist(), h[hit].tolist(), strict=True):
                    word = without_one(raw[s:e].decode(), c)
                    if len(word) >= shortest:
                        lost[word] = lost.get(word, 0) + 1
                leads = np.zeros(len(text) + 1, np.int32)
                np.cumsum(text == 0xC3, out=leads[1:])
                keep = ~hit & (sizes - (leads[ends] - leads[starts]) >= shortest)
                starts, ends = starts[keep], ends[keep]
                own, first, times = np.unique(block.hashes(starts, ends, True), return_index=True, return_counts=True)
                for k, s, e, n in zip(own.tolist(), starts[first].tolist(), ends[first].tolist(), times.tolist(), strict=True):
                    if k in counts:
                        counts[k] += n
                    else:
                        counts[k], named[k] = n, raw[s:e].decode()
                if len(counts) + len(lost) > TOGETHER:
                    yield from out()
        if counts or lost:
            yield from out()

    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(trimmed(count), "word string, n long")


def _piece(word: Column, at: Column, size: Column) -> Column:
    """``size`` code points of ``word`` from ``at`` (from 0) on."""
    return F.substring(word, at + 1, size)


def _rest(word: Column, at: Column, size: Column) -> Column:
    return F.concat(_piece(word, F.lit(0), at), F.substring(word, at + size + 1, F.length(word)))


def chunks(rows: DataFrame) -> DataFrame:
    """key, word, n, rest of the words that contribute chunks; rows: (key, word, n, rest), of which ``rest`` is cut."""
    rest, size = F.col("rest"), F.length("rest")
    half = F.floor(size / 2).cast("int")
    cuts = [F.struct(F.concat_ws("\n", "key", F.concat(size.cast("string"), F.lit(f"/{k}/"), _piece(rest, at, half))).alias("key"), _rest(rest, at, half).alias("rest")) for k, at in enumerate((F.lit(0), size - half))]
    return rows.where(size >= 2).select("word", "n", F.explode(F.array(*cuts)).alias("c")).select("c.key", "word", "n", "c.rest")


def grams(rows: DataFrame) -> DataFrame:
    """key, word, n, rest of the words that contribute grams: at the places where a chunk of a word as long, or one shorter, can stand."""
    rest, size = F.col("rest"), F.length("rest")
    cuts = []
    for shorter in (0, 1):
        other = size - shorter
        half = F.floor(other / 2).cast("int")
        for k, at in enumerate((F.lit(0), other - half)):
            for shift in range(shorter + 1):
                key = F.concat_ws("\n", "key", F.concat(other.cast("string"), F.lit(f"/{k}/"), _piece(rest, at + shift, half)))
                cuts.append(F.when(other >= 2, F.struct(key.alias("key"), _rest(rest, at + shift, half).alias("rest"))))
    return rows.where(size >= 2).select("word", "n", F.explode(F.array(*cuts)).alias("c")).where("c is not null").select("c.key", "word", "n", "c.rest")


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """The verified pairs of words that share a key: a (from chunks) and b (from grams), each pair of equally long words once."""
    a, b = left.select("key", F.col("word").alias("a"), F.col("n").alias("na")), right.select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    apart = F.col("a") != F.col("b")
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    return a.join(b, "key").where(apart & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: the pairs of near words of (word, n), unique words of two code points or more, each pair once."""
    rows = words.select(F.lit("").alias("key"), "word", "n", F.col("word").alias("rest"))
    left, right = stored(chunks(rows), "chunks"), stored(grams(rows), "grams")
    found = []
    for level in range(LEVELS):
        sizes = left.groupBy("key").agg(F.count("*").alias("x")).join(right.groupBy("key").agg(F.count("*").alias("y")), "key")
        hot = stored(sizes.where(F.col("x") * F.col("y") > SPLIT).select("key"), "hot-chunks")
        if level == LEVELS - 1 or hot.isEmpty():
            found.append(_met(left, right))
            break
        found.append(_met(left.join(hot, "key", "left_anti"), right.join(hot, "key", "left_anti")))
        left, right = (stored(x.join(hot, "key", "left_semi"), "hot-words") for x in (left, right))
        # what is too short to be cut again meets as it is
        found.append(_met(left.where("length(rest) < 2"), right.where("length(rest) <= 2")))
        left, right = stored(chunks(left), "chunks"), stored(grams(right), "grams")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of (word, n)."""
    pairs = stored(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best"))
    table = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.m") >= times * F.col("n"), F.col("best.form")).alias("form"), F.when(-F.col("best.m") >= times * F.col("n"), -F.col("best.m")).alias("form_n"))
    table = stored(table, "forms")
    # pointers double, so a chain of k forms takes log2(k) rounds
    roots = stored(table.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, times: int = TIMES, one_of: int = ONE_OF) -> DataFrame:
    """The variants among the words of ``docs`` with the contract's deletions."""
    counted = planted_words(docs, one_of, shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return variants(stored(counted, "words"), times)


_BYTES = "list_transform(range(1, CAST(length(hex(encode(s))) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex(encode(s)), i, 2) AS UINTEGER))"
_CRC_STEP = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, CAST(3988292384 AS UINTEGER)) ELSE {x} >> 1 END"

ORACLE = rf"""
WITH RECURSIVE steps(x, k, v) AS (SELECT CAST(i AS UINTEGER), 0, CAST(i AS UINTEGER) FROM range(256) AS r(i)
  UNION ALL SELECT x, k + 1, {_CRC_STEP.format(x="v")} FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY x) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
d AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs GROUP BY ALL),
sums AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UINTEGER), {_BYTES}),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), CAST(4294967295 AS UINTEGER)) AS h
  FROM (SELECT w, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM d), crc),
cutout AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM sums),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cutout WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS y FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT DISTINCT word, n, other, m FROM (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM del a JOIN del b USING (i, y) WHERE a.word <> b.word
  UNION ALL SELECT del.word, del.n, v.word, v.n FROM del JOIN v ON v.word = y
  UNION ALL SELECT v.word, v.n, del.word, del.n FROM del JOIN v ON v.word = y)),
near AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS f, max(m) AS m FROM pairs GROUP BY word, n),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN f END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN near USING (word)),
chain(word, top, k) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN forms ON forms.word = top WHERE form IS NOT NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms JOIN (SELECT word, first(top ORDER BY k DESC) AS root FROM chain GROUP BY word) USING (word)
"""
