r"""Phrase collocations of a corpus by a weighted de Bruijn graph.

Texts are cut into pieces and those into words. Edges of the graph are the longest grams (three words), its nodes the grams one word shorter; an edge runs
from the node of its first words to that of its last. Every word begins one edge: where a piece ends before the edge is full, the
rest is empty, which is the correction for piece ends. So the flow out of a node, ends included, is the number of its
occurrences, and the flow out of what it begins with is that of the next shorter gram: all counts come from one aggregate of
edges by two further ones (``counted``). ``paths`` compacts unary paths, chains of nodes with one edge in and one edge out
that carry all their flow. A node inside such a path occurs only inside longer phrases, so it is no collocation of its own.

Words are counted first. A phrase that occurs ``least`` times has only words that do, so pieces may end at rarer words and
begin anew behind them: no count of a candidate changes. Frequent words get short numbers, as far as ``HEAD`` of them go, so that an
edge is one number in the shuffle; other words keep their 64-bit hashes, by which words are told apart, and their edges three columns.
The numbers go to every task; they are at most 16 MB.

Cases: a null text is empty, a null lang is ``und``, a null doc_id is no matter; pieces and words may be of any length. Repeated rows count each. An empty
table gives none. Columns of ``docs`` other than text and lang are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.grouping import labelled
from strandlake.llm.tables import cut, stored
from strandlake.llm.textblocks import LOWER, Block, blocks, mix, trimmed

LONGEST, LEAST, TOP, COVERED = 3, 10, 2_000, 50
#: Bits of a word's number; three stand in a long.
BITS = 21
#: Words that have a number; numbers start at 1.
HEAD = (1 << BITS) - 1
#: Words, or edges, of a task that are counted together before they leave it, and rows of a batch that leaves.
TOGETHER, ROWS = 1 << 22, 1 << 17
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[0x20, 0x09]] = True
WORD = "lang string, code long, word string, n long"
EDGE = "w1 long, w2 long, w3 long, n long"


@dataclass
class Words:
    """The words of a block: places, hashes (of language and word), rows, and whether the next one stands in the same piece."""

    block: Block
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    codes: np.ndarray
    goes_on: np.ndarray


def _words(batch: pa.RecordBatch) -> Iterator[Words]:
    """batch: (lang, text)."""
    named = batch.column(0).dictionary_encode()
    seeds = np.array([int.from_bytes(x.encode()[:8].ljust(8, b"\0"), "little") ^ len(x) for x in named.dictionary.to_pylist()] or [0], np.uint64)
    for k, x in enumerate(named.dictionary.to_pylist()):
        for at in range(8, len(x.encode()), 8):
            seeds[k] = mix(seeds[k : k + 1])[0] ^ np.uint64(int.from_bytes(x.encode()[at : at + 8].ljust(8, b"\0"), "little"))
    lang = mix(seeds + np.uint64(1))[named.indices.to_numpy(zero_copy_only=False)]
    for block in blocks(batch.column(1)):
        starts, ends, rows = block.spans(_ENDS_WORD)
        piece = np.zeros(len(block.data) + 1, np.int32)
        np.cumsum(_ENDS_PIECE[block.data], out=piece[1:])
        goes_on = np.zeros(len(starts), bool)
        goes_on[:-1] = (rows[1:] == rows[:-1]) & (piece[starts[1:]] == piece[starts[:-1]])
        # zero stands for no word; the top bit is left for words without a number
        codes = mix(block.hashes(starts, ends, True) ^ lang[block.first + rows]) >> np.uint64(1) | np.uint64(1)
        yield Words(block, starts, ends, rows, codes, goes_on)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts[order], new)


def _in_batches(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, code (its 63-bit hash), word (lower case) and n, for each word of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[str, bytes]] = {}
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        n_waiting = 0

        def merge() -> None:
            nonlocal codes, counts, n_waiting
            codes, counts = _summed(np.concatenate([codes, *(x for x, _ in waiting)]), np.concatenate([counts, *(x for _, x in waiting)]))
            waiting.clear()
            n_waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            order = codes.tolist()
            named = [kept[x] for x in order]
            yield from _in_batches([[x for x, _ in named], codes.view(np.int64), [x.decode() for _, x in named], counts], ["lang", "code", "word", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for w in _words(batch):
                if not len(w.codes):
                    continue
                own, first, times = np.unique(w.codes, return_index=True, return_counts=True)
                at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
                new = first[codes[at] != own] if len(codes) else first  # those still waiting are named again
                text = LOWER[w.block.data].tobytes()
                for c, s, e, r in zip(w.codes[new].tolist(), w.starts[new].tolist(), w.ends[new].tolist(), w.rows[new].tolist(), strict=True):
                    kept[c] = (langs[w.block.first + r], text[s:e])
                waiting.append((own, times))
                n_waiting += len(own)
                if n_waiting > len(codes) // 2 + ROWS:
                    merge()
                if len(codes) > TOGETHER // 8:
                    yield from out()
                    kept, codes, counts = {}, codes[:0], counts[:0]
        merge()
        if len(codes):
            yield from out()

    found = _rows(docs).mapInArrow(trimmed(count), WORD)
    return found.groupBy("lang", "code", "word").agg(F.sum("n").alias("n"))


def _head(words: DataFrame, most: int) -> tuple[np.ndarray, bool]:
    """The codes of the ``most`` most frequent words or fewer, in order, and whether there are others."""
    by_count = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    least, total = 0, 0
    for r in by_count:  # a row a count, of which there are about the square root of the words
        total += r.words
        if total <= most:
            least = r.n
    some = words.where(F.col("n") >= least).select("code").toArrow() if least else None
    return np.sort(some.column("code").to_numpy().view(np.uint64)) if least else np.zeros(0, np.uint64), total > most


_TAIL = np.uint64(1 << 63)


def _packed(w1: Column, w2: Column, w3: Column) -> Column:
    return F.shiftleft(w1, 2 * BITS).bitwiseOR(F.shiftleft(w2, BITS)).bitwiseOR(w3)


def edges(docs: DataFrame, head: Broadcast, others: bool) -> DataFrame:
    """k1, k2, k3, n: the edges, packed where all words have a number (``w1``, 0, 0), and their weights.

    A word without a number has its code and the top bit if there are ``others`` that are frequent, else a piece ends there.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: np.ndarray = head.value
        keys, wide, n = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, times = _summed(np.concatenate(keys), np.ones(sum(map(len, keys)), np.int64)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            none = np.zeros(len(key), np.int64)
            if len(key):
                yield from _in_batches([key.view(np.int64), none, none, times], ["k1", "k2", "k3", "n"])
            if wide:
                found, times = np.unique(np.concatenate(wide), axis=0, return_counts=True)
                yield from _in_batches([*(found.view(np.int64).T.copy()), times], ["k1", "k2", "k3", "n"])

        for batch in batches:
            for w in _words(batch):
                if not len(w.codes):
                    continue
                own, place = np.unique(w.codes, return_inverse=True)
                at = np.minimum(np.searchsorted(numbers, own), max(0, len(numbers) - 1))
                known = numbers[at] == own if len(numbers) else np.zeros(len(own), bool)
                code = np.where(known, at.astype(np.uint64) + np.uint64(1), own | _TAIL if others else np.uint64(0))[place]
                nothing = np.zeros(2, np.uint64)
                second = np.where(w.goes_on, np.append(code[1:], nothing[:1]), 0)
                third = np.where((second > 0) & np.append(w.goes_on[1:], False), np.append(code[2:], nothing)[: len(code)], 0)
                real = code > 0
                code, second, third = code[real], second[real], third[real]
                narrow = (code | second | third) < _TAIL if others else np.ones(len(code), bool)
                a, b, c = (x[narrow] for x in (code, second, third))
                keys.append(a << np.uint64(2 * BITS) | b << np.uint64(BITS) | c)
                if not narrow.all():
                    wide.append(np.stack([x[~narrow] for x in (code, second, third)], 1))
                n += len(code)
                if n > TOGETHER:
                    yield from out()
                    keys, wide, n = [], [], 0
        if n:
            yield from out()

    found = _rows(docs).mapInArrow(trimmed(gather), "k1 long, k2 long, k3 long, n long")
    return found.groupBy("k1", "k2", "k3").agg(F.sum("n").alias("n"))


def _three() -> list[Column]:
    """w1, w2, w3 of a row (k1, k2, k3)."""
    one = (F.col("k2") == 0) & (F.col("k3") == 0) & (F.col("k1") >= 0)
    mask = F.lit(HEAD).cast("long")
    return [
        F.when(one, F.shiftright("k1", 2 * BITS)).otherwise(F.col("k1")),
        F.when(one, F.shiftright("k1", BITS).bitwiseAND(mask)).otherwise(F.col("k2")),
        F.when(one, F.col("k1").bitwiseAND(mask)).otherwise(F.col("k3")),
    ]


def _keyed(w1: Column, w2: Column, w3: Column) -> list[Column]:
    one = (w1 >= 0) & (w2 >= 0) & (w3 >= 0)
    none = F.lit(0).cast("long")
    return [F.when(one, _packed(w1, w2, w3)).otherwise(w1).alias("k1"), F.when(one, none).otherwise(w2).alias("k2"), F.when(one, none).otherwise(w3).alias("k3")]


def counted(graph: DataFrame, least: int = LEAST) -> DataFrame:
    """w1, w2, w3, n of the phrases of one to three words that occur ``least`` times; missing words are 0.

    Every step hands the weights one word down: to a node its edges and the ends there, to a word its nodes and its ends.
    What occurs often enough goes along as it is.
    """
    for width in (3, 2):
        w = _three()
        last = w[width - 1]
        shorter = [F.lit(0).cast("long") if k == width - 1 else w[k] for k in range(3)]
        longer = [] if width == 3 else [w[2] != 0]
        down = F.struct(*_keyed(*shorter), "n")
        same = F.when((last != 0) & (F.col("n") >= least), F.struct("k1", "k2", "k3", "n"))
        rows = F.array(down, same)
        if longer:  # edges were handed down before
            rows = F.when(longer[0], F.array(F.struct("k1", "k2", "k3", "n"))).otherwise(rows)
        graph = graph.select(F.explode(rows).alias("e")).where("e is not null").select("e.*").groupBy("k1", "k2", "k3").agg(F.sum("n").alias("n"))
    w1, w2, w3 = _three()
    return graph.where(F.col("n") >= least).select(w1.alias("w1"), w2.alias("w2"), w3.alias("w3"), "n")


@dataclass
class Graph:
    """Frequent words (lang, code, word, n), frequent phrases (w1, w2, w3, n) in numbers, sums (lang, n), and numbers."""

    words: DataFrame
    phrases: DataFrame
    totals: DataFrame
    head: Broadcast

    def codes(self, c: str) -> Column:
        """The word code of a column of numbers."""
        head = self.head

        @F.arrow_udf("long")
        def code(x: pa.Array) -> pa.Array:
            n = x.to_numpy(zero_copy_only=False)
            if not len(head.value):
                return pa.array(n & np.int64((1 << 63) - 1))
            return pa.array(np.where(n > 0, head.value.view(np.int64)[np.clip(n - 1, 0, len(head.value) - 1)], n & np.int64((1 << 63) - 1)))

        return code(F.col(c))


def graph_of(docs: DataFrame, least: int = LEAST, most_numbers: int = HEAD) -> Graph:
    all_words = stored(word_counts(docs), "phrase-words")
    words = stored(all_words.where(F.col("n") >= least), "frequent-words")
    numbers, others = _head(words, most_numbers)
    head = docs.sparkSession.sparkContext.broadcast(numbers)
    phrases = stored(counted(edges(docs, head, others), least), "phrases")
    return Graph(words, phrases, cut(all_words.groupBy("lang").agg(F.sum("n").alias("n"))), head)


def _node(a: str, b: str) -> list[Column]:
    return [F.col(a).alias("a"), F.col(b).alias("b")]


def around(phrases: DataFrame) -> DataFrame:
    """a, b, n_in, n_out, most, through: of each node that has frequent edges their numbers, the largest weight, and whether they carry all its flow."""
    graph = phrases.where("w3 <> 0")
    ends = graph.select(*_node("w1", "w2"), F.lit(0).alias("is_in"), "n").union(graph.select(*_node("w2", "w3"), F.lit(1), "n"))
    found = ends.groupBy("a", "b").agg(F.sum("is_in").alias("n_in"), F.sum(1 - F.col("is_in")).alias("n_out"), F.max("n").alias("most"), F.min("n").alias("fewest"))
    nodes = phrases.where("w2 <> 0 and w3 = 0").select(*_node("w1", "w2"), "n")
    return nodes.join(found, ["a", "b"]).withColumn("inside", F.expr("n_in = 1 and n_out = 1 and fewest = n"))


def paths(graph: Graph) -> DataFrame:
    """lang, words, n: the unary paths of the graph, compacted: the longest chains of edges whose inner nodes have one edge in, one out, and all their flow on both.

    Every edge lies in one path. Edges of a chain point to the one before; pointers double each round, so a path of p edges takes log2(p) rounds.
    No chain closes on itself: a piece that entered it would begin at one of its nodes, which then had more flow than its edge in.
    A path is no longer than the longest piece.
    """
    graph_edges = graph.phrases.where("w3 <> 0")
    inside = around(graph.phrases).where("inside").select("a", "b")
    key = lambda *c: F.xxhash64(*c)
    own = graph_edges.withColumn("edge", key("w1", "w2", "w3"))
    before = own.select(F.col("w2").alias("a"), F.col("w3").alias("b"), F.col("edge").alias("up")).join(inside, ["a", "b"])
    linked = own.join(before, (own.w1 == before.a) & (own.w2 == before.b), "left").select("w1", "w2", "w3", "n", "edge", F.coalesce("up", "edge").alias("up"))
    state = stored(linked.select("w1", "w2", "w3", "n", "edge", "up", F.when(F.col("up") == F.col("edge"), 0).otherwise(1).cast("long").alias("hops")), "path-edges")
    reach = 1
    while not state.where(F.col("hops") == reach).isEmpty():
        up = state.select(F.col("edge").alias("_e"), F.col("up").alias("_up"), F.col("hops").alias("_hops"))
        state = stored(state.join(up, F.col("up") == F.col("_e")).select("w1", "w2", "w3", "n", "edge", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops")), "path-steps")
        reach *= 2
    coded = state.select(F.col("up").alias("path"), "hops", "n", *(graph.codes(c).alias(c) for c in ("w1", "w2", "w3")))
    placed = coded.select("path", "n", F.explode(F.when(F.col("hops") == 0, F.array(*(F.struct(F.lit(k).cast("long").alias("at"), F.col(f"w{k + 1}").alias("code")) for k in range(3)))).otherwise(F.array(F.struct((F.col("hops") + 2).alias("at"), F.col("w3").alias("code"))))).alias("p"))
    named = placed.select("path", "n", "p.at", "p.code").join(graph.words.select("lang", "code", "word"), "code")
    return named.groupBy("path").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"), F.min("n").alias("n")).select("lang", F.transform("w", lambda x: x.word).alias("words"), "n")


def candidates(graph: Graph, covered: int = COVERED) -> DataFrame:
    """w1, w2, w3, a, l, r, score of the phrases of two and three words that no longer one covers to ``covered`` percent."""
    phrases = graph.phrases
    word = phrases.where("w2 = 0").select("w1", "n")
    node = phrases.where("w2 <> 0 and w3 = 0").select("w1", "w2", "n")
    edge = phrases.where("w3 <> 0")
    by_word = lambda rows, c, name: labelled(rows, word.select(F.col("w1").alias(c), F.col("n").alias(name), F.col("n")), c)
    # nodes inside unary paths have an edge that carries all they have
    near = around(phrases)
    free = node.join(near.select(F.col("a").alias("w1"), F.col("b").alias("w2"), "most", "inside"), ["w1", "w2"], "left").where(~F.coalesce("inside", F.lit(False)) & (100 * F.coalesce("most", F.lit(0)) < covered * F.col("n")))
    pairs = by_word(by_word(free.select("w1", "w2", F.lit(0).cast("long").alias("w3"), F.col("n").alias("a")), "w1", "l"), "w2", "r")
    pairs = pairs.select("w1", "w2", "w3", "a", F.array(F.struct("l", "r")).alias("cuts"))
    triples = edge.select("w1", "w2", "w3", F.col("n").alias("a"))
    triples = triples.join(node.select("w1", "w2", F.col("n").alias("l2")), ["w1", "w2"]).join(node.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("r1")), ["w2", "w3"])
    triples = by_word(by_word(triples, "w1", "l1"), "w3", "r2")
    triples = triples.select("w1", "w2", "w3", "a", F.array(F.struct(F.col("l1").alias("l"), F.col("r1").alias("r")), F.struct(F.col("l2").alias("l"), F.col("r2").alias("r"))).alias("cuts"))
    # products reach 10^36 for counts up to 10^15
    wide = lambda c: c.cast("decimal(15,0)")
    both = pairs.unionByName(triples)
    scored = [F.struct(_div(wide(F.col("a")) * wide(F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)"), wide(c["l"]) * wide(c["r"])).alias("score"), F.lit(k).alias("k"), c["l"].alias("l"), c["r"].alias("r")) for k, c in ((k, F.get("cuts", F.lit(k))) for k in range(LONGEST - 1))]
    best = both.select("w1", "w2", "w3", "a", F.least(scored[0], F.when(F.size("cuts") > 1, scored[1])).alias("best"))
    return best.select("w1", "w2", "w3", "a", "best.l", "best.r", "best.score")


def _div(x: Column, y: Column) -> Column:
    """Whole-number division of decimals without a remainder."""
    return F.call_function("div", x, y)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, most_numbers: int = HEAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, count and phrase."""
    graph = graph_of(docs, least, most_numbers)
    found = candidates(graph, covered).withColumns({f"c{k}": graph.codes(f"w{k}") for k in (1, 2, 3)}).withColumn("n", F.lit(1))
    words = graph.words.select(F.col("code").alias("c1"), "lang", F.col("word").alias("t1"), F.lit(1).alias("n"))
    # the language first, so that only the best by score and count, with ties, need their words
    best = stored(labelled(found.drop("n"), words, "c1").withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place"), "best-phrases")
    for k in (2, 3):
        names = graph.words.select(F.col("code").alias(f"c{k}"), F.col("word").alias(f"t{k}"))
        best = best.join(names, f"c{k}", "left")
    named = best.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "l", "r", "score")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(graph.totals), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
t AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM t GROUP BY lang),
places AS (SELECT lang, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3 FROM t),
f AS (SELECT lang, w1, w2, w3, w1 || CASE WHEN k > 1 THEN ' ' || w2 ELSE '' END || CASE WHEN k > 2 THEN ' ' || w3 ELSE '' END AS x, k, n
  FROM (SELECT lang, w1, w2, w3, count(*) AS n FROM places GROUP BY ALL), (VALUES (1), (2), (3)) AS s(k) WHERE k = 1 OR (k = 2 AND w2 IS NOT NULL) OR w3 IS NOT NULL),
g AS (SELECT lang, x, k, sum(n) AS n FROM f GROUP BY ALL),
keyed AS (SELECT lang || chr(10) || x AS id, n FROM g),
words AS (SELECT DISTINCT lang, x, k, w1, w2, CASE WHEN k > 2 THEN w3 END AS w3 FROM f WHERE k > 1),
c AS (SELECT words.*, n AS a FROM words JOIN g USING (lang, x, k) WHERE n >= 10),
cover AS (SELECT lang, y AS x, max(a) AS most FROM (SELECT lang, unnest([w1 || ' ' || w2, w2 || ' ' || w3]) AS y, a FROM c WHERE k = 3) GROUP BY ALL),
cuts AS (SELECT lang, x, a, 1 AS cut, w1 AS p, CASE WHEN k = 2 THEN w2 ELSE w2 || ' ' || w3 END AS q, k FROM c
  UNION ALL SELECT lang, x, a, 2, w1 || ' ' || w2, w3, k FROM c WHERE k = 3),
s AS (SELECT cuts.*, gp.n AS l, gq.n AS r, (1000000 * CAST(a AS HUGEINT) * a) // (CAST(gp.n AS HUGEINT) * gq.n) AS score
  FROM cuts JOIN keyed gp ON gp.id = lang || chr(10) || p JOIN keyed gq ON gq.id = lang || chr(10) || q),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x, k ORDER BY score, cut) = 1),
kept AS (SELECT best.* FROM best LEFT JOIN cover USING (lang, x) WHERE k = 3 OR 100 * coalesce(most, 0) < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, x AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n.n AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, x) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
