"""Fuzzy line de-duplication.

Lines are normalised (case, digits, punctuation and spacing) and hashed for equality; lines of equal normal form are one class.
Classes meet in buckets, are verified by edit similarity (1 - distance / longer length) of their normal forms, and of each
connected group one occurrence stays: the first line, by doc_id and line number.

The buckets are bands of MinHashes over the runs of bytes of the normal form, each counted with its number among equal
ones, so that what is repeated weighs as much as it is long. SimHash blocks, the method named for this operator, were built first and
reached 0.20 of the true pairs: one changed word of thirty moves four to twelve of 64 bits, and blocks that allow for so many
have keys too short to tell lines apart (README). Lines of up to ``SHORT`` bytes meet over shorter runs than longer ones,
those about the border over both. Lengths, counts of letters and counts of common runs, which bound the edit distance from
below, go before the edit distance, so they drop no link. A linked pair misses all buckets with a chance that falls with its
similarity; the README has it as measured.

Cases: lines under ``least_words`` words always stay. A null text stays null. Rows with a null doc_id stay as they are.
Rows that share a doc_id are read as one document's lines, each with its own numbers. An empty table gives none. Columns of
``docs`` named like those that are added or used here are kept as they are; then the added ones get an underscore behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.grouping import Group, Joined, intersections, labelled, linked_groups, numbered, spanning
from strandlake.llm.tables import BITMAP_BITS, bitmap_of, held, places, split_by_ids, stored
from strandlake.llm.textblocks import Block, blocks, eights, mix, trimmed

LEAST_WORDS = 5
SIMILARITY = 0.9
SHORT = 96


@dataclass(frozen=True)
class Banding:
    """``bands`` of ``rows`` MinHashes over runs of ``gram`` bytes; ``first`` numbers the first band."""

    gram: int
    bands: int
    rows: int
    first: int


BANDINGS = (Banding(gram=5, bands=16, rows=4, first=0), Banding(gram=10, bands=10, rows=3, first=16))
#: Bits of the bitmap of the lines whose texts are wanted, 8 MB.
TEXT_BITS = 26
#: Pairs that are tested by length and counts at once, that are verified at once, and fewer than which are verified one by one; 64-bit words that the vectorised edit distance works on, and characters beyond which it does not.
MOST_TESTS, MOST_EDITS, FEW_EDITS, EDIT_WORDS, LONG_EDITS = 100_000, 8_192, 48, 1 << 16, 20_000
#: Characters of the runs that linked lines have in common, and of a single pair of lines from which on these are counted.
RUN, LONG_PAIR = 5, 1_000
_FLIPS, _FACTORS = np.random.default_rng(11).integers(0, 1 << 32, (2, max(b.bands * b.rows for b in BANDINGS)), dtype=np.uint32)
_FACTORS |= np.uint32(1)
#: The counts that a line is tested by: of each letter, of 0, of spaces, and of other characters by the parity of their first byte.
COUNTS = 30
_COUNTED = np.full(256, COUNTS, np.int64)
_COUNTED[:128] = COUNTS - 2 + np.arange(128) % 2
_COUNTED[192:] = COUNTS - 2 + np.arange(192, 256) % 2
_COUNTED[97:123] = np.arange(26)
_COUNTED[ord("0")], _COUNTED[32] = 26, 27
LINES = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("key", pa.int64()), ("first_here", pa.bool_()), ("bands", pa.list_(pa.int64()))])

#: A-Z and digits fold, ASCII punctuation and controls become spaces; every other byte stays.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = ord("0")
_FOLD[[x for x in range(128) if not chr(x).isalnum() and x != 10]] = 32
_TABLE = bytes(_FOLD)


def normal_form(line: str) -> str:
    return b" ".join(line.encode().translate(_TABLE).split()).decode()


def edits(a: str, b: str) -> int:
    """Levenshtein distance; the differences down a column of the table are bits of two integers, so a column is a few operations."""
    if not a or not b:
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, distance = every, 0, len(a)
    for c in b:
        equal = places.get(c, 0)
        level = ((((equal & up) + up) ^ up) | equal | down) & every
        gain, loss = down | (every ^ (level | up)), up & level
        distance += (gain >> last) - (loss >> last)
        gain, loss = (gain << 1 | 1) & every, (loss << 1) & every
        up, down = loss | (every ^ (level | gain)), gain & level
    return distance


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length reaches ``similarity``."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # replacing the words that differ place by place is one way to edit, so the distance is no more than that
    return _words_near(a, b, most) or edits(a, b) <= most


@dataclass
class Lines:
    """The lines of a block that have words enough: row, number in the row, class key, and where the normal form stands in ``text``."""

    row: np.ndarray
    number: np.ndarray
    key: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def first_in_row(self) -> np.ndarray:
        """Whether a line is the first of its key in its row."""
        first = np.zeros(len(self.key), bool)
        if len(self.key):
            first[np.unique(mix(self.key ^ mix(self.row.astype(np.uint64))), return_index=True)[1]] = True
        return first


def normalised_lines(block: Block, least_words: int) -> Lines:
    folded = Block(block.first, _FOLD[block.data], block.offsets)
    starts = np.sort(np.concatenate([block.offsets[:-1], np.flatnonzero(block.data == 10) + 1]), kind="stable")
    at, ends, row, hashes = folded.words()
    line = np.searchsorted(starts, at, side="right") - 1
    enough = np.bincount(line, minlength=len(starts))[line] >= least_words
    at, ends, row, hashes, line = at[enough], ends[enough], row[enough], hashes[enough], line[enough]
    if not len(at):
        return Lines(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint8, np.int64, np.int64)))
    new = np.concatenate([[True], line[1:] != line[:-1]])
    edge = np.flatnonzero(new)
    size = np.diff(np.append(edge, len(line)))
    place = np.arange(len(line)) - np.repeat(edge, size)
    key = mix(np.add.reduceat(mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), edge) + size.astype(np.uint64))
    # the bytes of words, and the one before each word but a line's first
    step = np.zeros(len(folded.data) + 1, np.int8)
    step[at] += 1
    step[ends] -= 1
    keep = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    keep[at[~new] - 1] = True
    until = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=until[1:])
    which = line[edge]
    n = block.per_row(block.data == 10) + 1
    first_line = np.cumsum(n) - n
    return Lines(row[edge], which - first_line[row[edge]], key, folded.data[keep], until[at[edge]], until[ends[edge + size - 1]])


def _bands(lines: Lines, some: np.ndarray, by: Banding) -> np.ndarray:
    """The bucket keys of the lines ``some``, with the band's number in the lowest bits; a line shorter than a run has one, itself and what stands behind."""
    if not len(some):
        return np.zeros((0, by.bands), np.uint64)
    n = np.maximum(1, lines.ends[some] - lines.starts[some] - by.gram + 1)
    stop = np.cumsum(n)
    lane = eights(np.concatenate([lines.text, np.zeros(8, np.uint8)]))
    if by.gram < 8:
        run = lane << np.uint64(8 * (8 - by.gram))
    else:
        run = lane.copy()
        run[: len(run) - by.gram + 8] ^= lane[by.gram - 8 :] * np.uint64(0x9E3779B97F4A7C15)
    # the places where runs begin: whole lines take up the text one behind another, so a mask is enough
    step = np.zeros(len(run) + 1, np.int8)
    step[lines.starts[some]] += 1
    step[lines.starts[some] + n] -= 1
    run = mix(run[np.cumsum(step[:-1], dtype=np.int8).view(bool)])
    # the number of a run among equal ones of its line; 40 bits tell them apart
    run >>= np.uint64(24)
    run |= np.repeat(np.arange(len(some), dtype=np.uint64) << np.uint64(40), n)
    run.sort()
    new = np.ones(len(run), bool)
    np.not_equal(run[1:], run[:-1], out=new[1:])
    again = np.flatnonzero(~new)
    run <<= np.uint64(24)
    if len(again):
        new = np.flatnonzero(new)
        run[again] += (again - new[np.searchsorted(new, again) - 1]).astype(np.uint64)
    value = (mix(run) >> np.uint64(32)).astype(np.uint32)
    out, work = np.empty((by.bands, len(some)), np.uint64), np.empty_like(value)
    for band in range(by.bands):
        key = np.full(len(some), np.uint64(by.first + band))
        for k in range(band * by.rows, (band + 1) * by.rows):
            np.bitwise_xor(value, _FLIPS[k], out=work)
            np.multiply(work, _FACTORS[k], out=work)
            key = mix((key << np.uint64(32)) ^ (key >> np.uint64(32)) ^ np.minimum.reduceat(work, stop - n))
        out[band] = numbered(key, by.first + band)
    return out.T


def line_buckets(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of all lines one after another, and how many each has."""
    size = lines.ends - lines.starts
    parts = [np.flatnonzero(size <= SHORT / SIMILARITY), np.flatnonzero(size > SHORT * SIMILARITY)]
    found = [_bands(lines, some, by) for some, by in zip(parts, BANDINGS, strict=True)]
    owner = np.concatenate([np.repeat(some, by.bands) for some, by in zip(parts, BANDINGS, strict=True)])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([f.ravel() for f in found])[order], np.bincount(owner, minlength=len(size))


def hashed_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, line_no (from 0), key, whether the line is the row's first of its key, and if so its buckets; lines of ``least_words`` words or more."""

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                lines = normalised_lines(block, least_words)
                if not len(lines.key):
                    continue
                first = lines.first_in_row()
                own = Lines(*(x[first] for x in (lines.row, lines.number, lines.key)), lines.text, lines.starts[first], lines.ends[first])
                keys, times = line_buckets(own)
                count = np.zeros(len(first), np.int64)
                count[first] = times
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(keys.view(np.int64)))
                ids = batch.column(0).slice(block.first, block.rows).take(pa.array(lines.row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lines.number.astype(np.int32)), pa.array(lines.key.view(np.int64)), pa.array(first), listed], schema=LINES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(hash_lines), "doc_id long, line_no int, key long, first_here boolean, bands array<long>")


def class_texts(docs: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """(id, payload): the normal forms of the classes ``wanted`` (key, doc_id of a document that holds it), and some more by chance."""
    wanted = stored(wanted.select("key", "doc_id"), "wanted-lines")
    shared = docs.sparkSession.sparkContext.broadcast((bitmap_of(wanted.select("key", "doc_id"), TEXT_BITS), bitmap_of(wanted.select("doc_id"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_lines, of_docs = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(held(of_docs, places([ids], BITMAP_BITS))))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                lines = normalised_lines(block, least_words)
                some = np.flatnonzero(lines.first_in_row() & held(of_lines, places([lines.key.view(np.int64), ids[block.first + lines.row]], TEXT_BITS)))
                raw = lines.text.tobytes()
                texts = [raw[s:e] for s, e in zip(lines.starts[some].tolist(), lines.ends[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lines.key[some].view(np.int64)), pa.array(texts, pa.binary())], names=["id", "payload"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(trimmed(pick), "id long, payload binary").dropDuplicates(["id"])


def edit_distances(texts: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``edits`` of the pairs (texts[x], texts[y]) where it links them, else some number above ``most_edits``; all pairs at once."""
    out = np.zeros(len(x), np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    far = np.abs(size[x] - size[y]) > most_edits(size[x], size[y])
    out[far] = np.maximum(size[x], size[y])[far]
    one_by_one = ~far & ((size[x] > LONG_EDITS) | (size[y] > LONG_EDITS) | (size[x] == 0) | (size[y] == 0))
    rest = np.flatnonzero(~far & ~one_by_one)
    # pairs of about the same length go together
    rest = rest[np.argsort(size[x[rest]], kind="stable")]
    at = 0
    while at < len(rest):
        words = most_edits(size[x[rest[at]]], size[y[rest[at]]]) // 32 + 2
        part = rest[at : at + max(1, EDIT_WORDS // int(words))]
        part = part[: np.searchsorted(size[x[part]], 1.2 * size[x[part[0]]] + 16, side="right")]
        at += len(part)
        if len(part) < FEW_EDITS:
            one_by_one[part] = True
            continue
        part = part[np.argsort(size[y[part]], kind="stable")]
        out[part] = _edit_columns(texts, size, x[part], y[part])
    for k in np.flatnonzero(one_by_one):
        out[k] = edits(texts[x[k]], texts[y[k]])
    return out


def _edit_columns(texts: list[str], size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distances of pairs ordered by the length of y: differences down a column are bits of integers, for all pairs.

    Only words about the diagonal are followed, as far from it as a link may be; what is beyond counts as one edit a step,
    which is never too few, so distances that link are exact and others stay too large.
    """
    used, own = np.unique(np.concatenate([x, y]), return_inverse=True)
    codes = np.frombuffer("".join(texts[k] for k in used.tolist()).encode("utf-32-le"), "<u4")
    letters, code = np.unique(codes, return_inverse=True)
    n = size[used]
    start = np.cumsum(n) - n
    px, py = own[: len(x)], own[len(x) :]
    words, kinds, most = int(-(-n[px].max() // 64)), len(letters), int(most_edits(n[px], n[py]).max())
    place = np.arange(len(code)) - np.repeat(start, n)
    inside = place < 64 * words
    text = np.repeat(np.arange(len(used)), n)
    held_at = np.zeros((words, len(used) * kinds), np.uint64)
    np.bitwise_or.at(held_at, (place[inside] >> 6, text[inside] * kinds + code[inside]), np.uint64(1) << (place[inside] & 63).astype(np.uint64))
    one, top, full = np.uint64(1), np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF)
    up, down = [np.full(len(x), full) for _ in range(words)], [np.zeros(len(x), np.uint64) for _ in range(words)]
    ends, out, first = n[py], np.zeros(len(x), np.int64), 0
    low, above = 0, np.zeros(len(x), np.int64)  # the first word followed, and the distance where it begins
    for column in range(int(ends.max())):
        while low < min(words - 1, (column - most) // 64):
            above += np.bitwise_count(up[low]).astype(np.int64) - np.bitwise_count(down[low])
            low += 1
        above += 1
        row = px[first:] * kinds + code[start[py[first:]] + column]
        gain, loss = one, np.uint64(0)
        for w in range(low, min(words, (column + most) // 64 + 1)):
            equal, u, d = held_at[w][row], up[w][first:], down[w][first:]
            vertical = equal | d
            equal |= loss
            level = (((equal & u) + u) ^ u) | equal
            more, less = d | ~(level | u), u & level
            next_ = more >> top, less >> top
            more, less = (more << one) | gain, (less << one) | loss
            up[w][first:], down[w][first:] = less | ~(vertical | more), more & vertical
            gain, loss = next_
        done = int(np.searchsorted(ends, column + 1, side="right"))
        if done > first:
            own_size, total = n[px[first:done]], above[first:done].copy()
            for w in range(low, words):
                mask = np.where(own_size >= 64 * (w + 1), full, (one << np.clip(own_size - 64 * w, 0, 63).astype(np.uint64)) - one)
                total += np.bitwise_count(up[w][first:done] & mask).astype(np.int64) - np.bitwise_count(down[w][first:done] & mask)
            out[first:done], first = total, done
    return out


def letter_counts(texts: pa.Array) -> np.ndarray:
    """A row a text (binary, UTF-8)."""
    raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    size = np.array([len(t) for t in texts.to_pylist()], np.int64)
    at = np.repeat(np.arange(len(size)), size) * (COUNTS + 1) + _COUNTED[raw]
    return np.bincount(at, minlength=len(size) * (COUNTS + 1)).reshape(-1, COUNTS + 1)[:, :COUNTS].astype(np.int32)


def most_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((1 - SIMILARITY) * np.maximum(a, b) + 1e-9).astype(np.int64)


def may_be_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False where counts show more edits than a link has; an edit adds one character at most and takes one away."""
    more = a - b
    edits_ = np.maximum(np.maximum(more, 0).sum(-1), np.maximum(-more, 0).sum(-1))
    return edits_ <= most_edits(a.sum(-1), b.sum(-1))


def run_sets(texts: list[str]) -> list[np.ndarray]:
    """The runs of ``RUN`` characters of each text, each with its number among equal ones, as hashes."""
    size = np.array([max(0, len(t) - RUN + 1) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    start = np.cumsum([0, *(len(t) for t in texts[:-1])])
    at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    run = np.zeros(len(at), np.uint64)
    for k in range(RUN):
        run = mix(run + code[at + k])
    # runs that 40 bits do not tell apart count as equal, so more seem common, not fewer
    ordered = np.sort(np.repeat(np.arange(len(texts), dtype=np.uint64), size) << np.uint64(40) | run >> np.uint64(24))
    if not len(ordered):
        return [ordered] * len(texts)
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    again = np.arange(len(ordered)) - np.repeat(new, np.diff(np.append(new, len(ordered))))
    return np.split(mix((ordered << np.uint64(24)) + again.astype(np.uint64)), np.cumsum(size)[:-1])


def least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The runs that texts of these lengths have in common at least if they are linked; an edit changes ``RUN`` of them."""
    return np.maximum(a, b) - RUN + 1 - RUN * most_edits(a, b)


def _far(texts: list[str], size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs have too few runs in common; looked at for long lines only, for which the distance takes longer."""
    out = np.zeros(len(x), bool)
    for k in np.flatnonzero(np.maximum(size[x], size[y]) > LONG_PAIR):
        common = len(np.intersect1d(*run_sets([texts[x[k]], texts[y[k]]]), assume_unique=True))
        out[k] = common < least_common(size[x[k]], size[y[k]])
    return out


def surely_near(texts: list[str], size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs that one simple way to edit links: characters or words replaced place by place, or all between the common beginning and end."""
    out = np.zeros(len(x), bool)
    code = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    most = most_edits(size[x], size[y])
    for k in np.flatnonzero(np.abs(size[x] - size[y]) <= most):
        a, b = code[x[k]], code[y[k]]
        short, long = min(len(a), len(b)), max(len(a), len(b))
        ahead, behind = a[:short] != b[:short], a[len(a) - short :] != b[len(b) - short :]
        if not short or not long:
            continue
        begin = int(ahead.argmax()) if ahead.any() else short
        end = int(behind[::-1].argmax()) if behind.any() else short
        differ = long - short + min(int(ahead.sum()), int(behind.sum()))
        out[k] = min(differ, long - min(begin + end, short)) <= most[k] or _words_near(texts[x[k]], texts[y[k]], most[k])
    return out


def _words_near(a: str, b: str, most: int) -> bool:
    """Whether replacing the words that differ place by place is an edit of ``most`` characters at most."""
    words_a, words_b = a.split(" "), b.split(" ")
    return len(words_a) == len(words_b) and sum(max(len(x), len(y)) for x, y in zip(words_a, words_b, strict=True) if x != y) <= most


def _near(texts: list[str], size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the pairs (texts[x], texts[y]) are linked."""
    out = surely_near(texts, size, x, y)
    rest = np.flatnonzero(~out)
    out[rest] = edit_distances(texts, x[rest], y[rest]) <= most_edits(size[x[rest]], size[y[rest]])
    return out


def _pair_links(a: pa.Array, b: pa.Array) -> np.ndarray:
    out = may_be_similar(letter_counts(a), letter_counts(b))
    some = np.flatnonzero(out)
    texts = [t.decode() for t in (*a.take(pa.array(some)).to_pylist(), *b.take(pa.array(some)).to_pylist())]
    size = np.array([len(t) for t in texts], np.int64)
    x, y = np.arange(len(some)), np.arange(len(some), 2 * len(some))
    far = _far(texts, size, x, y)
    out[some[far]] = False
    some, x, y = some[~far], x[~far], y[~far]
    out[some] = _near(texts, size, x, y)
    return out


def _block_links(group: Group) -> tuple[np.ndarray, np.ndarray]:
    texts = [t.decode() for t in group.payload.to_pylist()]
    counts, size = letter_counts(group.payload), np.array([len(t) for t in texts], np.int64)
    runs = None if group.listed else run_sets(texts)
    joined, xs, ys = Joined(), [], []
    for x, y, bucket in group.pairs(MOST_TESTS):
        some = may_be_similar(counts[x], counts[y])
        x, y, bucket = x[some], y[some], bucket[some]
        some = group.fresh(x, y, bucket)
        x, y = x[some], y[some]
        if runs is None:
            some = ~_far(texts, size, x, y)
            x, y = x[some], y[some]
        elif len(x):
            rows, cols = np.unique(x), np.unique(y)
            common = intersections([runs[r] for r in rows], [runs[c] for c in cols])[np.searchsorted(rows, x), np.searchsorted(cols, y)]
            some = common >= least_common(size[x], size[y])
            x, y = x[some], y[some]
        while len(x):
            # what is linked by now needs no look
            label = np.array([joined.find(c) for c in group.component.tolist()])
            some = label[x] != label[y]
            x, y = x[some], y[some]
            a, b = x[:MOST_EDITS], y[:MOST_EDITS]
            near = _near(texts, size, a, b)
            a, b = spanning(a[near], b[near], group.component, joined)
            xs.append(a)
            ys.append(b)
            x, y = x[MOST_EDITS:], y[MOST_EDITS:]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys])


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, line_no) of the lines that go: every line of a group but its first occurrence."""
    lines = stored(hashed_lines(docs, least_words).where("doc_id is not null"), "lines")
    classes = stored(lines.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "line-classes")
    members = lines.where("first_here").select(F.explode("bands").alias("bucket"), F.col("key").alias("id"))
    weights = classes.where("n > 1").select(F.col("key").alias("id"), F.col("n").alias("weight"))

    def texts_of(ids: DataFrame) -> DataFrame:
        return class_texts(docs, classes.join(ids.withColumnRenamed("id", "key"), "key"), least_words)

    groups = linked_groups(members, weights, texts_of, _pair_links, _block_links, "lines")
    grouped = classes.join(groups.withColumnRenamed("id", "key"), "key", "left").where("n > 1 or component is not null").withColumn("group", F.coalesce("component", "key"))
    grouped = stored(grouped.select("key", "group", "doc_id", F.col("n").alias("times")), "line-groups")
    keepers = stored(grouped.groupBy("group").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")), "line-keepers")
    owner = stored(labelled(grouped, keepers, "group").select("key", "group", "keeper", F.col("times").alias("n")), "line-owners")
    shared = stored(labelled(lines.select("doc_id", "line_no", "key"), owner, "key").where("keeper is not null").select("doc_id", "line_no", "group", "keeper"), "shared-lines")
    sizes = shared.groupBy("group").agg(F.count("*").alias("n"), F.min(F.when(F.col("doc_id") == F.col("keeper"), F.col("line_no"))).alias("kept_no"))
    return labelled(shared, stored(sizes, "kept-lines"), "group").where("doc_id <> keeper or line_no <> kept_no").select("doc_id", "line_no")


def _added(docs: DataFrame, *names: str) -> list[str]:
    """Names for added columns that no column of ``docs`` has (case apart, as Spark resolves them)."""
    have, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def drop_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated lines gone; adds ``n_lines`` and ``n_removed``."""
    lines = stored(repeated_lines(docs, least_words), "repeated-lines")
    n_lines, n_removed, key, gone = _added(docs, "n_lines", "n_removed", "id_of_gone", "lines_gone")
    dropped = lines.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_set("line_no")).alias(gone))
    maybe, others = split_by_ids(docs, lines.select("doc_id"))
    joined = maybe.join(dropped.hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    parts, breaks = F.split("text", "\n", -1), F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    number = F.coalesce(breaks + 1, F.lit(0)).cast("long").alias(n_lines)
    cut = joined.select(
        *(F.when(F.col(gone).isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        number,
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed),
    )
    return cut.union(others.select(*(F.col(f"`{c}`") for c in docs.columns), number, F.lit(0).cast("long").alias(n_removed)))
