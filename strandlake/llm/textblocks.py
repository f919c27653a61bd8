"""Vectorised word, line and shingle hashing of Arrow text columns with numpy.

A batch is cut into blocks of about a megabyte. Inside a block every word or line is read in lanes of eight bytes, each mixed
with its number, and the sum of its lanes is mixed with its length, so no Python loop runs over words.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK_BYTES = 1 << 20
#: By the number of bytes of a lane that belong to the word.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one little-endian number; zeros stand behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, 0, (1,)).copy()


@dataclass
class Block:
    """Consecutive rows of a batch: their UTF-8 bytes and row offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold_case: bool) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, U)
        padded = np.concatenate([LOWER[self.data] if fold_case else self.data, np.zeros(8, np.uint8)])
        at_any = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        size = ends - starts
        lanes = np.maximum(1, (size + 7) >> 3)
        first = np.cumsum(lanes) - lanes
        number = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        rest = np.repeat(size, lanes) - 8 * number
        lane = at_any[np.repeat(starts, lanes) + 8 * number] & _LANE[np.minimum(rest, 8)]
        found = np.add.reduceat(mix(lane ^ mix(number.astype(U) + U(0x9E3779B97F4A7C15))), first)
        return mix(found + size.astype(U) * U(0xD6E8FEB86659FD93))

    def spans(self, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the runs of bytes other than those ``breaks`` marks (white space); none spans two rows."""
        space = breaks[self.data]
        edge = np.zeros(len(space) + 1, bool)
        edge[self.offsets] = True
        before, after = np.ones(len(space), bool), np.ones(len(space), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        starts = np.flatnonzero(~space & (before | edge[:-1]))
        ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        return starts, ends, self.row_of(starts)

    def words(self, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, rows and hashes of the runs of bytes other than white space."""
        starts, ends, row = self.spans()
        return starts, ends, row, self.hashes(starts, ends, fold_case)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r"""Starts, ends, rows and raw hashes of the \n-split lines of every row, the empty ones too."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        counts = self.per_row(self.data == 10) + 1
        rows = np.repeat(np.arange(self.rows), counts)
        return starts, ends, rows, self.hashes(starts, ends, False)


def trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task that gives memory back to the system at its end, since workers live on for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not gc.get_freeze_count():
            gc.freeze()  # the modules a worker has loaded; the collection of each task need not walk them
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def blocks(column: pa.Array) -> Iterator[Block]:
    """Blocks of a string column; a null counts as empty. The bytes are not copied unless there are nulls."""
    column = column.fill_null("") if column.null_count else column
    size = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.zeros(1, np.int64)
    if len(column):
        raw = np.frombuffer(column.buffers()[1], size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(raw, raw[at] + BLOCK_BYTES, side="right")) - 1)
        end = min(end, len(column))
        yield Block(at, data[raw[at] : raw[end]], raw[at : end + 1] - raw[at])
        at = end


_STEP = [U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all windows of ``size`` words that lie inside one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    inside = np.flatnonzero(rows[:n] == rows[size - 1 :])
    total = np.zeros(len(inside), U)
    for k in range(size):
        total += mix(hashes[inside + k] ^ _STEP[k % 5]) * (_STEP[(k + 2) % 5] + U(2 * (k // 5)))
    return inside, mix(total)


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, ordered by row: hashes, and row bounds.

    A row with some words but fewer than ``size`` has its whole sequence as one shingle.
    """
    _, _, rows, hashes = block.words(fold_case=True)
    at, found = windows(hashes, rows, size)
    owner = rows[at]
    counts = np.bincount(rows, minlength=block.rows)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(rows, short)
        whole = np.zeros(len(short), U)
        for k in range(size - 1):
            has = counts[short] > k
            whole[has] += mix(hashes[first[has] + k] ^ _STEP[k]) * _STEP[(k + 1) % 5]
        found = np.concatenate([found, mix(whole ^ U(0x5BF0_3635_DEAD_0001))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(block.rows + 1))
