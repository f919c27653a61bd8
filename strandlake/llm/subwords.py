"""Byte-level BPE ids of whole texts, with the ids of frequent words remembered in a bounded cache."""

from __future__ import annotations

import base64
import functools
import re
from array import array

import numpy as np

from strandlake.llm.textblocks import Block

#: Words remembered by a task; the cache starts anew when full.
CACHE_WORDS = 500_000
_LONGEST = 48
_SPACE, _RARE = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RARE[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)]] = True
_TWO_SPACES = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


class Subwords:
    """``ids(text)`` gives the little-endian unsigned 32-bit ids as bytes.

    The vocabulary's splitting pattern never joins what stands before a single space with what stands after it, nor what
    stands on two sides of a single line break, so pieces between them are encoded one by one and remembered.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.raw_byte = np.zeros(self.size, bool)
        for token, i in ranks.items():
            self.raw_byte[i] = len(token) == 1 and token[0] >= 0x80
        self.inner: dict[str, bytes] = {}
        self.leading: dict[str, bytes] = {}
        self.line_break = self._plain("\n")
        self.signs = {x: self._plain(x) for x in ".,;:!?"}

    def _plain(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def _word(self, piece: str, space: str) -> bytes:
        """Letters alone are one pre-token; a last sign of punctuation is one more."""
        if piece.isalpha():
            return array("I", self.encoding._core_bpe.encode_single_piece((space + piece).encode())).tobytes()
        if piece[-1:] in self.signs and piece[:-1].isalpha():
            known = self.inner if space else self.leading
            return (known.get(piece[:-1]) or self._word(piece[:-1], space)) + self.signs[piece[-1]]
        return self._plain(space + piece)

    def _kept(self, known: dict[str, bytes], most: int, piece: str, space: str) -> bytes:
        found = self._word(piece, space)
        if len(piece) <= _LONGEST:
            if len(known) >= most:
                known.clear()
            known[piece] = found
        return found

    def _first(self, piece: str) -> bytes:
        return self.leading.get(piece) or self._kept(self.leading, CACHE_WORDS // 4, piece, "")

    def _after_space(self, piece: str) -> bytes:
        return self._kept(self.inner, CACHE_WORDS, piece, " ")

    def _joined(self, pieces: list[str]) -> list[bytes]:
        first, rest = pieces[0], pieces[1:]
        found = list(map(self.inner.get, rest))
        if None in found:
            found = [self._after_space(p) if f is None else f for f, p in zip(found, rest, strict=True)]
        return [self._first(first), *found]

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _TWO_SPACES.search(text):
            return b"".join(self._joined(_SAFE_CUT.split(text)))
        out: list[bytes] = []
        for line in text.split("\n"):
            out += self._joined(line.split(" "))
            out.append(self.line_break)
        return b"".join(out[:-1])


class BlockEncoder:
    """Encodes the texts of a block at once: each distinct word is looked up once and the ids are gathered by numpy.

    Added tokens (text, id) are found wherever they stand, and what is between them is encoded by itself.

    Known words live in a pool, by the hash of the word and of what stands before it (nothing, a space, a line break).
    Texts with other white space go through ``Subwords.ids``.
    """

    def __init__(self, words: Subwords, added: tuple[tuple[str, int], ...] = ()):
        self.words, self.added = words, dict(added)
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if added else None
        self._empty()

    def _ids(self, text: str) -> bytes:
        if not self.split:
            return self.words.ids(text)
        return b"".join(self.added[x].to_bytes(4, "little") if x in self.added else self.words.ids(x) for x in self.split.split(text))

    def _empty(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, keys: list[int], ids: list[bytes]) -> None:
        """Appends the ids of new words to the pool."""
        new, at = np.frombuffer(b"".join(ids), "<u4"), len(self.known)
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(ids) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(new)] = new
        self.sizes[at : at + len(ids)] = sizes
        self.starts[at : at + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(new)
        self.known.update(zip(keys, range(at, at + len(ids)), strict=True))

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the bounds of each row in them."""
        data, offsets = block.data, block.offsets
        raw = data.tobytes()
        odd = uneven_rows(block)
        for token in self.added:
            if (mark := token.encode()) in raw:
                found = np.array([m.start() for m in re.finditer(re.escape(mark), raw)])
                odd = np.union1d(odd, block.row_of(found))
        starts, ends, rows, hashes = block.words()
        if len(self.known) > CACHE_WORDS or self.used > 8 * CACHE_WORDS:
            self._empty()
        before = np.where(starts > offsets[rows], data[np.maximum(starts - 1, 0)], 0)
        keys, first, which = np.unique(hashes ^ (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
        listed = keys.tolist()
        places = list(map(self.known.get, listed))
        if None in places:
            new = [k for k, place in enumerate(places) if place is None]
            words, w = self.words, first[new]
            found = []
            for start, end, lead in zip(starts[w].tolist(), ends[w].tolist(), before[w].tolist(), strict=True):
                ids = words._word(raw[start:end].decode("utf-8", "replace"), " " if lead == 32 else "")
                found.append(words.line_break + ids if lead == 10 else ids)
            self._add([listed[k] for k in new], found)
            for k in new:
                places[k] = self.known[listed[k]]
        at = np.array(places, np.int64)[which] if listed else np.zeros(0, np.int64)
        sizes = self.sizes[at]
        if len(odd):
            sizes[np.isin(rows, odd)] = 0
        ends_ = np.cumsum(sizes)
        total = int(ends_[-1]) if len(ends_) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends_ - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, sizes, block.rows).astype(np.int64))])
        if not len(odd):
            return ids, bounds
        parts = np.split(ids, bounds[1:-1])
        for i in odd:
            parts[i] = np.frombuffer(self._ids(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")), "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def uneven_rows(block: Block) -> np.ndarray:
    """Rows with white space that is not one space or line break between words: two together, one at the end, other kinds."""
    data, last = block.data, block.offsets[1:] - 1
    space = _SPACE[data]
    odd = _RARE[data]
    odd[1:] |= space[1:] & space[:-1]
    last = last[block.offsets[1:] > block.offsets[:-1]]
    odd[last] |= space[last]
    for lead, seconds in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE3, (0x80,))):
        at = np.flatnonzero(data[:-1] == lead)
        odd[at] |= np.isin(data[at + 1], seconds)
    at = np.flatnonzero(data[:-2] == 0xE2)
    third = data[at + 2]
    odd[at] |= (data[at + 1] == 0x80) & ((third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF))) | (data[at + 1] == 0x81) & (third == 0x9F)
    return np.unique(block.row_of(np.flatnonzero(odd)))


@functools.cache
def subwords(name: str) -> Subwords:
    return Subwords(name)


def block_encoder(name: str, added: tuple[tuple[str, int], ...] = ()) -> BlockEncoder:
    """A new encoder for a task; the words remembered go with it, so that they do not stay in a worker's memory."""
    words = subwords(name)
    words.inner.clear()
    words.leading.clear()
    return BlockEncoder(words, added)
