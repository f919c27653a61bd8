"""Run and k-mer figures of sequences in one Arrow function: native higher-order functions would walk each letter interpreted."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILE = "struct<base:string,run:int,motif2:string,top2:int,all2:int,acgt_motif2:string,acgt_top2:int,acgt_all2:int,motif3:string,top3:int,all3:int,acgt_motif3:string,acgt_top3:int,acgt_all3:int>"
_ACGT = np.zeros(256, bool)
_ACGT[np.frombuffer(b"ACGT", np.uint8)] = True
#: Up to this length the k-mers of a sequence are compared with each other at once; above, they are sorted.
SHORT = 64
ROWS = 2048


def _runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest run of each row, and the first place where a run reaches it."""
    current = np.ones(len(m), np.int32)
    best, at = current.copy(), np.zeros(len(m), np.int64)
    for j in range(1, m.shape[1]):
        current = np.where(m[:, j] == m[:, j - 1], current + 1, 1)
        more = current > best
        best[more], at[more] = current[more], j
    return best, at


def _times(codes: np.ndarray, real: np.ndarray) -> np.ndarray:
    """How often the k-mer of each place is among the row's real ones; 0 where it is not one itself."""
    if codes.shape[1] <= SHORT:
        return ((codes[:, :, None] == codes[:, None, :]) & real[:, None, :]).sum(2) * real
    out = np.zeros(codes.shape, np.int64)
    for row, (c, r) in enumerate(zip(codes, real, strict=True)):
        _, which, n = np.unique(c[r], return_inverse=True, return_counts=True)
        out[row, r] = n[which]
    return out


def _pieces(m: np.ndarray, at: np.ndarray, size: int, some: np.ndarray) -> pa.Array:
    """``size`` letters of each row of ``m`` from ``at`` on, empty where not ``some``."""
    letters = m[np.arange(len(m))[some][:, None], at[some][:, None] + np.arange(size)]
    return pa.StringArray.from_buffers(len(m), pa.py_buffer(np.concatenate([[0], np.cumsum(some * size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


def _figures(m: np.ndarray) -> pa.StructArray:
    """The profiles of rows of letters of one size."""
    rows, size = m.shape
    run, first = _runs(m) if size else (np.zeros(rows, np.int32), np.zeros(rows, np.int64))
    found = {"base": _pieces(m, first, 1, np.full(rows, size > 0)), "run": pa.array(run.astype(np.int32))}
    for k in (2, 3):
        n = max(0, size - k + 1)
        codes, plain = np.zeros((rows, n), np.int32), np.ones((rows, n), bool)
        for j in range(k if n else 0):
            codes = codes * 256 + m[:, j : j + n]
            plain &= _ACGT[m[:, j : j + n]]
        every, all_plain = np.ones((rows, n), bool), bool(plain.all())
        for name, real in (("", every), ("acgt_", plain)):
            if not name or not all_plain:
                times = _times(codes, real) if n else np.zeros((rows, 1), np.int64)
                at = times.argmax(1)
                top = times[np.arange(rows), at]
            found |= {f"{name}motif{k}": _pieces(m, at, k, top > 0), f"{name}top{k}": pa.array(top.astype(np.int32)), f"{name}all{k}": pa.array(real.sum(1).astype(np.int32))}
    return pa.StructArray.from_arrays([found[f.name] for f in _type()], fields=list(_type()))


def _profile(s: pa.Array) -> pa.Array:
    texts = s.to_pylist()
    sizes = np.array([-1 if t is None else len(t) for t in texts])
    parts, order = [], []
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        for first in range(0, len(rows), ROWS):
            some = rows[first : first + ROWS]
            raw = "".join(texts[i] for i in some)
            if raw.isascii():
                parts.append(_figures(np.frombuffer(raw.encode(), np.uint8).reshape(len(some), size)))
                order.append(some)
                continue
            # motifs are letters of the text, which may not be one byte each
            figures = _figures(np.frombuffer(raw.encode("ascii", "replace"), np.uint8).reshape(len(some), size)).to_pylist()
            for i, own in zip(some, figures, strict=True):
                asked = texts[i].encode("ascii", "replace").decode()
                if own["base"] == "?":
                    own["base"] = texts[i][asked.index("?" * own["run"]) + own["run"] - 1]
                own |= {n: texts[i][asked.index(v) : asked.index(v) + len(v)] for n, v in own.items() if n.endswith(("motif2", "motif3")) and "?" in v}
            parts.append(pa.array(figures, _type()))
            order.append(some)
    if not parts:
        return pa.nulls(len(texts), _type())
    # a null row takes from behind the end
    place = np.full(len(texts), -1)
    place[np.concatenate(order)] = np.arange(len(np.concatenate(order)))
    return pa.concat_arrays(parts).take(pa.array(place, mask=place < 0))


def _type() -> pa.DataType:
    parts = [p.split(":") for p in PROFILE.removeprefix("struct<").removesuffix(">").split(",")]
    return pa.struct([(n, pa.string() if t == "string" else pa.int32()) for n, t in parts])


@functools.cache
def _function():
    """Made at its first use, since workers import this module without a session."""
    return F.arrow_udf(_profile, PROFILE)


def sequence_profile(s: Column) -> Column:
    """base and run: the first run that reaches the greatest length. motifK, topK, allK (K 2 or 3): the commonest k-mer, the first
    seen of equals, its number and that of all; acgt_ ones count k-mers of A, C, G, T only. A null stays null.

    Spark evaluates equal uses in one projection once.
    """
    return _function()(s)
