"""Language-model scores of whole texts.

Base: word counts of the training documents with add-one smoothing, exact for every document. The most frequent words (a
bounded number) go to every task; what else a document holds is joined.

Model: a causal self-attention layer in numpy over subword ids. The ``OWN_IDS`` most frequent ids have embeddings and outputs
of their own, the last of them standing for all rarer ids, which share its chance by their counts; on byte-level ids of prose
the own ones are nearly all tokens. The chance of an id is that of its group of ``GROUP`` ids times that within the group, both
from the layer. Id counts come from all training documents and are where the outputs begin. The layer's weights start from a
bounded sample of documents and are then trained where the data lie: every stored part trains on all of its training windows and
the weights are averaged by Spark. Texts are scored in overlapping windows, each token once, many windows at a time.

Cases: a null text is empty and has its end alone. A null doc_id counts as training. Repeated rows come back each. Without
training documents all counts are 0. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.subwords import block_encoder
from strandlake.llm.tables import bitmap_of, held, places, stored
from strandlake.llm.textblocks import blocks, trimmed

VOCABULARY = "byte_bpe_50k.tiktoken"
N_IDS, END = 50_257, 50_256
GROUPS = GROUP = 64
OWN_IDS = GROUPS * GROUP
REST, START = OWN_IDS - 1, OWN_IDS  # all rarer ids; what stands before a text
WIDTH, WINDOW, OVERLAP = 24, 32, 8
STEP = WINDOW - OVERLAP
BATCH = 256
#: Bounds: words that go to every task (a power of two of occurrences is the border), documents and steps of the first fit.
HEAD_WORDS, FIRST_DOCS, FIRST_STEPS = 300_000, 400, 800
#: Documents whose windows are shuffled together in the second fit, and bits of the bitmap of the words that are joined, 8 MB.
TRAIN_DOCS, TAIL_BITS = 256, 26
END_WORD = np.uint64(0xE17A_0E17_A0E1_7A0E)
TEXTS = "doc_id long, held_out boolean, text string, ids binary, word long, times long"


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ---------------------------------------------------------------- the attention layer


#: Logits between these bounds are raised as they are.
_RAISED = 60.0


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``z`` raised in place, each row by a factor of its own where the values are large, and what was taken from the rows before."""
    if z.size and -_RAISED < float(z.min()) and float(z.max()) < _RAISED:
        return np.exp(z, out=z), np.zeros(1, np.float32)
    top = z.max(-1)
    z -= top[..., None]
    return np.exp(z, out=z), top


@dataclass
class Layer:
    """Embeddings of ids and places, one attention head with a residual, and the outputs over groups and within each group."""

    p: dict[str, np.ndarray]

    SHAPES = {"e": (OWN_IDS + 1, WIDTH), "pos": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "u": (WIDTH, GROUPS), "b": (GROUPS,), "w": (GROUPS, WIDTH, GROUP), "c": (GROUPS, GROUP)}  # noqa: RUF012

    @classmethod
    def new(cls, counts: np.ndarray, seed: int = 7) -> Layer:
        """Random but for the outputs, which begin at the own ids' counts."""
        rng = np.random.default_rng(seed)
        p = {n: (rng.normal(size=s) * 0.25).astype(np.float32) for n, s in cls.SHAPES.items()}
        table = np.log(counts.reshape(GROUPS, GROUP) + 0.5)
        p["b"] = np.log(np.exp(table).sum(1)).astype(np.float32)
        p["b"] -= p["b"].max()
        p["c"] = (table - table.max(1, keepdims=True)).astype(np.float32)
        p["w"] *= 0.2
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Layer:
        out, at = {}, 0
        for n, s in cls.SHAPES.items():
            size = int(np.prod(s))
            out[n], at = flat[at : at + size].reshape(s).astype(np.float32), at + size
        return cls(out)

    def _joint(self) -> np.ndarray:
        return np.hstack([self.p["q"] / np.float32(WIDTH**0.5), self.p["k"], self.p["v"]])

    def forward(self, c: np.ndarray, first: int = 0) -> dict[str, np.ndarray]:
        """c: ids before each target, windows by places; ``h`` is there for places from ``first`` on."""
        p = self.p
        x = np.take(p["e"], c, axis=0)
        x += p["pos"]
        all_ = (x.reshape(-1, WIDTH) @ self._joint()).reshape(*c.shape, 3 * WIDTH)
        q, k, v = all_[:, first:, :WIDTH], all_[:, :, WIDTH : 2 * WIDTH], all_[:, :, 2 * WIDTH :]
        a = np.matmul(q, k.transpose(0, 2, 1))
        if a.size and -_RAISED < float(a.min()) and float(a.max()) < _RAISED:
            np.exp(a, out=a)
            a *= _EARLIER[first:]
        else:
            a += _LATER[first:]
            a -= a.max(2, keepdims=True)
            np.exp(a, out=a)
        a *= (1 / (a @ _ONES))[:, :, None]
        o = np.matmul(a, v)
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "o": o, "h": o + x[:, first:]}

    def _parts(self, c: np.ndarray, targets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]], np.ndarray, np.ndarray]:
        """Windows with a target in the overlap and the others, which need no ``h`` there: (windows, real places, forward); and the ``h`` and ids of all targets."""
        early = (targets[:, :OVERLAP] >= 0).any(1)
        parts, hs, wanted = [], [np.zeros((0, WIDTH), np.float32)], [np.zeros(0, np.int64)]
        for some, first in ((np.flatnonzero(early), 0), (np.flatnonzero(~early), OVERLAP)):
            if not len(some):
                continue
            f, flat = self.forward(c[some], first), targets[some, first:].ravel()
            real = np.flatnonzero(flat >= 0)
            parts.append((some, real, f))
            hs.append(f["h"].reshape(-1, WIDTH)[real])
            wanted.append(flat[real])
        return parts, np.concatenate(hs), np.concatenate(wanted)

    def _within(self, h: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
        """The order of the targets by group, their ``h``, (group, start, end) of each group in it, and the logits within the groups."""
        group = (want // GROUP).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))]).tolist()
        spans = [(g, bounds[g], bounds[g + 1]) for g in range(GROUPS) if bounds[g] < bounds[g + 1]]
        h, z = h[order], np.empty((len(want), GROUP), np.float32)
        for g, s, e in spans:
            np.matmul(h[s:e], self.p["w"][g], out=z[s:e])
            z[s:e] += self.p["c"][g]
        return order, h, spans, z

    def log_chance(self, c: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of the chance of each target id (negative ones: none, 0)."""
        parts, h, want = self._parts(c, targets)
        rows = np.arange(len(want))
        z = h @ self.p["u"]
        z += self.p["b"]
        own = z[rows, want // GROUP]
        y, top = exponentials(z)
        own = own - top - np.log(y @ _ONES_GROUPS)
        order, _, _, z = self._within(h, want)
        inner = z[rows, want[order] % GROUP]
        y, top = exponentials(z)
        own[order] += inner - top - np.log(y @ _ONES_GROUP)
        out, at = np.zeros(targets.shape), 0
        for some, real, f in parts:
            first = WINDOW - f["h"].shape[1]
            part = np.zeros(f["h"].shape[:2])
            part.reshape(-1)[real] = own[at : at + len(real)]
            out[some, first:] = part
            at += len(real)
        return out

    def train_step(self, c: np.ndarray, targets: np.ndarray, state: dict[str, tuple[np.ndarray, np.ndarray]], t: int, rate: float) -> float:
        p = self.p
        parts, h, want = self._parts(c, targets)
        if not len(want):
            return 0.0
        share, rows = np.float32(1 / len(want)), np.arange(len(want))

        def lost(z: np.ndarray, at: np.ndarray, ones: np.ndarray) -> tuple[float, np.ndarray]:
            """The loss of the logits, and its gradient in their place."""
            own = z[rows, at]
            y, top = exponentials(z)
            total = y @ ones
            y *= (share / total)[:, None]
            y[rows, at] -= share
            return float((np.log(total) + top - own).sum()), y

        z = h @ p["u"]
        z += p["b"]
        loss, y = lost(z, want // GROUP, _ONES_GROUPS)
        g = {"u": h.T @ y, "b": np.ones(len(y), np.float32) @ y, "w": np.zeros_like(p["w"]), "c": np.zeros_like(p["c"])}
        d_real = y @ p["u"].T
        order, by_group, spans, z = self._within(h, want)
        more, y = lost(z, want[order] % GROUP, _ONES_GROUP)
        loss += more
        d_group, ones = np.empty_like(by_group), np.ones(len(y), np.float32)
        for k, s, e in spans:
            np.matmul(by_group[s:e].T, y[s:e], out=g["w"][k])
            np.matmul(ones[s:e], y[s:e], out=g["c"][k])
            np.matmul(y[s:e], p["w"][k].T, out=d_group[s:e])
        d_real[order] += d_group
        joint, at = self._joint(), 0
        d_joint, g["pos"], g["e"] = np.zeros_like(joint), np.zeros_like(p["pos"]), np.zeros_like(p["e"])
        for some, real, f in parts:
            first = WINDOW - f["h"].shape[1]
            dh = np.zeros((f["h"].size // WIDTH, WIDTH), np.float32)
            dh[real] = d_real[at : at + len(real)]
            at += len(real)
            dh = dh.reshape(f["h"].shape)
            d_all = np.zeros((len(some), WINDOW, 3 * WIDTH), np.float32)
            np.matmul(f["a"].transpose(0, 2, 1), dh, out=d_all[:, :, 2 * WIDTH :])
            ds = np.matmul(dh, f["v"].transpose(0, 2, 1))
            # a row's sum of attention by its gradient is the product of the output and the output's gradient
            ds -= (dh * f["o"]).sum(2, keepdims=True)
            ds *= f["a"]
            np.matmul(ds, f["k"], out=d_all[:, first:, :WIDTH])
            np.matmul(ds.transpose(0, 2, 1), f["q"], out=d_all[:, :, WIDTH : 2 * WIDTH])
            flat = d_all.reshape(-1, 3 * WIDTH)
            d_joint += f["x"].reshape(-1, WIDTH).T @ flat
            dx = (flat @ joint.T).reshape(f["x"].shape)
            dx[:, first:] += dh
            g["pos"] += dx.sum(0)
            ids = c[some].ravel()
            by_id = np.argsort(ids.astype(np.uint16), kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(ids[by_id]) != 0]))
            g["e"][ids[by_id[edge]]] += np.add.reduceat(dx.reshape(-1, WIDTH)[by_id], edge, axis=0)
        g |= {"q": d_joint[:, :WIDTH] / np.float32(WIDTH**0.5), "k": d_joint[:, WIDTH : 2 * WIDTH], "v": d_joint[:, 2 * WIDTH :]}
        for n, d in g.items():
            if n not in state:
                state[n] = np.zeros_like(p[n]), np.zeros_like(p[n])
            m, v = state[n]
            m *= np.float32(0.9)
            m += np.float32(0.1) * d
            v *= np.float32(0.99)
            v += np.float32(0.01) * d * d
            size = np.sqrt(v)
            size *= np.float32(1 / np.sqrt(1 - 0.99**t))
            size += np.float32(1e-8)
            p[n] -= np.float32(rate / (1 - 0.9**t)) * m / size
        return loss / len(want)


#: What keeps a place from the later ones.
_LATER = np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32)
_EARLIER = np.tri(WINDOW, dtype=np.float32)
_ONES, _ONES_GROUPS, _ONES_GROUP = (np.ones(n, np.float32) for n in (WINDOW, GROUPS, GROUP))


def id_windows(own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of all windows of consecutive texts, the row of each window, and places of targets in ``own``.

    A target that an earlier window scores is -1, and so is what stands behind the text's end.
    """
    sizes = np.diff(bounds)
    n = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP)), 0)
    row = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = number[:, None] * STEP + np.arange(WINDOW)
    inside = place < sizes[row][:, None]
    at = np.where(inside, bounds[row][:, None] + place, 0)
    fresh = inside & ((number[:, None] == 0) | (np.arange(WINDOW) >= OVERLAP))
    before = np.where(place == 0, START, own[np.maximum(at - 1, 0)])
    return np.where(inside, before, START), np.where(fresh, own[at], -1), row, at


@dataclass
class OwnIds:
    """The own id of every id, the counts of the own ids, and the natural log of a rarer id's share of ``REST``."""

    of: np.ndarray
    counts: np.ndarray
    log_share: np.ndarray

    @classmethod
    def counted(cls, counts: np.ndarray) -> OwnIds:
        order = np.lexsort((np.arange(N_IDS), -counts))
        of = np.full(N_IDS, REST, np.int64)
        of[order[:REST]] = np.arange(REST)
        rare = of == REST
        log_share = np.zeros(N_IDS, np.float32)
        log_share[rare] = np.log(counts[rare] + 1.0) - np.log((counts[rare] + 1.0).sum())
        return cls(of, np.bincount(of, counts, OWN_IDS), log_share)


def fitted(layer: Layer, inputs: np.ndarray, targets: np.ndarray, steps: int, rate: float, seed: int = 3) -> Layer:
    rng, state = np.random.default_rng(seed), {}
    for t in range(1, steps + 1):
        some = rng.integers(0, len(inputs), BATCH)
        layer.train_step(inputs[some], targets[some], state, t, rate * (1 - 0.9 * t / steps))
    return layer


# ---------------------------------------------------------------- the corpus


def _encoded(docs: DataFrame) -> DataFrame:
    """A row a document with its text and ids, and rows with the words of each batch of training documents and their counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = block_encoder(VOCABULARY)
        for batch in batches:
            out = batch.column(1).to_numpy(zero_copy_only=False)
            words, times = [], []
            for block in blocks(batch.column(2)):
                ids, bounds = encoder.encode(block)
                raw = ids.astype("<u2").tobytes()
                column = pa.Array.from_buffers(pa.binary(), block.rows, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(raw)])
                part = batch.slice(block.first, block.rows)
                none = pa.nulls(block.rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2).cast(pa.string()).fill_null(""), column, none, none], names=["doc_id", "held_out", "text", "ids", "word", "times"])
                _, _, rows, hashes = block.words(fold_case=True)
                w, n = np.unique(hashes[~out[block.first + rows]], return_counts=True)
                words.append(w)
                times.append(n)
            learned = int((~out).sum())
            if learned:
                w, at = np.unique(np.concatenate([*words, [END_WORD]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([*times, [learned]])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int64()), pa.nulls(len(w), pa.bool_()), pa.nulls(len(w), pa.string()), pa.nulls(len(w), pa.binary()), pa.array(w.view(np.int64)), pa.array(n)], names=["doc_id", "held_out", "text", "ids", "word", "times"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(trimmed(encode), TEXTS)


def _with_end(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch with each text's end, and the bounds."""
    parts = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in column]
    sizes = np.array([len(x) for x in parts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.full(bounds[-1], END, np.int64)
    keep = np.ones(bounds[-1], bool)
    keep[bounds[1:] - 1] = False
    flat[keep] = np.concatenate(parts) if parts else []
    return flat, bounds


def _id_counts(texts: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_IDS, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, TRAIN_DOCS):
                total += np.bincount(_with_end(batch.column(0).slice(first, TRAIN_DOCS))[0], minlength=N_IDS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    found = texts.where("not held_out").select("ids").mapInArrow(trimmed(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(N_IDS, np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


def trained_part(layer: Layer, own: OwnIds, columns: Iterator[pa.Array]) -> int:
    """Trains on every window of the ids in ``columns``; the number of steps."""
    rng, state, t = np.random.default_rng(3), {}, 0
    for column in columns:
        for first in range(0, len(column), TRAIN_DOCS):
            flat, bounds = _with_end(column.slice(first, TRAIN_DOCS))
            inputs, targets, _, _ = id_windows(own.of[flat], bounds)
            order = rng.permutation(len(inputs))
            for k in range(0, len(order), BATCH):
                t += 1
                some = order[k : k + BATCH]
                layer.train_step(inputs[some], targets[some], state, t, 0.003)
    return t


def train(texts: DataFrame) -> tuple[Layer, OwnIds]:
    """Id counts over all training texts, a first fit on a bounded sample, and a second one averaged over all parts."""
    own = OwnIds.counted(_id_counts(texts))
    layer = Layer.new(own.counts)
    learn = texts.where("not held_out").select("doc_id", "ids")
    ids = learn.select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(FIRST_DOCS).select("doc_id").distinct()
    first = learn.join(F.broadcast(ids), "doc_id", "left_semi").select("ids").limit(FIRST_DOCS).toArrow().combine_chunks()
    parts = [id_windows(own.of[flat], bounds)[:2] for flat, bounds in (_with_end(first.column("ids").slice(k, 32)) for k in range(0, first.num_rows, 32))]
    if not parts:
        return layer, own
    inputs, targets = (np.concatenate([p[k] for p in parts]) for k in range(2))
    start = fitted(layer, inputs, targets, FIRST_STEPS, 0.015).flat()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layer = Layer.of(start)
        t = trained_part(layer, own, (batch.column(0) for batch in batches))
        if t:
            w = layer.flat().astype(np.float64) * t
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(w), pa.array(np.full(len(w), t))], names=["place", "weighted", "steps"])

    rows = learn.select("ids").mapInArrow(trimmed(local), "place long, weighted double, steps long").groupBy("place").agg((F.sum("weighted") / F.sum("steps")).alias("w")).orderBy("place").toArrow()
    return (Layer.of(rows.column("w").to_numpy()) if rows.num_rows else Layer.of(start)), own


def scores(docs: DataFrame) -> DataFrame:
    """A row a document: held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's chance of the text)."""
    table = stored(_encoded(docs), "lm-texts")
    counts = stored(table.where("word is not null").groupBy("word").agg(F.sum("times").alias("times")), "lm-words")
    total = counts.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, base_log = total["n"], float(np.log10(total["n"] + total["v"] + 1))
    # words of 2^k occurrences or more belong to the head, k the least with which it has at most HEAD_WORDS words
    steps = counts.groupBy(F.floor(F.log2("times")).cast("int").alias("k")).count().orderBy(F.desc("k")).collect()
    power, sum_ = 62, 0
    for r in steps:
        sum_ += r["count"]
        if sum_ > HEAD_WORDS:
            break
        power = r["k"]
    is_head = F.floor(F.log2("times")).cast("int") >= power
    head, tail = counts.where(is_head).toArrow(), counts.where(~is_head)
    words = head.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    texts = table.where("ids is not null")
    layer, own = train(texts)
    shared = docs.sparkSession.sparkContext.broadcast((words[order], head.column("times").to_numpy()[order], bitmap_of(tail.select("word"), TAIL_BITS), layer.flat(), own))
    return _scored(texts, tail, shared, n_train, base_log)


def _scored(texts: DataFrame, tail: DataFrame, shared, n_train: int, base_log: float) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times, tail_bits, flat_layer, own_ids = shared.value
        layer, logs = Layer.of(flat_layer), np.log10(times + 1.0)
        for batch in batches:
            for block in blocks(batch.column(2)):
                part = batch.slice(block.first, block.rows)
                _, _, rows, hashes = block.words(fold_case=True)
                rows, hashes = np.concatenate([rows, np.arange(block.rows)]), np.concatenate([hashes, np.full(block.rows, END_WORD)])
                keys, which = np.unique(hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1))
                has = words[at] == keys if len(words) else np.zeros(len(keys), bool)
                value = np.where(has, logs[at], 0.0) if len(words) else np.zeros(len(keys))
                own, known = value[which], has[which]
                sums = np.bincount(rows, own, block.rows)
                n_known = np.bincount(rows, known, block.rows).astype(np.int64)
                n_tokens = np.bincount(rows, minlength=block.rows)
                # what no training text has needs no join: its count is 0
                maybe = held(tail_bits, places([keys.view(np.int64)], TAIL_BITS))[which]
                rest = np.flatnonzero(~known & maybe)
                rest = rest[np.lexsort((which[rest], rows[rest]))]
                edge = np.flatnonzero(np.concatenate([[True], (rows[rest][1:] != rows[rest][:-1]) | (which[rest][1:] != which[rest][:-1])])) if len(rest) else np.zeros(0, np.int64)
                repeat = np.diff(np.append(edge, len(rest)))
                heads = rest[edge] if len(rest) else rest
                cuts = np.searchsorted(rows[heads], np.arange(block.rows + 1)).astype(np.int32)
                listed = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (hashes[heads].view(np.int64), repeat.astype(np.int64))]
                found = _text_scores(layer, own_ids, part.column(3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_tokens), pa.array(n_known), pa.array(sums), pa.array(found), *listed], names=["doc_id", "held_out", "n_tokens", "n_known", "sums", "score", "words", "times"])

    scored = texts.select("doc_id", "held_out", "text", "ids").mapInArrow(trimmed(score), "doc_id long, held_out boolean, n_tokens long, n_known long, sums double, score double, words array<long>, times array<long>")
    # rows without rare words take a key of their own, so that no task gets them all
    rows = scored.withColumn("rid", F.monotonically_increasing_id()).withColumn("w", F.explode_outer(F.arrays_zip("words", "times")))
    rows = rows.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "sums", "score", F.coalesce("w.words", F.col("rid")).alias("word"), F.coalesce("w.times", F.lit(0)).alias("k"))
    joined = rows.join(tail.withColumnRenamed("times", "c"), "word", "left")
    keys = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "sums", "score"]
    agg = joined.groupBy(*keys).agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("rare"))
    return agg.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("sums") + F.col("rare") - F.col("n_tokens") * F.lit(base_log)).alias("base_score"), "score",
    )


def _text_scores(layer: Layer, own: OwnIds, ids: pa.Array) -> np.ndarray:
    flat, bounds = _with_end(ids)
    within = np.add.reduceat(own.log_share[flat].astype(np.float64), bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    inputs, targets, row, _ = id_windows(own.of[flat], bounds)
    total = np.zeros(len(bounds) - 1)
    for k in range(0, len(inputs), BATCH):
        chance = layer.log_chance(inputs[k : k + BATCH], targets[k : k + BATCH])
        total += np.bincount(row[k : k + BATCH], chance.sum(1), len(total))
    return (total + within) / np.log(10)
