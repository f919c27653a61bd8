"""Spelling variants, SimHash near-duplicates and collocations against plain Python, on texts with nulls, ties, repeats and long runs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandlake.llm import collocations, grouping, simhash, spelling

LOWER = {x: x + 32 for x in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, n long, fp long, word string, component_id long, gone_id long"


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgéü", k=rng.randint(1, 9))) for _ in range(120)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    base = prose(120).split()
    texts = [None, "", " \t", "One", "two Words", "a" * 400 + " " + "b" * 40 + "  c", prose(60), "same words " * 30, "x, y. z! " * 12, prose(9_000)]
    for k in range(40):  # near copies, in a row, so that they hang together by links of their own
        base[rng.randrange(len(base))] = f"w{k}"
        texts += [" ".join(base)] * (1 + k % 2)
    passage = "the very same passage of some words that stands in many documents, again"
    texts += [f"{prose(5)} {passage} {prose(5)}" for _ in range(14)]
    texts += ["Colour colour COLOUR × ÷ naïve ÀÉÎ " * 6, "étude straße Straße řeka " * 8]
    return [(i if i != 6 else None, t, "en" if i % 3 else (None if i % 2 else "de"), 1, 2, "x", 3, 4) for i, t in enumerate(texts)] + [(20, "another text", "en", 1, 2, "x", 3, 4)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- SimHash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """fps: (doc_id, fingerprint) rows; doc_id -> smallest reachable."""
    up = {d: d for d, _ in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(fps, 2):
        if (x ^ y).bit_count() <= 3:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {d: find(d) for d in up}


def test_xxh64_of_ranges_of_any_size():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5_000, dtype=np.uint8)
    sizes = np.array([*range(70), 100, 255, 256, 257, 1_000])
    starts = rng.integers(0, 4_000, len(sizes))
    want = [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(starts, sizes, strict=True)]
    assert simhash.xxh64(data, starts, sizes).tolist() == want


def test_pieces_of_a_text_sum_to_its_majority(monkeypatch):
    h = np.random.default_rng(4).integers(0, 1 << 63, 500).astype(np.uint64)
    first, counts = np.array([0, 7, 300]), np.array([7, 293, 200])
    whole = simhash._majority(h, first, counts)
    monkeypatch.setattr(simhash, "SUMMED", 16)
    assert (simhash._majority(h, first, counts) == whole).all()


def test_simhash_groups(docs, rows, empty):
    want = [(r[0], fingerprint(r[1])) for r in rows]
    label = components([x for x in want if x[0] is not None])
    found = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(found, key=key) == sorted([(d, f"{x:016x}", label.get(d)) for d, x in want], key=key)
    assert any(d is not None and label[d] != d for d, _ in want)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {None} | set(label.values())
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits", [3, 4])
def test_every_pair_of_three_bits_meets_in_a_list(spark, bits):
    rng = random.Random(bits)
    pairs = [(x := rng.getrandbits(64), x ^ sum(1 << b for b in rng.sample(range(64), bits))) for _ in range(300)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ids = spark.createDataFrame([(signed(x),) for p in pairs for x in p], "id long").distinct()
    lists = {}
    for r in simhash.postings(ids).collect():
        lists.setdefault(r.id, set()).add(r.bucket)
    if bits == 3:
        assert all(lists[signed(a)] & lists[signed(b)] for a, b in pairs)
    near = simhash.near(*(np.array([p[k] for p in pairs], np.uint64) for k in (0, 1)))
    assert near.all() if bits == 3 else not near.any()


def test_a_large_bucket_of_two_components_is_dealt_in_few_rows(spark):
    n = 50_000
    members = spark.range(n).select(F_lit(7, "bucket"), "id", (F_col("id") % 100 == 0).cast("long").alias("component"))
    here = members.selectExpr("bucket", "id", "component", "0L AS _top", f"{-(-n * 99 // 100 // grouping.BLOCK)}L AS _tops", "1L AS _rest")
    found = grouping.dealt_out(here)
    assert found.count() < 2 * n
    # every pair of members of the two components meets
    blocks = {(r.id, r.i, r.j) for r in found.where("id < 2000").select("id", "i", "j").collect()}
    tasks = {}
    for x, i, j in blocks:
        tasks.setdefault(x, set()).add((i, j))
    assert all(tasks[a] & tasks[b] for a in range(0, 2000, 100) for b in range(2000) if b % 100)


def F_lit(value, name):
    from pyspark.sql import functions as F

    return F.lit(value).cast("long").alias(name)


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_heavy_keys_are_looked_up_like_others(spark):
    rows = spark.range(3_000).selectExpr("id", "CASE WHEN id < 1500 THEN 5 ELSE id END AS key")
    labels = rows.groupBy("key").count().selectExpr("key", "count AS n", "key * 2 AS label").where("key % 7 <> 3")
    found = {r.id: r.label for r in grouping.labelled(rows, labels, "key").collect()}
    assert len(found) == 3_000
    assert all(found[i] == (None if k % 7 == 3 else 2 * k) for i in range(3_000) for k in [5 if i < 1500 else i])


# ---------------------------------------------------------------- spelling


def vocabulary(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variant_rows(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_variants_of_documents(docs, rows, empty):
    assert as_rows(spelling.spelling_variants(docs)) == variant_rows(vocabulary(rows))
    assert spelling.spelling_variants(empty).count() == 0


@pytest.mark.parametrize("split", [1, 50, 10**9])
def test_near_words_do_not_depend_on_where_chunks_are_split(spark, monkeypatch, split):
    monkeypatch.setattr(spelling, "SPLIT", split)
    rng = random.Random(2)
    words = {"".join(rng.choices("abé", k=rng.randint(6, 9))) for _ in range(300)} | {"stemstem" + "".join(rng.choices("ab", k=rng.randint(0, 7))) for _ in range(150)}
    counts = {w: rng.choice([5, 5, 30, 200, 1_500]) for w in words}
    found = spelling.variants(spark.createDataFrame(sorted(counts.items()), "word string, n long"))
    assert as_rows(found) == variant_rows(counts)
    assert any(r[2] != (r[1] or r[0]) for r in as_rows(found))  # chains of forms


def test_checksums_of_runs_of_any_size():
    text = np.frombuffer(bytes(random.Random(1).choices(range(97, 123), k=3_000)), np.uint8)
    sizes = np.array([1, 2, 3, 8, 63, 64, 65, 66, 900])
    starts = np.arange(len(sizes)) * 200
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(sizes))], np.uint32)
    assert spelling.checksums(text, starts, sizes, before).tolist() == [zlib.crc32(text[s : s + n].tobytes(), int(b)) for s, n, b in zip(starts, sizes, before, strict=True)]


# ---------------------------------------------------------------- collocations


def phrase_counts(rows):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return f, n


def phrase_rows(rows, least=10, top=2_000):
    found, n = phrase_counts(rows)
    out = []
    for lang, f in found.items():
        have = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + 2] for p, a in have.items() if len(p) == 3 for i in (0, 1) if 100 * a >= 50 * f[p[i : i + 2]]}
        scored = []
        for p, a in have.items():
            if p not in covered:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, x.decode(), -a, left, right, n[lang], -s) for i, (s, a, x, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("numbers", [collocations.HEAD, 5, 0])
def test_collocations(docs, rows, numbers):
    found = collocations.collocations(docs, most_numbers=numbers).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = phrase_rows(rows)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert {len(r[2].split()) for r in want} == {2, 3}


def test_collocations_of_nothing(empty):
    assert collocations.collocations(empty).count() == 0


def test_node_flow_gives_all_counts(docs, rows):
    graph = collocations.graph_of(docs, least=3)
    coded = graph.phrases.select(*(graph.codes(c).alias(c) for c in ("w1", "w2", "w3")), "n")
    names = {(r.code): (r.lang, r.word) for r in graph.words.collect()}
    found = {}
    for r in coded.collect():
        p = [names[c] for c in (r.w1, r.w2, r.w3) if c]
        found[p[0][0], tuple(w for _, w in p)] = r.n
    f, _ = phrase_counts(rows)
    assert found == {(lang, p): a for lang, c in f.items() for p, a in c.items() if a >= 3}


def test_unary_paths_are_compacted(docs, rows):
    found = {(r.lang, tuple(r.words)): r.n for r in collocations.paths(collocations.graph_of(docs)).collect()}
    f, _ = phrase_counts(rows)
    edges = Counter((lang, p[i : i + 3]) for lang, p in found for i in range(len(p) - 2))
    assert edges == {(lang, p): 1 for lang, c in f.items() for p, a in c.items() if len(p) == 3 and a >= 10}
    for (lang, p), n in found.items():
        assert {f[lang][p[i : i + 3]] for i in range(len(p) - 2)} == {n}
    assert max(len(p) for _, p in found) > 8  # the passage is one path


def test_words_of_a_batch_stop_at_pieces_and_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array(["a b. c", None, "a\tB"])], names=["lang", "text"])
    (w,) = collocations._words(batch)
    assert w.goes_on.tolist() == [True, False, False, True, False]
    assert w.codes[0] == w.codes[3] and w.codes[1] == w.codes[4] and len(set(w.codes.tolist())) == 3
