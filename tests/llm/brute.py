"""Plain Python versions of the operators' contracts, to compare with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations
from math import log10

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {x: x + 32 for x in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOWER))


def license_row(text):
    w = words(text, PLAIN)
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def joined(spans, kinds):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, kinds.index(k), k, e) for k, s, e in spans))


def secret_spans(text):
    t = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def pii_spans(text):
    t = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def near_groups(docs):
    """docs: (doc_id, text); doc_id -> (n_shingles, component)."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    both = Counter()
    for ds in by_shingle.values():
        both.update(combinations(sorted(ds), 2))
    for (a, b), n in both.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def base_scores(docs):
    """docs: (doc_id, text); rows of doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = {d: [*words(t), None] for d, t in docs}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(x for d, ts in tokens.items() if not out[d] for x in ts)
    n, v = sum(counts.values()), len(counts)
    return {d: (out[d], len(ts), sum(counts[x] > 0 for x in ts), n, sum(log10((counts[x] + 1) / (n + v + 1)) for x in ts)) for d, ts in tokens.items()}


def quality_row(text):
    t = text or ""
    w = SPACED.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed


def contamination_row(text, items):
    w = words(text, PLAIN)
    hit, found = set(), set()
    places = {}
    for item, it in items:
        iw = words(it, PLAIN)
        n = min(10, len(iw))
        for k in range(len(iw) - n + 1) if n else ():
            x = tuple(iw[k : k + n])
            if (n, x) not in places:
                places[n, x] = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) == x]
            for i in places[n, x]:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)
