"""Personal data: base patterns, and candidates judged by gradient-boosted trees.

Generators propose overlapping spans with high recall. Each span gets format and context features, boosted trees of depth
two score it, and spans over a calibrated threshold are redacted beside the base ones. The trees are fitted on the driver to a
bounded sample: candidates of about ``SAMPLE_DOCS`` documents, by hash, ``SAMPLE_ROWS`` at most, labelled by whether a valid base span covers
them, and forms of personal data that the base patterns cannot see, made from the base spans of the sample and what stands before them: mail
addresses with (at) and (dot), telephone numbers without the plus, account numbers. The threshold is the lowest that reaches
``PRECISION`` on the quarter of the sample held out. The fitted trees become CASE expressions, so the scan itself is one pass of
built-in functions without a shuffle.

Cases: a null text is empty; repeated rows give repeated rows; an empty table gives none. Spans of the trees never overlap
base spans. Very long runs of digits are matched without recursion.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.secret_scan import sample_of
from strandlake.llm.spans import joined, matches, overlapping, tagged

# fixed values: the base patterns, with possessive quantifiers where that changes nothing but the time
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: The generators' patterns, wider than the base ones.
GENERATORS = (
    r"[0-9(+][0-9\x20()./-]{6,60}[0-9]",
    r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,24}",
    r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?\b",
)
CONTEXT = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|card|visa|account|iban|address|\bip\b|reach)"
SAMPLE_DOCS, SAMPLE_ROWS, MADE_ROWS, ROUNDS, RATE, PRECISION = 20_000, 4_000, 600, 24, 0.3, 0.95
FEATURES = ("digits", "length", "separators", "letters", "plus", "at", "parens", "groups", "context", "colon", "luhn", "marked", "account", "zero")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value with at most 19 of them pass the Luhn test; longer ones do not."""
    d = F.reverse(digits_of(value))
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    digit = lambda i: F.ascii(F.substring(d, i, F.lit(1))) - 48
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return F.when(F.char_length(d).between(1, 19), total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> dict[str, Column]:
    stripped = lambda p: F.regexp_replace(p, "^0+", "")
    part_ok = lambda p: F.when(F.char_length(stripped(p)) <= 3, F.concat(F.lit("0"), stripped(p)).cast("int") <= 255).otherwise(F.lit(False))
    n = lambda s: F.char_length(digits_of(s["value"]))
    return {
        "email": matches(text, EMAIL, text.contains("@")),
        "ip": F.filter(matches(text, IP, text.contains(".")), lambda s: F.forall(F.split(s["value"], r"\."), part_ok)),
        "card": F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda s: n(s).between(12, 19) & luhn(s["value"])),
        "phone": F.filter(matches(text, PHONE, text.contains("+")), lambda s: n(s).between(9, 15)),
    }


def candidates(text: Column, base: Column) -> Column:
    """The generators' spans with their features; ``covered``: a base span overlaps."""
    spans = F.concat(*(matches(text, g) for g in GENERATORS))

    def described(s: Column) -> Column:
        v = s["value"]
        count = lambda pattern: (F.char_length(v) - F.char_length(F.regexp_replace(v, pattern, ""))).cast("double")
        before = F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(s["start"], F.lit(24)))
        values = {
            "digits": count("[0-9]"), "length": F.char_length(v).cast("double"), "separators": count(r"[\x20./-]"), "letters": count("[A-Za-z]"),
            "plus": v.startswith("+").cast("double"), "at": v.rlike(r"@|\(at\)|\[at\]").cast("double"), "parens": count("[()]"), "groups": F.size(F.split(v, "[^0-9]+")).cast("double"),
            "context": before.rlike(CONTEXT).cast("double"), "colon": before.rlike(r"[:=]\x20?$").cast("double"), "marked": v.rlike(r"[(\[](?:at|dot)[)\]]").cast("double"), "account": v.rlike("^[A-Z]{2}[0-9]{2}").cast("double"), "zero": v.rlike(r"^\(?0").cast("double"), "luhn": (luhn(v) & (F.char_length(digits_of(v)) >= 12)).cast("double"),
        }
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), overlapping(s, base).alias("covered"), *(values[k].alias(k) for k in FEATURES))

    return F.transform(spans, described)


@dataclass(frozen=True)
class Tree:
    """feature < cut sends to the left; each side has one more split or a constant."""

    feature: int
    cut: float
    left: Tree | float
    right: Tree | float


def score_column(tree: Tree | float, s: Column) -> Column:
    if not isinstance(tree, Tree):
        return F.lit(float(tree))
    return F.when(s[FEATURES[tree.feature]] < tree.cut, score_column(tree.left, s)).otherwise(score_column(tree.right, s))


def score_value(tree: Tree | float, x: list[float]) -> float:
    while isinstance(tree, Tree):
        tree = tree.left if x[tree.feature] < tree.cut else tree.right
    return tree


def fit_tree(xs: list[list[float]], gradient: list[float], weight: list[float], rows: list[int], depth: int) -> Tree | float:
    g, h = sum(gradient[i] for i in rows), sum(weight[i] for i in rows)
    leaf = RATE * g / (h + 1)
    if depth == 0 or len(rows) < 10:
        return leaf
    best, found = g * g / (h + 1) + 1e-6, None
    for f in range(len(FEATURES)):
        order = sorted(rows, key=lambda i: xs[i][f])
        gl = hl = 0.0
        for here, after in zip(order, order[1:], strict=False):
            gl, hl = gl + gradient[here], hl + weight[here]
            if xs[here][f] < xs[after][f] and (gain := gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1)) > best:
                best, found = gain, (f, (xs[here][f] + xs[after][f]) / 2)
    if not found:
        return leaf
    f, cut = found
    return Tree(f, cut, *(fit_tree(xs, gradient, weight, [i for i in rows if (xs[i][f] < cut) == side], depth - 1) for side in (True, False)))


@dataclass(frozen=True)
class Model:
    prior: float
    trees: tuple[Tree | float, ...]
    threshold: float

    def score(self, s: Column) -> Column:
        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + score_column(tree, s)
        return total


def fit(xs: list[list[float]], ys: list[int]) -> Model:
    """Boosted trees for the log odds on three rows of four; the threshold is calibrated on the rest."""
    learn, test = [i for i in range(len(ys)) if i % 4], [i for i in range(len(ys)) if i % 4 == 0]
    positive = sum(ys[i] for i in learn)
    if not positive or positive == len(learn):
        return Model(0.0, (), math.inf)
    prior = math.log(positive / (len(learn) - positive))
    odds, trees = [prior] * len(ys), []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-o)) for o in odds]
        trees.append(tree := fit_tree(xs, [y - q for y, q in zip(ys, p, strict=True)], [q * (1 - q) for q in p], learn, 2))
        odds = [o + score_value(tree, x) for o, x in zip(odds, xs, strict=True)]
    threshold, hits = math.inf, 0
    for n, i in enumerate(sorted(test, key=lambda i: -odds[i]), 1):
        hits += ys[i]
        if hits >= PRECISION * n:
            threshold = odds[i]
    return Model(prior, tuple(trees), max(threshold, 0.0))


def _found(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("_t"))
    found = found.select("doc_id", "_t", *(c.alias(k) for k, c in base_spans(F.col("_t")).items()))
    base = F.concat(*(tagged(F.col(k), k, i) for i, k in enumerate(KINDS)))
    return found.select("doc_id", "_t", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base"))


def account_number(country: str, digits: str) -> str:
    """With the check digits of the international standard."""
    rest = digits + "".join(str(ord(c) - 55) for c in country) + "00"
    return f"{country}{98 - int(rest) % 97:02d}{digits}"


def made_texts(found: list[tuple[str, str, str]], seed: int = 5) -> list[tuple[str, str, str]]:
    """(before, value, after) in forms that the base patterns do not see, from (kind, before, value) of base spans."""
    rng = random.Random(seed)
    leads = {"email": ["mail ", "contact: ", "reach me at "], "phone": ["call ", "tel. ", "phone: ", "fax "], "account": ["account ", "IBAN: ", "pay to "]}
    out = []
    for kind, before, value in found:
        if kind == "email":
            at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", ".")])
            name, host = value.split("@", 1)
            form = name + at + host.replace(".", dot)
        elif kind == "phone":
            digits = re.sub("[^0-9]", "", value)
            gap = rng.choice([" ", "-", "/"])
            form = rng.choice(["0", "00"]) + digits[:3] + gap + digits[3:6] + gap + digits[6:]
        else:
            digits = "".join(rng.choices("0123456789", k=rng.choice([16, 18, 20])))
            form = account_number(rng.choice(["DE", "FR", "ES", "GB"]), digits)
            if rng.random() < 0.5:
                form = " ".join(form[k : k + 4] for k in range(0, len(form), 4))
            kind = "account"
        lead = before if rng.random() < 0.5 else before[:8] + " " + rng.choice(leads[kind])
        out.append((lead, form, rng.choice([".", " ", ", and", "\n"])))
    return out


def _sample(docs: DataFrame) -> DataFrame:
    return _found(sample_of(docs.select("doc_id", F.col("text").cast("string").alias("text")), SAMPLE_DOCS))


def train(docs: DataFrame) -> Model:
    features = lambda c: [*(F.col(f"{c}.{k}") for k in FEATURES)]
    sample = _sample(docs)
    rows = sample.select("doc_id", F.explode(candidates(F.col("_t"), F.col("base"))).alias("c"))
    rows = rows.orderBy(F.xxhash64("doc_id", "c.start", "c.end"), "doc_id", "c.start").limit(SAMPLE_ROWS).select(*features("c"), "c.covered").collect()
    xs, ys = [[float(r[k]) for k in FEATURES] for r in rows], [int(r["covered"]) for r in rows]
    spans = sample.select("doc_id", "_t", F.explode("base").alias("s")).select("doc_id", "s.kind", F.substring("_t", F.greatest(F.lit(1), F.col("s.start") - 23), F.least(F.col("s.start"), F.lit(24))).alias("before"), F.substring("_t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))
    found = spans.orderBy(F.xxhash64("doc_id", "value"), "doc_id", "value").limit(MADE_ROWS).collect()
    made = made_texts([(r["kind"], r["before"], r["value"]) for r in found])
    if made:
        texts = docs.sparkSession.createDataFrame([(i, a + v + z, len(a), len(a) + len(v)) for i, (a, v, z) in enumerate(made)], "i int, _t string, s int, e int")
        none = F.array().cast("array<struct<start:int,end:int>>")
        some = texts.select("i", "s", "e", F.explode(candidates(F.col("_t"), none)).alias("c")).where("c.start >= s - 2 and c.end <= e + 1 and c.end - c.start >= 0.8 * (e - s)")
        for r in some.orderBy("i", "c.start").select(*features("c")).collect():
            xs.append([float(r[k]) for k in FEATURES])
            ys.append(1)
    return fit(xs, ys)


def personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the number of spans of each base kind, ``base`` and ``spans`` (arrays of start, ord, end, kind)."""
    found = _found(docs)
    if math.isinf(model.threshold):
        return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base", F.col("base").alias("spans"))
    other = F.filter(candidates(F.col("_t"), F.col("base")), lambda s: ~s["covered"] & (model.score(s) >= model.threshold))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base", F.concat("base", F.array_distinct(tagged(other, "other", len(KINDS)))).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """The text with all its spans replaced; overlapping spans become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(F.array_sort(spans), start, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.char_length(text))))


def op9_pii(docs: DataFrame) -> DataFrame:
    found = personal_data(docs, train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
