"""Places of regular-expression matches as array columns, by built-in functions only.

``regexp_extract_all`` gives the leftmost non-overlapping matches and ``split`` the texts between them; running sums of
their lengths are the places, in code points, from 0, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, maybe: Column | None = None) -> Column:
    """start, end and value of every match; ``maybe`` is a cheap condition that each text with a match meets."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(values)), values, lambda g, v: F.struct(F.char_length(g).alias("gap"), v.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + x["gap"]
        last = first + F.char_length(x["value"])
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(F.struct(first.alias("start"), last.alias("end"), x["value"].alias("value")))).alias("out"))

    found = text.rlike(pattern)
    return F.when(found if maybe is None else maybe & found, F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end of spans with (start, ord, end, kind), by start and then order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def tagged(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def overlapping(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def constant_doubles(values: list[float]) -> Column:
    """A constant array given as one literal; the optimizer folds it."""
    return F.split(F.lit(",".join(f"{v:.6f}" for v in values)), ",").cast("array<double>")
