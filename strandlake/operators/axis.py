"""Steps, runs, unions and moving sums along an axis, such as the places of a contig, that is longer than one task should walk.

An axis is cut into ranges of ``SPAN`` places. Sums and maxima inside a range are a window over it; what is carried into a range
comes from the totals of those before, of which a key has one for ``SPAN`` places. Rows have distinct places a key, so no
task gets more than ``SPAN`` of them, however long a contig is or however many reads it has. Rows with a null key or place are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 16
#: Parts into which the windows of a bin are dealt for features of all contigs.
SLOTS = 16
_FOLD = {"sum": F.sum, "max": F.max}


def running(rows: DataFrame, keys: tuple[str, ...], at: str, upto: dict[str, tuple[str, str]] | None = None, before: dict[str, tuple[str, str]] | None = None, following: str = "", span: int = SPAN) -> DataFrame:
    """``rows`` with running folds along ``at``, which is distinct a key, and the next row's ``at`` as ``following``.

    ``upto`` and ``before`` name a fold ("sum" or "max") and a column each: over the rows up to and with each one, or those before it.
    """
    upto, before = upto or {}, before or {}
    wanted = upto | before
    cut = rows.where(F.col(at).isNotNull()).withColumn("_part", F.floor(F.col(at) / span))
    totals = cut.groupBy(*keys, "_part").agg(F.min(at).alias("_first"), *(_FOLD[fold](c).alias(f"_all_{n}") for n, (fold, c) in wanted.items()))
    along = Window.partitionBy(*keys).orderBy("_part")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_part", F.lead("_first").over(along).alias("_next"), *(_FOLD[fold](f"_all_{n}").over(earlier).alias(f"_till_{n}") for n, (fold, _) in wanted.items()))
    inside = Window.partitionBy(*keys, "_part").orderBy(at)

    def folded(name: str, last: int) -> Column:
        fold, c = wanted[name]
        here = _FOLD[fold](c).over(inside.rowsBetween(Window.unboundedPreceding, last))
        return F.greatest(F.col(f"_till_{name}"), here) if fold == "max" else F.coalesce(f"_till_{name}", F.lit(0)) + F.coalesce(here, F.lit(0))

    out = cut.join(carried, [*keys, "_part"])
    more = [folded(n, 0).alias(n) for n in upto] + [folded(n, -1).alias(n) for n in before]
    if following:
        more.append(F.coalesce(F.lead(at).over(inside), F.col("_next")).alias(following))
    return out.select(*rows.columns, *more)


def steps(rows: DataFrame, keys: tuple[str, ...], weights: dict[str, Column]) -> DataFrame:
    """keys, pos and the changes of each weight there, of intervals start0 to end0; places where nothing changes are left out."""
    first = F.struct(F.col("start0").alias("pos"), *(w.alias(n) for n, w in weights.items()))
    last = F.struct(F.col("end0").alias("pos"), *((-w).alias(n) for n, w in weights.items()))
    changes = rows.select(*keys, F.explode(F.array(first, last)).alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(*(F.sum(f"e.{n}").alias(n) for n in weights))
    some = F.lit(False)
    for n in weights:
        some = some | (F.col(n) != 0)
    return changes.where(some)


def levels(changes: DataFrame, keys: tuple[str, ...], names: tuple[str, ...], span: int = SPAN) -> DataFrame:
    """keys, pos, stop and what each of ``names`` sums up to from pos on, up to stop (null behind the last change)."""
    renamed = changes.select(*keys, "pos", *(F.col(n).alias(f"_d_{n}") for n in names))
    return running(renamed, keys, "pos", {n: ("sum", f"_d_{n}") for n in names}, following="stop", span=span).select(*keys, "pos", "stop", *names)


def runs(rows: DataFrame, keys: tuple[str, ...], weights: dict[str, Column], span: int = SPAN) -> DataFrame:
    """keys, start0, end0 and the sum of each weight of the intervals that lie there, where one is not zero."""
    some = F.lit(False)
    for n in weights:
        some = some | (F.col(n) != 0)
    found = levels(steps(rows, keys, weights), keys, tuple(weights), span).where(F.col("stop").isNotNull() & some)
    return found.select(*keys, F.col("pos").alias("start0"), F.col("stop").alias("end0"), *weights)


def union_of(rows: DataFrame, keys: tuple[str, ...], span: int = SPAN) -> DataFrame:
    """keys, start0, end0: the unions of intervals that overlap or touch."""
    longest = rows.groupBy(*keys, "start0").agg(F.max("end0").alias("end0"))
    seen = running(longest, keys, "start0", before={"_reach": ("max", "end0")}, span=span)
    heads = seen.withColumn("_head", F.when(F.coalesce(F.col("start0") > F.col("_reach"), F.lit(True)), F.col("start0")))
    owned = running(heads, keys, "start0", {"_block": ("max", "_head")}, span=span)
    return owned.groupBy(*keys, "_block").agg(F.max("end0").alias("end0")).select(*keys, F.col("_block").alias("start0"), "end0")


def moving_sums(changes: DataFrame, keys: tuple[str, ...], names: tuple[str, ...], window: int, length: Column, span: int = SPAN) -> DataFrame:
    """Sums over ``window`` places around each (``window // 2`` before), zero outside, as pieces on which they change evenly.

    changes: the ``steps`` of a function. The result has keys, start0, end0 and for each name its sum at start0 (``name``) and what it
    gains a place (``name_slope``). Its slope is a step function too, so nothing is enumerated a place. Pieces lie within
    0 to ``length``, a column; those that are zero throughout are left out.
    """
    left = window // 2
    right = window - left - 1
    turn = F.array(
        F.struct((F.col("pos") - right).alias("pos"), *(F.col(n).alias(n) for n in names)),
        F.struct((F.col("pos") + left + 1).alias("pos"), *((-F.col(n)).alias(n) for n in names)),
    )
    turns = changes.select(*keys, F.explode(turn).alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(*(F.sum(f"e.{n}").alias(n) for n in names))
    sloped = levels(turns, keys, names, span).where(F.col("stop").isNotNull())
    rise = sloped.select(*keys, "pos", "stop", *(F.col(n).alias(f"{n}_slope") for n in names), *((F.col(n) * (F.col("stop") - F.col("pos"))).alias(f"_rise_{n}") for n in names))
    summed = running(rise, keys, "pos", before={n: ("sum", f"_rise_{n}") for n in names}, span=span)
    first, last = F.greatest(F.lit(0), F.col("pos")), F.least(length, F.col("stop"))
    pieces = summed.withColumn("start0", first).withColumn("end0", last).where("end0 > start0")
    some = F.lit(False)
    for n in names:
        some = some | (F.col(n) != 0) | (F.col(f"{n}_slope") != 0)
    at_start = [(F.col(n) + F.col(f"{n}_slope") * (F.col("start0") - F.col("pos") + 1)).alias(n) for n in names]
    return pieces.where(some).select(*keys, "start0", "end0", *at_start, *(f"{n}_slope" for n in names))


def even_sum(first: Column, slope: Column, n: Column) -> Column:
    """first + (first + slope) + ... of n terms."""
    return first * n + slope * (n * (n - 1)) / 2


def least_sum(a: Column, a_slope: Column, b: Column, b_slope: Column, n: Column) -> Column:
    """The sum of the lesser of two evenly changing values over n places."""
    gap, growth = a - b, a_slope - b_slope
    crossing = F.when(growth > 0, F.floor(-gap / growth) + 1).when(growth < 0, F.ceil(-gap / growth)).otherwise(0)
    c = F.least(n, F.greatest(F.lit(0).cast("long"), crossing.cast("long")))
    parts = lambda x, sx, y, sy: even_sum(x, sx, c) + even_sum(y + sy * c, sy, n - c)
    return F.when(growth > 0, parts(a, a_slope, b, b_slope)).when(growth < 0, parts(b, b_slope, a, a_slope)).when(gap <= 0, even_sum(a, a_slope, n)).otherwise(even_sum(b, b_slope, n))


def overlay(parts: dict[str, DataFrame], keys: tuple[str, ...], span: int = SPAN) -> DataFrame:
    """Several step functions on their common breakpoints: keys, start0, end0 and a column for each of ``parts``, 0 where it has nothing.

    Each part has intervals (keys, start0, end0, value), whose values add up where they overlap. Adjacent runs of equal values are one.
    """
    changes = None
    for name in parts:
        rows = parts[name].select(*keys, "start0", "end0", *((F.col("value") if n == name else F.lit(0.0)).cast("decimal(24,9)").alias(n) for n in parts))
        changes = rows if changes is None else changes.unionByName(rows)
    # whole numbers of 10^-9, so that what begins and ends leaves nothing
    found = runs(changes, keys, {n: F.col(n) for n in parts}, span)
    return found.select(*keys, "start0", "end0", *(F.col(n).cast("double").alias(n) for n in parts))


def overlapping(features: DataFrame, windows: DataFrame, size: int, everywhere: tuple[str, ...] = ("*", "all")) -> DataFrame:
    """Pairs of features (contig, start, end and others) and windows (contig, start0, end0 and others) that share a place.

    Features and windows meet in the bins of ``size`` places that they touch, in the first one that both do, so long ones and crowded
    contigs are split by place and each pair comes once. Features of the contigs ``everywhere`` belong to each contig that has windows.
    Columns of features are prefixed ``f_``.
    """
    named = features.select(*(F.col(c).alias(f"f_{c}") for c in features.columns)).where("f_end > f_start")
    bins = lambda first, last: F.sequence(F.floor(F.col(first) / size), F.floor((F.col(last) - 1) / size))
    left = named.withColumn("_bin", F.explode(bins("f_start", "f_end")))
    right = windows.where("end0 > start0").withColumn("_bin", F.explode(bins("start0", "end0")))
    everywhere_ = F.col("f_contig").isin(*everywhere)
    own = right.join(left.where(~everywhere_).withColumnRenamed("f_contig", "contig"), ["contig", "_bin"]).withColumn("f_contig", F.col("contig"))
    # the windows of a bin are those of all contigs: they are dealt over slots
    dealt = left.where(everywhere_).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    common = right.withColumn("_slot", F.pmod(F.xxhash64("contig"), F.lit(SLOTS)).cast("int")).join(dealt, ["_bin", "_slot"]).drop("_slot")
    both = own.unionByName(common)
    first = F.floor(F.greatest("f_start", "start0") / size)
    return both.where((F.col("f_start") < F.col("end0")) & (F.col("start0") < F.col("f_end")) & (F.col("_bin") == first)).drop("_bin")
