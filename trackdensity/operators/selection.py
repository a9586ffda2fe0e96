"""Order statistics by group without sorting: brackets around a rank, narrowed by grouped counts.

F.percentile and F.median hold every distinct value of a group in one task. Here each wanted rank
of each group has a bracket of values that surely holds it. A round sketches the values inside
each bracket (a fixed number of them a bracket, merged like any partial aggregate), takes the two
sketch points around the rank as the next bracket, and counts exactly what lies below and inside.
Rounds end when a bracket is one value, or holds `most` rows or fewer, which are then ranked in a
window of their group and rank. A round reads the rows that are inside a bracket only, so all
after the first are small; jobs depend on the logarithm of the rows, not on groups or ranks.
Values meet their brackets where they lie: up to HELD brackets (one for each group and rank) are
broadcast, so no task is sent all values of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

MOST = 250_000  # rows of a bracket that one task may rank
STEPS = 256  # sketch points of a bracket
ACCURACY = 16 * STEPS  # a sketch point is off by a sixteenth of a step at most
HELD = 100_000  # brackets that are broadcast; where there are more, values are shuffled by group


def _same(by: list[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def _held(brackets: DataFrame, n: int) -> DataFrame:
    """The n rows of a table of brackets as the small side of a join. The planner doesn't know its size, as it is an aggregate."""
    return F.broadcast(brackets) if n <= HELD else brackets


def _inside(values: DataFrame, brackets: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, _q, _v of each value in each bracket of its group. The bracket table has a row for each group and rank."""
    spans = _held(brackets.groupBy(*by).agg(F.collect_list(F.struct("_q", "_lo", "_hi")).alias("_b")), n)
    met = values.alias("a").join(spans.alias("b"), _same(by, "a", "b")) if by else values.crossJoin(F.broadcast(spans))
    own = F.filter("_b", lambda x: (F.col("_v") >= x["_lo"]) & (F.col("_v") <= x["_hi"]))
    return met.select(*[F.col(f"a.{c}") for c in by], "_v", F.explode(F.transform(own, lambda x: x["_q"])).alias("_q"))


def ranked_values(df: DataFrame, value: Column, by: list[str], ranks: dict[str, Column], most: int | None = None) -> DataFrame:
    """by, _q (name of the rank), _k (the rank, 0-based, least first) and _v, the exact value at it.

    ranks: for each name a rank as a Column of _n, the number of values of the group. Null and NaN
    values are left out; ranks outside 0 .. _n - 1 give no row. A null group is one like any other.
    """
    most = MOST if most is None else most
    values = df.select(*by, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).filter("_n > 0")
    wanted = F.explode(F.array(*[F.struct(F.lit(q).alias("_q"), k.cast("long").alias("_k")) for q, k in ranks.items()]))
    start = sizes.withColumn("_w", wanted).select(*by, "_w._q", "_w._k", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_n").filter("_k >= 0 and _k < _n")
    open_ = saved(start, "brackets")
    closed, rows = None, values
    while True:
        settled = open_.filter(F.col("_lo") == F.col("_hi")).select(*by, "_q", "_k", F.col("_lo").alias("_v"))
        closed = settled if closed is None else closed.unionByName(settled)
        open_ = open_.filter(F.col("_lo") < F.col("_hi"))
        largest, n = open_.agg(F.max("_n"), F.count(F.lit(1))).first()
        if not largest:
            return closed
        # what is inside some bracket; a value in the brackets of several ranks is kept once for each
        rows = _inside(rows.select(*by, "_v"), open_, by, n) if rows is values else rows.alias("a").join(_held(open_, n).alias("b"), _same(by, "a", "b") & (F.col("a._q") == F.col("b._q")) & F.col("a._v").between(F.col("b._lo"), F.col("b._hi"))).select("a.*")
        if largest <= most:
            order = Window.partitionBy(*by, "_q").orderBy("_v")
            at = rows.withColumn("_r", F.row_number().over(order) - 1).alias("a")
            last = at.join(_held(open_, n).alias("b"), _same(by, "a", "b") & (F.col("a._q") == F.col("b._q")) & (F.col("a._r") == F.col("b._k") - F.col("b._below")))
            return closed.unionByName(last.select(*[F.col(f"a.{c}") for c in by], "a._q", "b._k", "a._v"))
        rows = saved(rows.select(*by, "_q", "_v"), "inside")
        open_ = saved(_narrowed(rows, open_, by, n), "brackets")


def _narrowed(rows: DataFrame, brackets: DataFrame, by: list[str], n: int) -> DataFrame:
    """The brackets between the sketch points around each rank, with exact counts below and inside."""
    points = F.percentile_approx("_v", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), F.lit(ACCURACY))
    sketch = rows.groupBy(*by, "_q").agg(points.alias("_p"))
    on = _same(by, "a", "b") & (F.col("a._q") == F.col("b._q"))
    step = F.floor((F.col("_k") - F.col("_below")) * STEPS / F.col("_n"))
    at = lambda i: F.element_at("_p", F.greatest(F.lit(1), F.least(F.lit(STEPS + 1), i)).cast("int"))
    # the rank lies between the points a step and an error away; the ends of the old bracket hold always
    near = sketch.alias("a").join(brackets.alias("b"), on).select(*[F.col(f"b.{c}") for c in by], "b._q", "_k", "_below", F.when(step < 2, F.col("_lo")).otherwise(at(step)).alias("_lo"), F.when(step > STEPS - 4, F.col("_hi")).otherwise(at(step + 4)).alias("_hi"))
    near = _held(near, n).alias("b")
    under = F.sum((F.col("a._v") < F.col("b._lo")).cast("long"))
    inside = F.sum(F.col("a._v").between(F.col("b._lo"), F.col("b._hi")).cast("long"))
    edge = F.sum((F.col("a._v") == F.col("b._lo")).cast("long"))
    top = F.sum((F.col("a._v") < F.col("b._hi")).cast("long"))
    keys = [F.col(f"b.{c}") for c in by]
    found = rows.alias("a").join(near, on).groupBy(*keys, "b._q", "b._k", "b._below", "b._lo", "b._hi").agg(under.alias("_u"), inside.alias("_i"), edge.alias("_e"), top.alias("_t"))
    rank = F.col("_k") - F.col("_below")
    # one value may hold the rank by itself, whatever else is in the bracket
    low, high = rank < F.col("_u") + F.col("_e"), rank >= F.col("_t")
    return found.select(
        *by, "_q", "_k", F.when(high, F.col("_hi")).otherwise(F.col("_lo")).alias("_lo"), F.when(low, F.col("_lo")).otherwise(F.col("_hi")).alias("_hi"),
        (F.col("_below") + F.when(high, F.col("_t")).otherwise(F.col("_u"))).alias("_below"), F.when(low, F.col("_e")).when(high, F.col("_u") + F.col("_i") - F.col("_t")).otherwise(F.col("_i")).alias("_n"),
    )


def quantiles(df: DataFrame, value: Column, by: list[str], named: dict[str, float], most: int | None = None) -> DataFrame:
    """by and a column for each name: the exact quantile, between two values in proportion, as F.percentile has it."""
    n1 = (F.col("_n") - 1).cast("double")
    ranks = {f"{q}:{side}": f(n1 * p) for q, p in named.items() for side, f in (("a", F.floor), ("b", F.ceil))}
    found = ranked_values(df, value, by, ranks, most).withColumn("_name", F.split("_q", ":")[0]).withColumn("_side", F.split("_q", ":")[1])
    sizes = df.select(*by, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    pick = lambda q, side: F.max(F.when((F.col("_name") == q) & (F.col("_side") == side), F.col("_v"))).alias(f"{q}:{side}")
    wide = found.groupBy(*by).agg(*[pick(q, s) for q in named for s in "ab"])
    wide = sizes.alias("a").join(wide.alias("b"), _same(by, "a", "b")).select(*[F.col(f"a.{c}") for c in by], "_n", *[F.col(f"b.`{q}:{s}`").alias(f"{q}:{s}") for q in named for s in "ab"]) if by else sizes.crossJoin(F.broadcast(wide))

    def between(q: str, p: float) -> Column:
        a, b = F.col(f"`{q}:a`"), F.col(f"`{q}:b`")
        part = n1 * p - F.floor(n1 * p)
        return F.when(a == b, a).otherwise(a * (1 - part) + b * part).alias(q)

    return wide.select(*by, *[between(q, p) for q, p in named.items()])


def largest_mean(df: DataFrame, value: Column, by: list[str], share: float, most: int | None = None) -> DataFrame:
    """by, top: the mean of the max(1, ceil(share n)) largest values of each group, without ranking them.

    The value t at that rank is selected; what is above it is summed in one pass, and t stands in for
    as many of its ties as are missing.
    """
    k = F.greatest(F.lit(1), F.ceil(F.round(F.col("_n") * F.lit(share), 9))).cast("long")
    cut = ranked_values(df, value, by, {"t": F.col("_n") - k}, most).select(*by, F.col("_v").alias("_t"), F.col("_k").alias("_rank"))
    values = df.select(*by, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if by:
        cut = saved(cut, "cuts")
    met = values.alias("a").join(_held(cut, cut.count()).alias("b"), _same(by, "a", "b")) if by else values.crossJoin(F.broadcast(cut))
    above = F.col("_v") > F.col("_t")
    sums = met.groupBy(*[F.col(f"a.{c}") for c in by], "_t", "_rank").agg(F.sum(F.when(above, F.col("_v"))).alias("_s"), F.sum(above.cast("long")).alias("_a"), F.count(F.lit(1)).alias("_n"))
    taken = F.col("_n") - F.col("_rank")
    total = F.coalesce("_s", F.lit(0.0)) + (taken - F.col("_a")) * F.col("_t")
    return sums.select(*by, (total / taken).alias("top"))

