"""Operators over one global time order, without a window over all rows.

Rows are bucketed by a monotone key (a day, a block of row numbers); only the table of buckets,
one row each, has an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free


def _met(rows: DataFrame, buckets: DataFrame, bucket: str) -> DataFrame:
    """rows with the columns of the bucket table; a null bucket is one like any other."""
    return rows.join(buckets.withColumnRenamed(bucket, f"{bucket}_key"), rows[bucket].eqNullSafe(F.col(f"{bucket}_key"))).drop(f"{bucket}_key")


def row_number(df: DataFrame, bucket: Column, order: list[str], name: str = "rn") -> DataFrame:
    """0-based position in (bucket, order); a null bucket comes first."""
    b, n, off, local = free(df, "bucket", "size", "offset", "local")
    rows = df.withColumn(b, bucket)
    sizes = rows.groupBy(b).agg(F.count(F.lit(1)).alias(n))
    before = sizes.select(b, (F.sum(n).over(Window.orderBy(b)) - F.col(n)).alias(off))
    rows = rows.withColumn(local, F.row_number().over(Window.partitionBy(b).orderBy(*order)))
    return _met(rows, before, b).withColumn(name, F.col(off) + F.col(local) - 1).drop(b, local, off)


def row_lag(df: DataFrame, value: str, k: int, name: str, block: int | None = None) -> DataFrame:
    """value k rows earlier; null for the first k.

    Blocks of `block` rows (k at least) take along those of the block before, so one shuffle does.
    """
    blk, own = free(df, "block", "own")
    size = max(block or k, k)
    home = F.floor(F.col("rn") / size)
    twice = df.withColumn(blk, F.explode(F.array(home, home + 1))).withColumn(own, F.col(blk) == home)
    w = Window.partitionBy(blk).orderBy("rn")
    return twice.withColumn(name, F.lag(value, k).over(w)).filter(own).drop(blk, own)


def rolling_mean(df: DataFrame, value: Column, window: int, name: str) -> DataFrame:
    """Mean over the trailing `window` rows (fewer at the start; nulls left out), by blocks with a halo.

    Running sums of a block and its halo differ by the window's, so the work does not grow with the window.
    """
    blk, own, v, total, n = free(df, "block", "own", "v", "total", "n")
    home = F.floor(F.col("rn") / window)
    twice = df.withColumn(v, value).withColumn(blk, F.explode(F.array(home, home + 1))).withColumn(own, F.col(blk) == home)
    order = Window.partitionBy(blk).orderBy("rn")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = twice.withColumns({total: F.coalesce(F.sum(v).over(running), F.lit(0.0)), n: F.count(v).over(running)})
    inside = lambda c: F.col(c) - F.lag(c, window, 0).over(order)
    return sums.withColumn(name, F.try_divide(inside(total), inside(n))).filter(own).drop(blk, own, v, total, n)


def fill(df: DataFrame, bucket: Column, order: list[str], columns: list[str], back: bool = True) -> DataFrame:
    """Forward fill of all columns in the global order, then (back) the first value for what precedes it.

    A null bucket comes first.
    """
    b, *names = free(df, "bucket", *[f"{k}_{c}" for c in columns for k in ("last", "carry", "head")])
    last, carry, head = ({c: names[3 * i + k] for i, c in enumerate(columns)} for k in range(3))
    rows = df.withColumn(b, bucket)
    w = Window.partitionBy(b).orderBy(*order)
    lasts = rows.groupBy(b).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(last[c]) for c in columns])
    every = Window.orderBy(b)
    carried = lasts.select(b, *[F.last(last[c], True).over(every.rowsBetween(Window.unboundedPreceding, -1)).alias(carry[c]) for c in columns])
    out = _met(rows, F.broadcast(carried), b)  # one row for each bucket
    if back:
        first = rows.agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(b, *order))).alias(head[c]) for c in columns])
        out = out.crossJoin(F.broadcast(first))
    pick = lambda c: F.coalesce(F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col(carry[c]), *([F.col(head[c])] if back else []))
    return out.select(*[c for c in df.columns if c not in columns], *[pick(c).alias(c) for c in columns])


def calendar(df: DataFrame, time: str, step: str) -> DataFrame:
    """Every step from the first to the last time."""
    return df.agg(F.min(time).alias("a"), F.max(time).alias("b")).select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(time))


def densify(df: DataFrame, time: str, step: str) -> DataFrame:
    return calendar(df, time, step).join(df, time, "left")


def segments(df: DataFrame, bucket: Column, order: list[str], lon: str = "lon", jump: float = 180.0) -> DataFrame:
    """segment: counts breaks where lon jumps by more than `jump` against the row before in the global order.

    A null bucket comes first.
    """
    b, end, prev, brk, n, off = free(df, "bucket", "end", "prev", "break", "n", "offset")
    rows = df.withColumn(b, bucket)
    ends = rows.groupBy(b).agg(F.max_by(lon, F.struct(*order)).alias(end))
    before = ends.select(b, F.lag(end).over(Window.orderBy(b)).alias(prev))
    w = Window.partitionBy(b).orderBy(*order)
    jumps = F.abs(F.col(lon) - F.coalesce(F.lag(lon).over(w), prev)) > jump
    rows = _met(rows, F.broadcast(before), b).withColumn(brk, F.coalesce(jumps.cast("int"), F.lit(0)))
    sums = rows.groupBy(b).agg(F.sum(brk).alias(n))
    offsets = sums.select(b, (F.sum(n).over(Window.orderBy(b)) - F.col(n)).alias(off))
    return _met(rows, F.broadcast(offsets), b).withColumn("segment", F.col(off) + F.sum(brk).over(w)).drop(b, prev, brk, off)


def ap_history(index_3h: DataFrame) -> DataFrame:
    """Seven values: daily mean, ap now and 3, 6, 9 h before, means of 12-33 and 36-57 h before (all 8 needed)."""
    dense = densify(index_3h, "time", "3 hours").withColumn("_y", F.date_trunc("year", "time"))
    # a year has 2,928 slots; the last 19 of the year before come along
    both = dense.withColumn("_y", F.explode(F.array("_y", F.date_trunc("year", F.expr("time + interval 57 hours"))))).distinct()
    w = Window.partitionBy("_y").orderBy("time")
    mean = lambda a, b: F.when(F.count("ap").over(w.rowsBetween(a, b)) == 8, F.avg("ap").over(w.rowsBetween(a, b)))
    daily = index_3h.groupBy(F.to_date("time").alias("_d")).agg(F.avg("ap").alias("ap_daily"))
    out = both.select("time", "_y", F.col("ap").alias("ap_0h"), *[F.lag("ap", k).over(w).alias(f"ap_m{3 * k}h") for k in (1, 2, 3)], mean(-11, -4).alias("ap_avg12_33h"), mean(-19, -12).alias("ap_avg36_57h"))
    out = out.filter(F.col("_y") == F.date_trunc("year", "time")).drop("_y")
    return out.join(daily, F.to_date("time") == F.col("_d"), "left").drop("_d")


def centred_mean(daily: DataFrame, day: str, value: str, half: int, name: str) -> DataFrame:
    """Mean over days -half..half of a densified daily series."""
    dense = daily.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias(day)).join(daily, day, "left")
    span = 2 * half + 1
    n = F.datediff(F.col(day), F.lit("1970-01-01"))
    blk = F.explode(F.array_distinct(F.array(F.floor(n / span) - 1, F.floor(n / span), F.floor(n / span) + 1)))
    w = Window.partitionBy("_blk").orderBy(day).rowsBetween(-half, half)
    return dense.withColumn("_blk", blk).withColumn(name, F.avg(value).over(w)).filter(F.col("_blk") == F.floor(n / span)).drop("_blk")


def time_lag(df: DataFrame, time: str, value: str, hours: list[int]) -> DataFrame:
    """{value}_lag{h}: the value h hours earlier on a dense hourly series, by one shuffle; null where there is none."""
    (shift,) = free(df, "shift")
    moved = df.select(F.explode(F.array(*[F.lit(h) for h in hours])).alias(shift), (F.col(time) + F.make_interval(hours=F.col(shift))).alias(time), value)
    lags = moved.groupBy(time).agg(*[F.max(F.when(F.col(shift) == h, F.col(value))).alias(f"{value}_lag{h}") for h in hours])
    return df.join(lags, time, "left")


def last_days(df: DataFrame, days: int, time: str = "time") -> DataFrame:
    """Rows of the last `days` days before the latest time, that one included."""
    (latest,) = free(df, "latest")
    end = df.agg(F.max(time).alias(latest))
    return df.crossJoin(F.broadcast(end)).filter(F.col(time) >= F.col(latest) - F.make_interval(days=F.lit(days))).drop(latest)
