"""Kernel density of many columns and groups on shared grids: linear binning, then convolution of the bins.

The direct sum costs rows times points. Here a row gives its weight to the two grid nodes beside it, in
proportion, which is one grouped count; each node's weight then spreads to the nodes within REACH
bandwidths. Cost: rows, plus nodes times the kernel's width; a row of the grid is all that is joined.

For a second derivative of the kernel of at most 1 / (h^3 sqrt(2 pi)), linear binning is off by no more
than step^2 / 8 of it at each point, so by `binning_error`; the cut of the kernel adds exp(-REACH^2 / 2)
of its height at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

REACH = 6.0  # bandwidths


def binning_error(step: float, h: float) -> float:
    """Most that the binned density differs from the direct sum."""
    return step * step / 8 / (h**3 * math.sqrt(2 * math.pi)) + math.exp(-REACH * REACH / 2) / (h * math.sqrt(2 * math.pi))


def binned_kde(df: DataFrame, values: dict[str, Column], nodes: int = 520, share: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """feature, by, node, x, density: a Gaussian density of each column and group, on one grid for a column's groups.

    A grid has `nodes` places from the column's least to its largest value; the bandwidth is `share` of
    that range. Null, NaN and infinite values are left out; a column of one value has no grid and no row.
    """
    by = by or []
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("v")) for n, v in values.items()]))
    rows = df.select(*by, each.alias("c")).select("c.feature", *by, "c.v").filter(C.finite(F.col("v")))
    grids = rows.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("hi > lo").withColumn("step", (F.col("hi") - F.col("lo")) / (nodes - 1))
    # a row for each column
    placed = rows.join(F.broadcast(grids), "feature").withColumn("u", (F.col("v") - F.col("lo")) / F.col("step"))
    first = F.least(F.lit(nodes - 2), F.floor("u")).cast("int")
    placed = placed.select("feature", *by, first.alias("i"), (F.col("u") - first).alias("part"))
    sums = placed.groupBy("feature", *by, "i").agg(F.sum("part").alias("above"), F.count(F.lit(1)).alias("n"))
    ends = F.explode(F.array(F.struct(F.col("i").alias("j"), (F.col("n") - F.col("above")).alias("w")), F.struct((F.col("i") + 1).alias("j"), F.col("above").alias("w"))))
    weights = sums.select("feature", *by, ends.alias("e")).groupBy("feature", *by, F.col("e.j").alias("j")).agg(F.sum("e.w").alias("w"))
    total = rows.groupBy("feature", *by).agg(F.count(F.lit(1)).alias("total"))
    wide = math.ceil(REACH * share * (nodes - 1))
    scale = share * (nodes - 1)  # bandwidth in steps
    node = F.explode(F.sequence(F.greatest(F.lit(0), F.col("j") - wide), F.least(F.lit(nodes - 1), F.col("j") + wide)))
    spread = weights.select("feature", *by, "j", "w", node.alias("node"))
    z = (F.col("node") - F.col("j")) / F.lit(scale)
    heights = spread.groupBy("feature", *by, "node").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("s"))
    out = heights.join(F.broadcast(grids), "feature").join(F.broadcast(total), ["feature", *by])
    h = F.col("step") * scale
    return out.select("feature", *by, "node", (F.col("lo") + F.col("node") * F.col("step")).alias("x"), (F.col("s") / (F.col("total") * h * math.sqrt(2 * math.pi))).alias("density"))
