import numpy as np
from pyspark.sql import functions as F

from trackdensity.functions import columns as C
from trackdensity.operators import blocks

RATE = lambda k: 0.1 if k else 1.0


def test_rounds_are_fitted_once_and_do_not_depend_on_partitions(spark, monkeypatch):
    d = spark.range(3000).select("id", (F.col("id") * 37 % 101 / 101.0).alias("a"), (F.col("id") * 53 % 97 / 97.0).alias("b"), (F.col("id") % 4 == 0).alias("v"))
    d = d.withColumn("y", F.sin(6 * F.col("a")) + F.col("b") + F.pmod(F.xxhash64("a", "b"), F.lit(100)) / 100.0)
    jobs, sums = [], blocks._level_sums
    monkeypatch.setattr(blocks, "_level_sums", lambda *a: jobs.append(1) or sums(*a))
    monkeypatch.setattr(blocks, "BLOCK", 200)
    fit = lambda df, rounds=6, **more: blocks.boost(df, ["a", "b"], "y", F.col("v"), ["id"], blocks.squared, RATE, rounds, depth=2, min_rows=20, patience=4, **more)
    model, curve = fit(d.coalesce(1), sample=0.5, share=0.5)
    assert len(jobs) <= 2 * (len(curve) + 1)
    other, again = fit(d.repartition(5), sample=0.5, share=0.5)
    assert curve == again and all((x.f == y.f).all() and (x.v == y.v).all() for x, y in zip(model.trees, other.trees, strict=True))
    assert len(model.trees) == 1 + min(range(len(curve)), key=lambda k: curve[k][2])
    rmse = lambda m: m.score(d.filter("v")).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).alias("e")).first().e
    assert abs(rmse(model) - curve[len(model.trees) - 1][2]) < 1e-6
    assert abs(sum(model.importances().values()) - 1) < 1e-9
    # without draws the root of the first tree is the best split of all
    whole, _ = fit(d, 1)
    rows = d.filter("not v").toPandas()
    gains = {}
    for f, cuts in enumerate(whole.cuts):
        for b, cut in enumerate(cuts):
            low = rows.y[rows["ab"[f]] <= cut]
            high = rows.y[rows["ab"[f]] > cut]
            if min(len(low), len(high)) >= 20:
                gains[f, b] = low.sum() ** 2 / len(low) + high.sum() ** 2 / len(high)
    assert (whole.trees[0].f[1], whole.trees[0].b[1]) == max(gains, key=gains.get)


def test_newton_steps_are_those_of_the_columns(spark):
    g, h = C.pseudo_huber(-F.col("r"), 1.0)
    rows = spark.createDataFrame([(float(x),) for x in (-3.5, -0.2, 0.0, 0.7, 40.0)], "r double").select("r", (-g).alias("s"), h.alias("h")).collect()
    s, h = blocks.pseudo_huber(np.array([x.r for x in rows]), False)
    assert np.allclose(s, [x.s for x in rows]) and np.allclose(h, [x.h for x in rows])
