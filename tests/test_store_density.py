import numpy as np
import pytest
from pyspark.sql import functions as F

from trackdensity.operators import density, summaries
from trackdensity.sources.run_store import RunStore


def test_run_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path), "dr1_pre_h3")
    rows = spark.createDataFrame([(0.0, 5.0), (4.0, 9.0), (1.0, None)], "a double, b double")
    assert store.versions() == []
    with pytest.raises(FileNotFoundError):
        store.tables()
    params = summaries.scaler_fit(rows, ["a", "b"])
    assert store.begin().save_scaler(params).save("metrics", rows.limit(1)).commit() == 1
    back = summaries.scale(rows, store.load_scaler(), ["a", "b"])
    assert sorted(map(str, back.collect())) == sorted(map(str, summaries.scale(rows, params, ["a", "b"]).collect()))
    # a writer that is killed before its commit leaves nothing to be seen
    store.begin().save("metrics", rows)
    assert store.versions() == [1] and store.read("metrics").count() == 1
    # two writers of one tag: both stay, the later commit is the newest
    one, two = store.begin().save("metrics", rows), RunStore(spark, str(tmp_path), "dr1_pre_h3").begin().save("metrics", rows.limit(2))
    assert (two.commit(), one.commit()) == (2, 3)
    assert [store.read("metrics", v).count() for v in (1, 2, 3)] == [1, 2, 3] and store.read("metrics").count() == 3
    # a version's name that is taken is never replaced
    draft = tmp_path / "dr1_pre_h3" / "mine"
    draft.write_text("x")
    assert not store._renamed(str(draft), f"{store.base}/versions/{2:08d}") and store.read("metrics", 2).count() == 2
    with pytest.raises(ValueError):
        store.begin().save("a/b", rows)


def test_stored_stages(spark, tmp_path):
    from pyspark.ml.regression import DecisionTreeRegressor

    from trackdensity.operators import boosting

    df = boosting.assemble(spark.createDataFrame([(float(i), float(i % 3)) for i in range(30)], "a double, y double"), ["a"])
    tree = DecisionTreeRegressor(labelCol="y", maxDepth=2).fit(df)
    model = boosting.Stages(0.5, [tree], [0.1])
    store = RunStore(spark, str(tmp_path), "m")
    store.begin().save_stages(model).commit()
    pick = lambda m: [r.prediction for r in m.score(df).orderBy("a").collect()]
    assert pick(store.load_stages()) == pick(model)


def test_binned_density_is_within_its_bound_of_the_direct_sum(spark):
    rng = np.random.default_rng(1)
    a, b = np.r_[rng.normal(0, 1, 400), rng.normal(6, 0.3, 200)], rng.exponential(2.0, 600)
    side = rng.integers(0, 2, 600)
    rows = [(float(x), float(y), int(s)) for x, y, s in zip(a, b, side)] + [(None, float("nan"), 0), (float("inf"), None, 1)]
    df = spark.createDataFrame(rows, "a double, b double, side int").repartition(3)
    out = density.binned_kde(df, {"a": F.col("a"), "b": F.col("b"), "flat": F.lit(1.0)}, nodes=101, share=0.05, by=["side"]).toPandas()
    assert set(out["feature"]) == {"a", "b"} and len(out) > 350
    for name, v in (("a", a), ("b", b)):
        step, h = (v.max() - v.min()) / 100, 0.05 * (v.max() - v.min())
        for s in (0, 1):
            got = out[(out.feature == name) & (out.side == s)].set_index("node")
            x = v.min() + step * np.arange(101)
            want = np.exp(-(((x[:, None] - v[side == s]) / h) ** 2) / 2).mean(1) / (h * np.sqrt(2 * np.pi))
            mine = got["density"].reindex(range(101), fill_value=0.0).to_numpy()
            assert np.abs(mine - want).max() <= density.binning_error(step, h) and abs(mine.sum() * step - want.sum() * step) < 1e-3
