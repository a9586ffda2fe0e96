import numpy as np
import pytest
from pyspark.sql import functions as F

from trackdensity.operators import selection, summaries, tables

QUANTILES = {"p0": 0.0, "p05": 0.05, "p5": 0.5, "p95": 0.95, "p1": 1.0}


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(1)
    wide = lambda n: rng.normal(size=n) * 10.0 ** rng.integers(-15, 15, size=n)
    tied = np.r_[np.ones(1100), wide(900)]  # one value is held by more than half of the rows
    return {"wide": wide(3000), "one": wide(1), "tied": tied, None: wide(700), "two": np.r_[np.zeros(750), np.ones(750)]}


@pytest.fixture(scope="module")
def rows(spark, groups):
    values = [(g, float(x)) for g, v in groups.items() for x in v] + [("wide", None), ("wide", float("nan")), ("empty", None)]
    return spark.createDataFrame(values, "g string, v double").repartition(5).cache()


@pytest.mark.parametrize("most", [100_000, 25])
def test_quantiles_and_largest_means(rows, groups, most):
    got = {r.g: r for r in selection.quantiles(rows, F.col("v"), ["g"], QUANTILES, most).collect()}
    assert got.keys() == groups.keys()
    top = {r.g: r.top for r in selection.largest_mean(rows, F.col("v"), ["g"], 0.05, most).collect()}
    for g, x in groups.items():
        for q, p in QUANTILES.items():
            assert np.isclose(got[g][q], np.quantile(x, p), rtol=1e-12, atol=0), (g, q)
        k = max(1, int(np.ceil(round(0.05 * len(x), 9))))
        assert np.isclose(top[g], np.sort(x)[::-1][:k].mean()), g
    every = np.concatenate(list(groups.values()))
    assert np.isclose(selection.quantiles(rows, F.col("v"), [], {"m": 0.5}, most).first().m, np.median(every), rtol=1e-12)


def test_brackets_get_small(rows, monkeypatch):
    """No task's state is above the bracket: what is ranked in a window holds `most` rows of a group and rank at most."""
    seen = []
    narrowed = selection._narrowed
    monkeypatch.setattr(selection, "_narrowed", lambda *a: seen.append(a[0].count()) or narrowed(*a))
    selection.quantiles(rows, F.col("v"), ["g"], {"m": 0.5}, 25).collect()
    assert len(seen) <= 3 and all(b < a / 5 for a, b in zip(seen, seen[1:], strict=False))


def test_nothing_to_select(rows):
    none = rows.limit(0)
    assert selection.quantiles(none, F.col("v"), ["g"], QUANTILES).count() == 0
    assert summaries.top_share(none, F.col("v")).first().top5 is None


def test_bands_and_columns(spark):
    df = spark.createDataFrame([(-90.0, 1.0), (-80.0, 3.0), (-79.0, None), (5.0, 7.0), (None, 2.0)], "lat double, x double")
    assert {(r.band, r.median, r.n) for r in summaries.lat_bands(df, F.col("x")).collect()} == {(-85.0, 2.0, 2), (-75.0, None, 1), (5.0, 7.0, 1), (None, 2.0, 1)}
    r = summaries.column_quantiles(df, {"a": F.col("lat"), "b": F.col("x")}, {"lo": 0.0, "mid": 0.5}).first()
    assert (r.a_lo, r.a_mid, r.b_lo, r.b_mid) == (-90.0, -79.5, 1.0, 2.5)


def test_values_are_not_shuffled_to_their_brackets(spark, rows, monkeypatch):
    """Where the planner can't know that the brackets are few, a task was sent all values of a group and sorted them (F16)."""
    monkeypatch.setattr(selection, "saved", lambda d, _: plans.append(d._jdf.queryExecution().toString()) or saved(d, _))
    plans, saved = [], tables.saved
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (selection.quantiles(rows, F.col("v"), ["g"], {"m": 0.5}, 25), selection.largest_mean(rows, F.col("v"), ["g"], 0.05, 25)):
            physical = [p.split("== Physical Plan ==")[1] for p in plans if "approx_percentile" in p or "percentile_approx" in p]
            assert physical and all("BroadcastHashJoin" in p and p.count("SortMergeJoin") <= 1 for p in physical)  # one: sketches with brackets
            assert found.count() == 5
            if "top" in found.columns:
                assert "SortMergeJoin" not in found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
