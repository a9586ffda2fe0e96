"""Rolling-origin backtests over the fold plan: one plan for all folds, or chains of boosted models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import boosting, summaries


def rolling_shift(rows: DataFrame, horizon: int, retrain: bool, history: int = 5) -> DataFrame:
    """rows (time, obs, ref) of every fold's forecast days with fold and pred; overlapping forecasts are kept.

    With retrain, pred is ref shifted by the mean log residual of the fold's training days, else ref.
    """
    days = rows.withColumn("day", F.to_date("time"))
    plan = summaries.fold_plan(days.select("day").distinct(), horizon, history)
    ahead = days.join(plan.filter("role = 'forecast'").select("day", "fold"), "day")
    if not retrain:
        return ahead.withColumn("pred", F.col("ref"))
    # a day's sums serve all folds it is in
    daily = days.select("day", C.log_ratio(F.col("obs"), F.col("ref")).alias("y")).groupBy("day").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    fitted = plan.filter("role = 'train'").join(daily, "day").groupBy("fold").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("shift"))
    return ahead.join(fitted, "fold", "left").withColumn("pred", F.col("ref") * F.exp(F.coalesce("shift", F.lit(0.0)))).drop("shift")


def rolling_boost(rows: DataFrame, label: str, horizon: int, loss, rate, rounds: int, start: boosting.Stages, history: int = 5, folds: list[int] | None = None, snapshots: str | None = None, **kwargs) -> DataFrame:
    """Forecasts of every fold by a chain of warm-started models, which begins anew from `start` with each segment.

    rows: time, features, label. Each fold trains on its days (the last of them as the eval set) and
    forecasts its horizon: fold, prediction and the columns of rows. snapshots: a folder for each fold's model.
    """
    days = rows.withColumn("day", F.to_date("time"))
    plan = summaries.fold_plan(days.select("day").distinct(), horizon, history)
    found, model, segment = None, start, None
    by_fold: dict[int, list] = {}
    for r in plan.orderBy("fold", "day").collect():  # a row for each day of a fold
        by_fold.setdefault(r["fold"], []).append(r)
    for fold, parts in sorted(by_fold.items()):
        if folds is not None and fold not in folds:
            continue
        if parts[0]["segment"] != segment:
            model, segment = start, parts[0]["segment"]
        train, ahead = ([p["day"] for p in parts if p["role"] == k] for k in ("train", "forecast"))
        own = days.filter(F.col("day").isin(train))
        model, _ = boosting.newton_boost(own.filter(F.col("day") != train[-1]), own.filter(F.col("day") == train[-1]), label, loss, rate, rounds, start=model, **kwargs)
        if snapshots:
            model.save(rows.sparkSession, f"{snapshots}/fold-{fold}")
        one = model.score(days.filter(F.col("day").isin(ahead))).withColumn("fold", F.lit(fold)).drop("day")
        found = one if found is None else found.unionByName(one)
    return found
