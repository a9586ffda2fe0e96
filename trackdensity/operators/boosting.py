"""Boosted regression: Spark's own for squared loss, stage-wise Newton steps for others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Loss = Callable[[Column], tuple[Column, Column]]


def assemble(df: DataFrame, features: list[str], expected: list[str] | None = None) -> DataFrame:
    """Rows with all features present, in fixed order, as the column `features`; another order than expected is an error."""
    if expected is not None and list(features) != list(expected):
        raise ValueError(f"features in another order than {expected}")
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def train_squared(df: DataFrame, label: str, rounds: int = 1360, depth: int = 4, min_rows: int = 300, validation: str | None = None, patience: int = 30):
    """Up to `rounds` trees; with validation, those up to the best round, found once `patience` rounds bring no better one.

    Spark's own early stop has no patience, so rounds are fitted in growing blocks and the
    validation error of each is read. Trees depend on the seed and the rows alone, hence a
    longer fit begins with the trees of a shorter one; the rows are checkpointed for that.
    """
    fit = lambda rows, n: GBTRegressor(labelCol=label, featuresCol="features", maxIter=n, maxDepth=depth, minInstancesPerNode=min_rows, subsamplingRate=0.5, featureSubsetStrategy="0.6", stepSize=0.1, seed=7).fit(rows)
    if not validation:
        return fit(df, rounds)
    rows = df.select("features", label, validation).checkpoint()
    train, valid = rows.filter(~F.col(validation)), rows.filter(validation)
    n = min(rounds, 2 * patience)
    while True:
        errors = fit(train, n).evaluateEachIteration(valid, "squared")
        best = stopping_round(errors, patience)
        if best + patience < n or n == rounds:
            return fit(train, best + 1)
        n = min(rounds, 2 * n)


def stopping_round(errors: list[float], patience: int) -> int:
    """Index of the best error before `patience` rounds in a row were no better."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best


@dataclass
class Stages:
    """A warm-startable model: base + sum of rate * tree."""

    base: float
    trees: list = field(default_factory=list)
    rates: list[float] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        df = df.withColumn(out, F.lit(self.base))
        for k, (t, r) in enumerate(zip(self.trees, self.rates, strict=True)):
            df = t.setPredictionCol(f"_t{k}").transform(df).withColumn(out, F.col(out) + r * F.col(f"_t{k}")).drop(f"_t{k}")
        return df

    def first(self, n: int) -> Stages:
        return Stages(self.base, self.trees[:n], self.rates[:n])

    def save(self, spark: SparkSession, path: str) -> None:
        """Trees under path/tree-N and, last, a manifest of the rates, so a folder with a manifest is whole."""
        for k, t in enumerate(self.trees):
            t.write().overwrite().save(f"{path}/tree-{k}")
        rows = [(-1, float(self.base)), *enumerate(map(float, self.rates))]
        spark.createDataFrame(rows, "stage int, rate double").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Stages:
        rates = dict(map(tuple, spark.read.parquet(f"{path}/manifest").collect()))  # a row for each stage
        base = rates.pop(-1)
        return cls(base, [DecisionTreeRegressionModel.load(f"{path}/tree-{k}") for k in sorted(rates)], [rates[k] for k in sorted(rates)])


def newton_boost(train: DataFrame, valid: DataFrame, label: str, loss: Loss, rate: Callable[[int], float], rounds: int, depth: int = 4, min_rows: int = 50, start: Stages | None = None, patience: int = 30) -> tuple[Stages, list[tuple[int, float, float]]]:
    """(best stages, curve of (round, train rmse, valid rmse)). Continues from `start` if given."""
    model = start or Stages(float(train.agg(F.avg(label)).first()[0] or 0.0))
    model = Stages(model.base, list(model.trees), list(model.rates))
    rmse = lambda df: float(df.agg(F.sqrt(F.avg(F.pow(F.col("_y") - F.col(label), 2)))).first()[0])
    a, b = (model.score(x, "_y").select("features", label, "_y") for x in (train, valid))
    curve, best, kept = [], float("inf"), len(model.trees)
    for k in range(rounds):
        g, h = loss(F.col("_y") - F.col(label))
        step = a.withColumn("_h", h).withColumn("_g", -g / F.col("_h"))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="_g", weightCol="_h", maxDepth=depth, minInstancesPerNode=min_rows, predictionCol="_t", seed=k).fit(step)
        r = rate(k)
        model.trees.append(tree)
        model.rates.append(r)
        add = lambda df: tree.setPredictionCol("_t").transform(df).select("features", label, (F.col("_y") + r * F.col("_t")).alias("_y"))  # noqa: B023, E731
        # written to the checkpoint folder: the lineage stays short and survives lost executors
        a, b = add(a).checkpoint(), add(b).checkpoint()
        curve.append((k, rmse(a), rmse(b)))
        if curve[-1][2] < best:
            best, kept = curve[-1][2], len(model.trees)
        elif len(model.trees) - kept >= patience:
            break
    return model.first(kept), curve
