"""Boosted regression on packed blocks: each round's tree by exact sums over bins, whatever the number of rows.

Rows are packed once into blocks (a byte for each feature's bin, the residual, a key), which stay
cached. A level of a tree is one job: tasks sum weights and steps over (node, feature, bin) and only these
arrays of fixed size leave them. A round's tree moves the residuals in the same job that counts the round's errors and
sums the next root, so a round costs as many jobs as its tree has levels, and none is fitted twice. Sums
are whole numbers and rows are drawn by their key, so trees do not depend on the order or the partitions
of the rows. Blocks are written to the shared folder each 16 rounds: a lost executor costs that many at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import saved

Step = Callable[[np.ndarray, bool], tuple[np.ndarray, np.ndarray | None]]
BLOCK = 1 << 16  # rows of a block
DEALT = 1 << 20  # rows of a partition at most, where that is more than two partitions a core
EVERY = 16  # rounds between written states
PARTS = 1 << 24  # the largest label is so many units; sums are whole units
STATE = "bins binary, key binary, r binary"


def squared(r: np.ndarray, first: bool) -> tuple[np.ndarray, None]:
    """Step (times weight 1) of the squared loss at residual r: the label itself first, then the gradient."""
    return (r if first else 2 * r), None


def pseudo_huber(r: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Newton step times weight, and weight (the second derivative), of columns.pseudo_huber of width 1."""
    s = 1 + r * r
    root = np.sqrt(s)
    return r / root, 1 / (s * root)


@dataclass
class Tree:
    """A full tree by node number (root 1): rows whose bin of feature f is above b go to 2n + 1, others to 2n; an unsplit node sends all to 2n."""

    f: np.ndarray
    b: np.ndarray
    v: np.ndarray
    gains: np.ndarray

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        n = bins.shape[1]
        at, flat, here = np.ones(n, np.int64), bins.reshape(-1), np.arange(n)
        for _ in range(levels):
            at = 2 * at + (flat.take(self.f[at] * n + here) > self.b[at])
        return at


@dataclass
class Ensemble:
    """base + sum of rate * tree."""

    features: list[str]
    cuts: list[np.ndarray]
    depth: int
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        cuts, trees, rates, base, depth = self.cuts, self.trees, self.rates, self.base, self.depth

        def predict(batches):
            for values in batches:
                bins = np.stack([np.searchsorted(c, x.to_numpy(), side="left").astype(np.uint8) for c, x in zip(cuts, values, strict=True)])
                y = np.full(bins.shape[1], base)
                for t, r in zip(trees, rates, strict=True):
                    y += r * t.v[t.nodes(bins, depth)]
                yield _series(y)

        return df.withColumn(out, _scorer(predict)(*[F.col(f).cast("double") for f in self.features]))

    def importances(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        total = sum((t.gains for t in self.trees), np.zeros(len(self.features)))
        return dict(zip(self.features, (total / total.sum() if total.sum() else total).tolist(), strict=True))


def _series(x: np.ndarray):
    import pandas as pd

    return pd.Series(x)


def _scorer(predict):
    import pandas as pd

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        return predict(batches)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def _pack(cuts: list[np.ndarray], base: float):
    """Batches of (features, label, valid, key) as blocks; the key's last bit says whether the row is watched."""

    def blocks(batches):
        held, n = [], 0

        def block():
            t = pa.Table.from_batches(held)
            bins = np.stack([np.searchsorted(c, t.column(i).to_numpy(), side="left").astype(np.uint8) for i, c in enumerate(cuts)])
            valid = t.column("_valid").to_numpy().astype(np.int64)
            key = (t.column("_key").to_numpy() & ~np.int64(1)) | valid
            return _row(bins, key, t.column("_label").to_numpy() - base)

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return blocks


def _row(bins: np.ndarray, key: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, key, r)], ["bins", "key", "r"])


def _blocks(batches, n_features: int):
    for batch in batches:
        for bins, key, r in zip(*[batch.column(i) for i in range(3)], strict=True):
            yield np.frombuffer(bins.as_buffer(), np.uint8).reshape(n_features, -1), np.frombuffer(key.as_buffer(), np.int64), np.frombuffer(r.as_buffer(), np.float64)


def _mover(tree: Tree, rate: float, depth: int, n_features: int):
    def move(batches):
        for bins, key, r in _blocks(batches, n_features):
            yield _row(bins, key, r - rate * tree.v[tree.nodes(bins, depth)])

    return move


def _drawn(key: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Whether each row is in a round's sample: a mix of its key and the round."""
    x = (key >> 1).astype(np.uint64) ^ np.uint64(((seed << 32) + round_ + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(33)) < np.uint64(int(share * 2**31))


def _summer(tree: Tree, level: int, round_: int, step: Step, unit: float, n_features: int, width: int, share: float, seed: int):
    """Sums n, h, s of a task over (node, feature, bin); at the root also number and errors of the watched and the other rows."""

    def sums(batches):
        size = 2**level * n_features * width
        n, h, s = (np.zeros(size, np.int64) for _ in range(3))
        errors = np.zeros((2, 2), np.int64)
        for bins, key, r in _blocks(batches, n_features):
            watched = (key & 1).astype(bool)
            if level == 0:
                e = np.rint((r * unit) ** 2 / PARTS)
                for k, own in enumerate((watched, ~watched)):
                    errors[k] += (int(own.sum()), int(e[own].sum()))
            use = np.flatnonzero(~watched & _drawn(key, round_, seed, share) if share < 1 else ~watched)
            own, (z, w) = bins[:, use], step(r[use], round_ == 0)
            z = np.rint(z * unit)
            w = None if w is None else np.rint(w * PARTS)
            at = (tree.nodes(own, level) - 2**level) * (n_features * width)
            for f in range(n_features):
                cell = at + (f * width) + own[f]
                n += np.bincount(cell, minlength=size)
                s += np.bincount(cell, z, size).astype(np.int64)
                if w is not None:
                    h += np.bincount(cell, w, size).astype(np.int64)
        full = h if step is not squared else n * PARTS
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (np.stack([n, full, s]), errors)], ["sums", "errors"])

    return sums


def _level_sums(state: DataFrame, summer, shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Arrays (3 of n, h, s by node, feature, bin) and the errors, added up on the driver: an array of fixed size comes from each partition, which holds a million rows or so."""
    out, errors = np.zeros((3, int(np.prod(shape))), np.int64), np.zeros((2, 2), np.int64)
    for sums, own in state.mapInArrow(summer, "sums binary, errors binary").collect():
        out += np.frombuffer(sums, np.int64).reshape(out.shape)
        errors += np.frombuffer(own, np.int64).reshape(2, 2)
    out = np.stack([out[0], out[1] / PARTS, out[2]])
    return out.reshape(3, *shape), errors


def _split(tree: Tree, open_: set[int], sums: np.ndarray, level: int, unit: float, min_rows: int, share: float, draw: list[int]) -> set[int]:
    """Splits the open nodes of a level where a split gains; returns the open nodes of the next."""
    n, h, s = sums
    s = s / unit
    n_features = n.shape[1]
    some = int(np.ceil(share * n_features))
    score = lambda a, b: np.divide(a * a, b, out=np.zeros_like(a), where=b > 0)
    mean = lambda a, b: float(a / b) if b > 0 else 0.0
    after = set()
    for k in range(2**level):
        node = 2**level + k
        if node not in open_:
            tree.v[2 * node] = tree.v[2 * node + 1] = tree.v[node]
            continue
        nt, ht, st = n[k, 0].sum(), h[k, 0].sum(), s[k, 0].sum()
        tree.v[node] = mean(st, ht)
        nl, hl, sl = (np.cumsum(x[k], axis=1) for x in (n, h, s))
        gain = score(sl, hl) + score(st - sl, ht - hl) - float(score(np.array([st]), np.array([ht]))[0])
        fine = (nl >= min_rows) & (nt - nl >= min_rows)
        if some < n_features:
            chosen = np.random.default_rng([*draw, node]).choice(n_features, some, replace=False)
            fine[np.setdiff1d(np.arange(n_features), chosen)] = False
        gain = np.where(fine, np.round(gain, 9), 0.0)
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[f, b] <= 0:
            tree.v[2 * node] = tree.v[2 * node + 1] = tree.v[node]
            continue
        tree.f[node], tree.b[node] = f, b
        tree.gains[f] += gain[f, b]
        tree.v[2 * node], tree.v[2 * node + 1] = mean(sl[f, b], hl[f, b]), mean(st - sl[f, b], ht - hl[f, b])
        after |= {2 * node, 2 * node + 1}
    return after


def boost(
    df: DataFrame, features: list[str], label: str, valid: Column, key: list[str], step: Step, rate: Callable[[int], float], rounds: int, depth: int = 4, min_rows: int = 300, patience: int = 30,
    bins: int = 32, sample: float = 1.0, share: float = 1.0, seed: int = 7, mean_first: bool = False,
) -> tuple[Ensemble, list[tuple[int, float, float]]]:
    """(the trees up to the best round, curve of (round, train rmse, valid rmse)).

    Stops after `patience` rounds without a smaller error of the watched rows (`valid`). Each round
    draws `sample` of the other rows by their key; each node draws `share` of the features.
    """
    points = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("_label"), valid.alias("_valid"), F.xxhash64(*key).alias("_key")).dropna()
    rows = saved(rows, "rows")
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("_label")).alias("m"), F.avg(F.when(~F.col("_valid"), F.col("_label"))).alias("a"), *[F.percentile_approx(f"f{i}", points, F.lit(10_000)).alias(f"f{i}") for i in range(len(features))]).first()
    cuts = [np.array(sorted(set(one[f"f{i}"] or []))) for i in range(len(features))]
    model = Ensemble(features, cuts, depth, float(one["a"] or 0.0) if mean_first else 0.0)
    unit = float(PARTS / 2.0 ** np.ceil(np.log2(one["m"] or 1.0)))
    n_features, width = len(features), max(len(c) for c in cuts) + 1
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, one["n"] // DEALT + 1)
    state = saved(rows.mapInArrow(_pack(cuts, model.base), STATE).repartition(int(min(parts, one["n"] // BLOCK + 1))), "blocks")
    held = state.persist()
    curve, best, kept = [], float("inf"), 0
    for k in range(rounds + 1):
        size = 2 ** (depth + 1)
        tree = Tree(np.zeros(size, np.int64), np.full(size, 255, np.int64), np.zeros(size), np.zeros(n_features))
        open_ = {1}
        for level in range(depth):
            shape = (2**level, n_features, width)
            sums, errors = _level_sums(held, _summer(tree, level, k, step, unit, n_features, width, sample, seed), shape)
            if level == 0 and k:
                watched, own = (float(np.sqrt(e * PARTS / n)) / unit if n else float("nan") for n, e in errors)
                curve.append((k - 1, own, watched))
                if k == 1 or watched < best:
                    best, kept = watched, k
                if k - kept >= patience or k == rounds:
                    held.unpersist()
                    return Ensemble(features, cuts, depth, model.base, model.trees[:kept], model.rates[:kept]), curve
            open_ = _split(tree, open_, sums, level, unit, min_rows, share, [seed, k])
            if not open_:
                for node in range(2 ** (level + 1), 2**depth):
                    tree.v[2 * node] = tree.v[2 * node + 1] = tree.v[node]
                break
        model.trees.append(tree)
        model.rates.append(float(rate(k)))
        moved = held.mapInArrow(_mover(tree, model.rates[-1], depth, n_features), STATE)
        before = held
        held = (saved(moved, "blocks") if k % EVERY == EVERY - 1 else moved).persist()
        if k % EVERY != EVERY - 1:
            held.count()
        before.unpersist()
    raise AssertionError("rounds end in the loop")
