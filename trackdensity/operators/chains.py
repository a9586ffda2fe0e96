"""Rolling backtests with retraining: the small boosted models of all chains are fitted at once.

A segment of the fold plan is a chain: its first fold starts from the core model, each later fold goes
on from the model before. Chains don't depend on each other, so fold number `pos` of every chain is
fitted in the same jobs. One round adds a tree to every live chain; each level of these trees is one
grouped aggregate of gradient sums over (chain, node, feature, bin). The number of jobs is that of
positions (seven) times rounds times levels, whatever the number of folds, and no task holds a chain's
rows.

Rows are put in order and packed once into blocks of a day (a byte for each feature's bin, arrays of
labels and predictions, the columns to keep); a block is there once for each chain that meets its day.
A round reads the blocks that its folds train on and no others; what a task sends on are sums by bin.
At the end of a position its trees move the blocks of this and later positions. Gradients are summed
in whole numbers: trees do not depend on the order of rows. The driver sees a round's eval error of each
chain and the nodes of its tree; there is a chain for each seven days of data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..sources.run_store import Run, RunStore
from . import summaries
from .boosting import Loss
from .tables import saved

BLOCK = 1 << 14  # rows of a block at most
DEALT = 1 << 20  # rows of a partition, where that is more than two partitions a core
EVERY = 16  # rounds between written blocks
NODES_HELD = 100_000  # nodes of finished trees that the driver holds before they are written
UNIT = float(1 << 20)  # gradients and errors are summed as multiples of its inverse
BLOCKS = "part int, seq int, day date, n int, bins binary, label array<double>, y array<double>, keep binary"
STATE = "chain string, day date, at long, bins binary, label array<double>, y array<double>, best array<double>, keep binary"
MOVED = "chain string, first long, total long, bins binary, label array<double>, y array<double>"
TREE = "chain string, pos int, round int, rate double, nodes map<int,struct<f:int,b:int,v:double>>"


def chain_plan(days: DataFrame, horizon: int, history: int = 5, name: str = "") -> DataFrame:
    """chain, pos, fold, role, day: the rolling-origin plan with each segment as a chain of up to seven folds."""
    plan = summaries.fold_plan(days, horizon, history)
    return plan.select(F.concat(F.lit(name), F.col("segment").cast("string")).alias("chain"), F.pmod(F.col("fold") + 4, F.lit(7)).cast("int").alias("pos"), "fold", "role", "day")


def bin_cuts(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """At most bins - 1 distinct cuts of each feature, at its quantiles (by a sketch; it is a matter of resolution only)."""
    points = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    one = df.agg(*[F.percentile_approx(F.col(f).cast("double"), points, F.lit(10_000)).alias(f) for f in features]).first()
    return {f: sorted(set(one[f] or [])) for f in features}


def binned(cuts: dict[str, list[float]]) -> Column:
    """Array of each feature's bin: how many of its cuts lie below the value (none below null)."""

    def number(f: str, found: list[float]) -> Column:
        n = F.lit(0)
        for x in found:
            n = n + F.when(F.col(f) > x, 1).otherwise(0)
        return n

    return F.array(*[number(f, c) for f, c in cuts.items()])


def node_of(nodes: Column, bins: Column, depth: int) -> Column:
    """The node, `depth` levels down at most, that a row's bins lead to (nodes by number: the root 1, those below n are 2n and 2n + 1)."""

    def down(at: Column, _: Column) -> Column:
        n = F.element_at(nodes, at)
        return F.when(n["f"].isNull(), at).otherwise(2 * at + (F.element_at(bins, n["f"] + 1) > n["b"]).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), down) if depth else F.lit(1)


def leaf(nodes: Column, bins: Column, depth: int) -> Column:
    """Value of the leaf that a row's bins lead to in a tree."""
    return F.coalesce(F.element_at(nodes, node_of(nodes, bins, depth))["v"], F.lit(0.0))


@dataclass
class Trees:
    """A model to keep: its trees (pos, round, rate, nodes), the cuts of its features, and how deep a tree is."""

    trees: DataFrame
    cuts: dict[str, list[float]]
    depth: int

    def score(self, df: DataFrame, start: Column | None = None, out: str = "prediction") -> DataFrame:
        """df with the sum of the trees: they travel as one row and are folded in one expression, whatever their number."""
        flat = self.trees.select(F.struct("pos", "round", "rate", F.map_entries("nodes").alias("nodes")).alias("t"))
        one = flat.agg(F.transform(F.array_sort(F.collect_list("t")), self._flat).alias("_trees"))
        total = F.aggregate("_trees", (F.lit(0.0) if start is None else start).cast("double"), lambda acc, t: acc + t["rate"] * leaf(t["nodes"], F.col("_bins"), self.depth))
        return df.withColumn("_bins", binned(self.cuts)).crossJoin(F.broadcast(one)).withColumn(out, total).select(*df.columns, out)

    def _flat(self, t: Column) -> Column:
        """A tree's rate and its nodes as an array by number."""
        by_number = F.map_from_entries(t["nodes"])
        return F.struct(t["rate"].alias("rate"), F.transform(F.sequence(F.lit(1), F.lit(2 ** (self.depth + 1) - 1)), lambda i: F.element_at(by_number, i)).alias("nodes"))

    def save(self, run: Run, name: str) -> None:
        """As two tables of a run: NAME (trees) and NAME-cuts."""
        run.save(name, self.trees.select("pos", "round", "rate", "nodes"))
        cuts = [(k, self.depth, f, c) for k, (f, c) in enumerate(self.cuts.items())]
        run.save(f"{name}-cuts", self.trees.sparkSession.createDataFrame(cuts, "k int, depth int, feature string, cuts array<double>").coalesce(1))

    @classmethod
    def load(cls, store: RunStore, name: str, version: int | None = None) -> Trees:
        rows = sorted(store.read(f"{name}-cuts", version).collect())  # a row for each feature
        return cls(store.read(name, version), {r["feature"]: list(r["cuts"]) for r in rows}, rows[0]["depth"])


@dataclass
class Chains:
    """trees: a row for each chain, position and round; kept: chain, pos, fold, rounds (of that position that stay), error."""

    trees: DataFrame
    kept: DataFrame
    cuts: dict[str, list[float]]
    depth: int
    forecasts: DataFrame

    def snapshot(self, fold: int, name: str = "") -> Trees:
        """A fold's model: the trees kept at its own and at all earlier positions of its chain (whose names begin with `name`)."""
        own = self.kept.filter((F.col("fold") == fold) & F.col("chain").startswith(name)).select("chain", F.col("pos").alias("last"))
        rounds = self.kept.select("chain", "pos", "rounds")
        trees = self.trees.join(rounds, ["chain", "pos"]).join(own, "chain").filter((F.col("pos") <= F.col("last")) & (F.col("round") < F.col("rounds")))
        return Trees(trees.select("pos", "round", "rate", "nodes"), self.cuts, self.depth)


@dataclass
class _Nodes:
    """A tree's nodes as arrays by number: feature (-1 where it is not split), bin and value."""

    f: np.ndarray
    b: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, nodes: dict, depth: int) -> _Nodes:
        size = 2 ** (depth + 1)
        f, b, v = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        for i, (own, cut, value) in nodes.items():
            if own is None:
                v[i] = value
            else:
                f[i], b[i] = own, cut
        return cls(f, b, v)

    def at(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """node_of for the columns of bins."""
        n = bins.shape[1]
        at, flat, here = np.ones(n, np.int64), bins.reshape(-1), np.arange(n)
        for _ in range(depth):
            f = self.f[at]
            at = np.where(f < 0, at, 2 * at + (flat.take(np.maximum(f, 0) * n + here) > self.b[at]))
        return at


def _whole(x: np.ndarray) -> np.ndarray:
    """x as multiples of 1 / UNIT, halves away from zero."""
    if not np.isfinite(x).all():
        raise ValueError("a gradient or error is not finite")
    a = np.abs(x * UNIT)
    n = np.floor(a)
    return (np.sign(x) * (n + (a - n >= 0.5))).astype(np.int64)


def _bins(value: pa.Scalar, n_features: int, width: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8 if width <= 256 else np.int32).reshape(n_features, -1)


def _lists(*arrays: np.ndarray) -> list[pa.Array]:
    """Each array as a column of one row."""
    return [pa.ListArray.from_arrays([0, len(x)], pa.array(x, pa.float64())) for x in arrays]


def _watched(first: int, total: int, n: int) -> np.ndarray:
    """Whether rows number first, first + 1, ... of a fold's training rows are in its blocks 3 and 4 of six."""
    size = total // 6
    block = np.minimum((first + np.arange(n)) // size, 5) if size else np.zeros(n, np.int64)
    return (block == 3) | (block == 4)


def _packer(cuts: list[np.ndarray], keep: list[str], width: int):
    """Rows in order (part, day, features, label, y, columns to keep) as blocks of a day."""
    n_features = len(cuts)

    def blocks(batches):
        held, size, seq = [], 0, 0

        def block():
            t = pa.Table.from_batches(held)
            bins = np.stack([np.searchsorted(c, t.column(f"_f{i}").to_numpy(), side="left") for i, c in enumerate(cuts)]) if n_features else np.zeros((0, size))
            sink = pa.BufferOutputStream()
            kept = t.select(keep)
            with pa.ipc.new_stream(sink, kept.schema) as out:
                out.write_table(kept)
            one = [pa.array([x], k) for x, k in ((t["_part"][0].as_py(), pa.int32()), (seq, pa.int32()), (t["day"][0].as_py(), pa.date32()), (size, pa.int32()), (bins.astype(np.uint8 if width <= 256 else np.int32).tobytes(), pa.binary()))]
            return pa.RecordBatch.from_arrays([*one, *_lists(t["_label"].to_numpy(), t["_y"].to_numpy()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "seq", "day", "n", "bins", "label", "y", "keep"])

        last = None
        for batch in batches:
            days = batch.column("day").cast(pa.int32()).to_numpy()
            ends = [*(np.flatnonzero(np.diff(days)) + 1).tolist(), len(days)]
            at = 0
            for end in ends:
                while at < end:
                    if size and (size == BLOCK or days[at] != last):
                        yield block()
                        held, size, seq = [], 0, seq + 1
                    some = min(end - at, BLOCK - size)
                    held.append(batch.slice(at, some))
                    last, size, at = days[at], size + some, at + some
        if size:
            yield block()

    return blocks


def _mover(trees: dict[str, tuple[float, _Nodes]], depth: int, n_features: int, width: int):
    """The blocks of the chains that have a tree, each moved by it."""

    def move(batches):
        for batch in batches:
            for i, chain in enumerate(batch.column(0).to_pylist()):
                if chain in trees:
                    rate, tree = trees[chain]
                    y = batch.column(5)[i].values.to_numpy() + rate * tree.v[tree.at(_bins(batch.column(3)[i], n_features, width), depth)]
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, 1) for k in range(5)], *_lists(y)], batch.schema.names)

    return move


def _stepper(trees: dict[str, list[tuple[float, _Nodes]]], stay: dict[str, int], last: bool, depth: int, n_features: int, width: int):
    """All blocks moved by some rounds' trees: `best` is the prediction after the first `stay` of them; in the end it is where the next position starts."""

    def step(batches):
        for batch in batches:
            for i, chain in enumerate(batch.column(0).to_pylist()):
                y, best = (batch.column(k)[i].values.to_numpy() for k in (5, 6))
                bins, own = _bins(batch.column(3)[i], n_features, width), trees.get(chain, [])
                for k, (rate, tree) in enumerate(own):
                    y = y + rate * tree.v[tree.at(bins, depth)]
                    best = y if stay.get(chain) == k + 1 else best
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, 1) for k in range(5)], *_lists(best if last else y, best), batch.column(7).slice(i, 1)], batch.schema.names)

    return step


def _summer(trees: dict[str, _Nodes], level: int, n_features: int, width: int):
    """Sums g and h and number n of a task's training rows by chain, node of the level, feature and bin."""
    shape = (2**level, n_features, width)
    size = int(np.prod(shape))

    def add(out: np.ndarray, cell: np.ndarray, x: np.ndarray) -> None:
        if len(x) and float(np.abs(x).max()) * len(x) < 2**53:  # exact in doubles
            out += np.bincount(cell, x, size).astype(np.int64)
        else:
            np.add.at(out, cell, x)

    def sums(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, chain in enumerate(batch.column(0).to_pylist()):
                if chain not in trees:
                    continue
                first, total = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                bins, g, h = _bins(batch.column(3)[i], n_features, width), *(batch.column(k)[i].values.to_numpy() for k in (4, 5))
                node = trees[chain].at(bins, level) - 2**level
                use = np.flatnonzero(~_watched(first, total, len(g)) & (node >= 0))
                bins, node, g, h = bins[:, use], node[use], _whole(g[use]), _whole(h[use])
                out = found.setdefault(chain, np.zeros((3, size), np.int64))
                for f in range(n_features):
                    cell = (node * n_features + f) * width + bins[f]
                    for k, x in enumerate((g, h, np.ones(len(g), np.int64))):
                        add(out[k], cell, x)
        for chain, out in found.items():
            cells = np.flatnonzero(out[2])
            node, f, b = np.unravel_index(cells, shape)
            yield pa.RecordBatch.from_arrays([pa.array([chain] * len(cells), pa.string()), *[pa.array(x, pa.int32()) for x in (node + 2**level, f, b)], *[pa.array(x, pa.int64()) for x in out[:, cells]]], ["chain", "node", "f", "b", "g", "h", "n"])

    return sums


def _errors(batches):
    """chain, e and n of each block: squared errors of the watched rows, in whole numbers, and how many there are."""
    for batch in batches:
        for i, chain in enumerate(batch.column(0).to_pylist()):
            label, y = (batch.column(k)[i].values.to_numpy() for k in (4, 5))
            own = _watched(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), len(y))
            yield pa.RecordBatch.from_arrays([pa.array([chain], pa.string()), *[pa.array([int(x)], pa.int64()) for x in (_whole((y[own] - label[own]) ** 2).sum(), own.sum())]], ["chain", "e", "n"])


def _unpacker(batches):
    """Rows of blocks (chain, fold, label, best, keep)."""
    for batch in batches:
        for i in range(batch.num_rows):
            kept = pa.ipc.open_stream(batch.column(4)[i].as_buffer()).read_all().combine_chunks()
            label, best = (batch.column(k)[i].values for k in (2, 3))
            n = len(label)
            every = [pa.array([batch.column(0)[i].as_py()] * n, pa.string()), pa.array(np.full(n, batch.column(1)[i].as_py(), np.int64)), *[pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in kept.columns], label, best]
            yield pa.RecordBatch.from_arrays(every, ["chain", "fold", *kept.schema.names, "label", "prediction"])


def _best_splits(blocks: DataFrame, trees: dict[str, dict], level: int, depth: int, min_rows: int, penalty: float, n_features: int, width: int) -> DataFrame:
    """chain, node, sums g and h, and the best split s (f, b and the sums of its lower side; null if none), of the nodes of one level.

    blocks: chain, first, total, bins, g, h; trees: the nodes of the levels above by chain. Only sums of bins
    are shuffled: first by bin, then by chain, which serves both windows and the last aggregate.
    """
    own = _summer({c: _Nodes.of(x, depth) for c, x in trees.items()}, level, n_features, width)
    parts = blocks.select("chain", "first", "total", "bins", "g", "h").mapInArrow(own, "chain string, node int, f int, b int, g long, h long, n long")
    sums = parts.groupBy("chain", "node", "f", "b").agg(*[F.sum(x).alias(x) for x in "ghn"])
    by = Window.partitionBy("chain", "node", "f")
    left = by.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.repartition("chain").select("chain", "node", "f", "b", *[F.sum(x).over(left).alias(f"{x}l") for x in "ghn"], *[F.sum(x).over(by).alias(f"{x}t") for x in "ghn"])
    score = lambda g, h: F.pow(g / UNIT, 2) / (h / UNIT + penalty)
    rest = lambda x: F.col(f"{x}t") - F.col(f"{x}l")
    gain = F.round(score(F.col("gl"), F.col("hl")) + score(rest("g"), rest("h")) - score(F.col("gt"), F.col("ht")), 9)
    fine = (F.col("nl") >= min_rows) & (rest("n") >= min_rows) & (gain > 0)
    split = F.when(fine, F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), F.col("gl").alias("g"), F.col("hl").alias("h")))
    return sums.groupBy("chain", "node").agg(F.max("gt").alias("g"), F.max("ht").alias("h"), F.max(split).alias("s"))


def _grow(blocks: DataFrame, live: list[str], depth: int, min_rows: int, penalty: float, n_features: int, width: int) -> dict[str, dict]:
    """A tree for each live chain: {node: (f, b, None) or (None, None, value)}. A level is one job; its splits come to the driver."""
    value = lambda g, h: -(g / UNIT) / (h / UNIT + penalty)
    trees: dict[str, dict] = {c: {} for c in live}
    for level in range(depth):
        for r in _best_splits(blocks, trees, level, depth, min_rows, penalty, n_features, width).collect():  # a row for each node of the level
            tree, node, s = trees[r["chain"]], r["node"], r["s"]
            tree[node] = (None, None, value(r["g"], r["h"])) if s is None else (-s["f"], -s["b"], None)
            if s is not None:  # leaves, unless the next level splits them
                tree[2 * node], tree[2 * node + 1] = (None, None, value(s["g"], s["h"])), (None, None, value(r["g"] - s["g"], r["h"] - s["h"]))
    return trees


def _packed(rows: DataFrame, cuts: dict[str, list[float]], keep: list[str], order: list[str], n: int, width: int) -> DataFrame:
    """Blocks of the rows in order, with `at`: how many rows of their day come before them."""
    spark = rows.sparkSession
    parts = int(min(max(2 * spark.sparkContext.defaultParallelism, n // DEALT + 1), n // BLOCK + 1))
    columns = ["day", *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(cuts)], "_label", "_y"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("_part"), *columns, *keep)
    blocks = saved(placed.mapInArrow(_packer([np.array(c) for c in cuts.values()], keep, width), BLOCKS), "blocks")
    before = F.sum("n").over(Window.partitionBy("day").orderBy("part", "seq")) - F.col("n")
    places = saved(blocks.select("part", "seq", before.alias("at"), "day", "n").drop("day", "n"), "places")  # a row for each block
    return blocks.join(F.broadcast(places), ["part", "seq"])


def fit(
    rows: DataFrame, plan: DataFrame, label: str, features: list[str], loss: Loss, rate: Callable[[int], float], rounds: int, order: list[str], keep: list[str] | None = None, depth: int = 4, bins: int = 32,
    min_rows: int = 300, penalty: float = 1.0, patience: int = 30, start: Column | None = None,
) -> Chains:
    """Fits every fold of the plan and forecasts its days.

    rows: time, label, features and the columns `keep`; `order` (with time first) numbers the rows of a day.
    A fold trains on blocks 0, 1, 2 and 5 of its training rows in order and watches the error of blocks 3
    and 4: it stops after `patience` rounds without a better one and keeps the best (all rounds
    where there are fewer than six rows). `start` is the core model's prediction (0 by default).
    rate(k) is the rate of round k of a fold. Rows with a null label or feature take no part.
    """
    keep = list(dict.fromkeys(keep or order))
    spark = rows.sparkSession
    rows = rows.dropna(subset=[label, *features]).withColumn("day", F.to_date("time")).filter(F.col("day").isNotNull())
    cuts = bin_cuts(rows, features, bins)
    n_features, width = len(cuts), max([len(c) for c in cuts.values()], default=0) + 1
    rows = rows.join(F.broadcast(plan.select("day").distinct()), "day", "left_semi")  # a row for each day
    sizes = saved(rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")), "sizes")
    plan = plan.join(sizes, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_fold = Window.partitionBy("chain", "pos", "role").orderBy("day")
    plan = plan.withColumn("before", F.sum("n").over(of_fold) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("chain", "pos", "role")))
    plan = saved(plan, "plan")
    y0 = (F.lit(0.0) if start is None else start).cast("double")
    n_rows = sizes.agg(F.sum("n")).first()[0] or 0
    kinds = {f.name: f for f in rows.schema.fields}
    blocks = _packed(rows.withColumns({"_label": F.col(label).cast("double"), "_y": y0}), cuts, keep, order, n_rows, width)
    of_day = plan.groupBy("chain", "day").agg(F.max("pos").alias("last"))  # the last position that a chain's day is needed at
    state = blocks.join(F.broadcast(of_day.select("chain", "day")), "day").select("chain", "day", "at", "bins", "label", "y", F.col("y").alias("best"), "keep")
    state = saved(state, "state")
    positions = sorted(r["pos"] for r in plan.select("pos").distinct().collect())  # seven at most
    trees, made, kept, forecasts = [], [], [], None
    for pos in positions:
        chains = {r["chain"]: [float("inf"), 0, 0, r["fold"]] for r in plan.filter(F.col("pos") == pos).select("chain", "fold").distinct().collect()}  # error, rounds kept, rounds since
        live = set(chains)
        needed = F.broadcast(of_day.filter(F.col("last") >= pos).select("chain", "day"))
        here = plan.filter(F.col("pos") == pos).select("chain", "day", "fold", "role", "before", "total")
        held = state.join(F.broadcast(here.filter("role = 'train'")), ["chain", "day"]).select("chain", (F.col("before") + F.col("at")).alias("first"), "total", "bins", "label", "y")
        held = _with_gradients(held, loss).persist()
        waiting, done = [], 0  # rounds whose trees the state still lacks, and how many it has

        def stepped(state: DataFrame, waiting: list, done: int, chains: dict, last: bool) -> DataFrame:
            own = {c: [(rate, _Nodes.of(grown[c], depth)) for rate, grown in waiting if c in grown] for c in chains}
            step = _stepper(own, {c: x[1] - done for c, x in chains.items()}, last, depth, n_features, width)
            return saved(state.join(needed, ["chain", "day"], "left_semi").select(*[f.split()[0] for f in STATE.split(", ")]).mapInArrow(step, STATE), "state")

        for k in range(rounds):
            if not live:
                break
            grown = _grow(held, sorted(live), depth, min_rows, penalty, n_features, width)
            made += [(c, pos, k, float(rate(k)), nodes) for c, nodes in grown.items()]
            if sum(len(x[4]) for x in made) > NODES_HELD:
                trees, made = [*trees, saved(spark.createDataFrame(made, TREE), "trees")], []
            waiting.append((float(rate(k)), grown))
            tree = {c: (float(rate(k)), _Nodes.of(nodes, depth)) for c, nodes in grown.items()}
            moved = held.select(*[f.split()[0] for f in MOVED.split(", ")]).mapInArrow(_mover(tree, depth, n_features, width), MOVED)
            before = held
            held = moved
            if k + 1 < rounds:
                held = (saved(moved, "moved") if k % EVERY == EVERY - 1 else moved)
                held = _with_gradients(held, loss).persist()
            watched = held.select(*[f.split()[0] for f in MOVED.split(", ")]).mapInArrow(_errors, "chain string, e long, n long").groupBy("chain").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
            errors = {r["chain"]: r["e"] / UNIT / r["n"] for r in watched.collect() if r["n"]}  # a row for each chain
            before.unpersist()
            for c in sorted(live):
                one = chains[c]
                if c not in errors or errors[c] < one[0]:
                    one[:3] = [errors.get(c, float("inf")), k + 1, 0]
                else:
                    one[2] += 1
                    if one[2] >= patience:
                        live.discard(c)
            if sum(len(x) for _, g in waiting for x in g.values()) > NODES_HELD:
                state, done, waiting = stepped(state, waiting, done, chains, False), done + len(waiting), []
        held.unpersist()
        kept += [(c, pos, x[3], x[1], x[0]) for c, x in sorted(chains.items())]
        state = stepped(state, waiting, done, chains, True)
        made_of = StructType([StructField("chain", StringType()), StructField("fold", LongType()), *[kinds[c] for c in keep], StructField(label, DoubleType()), StructField("prediction", DoubleType())])
        ahead = state.join(F.broadcast(here.filter("role = 'forecast'")), ["chain", "day"]).select("chain", F.col("fold").cast("long").alias("fold"), "label", "best", "keep").mapInArrow(_unpacker, made_of)
        forecasts = ahead if forecasts is None else forecasts.unionByName(ahead)  # seven parts at most
    if made:
        trees.append(saved(spark.createDataFrame(made, TREE), "trees"))
    return Chains(_all(trees, spark), spark.createDataFrame(kept, "chain string, pos int, fold long, rounds int, error double"), cuts, depth, forecasts)


def _with_gradients(blocks: DataFrame, loss: Loss) -> DataFrame:
    """Blocks with g and h: the loss's derivatives of each row."""
    side = lambda k: F.zip_with("y", "label", lambda y, label: loss(y - label)[k].cast("double"))
    return blocks.withColumns({"g": side(0), "h": side(1)})


def _all(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    """The tables of trees, read as one."""
    paths = [f for p in parts for f in p.inputFiles()]
    return spark.read.schema(TREE).parquet(*paths) if paths else spark.createDataFrame([], TREE)
