"""Hard negatives by exact integer inner products, many candidates in one multiplication.

Each component x becomes floor(256 x). In a block of candidates, component d of all of them is
biased to be non-negative and put side by side into fields of one wide integer W[d]; a field is
wide enough for the largest biased product sum, so fields never run over. An anchor's biased
component times W[d], summed over d, holds the biased scores of the whole block: one
multiplication for each component, whatever the number of candidates. Fields are unpacked and
the bias taken off, which gives exact scores.

How it runs: anchors and candidates are dealt into parts of a bounded size (by a hash of the
label, then by row), and each pair of an anchor part and a candidate part is one cogroup task.
Positives need the parts of the same hash of the label only; negatives need all parts. Each
task keeps its best rows for each anchor, and a window merges them over parts.

Defined cases: rows with a null label, a null vector, or a null or non-finite component (also
when 256 x is not finite) take no part. Shorter vectors count as padded with zeros. A row
without an id is no anchor, and comes last in ties. Rows that repeat an id are rows of their own;
anchors among them each get their rows. Scores beyond 63 bits count as the nearest long. Anchors
without positives, or positives without negatives in range, have no row. Other columns are not read.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BUCKETS = 256  # hashes of labels; their counts are all that the driver sees
PART_ANCHORS = 2048
PART_COMPONENTS = 1 << 21  # of a candidate part: rows times the longest vector
PART_ROWS = 32_768
BLOCK = 1024  # candidates packed into one wide integer
SCALE = 256.0
MOST = (1 << 63) - 1
POSITIVES_SCHEMA = "a_row long, id long, score long"
NEGATIVES_SCHEMA = "a_row long, nth int, id long, score long"


def quantised(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """floor(256 x) of each vector as a row; shorter vectors end in zeros. Whole numbers kept in doubles, so exact."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    width = max(int(size.max(initial=0)), width or 0)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


class Packed:
    """A block of candidates: for each component one wide integer with a field for each candidate."""

    def __init__(self, candidates: np.ndarray, anchors_low: int, anchors_high: int):
        n, dims = candidates.shape
        ints = _integers(candidates)
        self.n, self.bias, self.a_bias = n, -min(0, int(ints.min(initial=0))), -min(0, anchors_low)
        high = (int(ints.max(initial=0)) + self.bias) * (max(0, anchors_high) + self.a_bias) * max(1, dims)
        self.width = 32 if high < 1 << 32 else 64 if high < 1 << 62 else 64 * -(-high.bit_length() // 64)
        self.sums = ints.sum(axis=1)
        self.wide = [self._pack(ints[:, d] + self.bias) for d in range(dims)]
        self.dims = dims

    def _pack(self, fields: np.ndarray) -> int:
        if self.width <= 64:
            return int.from_bytes(fields.astype(f"<u{self.width // 8}").tobytes(), "little")
        return int.from_bytes(b"".join(int(x).to_bytes(self.width // 8, "little") for x in fields), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Exact inner products of one anchor with all candidates of the block."""
        total = sum(map(mul, [a + self.a_bias for a in anchor], self.wide))
        raw, step = total.to_bytes(self.n * self.width // 8, "little"), self.width // 8
        # (a + p)(c + q) = ac + q a + p c + pq, summed over the components
        fixed = self.bias * sum(anchor) + self.dims * self.a_bias * self.bias
        if step <= 8:
            return np.frombuffer(raw, f"<u{step}").astype(np.int64) - fixed - self.a_bias * self.sums
        exact = (int.from_bytes(raw[k : k + step], "little") - fixed - self.a_bias * int(c) for k, c in zip(range(0, len(raw), step), self.sums, strict=True))
        return np.array([max(-MOST - 1, min(MOST, x)) for x in exact], np.int64)


def _integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, or as Python's where they are large."""
    if not values.size or np.abs(values).max() < 1 << 24:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def _scored(anchors: pa.Table, candidates: pa.Table):
    """For each anchor its index and its scores with all candidates, which are in order of ids."""
    a, c = quantised(anchors["vec"]), quantised(candidates["c_vec"])
    dims = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (a, c))
    ints = _integers(a)
    low, high = int(ints.min(initial=0)), int(ints.max(initial=0))
    blocks = [Packed(c[k : k + BLOCK], low, high) for k in range(0, len(c), BLOCK)]
    for i, anchor in enumerate(ints.tolist()):
        yield i, np.concatenate([b.scores(anchor) for b in blocks])


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k by score, highest first, then by place."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.argsort(-scores[some].astype(np.float64), kind="stable")][:k] if _small(scores) else some[np.array(sorted(range(len(some)), key=lambda i: -int(scores[some[i]])), int)][:k]


def _small(scores: np.ndarray) -> bool:
    return not len(scores) or (scores.max() < 1 << 52 and scores.min() > -(1 << 52))


def _by_id(candidates: pa.Table) -> pa.Table:
    return candidates.sort_by([("c_id", "ascending")])  # rows without an id come last


def _table(columns: list, schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _positives(most: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if anchors.num_rows and candidates.num_rows:
            candidates = _by_id(candidates)
            ids, rows, labels = candidates["c_id"].to_pylist(), candidates["c_row"].to_numpy(), candidates["c_label"].to_numpy()
            a_rows, a_labels = anchors["row"].to_pylist(), anchors["label"].to_pylist()
            for i, scores in _scored(anchors, candidates):
                own = np.flatnonzero((labels == a_labels[i]) & (rows != a_rows[i]))
                for k in own[_first(scores[own], most)].tolist():
                    out[0].append(a_rows[i])
                    out[1].append(ids[k])
                    out[2].append(int(scores[k]))
        return _table(out, POSITIVES_SCHEMA)

    return run


def _negatives(most: int, low: int, high: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if anchors.num_rows and candidates.num_rows:
            candidates = _by_id(candidates)
            ids, labels = candidates["c_id"].to_pylist(), candidates["c_label"].to_numpy()
            a_rows, a_labels, wanted = (anchors[c].to_pylist() for c in ("row", "label", "positives"))
            for i, scores in _scored(anchors, candidates):
                # low * positive <= 100 * negative <= high * positive, in whole numbers
                ranges = [(-(-low * p // 100), high * p // 100) for p in wanted[i]]
                least, top = max(-MOST - 1, min(x for x, _ in ranges)), min(MOST, max(y for _, y in ranges))
                some = np.flatnonzero((scores >= least) & (scores <= top) & (labels != a_labels[i]))
                some = some[_first(scores[some], len(some))] if len(some) else some
                falling = -scores[some].astype(object) if not _small(scores) else -scores[some]
                for nth, (x, y) in enumerate(ranges):
                    at = int(np.searchsorted(falling, -y, "left"))
                    for k in some[at : at + most].tolist():
                        if scores[k] < x:
                            break
                        out[0].append(a_rows[i])
                        out[1].append(nth)
                        out[2].append(ids[k])
                        out[3].append(int(scores[k]))
        return _table(out, NEGATIVES_SCHEMA)

    return run


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Anchors with their part q, candidates with their part p, and the numbers of parts."""
    stats = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("long")).alias("a"), F.max(F.size("vec")).alias("d")).collect()  # BUCKETS rows at most
    longest = max([1, *(r["d"] for r in stats)])
    each = max(BLOCK, min(PART_ROWS, PART_COMPONENTS // longest))
    count = {"p": {r["bucket"]: -(-r["n"] // each) for r in stats}, "q": {r["bucket"]: -(-r["a"] // PART_ANCHORS) for r in stats}}
    total = {}
    for name, sizes in count.items():
        at, first = 0, []
        for b in range(BUCKETS):
            first.append(at)
            at += sizes.get(b, 0)
        total[name] = at
        n, f = (F.element_at(F.array(*map(F.lit, x)), F.col("bucket") + 1) for x in ([sizes.get(b, 0) for b in range(BUCKETS)], first))
        rows = rows.withColumn(f"n_{name}", n).withColumn(f"f_{name}", f)
        rows = rows.withColumn(name, F.col(f"f_{name}") + F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.col(f"n_{name}"))).cast("int"))
    return rows.filter("anchor"), rows, total["q"], total["p"]


def _pairs(anchors: DataFrame, candidates: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    a = anchors.select("row", "label", "vec", *extra, "q", F.explode("to").alias("p"))
    # new names all over: both sides come from one table
    c = candidates.select(*[F.col(x).alias(f"c_{x}") for x in ("row", "id", "label", "vec", "p")], F.explode("to").alias("c_q"))
    return a, c


def _top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its first `positives` rows of the same label, the first
    `negatives` rows of other labels whose score is `low` to `high` percent of the positive's.
    """
    vec = F.col(vec_col)
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    taken = rows.filter(F.col(label_col).isNotNull() & vec.isNotNull() & F.coalesce(whole, F.lit(False)))
    taken = taken.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"), F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"))
    taken = written(taken.withColumn("bucket", F.pmod(F.hash("label"), F.lit(BUCKETS))), "vectors")
    anchors, candidates, n_q, n_p = _dealt(taken)
    if not n_q:
        return taken.limit(0).select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(0).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score"))
    own = lambda name: F.sequence(F.col(f"f_{name}"), F.col(f"f_{name}") + F.col(f"n_{name}") - 1)
    a, c = _pairs(anchors.withColumn("to", own("p")), candidates.filter("n_q > 0").withColumn("to", own("q")), [])
    found = a.groupBy("q", "p").cogroup(c.groupBy("c_q", "c_p")).applyInArrow(_positives(positives), POSITIVES_SCHEMA)
    best = written(_top(found, ["a_row"], positives).select("a_row", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = best.groupBy("a_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    asking = anchors.join(wanted, anchors["row"] == wanted["a_row"]).withColumn("to", every(n_p))
    a, c = _pairs(asking, candidates.withColumn("to", every(n_q)), ["positives"])
    found = a.groupBy("q", "p").cogroup(c.groupBy("c_q", "c_p")).applyInArrow(_negatives(negatives, low, high), NEGATIVES_SCHEMA)
    out = _top(found, ["a_row", "nth"], negatives).join(best, ["a_row", "nth"]).join(anchors.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id")), "a_row")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
