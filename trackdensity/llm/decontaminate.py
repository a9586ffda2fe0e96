"""Benchmark decontamination: n-gram and rare-word seeds, then Smith-Waterman alignment.

1. The score of a document and an item is their best Smith-Waterman alignment over words
   (match 2, mismatch -1, gap -1) / (2 * words of the item); pairs of `threshold` or more
   are kept.
2. Seeds of an item of L words are all its word n-grams, however common, and its k rarest
   words (by occurrences in the corpus). An alignment without n consecutive matches has a
   break after every n - 1 matches at most, so to reach the threshold it matches so many
   words that at most k - 1 of the item's are left out: one of any k is matched. So every
   pair that brute force finds has a seed; which words are taken is a matter of speed only.
3. A seed's hit fixes a window of the document that holds every alignment through it that
   reaches the threshold. Windows with too few of the item's words are ruled out, as each
   match needs one; the others are aligned.

Items go to the tasks in slices of at most about BENCH_BYTES of text, two passes over the
texts for each: one counts the items' words, one finds and aligns.

Defined cases: null text is empty; words are lower-cased A-Z; items of fewer words than the
n-gram seed with their whole sequence only; empty items and empty tables give no pairs; in
the report rows that repeat a doc_id or item_id, or have none, are one document or item with the
best score; decontaminate() judges each row by itself, also those without or with repeated ids;
repeated item texts are reported for each item_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import free, row_hash, written

NGRAM, THRESHOLD = 3, 0.5
BENCH_BYTES = 8 << 20
BITS = (1 << 22) - 1


def _grams(h: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and the places where all k are of one text."""
    m = max(0, len(h) - k + 1)
    g = np.zeros(m, np.uint64)
    for j in range(k):
        g = K.mix(g * K.U(0x100000001B3) + h[j : j + m])
    return g, np.flatnonzero(owner[:m] == owner[k - 1 :][:m])


def least_matches(size: int, n: int, threshold: float) -> int:
    """Fewest matched words with which an alignment without n consecutive ones reaches the threshold."""
    reach = lambda m: 2 * m - (-(-m // (n - 1)) - 1) >= 2 * threshold * size
    return next((m for m in range(1, size + 1) if reach(m)), size + 1) if n > 1 else size + 1


class Bench:
    """A slice of the items: their words, seeds by hash, and how many matches each needs."""

    def __init__(self, ids: pa.Array, text: pa.Array, n: int, threshold: float):
        data, offs = K.text_bytes(text)
        self.ids, self.n, self.threshold = ids, n, threshold
        self.words, _, _, self.owner = K.words(K.LOWER[data], offs)
        self.size = np.bincount(self.owner, minlength=len(ids))
        self.first = np.cumsum(self.size) - self.size
        self.at = np.arange(len(self.words)) - self.first[self.owner]
        self.vocab, self.word = np.unique(self.words, return_inverse=True)
        by_size = {s: least_matches(s, n, threshold) for s in set(self.size.tolist())}
        self.unbroken = np.array([by_size[s] for s in self.size.tolist()], np.int64)
        self.need = np.ceil(threshold * self.size - 1e-9).astype(np.int64)
        self.margin = max(0, math.ceil(2 * (1 - threshold)))

    def seed(self, count: np.ndarray) -> None:
        """count: occurrences of each of vocab. Seeds by their number of words: sorted hashes, item, place."""
        self.seeds = {}
        for k in range(1, self.n + 1):
            g, at = _grams(self.words, self.owner, k)
            at = at[(self.size[self.owner[at]] == k) | (k == self.n)]
            self.seeds[k] = (g[at], self.owner[at], self.at[at], np.ones(len(at), bool))
        order = np.lexsort((self.at, count[self.word], self.owner))
        place = np.arange(len(order)) - self.first[self.owner[order]]
        own = self.owner[order]
        rare = order[(place < self.size[own] - self.unbroken[own] + 1) & (self.size[own] >= self.n)]
        more = (_grams(self.words[rare], np.zeros(len(rare)), 1)[0], self.owner[rare], self.at[rare], np.zeros(len(rare), bool))
        self.seeds[1] = tuple(np.concatenate(x) for x in zip(self.seeds[1], more, strict=True))
        for k, seeds in list(self.seeds.items()):
            order = np.argsort(seeds[0], kind="stable")
            self.seeds[k] = tuple(x[order] for x in seeds)
            if not len(order):
                del self.seeds[k]

    def index(self, h: np.ndarray) -> np.ndarray:
        """Each word's number in vocab, -1 for others."""
        if not len(self.vocab):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at, -1)

    def windows(self, h: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, first and last word (exclusive) of each window that may reach the threshold."""
        rows = [np.zeros((0, 4), np.int64)]
        for k, (hashes, item, at, whole) in self.seeds.items():
            g, ok = _grams(h, doc, k)
            ok = ok[self.bits[k][(g[ok] & K.U(BITS)).astype(np.int64)]]
            a, b = np.searchsorted(hashes, g[ok], "left"), np.searchsorted(hashes, g[ok], "right")
            r, s = K.ragged(a, b - a)
            pos = ok[r]
            cell = (pos - first[doc[pos]] - at[s]) // self.size[item[s]]
            # a window counts once; "whole" (0) sorts before "rare word" (1)
            rows.append(np.column_stack([doc[pos], item[s], cell, 1 - whole[s]]))
        found = np.unique(np.concatenate(rows), axis=0)
        found = found[np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(1)])[: len(found)]]
        d, item, cell, rare = found.T
        size = self.size[item]
        lo = np.maximum(first[d] + (cell - self.margin) * size, first[d])
        hi = np.minimum(first[d] + (cell + 2 + self.margin) * size, end[d])
        number = self.index(h)
        known = np.flatnonzero(number >= 0)
        keys = np.append(np.sort((number[known] << 32) + known), np.iinfo(np.int64).max)
        r, w = K.ragged(self.first[item], size)
        want = self.word[w] << 32
        held = np.bincount(r, weights=keys[np.searchsorted(keys, want + lo[r])] < want + hi[r], minlength=len(d))
        fine = held >= np.where(rare == 1, self.unbroken[item], self.need[item])
        return d[fine], item[fine], lo[fine], hi[fine]


def _texts(batches):
    for batch in batches:
        data, offs = K.text_bytes(batch.column(1))
        known = batch.columns[0], batch.columns[2]
        for a, b in K.chunks(offs):
            yield [x[a:b] for x in known], b - a, K.words(K.LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a]), offs[a:b] - offs[a]


def _count(bench: Bench):
    def run(batches):
        n = np.zeros(len(bench.vocab), np.int64)
        for _, _, (h, _, _, _), _ in _texts(batches):
            at = bench.index(h)
            n += np.bincount(at[at >= 0], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["word", "n"])

    return run


def smith_waterman(a: np.ndarray, b: np.ndarray) -> float:
    """Best local alignment of two sequences of word hashes: match 2, mismatch -1, gap -1."""
    steps = np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(b == x, 2, -1), row[1:] - 1)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
        row, best = new, max(best, int(new.max()))
    return best


def _align(bench: Bench):
    def run(batches):
        bench.bits = {}
        for k, seeds in bench.seeds.items():
            bench.bits[k] = np.zeros(BITS + 1, bool)
            bench.bits[k][(seeds[0] & K.U(BITS)).astype(np.int64)] = True
        for known, n, (h, s, e, doc), base in _texts(batches):
            first, end = np.searchsorted(doc, np.arange(n)), np.searchsorted(doc, np.arange(n), "right")
            best: dict = {}
            for d, item, lo, hi in zip(*(x.tolist() for x in bench.windows(h, doc, first, end)), strict=True):
                size = int(bench.size[item])
                b = bench.words[bench.first[item] : bench.first[item] + size]
                score = smith_waterman(b, h[lo:hi]) / (2 * size)
                if score >= bench.threshold:
                    row = (score, -int(s[lo] - base[d]), int(e[hi - 1] - base[d]))
                    best[d, item] = max(best.get((d, item), row), row)
            if best:
                at, item = (np.array(x) for x in zip(*best, strict=True))
                score, start, stop = (np.array(x) for x in zip(*best.values(), strict=True))
                yield pa.RecordBatch.from_arrays([*(x.take(pa.array(at)) for x in known), bench.ids.take(pa.array(item)), pa.array(score, pa.float64()), pa.array(-start), pa.array(stop)], names=["doc_id", "t", "item_id", "score", "start_byte", "end_byte"])

    return run


def _pairs(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float) -> DataFrame:
    """doc_id, t (hash of the text), item_id, score, start_byte, end_byte of the best passage of each pair of a row and an item."""
    items = bench.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("item_text")).dropDuplicates()
    items = written(items, "items")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_hash(F.col(text_col)).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-size // BENCH_BYTES))
    scored = None
    for k in range(slices):
        # at most about BENCH_BYTES of items
        part = items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(slices)) == k).orderBy("item_id", "item_text").toArrow().combine_chunks()
        ids = pa.array(part["item_id"].to_pylist(), pa.int64())  # an item may have no id
        own = Bench(ids, pa.array(part["item_text"].to_pylist(), pa.large_string()), ngram, threshold)
        count = np.zeros(len(own.vocab), np.int64)
        # at most one row for each word of the slice
        for r in text.mapInArrow(_count(own), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
            count[r["word"]] = r["n"]
        own.seed(count)
        found = text.mapInArrow(_align(own), "doc_id long, t long, item_id long, score double, start_byte long, end_byte long")
        scored = found if scored is None else scored.union(found)
    return scored


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, start_byte, end_byte (best passage) of each contaminated pair."""
    scored = _pairs(docs, bench, id_col, text_col, ngram, threshold)
    best = F.max(F.struct(F.col("score"), (-F.col("start_byte")).alias("s"), "end_byte"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", (-F.col("b.s")).alias("start_byte"), "b.end_byte")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the contaminated rows, each known by its id and a hash of its text; columns unchanged."""
    i, t = free(docs, "i", "t")
    found = _pairs(docs, bench, id_col, text_col, ngram, threshold).select(F.col("doc_id").alias(i), F.col("t").alias(t))
    bad = written(found.distinct(), "leaks").hint("merge")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(i)) & (row_hash(F.col(text_col)) == F.col(t)), "left_anti")
