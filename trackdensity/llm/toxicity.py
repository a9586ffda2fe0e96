"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels.

A sentence (split at ``. ! ?`` and line ends) has probability sigmoid(bias + sum of the
weights of its distinct word features); a document is toxic unless all of its sentences are
clean: 1 - prod(1 - p). Features are hashes of lower-cased words and of their first four and
five bytes.

Training reads a bounded sample: about `max_rows` labelled rows, half of each label where
there are so many, chosen by a hash of doc_id. Every feature of LEAST_DOCS documents whose counts
differ between the labels by LEAST_Z standard errors (by Spark's grouped counts) enters; the
noisy-or likelihood is then climbed on what the sample holds of those. Scoring covers every row and whole texts and
reports the sentence that offends most.

Defined cases: null or empty text has one empty sentence and scores the bias; no labelled
rows, or one label only, gives every document the smoothed share of label 1; a label that
repeats counts once, one of each kind for a doc_id counts as both; a null doc_id has no label, and its
row is scored like others; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import share

TABLE = 1 << 20
MAX_ROWS = 8_000
LEAST_DOCS, LEAST_Z = 5, 3.0
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
STOP = np.zeros(256, bool)
STOP[[ord(x) for x in ".!?\n\r"]] = True


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence) distinct pairs; document of each sentence; start byte of each sentence."""
    n_docs = len(offs) - 1
    low = K.LOWER[data]
    s, e, doc = K.spans(LETTER[low], offs)
    # a sentence begins at each text's start and after each stop that has a word before it in its text
    stops = np.cumsum(STOP[low])
    place = np.where(s > 0, stops[np.maximum(s - 1, 0)], 0) if len(s) else s
    first = np.ones(len(s), bool)
    first[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    sent = np.cumsum(first) - 1
    sent_doc, sent_start = doc[first], s[first]
    feats = [K.span_hash(low, s, e)] + [K.mix(K.span_hash(low, s, np.minimum(s + k, e)) + K.U(k)) for k in (4, 5)]
    f = np.concatenate([x & K.U(TABLE - 1) for x in feats]).astype(np.int64)
    pair = np.unique((np.tile(sent, 3).astype(np.int64) << 20) | f)
    bare = np.setdiff1d(np.arange(n_docs), sent_doc)  # texts without words: one empty sentence each
    return pair & (TABLE - 1), pair >> 20, np.concatenate([sent_doc, bare]), np.concatenate([sent_start, offs[:-1][bare]])


def _presence(batches):
    """(feature, label) of each document once, counted within the batch."""
    for batch in batches:
        data, offs = K.text_bytes(batch.column(1))
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in K.chunks(offs):
            f, sent, sent_doc, _ = _features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            seen = np.unique((sent_doc[sent] << 20) | f)
            key, n = np.unique(((seen & (TABLE - 1)) << 1) | toxic[a:b][seen >> 20], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(key & 1), pa.array(n)], names=["f", "toxic", "n"])


def _bags(chosen: np.ndarray):
    def run(batches):
        for batch in batches:
            data, offs = K.text_bytes(batch.column(1))
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in K.chunks(offs):
                f, sent, sent_doc, _ = _features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                own = np.isin(f, chosen)
                f, sent = f[own], sent[own]
                n_sent = np.bincount(sent_doc, minlength=b - a)
                order = np.lexsort((sent, sent_doc[sent]))
                f, sent = f[order], sent[order]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(sent_doc[sent], minlength=b - a))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(n_sent), pa.ListArray.from_arrays(ends, pa.array(f.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(sent.astype(np.int32)))],
                    names=["toxic", "n_sent", "f", "s"],
                )

    return run


def _climb(bags, chosen: np.ndarray, steps: int = 400, rate: float = 0.08, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights of the chosen features and bias that climb the noisy-or likelihood."""
    n_docs = bags.num_rows
    y, n_sent = (bags.column(c).to_numpy().astype(float) for c in ("toxic", "n_sent"))
    f, local = (pc.list_flatten(bags.column(c)).to_numpy().astype(np.int64) for c in ("f", "s"))
    f = np.searchsorted(chosen, f)
    doc_of = np.repeat(np.arange(n_docs), pc.list_value_length(bags.column("f")).to_numpy())
    _, inst = np.unique(doc_of * (1 << 32) + local, return_inverse=True)
    n_inst = int(inst.max()) + 1 if len(inst) else 0
    inst_doc = np.zeros(n_inst, np.int64)
    inst_doc[inst] = doc_of
    bare = n_sent - np.bincount(inst_doc, minlength=n_docs)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        z = np.bincount(inst, weights=theta[f], minlength=n_inst) + theta[-1]
        p, p0 = sig(z), sig(theta[-1])
        clean = np.bincount(inst_doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n_docs) + bare * np.log1p(-p0)
        doc_p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d loglik / d clean: toxic -(1-p)/p, clean 1; and d clean / d z = -p of the sentence
        outer = weight * np.where(y == 1, -(1 - doc_p) / doc_p, 1.0)
        g_inst = outer[inst_doc] * -p
        g = np.concatenate([np.bincount(f, weights=g_inst[inst], minlength=len(chosen)), [g_inst.sum() + (outer * bare * -p0).sum()]])
        g[:-1] -= decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta[-1] = min(theta[-1], -4.0)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """(weight of each feature of the table, bias). labels: doc_id, toxic."""
    labels = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and _id is not null").distinct()
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.zeros(TABLE, np.float32)
    if len(counts) < 2:
        toxic = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return weights, float(np.log(toxic / (1 - toxic)))
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("toxic") == y) & share([F.col("_id")], max_rows / 2, n))
    # about max_rows ids: a documented bound, so they may go to every task
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(labels.filter(keep)), "_id").select("toxic", "text")
    seen = rows.mapInArrow(_presence, "f long, toxic long, n long").groupBy("f").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum("n").alias("n"))
    total = {y: min(n, max_rows / 2) for y, n in counts.items()}
    rate = total[1] / (total[0] + total[1])
    z = (F.col("n1") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    # rows of the sample are bounded, and so are their features
    best = seen.filter(F.col("n") >= LEAST_DOCS).filter(F.abs(z) >= LEAST_Z).select("f").toPandas()
    chosen = np.sort(best["f"].to_numpy(np.int64))
    bags = rows.mapInArrow(_bags(chosen), "toxic long, n_sent long, f array<int>, s array<int>").toArrow()
    if len(set(bags.column("toxic").to_pylist())) < 2:
        return weights, -6.0
    weights[chosen], bias = _climb(bags, chosen)
    return weights, bias


def _scorer(weights, bias: float):
    def run(batches):
        w = weights.value
        for batch in batches:
            data, offs = K.text_bytes(batch.column(1))
            for a, b in K.chunks(offs):
                f, sent, sent_doc, start = _features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                z = np.bincount(sent, weights=w[f], minlength=len(sent_doc)) + bias
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                clean = np.bincount(sent_doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=b - a)
                order = np.lexsort((start, -p, sent_doc))
                top = order[np.searchsorted(sent_doc[order], np.arange(b - a))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(-np.expm1(clean)), pa.array(np.bincount(sent_doc, minlength=b - a)), pa.array(start[top] - (offs[a:b] - offs[a])), pa.array(p[top])],
                    names=["doc_id", "score", "n_sentences", "worst_start_byte", "worst_score"],
                )

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, worst_start_byte, worst_score (where the most offending sentence begins)."""
    weights = docs.sparkSession.sparkContext.broadcast(model[0])  # TABLE floats, 4 MB
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_scorer(weights, model[1]), "doc_id long, score double, n_sentences long, worst_start_byte long, worst_score double")
