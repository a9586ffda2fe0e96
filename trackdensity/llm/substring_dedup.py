"""Suffix-array dedup of repeated substrings of LENGTH bytes over all documents.

A byte goes if a LENGTH-byte string covers it that also starts earlier (smaller doc_id, or
same document and earlier start), judged on the input.

1. Anchors: in every run of LENGTH - GRAM + 1 consecutive GRAM-byte strings, those of the
   smallest hash. Which they are depends on the bytes alone, so two equal LENGTH-byte strings hold the
   same anchor at the same offset. Anchors that occur once in the corpus can be in no repeat.
2. An anchor's segment is what the strings cover that it is the anchor of. Segments of an
   anchor whose 128-bit BLAKE2 digests of offset and bytes agree collapse to the first
   (partial aggregation); of all others every string is a repeat.
3. Anchors with several different segments: their segments' bytes are dealt by anchor over
   shards of bounded size. A shard's suffix array is built by induced sorting (classify, sort
   leftmost-smaller substrings by recursion, induce), permuted common prefixes of LENGTH or more
   give the groups of equal strings, and all but the first of a group are repeats.
   Anchors with over HOT different segments deal out their strings one by one instead and
   are reduced by a grouped minimum, so no shard is unbounded; both ways give the same repeats.
4. Spans of repeats merge per document.

Defined cases: null text is empty; documents shorter than LENGTH lose nothing; a null doc_id
comes before all others; rows that repeat a doc_id are documents of their own, in order of a
hash of their texts; of rows equal in both, all but one lose every byte (if LENGTH bytes or
more); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import written
from .suffix_array import permuted_lcp, suffix_array

LENGTH, GRAM = 100, 40
HOT = 16384
SHARD_BYTES = 1 << 20
FACTORS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * K.U(2) + K.U(1)
CHUNK_BYTES = 1 << 17  # texts are hashed in runs of this size, which stay in a core's cache
SEPARATOR = 0xFF  # in no UTF-8 text
PLACE = "doc long, sub long, lo int, hi int"
FIRST_ID = -(1 << 63)  # stands for a null doc_id


def _sliding(x: np.ndarray, w: int, fold) -> np.ndarray:
    """fold over each w consecutive entries (len(x) - w + 1 results)."""
    size = 1
    while size * 2 <= w:
        x = fold(x[:-size], x[size:])
        size *= 2
    return fold(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def gram_hash(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes (8 at least) from each place on."""
    m, n = K.mix(K.windows(data) + K.U(1)), len(data) - gram + 1
    out = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        out += m[at : at + n] * FACTORS[k]
    return K.mix(out)


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, least hash of the string at each start) of the anchors of whole texts."""
    n, w = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = gram_hash(data, gram) | K.U(1)
    low = _sliding(g, w, np.minimum)  # for each start of a string
    end = np.repeat(offs[1:], np.diff(offs))[: len(low)]
    low[np.arange(len(low)) + length > end] = 0  # strings that would leave their text
    pad = np.zeros(w - 1, np.uint64)
    high = _sliding(np.concatenate([pad, low, pad]), w, np.maximum)
    at = np.flatnonzero(high[: len(g)] == g)
    return at, g[at], low


def reach(at: np.ndarray, g: np.ndarray, low: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings that each anchor is the anchor of; they are consecutive."""
    if not len(at):
        return at, at
    begin = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    end = np.append(begin[1:], len(low)) - 1
    run = np.searchsorted(begin, np.maximum(at - w + 1, 0), "right") - 1
    todo = np.flatnonzero(low[begin[run]] != g)
    while len(todo):
        run[todo] += 1
        todo = todo[low[begin[run[todo]]] != g[todo]]
    return np.maximum(begin[run], at - w + 1), np.minimum(end[run], at)


def _anchor_rows(length: int, gram: int, only_hash: bool):
    """Columns text (only_hash), or doc, sub, text -> an anchor a row."""

    def run(batches):
        for batch in batches:
            data, offs = K.text_bytes(batch.column(batch.num_columns - 1))
            made = []
            for a, b in K.chunks(offs, CHUNK_BYTES):
                d, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                at, g, low = anchors(d, o, length, gram)
                if only_hash:
                    made.append(pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], names=["ah"]))
                    continue
                lo, last = reach(at, g, low, length - gram + 1)
                hi = last + length
                raw = memoryview(np.ascontiguousarray(d))
                cuts = zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)
                digest = b"".join([hashlib.blake2b(raw[x:y], digest_size=16, salt=z.to_bytes(8, "little")).digest() for x, y, z in cuts])
                s = np.frombuffer(digest, np.int64).reshape(-1, 2)
                doc = np.searchsorted(o, at, "right") - 1
                keys = [batch.column(k).slice(a, b - a).take(pa.array(doc)) for k in (0, 1)]
                made.append(pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(s[:, 0]), pa.array(s[:, 1]), *keys, *[pa.array((x - o[doc]).astype(np.int32)) for x in (lo, hi)]], names=["ah", "s1", "s2", "doc", "sub", "lo", "hi"]))
            yield from pa.Table.from_batches(made).combine_chunks().to_batches() if made else ()

    return run


def _fields(lists: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row number of each struct in a list column, and its fields."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return np.repeat(np.arange(len(size)), size), [flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _slices(batches):
    """doc, sub, text, array of places -> a row with bytes for each place."""
    for batch in batches:
        data, offs = K.text_bytes(batch.column(2))
        row, (ah, m, lo, hi) = _fields(batch.column(3), ("ah", "m", "lo", "hi"))
        keys = [batch.column(k).to_numpy(zero_copy_only=False)[row] for k in (0, 1)]
        ends = np.cumsum(hi - lo)
        cuts = np.flatnonzero(np.diff(ends // SHARD_BYTES)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True):  # bounded runs of places
            size = (hi - lo)[a:b]
            offset = np.append(0, np.cumsum(size))
            take = K.ragged(offs[row[a:b]] + lo[a:b], size)[1]
            seg = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(data[take])])
            yield pa.RecordBatch.from_arrays([pa.array(ah[a:b]), pa.array(m[a:b]), *[pa.array(k[a:b]) for k in keys], *[pa.array(x[a:b].astype(np.int32)) for x in (lo, hi)], seg], names=["ah", "m", "doc", "sub", "lo", "hi", "seg"])


def _shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        doc, sub, lo = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "sub", "lo"))
        segs = table.column("seg").to_pylist()
        size = np.array([len(s) for s in segs], np.int64)
        t = np.frombuffer(bytes([SEPARATOR]).join(segs), np.uint8)
        base = np.cumsum(size + 1) - size - 1
        # each string of a segment starts in it and fits
        seg, within = K.ragged(np.zeros(len(segs), np.int64), size - length + 1)
        start = np.full(len(t), -1, np.int64)
        start[base[seg] + within] = np.arange(len(seg))
        order = suffix_array(t)
        # suffixes that share fewer than `length` bytes with the one before them begin a group
        breaks = np.cumsum(permuted_lcp(t, order)[order] < length)
        whole = np.flatnonzero(start[order] >= 0)
        own, breaks = start[order[whole]], breaks[whole]
        group = np.flatnonzero(np.diff(breaks, prepend=-1))
        place = doc[seg], sub[seg], lo[seg] + within
        rank = np.zeros(len(seg), np.int64)
        owner = np.lexsort(place[::-1])
        rank[owner] = np.arange(len(seg))
        least = np.repeat(np.minimum.reduceat(rank[own], group), np.diff(np.append(group, len(own)))) if len(group) else rank[own]
        later = np.zeros(len(own), bool)
        for p in place:
            later |= p[own] != p[owner[least]]
        found = np.sort(own[later])
        cut = np.ones(len(found), bool)
        cut[1:] = (np.diff(found) > 1) | (seg[found[1:]] != seg[found[:-1]])
        begin = found[cut]
        end = found[np.append(np.flatnonzero(cut)[1:] - 1, len(found) - 1)] if len(found) else found
        return pa.table({"doc": place[0][begin], "sub": place[1][begin], "lo": place[2][begin].astype(np.int32), "hi": (place[2][end] + length).astype(np.int32)})

    return run


def _strings(length: int):
    """Each string that holds the anchor, for anchors of very many segments."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                k = len(r["seg"]) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["seg"][i : i + length] for i in range(k)], pa.binary()), pa.array([r["doc"]] * k, pa.int64()), pa.array([r["sub"]] * k, pa.int64()), pa.array([r["lo"] + i for i in range(k)], pa.int32())],
                    names=["s", "doc", "sub", "lo"],
                )

    return run


def _removed(batches):
    for batch in batches:
        data, offs = K.text_bytes(batch.column(1))
        row, (lo, hi) = _fields(batch.column(2), ("lo", "hi"))
        gone, count, sha = [], [], []
        for a, b in K.chunks(offs):
            d, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            i, j = np.searchsorted(row, [a, b])
            doc = row[i:j] - a
            size = np.diff(o)[doc]
            delta = np.zeros(len(d) + 1, np.int32)
            np.add.at(delta, o[doc] + np.minimum(lo[i:j], size), 1)
            np.add.at(delta, o[doc] + np.minimum(hi[i:j], size), -1)
            dead = np.cumsum(delta[:-1], dtype=np.int32) > 0
            start, end, owner = K.spans(dead, o)
            count.append(np.bincount(owner, minlength=b - a))
            gone.append(np.bincount(owner, end - start, minlength=b - a).astype(np.int64))
            kept = d[~dead]
            cut = o - np.append(0, np.cumsum(gone[-1]))
            sha += [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(np.concatenate(gone + none)), pa.array(np.concatenate(count + none)), pa.array(sha, pa.string()), batch.column(3), batch.column(4)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "doc", "sub"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(id, doc, sub, text) and whether doc_ids repeat; sub tells apart their texts, where they do."""
    again = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    sub = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if again else F.lit(0).cast("long")
    own = F.col(id_col).cast("long")
    return docs.select(own.alias("id"), F.coalesce(own, F.lit(FIRST_ID)).alias("doc"), sub.alias("sub"), F.col(text_col).alias("text")), again


def repeated_spans(text: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """From doc, sub, text: doc, sub, spans (array of lo, hi in bytes, overlapping) of documents with repeats."""
    again = text.select("text").mapInArrow(_anchor_rows(length, gram, True), "ah long").groupBy("ah").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ah")
    found = text.select("doc", "sub", "text").mapInArrow(_anchor_rows(length, gram, False), f"ah long, s1 long, s2 long, {PLACE}").join(again, "ah")
    found = written(found, "anchors", "zstd")
    place, seg = F.struct("doc", "sub", "lo", "hi"), ["ah", "s1", "s2"]
    first = written(found.groupBy(*seg).agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")), "segments", "zstd")
    # each key is once on the right, so adaptive skew handling may split a segment of many copies
    copies = found.join(first.filter("n > 1").select(*seg, "f"), seg).filter(place > F.col("f")).select("doc", "sub", "lo", "hi")
    several = first.groupBy("ah").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    ask = first.join(several, "ah").select("f.doc", "f.sub", F.struct("ah", "m", "f.lo", "f.hi").alias("p")).groupBy("doc", "sub").agg(F.collect_list("p").alias("places"))
    ask = written(ask, "asked")
    segs = written(text.join(ask.hint("merge"), ["doc", "sub"]).select("doc", "sub", "text", "places").mapInArrow(_slices, f"ah long, m long, {PLACE}, seg binary"), "bytes", "zstd")
    size = segs.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-size // SHARD_BYTES))
    cold = segs.filter(f"m <= {hot}").withColumn("shard", F.pmod(F.xxhash64("ah"), F.lit(shards)))
    by_array = cold.groupBy("shard").applyInArrow(_shard(length), PLACE)
    strings = segs.filter(f"m > {hot}").mapInArrow(_strings(length), "s binary, doc long, sub long, lo int")
    at = F.struct("doc", "sub", "lo")
    firsts = strings.groupBy("s").agg(F.min(at).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    by_string = strings.join(firsts, "s").filter(at > F.col("f")).select("doc", "sub", "lo", (F.col("lo") + length).alias("hi"))
    spans = copies.union(by_array).union(by_string)
    return spans.distinct().groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **kwargs) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each input row."""
    text, repeats = _keyed(docs, id_col, text_col)
    spans = written(repeated_spans(text, length, **kwargs), "spans")
    joined = text.join(spans.hint("merge"), ["doc", "sub"], "left").select("id", "text", "spans", "doc", "sub")
    out = joined.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, doc long, sub long")
    if repeats:  # rows equal in id and text: all but one are copies as a whole
        nth = F.row_number().over(Window.partitionBy("doc", "sub").orderBy("n_bytes"))
        copy = (nth > 1) & (F.col("n_bytes") >= length)
        out = out.withColumn("copy", copy).withColumns({"n_removed": F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.col("n_removed")), "n_spans": F.when(F.col("copy"), F.lit(1).cast("long")).otherwise(F.col("n_spans")), "kept_sha256": F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256"))})
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
