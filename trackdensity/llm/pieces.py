"""SentencePiece encoding and decoding over a relational lattice.

1. Whole texts become `_` + text with spaces as `_` (U+2581) and are cut into units at
   places that no piece of the table spans, so units encode alone. Distinct units are
   counted over all documents.
2. The lattice, for the at most HEAD most frequent units (of at most LONGEST characters):
   explode substrings of bounded length, equi-join them to the piece table (fixed size),
   group the edges by unit, and fold them with Spark's higher-order `aggregate`.
   For a model of unigram scores the fold is Viterbi. The dealt vocabulary is a table of
   ranked merges, for which the best sum of scores is not what its library gives; there the
   fold over the same lattice applies the best-ranked edge that spans two neighbouring
   segments until none is left, which gives the library's ids exactly.
3. The units and their ids (at most HEAD rows of LONGEST characters, so of bounded size) go
   to the tasks, which replace each unit of each whole text by its ids; units are looked up by
   hash and compared byte by byte. Units beyond the table (rare or long ones) go through the
   same merges in the task, over the piece table: both ways give the same ids, none is dropped.
4. Decoding puts the pieces' bytes one after the other and drops the first space.

Defined cases: null or empty text has no ids and decodes to empty; U+2581 in a text counts
as a space, as in the library; characters without a piece become byte pieces; rows that
repeat a doc_id are rows of their own; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import written

HEAD = 1 << 20
LONGEST = 48
STEPS = 100_000
UNITS_A_TASK = 20_000
META = "▁"
META_BYTES = META.encode()


class Pieces:
    """A piece table: texts, ids, scores, and which ASCII signs no piece has after a letter."""

    def __init__(self, texts: list[str], scores: list[float], special: set[int], first_byte: int):
        self.texts, self.scores, self.first_byte = texts, scores, first_byte
        self.normal = {t: i for i, t in enumerate(texts) if i not in special}
        self.most = max(map(len, self.normal))
        floor = min(scores[i] for i in self.normal.values()) - 1
        self.best = {t: scores[i] - floor for t, i in self.normal.items()}  # above 0, in the order of the scores
        pairs = {(a, b) for t in self.normal for a, b in zip(t, t[1:], strict=False)}
        letters = {a for a, _ in pairs if ord(a) >= 128 or a.isalpha()} - {META}
        self.alone = np.zeros(256, bool)  # ASCII signs that stand in no longer piece
        self.after = np.zeros(256, bool)  # ASCII signs that stand after no letter in a piece
        for b in [*range(0x20), *range(0x21, 0x7F)]:
            c = chr(b)
            self.alone[b] = not any(c in p for p in pairs)
            self.after[b] = not c.isalpha() and not any((a, c) in pairs for a in letters)
        raw = [bytes([i - first_byte]) if first_byte <= i < first_byte + 256 else b"" if i in special else t.replace(META, " ").encode() for i, t in enumerate(texts)]
        self.raw_offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = p.vocab_size()
        special = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i)}
        first = min(i for i in range(n) if p.is_byte(i))
        return cls([p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], special, first)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, float(self.scores[i])) for t, i in self.normal.items()]
        return spark.createDataFrame(rows, "piece string, id int, score double")

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit by ranked merges: highest score first, then leftmost."""
        part, scores, ids = list(unit), self.scores, self.normal
        if len(part) <= 32:
            best = self.best
            pair = [best.get(a + b, 0.0) for a, b in zip(part, part[1:], strict=False)]
            while pair and (top := max(pair)) > 0:
                k = pair.index(top)
                part[k : k + 2] = [part[k] + part[k + 1]]
                del pair[k]
                if k:
                    pair[k - 1] = best.get(part[k - 1] + part[k], 0.0)
                if k < len(pair):
                    pair[k] = best.get(part[k] + part[k + 1], 0.0)
            return [i for p in part for i in ((ids[p],) if p in ids else [self.first_byte + b for b in p.encode()])]
        nxt, prv = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list = []

        def offer(a: int) -> None:
            b = nxt[a]
            if b < len(part) and (i := ids.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-scores[i], a, part[a], part[b]))

        for a in range(len(part)):
            offer(a)
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = nxt[a]
            if part[a] != x or b >= len(part) or part[b] != y:
                continue
            part[a], part[b], nxt[a] = x + y, "", nxt[b]
            if nxt[b] < len(part):
                prv[nxt[b]] = a
            offer(a)
            if prv[a] >= 0:
                offer(prv[a])
        out = []
        for p in part:
            if p:
                out += [ids[p]] if p in ids else [self.first_byte + b for b in p.encode()]
        return out


def _prepared(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a space before each text that isn't empty, and U+2581 as a space."""
    raw = data.tobytes()
    if META_BYTES in raw:
        texts = [raw[a:b].replace(META_BYTES, b" ") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    size = np.diff(offs)
    new = offs + np.concatenate([[0], np.cumsum(size > 0)])
    out = np.full(new[-1], 0x20, np.uint8)
    keep = np.ones(new[-1], bool)
    keep[new[:-1][size > 0]] = False
    out[keep] = data
    return out, new


def _units(data: np.ndarray, offs: np.ndarray, alone: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the units and their texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.zeros(n, bool)
    begin[offs[:-1][np.diff(offs) > 0]] = True
    space, lone = data == 0x20, alone[data]
    letter = (data >= 128) | ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    begin[1:] |= (space[1:] & ~space[:-1]) | lone[1:] | lone[:-1] | (letter[:-1] & after[data[1:]])
    s = np.flatnonzero(begin)
    return s, np.searchsorted(offs, s, "right") - 1


def _spans(data: np.ndarray, offs: np.ndarray, alone: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each unit."""
    s, doc = _units(data, offs, alone, after)
    return s, np.append(s[1:], len(data))[: len(s)], doc


def _count(alone: np.ndarray, after: np.ndarray):
    def run(batches):
        for batch in batches:
            data, offs = K.text_bytes(batch.column(0))
            for a, b in K.chunks(offs, 2 << 20, 1 << 30):
                d, o = _prepared(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                s, e, _ = _spans(d, o, alone, after)
                code, first, _ = K.distinct(d, s, e)
                n = np.bincount(code, minlength=len(first))
                size = e[first] - s[first]
                at = K.ragged(s[first], size)[1]
                unit = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(d[at]))])
                yield pa.RecordBatch.from_arrays([unit, pa.array(n)], names=["unit", "n"])

    return run


def lattice(units: DataFrame, pieces: DataFrame, longest_piece: int, first_byte: int, merges: bool = True) -> DataFrame:
    """(unit, ids) of distinct units (column unit, spaces as they are)."""
    cuts = f"""inline(flatten(transform(sequence(1, length(unit)), i -> transform(sequence(i, least(i + {longest_piece - 1}, length(unit))),
      j -> struct(i - 1 as lo, j as hi, substring(shown, i, j - i + 1) as piece)))))"""
    # the exchange of the distinct units serves the grouping of their edges too
    # (a few bytes for each unit, so the number of partitions is set by rows, not by bytes)
    units = units.repartition(max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // UNITS_A_TASK)), "unit")
    edges = units.select("unit", F.translate("unit", " ", META).alias("shown")).select("unit", F.expr(cuts))
    found = edges.join(F.broadcast(pieces), "piece")  # the piece table has a fixed size
    key = F.col("lo") * 1000 + F.col("hi")
    grouped = found.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct("score", "id")))).alias("e"))
    # units without any edge (no character has a piece) come back with byte pieces alone
    grouped = units.join(grouped, "unit", "left").withColumn("e", F.coalesce("e", F.expr("cast(map() as map<int, struct<score:double,id:int>>)")))
    if merges:
        fold = """aggregate(sequence(1, length(unit)), sequence(0, length(unit)), (c, step) -> if(size(c) < 3, c,
          aggregate(array(array_min(transform(sequence(1, size(c) - 2), t -> struct(-coalesce(e[c[t - 1] * 1000 + c[t + 1]].score, double('-inf')) as cost, c[t] as cut)))), c,
            (keep, best) -> if(best.cost = double('inf'), keep, array_remove(keep, best.cut)))))"""
    else:
        # Viterbi: for each end, the best score and the cut before it, over the edges and single characters
        fold = f"""aggregate(sequence(1, length(unit)), array(struct(0D as s, array(0) as c)), (v, j) -> array_append(v,
          array_max(transform(sequence(greatest(0, j - {longest_piece}), j - 1), i -> struct(
            v[i].s + coalesce(e[i * 1000 + j].score, if(i = j - 1, -1e6D, double('-inf'))) as s, array_append(v[i].c, j) as c)))), v -> element_at(v, -1).c)"""
    # one pass for every character's bytes where it has no piece
    spell = f"""flatten(transform(sequence(1, size(cuts) - 1), t -> if(e[cuts[t - 1] * 1000 + cuts[t]] is not null, array(e[cuts[t - 1] * 1000 + cuts[t]].id),
      transform(filter(split(regexp_replace(hex(encode(substring(unit, cuts[t - 1] + 1, cuts[t] - cuts[t - 1]), 'UTF-8')), '(..)', '$1 '), ' '), x -> x <> ''), x -> int(conv(x, 16, 10)) + {first_byte}))))"""
    return grouped.withColumn("cuts", F.expr(fold)).select("unit", F.expr(spell).alias("ids"))


class Known:
    """Units and their ids, found by hash and compared by bytes."""

    def __init__(self, units: pa.Array, ids: pa.ListArray):
        data, offs = K.text_bytes(units)
        h = K.span_hash(data, offs[:-1], offs[1:])
        order = np.argsort(h, kind="stable")
        ends = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy(zero_copy_only=False).astype(np.uint32)
        self.h, self.data = h[order], data
        self.start, self.size = offs[:-1][order], np.diff(offs)[order]
        self.ids_start, self.n_ids, self.ids = ends[:-1][order], np.diff(ends)[order], flat

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each span's unit, and whether there is one (of units of one hash, the first alone is found)."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        there = (self.h[at] == h) & (self.size[at] == size)
        i = np.flatnonzero(there)
        there[i] = K.same_bytes(data, start[i], self.data, self.start[at[i]], size[i])
        return at, there


def unit_table(docs: DataFrame, table: Pieces, text_col: str = "text", head: int = HEAD) -> Known:
    """The frequent units and their ids, by the lattice. At most `head` units."""
    spark = docs.sparkSession
    counted = docs.select(text_col).mapInArrow(_count(table.alone, table.after), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counted = written(counted.filter(F.length("unit") <= LONGEST), "units")
    # the smallest count so that at most `head` units reach it, from the largest counts down
    # (at most STEPS of them are read, so beyond those the table holds fewer units)
    steps = counted.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(STEPS).collect()
    total = np.cumsum([r["k"] for r in steps])
    fits = int(np.searchsorted(total, head, "right"))
    least = 1 if fits == len(steps) < STEPS else steps[fits - 1]["n"] if fits else None
    chosen = counted.filter(F.lit(False) if least is None else F.col("n") >= least).select("unit")
    found = lattice(chosen, table.frame(spark), table.most, table.first_byte).toArrow()
    whole = lambda name, kind: pa.concat_arrays([pa.array([], kind), *(x.cast(kind) for x in found.column(name).chunks)])
    return Known(whole("unit", pa.large_string()), whole("ids", pa.list_(pa.int32())))


class _Local:
    """Ids of units outside the table, by the same merges, met so far in a task."""

    def __init__(self, table: Pieces):
        self.table, self.known = table, {}

    def ids(self, raw: bytes) -> list[int]:
        if (found := self.known.get(raw)) is None:
            if len(self.known) > 150_000:
                self.known.clear()
            found = self.known[raw] = self.table.merge(raw.decode("utf-8", "replace").replace(" ", META))
        return found


def _encode(shared):
    def run(batches):
        known, table = shared.value
        local = _Local(table)
        for batch in batches:
            data, offs = K.text_bytes(batch.column(1))
            for a, b in K.chunks(offs):
                d, o = _prepared(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                s, e, doc = _spans(d, o, table.alone, table.after)
                code, first, h = K.distinct(d, s, e)
                at, there = known.find(d, s[first], (e - s)[first], h)
                rest = np.flatnonzero(~there)
                more = [local.ids(d[s[i] : e[i]].tobytes()) for i in first[rest]]
                size_of = np.zeros(len(first), np.int64)
                size_of[there], size_of[rest] = known.n_ids[at[there]], [len(x) for x in more]
                flat = np.concatenate([known.ids[K.ragged(known.ids_start[at[there]], size_of[there])[1]], np.fromiter((x for y in more for x in y), np.uint32)])
                order = np.append(np.flatnonzero(there), rest)
                from_of = np.zeros(len(first), np.int64)
                from_of[order] = np.cumsum(size_of[order]) - size_of[order]
                size = size_of[code]
                ids = flat[K.ragged(from_of[code], size)[1]]
                count = np.bincount(doc, weights=size, minlength=b - a).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(count)])
                yield batch.column(0).slice(a, b - a), ids, ends, (data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])

    return run


def _rows_of_ids(shared):
    coded = _encode(shared)

    def run(batches):
        for ids_col, ids, ends, _ in coded(batches):
            yield pa.RecordBatch.from_arrays([ids_col.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return run


def decode_ids(table: Pieces, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and their offsets."""
    size = (table.raw_offs[1:] - table.raw_offs[:-1])[ids]
    at = np.repeat(table.raw_offs[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out = table.raw[at]
    offs = np.concatenate([[0], np.cumsum(size)])[ends]
    keep = np.ones(len(out), bool)
    full = np.diff(offs) > 0
    keep[offs[:-1][full]] = False
    return out[keep], offs - np.concatenate([[0], np.cumsum(full)])


def _digests(shared, with_ids: bool):
    """Encode, decode, compare: a row for each text."""
    coded = _encode(shared)

    def run(batches):
        table = shared.value[1]
        for ids_col, ids, ends, (data, offs) in coded(batches):
            back, back_offs = decode_ids(table, ids.astype(np.int64), ends)
            wide = ids.astype("<u4")
            n = len(ids_col)
            crc = [zlib.crc32(wide[ends[i] : ends[i + 1]].tobytes()) for i in range(n)]
            texts = [back[back_offs[i] : back_offs[i + 1]].tobytes() for i in range(n)]
            same = [t == data[offs[i] : offs[i + 1]].tobytes().replace(META_BYTES, b" ") for i, t in enumerate(texts)]
            out = {"doc_id": ids_col.cast(pa.int64()), "n_tokens": pa.array(np.diff(ends)), "ids_crc32": pa.array(crc, pa.int64()), "decoded_crc32": pa.array([zlib.crc32(t) for t in texts], pa.int64()), "round_trip": pa.array(same, pa.bool_())}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _shared(docs: DataFrame, table: Pieces, text_col: str, head: int):
    # at most `head` units of at most LONGEST characters, and the piece table
    return docs.sparkSession.sparkContext.broadcast((unit_table(docs, table, text_col, head), table))


def encode(docs: DataFrame, table: Pieces, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, ids."""
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_rows_of_ids(_shared(docs, table, text_col, head)), "doc_id long, ids array<int>")


def decode(coded: DataFrame, table: Pieces) -> DataFrame:
    """doc_id, text of doc_id, ids."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in lists.to_pylist()])])
            back, offs = decode_ids(table, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([back[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, table: Pieces, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit), decoded_crc32 (UTF-8), round_trip; with_ids: ids too."""
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_digests(_shared(docs, table, text_col, head), with_ids), schema)
