"""Alignment of two tokenizers over the same texts, and how often their ids go together in the corpus.

Each text is encoded by A (byte-level BPE, with a space before the text) and by B (SentencePiece,
which adds that space). The byte offsets where tokens of both end are the common keys of two
dictionaries from a token's cumulative end to its index; in sorted order they slice both id
lists into groups, and in each slice every A-B pair of overlapping tokens is a link.

How it runs:
* A text is cut before each lone space between two characters that are surely no white space.
  Neither tokenizer has a token across such a place (A's pattern starts a token at the space;
  no piece of B has the mark of a space behind another character), so ids, groups and links of
  a text are those of its units one after the other, and each distinct unit is aligned once
  for each worker. Units are told apart by their bytes.
* A block of about BLOCK_BYTES of texts is one row of a written table: its documents, their
  units, its distinct links and their counts. A file has FILE_BLOCKS of them, so a task
  holds no more however long its input is. Links are summed over blocks, so a frequent pair
  is one row for each block before the shuffle, and one on the other side of the join back.
* The counts go back to the blocks by a cogroup: a block's task holds that block alone.

Defined cases: a text that is null or empty, or whose joined A or B bytes differ from space+text
(it holds U+2581, or bytes that are no UTF-8), has no tokens: zeros, and '' as its groups. Ids may
be null or repeat; each row is a document. An empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import written

BLOCK_BYTES, FILE_BLOCKS = 4 << 20, 4
UNITS_KEPT, UNIT_BYTES_KEPT = 300_000, 32 << 20
DICT_SPAN = 1 << 18  # ends of so many bytes are in the dictionaries at a time
BLOCK_SCHEMA = (
    "block long, doc_ids array<long>, stats binary, groups_sha256 array<string>, doc_offs binary, doc_units binary, "
    "unit_offs binary, unit_links binary, pairs array<long>, counts array<long>"
)
OUT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_made: dict[tuple[str, str], Aligner] = {}


def slices(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int, int, int]]:
    """(a_from, a_to, b_from, b_to) of each group of two lists of rising cumulative ends.

    The dictionaries hold the ends of DICT_SPAN bytes at a time: equal ends are in the same
    span, so nothing is lost and a long text needs no dictionary of all its tokens.
    """
    out, a0, b0, i, k, low = [], 0, 0, 0, 0, 0
    last = min(a_ends[-1], b_ends[-1]) if a_ends and b_ends else 0
    while low < last:
        low += DICT_SPAN
        j, m = bisect_right(a_ends, low, i), bisect_right(b_ends, low, k)
        a_at = {end: n for n, end in enumerate(a_ends[i:j], i + 1)}
        b_at = {end: n for n, end in enumerate(b_ends[k:m], k + 1)}
        for end in sorted(a_at.keys() & b_at.keys()):
            a1, b1 = a_at[end], b_at[end]
            out.append((a0, a1, b0, b1))
            a0, b0 = a1, b1
        i, k = j, m
    return out


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all overlapping pairs of two lists of rising ends over the same bytes.

    Between two neighbouring ends of either list lies one token of each, and two tokens that
    overlap do so in one such stretch: a slice of n and m tokens has n + m - 1 links.
    """
    every = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, every), np.searchsorted(b_ends, every)


def byte_level_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary (its file's entries, decoded)."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    entries = found["model"]["vocab"] | {x["content"]: x["id"] for x in found["added_tokens"]}
    out = [b""] * (max(entries.values()) + 1)
    for text, i in entries.items():
        out[i] = bytes([byte[c] for c in text])
    return out


def piece_table(processor) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> a byte; control pieces have none."""
    out = []
    for i in range(processor.get_piece_size()):
        text = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(text[3:5], 16)]))
        else:
            out.append(b"" if processor.is_control(i) or processor.is_unknown(i) else text.replace("▁", " ").encode())
    return out


class Aligner:
    """Both tokenizers, and the alignment of each distinct unit met so far in this worker."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_bytes, self.b_bytes = byte_level_table(a_file), piece_table(self.b)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        self.stride = len(self.b_bytes)
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.held = 0
        self.groups: list[str] = []
        self.wrong: list[int] = []  # units whose joined A or B bytes differ from theirs
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.pairs: list[np.ndarray] = []  # the links of one batch of units after the other

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return list(zip([x.ids for x in a], self.b.encode(texts, num_threads=1), strict=True))

    def _differ(self, units: list[bytes], ids: list[list[int]], table: list[bytes]) -> list[int]:
        """Numbers of the units whose tokens' bytes, joined, aren't a space and the unit."""
        if b"".join([table[i] for x in ids for i in x]) == b" " + b" ".join(units) and [sum(map(len, (table[i] for i in x))) for x in ids] == [1 + len(u) for u in units]:
            return []
        return [n for n, (u, x) in enumerate(zip(units, ids, strict=True)) if b"".join([table[i] for i in x]) != b" " + u]

    def _add(self, units: list[bytes]) -> np.ndarray:
        """Aligns new units, laid end to end; returns their sizes. Each unit's end is an end of both lists."""
        first = len(self.at)
        for u in units:
            self.at[u] = len(self.at)
            self.held += len(u)
        coded = self.encode([u.decode("utf-8", "replace") for u in units])
        a, b = [x for x, _ in coded], [y for _, y in coded]
        for n in {*self._differ(units, a, self.a_bytes), *self._differ(units, b, self.b_bytes)}:
            self.wrong.append(first + n)
            a[n], b[n] = [], []
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        a, b = ([i for x in ids for i in x] for ids in (a, b))
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        cut = slices(a_ends.tolist(), b_ends.tolist())
        at, bt = self.a_text, self.b_text
        text = [f"{at[a[i]]}|{bt[b[k]]}" if j - i == 1 == m - k else f"{','.join([at[x] for x in a[i:j]])}|{','.join([bt[x] for x in b[k:m]])}" for i, j, k, m in cut]
        i, j = links(a_ends, b_ends)
        self.pairs.append(a_ids[i] * self.stride + b_ids[j])
        # of each unit the groups and links up to its last token
        last = np.cumsum(n_a)
        groups = np.searchsorted(np.array([x[1] for x in cut], np.int64), last, "right")
        linked = np.searchsorted(i, last, "left")
        start = 0
        for end in groups.tolist():
            self.groups.append(";".join(text[start:end]))
            start = end
        return np.column_stack([n_a, n_b, np.diff(groups, prepend=0), np.diff(linked, prepend=0)])

    def find(self, units: list[bytes]) -> np.ndarray:
        at = self.at
        new = list(dict.fromkeys(u for u in units if u not in at))
        if new:
            self.sizes = np.concatenate([self.sizes, *(self._add(new[k : k + 4096]) for k in range(0, len(new), 4096))])
        return np.array([at[u] for u in units], np.int64)

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of each of these units, one after the other, and how many each has."""
        if len(self.pairs) > 1:
            self.pairs = [np.concatenate(self.pairs)]
        size = self.sizes[units, 3]
        first = np.cumsum(self.sizes[:, 3])[units] - size
        _, where = K.ragged(first, size)
        return np.concatenate([np.zeros(0, np.int64), *self.pairs])[where], size


def unit_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start and end (without the space before it) and text number of each unit.

    Cut is only where the bytes on both sides begin or end a character that is surely no white
    space: ASCII from 0x21 on, or a character whose first byte is neither 0xC2 nor 0xE1 to 0xE3.
    """
    n = len(data)
    lead_ok = np.zeros(256, bool)
    lead_ok[0x21:0x7F] = True
    lead_ok[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at + 1 < n)]
    before = at - 1
    for _ in range(3):  # back to the first byte of the character before
        before = before - ((data[before] & 0xC0) == 0x80) * (before > 0)
    at = at[lead_ok[data[at + 1]] & lead_ok[data[before]]]
    doc = np.searchsorted(offs, at, "right") - 1
    inside = (at > offs[doc]) & (at + 1 < offs[doc + 1])  # the neighbours are of the same text
    at = at[inside]
    full = np.flatnonzero(np.diff(offs) > 0)
    start = np.sort(np.concatenate([offs[full], at + 1]))
    doc = np.searchsorted(offs, start, "right") - 1
    end = offs[doc + 1].copy()
    same = np.flatnonzero(doc[1:] == doc[:-1])
    end[same] = start[same + 1] - 1
    return start, end, doc


def _blocks(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _made.get((a_file, b_file)) or _made.setdefault((a_file, b_file), Aligner(a_file, b_file))
        first, n_blocks = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal held, size, n_blocks
            ids = [i for x in held for i in x[0]]
            stats, sha = np.concatenate([x[1] for x in held]), [s for x in held for s in x[2]]
            per_doc, units = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
            which, local = np.unique(units, return_inverse=True)
            times = np.bincount(local, minlength=len(which))
            flat, length = al.links_of(which)
            key, link = np.unique(flat, return_inverse=True)
            n = np.bincount(link, weights=np.repeat(times, length), minlength=len(key)).astype(np.int64)
            as_bytes = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([first + n_blocks], pa.int64()), pa.array([ids], pa.list_(pa.int64())), as_bytes(stats, "<i8"), pa.array([sha], pa.list_(pa.string())),
                    as_bytes(np.concatenate([[0], np.cumsum(per_doc)]), "<i8"), as_bytes(local, "<u4"), as_bytes(np.concatenate([[0], np.cumsum(length)]), "<i8"),
                    as_bytes(link, "<u4"), pa.array([key], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())),
                ],
                names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")],
            )
            n_blocks += 1
            held, size = [], 0
            if len(al.at) > UNITS_KEPT or al.held > UNIT_BYTES_KEPT:
                al.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, offs = K.text_bytes(batch.column(1))
            for lo, hi in K.chunks(offs, 1 << 20):
                held.append((ids[lo:hi], *_texts(al, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])))
                size += int(offs[hi] - offs[lo])
                if size >= BLOCK_BYTES:
                    yield block()
        if held:
            yield block()

    return run


def _texts(al: Aligner, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of each text n_a, n_b, n_groups, n_links, its digest and number of units; and the units' numbers."""
    s, e, doc = unit_spans(data, offs)
    code, one, _ = K.distinct(data, s, e)
    raw = memoryview(np.ascontiguousarray(data))
    number = al.find([bytes(raw[a:b]) for a, b in zip(s[one].tolist(), e[one].tolist(), strict=True)])
    units = number[code]
    n = len(offs) - 1
    per_doc = np.bincount(doc, minlength=n)
    ends = np.cumsum(per_doc)
    odd = np.unique(doc[np.isin(units, al.wrong)]) if al.wrong else []
    if len(odd):  # the whole text decides: its joined bytes differ and it has no tokens, or it is one unit
        own = np.split(units, ends[:-1])
        for d in odd.tolist():
            own[d] = al.find([raw[offs[d] : offs[d + 1]].tobytes()])
            if int(own[d][0]) in al.wrong:
                own[d] = own[d][:0]
        per_doc, units = np.array([len(x) for x in own]), np.concatenate(own)
        doc, ends = np.repeat(np.arange(n), per_doc), np.cumsum(per_doc)
    stats = np.zeros((n, 4), np.int64)
    for k in range(4):
        stats[:, k] = np.bincount(doc, weights=al.sizes[units, k], minlength=n)
    groups, listed, sha, at = al.groups, units.tolist(), [], 0
    for end in ends.tolist():
        sha.append(hashlib.sha256(";".join([groups[u] for u in listed[at:end]]).encode()).hexdigest() if end > at else "")
        at = end
    return stats, sha, per_doc, units


def _totals(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block with the sums over their links of the counts and of best ones."""
    names = [x.split()[0] for x in OUT_SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    if not block.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
    rec = block.to_pylist()[0]
    as_array = lambda name, kind: np.frombuffer(rec[name], kind)
    pos = counts["pos"].to_numpy()
    total, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    total[pos], best[pos] = counts["total"].to_numpy(), counts["best"].to_numpy()
    stats, link = as_array("stats", "<i8").reshape(-1, 4), as_array("unit_links", "<u4")
    doc_offs, unit_offs, units = as_array("doc_offs", "<i8"), as_array("unit_offs", "<i8"), as_array("doc_units", "<u4")

    def by_doc(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(x[link])])
        per_unit = run[unit_offs[1:]] - run[unit_offs[:-1]]
        run = np.concatenate([[0], np.cumsum(per_unit[units])])
        return run[doc_offs[1:]] - run[doc_offs[:-1]]

    columns = [rec["doc_ids"], *stats.T, by_doc(best), by_doc(total), rec["groups_sha256"]]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def aligned_blocks(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of blocks: ids, group digests and sizes of documents, units, links and their counts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_blocks(a_file, b_file), BLOCK_SCHEMA), "aligned", "zstd", FILE_BLOCKS)


def pair_counts(blocks: DataFrame, stride: int) -> DataFrame:
    """pair (A id times stride plus B id), total links of the pair, whether no other A id has more with its B id."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total"))
    each = written(each, "pair-counts")
    most = each.groupBy((F.col("pair") % stride).alias("b_id")).agg(F.max("total").alias("most"))
    joined = each.join(most, F.col("pair") % stride == F.col("b_id"))
    return joined.select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    blocks = aligned_blocks(docs, a_file, b_file, id_col, text_col)
    places = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("pos", "pair"))
    back = places.join(pair_counts(blocks, len(_pieces(b_file))).hint("merge"), "pair").select("of", "pos", "total", "best")
    rest = blocks.drop("pairs", "counts")
    return rest.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_totals, OUT_SCHEMA)


def alignment_table(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, n_links, is_best: how often each id pair is linked in the corpus, and whether it is its B id's most frequent."""
    stride = len(_pieces(b_file))
    found = pair_counts(aligned_blocks(docs, a_file, b_file, id_col, text_col), stride)
    return found.select(F.floor(F.col("pair") / stride).cast("int").alias("a_id"), (F.col("pair") % stride).cast("int").alias("b_id"), F.col("total").alias("n_links"), (F.col("best") == 1).alias("is_best"))


def _pieces(b_file: str) -> list[bytes]:
    import sentencepiece

    return piece_table(sentencepiece.SentencePieceProcessor(model_file=b_file))
