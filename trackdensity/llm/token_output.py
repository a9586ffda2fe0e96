"""Token ids in a grammar-compressed binary format (Re-Pair), written and read by Spark.

1. Encode whole texts with the tokenizers library; each distinct unit (a run of letters, a
   digit, a run of other signs; or a whole word where these rules could differ from the
   tokenizer's own, as in words that may hold a special token) is encoded once for each
   worker and known by its bytes. END closes each document.
2. Range-partition by doc_id. Each partition is a shard; its ids are cut into records of
   whole documents of about RECORD ids. In each record Re-Pair repeatedly replaces frequent
   pairs by nonterminals (never across END), the most frequent first and all whose symbols
   don't meet in one round, until no pair occurs LEAST times or ids run out.
3. A record holds its place in the shard, doc_ids, each document's offset in the compressed sequence and in ids,
   the rules, each rule's expansion length, and the sequence: any document decodes alone.

Shards have about SHARD_IDS ids each, and more where there would be over MOST_SHARDS of them (their
bounds and sizes are what the driver holds); memory is that of one record and one document.

Defined cases: null text is empty, its ids are END alone; rows without a doc_id come first; rows
that repeat a doc_id are documents one after the other (order of their ids' bytes); an empty table writes and reads
an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import new_path, written

END = 2
FIRST_RULE = 49_408  # ids below are the vocabulary's; those up to 65,535 are free for nonterminals
RECORD = 1 << 20
CHUNK_BYTES = 1 << 20
LEAST = 24  # a rule takes 12 bytes and saves 2 at each place
SHARD_IDS, MOST_SHARDS, BLOCK = 1 << 22, 20_000, 1024
UNITS_KEPT = 1_000_000
RECORD_SCHEMA = "shard long, first long, n_docs long, n_null long, doc_ids binary, seq_offs binary, id_offs binary, rules binary, lengths binary, seq binary"

LETTER, DIGIT = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(97, 123)]] = True
DIGIT[[*range(48, 58)]] = True
_made: dict[str, Units] = {}


class Units:
    """Ids of the distinct units met so far in this worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.offs, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def find(self, units: list[bytes], whole: list[bool]) -> np.ndarray:
        """Number of each unit (lower-cased bytes, or the bytes of a whole word)."""
        if len(self.at) > UNITS_KEPT:
            self.clear()
        at = self.at
        which = [at.get(u, -1) for u in units]
        new = [i for i, k in enumerate(which) if k < 0]
        if new:
            found = []
            for i in new:
                raw = units[i]
                if whole[i]:
                    found.append(self.tok.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids)
                else:
                    found.append([t.id for t in self.tok.model.tokenize("".join([self.char[b] for b in raw]))])
                which[i] = at[raw] = len(at)
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, np.fromiter((x for y in found for x in y), np.uint16)])
        return np.array(which, np.int64)


def _units(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, text number and whole-word mark of each unit, and the bytes, lower-cased but for whole words."""
    low = K.LOWER[raw]
    n = len(low)
    lead = low == 0xC3
    tail = np.zeros(n, bool)
    tail[1:] = lead[:-1] & (low[1:] >= 0x80)
    sign = tail & ((low == 0x97) | (low == 0xB7))
    low = np.where(tail & (low <= 0x9E) & ~sign, low + np.uint8(0x20), low)
    letter = LETTER[low] | lead | (tail & ~sign)
    odd = ((low >= 0x80) & ~lead & ~tail) | sign | (low == 0x27) | (low < 9) | ((low > 13) & (low < 32)) | (low == 127)
    odd[:-1] |= (low[:-1] == ord("<")) & (low[1:] == ord("|"))  # may begin a special token
    ws, we, _ = K.spans(K.WORD[low], offs)
    bad = np.concatenate([[0], np.cumsum(odd)])
    whole = bad[we] > bad[ws]
    # within plain words, letters run on, digits stand alone, other signs run on
    kind = np.where(letter, 1, np.where(DIGIT[low], 2, np.where(K.WORD[low], 3, 0))).astype(np.int8)
    if whole.any():
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, ws[whole], 1)
        np.add.at(inside, we[whole], -1)
        word = np.cumsum(inside[:-1]) > 0
        kind[word] = 4
        low = np.where(word, raw, low)
    begin = kind > 0
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begin |= edge[:-1] & (kind > 0)
    s = np.flatnonzero(begin)
    stop = np.flatnonzero(begin | (kind == 0))
    e = np.append(stop, n)[np.searchsorted(stop, s, "right")]
    return s, e, np.searchsorted(offs, s, "right") - 1, kind[s] == 4, low


def _take(offs: np.ndarray, ids: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id lists numbered `which`, one after the other, and their lengths."""
    size = offs[which + 1] - offs[which]
    at = np.repeat(offs[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return ids[at], size


def encode_texts(path: str, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with END after each text, offsets of the texts)."""
    units = _made.setdefault(path, None) or _made.__setitem__(path, Units(path)) or _made[path]
    n_docs = len(offs) - 1
    s, e, doc, whole, low = _units(raw, offs)
    code, first, _ = K.distinct(low, s, e)
    bounds = zip(s[first].tolist(), e[first].tolist(), strict=True)
    text = low.tobytes()
    which = units.find([text[a:b] for a, b in bounds], whole[first].tolist())
    ids, size = _take(units.offs, units.ids, which[code])
    per_doc = np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64)
    out = np.full(len(ids) + n_docs, END, np.uint16)
    out[np.arange(len(ids)) + np.repeat(np.arange(n_docs), per_doc)] = ids
    return out, np.concatenate([[0], np.cumsum(per_doc + 1)])


def _encode(path: str):
    def run(batches):
        for batch in batches:
            data, offs = K.text_bytes(batch.column(1))
            for a, b in K.chunks(offs, CHUNK_BYTES):
                ids, at = encode_texts(path, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * 2).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), binary], names=["doc_id", "ids"])

    return run


def re_pair(seq: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(compressed sequence, rules [k, 2]) of ids below FIRST_RULE; END joins no pair."""
    seq, rules = seq.astype(np.uint16), []
    while len(seq) > 1 and FIRST_RULE + len(rules) < 1 << 16:
        often = np.bincount(seq, minlength=1 << 16) >= least  # a frequent pair has frequent symbols
        often[END] = False
        known, a, b = often[seq], seq[:-1], seq[1:]
        fine = known[:-1] & known[1:]
        twin = np.flatnonzero(fine & (a == b))
        if len(twin):  # of a run of equal ids every second place counts, from the left
            first = np.flatnonzero(np.append(True, np.diff(twin) > 1))
            begin = np.repeat(twin[first], np.diff(np.append(first, len(twin))))
            fine[twin[(twin - begin) % 2 == 1]] = False
        pair = a.astype(np.uint32) << 16 | b
        keys = np.sort(pair[fine])
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        freq, keys = np.diff(np.append(cut, len(keys))), keys[cut]
        if not len(freq) or freq.max() < least:
            break
        top = np.flatnonzero(freq >= least)
        lefts, rights, made = set(), set(), []
        for p in keys[top[np.lexsort((keys[top], -freq[top]))]].tolist():
            x, y = p >> 16, p & 0xFFFF
            # no symbol ends one pair and begins another, so occurrences cannot overlap
            if x not in rights and y not in lefts and FIRST_RULE + len(rules) + len(made) < 1 << 16:
                lefts.add(x)
                rights.add(y)
                made.append(p)
        chosen = np.array(made, np.uint32)
        order = np.argsort(chosen)
        left, right = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        left[chosen >> 16], right[chosen & 0xFFFF] = True, True
        near = np.flatnonzero(fine & left[a] & right[b])
        k = order[np.minimum(np.searchsorted(chosen[order], pair[near]), len(order) - 1)]
        own = chosen[k] == pair[near]
        hit = near[own]
        seq = seq.copy()
        seq[hit] = (FIRST_RULE + len(rules) + k[own]).astype(np.uint16)
        rules += made
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
    table = np.array(rules, np.uint32)
    return seq, np.column_stack([table >> 16, table & 0xFFFF]).astype(np.uint16)


def lengths(rules: np.ndarray) -> np.ndarray:
    """Number of ids that each rule stands for."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append(sum(out[x - FIRST_RULE] if x >= FIRST_RULE else 1 for x in (a, b)))
    return np.array(out, np.int64)


def expand(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that a (part of a) compressed sequence stands for; only the rules in it are read."""
    while (deep := seq >= FIRST_RULE).any():
        size = deep.astype(np.int64) + 1
        at = np.cumsum(size) - size
        out = np.repeat(seq, size)
        pair = rules[seq[deep] - FIRST_RULE]
        out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def _pack(batches):
    shard, before = TaskContext.get().partitionId(), 0

    def record(ids: list[int], parts: list[bytes]):
        whole = np.frombuffer(b"".join(parts), np.uint16)
        seq, rules = re_pair(whole)
        # END joins no pair, so the sequence holds as many as the ids; a text may hold that id too
        last = np.cumsum([int((np.frombuffer(p, np.uint16) == END).sum()) for p in parts]) - 1
        ends = np.flatnonzero(seq == END)[last] + 1
        id_offs = np.concatenate([[0], np.cumsum([len(p) // 2 for p in parts])])
        none = sum(i is None for i in ids)  # rows without an id come first
        fields = [np.array([0] * none + ids[none:], np.int64), np.concatenate([[0], ends]), id_offs, rules.ravel(), lengths(rules), seq]
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([before]), pa.array([len(ids)]), pa.array([none]), *[pa.array([x.tobytes()], pa.binary()) for x in fields]], names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    ids, parts, size = [], [], 0
    for batch in batches:
        for i, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            parts.append(p.as_buffer().to_pybytes())
            size += len(parts[-1]) // 2
            if size >= RECORD:
                yield record(ids, parts)
                before += size
                ids, parts, size = [], [], 0
    if ids:
        yield record(ids, parts)


def expand_all(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The same for a whole sequence: every rule is expanded once."""
    flat = np.concatenate([np.arange(FIRST_RULE, dtype=np.uint16), expand((FIRST_RULE + np.arange(len(rules))).astype(np.uint16), rules)])
    offs = np.concatenate([np.arange(FIRST_RULE), FIRST_RULE + np.append(0, np.cumsum(lengths(rules)))]).astype(np.int64)
    return _take(offs, flat, seq.astype(np.int64))[0]


def decode_record(rec: dict, only: int | None = None) -> np.ndarray:
    """All ids of a record, or those of its document number `only`, from that part of the sequence alone."""
    seq, rules = np.frombuffer(rec["seq"], np.uint16), np.frombuffer(rec["rules"], np.uint16).reshape(-1, 2)
    if only is not None:
        at = np.frombuffer(rec["seq_offs"], np.int64)
        return expand(seq[at[only] : at[only + 1]], rules)
    return expand_all(seq, rules)


def _unpack(batches):
    for batch in batches:
        for rec in batch.to_pylist():
            ids = decode_record(rec)
            ends = np.frombuffer(rec["id_offs"], np.int64)
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            n = rec["n_docs"]
            ids = pa.array(np.frombuffer(rec["doc_ids"], np.int64), mask=np.arange(n) < rec["n_null"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rec["shard"])), ids, pa.array(rec["first"] + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the records of docs in ascending doc_id order; returns the folder.

    Without a path that is one of the application's own tables, which shared.clear deletes.
    """
    path = path or new_path(docs.sparkSession, "tokens")
    coded = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_encode(tokenizer), "doc_id long, ids binary")
    coded = written(coded.withColumn("size", F.octet_length("ids")), "ids")  # the sum reads this column alone
    size = coded.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"] // 2
    shards = min(MOST_SHARDS, max(1, -(-size // SHARD_IDS)))  # a shard is a task; it holds one record at a time
    coded.drop("size").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(_pack, RECORD_SCHEMA).write.parquet(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    rows = written(spark.read.schema(RECORD_SCHEMA).parquet(path).mapInArrow(_unpack, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long"), "unpacked")
    # offsets of shards in blocks of BLOCK: the only window over all has one row for each block
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("m")).withColumn("block", F.floor(F.col("shard") / BLOCK))
    blocks = sums.groupBy("block").agg(F.sum("m").alias("b")).select("block", (F.sum("b").over(Window.orderBy("block")) - F.col("b")).alias("ahead"))
    inside = F.sum("m").over(Window.partitionBy("block").orderBy("shard")) - F.col("m")
    before = sums.withColumn("inside", inside).join(blocks, "block").select("shard", (F.col("ahead") + F.col("inside")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
