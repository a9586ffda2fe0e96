"""Exact dedup by a log-structured merge index of digests, in DataFrame operations only.

1. *Memtables*: rows dealt by a hash of doc_id over as many memtables as hold MEMTABLE_ROWS rows
   each, so their number follows the rows whatever the ids are. Each is reduced to one entry for each
   digest (smallest doc_id, number of rows): pre-aggregation, so a digest that a third of
   all rows share has at most one entry for each memtable.
2. *Flush*: entries are written as runs sorted by digest, with Parquet Bloom filters on it.
3. *Compaction*: FAN neighbouring runs of a level merge into one of the next, until FAN or
   fewer are left, which merge into the index; an entry keeps the smallest doc_id.
4. *Probe*: a bitmap of FILTER_BITS bits (so of fixed size) marks the digests of several rows. Rows whose
   bit is clear are alone and need no join; the others look their digest up through their run.
5. *Hits* are compared byte by byte with the text that stays, which is dealt over salts, one for each
   SALT_ROWS hits. Rows that differ in spite of an equal digest are grouped by text.

Defined cases: null text is empty text; a null doc_id comes before all others; rows that
repeat a doc_id count one by one, each with its own text, and share keep_id and kept where
their texts are equal; an empty table gives an empty result; further columns (also ones named
like our own) stay outside the operator, which reads only id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_path, repeats, written

MEMTABLE_ROWS = 8192
FAN = 64
FILTER_BITS = 1 << 26
SALT_ROWS = 2048
FIRST_ID = -(1 << 63)  # stands for a null doc_id


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; only runs that differ from one space are touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digest_of(text: Column, chars: int = 64) -> tuple[Column, Column]:
    """(hex SHA-256 of the normalised text, its first `chars` digits as bytes)."""
    sha = F.sha2(normalised(text).cast("binary"), 256)
    return sha, F.unhex(sha) if chars == 64 else F.encode(F.substring(sha, 1, chars), "US-ASCII")


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID))


def _flush(entries: DataFrame) -> DataFrame:
    """Entries (run, digest, keep_id, n) as sorted runs with filters, read again."""
    path = new_path(entries.sparkSession, "runs")
    ordered = entries.sortWithinPartitions("run", "digest").write
    ordered.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.max.bytes", str(1 << 20)).parquet(path)
    return entries.sparkSession.read.schema(entries.schema).parquet(path)


def memtable(n: int) -> Column:
    """Number of a row's memtable, of n."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n)))


def flush_runs(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS, n: int | None = None) -> DataFrame:
    """Runs of the memtables of rows (doc_id, digest); n: how many memtables, if known."""
    run = memtable(-(-rows.count() // memtable_rows) if n is None else n).alias("run")
    return _flush(rows.groupBy(run, "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))


def compact(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """The index: one entry (digest, keep_id, n) for each digest."""
    merged = lambda *by: runs.groupBy(*by, "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    while runs.select("run").distinct().count() > fan:
        runs = _flush(merged(F.floor(F.col("run") / fan).alias("run")))
    return written(merged(), "index")


def _place(digest: str) -> Column:
    """Bit of a digest in the filter, from 1."""
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS)) + 1


def digest_filter(digests: DataFrame) -> DataFrame:
    """bucket, bits: a bitmap of the digests, FILTER_BITS bits at most."""
    return digests.select(_place("digest").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def probe(rows: DataFrame, filter_: DataFrame) -> DataFrame:
    """rows with `maybe`: whether the filter has the digest's bit."""
    bit = F.bitmap_bit_position(_place("digest")).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(_place("digest"))).join(F.broadcast(filter_), "bucket", "left")  # 8 MB at most
    held = F.call_function("shiftright", byte, F.pmod(bit, F.lit(8))).bitwiseAND(F.lit(1)) == 1
    return joined.select(*rows.columns, F.coalesce(held, F.lit(False)).alias("maybe"))


def lookup(index: DataFrame, docs: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64) -> DataFrame:
    """doc_id, keep_id for rows of a new batch whose text the indexed corpus has; bytes are compared."""
    new = docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col), digest_chars)[1].alias("digest"), normalised(F.col(text_col)).alias("text"))
    found = probe(new, digest_filter(index)).filter("maybe").drop("maybe").join(index.select("digest", "keep_id"), "digest")
    old = corpus.select(_id(id_col).alias("keep_id"), digest_of(F.col(text_col), digest_chars)[1].alias("digest"), normalised(F.col(text_col)).alias("old"))
    return found.join(old, ["keep_id", "digest"]).filter("text = old").select("doc_id", F.nullif("keep_id", F.lit(FIRST_ID)).alias("keep_id")).distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64, memtable_rows: int = MEMTABLE_ROWS, fan: int = FAN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row."""
    sha, digest = digest_of(F.col(text_col), digest_chars)
    # where ids repeat, a hash of the text tells their rows apart
    own = [_id(id_col).alias("doc_id"), *([F.xxhash64(normalised(F.col(text_col))).alias("t")] if repeats(docs, id_col) else [])]
    rows = written(docs.select(*own, sha.alias("text_sha256"), digest.alias("digest")), "digests")
    key = [c for c in ("doc_id", "t") if c in rows.columns]
    n = -(-rows.count() // memtable_rows)
    runs = flush_runs(rows, memtable_rows, n)
    index = compact(runs, fan)
    several = index.filter("n > 1")
    rows = probe(rows, digest_filter(several))
    # through the runs: keyed by run too, so a hot digest is spread
    placed = runs.select("run", "digest").join(several, "digest")
    met = rows.filter("maybe").withColumn("run", memtable(n)).join(placed, ["run", "digest"], "left").select(*rows.columns, "keep_id", "n")
    alone = rows.filter("not maybe").select(*rows.columns, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    met = met.withColumns({"keep_id": F.coalesce("keep_id", "doc_id"), "n": F.coalesce("n", F.lit(1))})
    copies = written(met.filter("n > 1").select(*key, "digest", "keep_id", "n").distinct(), "hits")
    salts = F.greatest(F.ceil(F.col("n") / SALT_ROWS), F.lit(1))
    # one shuffle of the texts, at every size, for both sides of the comparison
    text = docs.select(*own, normalised(F.col(text_col)).alias("text")).join(copies.hint("merge"), key)
    text = written(text, "texts")
    # a repeated doc_id may hold several texts of a digest: the first in text order stays
    stays = (
        text.filter("doc_id = keep_id").groupBy("digest").agg(F.min("text").alias("keep_text"), F.max("n").alias("n"))
        .select("digest", "keep_text", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    )
    hits = text.withColumn("salt", F.pmod(F.xxhash64(*key), salts))
    differ = written(hits.join(stays, ["digest", "salt"]).filter("text <> keep_text").select(*key, "digest", "text"), "differ")
    out = met.union(alone)
    if differ.limit(1).count():
        texts = differ.groupBy("digest", "text").agg(F.min("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
        moved = differ.join(texts, ["digest", "text"]).select(*key, "digest", "own_keep", "own_n").distinct()
        fewer = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
        out = out.join(moved, [*key, "digest"], "left").join(fewer, "digest", "left")
        out = out.withColumns({"keep_id": F.coalesce("own_keep", "keep_id"), "n": F.coalesce("own_n", F.col("n") - F.coalesce("less", F.lit(0)))})
    name = lambda c: F.nullif(c, F.lit(FIRST_ID)).alias(c)
    return out.select(name("doc_id"), name("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
