"""Rows without ids, with repeated ids, and sizes beyond any sample's grid."""

import random
import time
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackdensity.llm import decontaminate, language_id, queries, shared, token_output, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    words = "the quick brown fox jumps over a lazy dog while seven grey wizards brew strong tea".split()
    rng = random.Random(4)
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(12)]
    return [(i, t, "en", "s", len(t)) for i, t in zip([None, None, 4, 4, 4, 5, None, 6, 6, 7, 8, 9], texts)] + [(None, None, None, None, None), (5, "", "en", "s", 0), (4, texts[2], "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("most", [2_000, 4_000])
def test_samples_do_not_depend_on_the_size_of_the_table(spark, most):
    n = 20_000_000_000  # as if there were so many rows; a hundredth of them is looked at
    assert abs(spark.range(n // 100).filter(shared.share([F.col("id")], most, n)).count() - most / 100) < 5 * (most / 100) ** 0.5
    assert spark.range(1000).filter(shared.share([F.col("id")], most, 1000)).count() == 1000


def test_training_reads_about_as_many_rows_of_any_table(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(language_id, "share", lambda keys, most, of: asked.append((most, of)) or shared.share(keys, most, of))
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text that all rows share").alias("text"), F.lit("en").alias("lang"))
    seen = []
    monkeypatch.setattr(language_id, "_count", lambda batches: iter(()))
    language_id.train(many, per_lang=300, id_col="doc_id")
    assert asked == [(300, 3000)] and 200 < many.filter(shared.share([F.col("doc_id"), F.col("text")], 300, 3000)).count() < 400 and not seen


def test_tokens_of_rows_without_ids(spark, docs, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = token_output.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert "/tables-" in path
    got = token_output.read_tokens(spark, path).orderBy("start").collect()
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows]
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for (i, *_), x in zip(rows, ids))
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    # starts are those of the files: the whole sequence, cut there, has these ids
    recs = [x.asDict() for x in spark.read.schema(token_output.RECORD_SCHEMA).parquet(path).orderBy("shard", "first").collect()]
    flat = [int(i) for x in recs for i in token_output.decode_record(x)]
    assert all(crc(flat[r.start : r.start + r.n_tokens]) == r.ids_crc32 for r in got)


def test_shards_follow_the_ids(spark, docs, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_IDS", 40)
    monkeypatch.setattr(token_output, "MOST_SHARDS", 5)
    path = token_output.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert 1 < spark.read.parquet(path).select("shard").distinct().count() <= 5
    assert token_output.read_tokens(spark, path).count() == 15


def test_clean_rows_without_ids_stay(spark):
    item = "nine purple owls argue about the price of winter boots in paris"
    rows = [(None, "a b"), (None, f"x {item} y"), (4, "clean words"), (4, item), (5, None), (None, "a b")]
    docs = spark.createDataFrame([(i, t, "c", "c", 0) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame([(None, item), (3, item), (None, None)], "item_id long, text string")
    assert Counter((r.doc_id, r.text) for r in decontaminate.decontaminate(docs, bench).collect()) == Counter([(None, "a b"), (None, "a b"), (4, "clean words"), (5, None)])
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(None, None), (None, 3), (4, None), (4, 3)}


def test_toxicity_of_rows_without_ids(spark, tmp_path, docs):
    texts = ["you awful horrid fool"] * 8 + ["a kind and gentle note"] * 8
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1), (None, None, None, None, None), (3, texts[9], "en", "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(16)] * 3 + [(None, 1), (1, 0)], "doc_id long, toxic int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == 19 and all(r.held_out is not None and 0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    once = toxicity.train(d, labels.distinct())
    again = toxicity.train(d, labels)
    assert (once[0] == again[0]).all() and once[1] == again[1]
    assert toxicity.score(docs.limit(0), again).count() == 0 and toxicity.train(docs.limit(0), labels.limit(0))[1] == 0.0


def test_languages_of_rows_without_ids(spark, rows, docs):
    out = language_id.identify_documents(docs).collect()
    assert Counter(r.id for r in out) == Counter(r[0] for r in rows)
    kept = language_id.keep_accepted(docs).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((r[0], r[1]) for r in rows if r[1])
    assert language_id.identify_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<a ", "<script ", "<!-- ", '<a "', "<a '\"", "<html ", "</a x='>", "<style>", "<a \">' "])
def test_pages_of_open_tags_take_linear_time(part):
    took = []
    for n in (100_000, 600_000):
        start = time.process_time()
        language_id.visible(part * n)
        took.append(time.process_time() - start)
    assert took[1] < 15 * max(took[0], 0.02)


def test_declared_language_of_a_long_page(spark):
    start = time.time()
    page = spark.range(1).select(F.concat(F.repeat(F.lit("<html "), 800_000), F.lit("lang=de>")).alias("h"), F.lit("<p><HTML\nclass='x' LANG = 'fr-CH'><html lang=de>").alias("g"))
    r = page.select(language_id.declared_language(F.col("h")).alias("h"), language_id.declared_language(F.col("g")).alias("g"), language_id.declared_language(F.lit("<htm lang=de>")).alias("n")).first()
    assert tuple(r) == ("de", "fr", None) and time.time() - start < 20


def test_memtables_follow_the_rows_whatever_the_ids(spark, monkeypatch):
    from trackdensity.llm import exact_dedup

    def flushes(ids):
        rows = spark.createDataFrame([(i, f"text {k % 40}") for k, i in enumerate(ids)], "doc_id long, text string")
        done = []
        flush = exact_dedup._flush
        monkeypatch.setattr(exact_dedup, "_flush", lambda e: done.append(1) or flush(e))
        out = exact_dedup.exact_dedup(rows, memtable_rows=50, fan=4).collect()
        monkeypatch.setattr(exact_dedup, "_flush", flush)
        assert all(r.group_size == sum(k % 40 == j % 40 for j in range(300)) for r, k in ((r, ids.index(r.doc_id)) for r in out))
        return len(done)

    rng = random.Random(1)
    assert flushes(list(range(300))) == flushes([rng.getrandbits(63) - 2**62 for _ in range(300)]) <= 2


def test_a_conversation_of_many_turns(spark):
    from trackdensity.llm import chat_format

    n = 100_000
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    turns = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), chat_format.text_part(F.concat(F.lit("say < \\ "), F.col("id"))).alias("parts"))
    start = time.time()
    r = chat_format.read_chat(chat_format.format_chat(turns)).select(F.size("turns").alias("n"), "loss_text", F.element_at("turns", n).alias("last")).first()
    took = time.time() - start
    assert r.n == n and r.loss_text == "".join(f"say < \\ {i}" for i in range(1, n, 2)) and tuple(r.last) == ("assistant", f"say < \\ {n - 1}")
    assert took < 60
