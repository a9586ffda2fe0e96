"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, hard_negatives, language_id, line_dedup, near_dedup, pieces, secret_scan, substring_dedup, token_alignment, token_output, toxicity
from .shared import table, written


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = toxicity.train(docs, labels.filter(~rest(F.col("doc_id"))))
    out = toxicity.score(docs, model)
    return out.select("doc_id", rest(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_sentences", "worst_start_byte", "worst_score")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_output.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_output.read_tokens(spark, path)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    turns = rows.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    back = chat_format.read_chat(written(chat_format.format_chat(turns), "chats"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify_documents(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "lang_id", "posterior", F.col("accepted").alias("kept"))


def op8_page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify_pages(table(spark, sf_dir, "pages"), language_id.train(table(spark, sf_dir, "documents"), id_col="doc_id"))
    return out.select(F.col("id").alias("page_id"), "lang_id", "posterior", F.col("accepted").alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle_words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align(table(spark, sf_dir, "documents"), a, b)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_sentencepiece, op3_substring_dedup, op4_toxicity, op5_token_output, op6_chat_format, op7_line_dedup, op8_language_id, op8_page_language_id, op9_near_dedup, op10_decontaminate, op11_token_alignment, op12_hard_negatives, op13_secret_scan)}

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over w keep_id, count(*) over w group_size, doc_id = min(doc_id) over w kept, text_sha256
from t window w as (partition by text_sha256)""",
    "op6_chat_format": r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(replace(replace(x, '\', '\b'), '<', '\l')) nx, length(replace(replace(replace(r, '\', '\b'), '<', '\l'), '"', '\q')) nr from c)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256,
  coalesce(sum(case when r = 'assistant' then length(x) end), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(case when r = 'assistant' then x end, '' order by turn, r, x), '')) loss_sha256,
  sum(24 + nx + nr)::bigint formatted_chars
from e group by conv_id""",
    "op7_line_dedup": r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l, text from documents),
w as (select doc_id, i, l[i] || chr(10) || l[i+1] || chr(10) || l[i+2] g from (select doc_id, l, unnest(range(1, len(l) - 1)) i from d)),
f as (select doc_id, i, row_number() over (partition by g order by doc_id, i) rn from w),
c as (select distinct doc_id, unnest([i, i+1, i+2]) n from f where rn > 1),
a as (select doc_id, list(n) cs from c group by doc_id)
select d.doc_id, len(l)::bigint n_lines, coalesce(len(cs), 0)::bigint n_removed_lines,
  sha256(case when cs is null then coalesce(text, '') else array_to_string([l[k] for k in range(1, len(l) + 1) if not list_contains(cs, k)], chr(10)) end) kept_sha256
from d left join a using (doc_id)""",
    "op12_hard_negatives": """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, [floor(256 * x::double) for x in embedding] v
  from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id aid, b.vec_id bid, a.lab = b.lab same, list_dot_product(a.v, b.v)::bigint s from r a, r b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select aid, bid, s from s where same qualify row_number() over (partition by aid order by s desc, bid) <= 5)
select p.aid anchor_id, p.bid positive_id, (row_number() over w)::int "rank", n.bid negative_id, p.s positive_score, n.s negative_score
from p join s n on n.aid = p.aid and not n.same and 80 * p.s <= 100 * n.s and 100 * n.s <= 100 * p.s
window w as (partition by p.aid, p.bid order by n.s desc, n.bid) qualify row_number() over w <= 5""",
}
