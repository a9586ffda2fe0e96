"""Chat formatting with typed content parts, in DataFrame operations only.

A conversation is its rows by turn; each row has an array of parts
``struct<type, text, ref, width, height, seconds, pages>``. A visitor walks the parts in
order: text parts are escaped, every image, audio and document part becomes an ordered
placeholder ``<image 1/>``, with its reference and the number of tokens it will expand to.

The template: ``<turn role="R">\\nTEXT\\n</turn>\\n``. In texts and roles ``\\`` becomes
``\\b``, ``<`` becomes ``\\l`` and ``"`` (roles only) ``\\q``, so no control string can occur
inside, and replacing ``\\l`` and ``\\q`` before ``\\b`` restores them.

Defined cases: null text, role or part is empty; turns of equal number go in order of role,
then of their parts (by type, then unescaped text); rows that repeat are turns of their own; a
null conv_id is a conversation; unknown part types are treated as documents of zero pages; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TAIL = "\n</turn>\n"
PATCH, AUDIO_TOKENS_S, PAGE_TOKENS = 14, 25, 256


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\q"), F.lit('"')), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def visit(parts: Column) -> Column:
    """Struct of text (with placeholders) and found (attachments) of an array of parts, in one fold over it."""

    def tokens(p: Column) -> Column:
        image = F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH)
        audio = F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_TOKENS_S)
        pages = F.coalesce(p["pages"], F.lit(0)).cast("long") * PAGE_TOKENS
        return F.when(p["type"] == "image", image).when(p["type"] == "audio", audio).otherwise(pages).cast("long")

    def step(acc: Column, p: Column) -> Column:
        kind = F.when(p["type"].isin("image", "audio"), p["type"]).otherwise(F.lit("document"))
        k = (F.size(acc["found"]) + 1).cast("int")
        placeholder = F.concat(F.lit("<"), kind, F.lit(" "), k.cast("string"), F.lit("/>"))
        entry = F.struct(k.alias("ordinal"), kind.alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens"))
        is_text = F.coalesce(p["type"], F.lit("text")) == "text"
        return F.struct(
            F.concat(acc["text"], F.when(is_text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder)).alias("text"),
            F.when(is_text, acc["found"]).otherwise(F.concat(acc["found"], F.array(entry))).alias("found"),
        )

    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<ordinal:int,type:string,ref:string,tokens:bigint>>").alias("found"))
    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), start, step)


def format_chat(turns: DataFrame) -> DataFrame:
    """From conv_id, turn, role, parts: conv_id, formatted, loss_spans, attachments, attachment_tokens.

    loss_spans are [start, end) code points of assistant texts in `formatted`. Attachments
    are in order of turns; their ordinals count from 1 within each turn.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), "parts").withColumn("v", visit(F.col("parts")))
    header = F.concat(F.lit('<turn role="'), F.replace(escape(F.col("role")), F.lit('"'), F.lit("\\q")), F.lit('">\n'))
    rows = rows.withColumn("x", F.concat(header, F.col("v.text"), F.lit(TAIL)))
    # where each turn ends in the whole text: running lengths, so that spans cost one look each
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("to", F.sum(F.length("x")).over(order))
    one = F.struct("to", "turn", "role", "x", F.length("v.text").alias("n"), F.col("v.found").alias("found"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    end = lambda x: x["to"] - len(TAIL)
    spans = F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct((end(x) - x["n"]).cast("int").alias("start"), end(x).cast("int").alias("end")))
    found = F.flatten(F.transform("t", lambda x: F.transform(x["found"], lambda a: F.struct(x["turn"].alias("turn"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = convs.select("conv_id", F.array_join(F.transform("t", lambda x: x["x"]), "").alias("formatted"), spans.alias("loss_spans"), found.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Read back: conv_id, turns (array of role, text, unescaped), loss_text, formatted_chars.

    Placeholders stay in the text as they stand. Turns and spans are met by their place in the
    text (a span begins where a turn's text begins), so the work is in proportion to the text.
    """
    pieces = F.filter(F.split("formatted", TAIL), lambda x: x != "")
    turns = formatted.select(F.col("conv_id").alias("conv"), F.posexplode(pieces).alias("nth", "x"))
    order = Window.partitionBy("conv").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    body = F.regexp_replace("x", r'^<turn role="[^"]*">\n', "")
    turns = turns.withColumn("to", F.sum(F.length("x") + len(TAIL)).over(order)).withColumn("body", body).withColumn("start", (F.col("to") - len(TAIL) - F.length("body")).cast("int"))
    masked = formatted.select(F.col("conv_id").alias("of"), F.explode("loss_spans").alias("s")).select("of", F.col("s.start").alias("at"), (F.col("s.end") - F.col("s.start")).alias("n"))
    met = turns.join(masked, F.col("conv").eqNullSafe(F.col("of")) & (F.col("start") == F.col("at")), "left")
    role = unescape(F.regexp_extract("x", r'^<turn role="([^"]*)">\n', 1))
    said = F.when(F.col("n").isNotNull(), unescape(F.expr("substring(body, 1, n)")))
    back = met.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("nth", role.alias("role"), unescape(F.col("body")).alias("text"), said.alias("loss")))).alias("t"), F.max("to").alias("formatted_chars"))
    out = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    loss = F.array_join(F.filter(F.transform("t", lambda x: x["loss"]), lambda x: x.isNotNull()), "")
    return back.select(F.col("conv").alias("conv_id"), out.alias("turns"), loss.alias("loss_text"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
