"""Line dedup over overlapping three-line windows, in DataFrame operations only.

Every three consecutive lines (separator ``\\n``) form a window with a 128-bit hash. Over
all documents the first position (smallest doc_id, then smallest line) of each window
stays; every later occurrence covers its three lines, overlapping covers merge into spans, and
covered lines go. Windows are judged on the input, not on what is left.

Defined cases: null text is empty text; documents of fewer than three lines have no window
and stay as they are; windows of empty lines count as any other; a null doc_id comes before
all others; rows that repeat a doc_id are documents of their own (order: doc_id, then a hash of
the text), and of rows equal in both all but one lose every line (if they have a window);
an empty table gives an empty result; other columns pass through untouched, and where one is
named like a column of ours, ours gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, repeats, written

WINDOW = 3


def _key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"))


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")


def line_windows(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """doc (doc_id, hash of the text), line, h1, h2 of every window."""
    parts = ", ".join(f"l[i + {k}]" for k in range(window))
    pairs = f"transform(sequence(0, size(l) - {window}), i -> struct(xxhash64({parts}) as h1, xxhash64(17, {parts}) as h2, i as line))"
    rows = docs.select(_key(id_col, text_col).alias("doc"), _lines(text_col).alias("l"))
    return rows.filter(F.size("l") >= window).select("doc", F.inline(F.expr(pairs)))


def covered_lines(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """doc and the ascending first lines of its windows that occur earlier, for documents that have some."""
    all_windows = line_windows(docs, id_col, text_col, window)
    place = F.struct("doc", "line")
    # equal windows meet as partial minima: a window that a third of all rows hold is one row for each task
    repeated = all_windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "first")
    repeated = written(repeated, "windows")
    # the table of repeated windows holds each key once, so adaptive skew handling may split the other side
    later = all_windows.join(repeated, ["h1", "h2"]).filter(place > F.col("first"))
    return later.select("doc", "line").groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("at"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with text rebuilt from the lines that stay, and n_lines, n_removed_lines added as last columns.

    Rows without a covered line keep their text (a null stays null).
    """
    n_lines, n_removed = free(docs, "n_lines", "n_removed_lines")
    again = repeats(docs, id_col)
    hit = written(covered_lines(docs, id_col, text_col, window), "covered")
    # rows go as one struct, so none of their columns meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(id_col, text_col).alias("doc"))
    # the same join at every size: the table of covered lines grows with the corpus
    rows = rows.join(hit.hint("merge"), "doc", "left").withColumn("l", F.split(F.coalesce(F.col("row")[text_col], F.lit("")), "\n"))
    if again:  # the join has dealt and sorted the rows by doc already
        nth = F.row_number().over(Window.partitionBy("doc").orderBy("doc"))
        every = F.expr(f"sequence(0, size(l) - {window})")
        rows = rows.withColumn("nth", nth).withColumn("at", F.when((F.col("nth") > 1) & (F.size("l") >= window), every).otherwise(F.col("at")))
    # what lies between the ends of the merged spans: from `window` lines after one start up to the next
    between = f"""transform(sequence(0, size(at)), k -> struct(
      if(k = 0, 0, at[k - 1] + {window}) as a, if(k = size(at), size(l), at[k]) as b))"""
    spans = F.expr(f"filter({between}, s -> s.a < s.b)")
    rows = rows.withColumn("spans", F.when(F.col("at").isNotNull(), spans))
    left = F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)")
    kept = F.expr("array_join(flatten(transform(spans, s -> slice(l, s.a + 1, s.b - s.a))), '\n')")
    text = F.when(F.col("at").isNotNull(), kept).otherwise(F.col("row")[text_col])
    return rows.select(
        *[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns],
        F.size("l").cast("long").alias(n_lines), F.when(F.col("at").isNotNull(), F.size("l") - left).otherwise(0).cast("long").alias(n_removed),
    )
