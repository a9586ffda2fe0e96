"""Language ID by Bayesian evidence fusion.

Evidence for each document: the likelihood of its whole text under byte-trigram models of
each language and of a uniform "und" model; the language that its markup declares; the
suffix of its address and its host, as a hierarchically smoothed prior
(global -> suffix -> domain -> host). Priors and the reliability of declarations are grouped
sums of the text posteriors over all documents; each document's own share is taken out of
its host's counts before its prior is formed.

The text models are trained on a bounded sample: about `per_lang` rows of each label, chosen
by a hash of id and text. Everything else covers all rows. The text's log likelihood is
scaled to EVIDENCE trigrams, as trigrams of a text aren't independent.

A document is rejected if it has no trigram of letters, if "und" is likeliest, or if the
best language's posterior is below `least`.

Defined cases: null text is empty and rejected; a null host, address or declaration gives
no evidence; equal posteriors go to the first language by name; rows without
or with repeated ids are judged each for itself; unclosed comments, hidden elements and quotes
of a page reach to its end or to the next bracket, in linear time; an empty table gives an empty result, an untrained language none;
other columns pass through untouched.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import free, row_hash, share, written

TABLE = 1 << 16
EVIDENCE = 100
PER_LANG = 2000
KAPPA = 20.0
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True
HIDDEN = re.compile(r"<!--|<(head|script|style|template|noscript)\b", re.I)
CLOSING = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("head", "script", "style", "template", "noscript")}
TAG = re.compile(r"<[/!?a-zA-Z]")
IN_TAG = re.compile(r"""[<>"']""")


def _trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table index of each trigram of letters and single spaces (a letter at least), and its text."""
    d = K.LOWER[data]
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = LETTER[d]
    fine = letter | K.SPACE[d]
    d = np.where(K.SPACE[d], np.uint8(32), d).astype(np.uint32)
    ok = fine[:-2] & letter[1:-1] & fine[2:]
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    ok &= owner[:-2] == owner[2:]
    idx = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    return idx[ok].astype(np.int64), owner[:-2][ok]


def _count(batches):
    for batch in batches:
        data, offs = K.text_bytes(batch.column(1))
        langs = np.array(batch.column(0).to_pylist(), object)
        total: dict = {}
        for a, b in K.chunks(offs):
            idx, owner = _trigrams(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            for lang in set(langs[a:b]):
                total[lang] = total.get(lang, 0) + np.bincount(idx[(langs[a:b] == lang)[owner]], minlength=TABLE)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "gram", "n"])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, id_col: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages by name, log probabilities [language, TABLE]) from about per_lang rows of each language.

    Rows are drawn by a hash of id and text: with an id, copies of one text are drawn each by itself.
    """
    rows = labelled.select((F.col(id_col) if id_col else F.lit(0)).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, TABLE), np.float32)
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & share([F.col("id"), F.col("text")], per_lang, n))
    # at most TABLE rows for each language
    found = rows.filter(keep).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts)
    table = np.full((len(langs), TABLE), 0.2)
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        table[k, own["gram"]] += own["n"]
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _scorer(logp: np.ndarray):
    logp = np.vstack([logp, np.full((1, TABLE), -np.log(TABLE), np.float32)])

    def score(text: pa.Array) -> pa.Array:
        data, offs = K.text_bytes(text)
        parts = [np.zeros((0, len(logp) + 1))]
        for a, b in K.chunks(offs):
            idx, owner = _trigrams(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            n = np.bincount(owner, minlength=b - a)
            scale = np.minimum(1.0, EVIDENCE / np.maximum(n, 1))
            parts.append(np.column_stack([*(np.bincount(owner, weights=row[idx], minlength=b - a) * scale for row in logp), n]))
        out = np.vstack(parts)
        width = out.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), pa.array(out.ravel()))

    return F.arrow_udf(score, "array<double>")


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def declared_language(markup: Column) -> Column:
    """Two-letter language of the first html element's lang attribute; null where there is none."""
    page = F.lower(markup)
    element = F.substring_index(F.substring(page, F.locate("<html", page), F.length(page)), ">", 1)
    found = F.when(page.contains("<html"), F.regexp_extract(element, r"^<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2})", 1))
    return F.when(found != "", found)


def _without_hidden(page: str) -> str:
    """The page with a space in place of each comment, head, script, style, template and noscript element."""
    out, at, seek = [], 0, 0
    while m := HIDDEN.search(page, seek):
        if not m[1]:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        else:
            open_end = page.find(">", m.end())
            if open_end < 0:  # no element can open from here on; comments still can
                start = page.find("<!--", m.end())
                if start < 0:
                    break
                seek = start
                continue
            closing = CLOSING[m[1].lower()].search(page, open_end + 1)
            end = closing.end() if closing else len(page)
        out += [page[at : m.start()], " "]
        at = seek = end
    out.append(page[at:])
    return "".join(out)


def _tag_end(page: str, start: int, failed: set[int]) -> int:
    """End of the tag at `start` whose quoted values may hold brackets; -1 where quotes and brackets don't close.

    failed: places outside quotes from which no tag ends. A scan stops at one of these, so all
    scans of a page together read it a bounded number of times.
    """
    at, passed = start + 2, []
    while True:
        m = IN_TAG.search(page, at)
        if m and m[0] == ">":
            return m.end()
        end = page.find(m[0], m.end()) if m and m[0] != "<" else -1
        at = end + 1
        if end < 0 or at in failed:
            failed.update(passed)
            return -1
        passed.append(at)


def visible(page: str) -> str:
    """One page's text, in time that grows with its length."""
    page = _without_hidden(page)
    out, at, last, failed = [], 0, page.rfind(">"), set()
    while (m := TAG.search(page, at)) and m.start() < last:
        end = _tag_end(page, m.start(), failed)
        out += [page[at : m.start()], " "]
        at = end if end > 0 else page.find(">", m.start()) + 1
    out.append(page[at:])
    return html.unescape("".join(out))


def visible_text(markup: Column) -> Column:
    """Text of a page without its head, scripts, styles, comments and tags, character references decoded."""

    def show(pages: pa.Array) -> pa.Array:
        return pa.array((None if x is None else visible(x) for x in (v.as_py() for v in pages)), pa.string())

    return F.arrow_udf(show, "string")(markup)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), r"https?://([^/:?#\s]+)", 1)
    return F.when(found != "", found)


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], key: dict[str, Column], text: Column, host: Column | None = None, declared: Column | None = None, least: float = 0.5
) -> DataFrame:
    """The columns of `key` with lang, posterior, accepted for each row of docs.

    host may have dots (suffix and domain are taken from it) or none. All of host and
    declared may be null.
    """
    langs, logp = model
    none = F.lit(None).cast("string")
    scored = docs.select(*[c.alias(f"_k_{n}") for n, c in key.items()], _scorer(logp)(F.coalesce(text, F.lit(""))).alias("s"), (none if host is None else host).alias("host"), (none if declared is None else declared).alias("declared"))
    scored = written(scored, "scored")
    names, size = [*langs, "und"], len(langs) + 1
    scored = scored.withColumn("n", F.col("s")[size]).withColumn("ll", F.slice("s", 1, size))
    scored = scored.withColumn("p", softmax(F.col("ll"))).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    sums = lambda *by: scored.filter("n > 0").groupBy(*by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(size)]).alias("c"), F.count(F.lit(1)).cast("double").alias("m"))
    smooth = lambda c, m, up: F.zip_with(c, up, lambda x, u: (x + KAPPA * u) / (m + KAPPA))
    every = sums().select(F.transform("c", lambda x: (F.coalesce(x, F.lit(0.0)) + 1) / (F.col("m") + size)).alias("g"))
    by_suffix = sums("suffix").filter("suffix <> ''").crossJoin(F.broadcast(every)).select("suffix", smooth(F.col("c"), F.col("m"), F.col("g")).alias("ps"))
    by_domain = sums("domain", "suffix").filter("domain <> ''").join(by_suffix, "suffix").select("domain", smooth(F.col("c"), F.col("m"), F.col("ps")).alias("pd"))
    hosts = sums("host", "domain").filter("host is not null").join(by_domain, "domain", "left").crossJoin(F.broadcast(every))
    hosts = written(hosts.select("host", F.col("c").alias("hc"), F.col("m").alias("hm"), F.coalesce("pd", "g").alias("up")), "hosts")
    # P(declared | language) from the posteriors of all rows that declare one: at most 26 * 26 rows
    said = sums("declared").filter("declared is not null")
    lang_total = said.agg(F.array(*[F.coalesce(F.sum(F.col("c")[i]), F.lit(0.0)) for i in range(size)]).alias("ct"))
    said = written(said.crossJoin(F.broadcast(lang_total)).select("declared", F.zip_with("c", "ct", lambda x, t: F.log((x + 0.5) / (t + 0.5 * 26 * 26))).alias("pl")), "declared")
    out = scored.join(hosts, "host", "left").join(F.broadcast(said), "declared", "left").crossJoin(F.broadcast(every))
    own = F.zip_with("hc", "p", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    prior = F.when(F.col("hm").isNull(), F.col("g")).otherwise(smooth(own, F.col("hm") - 1, F.col("up")))
    zero = F.array(*[F.lit(0.0)] * size)
    out = out.withColumn("f", F.zip_with(F.zip_with("ll", prior, lambda a, b: a + F.log(b)), F.coalesce("pl", zero), lambda a, b: a + b)).withColumn("q", softmax(F.col("f")))
    best = F.array_position("q", F.array_max("q")).cast("int")
    lang = F.when(F.col("n") > 0, F.element_at(F.array(*[F.lit(x) for x in names]), best)).otherwise("und")
    out = out.withColumn("lang", lang).withColumn("posterior", F.when(F.col("n") > 0, F.array_max("q")).otherwise(0.0))
    return out.select(*[F.col(f"_k_{n}").alias(n) for n in key], F.col("lang").alias("lang_id"), "posterior", ((F.col("lang") != "und") & (F.col("posterior") >= least)).alias("accepted"))


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source", **kwargs) -> DataFrame:
    """Documents: trained on their own labels, the source as host, declarations within the text."""
    text = F.col(text_col)
    return identify(docs, train(docs, text_col, lang_col, id_col=id_col), {"id": F.col(id_col), "t": row_hash(text)}, text, F.col(host_col), declared_language(text), **kwargs)


def identify_pages(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **kwargs) -> DataFrame:
    """Pages: their visible text, the host of their address, the language that their markup declares."""
    return identify(pages, model, {"id": F.col(id_col)}, visible_text(F.col(html_col)), host_of(F.col(url_col)), declared_language(F.col(html_col)), **kwargs)


def keep_accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """docs without the rows that language ID rejects; columns unchanged."""
    i, t = free(docs, "i", "t")
    bad = identify_documents(docs, id_col, text_col, **kwargs).filter("not accepted")
    bad = written(bad.select(F.col("id").alias(i), F.col("t").alias(t)).distinct(), "rejected")
    return docs.join(bad, (F.col(id_col).eqNullSafe(F.col(i))) & (row_hash(F.col(text_col)) == F.col(t)), "left_anti")
