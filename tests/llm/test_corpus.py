import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackdensity.llm import chat_format, decontaminate, exact_dedup, kernel, language_id, line_dedup, near_dedup, pieces, substring_dedup, token_output, toxicity
from trackdensity.llm.suffix_array import permuted_lcp, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = "keep_id h _row covered n_lines n_removed_lines doc row at l nth id t i n bad _bad _i _t text_sha256 digest maybe k1 sub spans kept any score".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def base():
    rng = np.random.default_rng(3)
    syl = "the and ing tion er re st on at ou ly".split()
    word = lambda: "".join(rng.choice(syl, rng.integers(1, 4)))
    text = lambda n: ". ".join(" ".join(word() for _ in range(8)) for _ in range(n))
    out = [text(6) for _ in range(12)]
    out[4], out[5] = out[1], out[1].replace("the", "thee", 1)
    out[6] = out[2][:150] + " " + text(2) + out[3][50:220] + out[3][50:220]
    # words whose letters follow the parity of their place's binary ones: the classic breaker of polynomial hashes
    odd = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    out += [odd, odd.translate(str.maketrans("ab", "ba")), f"{odd} {odd.translate(str.maketrans('ab', 'ba'))}", "hello <|endoftext|> x", "a<|startoftext|>b <| <|ENDOFTEXT|>"]
    out += ["", None, "One", "  two  \t words ", "a" * 500, "\n\n\n\n\n\n", "é️ ﬁ 字 don't <|endoftext|> x" * 9, text(400)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", "src", 1, *["clash"] * len(CLASHES)) for i, t in enumerate(base())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in enumerate(base())}


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("chars", [64, 1])
def test_exact(docs, texts, chars):
    got = rows(exact_dedup.exact_dedup(docs, digest_chars=chars))
    plain = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts.items()}
    for i, t in plain.items():
        same = [j for j, u in plain.items() if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())


def test_exact_repeated_rows(docs):
    out = exact_dedup.exact_dedup(docs.union(docs)).collect()
    assert len(out) == 2 * docs.count() and {r.group_size for r in out if r.doc_id == 0} == {2}


def repeated(spark):
    """Rows without or with repeated doc_ids, of equal and of different texts."""
    a, b = ("\n".join(" ".join(f"{x}{i}w{k}" for k in range(9)) for i in range(4)) for x in "ab")
    rows = [(None, a), (7, a), (7, a), (7, b), (8, b), (None, None), (9, ""), (9, ""), (9, None), (10, a[:50])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_exact_null_and_repeated_ids(spark):
    given, d = repeated(spark)
    for chars, fan in ((64, 64), (1, 2)):
        got = exact_dedup.exact_dedup(d, digest_chars=chars, memtable_rows=4, fan=fan).collect()
        lowest = lambda ids: None if None in ids else min(ids)
        want = []
        for i, t in given:
            plain = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            same = [j for j, u in given if re.sub(r"[\x20\x09-\x0D]+", " ", u or "") == plain]
            want.append((i, lowest(same), len(same), i == lowest(same), hashlib.sha256(plain.encode()).hexdigest()))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_lookup(spark, docs, texts):
    index = exact_dedup.compact(exact_dedup.flush_runs(docs.select("doc_id", exact_dedup.digest_of(F.col("text"), 2)[1].alias("digest")), 4), 2)
    new = spark.createDataFrame([(100, texts[4]), (101, "not there"), (102, texts[0].replace(" ", "  "))], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.lookup(index, new, docs, digest_chars=2).collect() if r.doc_id != 101} <= {(100, 1), (102, 0)}
    full = exact_dedup.compact(exact_dedup.flush_runs(docs.select("doc_id", exact_dedup.digest_of(F.col("text"))[1].alias("digest"))))
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.lookup(full, new, docs).collect()} == {(100, 1), (102, 0)}


def test_lines_null_and_repeated_ids(spark):
    given, d = repeated(spark)
    got = line_dedup.line_dedup(d)
    assert sorted(str((r.doc_id, r.n_lines, r.n_removed_lines)) for r in got.collect()) == sorted(
        str(x) for x in [(None, 4, 0), (7, 4, 4), (7, 4, 4), (7, 4, 0), (8, 4, 4), (None, 1, 0), (9, 1, 0), (9, 1, 0), (9, 1, 0), (10, 2, 0)]
    )


def test_lines_long_copy(spark):
    text = "\n".join(f"{i} {i * i}" for i in range(60_000))
    d = spark.createDataFrame([(1, text), (2, "head\n" + text + "\ntail")], "doc_id long, text string")
    assert rows(line_dedup.line_dedup(d))[2].text == "head\ntail"


def test_near_null_and_repeated_ids(spark):
    given, d = repeated(spark)
    got = sorted(str((r.doc_id, r.component_id, r.kept)) for r in near_dedup.near_dedup(d, shingle_words=2).collect())
    # the text of id 7 that comes first by its hash stays if its group begins there
    assert len(got) == len(given) and got.count("(None, None, True)") == 2 and "(8, 7, False)" in got and "(10, 10, True)" in got
    kept = near_dedup.keep_documents(d, shingle_words=2)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["10", "7", "7", "9", "9", "None", "None"]


def test_substrings_null_and_repeated_ids(spark):
    given, d = repeated(spark)
    got = substring_dedup.substring_dedup(d).collect()
    size = len(given[0][1].encode())
    removed = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got)
    assert len(got) == len(given)
    assert removed == sorted([("None", size, 0), ("7", size, size), ("7", size, size), ("7", size, 0), ("8", size, size), ("None", 0, 0), ("9", 0, 0), ("9", 0, 0), ("9", 0, 0), ("10", 50, 0)])


def test_spans_are_told_apart_by_bytes(monkeypatch):
    data = np.frombuffer(b"one two one three two one longer than eight longer than eighT", np.uint8)
    s, e, _ = kernel.spans(kernel.WORD[data], np.array([0, len(data)]))
    words = data.tobytes().split()
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(kernel, "span_hash", lambda d, a, b: np.zeros(len(a), np.uint64))
        code, first, _ = kernel.distinct(data, s, e)
        assert [words[first[c]] for c in code] == words and len(first) == len(set(words))
    assert kernel.same_bytes(data, s[[0, 0]], data, s[[2, 1]], np.array([3, 3])).tolist() == [True, False]

def test_lines(spark, docs):
    d = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "b\nc"), (4, None), (5, "q\nq\nq\nq\nq\nz")], "doc_id long, text string")
    got = rows(line_dedup.line_dedup(d))
    assert [got[i].text for i in (1, 2, 3, 4, 5)] == ["a\nb\nc\nd", "x\ny", "b\nc", None, "q\nz"]
    assert got[2].n_removed_lines == 3 and line_dedup.line_dedup(docs).columns == [*docs.columns, "n_lines_", "n_removed_lines_"]


def shingle_sets(texts, n):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    out = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(low))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_near(docs, texts, n):
    s = shingle_sets(texts, n)
    comp = {i: i for i in s}
    for _ in s:
        for a, b in itertools.combinations(s, 2):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = rows(near_dedup.near_dedup(docs, shingle_words=n))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s[i]), comp[i]) for i in s}


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n, a in ((1, 3), (2, 2), (200, 2), (3000, 4), (500, 1), (700, 150)):
        t = rng.integers(90, 90 + a, n).astype(np.uint8)
        b = t.tobytes()
        order = suffix_array(t).tolist()
        assert order == sorted(range(n), key=lambda i: b[i:])
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or t[i + k] != t[j + k]), n)  # noqa: B023, E731
        lcp = permuted_lcp(t, np.array(order))
        assert all(lcp[i] == common(i, j) for i, j in itertools.pairwise(order[::-1]))


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_substrings(docs, texts, hot):
    seen, got = set(), rows(substring_dedup.substring_dedup(docs, hot=hot))
    for i in sorted(texts):
        b = texts[i].encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), gone.sum(), hashlib.sha256(kept).hexdigest())
        assert got[i].n_spans == int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())


def test_pieces(docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, table = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces.load(path)
    for head in (pieces.HEAD, 3):
        got = rows(pieces.round_trip(docs, table, head=head))
        for i, t in texts.items():
            ids = np.array(sp.encode(t), "<u4")
            assert (got[i].n_tokens, got[i].ids_crc32, got[i].round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)
    back = rows(pieces.decode(pieces.encode(docs, table), table))
    assert {i: r.text for i, r in back.items()} == texts


def test_viterbi_fold_is_the_best_path(spark):
    rng, score = np.random.default_rng(9), {}
    for n in (1, 2, 3):
        for p in map("".join, itertools.product("abc", repeat=n)):
            if n == 1 or rng.random() < 0.6:
                score[p] = -float(rng.integers(1, 1000)) * n / 3
    ids = {p: i for i, p in enumerate(score)}
    table = spark.createDataFrame([(p, ids[p], s) for p, s in score.items()], "piece string, id int, score double")
    units = {"".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(60)}
    got = {r.unit: r.ids for r in pieces.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), table, 3, 100, merges=False).collect()}
    cuts = lambda u: [[]] if not u else [[u[:k], *rest] for k in (1, 2, 3) if u[:k] in score and len(u) >= k for rest in cuts(u[k:])]
    name = {i: p for p, i in ids.items()}
    for u in units:
        assert "".join(name[i] for i in got[u]) == u
        assert abs(sum(score[name[i]] for i in got[u]) - max(sum(score[p] for p in way) for way in cuts(u))) < 1e-9


def test_viterbi_fold(spark):
    units = spark.createDataFrame([("abc",), ("ab",)], "unit string")
    table = spark.createDataFrame([("a", 1, -1.0), ("b", 2, -1.0), ("c", 3, -1.0), ("ab", 4, -1.5), ("bc", 5, -0.2)], "piece string, id int, score double")
    assert {r.unit: r.ids for r in pieces.lattice(units, table, 2, 100, merges=False).collect()} == {"abc": [1, 5], "ab": [4]}


def test_tokens(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    folder = token_output.write_tokens(docs, path)
    got, start = rows(token_output.read_tokens(spark, folder)), 0
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rec = spark.read.parquet(folder).first().asDict()
    whole, at = token_output.decode_record(rec), np.frombuffer(rec["id_offs"], np.int64)
    assert all((token_output.decode_record(rec, k) == whole[at[k] : at[k + 1]]).all() for k in range(rec["n_docs"]))


def test_re_pair_round_trip():
    ids = np.random.default_rng(0).choice([5, 6, 7, 2, 900], 4000).astype(np.uint16)
    seq, rules = token_output.re_pair(ids)
    assert len(rules) and len(seq) < len(ids) and (token_output.expand(seq, rules) == ids).all()
    # it ends only when no pair is frequent
    pairs = [(a, b) for a, b in itertools.pairwise(seq.tolist()) if 2 not in (a, b) and a != b]
    assert max(pairs.count(p) for p in set(pairs)) < token_output.LEAST
    assert (token_output.lengths(rules) == [len(token_output.expand(np.array([token_output.FIRST_RULE + k], np.uint16), rules)) for k in range(len(rules))]).all()
    run = np.array([5] * 33 + [2] + [5] * 34, np.uint16)
    assert (token_output.expand(*token_output.re_pair(run, 2)) == run).all()


def test_chat(spark):
    part = chat_format.PART
    d = spark.createDataFrame([(1, 0, "user", [("text", "a</turn>\\l<", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None)]), (1, 1, "assistant", [("text", "ok \\b", None, None, None, None, None)]), (1, 2, None, None)], f"conv_id long, turn long, role string, parts array<{part}>")
    f = chat_format.format_chat(d)
    r, b = f.first(), chat_format.read_chat(f).first()
    assert r.formatted.count("</turn>") == 3 and [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 4)] and r.attachment_tokens == 4
    assert [(t.role, t.text) for t in b.turns] == [("user", "a</turn>\\l<<image 1/>"), ("assistant", "ok \\b"), ("", "")] and b.loss_text == "ok \\b"


def test_chat_ties_repeats_and_no_rows(spark):
    d = spark.createDataFrame([(1, 5, "user", x) for x in ("<", "A", "A", None, "\\")] + [(None, 1, None, "x")], "conv_id long, turn long, role string, text string")
    f = chat_format.format_chat(d.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts")))
    got = {r.conv_id: [t.text for t in r.turns] for r in chat_format.read_chat(f).collect()}
    assert got == {1: ["", "<", "A", "A", "\\"], None: ["x"]}
    none = d.limit(0).select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    assert chat_format.read_chat(chat_format.format_chat(none)).count() == 0


def test_language(spark, docs):
    more = spark.createDataFrame([(100 + i, "der und die nicht " * 9, "de", "b.de") for i in range(4)] + [(200, "123 456", None, None), (201, "", None, None)], "doc_id long, text string, lang string, source string")
    got = rows(language_id.identify_documents(docs.select(more.columns).union(more)), "id")
    assert got[100].lang_id == "de" and got[0].lang_id == "en" and not got[200].accepted and not got[201].accepted
    assert language_id.keep_accepted(docs).columns == docs.columns
    page = spark.createDataFrame([("x", '<html lang="de">', "http://a.b.de/x")], "t string, html string, url string").select(language_id.declared_language(F.col("html")).alias("d"), language_id.host_of(F.col("url")).alias("h")).first()
    assert (page.d, page.h) == ("de", "a.b.de")


def test_page_language_brute_force(spark):
    said = {"en": "the and of with that ", "de": "der und die nicht auch ", "fr": "le est dans pour une "}
    labelled = spark.createDataFrame([(t * 9, k) for k, t in said.items()] * 3, "text string, lang string")
    langs, logp = model = language_id.train(labelled)
    hosts = ["www.a.example.de", "shop.a.example.de", "b.other.de", "c.site.fr", "localhost", "x.co.com", None]
    rng, cases = np.random.default_rng(5), []
    for i in range(90):
        lang = ("de", "fr", "en")[i % 3]
        words = " ".join(rng.choice((said[lang] + said["en"]).split(), rng.integers(0, 6)))
        host = hosts[(i * 5 + i // 7) % 7]
        declared = (None, lang, "de")[i // 3 % 3]
        tag = "<HTML>" if declared is None else f"<HTML class=x LANG='{declared.upper()}'>"
        page = f"<!doctype html>{tag}<head><title>der die</title><style>p{{}}</style></head><body><!-- une > --><script>var t='</p>le';</script><p title=\"a > le\">{words}</p>&eacute;&amp;</body></html>"
        cases.append((i, host and f"HTTPS://{host}:80/p?q#x", page, host, declared, words + " é&"))
    pages = spark.createDataFrame([c[:3] for c in cases] + [(900, None, None)], "page_id long, url string, html string")
    got = rows(language_id.identify_pages(pages, model), "id")
    shown = spark.createDataFrame(cases, "i int, u string, h string, o string, d string, w string").select(language_id.visible_text(F.col("h")).alias("v"), "w").collect()
    assert all(r.v.split() == r.w.replace("é&", " é&").split() for r in shown)

    names, size = [*langs, "und"], len(langs) + 1
    table = np.vstack([logp, np.full((1, language_id.TABLE), -np.log(language_id.TABLE), np.float32)]).astype(float)
    letter = lambda b: 97 <= b < 123 or b >= 128

    def evidence(text):
        d = [32 if b in b" \t\n\v\f\r" else b for b in text.lower().encode()]
        grams = [d[i : i + 3] for i in range(len(d) - 2) if letter(d[i + 1]) and all(b == 32 or letter(b) for b in (d[i], d[i + 2]))]
        at = [((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) * 0x27D4EB2F % 2**32) >> 16 for a, b, c in grams]
        return table[:, at].sum(1) * min(1, language_id.EVIDENCE / max(1, len(at))), len(at)

    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    facts = [(h, d, *evidence(v.v)) for (_, _, _, h, d, _), v in zip(cases, shown, strict=True)] + [(None, None, *evidence(""))]
    post = [soft(ll) for _, _, ll, _ in facts]
    level = lambda h, k: None if h is None or "." not in h else ".".join(h.split(".")[-k:])
    pick = lambda f: [p for (h, d, _, n), p in zip(facts, post, strict=True) if n and f(h, d)]
    smooth = lambda c, m, up: (c + language_id.KAPPA * up) / (m + language_id.KAPPA)
    whole = pick(lambda h, d: True)
    every = (sum(whole) + 1) / (len(whole) + size)
    seen = set()
    for (i, (h, d, ll, n)), p in zip(enumerate(facts), post, strict=True):
        prior = every
        own = pick(lambda a, _: a is not None and a == h)  # noqa: B023
        if own:
            up = every
            for k in (1, 2) if level(h, 1) else ():
                c = pick(lambda a, _: level(a, k) == level(h, k))  # noqa: B023
                up = smooth(sum(c), len(c), up)
            prior = smooth(np.maximum(sum(own) - p, 0), len(own) - 1, up)
        f = ll + np.log(prior)
        if d:
            c, t = sum(pick(lambda _, a: a == d)), sum(pick(lambda _, a: a is not None))  # noqa: B023
            f = f + np.log((c + 0.5) / (t + 0.5 * 26 * 26))
        q, r = soft(f), got[cases[i][0] if i < len(cases) else 900]
        want = names[int(q.argmax())] if n else "und"
        assert r.lang_id == want and abs(r.posterior - (q.max() if n else 0)) < 1e-6, (i, h, d)
        assert r.accepted == (want != "und" and q.max() >= 0.5)
        seen.add((want, h is None, d))
    assert len(seen) > 6


def test_toxicity(spark):
    bad = [(i, f"the day is fine. you scum number {'x' * (i % 5)}. end", 1) for i in range(40)]
    good = [(100 + i, f"the day is fine. you friend number {'x' * (i % 5)}. end", 0) for i in range(60)]
    d = spark.createDataFrame([(i, t) for i, t, _ in bad + good] + [(500, None), (501, ""), (502, "Scum. a fine day\nyou SCUM! friend you scum number")], "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame([(i, y) for i, _, y in bad + good], "doc_id long, toxic int"))
    got = rows(toxicity.score(d, model))
    assert min(got[i].score for i in range(40)) > 0.7 > max(got[100 + i].score for i in range(60)) and got[500].score == got[501].score < 0.5
    assert got[0].worst_start_byte == 17

    # noisy-or over sentences, in plain Python
    def weight(word):
        whole, low = word.lower().encode(), []
        for part, k in ((whole, 0), (whole[:4], 4), (whole[:5], 5)):
            h = kernel.span_hash(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))
            low.append(int((kernel.mix(h + kernel.U(k)) if k else h)[0]) % toxicity.TABLE)
        return low

    for i, t in [(r.doc_id, r.text) for r in d.collect()]:
        clean = 1.0
        for sentence in [s for s in re.split(r"[.!?\n\r]", t or "") if re.search("[a-z0-9]", s, re.I)] or [""]:
            found = {f for w in re.findall("[a-z0-9]+", sentence, re.I) for f in weight(w)}
            clean *= 1 - 1 / (1 + np.exp(-(sum(float(model[0][f]) for f in found) + model[1])))
        assert abs(got[i].score - (1 - clean)) < 1e-6


def test_decontaminate(spark):
    item = " ".join(f"w{i}" for i in range(40))
    edited = item.replace("w7 ", "zz ").replace("w20 ", "").replace("w31", "w31 yy")
    d = spark.createDataFrame([(1, f"x y {item} z"), (2, f"q {edited} r"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(9, item), (10, None), (11, "one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) == {(1, 9), (2, 9)} and got[1, 9] == 1.0
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()} == {3, 4}


def test_decontaminate_brute_force(spark):
    item = [f"w{i}" for i in range(20)]
    other = [f"v{i % 7}" if i % 2 else f"u{i}" for i in range(24)]
    swap = lambda at: " ".join("zz" if i in at else w for i, w in enumerate(item))
    texts = [" ".join(item), swap({3, 9, 15}), " ".join(item[:12]), " ".join(item[9:]), "q q " + " x ".join(" ".join(item[i : i + 2]) for i in range(0, 20, 2)), " y ".join(item), swap(set(range(2, 20, 3))), swap({1, 4, 7, 10, 13, 16, 19}), "pad " * 30 + swap({4, 5, 6}) + " pad" * 30]
    texts += [" ".join(other[i:] + item[:i]) for i in range(0, 20, 3)] + ["w1 w2 w3 then w5", "", " ".join(item[::-1])] + [" ".join(item[:11])] * 9
    rng = np.random.default_rng(3)
    texts += [" ".join(str(rng.choice(["w", "v", "u"])) + str(rng.integers(20)) if rng.random() < 0.45 else w for w in item + other) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(item)), (10, " ".join(other)), (11, "w4 w5 w6")], "item_id long, text string")

    def align(a, b):
        rows, best = [[0] * (len(b) + 1)], 0
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(0, rows[-1][j] + (2 if x == y else -1), rows[-1][j + 1] - 1, new[j] - 1))
            rows.append(new)
            best = max(best, *new)
        return best / (2 * len(b))

    for threshold in (0.5, 0.4, 0.8):
        want = {(i, k): s for i, t in enumerate(texts) for k, x in ((9, item), (10, other), (11, ["w4", "w5", "w6"])) if (s := align(t.split(), x)) >= threshold}
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(d, b, threshold=threshold).collect()}
        assert got == want and len(want) > 10


def test_empty_tables(spark, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    table = pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    path = token_output.write_tokens(nothing, public_tokenizers.path("word_bpe_49k.json"))
    for df in (
        exact_dedup.exact_dedup(nothing), line_dedup.line_dedup(nothing), near_dedup.near_dedup(nothing), substring_dedup.substring_dedup(nothing), pieces.round_trip(nothing, table),
        token_output.read_tokens(spark, path), decontaminate.contaminated(nothing, bench), language_id.keep_accepted(nothing), toxicity.score(nothing, (np.zeros(toxicity.TABLE, np.float32), -6.0)),
    ):
        assert df.count() == 0
