import itertools
import re
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline

SF = "/root/testdata/sf0.001"
WORDS = {"en": "the and of with that which have from this are not was his her they", "de": "der und die nicht auch ein mit sich auf ist werden aus bei nach wird"}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and 0.7 * before < out.count() <= docs.count(), name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.filter("not round_trip").count() == 0


def corpus():
    """(doc_id, text, lang): plain texts, copies, near copies, shared passages, benchmark copies and junk."""
    rng = np.random.default_rng(8)
    made = lambda n, lang: " ".join(rng.choice(WORDS[lang].split(), n))
    item = " ".join(f"{a}{b}" for a, b in zip("quick lazy brown small silver".split() * 5, "fox dog bear bird fish".split() * 5, strict=True) for _ in (0,))
    item = " ".join(f"{w}{i}" for i, w in enumerate(item.split()))
    passage = "\n".join(made(9, "en") for _ in range(4))
    texts = [(made(60, ("en", "de")[i % 2]), ("en", "de")[i % 2]) for i in range(30)]
    texts += [(texts[0][0], "en")] * 40  # a hot group of copies
    for i in range(12):  # near copies: a word in sixty changed
        words = texts[2][0].split()
        words[5 * i % 60] = "changed"
        texts.append((" ".join(words), "en"))
    texts += [(f"{made(20, 'en')}\n{passage}\n{made(20, 'en')}", "en") for _ in range(9)]
    edited = item.split()
    for k in (3, 9, 15):
        edited[k] = "other"
    texts += [(f"{made(30, 'en')} {item} {made(10, 'en')}", "en"), (f"{made(30, 'en')} {' '.join(edited)} {made(10, 'en')}", "en"), (f"{made(30, 'de')} {' '.join(item.split()[:14])}", "de")]
    texts += [("1234 5678 !!", "en"), ("", "en"), (None, "de")]
    return [(i, t, lang) for i, (t, lang) in enumerate(texts)], item


def align(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *new)
    return best / (2 * len(b))


def expected(rows, item):
    docs = {i: t for i, t, _ in rows if re.search("[a-z]{3}", t or "")}  # all others have no trigram of letters
    seen, out = set(), {}
    for i in sorted(docs):
        lines = docs[i].split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in out.items())}
    group = {i: i for i in out}
    for _ in range(4):
        for a, b in itertools.combinations(sorted(out), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    return {i: t for i, t in out.items() if group[i] == i and align(t.lower().split(), item.split()) < 0.5}


def test_pipeline_equals_brute_force(spark, tmp_path):
    import sentencepiece

    rows, item = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, bad string, row string"
    given = [(i, t, lang, f"s{i % 3}", len(t or ""), "x", "y", "z") for i, t, lang in rows]
    spark.createDataFrame(given, schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = expected(rows, item)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and 20 < len(want) < 50
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, t in want.items():
        ids = np.array(sp.encode(t), "<u4")
        assert (got[i].n_tokens, got[i].ids_crc32, got[i].round_trip, got[i].ids) == (len(ids), zlib.crc32(ids.tobytes()), True, ids.tolist())
