import random
import string
import zlib

import numpy as np
from fixtures import ODD, make

from inkflow.llm import langid
from inkflow.llm.common import documents

DATA = "/root/testdata"


def brute_vector(text, table):
    seq = [0]
    for ch in text or "":
        c = int(table[ord(ch)])
        if c or seq[-1]:
            seq.append(c)
    if seq[-1]:
        seq.append(0)
    out = np.zeros(langid.DIM)
    v = {c: langid.letter_vectors(np.array([c]))[0].astype(int) for c in set(seq)}
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out


def test_vectors_are_bundles_of_bound_letters(monkeypatch):
    table = langid.letter_table()
    texts = ["Hello, World!", None, "", "été naïve", "你好 12", "...", "a"]
    for grams in (8192, 3):
        monkeypatch.setattr(langid, "GRAMS", grams)
        got, sizes = langid.vectors(texts, table)
        for t, v, n in zip(texts, got, sizes):
            assert np.array_equal(v, brute_vector(t, table)), t
            assert (n == 0) == (not v.any())


def test_chunks_cover_all_texts():
    texts = ["x" * n for n in (5, langid.CHARS + 7, 3, 0)] + [None] * 600
    parts = list(langid.chunks(texts))
    assert [i for a, p in parts for i in range(a, a + len(p))] == list(range(len(texts)))


def test_held_out_accuracy(spark):
    got = langid.op2_language_id(spark, f"{DATA}/sf0.01").join(documents(spark, f"{DATA}/sf0.01").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and len(held) > 150
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = make(spark, ODD)
    protos = langid.train(docs)
    rows = langid.predict(docs, protos, ["doc_id"]).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 9))
    assert {r.lang_pred for r in rows} <= {"en", "fr", "de", "und"}
    none = langid.predict(docs, langid.train(make(spark, [])), ["doc_id"]).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.predict(make(spark, []), protos, ["doc_id"]).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    rows = [(r.doc_id + 100, r.text[:150], r.lang, r.source) for r in documents(spark, f"{DATA}/sf0.001").collect() if r.text][:90] + ODD[:4]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    table, remainder = langid.letter_table(), lambda i: zlib.crc32(str("" if i is None else i).encode()) % 4
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    vector = {i: unit(brute_vector(t, table)) for i, t, *_ in rows}
    langs = sorted({x for i, _, x, _ in rows if x is not None and remainder(i) != 2})
    sums = [unit(sum(vector[i] for i, _, x, _ in rows if x == lang and remainder(i) != 2)) for lang in langs]
    protos = np.array([unit(s - np.mean(sums, axis=0)) for s in sums])
    got = {r.doc_id: r for r in langid.op2_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, *_ in rows:
        cos = protos @ vector[i]
        assert got[i].held_out == (remainder(i) == 2)
        if not vector[i].any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        assert abs(got[i].score - max(0, cos.max())) < 1e-4 and cos[langs.index(got[i].lang_pred)] > cos.max() - 1e-4


def test_gibberish_is_rejected_and_documents_stay(spark):
    rng = random.Random(8)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in documents(spark, f"{DATA}/sf0.01").collect()]
    noise = lambda n: "".join(rng.choice(string.ascii_lowercase + " ") for _ in range(n))
    junk = [(10_000 + i, noise(n), None, "a") for i, n in enumerate((300, 1000, 5000) * 5)]
    junk += [(11_000 + i, "%02x" % rng.getrandbits(8 * n), None, "a") for i, n in enumerate((600, 2000) * 5)]
    gone = {r.id for r in langid.rejected(make(spark, rows + junk)).collect()}
    letterless = {i for i, t, *_ in rows if not any(c.isalpha() for c in t or "")}
    assert gone >= {i for i, *_ in junk} | letterless
    assert len(gone - {i for i, *_ in junk} - letterless) <= 0.002 * len(rows)
    # where nothing is learnt only texts without a letter go
    assert {r.id for r in langid.rejected(make(spark, [(1, "words", None, "a"), (2, "12", None, "a"), (3, None, None, "a")])).collect()} == {2, 3}
    assert {r.id for r in langid.rejected(make(spark, ODD)).collect()} == {1, 2, 3, 9}
    assert langid.rejected(make(spark, [])).collect() == []
