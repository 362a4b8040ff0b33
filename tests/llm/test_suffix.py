import hashlib
import random

import numpy as np
import pytest
from fixtures import ODD, make

from inkflow.llm import removal, suffix
from inkflow.llm.common import documents, keyed

DATA = "/root/testdata"


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by a dictionary of all 50-byte strings."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        if i is not None:
            for a in range(len(t) - 49):
                w = t[a : a + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for a in range(len(t) - 49):
                if least[t[a : a + 50]] < i:
                    gone[a : a + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, f"{DATA}/sf0.001").collect()]
    want = brute(rows)
    assert result(suffix.op1_suffix_dedup(spark, f"{DATA}/sf0.001")) == want
    assert sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("small", [False, True])
def test_random_texts(spark, monkeypatch, small):
    if small:  # many blocks, chunks and pieces
        for name, n in (("BLOCK", 300), ("CHUNK", 900), ("PIECE", 200)):
            monkeypatch.setattr(suffix, name, n)
    rng = random.Random(7)
    rows = []
    for i in range(120):
        alphabet = rng.choice(["ab", "abcdefgh ", "é\0x ", "a"])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(300)))
        if rows and rng.random() < 0.7:
            s = rng.choice(rows)[1]
            a = rng.randrange(len(s) + 1)
            t = t[:100] + s[a : a + rng.randrange(40, 160)] + t[100:]
        rows.append((rng.randrange(90), t))
    docs = keyed(make(spark, [(i, t, "en", "a") for i, t in rows]))
    got = result(removal.remove(docs, suffix.duplicate_spans(docs)))
    assert got == brute(rows)


def test_odd_and_empty(spark):
    rows = ODD + [(50 + i, ODD[8][1][100 * i : 100 * i + 3000], "en", "a") for i in range(5)]
    docs = keyed(make(spark, rows))
    assert result(removal.remove(docs, suffix.duplicate_spans(docs))) == brute([r[:2] for r in rows])
    empty = keyed(make(spark, []))
    assert removal.remove(empty, suffix.duplicate_spans(empty)).collect() == []


def test_multikey_sort():
    rng = np.random.default_rng(3)
    cols = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(5)]
    order, new = suffix.multikey_sort(cols)
    rows = [tuple(c[i] for c in cols) for i in order]
    assert rows == sorted(rows)
    assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(500)]
