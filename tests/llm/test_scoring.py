import math
import re
import zlib
from collections import Counter

import numpy as np
from fixtures import ODD, make

from inkflow.llm import scoring
from inkflow.llm.common import documents

DATA = "/root/testdata"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def remainder(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10


def brute(rows, weights=None):
    """Contract columns by plain counting, and with ``weights`` the model's score."""
    word, pair, triple = Counter(), Counter(), Counter()
    for i, t in rows:
        if remainder(i):
            w = tokens(t)
            word.update(w)
            pair.update(zip([None, *w], w))
            triple.update(zip([None, *w], w, w[1:]))
    n, v = sum(word.values()), len(word)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((word[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        if weights is not None:
            for first, a, b, c in zip([True, *[False] * len(w)], [0, None, *w], [None, *w], w):
                two, three = (0, 0) if first else (pair[a, b], triple[a, b, c])
                l3, l2, l1, l0 = weights[64 + two.bit_length() if two else word[b].bit_length()]
                score += math.log10(l3 * three / max(two, 1) + l2 * pair[b, c] / max(word[b], 1) + l1 * word[c] / n + l0 / (v + 1))
        out.append((i, remainder(i) == 0, len(w), sum(word[x] > 0 for x in w), n, base, score))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def same(got, want, model=True):
    got = sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert not model or math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)


def test_query_against_brute_force(spark, monkeypatch):
    learned = []
    learn = scoring.learn
    monkeypatch.setattr(scoring, "learn", lambda c, n: learned.append(learn(c, n)) or learned[0])
    monkeypatch.setattr(scoring, "BLOCK", 30_000)
    rows = [(r.doc_id, r.text) for r in documents(spark, f"{DATA}/sf0.01").collect()]
    got = scoring.op5_lm_scoring(spark, f"{DATA}/sf0.01").collect()
    same(got, brute(rows, learned[0]))
    held = [r for r in got if r.held_out]
    # the mixture must tell held-out text better than the base
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert np.allclose(learned[0].sum(axis=1), 1) and (learned[0][1:, 1:] > 0).all() and (learned[0][64:] > 0).all()


def test_learning_raises_the_likelihood():
    rng = np.random.default_rng(1)
    q3, q2, q1, b = rng.integers(0, 100, 500), rng.integers(0, 100, 500), rng.integers(30, 80, 500), rng.choice([0, 1, 2, 3, 65, 66, 67, 68], 500)
    q3[b < 64] = 0
    q2[b == 0] = 0
    cell, n = ((b * scoring.CELLS + q3) * scoring.CELLS + q2) * scoring.CELLS + q1, rng.integers(1, 50, 500).astype(float)
    ratios = np.stack([np.where(q > 0, 2.0 ** ((q - scoring.OFFSET) / scoring.GRAIN), 0) for q in (q3, q2, q1)] + [np.ones(500)], axis=1)
    likelihood = lambda w: (n * np.log((w[b] * ratios).sum(axis=1))).sum()
    best = scoring.learn(cell, n)
    for _ in range(50):
        other = rng.dirichlet([1, 1, 1, 1], 2 * scoring.LEVELS)
        other[:64, 0] = 0
        other[0, 1] = 0
        other /= other.sum(axis=1, keepdims=True)
        assert likelihood(best) >= likelihood(0.9 * best + 0.1 * other) - 0.5


def test_long_texts_are_cut_between_words(monkeypatch):
    whole = scoring.token_hashes("  Some Words\nof\ta  text ".encode())
    monkeypatch.setattr(scoring, "PIECE", 3)
    assert scoring.token_hashes("  Some Words\nof\ta  text ".encode()).tolist() == whole.tolist()
    assert len(whole) == 6 and scoring.token_hashes(b"").tolist() == [int(scoring.END)]


def test_odd_and_empty(spark):
    docs = make(spark, ODD).select("doc_id", scoring.folds().alias("fold"), "text")
    same(scoring.score(docs).collect(), brute([r[:2] for r in ODD]), model=False)
    assert scoring.score(docs.limit(0)).collect() == []
    none = [r for r in scoring.score(docs.select("doc_id", "text", scoring.F.lit(scoring.HELD_OUT).alias("fold"))).collect()]
    assert all(r.train_tokens == 0 and r.score == 0 and r.n_known == 0 for r in none) and len(none) == len(ODD)
