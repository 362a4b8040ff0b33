import hashlib
import random

import pytest
from fixtures import ODD, make

from inkflow.llm import chunking, removal
from inkflow.llm.common import documents, keyed

DATA = "/root/testdata"


def brute_cuts(t):
    """Chunk ends by the rolling hash of 64 bits, byte after byte."""
    table, h, last, out = [int(x) for x in chunking.gear_table()], 0, 0, []
    for i, b in enumerate(t):
        h = (h << 1) + table[b] & 2**64 - 1
        if i + 1 - last >= chunking.LEAST and h & chunking.MASK == 0 or i + 1 - last == chunking.MOST:
            out.append(i + 1)
            last = i + 1
    return out + [len(t)] * (last < len(t))


def brute(rows):
    first, parts = {}, []
    for i, t in rows:
        t = (t or "").encode()
        ends = brute_cuts(t)
        parts.append((i, t, list(zip([0, *ends], ends))))
        if i is not None:
            for a, b in parts[-1][2]:
                x = (i, 0, a)
                first[t[a:b]] = min(first.get(t[a:b], x), x)
    out = []
    for i, t, spans in parts:
        gone = []
        for a, b in spans:
            if i is not None and first[t[a:b]] != (i, 0, a):
                if gone and gone[-1][1] == a:
                    gone[-1][1] = b
                else:
                    gone.append([a, b])
        gone = [(a, b) for a, b in gone if b - a >= chunking.RUN or b - a == len(t)]
        kept = b"".join(t[x:y] for x, y in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(t)]))
        out.append((i, len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_cuts_are_those_of_the_rolling_hash():
    rng, table = random.Random(2), chunking.gear_table()
    for n in (0, 1, 15, 16, 17, 200, 5000):
        t = rng.randbytes(n)
        assert chunking.cuts(t, table) == brute_cuts(t)
    for t in (b"a" * 1000, b"ab" * 300, b"the cat sat " * 50):
        assert chunking.cuts(t, table) == brute_cuts(t)


@pytest.mark.parametrize("small", [False, True])
def test_query_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(chunking, "CHUNK", 5000)
    rows = [(r.doc_id, r.text) for r in documents(spark, f"{DATA}/sf0.001").collect()]
    want = brute(rows)
    assert result(chunking.op8_substring_dedup(spark, f"{DATA}/sf0.001")) == want
    assert sum(r[2] for r in want) > 1000


def test_passage_that_repeats(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(rng.randrange(40, 90))} {passage} {text(50)}" if i % 3 == 0 else text(150), "en", "a") for i in range(60)]
    docs = keyed(make(spark, rows))
    got = {r.doc_id: r for r in removal.remove(docs, chunking.duplicate_chunks(docs), chunking.RUN).collect()}
    assert {i for i, r in got.items() if r.n_removed} == {i for i in range(60) if i % 3 == 0 and i > 0}
    assert all(r.n_removed <= len(passage) + 2 for r in got.values())


def test_odd_and_empty(spark):
    unique = [r for r in ODD if r[0] != 6]
    docs = keyed(make(spark, unique))
    got = removal.remove(docs, chunking.duplicate_chunks(docs), chunking.RUN)
    assert result(got) == brute([r[:2] for r in unique])
    docs = keyed(make(spark, ODD))
    assert len(removal.remove(docs, chunking.duplicate_chunks(docs), chunking.RUN).collect()) == len(ODD)
    empty = keyed(make(spark, []))
    assert removal.remove(empty, chunking.duplicate_chunks(empty), chunking.RUN).collect() == []
