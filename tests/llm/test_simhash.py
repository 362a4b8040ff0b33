import random

import numpy as np
import pytest
import xxhash
from fixtures import ODD, make

from inkflow.llm import graph, simhash


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def groups(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(x, set()).add(i)
    return sorted(map(sorted, out.values()))


def cluster(n, seed, flips=6, centres=5):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def rows_of(fps):
    import pyarrow as pa

    b = next(simhash.variants(iter([pa.RecordBatch.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64))], names=["fp"])])))
    k, ball, fp = (b.column(i).to_numpy() for i in range(3))
    order = np.lexsort((ball, k))
    return k[order], ball[order], fp[order]


@pytest.mark.parametrize("dense", [2048, 80])
def test_links_find_the_components_of_all_pairs(dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    for seed in range(3):
        fps = cluster(500, seed, centres=2 if dense < 100 else 6)
        k, ball, fp = rows_of(fps)
        u, v = simhash.meet(k, ball, fp.view(np.uint64))
        assert len(u) <= len(k)
        assert (np.bitwise_count(u ^ v) <= 64).all()
        at = {x: i for i, x in enumerate(fps)}
        got = graph.local_components(len(fps), np.array([at[int(x)] for x in u]), np.array([at[int(x)] for x in v]))
        assert groups(got.tolist()) == groups(brute_components(fps))


def test_links_over_batches_keep_keys_together():
    import pyarrow as pa

    fps = cluster(300, 9)
    k, ball, fp = rows_of(fps)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 37]) for x in (k, ball, fp)], names=["key", "ball", "fp"]) for i in range(0, len(k), 37)]
    out = list(simhash.links(iter(batches)))
    at = {x: i for i, x in enumerate(fps)}
    u, v = (np.concatenate([b.column(i).to_numpy() for b in out]).view(np.uint64) for i in (0, 1))
    got = graph.local_components(len(fps), np.array([at[int(x)] for x in u]), np.array([at[int(x)] for x in v]))
    assert groups(got.tolist()) == groups(brute_components(fps))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, 7), (-5, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: -5 for i in [-5, *range(21)]}, **{i: 100 for i in range(100, 130)}}


def test_documents(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = list(ODD)
    for g in range(12):
        w = [rng.choice(vocabulary) for _ in range(120)]
        for c in range(6):
            v = list(w)
            for _ in range(c % 3):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            rows.append((100 + 10 * g + c, " ".join(v), "en", "a"))
    got = simhash.near_duplicates(make(spark, rows)).collect()
    prints = [brute_print(t) for _, t, _, _ in rows]
    labels = brute_components(prints)
    want = []
    for (i, *_), p, x in zip(rows, prints, labels):
        ids = [rows[j][0] for j, y in enumerate(labels) if y == x and rows[j][0] is not None]
        want.append((i, p, min(ids, default=None)))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert len(set(labels)) < len(rows) - 20
    empty = simhash.near_duplicates(make(spark, []))
    assert empty.collect() == []
