import itertools
import random

import numpy as np
from fixtures import ODD, make

from inkflow.llm import common, graph, similar
from inkflow.llm.common import documents

DATA = "/root/testdata"


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_links(texts, least=similar.LEAST):
    """Pairs of texts with a Jaccard similarity of five-word shingles of ``least`` or more, from all pairs that share one."""
    sets, by = [grams(t) for t in texts], {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {p for own in by.values() for p in itertools.combinations(own, 2)}
    return {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def labels_of(n, links):
    a, b = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
    return graph.local_components(n, a, b).tolist()


def test_groups_of_documents(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in documents(spark, f"{DATA}/sf0.01").collect()]
    want = brute_links([r[1] for r in rows])
    place = {r[0]: i for i, r in enumerate(rows)}
    got = {place[r.doc_id]: place[r.first_id] for r in similar.groups(make(spark, rows)).collect()}
    label = labels_of(len(rows), want)
    found = sum(got[a] == got[b] for a, b in want)
    assert found >= 0.9 * len(want) and len(want) > 20
    # nothing is joined that the links don't join, and a group's first row is its least
    assert all(label[i] == label[x] and x <= i for i, x in got.items())


def test_edited_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, want = list(ODD[:8]), []
    for g in range(60):
        w = [rng.choice(vocabulary) for _ in range(200)]
        for c in range(4):
            v = list(w)
            for _ in range(c):  # up to 15 of 196 shingles change: a similarity of 0.85 or more to the first
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            rows.append((1000 + 10 * g + c, " ".join(v).upper() if c == 2 else " ".join(v), "en", "a"))
            want.append((1000 + 10 * g + c, 1000 + 10 * g))
    got = {r.doc_id: r.first_id for r in similar.groups(make(spark, rows)).collect()}
    assert sum(got[i] == x for i, x in want) >= 0.97 * len(want)
    assert all(got[i] // 10 == i // 10 for i, _ in want)


def test_odd_and_empty(spark):
    got = similar.groups(make(spark, ODD)).collect()
    assert len(got) == len(ODD)
    first = {(r.doc_id, r.k): r.first_id for r in got}
    assert {x for (i, _), x in first.items() if i in (1, 2, 3)} == {1}
    assert {x for (i, _), x in first.items() if i == 5} == {5}
    assert similar.groups(make(spark, [])).collect() == []


def group_of_copies(n, words=100):
    """An original and n copies, each with its own few words edited: sibling copies are mostly under 0.8."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    w = [rng.choice(vocabulary) for _ in range(words)]
    out = [" ".join(w)]
    for _ in range(n):
        v = list(w)
        for at in rng.sample(range(words), rng.choice((1, 2, 2, 3, 4))):
            v[at] = rng.choice(vocabulary)
        out.append(" ".join(v))
    return out


def partition_of(spark, texts):
    return [r.first_id for r in sorted(similar.groups(make(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect(), key=lambda r: r.doc_id)]


def test_large_group_of_edited_copies_against_brute_force(spark):
    texts = group_of_copies(1000)
    assert partition_of(spark, texts) == labels_of(len(texts), list(brute_links(texts)))


def test_appended_and_replaced_passages_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(60):
        w, share = some(300), rng.choice((0.05, 0.1, 0.15, 0.2, 0.24, 0.3))
        n = int(300 * share)
        texts += [" ".join(w), " ".join(w + some(n)), " ".join(some(n) + w), " ".join(w[: 150] + some(n // 2) + w[150 + n // 2 :])]
    links = brute_links(texts)
    assert len(links) > 100
    assert partition_of(spark, texts) == labels_of(len(texts), list(links))


def test_no_pair_of_documents_is_missed(spark):
    rows = [(i, r.text) for i, r in enumerate(documents(spark, f"{DATA}/sf0.01").select("text").collect())]
    texts = [t for _, t in rows]
    assert partition_of(spark, texts) == labels_of(len(texts), list(brute_links(texts)))


def test_unlike_nodes_of_one_bucket_all_have_their_turn(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, texts = some(120), []
    for _ in range(40):  # pairs of copies that share much with all others, but not enough
        w = common + some(70)
        v = list(w)
        v[rng.randrange(130, 190)] = "edit"
        texts += [" ".join(w), " ".join(v)]
    links = brute_links(texts)
    assert len(links) == 40
    assert partition_of(spark, texts) == labels_of(len(texts), list(links))


def written(spark):
    """Shuffle bytes that the session's tasks have written so far."""
    jvm = spark.sparkContext._jsc.sc()
    jvm.listenerBus().waitUntilEmpty()
    found = jvm.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_prefixes_shuffle_their_rows_little_when_counts_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(300):  # pairs of copies: every shingle but a few is shared
        w = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(w), " ".join([*w[:299], "edit"])]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")

    def run():
        with common.Scratch() as scratch:
            before = written(spark)
            rows = sorted(map(tuple, similar.prefixes(nodes, similar.LEAST, scratch).select("node", "key", "at", "size").collect()))
            return rows, written(spark) - before

    want, least = run()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 64 << 10)  # the counts are larger
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, most = run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and len(got) > 10_000
    assert most < 3 * least, (most, least)


def test_rows_of_shared_keys(spark, monkeypatch):
    rows = [(k, n, k + n) for k in range(3000) for n in range(1 + k % 3)] + [(-1, n, n) for n in range(500)] + [(-2, n, n) for n in range(41)]
    df = spark.createDataFrame(rows, "key long, node long, x long")
    of = {k: sum(r[0] == k for r in rows) for k in (-1, -2)} | {k: 1 + k % 3 for k in range(3000)}
    want = sorted((k, n, x, of[k]) for k, n, x in rows if of[k] > 1)
    monkeypatch.setattr(similar, "HOT", 40)
    for most in (1 << 20, 4 << 10, 0):  # the counts are broadcast, those of hot keys, none
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        with common.Scratch() as scratch:
            assert sorted(map(tuple, similar.shared_keys(df, scratch).select("key", "node", "x", "n").collect())) == want


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(2)
    for n, m, both in ((40, 50, 30), (5, 900, 5), (3000, 2000, 1500), (1, 1, 0)):
        a, b = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, m, dtype=np.uint64)
        b[:both] = a[:both]
        a, b = np.unique(a), np.unique(b)
        assert similar.most_shared(similar.sketch(a), similar.sketch(b)) >= len(np.intersect1d(a, b))
