"""Queries against their SQL over the tables, source mixing, and the pipeline's stages."""

import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from fixtures import ODD, make

from inkflow.llm import decontaminate, mixing, quality
from inkflow.llm.common import documents, row_key
from inkflow.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata"


def rows_of(df):
    plain = lambda x: x.item() if isinstance(x, np.generic) else x
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), c.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_quality_of_odd_rows(spark):
    got = quality.quality(make(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    assert quality.quality(make(spark, [])).collect() == []


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_windows_in_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    item = " ".join(f"b{i}" for i in range(30))
    rows = ODD + [(100, f"own words {item} and others", "en", "a"), (101, "only tiny thing here", "en", "a"), (102, " ".join(item.split()[3:15]), "en", "a"), (103, ("x " * 300) + item, "en", "a")]
    bench = spark.createDataFrame([(1, item), (2, "Tiny, THING"), (3, None), (4, ""), (None, "tiny thing"), (5, "Others")][: 6 if block > 200 else 5], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(make(spark, rows), bench).collect() if r.doc_id and r.doc_id >= 100}
    word = block > 200  # with an item of one word, and without
    assert (got[100].n_hit, got[100].n_items, got[100].contaminated) == (30 + word, 1 + word, True)
    assert (got[101].n_hit, got[101].n_items) == (2, 2)  # the null id is an item of its own
    assert got[102].n_hit == 0 and not got[102].contaminated
    assert (got[103].n_words, got[103].n_hit) == (330, 30)
    assert len(decontaminate.contamination(make(spark, rows), bench).collect()) == len(rows)
    assert decontaminate.contamination(make(spark, []), bench).collect() == []
    assert not any(r.n_hit for r in decontaminate.contamination(make(spark, rows), bench.limit(0)).collect())


def shares(sizes):
    """Targets by filling sources in small steps of the level: independent of the operator's closed form."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal = 1.5 * sum(sizes.values())
    low, high = 0.0, float(2 * sum(sizes.values()) + 1)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(2 * sizes[s], mid * weight[s]) for s in order) < goal:
            low = mid
        else:
            high = mid
    return {s: min(2.0 * sizes[s], high * weight[s]) for s in order}


@pytest.mark.parametrize("block", [64, 3])
def test_mixture(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = documents(spark, f"{DATA}/sf0.01").select("doc_id", "text", "source")
    sizes, most = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        n = len([w for w in (r.text or "").replace("\x0b", " ").replace("\x0c", " ").split() if w])
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
    want, got = shares(sizes), mixing.mix(docs).collect()
    taken = Counter()
    for r in got:
        assert 0 <= r.copies <= 2 and abs(r.target - want[r.source]) < 1e-6 * want[r.source] + 1e-6
        taken[r.source] += r.copies * r.size
    assert len(got) == docs.count()
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mixture_of_odd_rows(spark):
    got = mixing.mix(make(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.copies == 0 for r in got if r.size == 0)
    assert mixing.mix(make(spark, [])).collect() == []


def test_pipeline_stages(spark):
    if not os.path.exists(os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")):
        pytest.skip("the pipeline was left out")
    import corpus_pipeline as p

    folder = f"{DATA}/sf0.001"
    docs = documents(spark, folder)
    kept = p.language_id(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    alone = p.near_duplicates(spark, docs, folder)
    texts = [r.text for r in alone.collect()]
    assert alone.columns == docs.columns and len({(t or "").lower().encode().split().__str__() for t in texts}) == len(texts)
    clean = p.decontamination(spark, docs, folder)
    again = decontaminate.contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in again.where("n_hit = 0").collect())
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    planted = make(spark, [(1, "own words " * 5000 + item + " own words" * 5000, "en", "a"), (2, "own words " * 5000, "en", "a")])
    assert [r.doc_id for r in p.decontamination(spark, planted, folder).collect()] == [2]
    mixed = Counter(r.doc_id for r in p.mixture(spark, docs, folder).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
    assert p.run(spark, folder).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    for odd in (make(spark, ODD), make(spark, [])):
        for _, stage in p.STAGES:
            out = stage(spark, odd, folder)
            assert len(out.collect()) <= 2 * odd.count()
    once = p.near_duplicates(spark, make(spark, ODD), folder).select("doc_id", row_key().alias("key")).collect()
    assert len(once) == len(set(once))
