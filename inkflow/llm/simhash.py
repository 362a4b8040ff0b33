"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within three bits differ in at most one bit in one of their 32-bit
halves, one being half of three, rounded down. (Variants of the whole fingerprint would have to
reach two bits: 2,081 keys a fingerprint, 33 KB, against 34 keys on average here.) So every distinct fingerprint emits the variants
of each half within that radius: the half itself and the half with one set bit cleared (of two
halves that differ in one bit, one has it set and reaches the other). Rows meet by variant, the
colliding fingerprints are verified over all 64 bits, and components are found over the links.

Equal fingerprints are one row from the start, with their least id, so exact copies cost nothing
more. Rows that meet are compared in blocks; a variant that very many fingerprints share is
resolved by looking up its other half's variants instead, in time linear in their number. Of the
links within a variant only a spanning tree is sent on, never all pairs.

Nulls: a null, empty or blank text has fingerprint zero; null ids take no part in the minimum (a
component of null ids only has a null id). Repeated rows each give a row. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, dealt_join, documents, in_arrow, store, with_minimum
from .graph import components, local_components, trees

SHINGLE, SEED = 3, 42
#: Rows of one variant that are compared pair by pair; beyond, its other half is looked up.
DENSE = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash over XXH64 of lower-cased word shingles, unsigned."""
    w = text.lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else iter([b" ".join(w)])
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(in_arrow, run, f"doc_id {kind}, fp long")


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ball, fp): each half of a fingerprint, and each half with a set bit cleared."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for a in range(0, len(fp), 50_000):
            part = fp[a : a + 50_000]
            keys, balls, who = [], [], []
            for half in (0, 1):
                v = (part >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                tag = np.uint64(half << 32)
                keys.append(v | tag)
                balls.append(np.zeros(len(v), np.int8))
                who.append(part)
                for bit in range(32):
                    has = (v >> np.uint64(bit)) & np.uint64(1) == 1
                    keys.append((v[has] ^ np.uint64(1 << bit)) | tag)
                    balls.append(np.ones(int(has.sum()), np.int8))
                    who.append(part[has])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(balls)), pa.array(np.concatenate(who).view(np.int64))], names=["key", "ball", "fp"])


def _dense(fp: np.ndarray, centres: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the first ``centres`` fingerprints and all."""
    found = []
    for a in range(0, centres, 256):
        near = np.bitwise_count(fp[a : min(a + 256, centres), None] ^ fp[None, :]) <= 3
        x, y = np.nonzero(near)
        found.append((x + a, y))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _lookup(fp: np.ndarray, centres: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The same links' components, for very many fingerprints of one variant of ``half``.

    Every value within one bit of a centre's other half stands for the centres around it, which are
    within two bits of each other. Centres within two bits of the value, and others (one bit off in
    ``half``) within one bit of it, are within three bits of those centres.
    """
    other = ((fp >> np.uint64(32 * (1 - half))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    one = [np.uint32(0), *(np.uint32(1 << i) for i in range(32))]
    two = [np.uint32(1 << i | 1 << j) for i, j in combinations(range(32), 2)]
    value = np.concatenate([other[:centres] ^ m for m in one])
    owner = np.tile(np.arange(centres), len(one))
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    a, b = [owner], [np.repeat(owner[first], np.diff(np.r_[first, len(value)]))]
    value, owner = value[first], owner[first]
    for who, masks in ((np.arange(centres), two), (np.arange(centres, len(fp)), one)):
        for m in masks:
            q = other[who] ^ m
            at = np.minimum(np.searchsorted(value, q), len(value) - 1)
            hit = value[at] == q
            a.append(who[hit])
            b.append(owner[at[hit]])
    return np.concatenate(a), np.concatenate(b)


def meet(key: np.ndarray, ball: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges between fingerprints that link within a key; rows are sorted by key, centres first."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    use = (size > 1) & (ball[start] == 0)
    a, b = [], []
    for s, n in zip(start[use & (size > 64)], size[use & (size > 64)]):
        own, centres = fp[s : s + n], int(n - ball[s : s + n].sum())
        x, y = _dense(own, centres) if n <= DENSE else _lookup(own, centres, int(key[s] >> 32) & 1)
        label = local_components(int(n), x, y)
        child, parent = trees(label)
        a.append(child + s)
        b.append(parent + s)
    few = use & (size <= 64)
    rows = np.flatnonzero(np.repeat(few, size))
    end = np.repeat(np.where(few, start + size, 0), size)[rows]
    centre = ball[rows] == 0
    rows, end = rows[centre], end[centre]
    for d in range(1, 64):
        ok = rows + d < end
        rows, end = rows[ok], end[ok]
        if not len(rows):
            break
        near = np.bitwise_count(fp[rows] ^ fp[rows + d]) <= 3
        a.append(rows[near])
        b.append(rows[near] + d)
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    child, parent = trees(local_components(len(nodes), at[: len(a)], at[len(a) :]))
    return fp[nodes[child]], fp[nodes[parent]]


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): links found in rows (key, ball, fp) sorted by key and ball."""
    rest = None
    empty = True

    def out(part):
        u, v = meet(part[0], part[1], part[2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        if not len(now[0]):
            continue
        empty = False
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        cut = np.searchsorted(now[0], now[0][-1])  # the last key may go on
        if cut:
            yield out([x[:cut] for x in now])
        rest = [x[cut:] for x in now]
    if not empty:
        yield out(rest)


def print_links(prints: DataFrame) -> DataFrame:
    """(u, v): links that join the same components as all links of three bits or fewer of distinct ``fp``."""
    met = prints.select("fp").transform(in_arrow, variants, "key long, ball byte, fp long").repartition("key").sortWithinPartitions("key", "ball")
    return met.transform(in_arrow, links, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    prints = store(fingerprints(docs, shingle))
    distinct = Stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"))).df
    labels = components(print_links(distinct))
    linked = labels.join(distinct, labels.node == distinct.fp).select("fp", "root", "least")
    of_linked = with_minimum(linked, "root", "least", "component_id").select("fp", "component_id")
    of_all = Stored(distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    both = prints.join(of_all.small(), "fp") if of_all.is_small else dealt_join(prints, "fp", "doc_id", of_all.df)
    return both.select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
