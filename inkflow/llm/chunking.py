"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash shifts left and adds a table entry for each byte, so its low 16 bits depend on the last
16 bytes only. A chunk ends where the top five of these bits are zero, after ``LEAST`` bytes at
least and ``MOST`` at most; cuts depend on the bytes around them, so they are found again after an
insertion. A chunk's digest is 128 bits of BLAKE2b. Of equal digests the occurrence of the least
(id, key, position) stays; the others are duplicates. Runs of adjacent duplicate chunks of at least
``RUN`` bytes, or of the whole text, are removed: a single short chunk can repeat by chance.

Each map task keeps one occurrence of a digest in about eight megabytes of text and marks the
others at once, so digests that very many documents share reach their bucket once a chunk of text.

Nulls: a null text is empty; a row with a null id matches nothing and is kept whole. Repeated rows
are one document twice and keep what the first keeps. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, in_arrow, keyed, partitions
from .removal import SPANS, binary_rows, joined, pack, remove, span_batch, unpack
from .suffix import multikey_sort

LEAST, MOST, RUN = 16, 128, 96
MASK = 0xF800
CHUNK = 8 << 20


def gear_table() -> np.ndarray:
    """256 entries of 16 bits, from BLAKE2b of the byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=2).digest(), "little") for b in range(256)], np.uint16)


def gear(text: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The low 16 bits of the gear hash after each byte."""
    h = table[text]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    return h


def cuts(text: bytes, table: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n, out, last = len(text), [], 0
    if not n:
        return out
    ends = np.flatnonzero((gear(np.frombuffer(text, np.uint8), table) & np.uint16(MASK)) == 0) + 1
    for e in ends.tolist():
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST:
            last = e
            out.append(e)
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def first_of(digest: np.ndarray, doc: np.ndarray, k: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first of their digest, and the others; (two words, id, key, position)."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.lexsort((s, k, doc))
    order, new = multikey_sort([digest[by, 0], digest[by, 1]])
    order = by[order]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    lead = order[head]
    same = (doc[order] == doc[lead]) & (k[order] == k[lead]) & (s[order] == s[lead])
    return order[new], order[~same]


def emit(buckets: int):
    """Rows (bucket, kind, block): first occurrences by bucket (kind 0), spans that are settled (kind 1)."""

    def out(docs: list, ks: list, starts: list, ends: list, digests: list) -> pa.RecordBatch:
        n = [len(x) for x in starts]
        doc, k = np.repeat(np.array(docs, np.int64), n), np.repeat(np.array(ks, np.int64), n)
        s, e = np.array([x for y in starts for x in y], np.int64), np.array([x for y in ends for x in y], np.int64)
        digest = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
        first, other = first_of(digest, doc, k, s)
        spans = joined(doc[other], k[other], s[other], e[other])
        bucket = (digest[first, 0] >> np.uint64(40)).astype(np.int64) * buckets >> 24
        ids, kinds, blocks = [], [], []
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        for a, b in zip(cut, np.r_[cut[1:], len(bucket)] if len(bucket) else []):
            own = first[a:b]
            base = int(doc[own].min())
            ids.append(int(bucket[a]))
            kinds.append(0)
            blocks.append(pack([np.array([base], np.int64), doc[own] - base, k[own], s[own], (e - s)[own], digest[own, 0].view(np.uint8), digest[own, 1].view(np.uint8)]))
        if len(spans[0]):
            ids.append(int(spans[0][0] % buckets))
            kinds.append(1)
            blocks.append(pack(list(spans)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.int8()), pa.array(blocks, pa.binary())], names=["bucket", "kind", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, blake, size = gear_table(), hashlib.blake2b, 0
        held = [], [], [], [], []
        for d, k, t in binary_rows(batches):
            ends = cuts(t, table)
            starts = [0, *ends[:-1]] if ends else []
            for at in range(0, len(ends), 1 << 17):
                a, b = starts[at : at + (1 << 17)], ends[at : at + (1 << 17)]
                for part, x in zip(held, (d, k, a, b, b"".join([blake(t[x:y], digest_size=16).digest() for x, y in zip(a, b)]))):
                    part.append(x)
                size += b[-1] - a[0]
                if size >= CHUNK:
                    yield out(*held)
                    held, size = ([], [], [], [], []), 0
        if held[0]:
            yield out(*held)

    return run


def bucket_spans(blocks: list[bytes]) -> pa.RecordBatch:
    """Spans of the chunks of one bucket that aren't the first of their digest."""
    cols = []
    for block in blocks:
        base, doc, k, s, n, d0, d1 = unpack(block)
        cols.append((np.stack([d0.view(np.uint64), d1.view(np.uint64)], axis=1), doc.astype(np.int64) + int(base[0]), k.astype(np.int64), s.astype(np.int64), n.astype(np.int64)))
    digest, doc, k, s, n = (np.concatenate(c) for c in zip(*cols))
    _, other = first_of(digest, doc, k, s)
    return span_batch(doc[other], k[other], s[other], (s + n)[other])


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SPANS from rows (bucket, kind, block) sorted by bucket."""
    now, blocks = None, []
    for batch in batches:
        for bucket, kind, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if kind == 1:
                yield span_batch(*unpack(block.as_py()))
                continue
            if bucket != now and blocks:
                yield bucket_spans(blocks)
                blocks = []
            now = bucket
            blocks.append(block.as_py())
    if blocks:
        yield bucket_spans(blocks)


def duplicate_chunks(docs: DataFrame) -> DataFrame:
    """SPANS of duplicate chunks; ``docs`` is (doc_id, k, text)."""
    n = partitions(docs.sparkSession)
    sent = docs.select("doc_id", "k", "text").transform(in_arrow, emit(4 * n), "bucket int, kind byte, block binary")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").transform(in_arrow, resolve, SPANS)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of runs of duplicate chunks in all documents."""
    docs = keyed(documents(spark, sf_dir))
    return remove(docs, duplicate_chunks(docs), RUN).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
