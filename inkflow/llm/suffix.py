"""Removal of repeated 50-byte strings with a suffix array over range-partitioned buckets.

Every 50-byte string holds an anchor: the leftmost 16 bytes with the least hash among its 35
16-byte strings. Equal strings have equal anchors, so only the suffixes that start at anchors (about
one in 18) are sorted; a suffix stands for the run of neighbouring strings that share its anchor and
carries their bytes, those before the anchor reversed.

Splitters from a bounded sample range-partition the suffixes by their leading eight bytes; a leading
token is whole in one bucket, so no equal pair crosses a boundary. A bucket is sorted by multikey
quicksort over eight-byte words, which only goes on within ties, once by what follows the anchor and
once by what precedes it. From the common prefix lengths of neighbours in both orders, strings at
each offset of the anchor fall into classes of equal bytes; those of a document that isn't the least
of its class are removed. Bytes are compared, never only hashes.

Each map task keeps one copy of every distinct run in about eight megabytes of text, that of the
least document, and marks the others at once; so a passage that a third of all documents share
reaches its bucket once for each such chunk. Shuffled blocks are compressed.

Nulls: a null text is empty; a row with a null id matches nothing and is kept whole. Rows with one
id are no smaller than each other; each is compared with smaller ids by its own text. Texts of
fewer than 50 bytes have nothing to remove. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_arrow, keyed, partitions
from .removal import SPANS, binary_rows, joined, pack, remove, span_batch, unpack

WIDTH, ANCHOR = 50, 16
#: Bytes of text whose positions are handled at a time, in which runs are made distinct, and of a piece of a text.
BLOCK, CHUNK, PIECE = 1 << 20, 8 << 20, 4 << 20
#: Documents whose anchors choose the splitters; they only even out the buckets.
SAMPLE = 4000
LEFT, RIGHT = 40, 56  # bytes held before and after an anchor, in whole words


def multikey_sort(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, word by word within ties only; and which rows, in order, differ from the last."""
    n = len(columns[0])
    order = np.argsort(columns[0], kind="stable")
    s = columns[0][order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    for c in columns[1:]:
        tied = ~(new & np.r_[new[1:], True])
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, word = np.cumsum(new)[at], c[order[at]]
        sub = np.lexsort((word, group))
        order[at] = order[at][sub]
        word = word[sub]
        new[at[1:]] |= word[1:] != word[:-1]  # other groups already begin with new
    return order, new


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as an integer, first byte highest."""
    v = text.astype(np.uint64)
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        v = (v[:-step] << np.uint64(shift)) | v[step:]
    return v


def runs(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, last string, anchor) of each run of 50-byte strings that share an anchor.

    ``text`` holds whole pieces, one after the other, from start to end."""
    none = np.zeros(0, np.int64)
    if len(text) < WIDTH:
        return none, none, none
    w = words_at(text)
    h = w[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (w[8:] ^ (w[8:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    m = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, size = WIDTH - ANCHOR + 1, 1
    while 2 * size <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if span > size:
        m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
    anchor = (m & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.ones(len(text), bool)
    tail = end[:, None] - np.arange(1, WIDTH)
    valid[tail[tail >= start[:, None]]] = False
    valid = valid[: len(anchor)]
    begins = valid.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    ends = valid.copy()
    ends[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    a = np.flatnonzero(begins)
    return a, np.flatnonzero(ends), anchor[a]


def contexts(text: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words after and before each anchor, zero beyond the run's bytes."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), text, np.zeros(RIGHT, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, LEFT + RIGHT)[p]
    right, left = view[:, LEFT:].copy(), view[:, LEFT - 1 :: -1].copy()
    right[np.arange(RIGHT) >= (b + WIDTH - p)[:, None]] = 0
    left[np.arange(LEFT) >= (p - a)[:, None]] = 0
    return right, left


def as_words(rows: np.ndarray) -> list[np.ndarray]:
    return list(rows.view(">u8").astype(np.uint64).T)


class Chunk:
    """Runs of some megabytes of text, one row for each occurrence."""

    def __init__(self):
        self.size, self.rows = 0, []

    def add(self, pieces: list[tuple[int, int, int, bytes]]) -> None:
        """pieces: (doc_id, k, offset, bytes)."""
        text = np.frombuffer(b"".join(x[3] for x in pieces), np.uint8)
        length = np.array([len(x[3]) for x in pieces])
        end = np.cumsum(length)
        start = end - length
        a, b, p = runs(text, start, end)
        own = np.searchsorted(end, a, side="right")
        right, left = contexts(text, a, b, p)
        doc, k, off = (np.array([x[i] for x in pieces], np.int64)[own] for i in range(3))
        self.rows.append((right, left, doc, k, p - start[own] + off, p - b, p - a))
        self.size += len(text)

    def distinct(self):
        """Representatives (right, left, doc, k, low, high, count, places) in suffix order, and spans of the others."""
        right, left, doc, k, place, low, high = (np.concatenate(x) for x in zip(*self.rows))
        self.size, self.rows = 0, []
        order, new = multikey_sort([*as_words(right), *as_words(left), (low * 64 + high).astype(np.uint64)])
        group = np.cumsum(new) - 1
        d = doc[order]
        least = np.minimum.reduceat(d, np.flatnonzero(new))[group] if len(d) else d
        other = order[d > least]
        spans = joined(doc[other], k[other], place[other] - high[other], place[other] - low[other] + WIDTH)
        own, group = order[d == least], group[d == least]
        again = np.lexsort((place[own], k[own], group))
        own, group = own[again], group[again]
        first = np.ones(len(own), bool)
        first[1:] = (group[1:] != group[:-1]) | (k[own][1:] != k[own][:-1])
        rep = own[first]
        count = np.diff(np.r_[np.flatnonzero(first), len(own)])
        return (right[rep], left[rep], doc[rep], k[rep], low[rep], high[rep], count, place[own]), spans


def pieces_of(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Blocks of pieces; a long text is cut so that every 50-byte string is in one piece."""
    block, size = [], 0
    for d, k, t in rows:
        for at in range(0, max(len(t) - WIDTH + 1, 0), PIECE):
            part = t[at : at + PIECE + WIDTH - 1]
            block.append((d, k, at, part))
            size += len(part)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def emit(splitters: np.ndarray):
    """Rows (bucket, kind, block): runs by bucket (kind 0), spans that are settled (kind 1)."""

    def out(chunk: Chunk) -> pa.RecordBatch:
        (right, left, doc, k, low, high, count, places), spans = chunk.distinct()
        bucket = np.searchsorted(splitters, as_words(right[:, :8])[0] if len(right) else np.zeros(0, np.uint64), side="right")
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        at = np.r_[0, np.cumsum(count)]
        ids, kinds, blocks = [], [], []
        for a, b in zip(cut, np.r_[cut[1:], len(bucket)]):
            r, x = right[a:b], left[a:b]
            base = int(doc[a:b].min())
            flat = [r[np.arange(RIGHT) < (WIDTH - low[a:b])[:, None]], x[np.arange(LEFT) < high[a:b][:, None]]]
            ids.append(int(bucket[a]))
            kinds.append(0)
            blocks.append(pack([np.array([base], np.int64), doc[a:b] - base, k[a:b], low[a:b], high[a:b], count[a:b], places[at[a] : at[b]], *flat]))
        if len(spans[0]):
            ids.append(int(spans[0][0] % (len(splitters) + 1)))
            kinds.append(1)
            blocks.append(pack(list(spans)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.int8()), pa.array(blocks, pa.binary())], names=["bucket", "kind", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for block in pieces_of(binary_rows(batches)):
            chunk.add(block)
            if chunk.size >= CHUNK:
                yield out(chunk)
        if chunk.rows:
            yield out(chunk)

    return run


def prefix_lengths(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 16):
        b = min(a + (1 << 16), len(rows))
        other = rows[a:b] != rows[a - 1 : b - 1]
        first = other.argmax(axis=1)
        out[a:b] = np.where(other.any(axis=1), first, rows.shape[1])
    return out


def repeated(right, left, doc, low, high):
    """(row, least offset, greatest offset) of the rows with strings that an earlier document has."""
    order, new = multikey_sort(as_words(right[:, :ANCHOR]))
    tied = order[~(new & np.r_[new[1:], True])]  # the others' anchors occur once
    right, left, doc, low, high = (x[tied] for x in (right, left, doc, low, high))
    r_order, _ = multikey_sort(as_words(right)) if len(tied) else (tied, tied)
    l_order, _ = multikey_sort(as_words(left)) if len(tied) else (tied, tied)
    r_lcp, l_lcp = prefix_lengths(right[r_order]), prefix_lengths(left[l_order])

    def best(order, lcp):
        out = np.zeros(len(order), np.int64)
        out[order] = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(lcp) else lcp
        return out

    # a match of 50 bytes must be within what a row shares with its nearest rows on either side
    near = best(r_order, r_lcp) + best(l_order, l_lcp) >= WIDTH
    lo, hi = np.full(len(doc), WIDTH), np.full(len(doc), -1)
    for o in range(WIDTH - ANCHOR + 1):
        use = np.flatnonzero(near & (low <= o) & (o <= high))
        if len(use) < 2:
            continue
        r_class, l_class = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        r_class[r_order] = np.cumsum(r_lcp < WIDTH - o)
        l_class[l_order] = np.cumsum(l_lcp < o)
        both = r_class[use] * (len(doc) + 1) + l_class[use]
        by = np.argsort(both, kind="stable")
        s = both[by]
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        least = np.repeat(np.minimum.reduceat(doc[use][by], head), np.diff(np.r_[head, len(s)]))
        hit = use[by][doc[use][by] > least]
        lo[hit] = np.minimum(lo[hit], o)
        hi[hit] = np.maximum(hi[hit], o)
    got = hi >= 0
    return tied[got], lo[got], hi[got]


def bucket_spans(blocks: list[bytes]) -> pa.RecordBatch:
    """Spans to remove that one bucket's runs give."""
    cols = []
    for block in blocks:
        base, doc, k, low, high, count, places, right, left = unpack(block)
        low, high = low.astype(np.int64), high.astype(np.int64)
        r, x = np.zeros((len(doc), RIGHT), np.uint8), np.zeros((len(doc), LEFT), np.uint8)
        r[np.arange(RIGHT) < (WIDTH - low)[:, None]] = right
        x[np.arange(LEFT) < high[:, None]] = left
        cols.append((r, x, doc.astype(np.int64) + int(base[0]), k.astype(np.int64), low, high, count.astype(np.int64), places.astype(np.int64)))
    right, left, doc, k, low, high, count, places = (np.concatenate(c) for c in zip(*cols))
    row, lo, hi = repeated(right, left, doc, low, high)
    first = np.r_[0, np.cumsum(count)]
    n = count[row]
    at = np.repeat(first[row] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(row) else np.zeros(0, np.int64)
    where = places[at]
    return span_batch(*joined(np.repeat(doc[row], n), np.repeat(k[row], n), where - np.repeat(hi, n), where - np.repeat(lo, n) + WIDTH))


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


def splitters(docs: DataFrame, buckets: int) -> np.ndarray:
    """Leading words that part a sample's anchored suffixes evenly."""
    n = docs.count()
    part = docs.sample(min(1.0, SAMPLE / max(n, 1)), seed=1) if n > SAMPLE else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces_of(binary_rows(batches)):
            chunk = Chunk()
            chunk.add(block)
            lead = as_words(chunk.rows[0][0][:, :8])[0]
            yield pa.RecordBatch.from_arrays([pa.array([lead[::8].tobytes()], pa.binary())], names=["lead"])

    found = [r.lead for r in part.select("doc_id", F.lit(0).cast("long").alias("k"), "text").transform(in_arrow, run, "lead binary").collect()]
    lead = np.unique(np.frombuffer(b"".join(bytes(x) for x in found), np.uint64))
    return lead[np.linspace(0, len(lead) - 1, buckets + 1).astype(int)[1:-1]] if len(lead) > buckets else lead


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """SPANS of the bytes that 50-byte strings of smaller documents cover; ``docs`` is (doc_id, k, text)."""
    spark = docs.sparkSession
    cuts = splitters(docs.select("doc_id", "text"), 4 * partitions(spark))
    sent = docs.select("doc_id", "k", "text").transform(in_arrow, emit(cuts), "bucket int, kind byte, block binary")
    return sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").transform(in_arrow, resolve, SPANS)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of repeated 50-byte strings in all documents."""
    docs = keyed(documents(spark, sf_dir))
    return remove(docs, duplicate_spans(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
