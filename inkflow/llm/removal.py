"""Cutting byte spans out of texts, and packing of arrays for shuffles."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, store

SPANS = "doc_id long, k long, s long, e long"


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed block; integers take the fewest bytes that hold them."""
    parts = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        if x.dtype == np.int64 and (not len(x) or x.min() >= 0):
            top = int(x.max()) if len(x) else 0
            x = x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
        raw = x.tobytes()
        parts += [struct.pack("<3sQ", x.dtype.str.encode()[:3], len(raw)), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(block: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<3sQ", raw, at)
        at += struct.calcsize("<3sQ")
        x = np.frombuffer(raw, kind.decode(), n // int(kind[2:3]), at)
        out.append(x.astype(np.int64) if x.dtype.kind in "iu" and x.dtype != np.uint8 else x)
        at += n
    return out


def span_batch(doc: np.ndarray, k: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """A batch of SPANS."""
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, k, s, e)], names=["doc_id", "k", "s", "e"])


def joined(doc: np.ndarray, k: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple:
    """Spans of each (doc, k) with those that touch or overlap made one."""
    order = np.lexsort((s, k, doc))
    doc, k, s, e = doc[order], k[order], s[order], e[order]
    if not len(doc):
        return doc, k, s, e
    same = np.r_[False, (doc[1:] == doc[:-1]) & (k[1:] == k[:-1])]
    group = np.cumsum(~same)
    width = int(e.max()) + 1  # running maximum of the ends within each group
    high = np.maximum.accumulate(e + group * width) - group * width
    new = ~same | np.r_[True, s[1:] > high[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], k[first], s[first], high[last]


def remove(docs: DataFrame, spans: DataFrame, least: int = 1, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_found, n_removed, n_spans, kept_sha256), with ``texts`` also ``kept``.

    ``docs`` is (doc_id, k, text) and ``spans`` of type SPANS, in bytes. Runs of fewer than ``least``
    bytes stay, unless they are the whole text. Cut texts need not be whole UTF-8, so ``kept`` is binary.
    """
    own = store(spans).groupBy("doc_id", "k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    both = docs.join(own, ["doc_id", "k"], "left").select("doc_id", F.expr("cast(coalesce(text, '') as binary)").alias("text"), "spans.s", "spans.e")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, s, e in zip(batch.column(1), batch.column(2), batch.column(3)):
                text = text.as_py()
                if not s.is_valid:
                    rows.append((len(text), 0, 0, 0, hashlib.sha256(text).hexdigest(), text))
                    continue
                s, e = s.values.to_numpy(), e.values.to_numpy()
                zero = np.zeros(len(s), np.int64)
                _, _, a, b = joined(zero, zero, s, e)
                stay = (b - a >= least) | (b - a == len(text))
                a, b = a[stay].tolist(), b[stay].tolist()
                kept = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)]))
                rows.append((len(text), len(s), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) if rows else [[]] * 6
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())]
            if texts:
                arrays.append(pa.array(cols[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_found", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts)

    return both.transform(in_arrow, run, f"doc_id {kind}, n_bytes long, n_found long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def binary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, k, text) of batches with these columns; rows without an id are left out."""
    for batch in batches:
        text = batch.column(2).cast(pa.binary())
        for d, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text):
            if d is not None and t.is_valid:
                yield d, k, t.as_py()
