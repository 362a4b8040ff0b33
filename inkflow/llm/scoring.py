"""Language-model scores by deleted interpolation.

The model mixes four estimates of a word: its relative frequency after the two words before it, after
the word before it, and overall, and one over the vocabulary's size plus one for unknown words. A
text's first word follows the end token; only later words have two words before them. The weights
depend on how often the context was seen, in buckets of powers of two: the two words before, or where
these are new the one before. They are learned by expectation-maximisation on a fold of the training
documents that is deleted from the counts for that; scores then use the counts of all training
documents. Expectation-maximisation needs only the ratios of the estimates, so the deleted fold's
tokens are counted in cells of bucket and ratios to half an octave: a table whose size doesn't depend
on the corpus.

Texts become blocks of token numbers, each of one fold, in the shared folder. Every block sends its
distinct words, pairs and triples with their counts to buckets by hash, triples in a round of their
own, so what a third of all tokens share reaches its bucket once a block; the bucket adds up and
answers each block. Words are told apart by 64 bits of XXH64, pairs and triples by 56 bits; sums of
10**9 distinct words have a collision with a chance of 3 %.

Nulls: a null text is empty and has the end token only; a null id counts as the empty text when
folds are drawn. Repeated rows each give a row and train each. Without training documents every
token has probability one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, documents, id_crc, in_arrow, partitions
from .removal import pack, unpack

#: Bytes of text of a block, and of a piece that is split into words at a time.
BLOCK, PIECE = 5 << 20, 4 << 20
SEED = 0
#: The end token's hash, and the multipliers that mix the hashes of a pair.
END, LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9)
FIT, DELETED, HELD_OUT = 0, 1, 2
WORDS, PAIRS, TRIPLES, STATS = 0, 1, 2, 3
BITS = {WORDS: 64, PAIRS: 56, TRIPLES: 56}
FOLDS = 10
#: Weights' buckets: LEVELS by the frequency of the word before, then as many by that of the two words before.
LEVELS, STEPS = 64, 100
#: Ratios of estimates are held to 1/GRAIN of an octave, from 2**-25 to 2**75.
GRAIN, OFFSET, CELLS = 2, 50, 200
_SPACE = b" \t\n\r\x0b\x0c"


def token_hashes(text: bytes) -> np.ndarray:
    """A hash for each lower-cased word, and the end token's."""
    parts, at = [], 0
    while at < len(text):
        to = min(at + PIECE, len(text))
        while to < len(text) and text[to] not in _SPACE:
            to += 1
        words = text[at:to].lower().split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words)))
        at = to
    return np.concatenate([*parts, np.array([END])])


def pair_keys(vocabulary: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """56 bits for each token with the one before it; ``first`` are the texts' first places."""
    before = np.r_[END, vocabulary[index[:-1]]]
    before[first] = END
    z = (before * LEFT) ^ ((vocabulary[index] + (before >> np.uint64(17))) * RIGHT)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(29))) >> np.uint64(8)


def triple_keys(vocabulary: np.ndarray, index: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all tokens but the texts' first, and 56 bits for each with the two before it."""
    later = np.ones(len(index), bool)
    later[first] = False
    at = np.flatnonzero(later)
    z = (pair[at - 1] * RIGHT) ^ ((vocabulary[index[at]] + (pair[at - 1] >> np.uint64(13))) * LEFT)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return at, (z ^ (z >> np.uint64(29))) >> np.uint64(8)


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of eight-byte integers, all lowest ones first: those of small values compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def unplanes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(8, -1).T).view("<u8").ravel()


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unsteps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(unplanes(x), dtype=np.uint64)


def block_of(hashes: list[np.ndarray]) -> bytes:
    vocabulary, index = np.unique(np.concatenate(hashes), return_inverse=True)
    return pack([planes(np.array([len(x) for x in hashes])), planes(index), steps(vocabulary)])


def unblock(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, place of each token in the vocabulary, sorted vocabulary)."""
    length, index, vocabulary = unpack(data)
    return unplanes(length).astype(np.int64), unplanes(index).astype(np.int64), unsteps(vocabulary)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, fold, ids, data) from (doc_id, fold, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, id_type = {}, TaskContext.get().partitionId() << 32, None

        def out(fold):
            nonlocal number
            number += 1
            ids, hashes, _ = held.pop(fold)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([fold], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([block_of(hashes)], pa.binary())], names=["block", "fold", "ids", "data"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                text = text.as_py() or b""
                own = held.setdefault(fold, [[], [], 0])
                own[0].append(i)
                own[1].append(token_hashes(text))
                own[2] += len(text) + 16
                if own[2] >= BLOCK:
                    yield out(fold)
        for fold in sorted(held):
            yield out(fold)

    return docs.select("doc_id", "fold", "text").transform(in_arrow, run, f"block long, fold int, ids array<{kind}>, data binary")


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Buckets that follow the order of the keys."""
    return ((keys >> np.uint64(bits - 24)).astype(np.int64) * buckets) >> 24


def requests(kinds: tuple[int, ...], buckets: int):
    """Rows (part, block, fold, kind, bucket, data): distinct keys of ``kinds`` with their counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, fold, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                length, index, vocabulary = unblock(data.as_py())
                first = np.r_[0, np.cumsum(length)[:-1]]
                pair = pair_keys(vocabulary, index, first)
                rows = []
                for kind in kinds:
                    if kind == WORDS:
                        keys, n = vocabulary, np.bincount(index)
                    else:
                        keys, n = np.unique(pair if kind == PAIRS else triple_keys(vocabulary, index, pair, first)[1], return_counts=True)
                    bucket = bucket_of(keys, BITS[kind], buckets)
                    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
                    for a, b in zip(cut, np.r_[cut[1:], len(keys)]):
                        rows.append((kind * buckets + int(bucket[a]), block, fold, kind, int(bucket[a]), pack([steps(keys[a:b]), planes(n[a:b])] if fold != HELD_OUT else [steps(keys[a:b])])))
                cols = list(zip(*rows)) or [()] * 6
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int8(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "block", "fold", "kind", "bucket", "data"])

    return run


def answer(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (block, kind, bucket, data, v, n, v_fit, n_fit) for the requests (block, fold, kind, bucket, data) of one bucket.

    A block of the deleted fold gets the counts without that fold, and what the fold adds; others
    get the sum. A last row holds the numbers of distinct words and of words."""
    asked = [unpack(x[4]) for x in rows]
    keys = [unsteps(x[0]) for x in asked]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sizes = [len(k) for k in keys]
    fold = np.repeat([x[1] for x in rows], sizes)
    n = np.concatenate([unplanes(x[1]).astype(np.int64) if len(x) > 1 else np.zeros(s, np.int64) for x, s in zip(asked, sizes)])
    fit, deleted = (np.bincount(at[fold == f], n[fold == f], len(distinct)).astype(np.int64) for f in (FIT, DELETED))
    out, start = [], 0
    for (block, own, kind, bucket, _), size in zip(rows, sizes):
        i = at[start : start + size]
        start += size
        out.append((block, kind, bucket, pack([planes(fit[i]), planes(deleted[i])] if own == DELETED else [planes(fit[i] + deleted[i])]), 0, 0, 0, 0))
    if rows[0][2] == WORDS:
        out.append((None, STATS, rows[0][3], b"", int((fit + deleted > 0).sum()), int((fit + deleted).sum()), int((fit > 0).sum()), int(fit.sum())))
    types = (pa.int64(), pa.int8(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["block", "kind", "bucket", "data", "v", "n", "v_fit", "n_fit"])


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers to rows (part, block, fold, kind, bucket, data) sorted by part."""
    now, rows = None, []
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now and rows:
                yield answer(rows)
                rows = []
            now = part
            rows.append(row)
    if rows:
        yield answer(rows)


class Counted:
    """The tokens of a block with the counts that its buckets answered."""

    def __init__(self, table: pa.Table):
        parts = {WORDS: {}, PAIRS: {}, TRIPLES: {}}
        for kind, bucket, data, ids in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["data"], table["ids"]):
            if kind in parts:
                parts[kind][bucket] = unpack(data.as_py())
            else:
                self.ids = ids.values
                self.length, index, vocabulary = unblock(data.as_py())
        self.first = np.r_[0, np.cumsum(self.length)[:-1]]
        self._index, self._parts = index, parts
        self._before = np.r_[0, index[:-1]]
        self._before[self.first] = np.searchsorted(vocabulary, END)
        pair = pair_keys(vocabulary, index, self.first)
        self._later, triple = triple_keys(vocabulary, index, pair, self.first)
        _, self._pair = np.unique(pair, return_inverse=True)
        _, self._triple = np.unique(triple, return_inverse=True)

    def counts(self, which: int = 0) -> np.ndarray:
        """Five rows: for every token the counts of its triple and of the two tokens before it (zero
        for a text's first), of its pair and of the token before it, and of itself."""
        word, pair, triple = (
            np.concatenate([unplanes(x[b][which]) for b in sorted(x)] or [np.zeros(0)]).astype(np.int64) for x in (self._parts[k] for k in (WORDS, PAIRS, TRIPLES)))
        out = np.zeros((5, len(self._index)), np.int64)
        out[2], out[3], out[4] = pair[self._pair], word[self._before], word[self._index]
        out[0, self._later], out[1, self._later] = triple[self._triple], out[2, self._later - 1]
        return out


def level(n: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 if it is new, else 1 + the whole part of log2."""
    return np.frexp(n.astype(float))[1]


def bucket_of_context(counts: np.ndarray) -> np.ndarray:
    return np.where(counts[1] > 0, LEVELS + level(counts[1]), level(counts[3]))


def estimates(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Relative frequencies after two words, after one and overall."""
    triple, two, pair, one, word = counts
    return triple / np.maximum(two, 1), pair / np.maximum(one, 1), word / max(n, 1)


def cells(v: int, n: int):
    """Rows (cell, n): deleted tokens by bucket and by the ratios of their estimates to 1 / (v + 1)."""

    def ratio(x):
        with np.errstate(divide="ignore"):
            q = np.rint(GRAIN * np.log2(x))
        return np.where(x > 0, np.clip(np.where(x > 0, q, 0) + OFFSET, 1, CELLS - 1), 0).astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        counts = Counted(table).counts()
        cell = bucket_of_context(counts).astype(np.int64)
        for x in estimates(counts, n):
            cell = cell * CELLS + ratio(x * (v + 1))
        cell, m = np.unique(cell, return_counts=True)
        return pa.table([pa.array(cell), pa.array(m.astype(np.int64))], names=["cell", "n"])

    return run


def learn(cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights (triple, pair, word, uniform) of each bucket, by expectation-maximisation over the cells.

    A bucket without deleted tokens has the weights of the next lower one with some, of its kind."""
    weights = np.tile(np.array([0.4, 0.3, 0.2, 0.1]), (2 * LEVELS, 1))
    weights[:LEVELS] = (0, 0.5, 0.4, 0.1)
    weights[0] = (0, 0, 0.9, 0.1)
    fixed = weights == 0
    first = weights.copy()
    b = cell // CELLS**3
    ratios = np.stack([np.where(q > 0, 2.0 ** ((q - OFFSET) / GRAIN), 0) for q in (cell // CELLS**2 % CELLS, cell // CELLS % CELLS, cell % CELLS)] + [np.ones(len(cell))], axis=1)
    if len(cell):
        for _ in range(STEPS):
            share = weights[b] * ratios
            share *= (n / share.sum(axis=1))[:, None]
            total = np.stack([np.bincount(b, x, 2 * LEVELS) for x in share.T], axis=1) + 0.01  # no weight becomes zero
            total[fixed] = 0
            weights = total / total.sum(axis=1, keepdims=True)
        seen = np.bincount(b, n, 2 * LEVELS) > 0
        for part in (slice(0, LEVELS), slice(LEVELS, 2 * LEVELS)):
            own = np.flatnonzero(seen[part])
            if not len(own):
                weights[part] = first[part]
                continue
            last = np.maximum.accumulate(np.where(seen[part], np.arange(LEVELS), -1))
            weights[part] = weights[part][np.where(last >= 0, last, own[0])]
        if not seen[0]:
            weights[0] = first[0]
    return weights


def scores(v: int, n: int, weights: np.ndarray, names: list[str]):
    """A row for each document of a block."""

    def run(table: pa.Table) -> pa.Table:
        block = Counted(table)
        counts = block.counts()
        if int(max(table["fold"].to_pylist())) == DELETED:
            counts += block.counts(1)
        w, word = weights[bucket_of_context(counts)], counts[4]
        p = w[:, 3] / (v + 1)
        for i, x in enumerate(estimates(counts, n)):
            p += w[:, i] * x
        if not n:
            p = np.ones(len(word))
        add = lambda x: np.add.reduceat(x, block.first)
        base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
        rows = len(block.length)
        held = int(max(table["fold"].to_pylist())) == HELD_OUT
        return pa.table([block.ids, pa.array([held] * rows), pa.array(block.length), pa.array(add((word > 0).astype(np.int64))), pa.array([n] * rows, pa.int64()), pa.array(add(base)), pa.array(add(np.log10(p)))], names=names)

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) from (doc_id, fold, text).

    ``fold``: FIT and DELETED documents train, the latter also weigh; HELD_OUT ones are only scored."""
    n = partitions(docs.sparkSession)
    own = Stored(blocks(docs)).df

    def ask(*kinds: int) -> DataFrame:
        asked = own.select("block", "fold", "data").transform(in_arrow, requests(kinds, 4 * n), "part int, block long, fold int, kind byte, bucket int, data binary")
        return Stored(asked.repartition(n, "part").sortWithinPartitions("part").transform(in_arrow, answers, "block long, kind byte, bucket int, data binary, v long, n long, v_fit long, n_fit long")).df

    given = ask(WORDS, PAIRS).union(ask(TRIPLES))  # one after the other: shuffle files of the first are gone
    total = given.where(f"kind = {STATS}").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("v", "n", "v_fit", "n_fit"))).first()
    whole = own.select("block", "fold", "ids", F.expr("cast(-1 as byte) as kind"), F.expr("0 as bucket"), "data")

    def joined(where: str) -> DataFrame:
        few = given.where(f"kind <> {STATS}").select("block", F.lit(-1).alias("fold"), F.lit(None).cast(own.schema["ids"].dataType).alias("ids"), "kind", "bucket", "data")
        if where:
            few = few.join(F.broadcast(own.where(where).select("block")), "block", "left_semi").select(*few.columns)
        return (whole.where(where) if where else whole).unionByName(few).groupBy("block")

    # one number for each block of the deleted fold, about a ten-thousandth of a per mille of the text
    counted = joined(f"fold = {DELETED}").applyInArrow(cells(total.v_fit, total.n_fit), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = counted.toArrow().sort_by("cell")
    weights = learn(found["cell"].to_numpy(), found["n"].to_numpy().astype(float))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined("").applyInArrow(scores(total.v, total.n, weights, names), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def folds():
    """Remainder 0 is held out; remainder 1 of the training documents is the deleted fold."""
    return F.expr(f"case pmod(crc32(coalesce(cast(doc_id as string), '')), {FOLDS}) when 0 then {HELD_OUT} when 1 then {DELETED} else {FIT} end")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(documents(spark, sf_dir).select("doc_id", folds().alias("fold"), "text"))
