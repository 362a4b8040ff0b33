"""Language identification with hyperdimensional profiles.

Every letter has a pseudo-random vector of +1 and -1, derived from its code point. A letter
trigram's vector binds (multiplies) its letters' vectors, the first two rotated by two places and
one place. A text's vector bundles (adds) the vectors of its trigrams; a language's prototype
bundles those of its training documents, at equal weight for each document, less the mean of all
languages' directions. A document gets the language of the prototype with the highest cosine.

Counts of trigrams are gathered first and multiplied with the trigrams' vectors as matrices; the
sums are the same. Prototypes are summed in a tree over tasks, so what reaches the driver is
languages x dimensions, whatever the number of documents.

Nulls: a null or empty text, or one without a letter, is ``und`` with score 0. A null language
doesn't train; a null id counts as the empty text when the training set is drawn. With no training
rows all is ``und``. Repeated rows each give a row. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, documents, id_crc, in_arrow, row_key, store

DIM = 1024
#: Documents and characters that are counted at a time, and trigrams whose vectors are made at a time.
DOCS, CHARS, GRAMS = 256, 1 << 20, 4096
#: Labels are few; more than this is a mistake in the input.
MAX_LANGS = 10_000
UNKNOWN = "und"
#: Rejection: distances of the quartiles below the lower one, and widths of the spread of unrelated vectors.
REACH, CHANCE = 3, 5


def letter_table() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A row of +1 and -1 for each code point, from a splitmix64 stream seeded by it."""
    with np.errstate(over="ignore"):
        z = letters.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + np.arange(1, dim // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (np.unpackbits(z.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).reshape(len(letters), dim)


def chunks(texts: list) -> Iterator[tuple[int, list]]:
    """Runs of texts that are counted together, with the index of their first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= DOCS or size + len(t or "") > CHARS):
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield at, texts[at:]


def count_grams(texts: list, table: np.ndarray):
    """(document, column) of every trigram, and each column's three letters."""
    joined = "".join(f"\0{t or ''}\0" for t in texts)
    code = table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), [len(t or "") + 2 for t in texts])
    keep = code != 0
    keep[1:] |= (code[:-1] != 0) | (doc[1:] != doc[:-1])
    keep[0] = True
    code, doc = code[keep], doc[keep]
    letters = np.flatnonzero(np.bincount(code))
    n = len(letters)
    index = np.zeros(int(letters[-1]) + 1, np.int64)
    index[letters] = np.arange(n)
    x = index[code]
    ok = doc[2:] == doc[:-2]
    gram, doc = ((x[:-2] * n + x[1:-1]) * n + x[2:])[ok], doc[2:][ok]
    if n**3 <= 1 << 23:
        seen = np.zeros(n**3, bool)
        seen[gram] = True
        kinds = np.flatnonzero(seen)
        column = (np.cumsum(seen) - 1)[gram]
    else:
        kinds, column = np.unique(gram, return_inverse=True)
    return doc, column, letters[np.stack([kinds // n // n, kinds // n % n, kinds % n])]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    letters, at = np.unique(grams, return_inverse=True)
    v = letter_vectors(letters)
    at = at.reshape(grams.shape)
    return (np.roll(v, 2, axis=1)[at[0]] * np.roll(v, 1, axis=1)[at[1]] * v[at[2]]).astype(np.float32)


def vectors(texts: list, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, zeros where there is no letter; and its number of trigrams."""
    out = np.zeros((len(texts), DIM), np.float32)
    doc, column, grams = count_grams(texts, table)
    width = grams.shape[1]
    for a in range(0, width, GRAMS):
        b = min(a + GRAMS, width)
        here = slice(None) if width <= GRAMS else (column >= a) & (column < b)
        counts = np.bincount(doc[here] * (b - a) + (column[here] - a), minlength=len(texts) * (b - a)).reshape(len(texts), b - a)
        out += counts.astype(np.float32) @ gram_vectors(grams[:, a:b])
    return out, np.bincount(doc, minlength=len(texts))


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from rows of ``text`` and a non-null ``lang``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = letter_table(), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in chunks(texts):
                v, _ = vectors(part, table)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.maximum(norm, 1e-9)
                own = langs[at : at + len(part)]
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + v[[x == lang for x in own]].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = store(docs.where("lang is not null").select("text", "lang").transform(in_arrow, partial, "lang string, v array<double>"))
    rows = parts.select("lang", F.posexplode("v").alias("j", "x")).groupBy("lang", "j").agg(F.sum("x").alias("x"))
    # integers, so that the order in which parts are added doesn't show
    rows = rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("j", F.expr("cast(round(x * 1e6) as bigint)").alias("x")))).alias("v"))
    found = {r.lang: np.array([x.x for x in r.v], float) for r in rows.limit(MAX_LANGS + 1).toLocalIterator()}
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    unit = {k: v / n for k, v in sorted(found.items()) if (n := np.linalg.norm(v)) > 0}
    if len(unit) > 1:
        mean = np.mean(list(unit.values()), axis=0)
        unit = {k: d / max(np.linalg.norm(d), 1e-12) for k, v in unit.items() for d in [v - mean]}
    return unit


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred, score and the number of trigrams; ``docs`` has them and ``text``."""
    names = list(prototypes)
    sent = keep if "text" in keep else [*keep, "text"]
    place = sent.index("text")
    matrix = np.array([prototypes[x] for x in names], np.float32).reshape(len(names), DIM)
    fields = [docs.schema[x] for x in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, grams long"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            pred, scores, sizes = [], [], []
            for _, part in chunks(texts):
                v, grams = vectors(part, table)
                sizes += grams.tolist()
                norm = np.linalg.norm(v, axis=1)
                if not names:
                    pred += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                cos = (v @ matrix.T) / np.maximum(norm, 1e-9)[:, None]
                best = cos.argmax(axis=1)
                top = np.clip(cos[np.arange(len(part)), best], 0, 1).astype(float)
                pred += [names[b] if n > 0 else UNKNOWN for b, n in zip(best, norm)]
                scores += [float(t) if n > 0 else 0.0 for t, n in zip(top, norm)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], names=[*keep, "lang_pred", "score", "grams"])

    return docs.select(*(F.col(f"`{x}`") for x in sent)).transform(in_arrow, score, schema)


def rejected(docs: DataFrame) -> DataFrame:
    """(id, key) of the rows that are in none of the languages learnt from the rows with one; key is ``row_key``.

    These are texts without a letter, and those whose score is an outlier among texts of about their
    number of trigrams (below the lower quartile by more than ``REACH``
    times the distance of the quartiles) and no more than an unrelated text gets by chance: cosines of
    unrelated vectors spread by 1 / sqrt(DIM), and ``CHANCE`` such widths are the bound. Scores of short
    texts spread widely, so no short text is an outlier unless most texts of its length do better. Where
    nothing was learnt only texts without a letter are rejected.
    """
    prototypes = train(docs)
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    found = store(predict(rows, prototypes, ["doc_id", "key"]))
    sized = found.where(f"lang_pred <> '{UNKNOWN}'").select("doc_id", "key", "score", F.expr("length(bin(grams))").alias("class"), F.expr("cast(round(score * 1000) as int)").alias("bucket"))
    # a histogram of at most a thousand buckets by class of lengths
    upto = sized.groupBy("class", "bucket").agg(F.count("*").alias("n")).select("*", F.expr("sum(n) over (partition by class order by bucket)").alias("upto"), F.expr("sum(n) over (partition by class)").alias("total"))
    fences = upto.groupBy("class").agg(F.expr("min(bucket) filter (where 4 * upto >= total)").alias("q1"), F.expr("min(bucket) filter (where 4 * upto >= 3 * total)").alias("q3"))
    limits = fences.select("class", F.expr(f"q1 - {REACH} * (q3 - q1)").alias("fence"))
    outliers = sized.where(f"score < {CHANCE / DIM**0.5!r}").join(Stored(limits).small(), "class").where("bucket < fence")
    letterless = found.where("grams = 0")
    return letterless.select("doc_id", "key").union(outliers.select("doc_id", "key")).select(F.col("doc_id").alias("id"), "key").distinct()


def held_out():
    return F.pmod(id_crc(), F.lit(4)) == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from those that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out().alias("held_out"))
    return predict(docs, train(docs.where("not held_out")), ["doc_id", "held_out"]).drop("grams")
