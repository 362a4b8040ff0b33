"""Personal data: base patterns, and information-theoretic sanitisation of terms that reveal it.

The base finds e-mail addresses, IPv4 addresses, payment card and phone numbers. The values found
are the protected entities. Every word of a document with an entity is a candidate term of it,
wherever it stands. Counts over all documents (with the term, with the entity, with both) estimate
how much the term tells about the entity: their pointwise mutual information, against the entity's
own information content. Where a term gives away at least the share ``DISCLOSURE`` of it, in at
least ``SUPPORT`` documents, each of its occurrences outside base spans gets a span of kind
``term``, in every document. ``sanitise`` replaces spans by their kind, generalising entities and
terms alike.

Pairs are counted in Python before they are shuffled, for entities with support only. Sets of
entities and terms go to Python when their files are small enough to broadcast; rows are joined
when not.

Nulls: a null text is empty; null ids are kept. Repeated rows each give a row and count as
documents. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Stored, documents, in_arrow, row_key

KINDS = ("email", "ip", "card", "phone")
SUPPORT, DISCLOSURE = 2, 0.8
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    # a match can only start where a run of digits does: looking there only takes linear time
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_TERM = r"[^\W\d_]{2,}"


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _emails(text: str, rule: re.Pattern):
    """Leftmost matches, looking only around each @: a match starts where the run of its first
    part's characters before the @ starts, or where the last match ended."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = rule.match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str, rules: dict[str, re.Pattern]) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base matches, sorted."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in _emails(text, rules["email"])]
    for m in rules["card"].finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "." in text:
        for m in rules["ip"].finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in rules["phone"].finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(kind: int, value: str) -> str:
    """A value in the form in which equal ones agree."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else re.sub('[^0-9]', '', value)}"


def terms_of(text: str, term: re.Pattern) -> set[str]:
    """A text's distinct words, in lower case."""
    return {w.lower() for w in set(term.findall(text))}


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, k, spans, entities, found_in) of every document; found_in is the text if it has an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = {k: re.compile(v) for k, v in _PATTERNS.items()}
        for batch in batches:
            spans, entities, texts = [], [], []
            for text in batch.column(2).to_pylist():
                own = base_spans(text or "", rules)
                spans.append([{"s": s, "kind": k, "e": e} for s, k, e in own])
                entities.append(sorted({entity(k, text[s:e]) for s, k, e in own}))
                texts.append(text if own else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("kind", pa.int32()), ("e", pa.int32())]))),
                 pa.array(entities, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["doc_id", "k", "spans", "entities", "found_in"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("k"), "text").transform(in_arrow, run, f"doc_id {kind}, k long, spans array<struct<s:int,kind:int,e:int>>, entities array<string>, found_in string")


def _set(rows: Stored):
    """The first column as a set for Python, if its files are small."""
    return rows.df.sparkSession.sparkContext.broadcast({r[0] for r in rows.df.toLocalIterator()}) if rows.bytes <= BROADCAST_BYTES else None


def pair_counts(with_any: DataFrame, entities: Stored) -> DataFrame:
    """(entity, term, n_both): documents with each of ``entities`` and each term."""
    wanted = _set(entities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, counts = re.compile(_TERM), Counter()
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [w for w in own if wanted is None or w in wanted.value]
                terms = terms_of(text, rule) if own else ()
                for who in own:
                    counts.update((who, t) for t in terms)
                    if len(counts) > 500_000:
                        yield _paired(counts)
                        counts = Counter()
        yield _paired(counts)

    parts = with_any.select("entities", "found_in").transform(in_arrow, run, "entity string, term string, n long")
    if wanted is None:
        parts = parts.join(entities.df, "entity", "left_semi")
    return parts.groupBy("entity", "term").agg(F.sum("n").alias("n_both"))


def _paired(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in counts], pa.string()), pa.array([x[1] for x in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entity", "term", "n"])


def term_counts(docs: DataFrame, terms: Stored) -> DataFrame:
    """(term, n): documents with each of ``terms``."""
    wanted = _set(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, counts = re.compile(_TERM), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    own = terms_of(text, rule)
                    counts.update(own if wanted is None else own & wanted.value)
                    if len(counts) > 500_000:
                        yield _counted(counts)
                        counts = Counter()
        yield _counted(counts)

    parts = docs.select("text").transform(in_arrow, run, "term string, n long")
    if wanted is None:
        parts = parts.join(terms.df, "term", "left_semi")
    return parts.groupBy("term").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, terms: Stored) -> DataFrame:
    """(doc_id, k, terms): the spans of ``terms`` outside base spans, of documents that have any."""
    wanted = _set(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, rules = re.compile(_TERM), {k: re.compile(v) for k, v in _PATTERNS.items()}
        for batch in batches:
            at, spans = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if not text or wanted is not None and terms_of(text, rule).isdisjoint(wanted.value):
                    continue
                base_of, j, own, done = base_spans(text, rules), 0, [], 0
                for m in rule.finditer(text):
                    word = m[0].lower()
                    while j < len(base_of) and base_of[j][0] < m.end():
                        done, j = max(done, base_of[j][2]), j + 1
                    if done <= m.start() and (wanted is None or word in wanted.value):
                        own.append({"term": word, "s": m.start(), "e": m.end()})
                if own:
                    at.append(i)
                    spans.append(own)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(spans, pa.list_(pa.struct([("term", pa.string()), ("s", pa.int32()), ("e", pa.int32())])))], names=["doc_id", "k", "terms"])

    rows = docs.select("doc_id", row_key().alias("k"), "text").transform(in_arrow, run, f"doc_id {kind}, k long, terms array<struct<term:string,s:int,e:int>>")
    if wanted is None:
        rows = rows.select("doc_id", "k", F.explode("terms").alias("t")).select("doc_id", "k", "t.*").join(terms.df, "term", "left_semi").groupBy("doc_id", "k").agg(F.array_sort(F.collect_set(F.struct("s", F.col("term"), "e"))).alias("terms"))
    return rows.dropDuplicates(["doc_id", "k"]).select("doc_id", "k", F.expr(f"transform(terms, t -> struct(t.s as s, {len(KINDS)} as kind, t.e as e))").alias("terms"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, k, spans, terms): base spans and the spans of revealing terms of every document."""
    found = Stored(base(docs)).df
    with_any = found.where("size(spans) > 0")
    total = found.count()
    entities = Stored(with_any.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).where(f"n_entity >= {SUPPORT}"))
    both = Stored(pair_counts(with_any, entities).where(f"n_both >= {SUPPORT}"))
    terms = term_counts(docs, Stored(both.df.select("term").distinct()))
    scored = both.df.join(entities.small(), "entity").join(Stored(terms).small(), "term")
    # information that the term gives about the entity, against the entity's own
    told = F.expr(f"ln({total}D * n_both / (n * n_entity)) >= {DISCLOSURE} * ln({total}D / n_entity) and n_entity < {total}")
    revealing = Stored(scored.where(told).select("term").distinct())
    named = Stored(occurrences(docs, revealing)).small().alias("t")
    return found.alias("f").join(named, F.expr("f.k = t.k and f.doc_id <=> t.doc_id"), "left").select("f.doc_id", "f.k", "spans", F.expr("coalesce(terms, array())").alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts with every span replaced by its kind in brackets."""
    rows = find(docs).select("doc_id", "k", F.expr("array_sort(concat(spans, terms))").alias("all")).distinct()
    names = f"array({', '.join(repr(x) for x in (*KINDS, 'term'))})"
    step = f"""aggregate(all, struct(0 as at, '' as out), (a, x) -> if(x.s < a.at, a, struct(x.e as at, concat(a.out, substr(text, a.at + 1, x.s - a.at), '[', {names}[x.kind], ']') as out)), a -> concat(a.out, substr(text, a.at + 1)))"""
    return docs.select("doc_id", row_key().alias("k"), "text").alias("d").join(rows.alias("r"), F.expr("d.k = r.k and d.doc_id <=> r.doc_id")).select("d.doc_id", F.expr(step).alias("text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents: base spans, and terms that reveal an entity wherever they stand."""
    names = f"array({', '.join(repr(x) for x in (*KINDS, 'term'))})"
    said = f"array_join(transform({{}}, x -> concat({names}[x.kind], ':', x.s, ':', x.e)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find(documents(spark, sf_dir)).select(
        "doc_id", *counts, F.expr(f"sha2({said.format('spans')}, 256)").alias("base_sha256"),
        F.expr(said.format("array_sort(concat(spans, terms))")).alias("spans"), F.expr("cast(size(terms) as bigint)").alias("n_terms"),
    )
