"""Benchmark decontamination: a prefix-filtered join of documents with item-sized windows.

A document matches a window only if it holds the window's words in order, so it must hold the
window's rarest shingle of two words (its word, if it has but one). Shingles are ordered by their
count over all documents; that one necessary prefix shingle of each window, with its offset, is
joined with the shingles of the documents. Length and position bounds discard alignments that leave
the document, and the words of the rest are compared in full.

The windows' table is broadcast in blocks of bounded bytes: one block unless the benchmark is
large, else one pass over the documents for each block.

Nulls: a null text has no words, a null item id counts as the empty text. An item without words
has no window; items of fewer than ``WINDOW`` words are one window. Repeated rows each give a
row; repeated items count once. Other columns of the inputs are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, _sql, documents, row_key, store, table

WINDOW = 13
#: Bytes of the windows' words and item ids in one broadcast block.
BLOCK_BYTES = 32 << 20
#: Words of a segment of a document, without its overlaps.
SEGMENT = 128
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str = "text") -> str:
    between = _sql(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return f"filter(split(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{between}'), w -> w <> '')"


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win, items): each distinct window with the ids of the items that hold it, as strings."""
    items = benchmark.select(F.expr("coalesce(cast(item_id as string), '')").alias("item"), F.expr(_words()).alias("w")).where("size(w) > 0")
    return items.select("item", F.expr(f"explode(if(size(w) <= {size}, array(w), transform(sequence(0, greatest(size(w) - {size}, 0)), i -> slice(w, i + 1, {size}))))").alias("win")).groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _shingles(w: str, single: bool, most: int | None = None) -> str:
    """SQL for struct(at, token) of the two-word shingles of a column of words, with ``single`` of its words too.

    A shingle has a space and so differs from every word; the one that would start at the last word is null.
    ``most`` is the number of words at which a shingle may start."""
    numbered = lambda x: f"transform({x}, (t, i) -> struct(i as at, t as token))"
    pairs = numbered(f"zip_with({w}, slice({w}, 2, greatest(size({w}), 1)), (a, b) -> concat(a, ' ', b))")
    return f"concat({pairs}, {numbered(f'slice({w}, 1, {most})' if most else w)})" if single else pairs


def prefixes(wins: DataFrame, docs: DataFrame, single: bool) -> DataFrame:
    """The windows with their rarest shingle (``token``) and its place (``off``); ``single`` if some have one word."""
    own = wins.select("win", F.explode(F.expr(f"filter({_shingles('win', single)}, t -> t.token is not null and (size(win) = 1 or instr(t.token, ' ') > 0))")).alias("t")).select("win", F.col("t.at").alias("off"), "t.token")
    vocabulary = Stored(own.select("token").distinct()).small()
    said = docs.select(F.expr(_words()).alias("w")).select(F.explode(F.expr(_shingles("w", single))).alias("t")).select("t.token")
    counts = said.join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    placed = own.join(Stored(counts).small(), "token", "left")
    first = placed.groupBy("win").agg(F.expr("min(struct(coalesce(n, 0L) as n, token, off))").alias("p"))
    return first.join(wins, "win").select("win", "items", F.col("p.token").alias("token"), F.col("p.off").alias("off"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document: its ``row_key`` as k, hit words and items; contaminated if ``share * n_hit >= n_words``."""
    wins = store(windows(benchmark, size))
    held = wins.agg(F.expr("sum(octet_length(array_join(win, ' ')) + octet_length(array_join(items, ' ')))").alias("bytes"), F.expr("min(size(win)) = 1").alias("single")).first()
    blocks, single = max(1, -(-(held.bytes or 0) // BLOCK_BYTES)), bool(held.single)
    placed = store(prefixes(wins, docs, single))
    found = [_matches(docs, placed.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b) if blocks > 1 else placed, b == 0, size, single) for b in range(blocks)]
    rows = reduce(DataFrame.unionByName, found)
    by_doc = rows.groupBy("doc_id", "k").agg(
        F.max("n_words").alias("n_words"), F.sum("head").alias("copies"), F.flatten(F.collect_set("hits")).alias("hits")
    )
    done = by_doc.select(
        "doc_id", "k", "n_words", "copies",
        F.expr("cast(size(array_distinct(flatten(transform(hits, h -> sequence(h.start, h.start + h.len - 1))))) as bigint)").alias("n_hit"),
        F.expr("array_sort(array_distinct(flatten(transform(hits, h -> h.items))))").alias("ids"),
    )
    return done.select(
        "doc_id", "k", "n_words", "n_hit", F.expr("cast(size(ids) as bigint)").alias("n_items"), F.expr("sha2(array_join(ids, ','), 256)").alias("items_sha256"),
        F.expr(f"n_hit > 0 and {share} * n_hit >= n_words").alias("contaminated"), F.expr("explode(sequence(1L, copies))").alias("copy"),
    ).drop("copy")


def _matches(docs: DataFrame, placed: DataFrame, header: bool, size: int, single: bool) -> DataFrame:
    """Verified windows of each document, and with ``header`` one row without any for every document.

    Documents are cut into segments that overlap by a window on both sides, so a token's row holds
    only the words that a window around it can need, however long the document is."""
    by_token = F.broadcast(placed.groupBy("token").agg(F.collect_list(F.struct("off", "win", "items")).alias("cands")))
    base = docs.select("doc_id", row_key().alias("k"), F.expr(_words()).alias("w"))
    edge = size - 1
    cut = f"""transform(if(size(w) = 0, array(0), sequence(0, greatest(size(w) - 1, 0), {SEGMENT})),
        s -> struct(s as s, least(s, {edge}) as lead, slice(w, greatest(s - {edge}, 0) + 1, least(s, {edge}) + {SEGMENT + edge}) as seg, slice(w, s + 1, {SEGMENT + 1}) as own))"""
    segments = base.select("doc_id", "k", F.expr("cast(size(w) as bigint)").alias("n_words"), F.explode(F.expr(cut)).alias("x")).select("doc_id", "k", "n_words", "x.s", "x.lead", "x.seg", "x.own")
    # place 0 stands for the segment itself, shingles count from 1; the last one's second word is in the overlap
    here = F.explode(F.expr(f"concat(array(struct(-1 as at, cast(null as string) as token)), {_shingles('own', single, SEGMENT)})")).alias("t")
    tokens = segments.select("doc_id", "k", "n_words", "s", "lead", "seg", here).select("doc_id", "k", "n_words", "s", "lead", "seg", F.expr("t.at + 1 as at"), "t.token")
    kept = tokens.join(by_token, "token", "left").where("(at = 0 and s = 0) or cands is not null") if header else tokens.join(by_token, "token")
    verified = """transform(filter(coalesce(cands, array()), c -> lead + at - 1 >= c.off and lead + at - 1 - c.off + size(c.win) <= size(seg)
        and slice(seg, lead + at - c.off, size(c.win)) = c.win), c -> struct(s + at - 1 - c.off as start, size(c.win) as len, c.items as items))"""
    return kept.select("doc_id", "k", "n_words", F.expr("if(at = 0, 1L, 0L)").alias("head"), F.expr(verified).alias("hits"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words of every document against every benchmark item."""
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("k")


_W = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, {_W} as w from documents),
b as (select coalesce(item_id::varchar, '') as item, {_W} as w from benchmark),
iw as (select distinct item, least(len(w), {WINDOW}) as m, unnest(list_transform(range(0, len(w) - least(len(w), {WINDOW}) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), {WINDOW})], ' '))) as s from b where len(w) > 0),
dw as (select r, m, i, array_to_string(w[i + 1 : i + m], ' ') as s from (select r, w, m, unnest(range(0, len(w) - m + 1)) as i from d, (select distinct m from iw) where len(w) >= m)),
hit as (select r, i, dw.m, item from dw join iw on dw.s = iw.s and dw.m = iw.m),
h as (select r, count(distinct p) as n from (select r, unnest(range(i, i + m)) as p from hit) group by r),
it as (select r, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(it.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) as contaminated
from d left join h on d.r = h.r left join it on d.r = it.r
"""
