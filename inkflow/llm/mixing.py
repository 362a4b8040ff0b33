"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; a document's expected copies are its source's target over
its source's size. The whole part is taken outright. The fractions of a source are rounded in
pairs: mass, weighted by the documents' sizes, moves from one to the other in a random
direction until one of them is 0 or 1, so the words taken are kept exactly by each step and in
expectation every document keeps its probability. Blocks of about ``BLOCK`` documents do this
in order and hand one residual document to the next level of a tree; after ``log_BLOCK(n)``
levels one residual is left for each source, which is why a source misses its target by less
than one document. Draws are hashes of the documents, so reruns agree.

Nulls: a null source is one source, the last; a null text has size 0 and is taken 0 times; null
ids are kept. Repeated rows are counted first and get draws of their own, so they spread over
blocks. Empty input gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, _sql, documents, row_key, store

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 64


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, k, source, size, rep): one row per document; rep tells repeated rows apart."""
    word = _sql(r"[^\x20\x09-\x0D]+")
    sized = docs.select("doc_id", row_key().alias("k"), "source", F.expr(f"cast(regexp_count(coalesce(text, ''), '{word}') as bigint)").alias("size"))
    counted = sized.groupBy("doc_id", "k", "source", "size").agg(F.count("*").alias("m"))
    return counted.select("doc_id", "k", "source", "size", F.expr("explode(sequence(1L, m))").alias("rep"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n): water-filling under the caps.

    Sources are sorted by cap over weight; the first one whose level, with all before it at their
    caps, is within its own cap sets the level of all that follow.
    """
    w = F.expr(f"element_at(array({', '.join(map(str, weights))}), cast((row_number() over (order by source nulls last) - 1) % {len(weights)} as int) + 1)")
    weighed = by_source.select("*", w.alias("w"))
    # a null source sorts last but must not look like a missing one: its rank is by (is null, source)
    order = f"order by {most} * source_size / w, isnull(source), source"
    level = weighed.select(
        "*",
        F.expr(f"({share}D * sum(source_size) over () - coalesce(sum({most} * source_size) over ({order} rows between unbounded preceding and 1 preceding), 0)) / sum(w) over ({order} rows between current row and unbounded following)").alias("level"),
        F.expr(f"{most} * source_size / w").alias("cap"),
    )
    at = level.select("*", F.expr("min(if(level <= cap, cap, null)) over ()").alias("first_cap")).select("*", F.expr("max(if(cap = first_cap and level <= cap, level, null)) over ()").alias("reached"))
    return at.select("source", "source_size", "n", F.expr(f"cast(least({most} * source_size, coalesce(reached * w, {most} * source_size)) as double)").alias("target"))


_STEP = """aggregate(sequence(1, size(items) - 1), named_struct('c', 0, 'x', items[0].x, 'out', cast(array() as array<int>)), (s, i) ->
  case when items[i].u * (least((1 - s.x) * items[s.c].size, items[i].x * items[i].size) + least(s.x * items[s.c].size, (1 - items[i].x) * items[i].size))
            < least(s.x * items[s.c].size, (1 - items[i].x) * items[i].size)
  then if((1 - s.x) * items[s.c].size <= items[i].x * items[i].size,
    named_struct('c', i, 'x', greatest(0D, items[i].x - (1 - s.x) * items[s.c].size / items[i].size), 'out', concat(s.out, array(s.c * 2 + 1))),
    named_struct('c', s.c, 'x', least(1D, s.x + items[i].x * items[i].size / items[s.c].size), 'out', concat(s.out, array(i * 2))))
  else if(s.x * items[s.c].size <= (1 - items[i].x) * items[i].size,
    named_struct('c', i, 'x', least(1D, items[i].x + s.x * items[s.c].size / items[i].size), 'out', concat(s.out, array(s.c * 2))),
    named_struct('c', s.c, 'x', greatest(0D, s.x - (1 - items[i].x) * items[i].size / items[s.c].size), 'out', concat(s.out, array(i * 2 + 1)))) end)"""
_ROW = ["doc_id", "k", "rep", "source", "size", "source_size", "target"]


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, k, rep, source, size, source_size, target, copies): how often each document is taken."""
    spark = docs.sparkSession
    sized = store(sizes(docs))
    goals = Stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))))
    rows = sized.alias("d").join(goals.small().alias("g"), F.expr("d.source <=> g.source")).select("doc_id", "k", "rep", "d.source", "size", "source_size", "target", "n", F.expr("if(source_size > 0, target / source_size, 0D)").alias("r"))
    start = rows.select(*_ROW, F.expr("cast(floor(r) as bigint)").alias("whole"), F.expr("r - floor(r)").alias("x"), F.expr(f"cast(ceil(n / {BLOCK}) as bigint)").alias("blocks"))
    settled = [start.where("x = 0 or size = 0").select(*_ROW, F.expr("if(size = 0, 0L, whole)").alias("copies"))]
    pending, most = start.where("x > 0 and size > 0"), int(goals.df.agg(F.max("n")).first()[0] or 0)
    level = 0
    while True:
        drawn = pending.select(*_ROW, "whole", "x", "blocks", F.expr(f"pmod(xxhash64(k, rep, {level}, 'block'), blocks)").alias("b"), F.expr(f"shiftrightunsigned(xxhash64(k, rep, {level}, 'draw'), 11) / 9007199254740992D").alias("u"))
        item = F.struct("k", "rep", "doc_id", "size", "whole", "x", "u")
        blocks = drawn.groupBy("source", "source_size", "target", "blocks", "b").agg(F.array_sort(F.collect_list(item)).alias("items"))
        stepped = blocks.select("*", F.expr(f"if(size(items) > 1, {_STEP}, named_struct('c', 0, 'x', items[0].x, 'out', cast(array() as array<int>)))").alias("s"))
        done = store(stepped)
        most = -(-most // BLOCK)
        last = most <= 1
        outcome = "concat(transform(s.out, o -> struct(items[o div 2] as it, o % 2 as one)), array(struct(items[s.c] as it, if(items[s.c].u < s.x, 1, 0) as one)))" if last else "transform(s.out, o -> struct(items[o div 2] as it, o % 2 as one))"
        settled.append(done.select("source", "source_size", "target", F.expr(f"explode({outcome})").alias("o")).select("o.it.doc_id", "o.it.k", "o.it.rep", "source", "o.it.size", "source_size", "target", F.expr("o.it.whole + o.one").alias("copies")))
        if last:
            return reduce(DataFrame.unionByName, settled)
        pending = done.select("s.c", "s.x", "items", "source", "source_size", "target", "blocks").select("items", "x", "source", "source_size", "target", F.expr("items[c]").alias("it"), F.expr(f"cast(ceil(blocks / {BLOCK}) as bigint)").alias("blocks")).select(
            "it.doc_id", "it.k", "it.rep", "source", "it.size", "source_size", "target", "it.whole", "x", "blocks"
        )
        level += 1


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", F.expr("size * copies").alias("taken"))
