"""Quality rules with thresholds that adapt to each language and source.

Every document gets integer measures. Their distribution per (language, source) is kept in a
mergeable log-bucket quantile sketch: counts of buckets whose width is at most 1/32 of their
value, so two sketches merge by adding counts, and their size is bounded by the number of
buckets, whatever the number of documents. Quantiles read from the sketches give a fence for
each measure; documents join the fences of their group and those outside one are dropped.
Groups of fewer than ``min_group`` documents use the sketch merged over their language.

Nulls: a null text has no words; null languages and sources form groups of their own; a null
id is kept as it is. Repeated rows each give a row. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, _sql, documents, store, words

#: Measure -> slack added beyond the fence (symbols per mille of word characters, repeated lines
#: in percent, words of repeated windows per mille, word length in hundredths).
MEASURES = {"f_symbol": 100, "f_lines": 30, "f_repeat": 100, "f_long": 150, "f_short": 400}
#: Fence: upper quartile + REACH * (upper quartile - lower quartile) + slack.
REACH = 3
MIN_GROUP = 50
WINDOW = 8


def measures(docs: DataFrame) -> DataFrame:
    """The base columns of each document, with integer measures derived from them."""
    w = WINDOW
    has_word = _sql(r"[^\x20\x09-\x0D]")
    step = docs.select("doc_id", "lang", "source", F.expr(words()).alias("w"), F.expr(f"filter(split(coalesce(text, ''), '\\n'), l -> rlike(l, '{has_word}'))").alias("lines"), F.expr("cast(regexp_count(coalesce(text, ''), '[#*$%&|<>]') as bigint)").alias("n_symbols"))
    step = step.select(
        "doc_id", "lang", "source", "n_symbols", "w",
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(w, '')) as bigint)").alias("word_chars"),
        F.expr("cast(size(lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        # hashes only tell which documents may repeat a window; those are compared as text below
        F.expr(f"if(size(w) > {w}, transform(sequence(0, size(w) - {w}), i -> xxhash64({', '.join(f'w[i + {k}]' for k in range(w))})), array())").alias("h"),
    )
    step = step.withColumn("again", F.expr("size(array_distinct(h)) < size(h)")).drop("h")
    step = step.withColumn("s", F.expr(f"if(again, array_sort(transform(sequence(0, size(w) - {w}), i -> struct(array_join(slice(w, i + 1, {w}), ' ') as t, i as i))), array())")).drop("w")
    step = step.withColumn("p", F.expr("array_sort(filter(transform(s, (x, k) -> if((k > 0 and x.t = s[greatest(k - 1, 0)].t) or (k < size(s) - 1 and x.t = s[least(k + 1, size(s) - 1)].t), x.i, -1)), x -> x >= 0))")).drop("s")
    step = step.withColumn("n_repeat_words", F.expr(f"aggregate(transform(p, (x, k) -> if(k < size(p) - 1, least({w}, p[least(k + 1, size(p) - 1)] - x), {w})), 0L, (a, b) -> a + b)"))
    return step.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words").alias("base_failed"),
        F.expr("n_symbols * 1000 div greatest(word_chars, 1)").alias("f_symbol"),
        F.expr("n_dup_lines * 100 div greatest(n_lines, 1)").alias("f_lines"),
        F.expr("n_repeat_words * 1000 div greatest(n_words, 1)").alias("f_repeat"),
        F.expr("word_chars * 100 div greatest(n_words, 1)").alias("f_long"),
        F.expr("n_words * 10000 div greatest(word_chars, 1)").alias("f_short"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): bucket counts over the documents that pass the base rules."""
    long = measured.where(~F.col("base_failed")).select("lang", "source", F.expr(f"stack({len(MEASURES)}, {', '.join(f"'{m}', {m}" for m in MEASURES)}) as (measure, x)"))
    bucket = F.expr("if(x < 64, x, shiftleft(shiftright(x, length(bin(x)) - 6), length(bin(x)) - 6))")
    return long.select("lang", "source", "measure", bucket.alias("bucket")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, one upper fence for each measure), read from the sketches."""
    merged = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))

    def quartiles(df: DataFrame, keys: list[str]) -> DataFrame:
        part = ", ".join(keys)
        cum = df.select("*", F.expr(f"sum(n) over (partition by {part} order by bucket)").alias("upto"), F.expr(f"sum(n) over (partition by {part})").alias("total"))
        return cum.groupBy(*keys).agg(F.max("total").alias("total"), F.expr("min(bucket) filter (where 4 * upto >= total)").alias("q1"), F.expr("min(bucket) filter (where 4 * upto >= 3 * total)").alias("q3"))

    own = quartiles(sketch, ["lang", "source", "measure"]).alias("a")
    all_of = quartiles(merged, ["lang", "measure"]).alias("b")
    both = own.join(all_of, F.expr("a.lang <=> b.lang and a.measure = b.measure")).select(
        "a.lang", "a.source", "a.measure",
        F.expr(f"if(a.total >= {min_group}, a.q3 + {REACH} * (a.q3 - a.q1), b.q3 + {REACH} * (b.q3 - b.q1))").alias("fence"),
    )
    return both.groupBy("lang", "source").agg(*(F.expr(f"max(fence) filter (where measure = '{m}') + {slack}").alias(f"hi_{m}") for m, slack in MEASURES.items()))


def quality(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per document: base measures, ``base_failed`` and the verdict ``kept``."""
    measured = store(measures(docs))
    limits = Stored(fences(sketches(measured), min_group)).small().alias("l")
    inside = " and ".join(f"{m} <= hi_{m}" for m in MEASURES)
    return measured.alias("m").join(limits, F.expr("m.lang <=> l.lang and m.source <=> l.source"), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(f"not base_failed and coalesce({inside}, true)").alias("kept")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return quality(documents(spark, sf_dir))


ORACLE = rf"""
with t as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as x from documents),
d as (select *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from t),
win as (select r, unnest(range(0, len(w) - {WINDOW - 1})) as i, w from d where len(w) >= {WINDOW}),
ws as (select r, i, array_to_string(w[i + 1 : i + {WINDOW}], ' ') as s from win),
dup as (select r, i from (select r, i, count(*) over (partition by r, s) as c from ws) where c > 1),
cov as (select r, count(distinct p) as n from (select r, unnest(range(i, i + {WINDOW})) as p from dup) group by r),
b as (select d.r, doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from d left join cov on d.r = cov.r),
m as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  n_symbols * 1000 // greatest(word_chars, 1) as f_symbol, n_dup_lines * 100 // greatest(n_lines, 1) as f_lines,
  n_repeat_words * 1000 // greatest(n_words, 1) as f_repeat, word_chars * 100 // greatest(n_words, 1) as f_long,
  n_words * 10000 // greatest(word_chars, 1) as f_short from b),
u as ({' union all '.join(f"select lang, source, '{k}' as measure, {k} as v from m where not base_failed" for k in MEASURES)}),
k as (select lang, source, measure, case when v < 64 then v else (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) end as bucket, count(*) as n from u group by all),
kc as (select *, sum(n) over (partition by lang, source, measure order by bucket) as upto, sum(n) over (partition by lang, source, measure) as total from k),
a as (select lang, source, measure, max(total) as total, min(bucket) filter (where 4 * upto >= total) as q1, min(bucket) filter (where 4 * upto >= 3 * total) as q3 from kc group by all),
lm as (select lang, measure, bucket, sum(n) as n from k group by all),
lc as (select *, sum(n) over (partition by lang, measure order by bucket) as upto, sum(n) over (partition by lang, measure) as total from lm),
l as (select lang, measure, min(bucket) filter (where 4 * upto >= total) as q1, min(bucket) filter (where 4 * upto >= 3 * total) as q3 from lc group by all),
f as (select a.lang, a.source, a.measure, case when a.total >= {MIN_GROUP} then a.q3 + {REACH} * (a.q3 - a.q1) else l.q3 + {REACH} * (l.q3 - l.q1) end as fence
  from a join l on a.lang is not distinct from l.lang and a.measure = l.measure),
h as (select lang, source, {', '.join(f"max(fence) filter (where measure = '{k}') + {v} as hi_{k}" for k, v in MEASURES.items())} from f group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce({' and '.join(f"{k} <= hi_{k}" for k in MEASURES)}, true) as kept
from m left join h on m.lang is not distinct from h.lang and m.source is not distinct from h.source
"""
