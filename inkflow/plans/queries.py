"""Every operator as a query over the tables of a folder, with SQL that gives the same rows.

The tables hold no images, so operators take stand-ins: an embedding of 64 numbers is eight steps of
eight class scores, or a map of eight by eight; lines of orders give sizes and rectangles; texts of
conversations are lines of characters.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Detector
from ..functions import decode, geometry, text
from ..operators import layout, pixels
from ..sources import sinks
from ..sources.models import Scorers
from ..streaming import pages as streaming
from .engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STEPS, CLASSES = 8, 8
ALPHABET = "-abcdefg"
LABELS = ("0", "180")
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_KEYS = ", ".join(KEYS)


def query(oracle: str | None = None):
    """Registers a query by its function's name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores, some tasks for each: those that take far more time than space are too few tasks by their files."""
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


# Sequence and class scores


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr(decode.steps_of("embedding", CLASSES)).alias("probs"))
    best = rows.withColumn("best", decode.argmax_steps("probs")).withColumn("kept", decode.kept_steps("best"))
    letters = F.array(*(F.lit(c) for c in ALPHABET))
    return best.withColumn("alphabet", letters).withColumn("chars", decode.chars("best", "kept", "alphabet")).withColumn("confs", decode.confidences("best", "kept"))


_BEST = f"""with s as (select vec_id, label, t, embedding[t * 8 + 1 : t * 8 + 8] as r from embeddings, range({STEPS}) x(t)),
b as (select vec_id, label, t, list_position(r, list_max(r)) - 1 as i, list_max(r) as v from s),
k as (select *, i <> 0 and (t = 0 or i <> lag(i) over (partition by vec_id order by t)) as kept from b)"""
_UNITS = "cast(bround(x * 100000, 0) as bigint)"


@query(f"{_BEST} select vec_id, string_agg(i::varchar, ',' order by t) as classes, sum(round_even(v::double * 100000, 0)::bigint)::bigint as value_units from b group by vec_id")
def ctc_argmax(spark, sf_dir):
    return _steps(spark, sf_dir).select("vec_id", F.expr("array_join(transform(best, b -> cast(b.i as string)), ',')").alias("classes"), F.expr("aggregate(best, 0L, (a, b) -> a + cast(bround(cast(b.v as double) * 100000, 0) as bigint))").alias("value_units"))


@query(f"{_BEST} select vec_id, coalesce(string_agg(t::varchar, ',' order by t) filter (where kept), '') as valid_cols, count(*) filter (where kept) as n_kept from k group by vec_id")
def ctc_collapse(spark, sf_dir):
    return _steps(spark, sf_dir).select("vec_id", F.array_join(F.col("kept").cast("array<string>"), ",").alias("valid_cols"), F.size("kept").cast("long").alias("n_kept"))


@query(f"{_BEST} select vec_id, coalesce(string_agg('{ALPHABET}'[(i + 1)::int], '' order by t) filter (where kept), '') as text from k group by vec_id")
def ctc_text(spark, sf_dir):
    return _steps(spark, sf_dir).select("vec_id", F.array_join("chars", "").alias("text"))


@query(f"{_BEST} select vec_id, greatest(count(*) filter (where kept), 1) as n_confs, coalesce(sum(round_even(v::double * 100000, 0)::bigint) filter (where kept), 0)::bigint as conf_units from k group by vec_id")
def ctc_conf(spark, sf_dir):
    return _steps(spark, sf_dir).select("vec_id", F.size("confs").cast("long").alias("n_confs"), F.expr(f"aggregate(confs, 0L, (a, x) -> a + {_UNITS})").alias("conf_units"))


@query(f"""{_BEST}, l as (select vec_id, coalesce(string_agg('{ALPHABET}'[(i + 1)::int], '' order by t) filter (where kept), '') as label,
coalesce(sum(round_even(v::double * 100000, 0)::bigint) filter (where kept), 0)::bigint as conf_units from k group by vec_id)
select vec_id, label, conf_units, ({STEPS} * ((vec_id % 7) + 1)) / 8.0::double as line_txt_len from l""")
def rec_result(spark, sf_dir):
    lines = _steps(spark, sf_dir).withColumn("wh", F.expr("cast(vec_id % 7 + 1 as float)"))
    return lines.select("vec_id", F.array_join("chars", "").alias("label"), F.expr(f"aggregate(confs, 0L, (a, x) -> a + {_UNITS})").alias("conf_units"), decode.line_length(f"{STEPS}F", "wh", "8F").cast("double").alias("line_txt_len"))


@query(f"""{_BEST}, l as (select vec_id, label as page, coalesce(string_agg('{ALPHABET}'[(i + 1)::int], '' order by t) filter (where kept), '') as said,
coalesce(sum(round_even(v::double * 100000, 0)::bigint) filter (where kept), 0)::bigint as units from k group by vec_id, label)
select page, coalesce(string_agg(said, ' ' order by vec_id) filter (where units > 80000), '') as text_blocks from l group by page""")
def text_blocks(spark, sf_dir):
    lines = _steps(spark, sf_dir).select("vec_id", F.col("label").alias("page"), F.array_join("chars", "").alias("said"), F.expr(f"aggregate(confs, 0L, (a, x) -> a + {_UNITS})").alias("units"))
    return layout.text_blocks(lines, "page", "vec_id", "said", "units", 80000)


@query("select conv_id, coalesce(string_agg(text, ' ' order by turn) filter (where turn > 0), '') as text_blocks from conversations group by conv_id")
def text_blocks_conversations(spark, sf_dir):
    return layout.text_blocks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "turn", 0)


_CLASS = "select vec_id, case when embedding[1] >= embedding[2] then '0' else '180' end as cls_label, greatest(embedding[1], embedding[2])::double as cls_score from embeddings"


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").select("vec_id", decode.class_label("slice(embedding, 1, 2)", LABELS).alias("c"))
    return found.select("vec_id", F.col("c.label").alias("cls_label"), F.col("c.score").cast("double").alias("cls_score"))


@query(_CLASS)
def cls_argmax(spark, sf_dir):
    return _classes(spark, sf_dir)


@query(f"select vec_id, cls_label = '180' and cls_score > 0.1 as turned from ({_CLASS})")
def cls_rotate180(spark, sf_dir):
    return _classes(spark, sf_dir).select("vec_id", decode.turned("cls_label", "cls_score", 0.1).alias("turned"))


# Probability maps


def _masks(spark: SparkSession, sf_dir: str, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(vec_id, mask): the masks that a kernel makes of the maps, as strings of 0 and 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            masks = ["".join("01"[int(x)] for x in function(np.asarray(p, np.float32).reshape(8, 8)).ravel()) for p in frame.embedding]
            yield pd.DataFrame({"vec_id": frame.vec_id, "mask": masks})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, mask string")


@query("select vec_id, list_aggregate(list_transform(embedding, lambda p: case when p > 0.1::float then '1' else '0' end), 'string_agg', '') as mask from embeddings")
def db_threshold(spark, sf_dir):
    return _masks(spark, sf_dir, lambda prob: pixels.threshold(prob, np.float32(0.1)))


@query("""with c as (select vec_id, i, embedding[i + 1] > 0.1::float as on_ from embeddings, range(64) x(i)), j as (select a.vec_id, a.i, bool_or(b.on_) as on_ from c a join c b
on a.vec_id = b.vec_id and b.i in (a.i, a.i - 1, a.i - 8, a.i - 9) and b.i % 8 <= a.i % 8 group by all) select vec_id, string_agg(case when on_ then '1' else '0' end, '' order by i) as mask from j group by vec_id""")
def db_dilate(spark, sf_dir):
    return _masks(spark, sf_dir, lambda prob: pixels.dilate(pixels.threshold(prob, np.float32(0.1))))


def _boxes_of_maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for vec, flat in zip(frame.vec_id, frame.embedding):
            prob = np.asarray(flat, np.float32).reshape(8, 8)
            numbers = pixels.label(pixels.threshold(prob, np.float32(0.1)))
            for n in range(1, numbers.max() + 1):
                ys, xs = np.nonzero(numbers == n)
                box = np.array([[xs.min(), ys.min()], [xs.max(), ys.min()], [xs.max(), ys.max()], [xs.min(), ys.max()]], float)
                rows.append((vec, n - 1, len(xs), xs.min(), ys.min(), xs.max(), ys.max(), int(round(pixels.score_fast(prob.astype(float), box) * 1e6)), int(round(pixels.score_slow(prob.astype(float), numbers == n) * 1e6))))
        yield pd.DataFrame(rows, columns=["vec_id", "comp", "cells", "x_min", "y_min", "x_max", "y_max", "fast", "slow"])


_PARTS = """with recursive c as (select vec_id, i, i % 8 as x, i // 8 as y, embedding[i + 1]::double as p from embeddings, range(64) g(i) where embedding[i + 1] > 0.1::float),
r as (select vec_id, i, x, y, i as root from c union select r.vec_id, c.i, c.x, c.y, r.root from r join c on r.vec_id = c.vec_id and abs(r.x - c.x) <= 1 and abs(r.y - c.y) <= 1),
m as (select vec_id, i, min(root) as root from r group by all), g as (select m.vec_id, m.root, count(*) as cells, min(x) as x_min, min(y) as y_min, max(x) as x_max, max(y) as y_max, avg(p) as slow from m join c on m.vec_id = c.vec_id and m.i = c.i group by all),
n as (select *, row_number() over (partition by vec_id order by root) - 1 as comp from g)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(_boxes_of_maps, "vec_id long, comp long, cells long, x_min long, y_min long, x_max long, y_max long, fast long, slow long")


@query(f"{_PARTS} select vec_id, comp, cells, x_min, y_min, x_max, y_max from n")
def db_components(spark, sf_dir):
    return _parts(spark, sf_dir).drop("fast", "slow")


@query(f"{_PARTS}, f as (select n.vec_id, comp, avg(embedding[i + 1]::double) as fast from n join embeddings e on n.vec_id = e.vec_id, range(64) g(i) where i % 8 between x_min and x_max and i // 8 between y_min and y_max group by all) select vec_id, comp, round(fast * 1000000)::bigint as score_units from f")
def box_score_fast(spark, sf_dir):
    return _parts(spark, sf_dir).select("vec_id", "comp", F.col("fast").alias("score_units"))


@query(f"{_PARTS} select vec_id, comp, round(slow * 1000000)::bigint as score_units from n")
def box_score_slow(spark, sf_dir):
    return _parts(spark, sf_dir).select("vec_id", "comp", F.col("slow").alias("score_units"))


@query(f"{_PARTS} select vec_id, comp, cells from n where comp < 3")
def candidate_limit(spark, sf_dir):
    return layout.first_candidates(_parts(spark, sf_dir), "vec_id", ["comp"], 3).select("vec_id", "comp", "cells")


@query(f"{_PARTS}, q as (select *, row_number() over (partition by vec_id order by cells desc, comp desc) as k from n) select vec_id, cells, comp from q where k = 1")
def largest_component(spark, sf_dir):
    return layout.largest(_parts(spark, sf_dir), ["vec_id"], "cells", ["comp"])


@query(f"""{_PARTS}, f as (select n.vec_id, n.comp, avg(embedding[i + 1]::double) as fast from n join embeddings e on n.vec_id = e.vec_id, range(64) g(i) where i % 8 between x_min + 1 and x_max + 1 and i // 8 between y_min + 1 and y_max + 1 group by all)
select n.vec_id, n.comp, coalesce(round(fast * 1000000), 0)::bigint as score_units from n left join f on n.vec_id = f.vec_id and n.comp = f.comp""")
def box_score_off_grid(spark, sf_dir):
    """Scores of boxes whose corners lie between pixels: they are rounded, so these move by one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for vec, flat in zip(frame.vec_id, frame.embedding):
                prob = np.asarray(flat, np.float32).reshape(8, 8)
                numbers = pixels.label(pixels.threshold(prob, np.float32(0.1)))
                for n in range(1, numbers.max() + 1):
                    ys, xs = np.nonzero(numbers == n)
                    box = np.array([[xs.min(), ys.min()], [xs.max(), ys.min()], [xs.max(), ys.max()], [xs.min(), ys.max()]]) + 0.6
                    rows.append((vec, n - 1, int(round(pixels.score_fast(prob.astype(float), box) * 1e6))))
            yield pd.DataFrame(rows, columns=["vec_id", "comp", "score_units"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, comp long, score_units long")


# the least rectangle has a side along two of the points; its area is a fraction over at most 98, so 0.3 keeps off halves
@query(f"""{_PARTS}, t as (select vec_id, root, i % 8 as x, i // 8 as y from m),
d as (select distinct a.vec_id, a.root, b.x - a.x as dx, b.y - a.y as dy from t a join t b on a.vec_id = b.vec_id and a.root = b.root where b.x > a.x or b.x = a.x and b.y > a.y),
e as (select d.vec_id, d.root, (max(dx * x + dy * y) - min(dx * x + dy * y)) * (max(dx * y - dy * x) - min(dx * y - dy * x)) * 1000::double / (dx * dx + dy * dy) as area from d join t on d.vec_id = t.vec_id and d.root = t.root group by d.vec_id, d.root, dx, dy),
s as (select vec_id, root, min(area) as area from e group by all)
select n.vec_id, n.comp, floor(coalesce(area, 0) + 0.3::double)::bigint as area_units from n left join s on n.vec_id = s.vec_id and n.root = s.root""")
def min_area_rect(spark, sf_dir):
    """Area of the least rectangle around each component of the maps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for vec, flat in zip(frame.vec_id, frame.embedding):
                numbers = pixels.label(pixels.threshold(np.asarray(flat, np.float32).reshape(8, 8), np.float32(0.1)))
                for n in range(1, numbers.max() + 1):
                    ys, xs = np.nonzero(numbers == n)
                    box, _ = pixels.min_area_rect(np.stack([xs, ys], axis=1))
                    area = np.hypot(*(box[1] - box[0])) * np.hypot(*(box[3] - box[0]))
                    rows.append((vec, n - 1, int(np.floor(area * 1000 + 0.3))))
            yield pd.DataFrame(rows, columns=["vec_id", "comp", "area_units"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, comp long, area_units long")


_PIXEL = "least(255, greatest(0, cast(floor(p * 255 + 128) as int)))"
_PIXELS = "list_transform(embedding, lambda p: least(255, greatest(0, floor(p::double * 255 + 128)::int))) as v"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"transform(cast(embedding as array<double>), p -> {_PIXEL})").alias("v"))


@query(f"""with v as (select vec_id, {_PIXELS}, vec_id % 3 as x0, vec_id % 4 as y0, 2 + vec_id // 3 % 4 as w, 2 + vec_id // 12 % 3 as h from embeddings),
p as (select vec_id, w, h, h * 2 >= w * 3 as turned, i % 8 - x0 as c, i // 8 - y0 as r, v[i + 1] as p from v, range(64) g(i) where i % 8 between x0 and x0 + w - 1 and i // 8 between y0 and y0 + h - 1)
select vec_id, any_value(case when turned then w else h end)::bigint as height, any_value(case when turned then h else w end)::bigint as width, sum(p * case when turned then c * 8 + h - 1 - r else r * 8 + c end)::bigint as weighed from p group by vec_id""")
def perspective_crop(spark, sf_dir):
    """Upright quads cut from the maps, high ones turned: sizes, and the pixels weighed by their place. Slanted ones are in the tests."""

    def cut(vec: int, values) -> tuple[int, int, int, int]:
        image = np.repeat(np.asarray(values, np.uint8).reshape(8, 8, 1), 3, axis=2)
        x, y, w, h = vec % 3, vec % 4, 2 + vec // 3 % 4, 2 + vec // 12 % 3
        crop = pixels.crop_quad(image, np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float))
        rows, columns = np.mgrid[: crop.shape[0], : crop.shape[1]]
        return vec, *crop.shape[:2], int((crop[:, :, 0].astype(int) * (rows * 8 + columns)).sum())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([cut(*x) for x in zip(frame.vec_id, frame.v)], columns=["vec_id", "height", "width", "weighed"])

    return _pixels(spark, sf_dir).mapInPandas(run, "vec_id long, height long, width long, weighed long")


@query("""with b as (select vec_id, vec_id % 50 as x0, label % 30 as y0, 20 + vec_id % 40 as w, vec_id % 5 + 1.5::double as l, vec_id % 2 = 1 as v from embeddings),
c as (select *, unnest([0, 1, 2, 3]) as corner, unnest([l, l + 4, l + 4, l]) as x, unnest([2.5::double, 2.5::double, 8.5::double, 8.5::double]) as y from b)
select vec_id, corner::bigint as corner, trunc(case when v then w - y else x end + x0)::bigint as page_x, trunc(case when v then x else y end + y0)::bigint as page_y from c""")
def unwarp_word_boxes(spark, sf_dir):
    """A cell of an upright line, or of one that was turned, in the coordinates of its page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for vec, about in zip(frame.vec_id, frame.label):
                x, y, w, h, left = vec % 50, about % 30, 20 + vec % 40, 10 + vec % 7, vec % 5 + 1.5
                box = np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)
                cell = np.array([[[left, 2.5], [left + 4, 2.5], [left + 4, 8.5], [left, 8.5]]])
                rows += [(vec, n, int(a), int(b)) for n, (a, b) in enumerate(pixels.to_page(box, cell, vec % 2 == 1)[0])]
            yield pd.DataFrame(rows, columns=["vec_id", "corner", "page_x", "page_y"])

    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label")).mapInPandas(run, "vec_id long, corner long, page_x long, page_y long")


@query("""select vec_id, round_even((vec_id % 13 + 1) * 1.5::double, 0)::bigint as height, round_even((vec_id % 20 + 1) * 2.25::double, 0)::bigint as width, (label % 10 * 20 + 5)::bigint as value from embeddings""")
def map_crops_to_original(spark, sf_dir):
    """Plain crops in the size they have on their page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            crops = [pixels.at_page_scale(np.full((v % 13 + 1, v % 20 + 1, 3), x % 10 * 20 + 5, np.uint8), 1.5, 2.25) for v, x in zip(frame.vec_id, frame.label)]
            yield pd.DataFrame({"vec_id": frame.vec_id, "height": [c.shape[0] for c in crops], "width": [c.shape[1] for c in crops], "value": [int(c.max()) if c.max() == c.min() else -1 for c in crops]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "label").mapInPandas(run, "vec_id long, height long, width long, value long")


@query(f"""with x as (select vec_id, {_PIXELS} from embeddings)
select vec_id, list_sum(list_transform(v, lambda p: round_even(p / 255.0::double * 10000, 0)::bigint))::bigint as v5_units, list_sum(list_transform(v, lambda p: round_even((p / 255.0::double - 0.5::double) / 0.5::double * 10000, 0)::bigint))::bigint as v4_units from x""")
def normalize_pixels(spark, sf_dir):
    x = _pixels(spark, sf_dir)
    # units of a ten-thousandth, as the kernel works in single precision
    units = lambda x: int(np.rint(x[0].astype(float) * 10_000).sum())
    half = (0.5, 0.5, 0.5)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images = [np.repeat(np.asarray(v, np.uint8).reshape(8, 8, 1), 3, axis=2) for v in frame.v]
            yield pd.DataFrame({"vec_id": frame.vec_id, "v5_units": [units(pixels.planar(i)) for i in images], "v4_units": [units(pixels.planar(i, half, half)) for i in images]})

    return x.mapInPandas(run, "vec_id long, v5_units long, v4_units long")


# Sizes


_SIZED = "select *, (l_partkey % 3000 + 1)::int as w, (l_suppkey * 37 % 2500 + 1)::int as h from lineitem"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEYS, "l_extendedprice", F.expr("cast(l_partkey % 3000 + 1 as int)").alias("w"), F.expr("cast(l_suppkey * 37 % 2500 + 1 as int)").alias("h"))


@query(f"""with s as ({_SIZED}), f as (select *, 200::float / greatest(w, h)::float as down, 30::float / least(w, h)::float as up from s),
a as (select *, case when greatest(w, h) > 200 then (round(round((w::float * down)::double) / 32) * 32)::int else w end as aw, case when greatest(w, h) > 200 then (round(round((h::float * down)::double) / 32) * 32)::int else h end as ah from f),
g as (select *, case when least(w, h) < 30 then up else 1::float end as r from a),
b as (select *, case when least(aw, ah) < 30 then (round(round((w::float * r)::double) / 32) * 32)::int else aw end as bw, case when least(aw, ah) < 30 then (round(round((h::float * r)::double) / 32) * 32)::int else ah end as bh from g),
e as (select *, least(aw, ah, bw, bh) <= 0 as bad from b)
select {_KEYS}, case when bad then null else bw end as out_w, case when bad then null else bh end as out_h, case when bad then null else round_even((w::float / bw::float)::double * 1000, 0)::bigint end as ratio_w, case when bad then null else round_even((h::float / bh::float)::double * 1000, 0)::bigint end as ratio_h, bad as failed from e""")
def resize_bounds(spark, sf_dir):
    r = _sizes(spark, sf_dir).select(*KEYS, geometry.resize_bounds("w", "h", 200, 30).alias("r"))
    units = lambda c: F.expr(f"cast(bround(cast(r.{c} as double) * 1000, 0) as bigint)").alias(c)
    return r.select(*KEYS, F.col("r.w").alias("out_w"), F.col("r.h").alias("out_h"), units("ratio_w"), units("ratio_h"), F.col("r.error").isNotNull().alias("failed"))


@query(f"with s as ({_SIZED}) select {_KEYS}, case when h <= 30 or w::float / h::float > 8 then trunc(abs(trunc(greatest(w::float / 8, 30) * 2) - h) / 2)::int else 0 end as padding from s")
def vertical_padding(spark, sf_dir):
    return _sizes(spark, sf_dir).select(*KEYS, geometry.vertical_padding("w", "h").alias("padding"))


_SIDE = "(round_even(trunc({x} * {r}) / 32, 0) * 32)::int"
_LOW = "(case when least(w, h) < 736 then 736::double / least(w, h) else 1::double end)"
_HIGH = "(case when greatest(w, h) > lim then lim::double / greatest(w, h) else 1::double end)"


@query(f"""with s as ({_SIZED}), t as (select *, case when greatest(w, h) < 960 then 960 when greatest(w, h) < 1500 then 1500 else 2000 end as lim from s)
select {_KEYS}, {_SIDE.format(x='w', r=_LOW)} as min_w, {_SIDE.format(x='h', r=_LOW)} as min_h, {_SIDE.format(x='w', r=_HIGH)} as max_w, {_SIDE.format(x='h', r=_HIGH)} as max_h from t""")
def det_limit_resize(spark, sf_dir):
    s = _sizes(spark, sf_dir).select(*KEYS, geometry.limit_resize("w", "h").alias("a"), geometry.limit_resize("w", "h", "max").alias("b"))
    return s.select(*KEYS, F.col("a.w").alias("min_w"), F.col("a.h").alias("min_h"), F.col("b.w").alias("max_w"), F.col("b.h").alias("max_h"))


@query(f"with s as ({_SIZED}) select {_KEYS}, least(ceil((80 * (w::float / h::float))::float)::int, 160) as width from s")
def cls_width(spark, sf_dir):
    return _sizes(spark, sf_dir).select(*KEYS, geometry.class_width("w", "h", 80, 160).alias("width"))


@query(f"""with s as ({_SIZED}), c as (select *, w::float / h::float as wh, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 as crop from s),
b as (select *, greatest(max(wh) over (partition by l_orderkey, crop // 6), (320 / 48.0)::float) as most, greatest(wh, (320 / 48.0)::float) as own from c)
select {_KEYS}, crop // 6 as batch_no, round_even((48::float * most)::double, 0)::int as img_width, least(ceil(48::float * wh)::int, round_even((48::float * own)::double, 0)::int) as resized_width from b""")
def rec_width(spark, sf_dir):
    crops = _sizes(spark, sf_dir).withColumn("crop", F.expr("row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1")).withColumn("wh", F.expr(geometry.wh_ratio("w", "h")))
    rows = layout.batch_ratio(layout.batches(crops, "crop"), ["l_orderkey", "batch_no"], "wh").withColumn("s", geometry.line_width("wh", "max_wh_ratio"))
    return rows.select(*KEYS, "batch_no", "s.img_width", "s.resized_width")


# Boxes


_RECT = "select *, (l_partkey % 900)::double as x0, (l_suppkey * 7 % 700)::double as y0, (l_partkey % 900 + l_quantity * 2)::double as x1, (l_suppkey * 7 % 700 + l_linenumber * 6)::double as y1 from lineitem"


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, "l_extendedprice", "l_quantity", F.expr("cast(l_partkey % 900 as double)").alias("x0"), F.expr("cast(l_suppkey * 7 % 700 as double)").alias("y0"))
    rows = rows.withColumn("x1", F.expr("x0 + l_quantity * 2")).withColumn("y1", F.expr("y0 + l_linenumber * 6"))
    return rows.withColumn("box", geometry.quad("x0", "y0", "x1", "y1"))


def _corners(rows: DataFrame, box: str = "out") -> DataFrame:
    return rows.select(*KEYS, *(F.expr(f"cast({box}[{i}].{c} as double)").alias(f"{c}{n}") for n, i in enumerate((0, 2)) for c in "xy"))


_NORM = "greatest(0::double, least({to}::double, round_even({v} / {size} * {to}, 0)))"


@query(f"with r as ({_RECT}) select {_KEYS}, " + ", ".join(f"{_NORM.format(v=f'{c}{i}', size=s, to=t)} as {c}{i}" for i in (0, 1) for c, s, t in (("x", 800, 1024), ("y", 600, 768))) + " from r")
def normalize_box(spark, sf_dir):
    return _corners(_rects(spark, sf_dir).withColumn("out", geometry.normalize_box("box", "800", "600", "1024", "768")))


@query(f"""with r as ({_RECT}), c as (select *, greatest(0, least(799, x0)) as a, greatest(0, least(599, y0)) as b, greatest(0, least(799, x1)) as c, greatest(0, least(599, y1)) as d from r)
select {_KEYS}, a::double as x0, b::double as y0, c::double as x1, d::double as y1 from c where c - a > 3 and d - b > 3""")
def clip_and_filter(spark, sf_dir):
    clipped = _rects(spark, sf_dir).withColumn("out", geometry.clip_box("box", "800", "600"))
    return _corners(clipped.where(geometry.large_enough("out")))


@query(f"with r as ({_RECT}) select {_KEYS}, " + ", ".join(f"greatest(0, least({m}, ({c}{i} - {p}) * {q}))::double as {c}{i}" for i in (0, 1) for c, m, p, q in (("x", 1000, 0, "1.5::double"), ("y", 900, 12, "1.25::double"))) + " from r")
def map_boxes_to_original(spark, sf_dir):
    return _corners(_rects(spark, sf_dir).withColumn("out", geometry.map_to_original("box", "0D", "12D", "1.5D", "1.25D", "1000D", "900D")))


@query(f"""with r as ({_RECT}), s as (select *, x1 - x0 as w, y1 - y0 as h from r), d as (select *, w * h * 1.6::double / (2 * (w + h)) as d from s)
select {_KEYS}, round_even((x0 - d) * 1000, 0)::bigint as left_units, round_even((y0 - d) * 1000, 0)::bigint as top_units, round_even((x1 + d) * 1000, 0)::bigint as right_units, round_even((y1 + d) * 1000, 0)::bigint as bottom_units from d""")
def unclip(spark, sf_dir):
    grown = _rects(spark, sf_dir).withColumn("out", geometry.unclip("box"))
    names = (("left", 0, "x"), ("top", 0, "y"), ("right", 2, "x"), ("bottom", 2, "y"))
    return grown.select(*KEYS, *(F.expr(f"cast(bround(out[{i}].{c} * 1000, 0) as bigint)").alias(f"{n}_units") for n, i, c in names))


@query(f"with r as ({_RECT}) select {_KEYS}, case when x1 - x0 < 0.000001 then 'VERTICAL' when round_even((y1 - y0) / (x1 - x0), 2) >= 1.5 then 'VERTICAL' else 'HORIZONTAL' end as direction from r")
def box_direction(spark, sf_dir):
    return _rects(spark, sf_dir).select(*KEYS, geometry.direction("box").alias("direction"))


@query(f"with r as ({_RECT}) select {_KEYS}, x1 - x0 as width, y1 - y0 as height from r")
def box_size(spark, sf_dir):
    return _rects(spark, sf_dir).withColumn("s", geometry.box_size("box")).select(*KEYS, "s.width", "s.height")


@query(f"with r as ({_RECT}) select l_orderkey, min(x0) as x_min, min(y0) as y_min, max(x1) as x_max, max(y1) as y_max from r group by l_orderkey")
def quads_to_rect(spark, sf_dir):
    rects = _rects(spark, sf_dir).withColumn("r", geometry.bounding_rect("box"))
    return rects.groupBy("l_orderkey").agg(F.min("r.x_min").alias("x_min"), F.min("r.y_min").alias("y_min"), F.max("r.x_max").alias("x_max"), F.max("r.y_max").alias("y_max"))


@query(f"""with r as ({_RECT}) select {_KEYS}, x1 - x0 as width, y1 - y0 as height from r where least(x1 - x0, y1 - y0) >= 3 and l_discount >= 0.05 and least(x1 - x0, y1 - y0) + (x1 - x0) * (y1 - y0) * 1.6::double / (x1 - x0 + y1 - y0) >= 9""")
def box_filters(spark, sf_dir):
    """Short side, score and short side after growing, each dropping boxes as soon as it can."""
    wide = _scored(spark, sf_dir).withColumn("s", geometry.box_size("box")).where("least(s.width, s.height) >= 3").where("score >= 0.05")
    grown = wide.withColumn("g", geometry.unclip("box")).withColumn("t", geometry.box_size("g")).where("least(t.width, t.height) >= 9")
    return grown.select(*KEYS, "s.width", "s.height")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*KEYS, F.col("l_discount").alias("score"), "l_quantity", F.expr("cast(l_partkey % 900 as double)").alias("x0"), F.expr("cast(l_suppkey * 7 % 700 as double)").alias("y0"))
    return rows.withColumn("box", geometry.quad("x0", "y0", "x0 + l_quantity * 2", "y0 + l_linenumber * 6"))


_POINTS = {"c": ("x + 10 + l_quantity + l_linenumber", "y + 20"), "a": ("x", "y"), "d": ("x + l_linenumber", "y + 22 + l_linenumber"), "b": ("x + 10 + l_quantity", "y - l_linenumber")}


def _pick(of: str, c: str, m: str) -> str:
    return f"list_filter({of}, lambda s: s.{c} = list_{m}(list_transform({of}, lambda t: t.{c})))[1]"


_LEFT, _RIGHT, _UPPER, _LOWER = (f"list_filter(p, lambda s: s.{c} {op} m{c})" for c, op in (("x", "<"), ("x", ">"), ("y", "<"), ("y", ">")))
_DIAMOND = f"[{_pick('p', 'x', 'min')}, {_pick('p', 'y', 'min')}, {_pick('p', 'x', 'max')}, {_pick('p', 'y', 'max')}]"
_BY_Y = f"[{_pick(_UPPER, 'x', 'min')}, {_pick(_UPPER, 'x', 'max')}, {_pick(_LOWER, 'x', 'max')}, {_pick(_LOWER, 'x', 'min')}]"
_BY_X = f"[{_pick(_LEFT, 'y', 'min')}, {_pick(_RIGHT, 'y', 'min')}, {_pick(_RIGHT, 'y', 'max')}, {_pick(_LEFT, 'y', 'max')}]"


@query(f"""with k as (select *, (l_partkey % 40)::double as x, (l_suppkey % 40)::double as y from lineitem), q as (select {_KEYS}, [{', '.join(f"{{'x': {u}, 'y': {v}}}" for u, v in _POINTS.values())}] as p from k),
m as (select *, (p[1].x + p[2].x + p[3].x + p[4].x) / 4 as mx, (p[1].y + p[2].y + p[3].y + p[4].y) / 4 as my from q),
t as (select *, list_contains(list_transform(p, lambda s: s.x), mx) as on_x, list_contains(list_transform(p, lambda s: s.y), my) as on_y from m),
o as (select *, case when on_x and on_y then {_DIAMOND} when on_x and not on_y then {_BY_Y} else {_BY_X} end as o from t)
select {_KEYS}, {', '.join(f"o[{i + 1}].{c} as {c}{i}" for i in range(4) for c in "xy")} from o""")
def order_points(spark, sf_dir):
    """Quads of any shape; points on one vertical line can't occur here and are in the tests."""
    base = table(spark, sf_dir, "lineitem").select(*KEYS, "l_quantity", F.expr("cast(l_partkey % 40 as double)").alias("x"), F.expr("cast(l_suppkey % 40 as double)").alias("y"))
    points = ", ".join(f"named_struct('x', {u}, 'y', {v})" for u, v in _POINTS.values())
    rows = base.select(*KEYS, F.expr(f"array({points})").alias("p")).withColumn("o", geometry.order_points("p"))
    return rows.select(*KEYS, *(F.expr(f"o[{i}].{c}").alias(f"{c}{i}") for i in range(4) for c in "xy"))


_TIES = "l_linenumber, l_partkey, l_suppkey, l_shipdate"


@query(f"""with b as (select *, l_quantity * 4 as y, l_extendedprice as x from lineitem), a as (select *, case when y - lag(y) over (partition by l_orderkey order by y, x, {_TIES}) >= 10 then 1 else 0 end as s from b),
l as (select *, sum(s) over (partition by l_orderkey order by y, x, {_TIES} rows between unbounded preceding and current row)::bigint as line_id from a)
select {_KEYS}, l_extendedprice, line_id, row_number() over (partition by l_orderkey order by line_id, x, y, {_TIES}) - 1 as position from l""")
def reading_order(spark, sf_dir):
    boxes = table(spark, sf_dir, "lineitem").select(*KEYS, "l_shipdate", F.expr("l_quantity * 4").alias("y"), F.col("l_extendedprice").alias("x"))
    ordered = layout.reading_order(boxes, "l_orderkey", "x", "y", _TIES.split(", "))
    return ordered.select(*KEYS, F.col("x").alias("l_extendedprice"), "line_id", "position")


_NEAR = "x0, x1, y0, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""with r as ({_RECT}), n as (select *, lead(x0) over w as nx, lag(x1) over w as px from r window w as (partition by l_orderkey order by {_NEAR}))
select {_KEYS}, l_extendedprice, x0 + coalesce(case when px > x0 then (px - x0) / 2 end, 0) as x0, x1 - coalesce(case when x1 > nx then (x1 - nx) / 2 end, 0) as x1 from n""")
def adjust_overlap(spark, sf_dir):
    return layout.adjust_overlap(_rects(spark, sf_dir), ["l_orderkey"], _NEAR.split(", "), "x0", "x1").select(*KEYS, "l_extendedprice", "x0", "x1")


# Words


_LETTER = "[a-zA-Z]"
_WHITE = r"[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LETTERS = f"""with recursive t as (select conv_id, turn, i, string_split(text, '')[i + 1] as ch, i + 7 * (i // 40) as col from conversations, lateral (select unnest(range(length(text))) as i)),
p as (select *, case when regexp_matches(ch, '{_LETTER}') then 'CN' else 'EN_NUM' end as kind, lag(col) over (partition by conv_id, turn order by i) as before from t),
v as (select *, lag(i) over w as pi, lag(kind) over w as pk from p where not regexp_matches(ch, '^{_WHITE}') window w as (partition by conv_id, turn order by i)),
b as (select *, sum(case when pi is null or i - pi > 1 or kind <> pk or col - before > 5 then 1 else 0 end) over (partition by conv_id, turn order by i) - 1 as word_no from v)"""
_WORDS = f"{_LETTERS}, w as (select conv_id, turn, word_no, string_agg(ch, '' order by i) as word, kind, min(col) as first_col, max(col) as last_col, count(*) as n, avg(i % 10) as conf from b group by conv_id, turn, word_no, kind)"


def _words(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("words", "cols", "type", "confs")) -> DataFrame:
    """The lines with a word and their words. Filters on words would find them a second time: the one that
    an explode asks for is left out by its outer form."""
    lines = _spread(spark, table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    lines = lines.where(text.has_words("text")).select("conv_id", "turn", F.expr("split(text, '')").alias("chars"))
    lines = lines.withColumn("cols", F.expr("transform(chars, (c, i) -> i + 7 * cast(i div 40 as int))")).withColumn("confs", F.expr("transform(chars, (c, i) -> cast(i % 10 as double))"))
    return lines.withColumn("words", text.segment_words("chars", "cols", "confs" if "confs" in fields else "null", _LETTER, fields))


@query(f"{_WORDS} select conv_id, turn, word_no::bigint as word_no, word, kind, first_col::bigint as first_col, n from w")
def word_segment(spark, sf_dir):
    each = _words(spark, sf_dir).select("conv_id", "turn", F.posexplode_outer("words").alias("word_no", "w"))
    return each.select("conv_id", "turn", F.col("word_no").cast("long").alias("word_no"), F.array_join("w.words", "").alias("word"), F.col("w.type").alias("kind"), F.expr("cast(w.cols[0] as bigint)").alias("first_col"), F.expr("cast(size(w.words) as bigint)").alias("n"))


@query(f"{_WORDS} select conv_id, turn, case when count(*) filter (where n > 1) > 0 then round(avg((last_col - first_col) * 4.0::double / (n - 1)) filter (where n > 1) * 1000)::bigint else -1 end as width_units from w group by conv_id, turn")
def avg_char_width(spark, sf_dir):
    widths = _words(spark, sf_dir, ("cols",)).withColumn("a", text.average_width("words", "4D", "-0.001D * size(chars)", "size(chars)"))
    return widths.select("conv_id", "turn", F.expr("cast(round(a * 1000) as bigint)").alias("width_units"))


@query(f"""{_LETTERS}, c as (select conv_id, turn, i, ch, greatest(trunc((col + 0.5) * 4 - 2), 0) + 100 as l, least(trunc((col + 0.5) * 4 + 2), 900) + 100 as r from b)
select conv_id, turn, row_number() over (partition by conv_id, turn order by l, i) - 1 as box_no, ch as word, l::double as left_edge, r::double as right_edge, (i % 10)::double as conf from c""")
def char_cell(spark, sf_dir):
    rows = _words(spark, sf_dir).withColumn("boxes", text.boxes("words", "4D", "4D", "100D", "1000D", single=True))
    each = rows.select("conv_id", "turn", F.posexplode_outer("boxes").alias("box_no", "b"))
    return each.select("conv_id", "turn", F.col("box_no").cast("long").alias("box_no"), F.col("b.word").alias("word"), F.col("b.left").alias("left_edge"), F.col("b.right").alias("right_edge"), F.col("b.conf").alias("conf"))


@query(f"""{_WORDS}, k as (select conv_id, turn, word, greatest(trunc((first_col + 0.5) * 4 - 2), 0) + 100 as l, least(trunc((last_col + 0.5) * 4 + 2), 900) + 100 as r, n from w where kind = 'EN_NUM')
select conv_id, turn, word, l::double as left_edge, r::double as right_edge from k""")
def en_num_box(spark, sf_dir):
    """Boxes of the words of one class only, a word each."""
    rows = _words(spark, sf_dir).withColumn("words", F.expr("filter(words, w -> w.type = 'EN_NUM')")).withColumn("boxes", text.boxes("words", "4D", "4D", "100D", "1000D"))
    return rows.select("conv_id", "turn", F.explode_outer("boxes").alias("b")).where("b is not null").select("conv_id", "turn", F.col("b.word").alias("word"), F.col("b.left").alias("left_edge"), F.col("b.right").alias("right_edge"))


@query(r"select doc_id, coalesce(regexp_matches(text, '[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]'), false) as has_cjk, coalesce(regexp_matches(text, '[\x{c0}-\x{ff}]'), false) as has_accent from documents")
def has_cjk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.has_cjk("text").alias("has_cjk"), text.has_cjk("text", r"[À-ÿ]").alias("has_accent"))


@query(r"select page_id, lower(regexp_extract(url, '(\.[^./\\]*)$', 1)) as extension, lower(regexp_extract(url, '(\.[^./\\]*)$', 1)) = '.html' as kept from pages")
def filter_image_ext(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.extension("url").alias("extension"), text.is_image("url", (".html",)).alias("kept"))


# Joins, aggregates, batches, streams


@query("select d.doc_id, d.n_chars, l.quality from documents d join labels l on d.doc_id = l.doc_id")
def boxes_with_lines(spark, sf_dir):
    return layout.with_recognitions(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query("select d.doc_id, d.n_chars, l.quality from documents d left join labels l on d.doc_id = l.doc_id")
def optional_stage(spark, sf_dir):
    return layout.with_recognitions(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], optional=True)


_TIMES = "select event_type as stage, sum(round(value * 100)::bigint)::bigint as total, count(*) as steps from events group by event_type"


@query(_TIMES)
def perf_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.expr("cast(round(value * 100) as bigint)").alias("ms"))
    return layout.stage_times(rows, ["stage"], "ms")


@query("select conv_id, turn // 6 as batch_no, count(*) as crops, max(length(text)) as widest from conversations group by conv_id, turn // 6")
def chunk_batches(spark, sf_dir):
    rows = layout.batches(table(spark, sf_dir, "conversations"), "turn")
    return rows.groupBy("conv_id", "batch_no").agg(F.count("*").alias("crops"), F.max(F.length("text")).cast("long").alias("widest"))


@query(_TIMES)
def stream_stage_times(spark, sf_dir):
    """The same totals from a stream of files that ends when all are read."""
    name = f"stage_times_{uuid.uuid4().hex}"
    rows = streaming.stream_table(spark, f"{sf_dir}/events.parquet").select(F.col("event_type").alias("stage"), F.expr("cast(round(value * 100) as bigint)").alias("ms"))
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="inkflow-")
    # a few rows, one for each stage, so the memory sink holds them
    run = streaming.stage_times(rows, "stage", "ms").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("""with p as (select url as image_path, length(html) % 5 as n, length(html) % 100 as d, page_id % 10 as c, page_id % 7 as r, case when page_id % 3 = 0 then 'a fault' end as error from pages)
select image_path, printf('%s: %d boxes, %d ms (detect %d, classify %d, recognise %d)', image_path, n, d + c + r, d, c, r) || chr(10) || coalesce(error, 'text of ' || image_path) as report from p""")
def text_report(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("image_path"), F.expr("array_repeat(1, length(html) % 5)").alias("det"), F.expr("cast(length(html) % 100 as bigint)").alias("det_ms"), F.expr("page_id % 10").alias("cls_ms"),
        F.expr("page_id % 7").alias("rec_ms"), F.expr("if(page_id % 3 = 0, 'a fault', null)").alias("error"), F.expr("concat('text of ', url)").alias("text_blocks"))
    return sinks.report(pages)


def _bright(tensor: np.ndarray) -> np.ndarray:
    return (tensor.mean(axis=1, keepdims=True) > 0.6).astype(np.float32)


def _bars(tensor: np.ndarray) -> np.ndarray:
    """Scores of eight steps by the brightness of each eighth of a line."""
    parts = np.stack([x.mean(axis=(1, 2)) for x in np.array_split(tensor.mean(axis=1)[:, None], 8, axis=3) for x in [x[:, 0]]], axis=1)
    return np.exp(-np.abs(parts[:, :, None] - np.linspace(-1, 1, len(ALPHABET))[None, None, :])).astype(np.float32)


@query()
def engine_pages(spark, sf_dir):
    """The whole engine over pictures of the maps, with stand-ins for the models; rows only."""

    def pictures(frames):
        for frame in (f[i : i + 256] for f in frames for i in range(0, len(f), 256)):  # pictures are a hundred times their maps
            rows = []
            for vec, flat in zip(frame.vec_id, frame.embedding):
                cells = np.clip(np.asarray(flat).reshape(8, 8, 1) * 400 + 100, 0, 255).astype(np.uint8)
                image = np.repeat(np.repeat(np.repeat(cells, 3, axis=2), 8, axis=0), 16, axis=1)
                rows.append((vec, f"map:{vec}", *image.shape, image.tobytes(), None))
            yield pd.DataFrame(rows, columns=["image_idx", "image_path", "height", "width", "n_channels", "data", "error"])

    rows = _spread(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    images = rows.mapInPandas(pictures, "image_idx long, image_path string, height int, width int, n_channels int, data binary, error string")
    pages = Engine(spark, Scorers(_bright, _bars), list(ALPHABET), Config(detector=Detector(limit_side_len=64))).pages(images)
    return pages.select("image_idx", "text_blocks", F.size("det").alias("boxes"), "error")
