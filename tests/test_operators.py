"""Edge cases of column functions and kernels, on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkflow.functions import decode, geometry, text
from inkflow.operators import layout, pixels
from inkflow.config import Detector


def value(spark, column, **cols):
    rows = spark.range(1).select(*(F.expr(v).alias(k) for k, v in cols.items())) if cols else spark.range(1)
    return rows.select(column.alias("out")).first().out


def ctc(spark, classes, scores="0.9"):
    best = "array(" + ", ".join(f"named_struct('i', {c}, 'v', cast({scores} as float))" for c in classes) + ")" if classes else "cast(array() as array<struct<i:int,v:float>>)"
    row = spark.range(1).select(F.expr(best).alias("best")).withColumn("kept", decode.kept_steps("best")).withColumn("abc", F.expr("array('-', 'a', 'b')"))
    return row.select("kept", F.array_join(decode.chars("best", "kept", "abc"), "").alias("text"), decode.confidences("best", "kept").alias("confs")).first()


def test_sequences(spark):
    assert ctc(spark, [1, 1, 0, 1, 2]).text == "aab"
    assert ctc(spark, [1, 1, 0, 1, 2]).kept == [0, 3, 4]
    for none in ([0, 0], []):
        got = ctc(spark, none)
        assert (got.text, got.kept, got.confs) == ("", [], [0.0])
    assert ctc(spark, [1], "0.123455").confs == [0.12346]


def test_best_class(spark):
    best = lambda a: value(spark, F.expr(decode.best_sql("a")), a=f"cast({a} as array<float>)")
    assert best("array(1, 3, 3)").i == 1  # the first of equals
    assert best("array(cast('nan' as float), 2, 5)").i == 2 and best("array(cast('nan' as float))").i == 0
    turned = lambda label, score: value(spark, decode.turned(f"'{label}'", score, 0.9))
    assert (turned("180", "0.9D"), turned("180", "0.91D"), turned("0", "1D")) == (False, True, False)
    assert value(spark, decode.turned("null", "1D", 0.9)) is False


def test_sizes(spark):
    size = lambda w, h: value(spark, geometry.resize_bounds("w", "h"), w=str(w), h=str(h))
    assert (size(100, 100).w, size(100, 100).ratio_w) == (100, 1.0)
    assert (size(4000, 1000).w, size(4000, 1000).h) == (2016, 512)  # 62.5 and 15.6 times 32, halves away from zero
    small = size(4000, 50)  # shrinks to 32 rows, which is enough
    assert (small.w, small.h, small.error) == (2016, 32, None)
    assert size(4000, 10).error and size(4000, 10).w is None
    assert (size(20, 300).w, size(20, 300).h) == (32, 448)
    pad = lambda w, h, r=8.0: value(spark, geometry.vertical_padding("w", "h", r), w=str(w), h=str(h))
    assert (pad(100, 30), pad(100, 31), pad(900, 100), pad(900, 100, -1)) == (15, 0, 62, 0)
    low = value(spark, geometry.limit_resize("80", "48", "min", 48))
    assert (low.w, low.h) == (64, 64)  # 2.5 and 1.5 go to the even multiple


def quad_of(points):
    return "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in points) + ")"


def xy(points):
    return [None if p is None else (p.x, p.y) for p in points]


def test_boxes(spark):
    order = lambda p: xy(value(spark, geometry.order_points("p"), p=quad_of(p)))
    assert order([(5, 0), (10, 5), (5, 10), (0, 5)]) == [(0, 5), (5, 0), (10, 5), (5, 10)]
    assert order([(3, 9), (3, 1), (3, 5), (3, 7)]) == [(3, 1), (3, 5), (3, 7), (3, 9)]
    assert order([(10, 10), (0, 0), (10, 0), (0, 10)]) == [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert order([(0, 0), (4, 1), (6, 9), (2, 10)])[:2] == [(0, 0), (4, 1)]
    assert order([(4, 0), (0, 2), (4, 8), (8, 10)]) == [(0, 2), (4, 0), (8, 10), (4, 8)]
    norm = value(spark, geometry.normalize_box("p", "10", "10", "5", "5"), p=quad_of([(1, 3), (5, 20), (-1, 0), (7, 9)]))
    assert xy(norm) == [(0, 2), (2, 5), (0, 0), (4, 4)]  # halves to even
    enough = lambda w: value(spark, geometry.large_enough("p"), p=quad_of([(0, 0), (w, 0), (w, 9), (0, 9)]))
    assert (enough(3), enough(3.1)) == (False, True)
    assert value(spark, geometry.unclip("p"), p=quad_of([(0, 0), (0, 0), (0, 0), (0, 0)])) is None
    grown = np.array(xy(value(spark, geometry.unclip("p"), p=quad_of([(0, 0), (10, 0), (10, 10), (0, 10)]))))
    assert np.allclose(grown, pixels.unclip(np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float), 1.6)) and grown[0, 0] == -4
    way = lambda w, h: value(spark, geometry.direction("p"), p=quad_of([(0, 0), (w, 0), (w, h), (0, h)]))
    assert (way(10, 14.9), way(10, 15), way(0, 5)) == ("HORIZONTAL", "VERTICAL", "VERTICAL")
    assert value(spark, geometry.box_size("p"), p=quad_of([(0, 0)])) is None


def words(spark, chars, cols=None):
    cols = cols if cols is not None else list(range(len(chars)))
    got = value(spark, text.segment_words("c", "k", "f"), c="array(" + ", ".join(f"'{x}'" for x in chars) + ")", k=f"cast(array({', '.join(map(str, cols))}) as array<int>)", f=f"array_repeat(1D, {len(chars)})")
    return None if got is None else [("".join(w.words), w.type) for w in got]


def test_words(spark):
    assert words(spark, "我a b") == [("我", "CN"), ("a", "EN_NUM"), ("b", "EN_NUM")]
    assert words(spark, "我　你") == [("我", "CN"), ("你", "CN")]  # an ideographic space is white space first
    assert words(spark, " ab") == [("ab", "EN_NUM")]
    assert words(spark, "ab", [0, 5]) == [("ab", "EN_NUM")] and words(spark, "ab", [0, 6]) == [("a", "EN_NUM"), ("b", "EN_NUM")]
    assert words(spark, " ", [0]) == [] and words(spark, "a", []) is None
    assert value(spark, text.has_cjk("t"), t="cast(null as string)") is False and value(spark, text.has_cjk("t"), t="'a！'") is True
    assert value(spark, text.average_width("w", "2D", "9D", "3"), w="array(named_struct('cols', array(4)))") == 3.0
    assert value(spark, text.average_width("w", "2D", "9D", "0"), w="array(named_struct('cols', array(4, 7)))") == 0.0
    assert [value(spark, text.is_image("p"), p=f"'{p}'") for p in ("a/b.PNG", "a.tif", "a.b/c", "x.webp")] == [True, False, False, True]


def test_layout(spark):
    boxes = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(5, 0), (1, 9), (3, 18), (0, 28), (9, 38)])], "image int, box int, x double, y double")
    got = {r.box: r.line_id for r in layout.reading_order(boxes, "image", "x", "y", ["box"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}  # a gap of exactly ten opens a line, drift doesn't
    lines = spark.createDataFrame([(1, 1, "b", 0.6), (1, 0, "a", 0.51), (1, 2, "c", 0.5), (2, 0, "d", 0.1), (2, 1, None, None)], "page int, n int, label string, score double")
    assert {r.page: r.text_blocks for r in layout.text_blocks(lines, "page", "n", "label", "score").collect()} == {1: "a b", 2: ""}
    assert layout.text_blocks(lines.limit(0), "page", "n", "label", "score").collect() == []


def test_components_and_contours():
    ring = np.zeros((9, 12), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    ring[7, 7] = ring[8, 8] = True
    assert pixels.label(ring).max() == 2 and pixels.label(ring, corners=False).max() == 3
    found = pixels.contours(ring)
    assert len(found) == 3 and [r.sum() for _, (_, _, r) in found] == [25, 5, 2]
    assert sorted(map(tuple, found[1][0])) == [(2, 3), (3, 2), (3, 4), (4, 3)]
    assert pixels.contours(np.zeros((4, 4), bool)) == [] and len(pixels.contours(ring, 2)) == 2
    for _, (top, left, region) in found:  # regions are in their own rectangles, within the map
        assert region.size <= 49 and top + region.shape[0] <= 9 and left + region.shape[1] <= 12
    rng = np.random.default_rng(2)
    for _ in range(20):
        mask = rng.random((15, 20)) < 0.5
        numbers, want, n = pixels.label(mask), np.zeros(mask.shape, int), 0
        for y, x in zip(*np.nonzero(mask)):
            if not want[y, x]:
                n += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < 15 and 0 <= b < 20 and mask[a, b] and not want[a, b]:
                        want[a, b] = n
                        todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert np.array_equal(numbers, want)


def test_dilation():
    dot = np.zeros((3, 3), bool)
    dot[1, 1] = True
    assert pixels.dilate(dot).astype(int).tolist() == [[0, 0, 0], [0, 1, 1], [0, 1, 1]]


def test_rectangles():
    rng = np.random.default_rng(1)
    for _ in range(50):
        w, h, turn = rng.uniform(2, 30), rng.uniform(2, 30), rng.uniform(0, np.pi)
        u, v = np.array([np.cos(turn), np.sin(turn)]), np.array([-np.sin(turn), np.cos(turn)])
        inside = (rng.random((40, 1)) * w * u) + (rng.random((40, 1)) * h * v)
        corners = np.array([[0, 0], w * u, w * u + h * v, h * v])
        box, side = pixels.min_area_rect(np.concatenate([inside, corners]))
        assert np.isclose(side, min(w, h)) and np.isclose(np.sort(box, axis=0), np.sort(corners, axis=0)).all()
    assert pixels.min_area_rect(np.array([[3, 4]]))[1] == 0


def test_boxes_of_a_map():
    prob = np.zeros((64, 96))
    prob[20:30, 10:60] = 0.9
    prob[40:42, 10:12] = 0.9  # too small
    prob[50:60, 10:60] = 0.45  # too faint
    for mode in ("fast", "slow"):
        found = pixels.boxes_of(prob, 192, 128, Detector(score_mode=mode, use_dilation=False))
        assert len(found) == 1
        box, score = found[0]
        assert np.isclose(score, 0.9) and (box[0] < (20, 40)).all() and (box[2] > (118, 58)).all()
    assert pixels.boxes_of(prob, 192, 128, Detector(max_candidates=0)) == []


def test_crops():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (40, 60, 3), np.uint8)
    same = pixels.crop_quad(image, np.array([[10, 5], [40, 5], [40, 20], [10, 20]], float))
    assert np.array_equal(same, image[5:20, 10:40])
    tall = pixels.crop_quad(image, np.array([[10, 5], [20, 5], [20, 20], [10, 20]], float))
    assert tall.shape == (10, 15, 3) and np.array_equal(tall, np.rot90(image[5:20, 10:20], -1))
    assert pixels.resize(image, 60, 40) is image and pixels.resize(image, 30, 20).shape == (20, 30, 3)
    cell = np.array([[[0, 0], [4, 0], [4, 3], [0, 3]]], float)
    box = np.array([[10, 5], [40, 5], [40, 20], [10, 20]], float)
    assert np.allclose(pixels.to_page(box, cell, False), cell + (10, 5), atol=1)


def test_tensors():
    image = np.full((2, 3, 3), (255, 0, 128), np.uint8)
    x = pixels.planar(image)
    assert x.shape == (3, 2, 3) and x[2, 0, 0] == 1 and x[1, 0, 0] == 0
    assert np.allclose(pixels.planar(image, (0.5,) * 3, (0.5,) * 3), x * 2 - 1)
    line = pixels.line_tensor(image, 4, 6, 8)
    assert line.shape == (3, 4, 8) and not line[:, :, 6:].any() and np.isclose(line[2, 0, 0], 1)
    assert pixels.with_alpha(image).shape == (2, 3, 4)


@pytest.mark.parametrize("least,changed", [(0.5, True), (0.95, False)])
def test_drawing(least, changed):
    image = np.zeros((20, 30, 3), np.uint8)
    out = pixels.draw(image, [(np.array([[5, 5], [20, 5], [20, 15], [5, 15]], float), 0.9)], least)
    assert out.shape == (20, 60, 3) and out[:, :30].any() == changed


def test_corners_are_sorted_after_growing(spark):
    for angle in (0, 20, 60, 80, 82, 85):
        t = np.deg2rad(angle)
        turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        box = pixels.sort_corners(np.array([[-50, -5], [50, -5], [50, 5], [-50, 5]]) @ turn.T + 100)
        grown = pixels.unclip(box, 1.6)
        assert np.array_equal(grown, pixels.sort_corners(grown))
        assert np.allclose(xy(value(spark, geometry.unclip("p"), p=quad_of(box.tolist()))), grown)


def test_scores_round_corners_to_the_nearest_pixel():
    prob = np.arange(100.0).reshape(10, 10)
    box = np.array([[1.6, 1.6], [5.4, 1.6], [5.4, 3.4], [1.6, 3.4]])
    # the rectangle starts at (1, 1); its corners are at 0.6 and 4.4 in it, so at 1 and 4
    assert pixels.score_fast(prob, box) == prob[2:4, 2:6].mean()


def test_scores_that_are_no_numbers_and_channels():
    nan = float("nan")
    assert pixels.best_class(np.array([[nan, 1.0, 2.0], [nan, nan, nan], [3.0, nan, 3.0]]), 1).tolist() == [2, 0, 0]
    assert pixels.colour(bytes([7, 9]), 1, 2).tolist() == [[[7, 7, 7], [9, 9, 9]]]
    assert pixels.colour(bytes([1, 2, 3, 255]), 1, 1).tolist() == [[[1, 2, 3]]]


def test_crops_at_page_scale():
    crop = np.full((3, 5, 3), 9, np.uint8)
    assert pixels.at_page_scale(crop, 1.5, 2.5).shape == (4, 12, 3)  # halves go to even
    assert (pixels.at_page_scale(crop, 2, 2) == 9).all()
