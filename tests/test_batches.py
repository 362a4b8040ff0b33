"""Kernels and stages that take many points, pixels or pages at a time give what they gave one by one."""

import numpy as np
import pyarrow as pa

from inkflow.config import Config, Detector
from inkflow.operators import pixels, stages
from inkflow.plans import queries
from inkflow.sources.models import Scorers

SF = "/root/testdata/sf0.001"


def test_hulls_look_at_the_outermost_points_only():
    rng = np.random.default_rng(3)
    for _ in range(100):
        points = np.argwhere(rng.random((12, 17)) < rng.uniform(0.01, 0.9))[:, ::-1]
        if len(points):
            assert np.array_equal(pixels.hull(rng.permutation(points)), pixels.hull(points.astype(float)))
    block = np.argwhere(np.ones((300, 400)))[:, ::-1]
    assert pixels._outermost(block) == ([[0, 0], [399, 0]], [[0, 299], [399, 299]])


def test_crops_and_sizes_pixel_by_pixel():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (90, 140, 3), np.uint8)
    # more pixels than a part holds; the quad leaves the image
    box = np.array([[-3, 5], [130, 2], [138, 80], [4, 89]], float)
    got = pixels.crop_quad(image, box)
    w, h = max(np.hypot(*(box[0] - box[1])), np.hypot(*(box[2] - box[3]))), max(np.hypot(*(box[0] - box[3])), np.hypot(*(box[1] - box[2])))
    back = np.linalg.inv(pixels.perspective(box, np.array([[0, 0], [w, 0], [w, h], [0, h]])))
    assert got.shape == (int(h), int(w), 3) and got.shape[0] * got.shape[1] > 4096
    weight = lambda d: ((-0.75 + 2) * d - (-0.75 + 3)) * d * d + 1 if d <= 1 else ((-0.75 * d + 3.75) * d - 6) * d + 3 if d < 2 else 0
    for y, x in rng.integers(0, got.shape[:2], (200, 2)):
        u, v, z = back @ (x, y, 1)
        u, v = u / z, v / z
        left, top = int(np.floor(u)), int(np.floor(v))
        want = sum(weight(abs(v - j)) * weight(abs(u - i)) * image[np.clip(j, 0, 89), np.clip(i, 0, 139)].astype(float) for j in range(top - 1, top + 3) for i in range(left - 1, left + 3))
        assert np.abs(got[y, x] - np.clip(want, 0, 255)).max() < 0.5 + 1e-6
    small = pixels.resize(image, 33, 21)
    y, x = (20 + 0.5) * 90 / 21 - 0.5, (7 + 0.5) * 140 / 33 - 0.5
    j, i, b, a = int(y), int(x), y % 1, x % 1
    want = sum(p * q * image[m, n].astype(float) for m, p in ((j, 1 - b), (j + 1, b)) for n, q in ((i, 1 - a), (i + 1, a)))
    assert np.abs(small[20, 7] - want).max() < 0.5 + 1e-3


def test_upright_boxes_score_as_others():
    prob = np.random.default_rng(5).random((20, 30)).astype(np.float32)
    for box in ([[2, 3], [9, 3], [9, 8], [2, 8]], [[-4, 3], [40, 3], [40, 25], [-4, 25]], [[5, 5], [5, 5], [5, 5], [5, 5]], [[31, 3], [35, 3], [35, 8], [31, 8]]):
        corners = np.array(box, float)
        x0, y0 = np.clip(corners.min(axis=0), 0, (29, 19)).astype(int)
        x1, y1 = np.clip(corners.max(axis=0), 0, (29, 19)).astype(int)
        part = prob[y0 : y1 + 1, x0 : x1 + 1]
        inside = pixels.fill(corners - (x0, y0), part.shape)
        assert pixels.score_fast(prob, corners) == (float(part[inside].mean()) if inside.any() else 0.0)


def test_rings_within_rings_and_parts_without_holes():
    mask = np.zeros((13, 24), bool)
    mask[1:12, 1:12], mask[2:11, 2:11], mask[4:9, 4:9], mask[6, 6] = True, False, True, False
    mask[3:6, 15:20] = True
    assert [(len(p), int(r.sum())) for p, (_, _, r) in pixels.contours(mask)] == [(40, 121), (52, 108), (15, 15), (24, 25), (4, 5)]


class Plan:
    """Stands for a DataFrame and keeps the function of its stage."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def test_pages_are_handed_on_together(spark, monkeypatch):
    monkeypatch.setattr(stages, "plan_sizes", lambda images, config: Plan())
    run = stages.detect(None, Config(detector=Detector(limit_side_len=64)), Scorers(queries._bright, queries._bars))
    image = np.zeros((64, 128, 3), np.uint8)
    image[8:32, 16:96] = 255
    row = {"height": 64, "width": 128, "data": image.tobytes(), "error": None, "pad": 0, "b_w": 128, "b_h": 64, "b_rw": 1.0, "b_rh": 1.0, "d_w": 128, "d_h": 64}
    bad = row | {"data": b"short"}
    batch = pa.RecordBatch.from_pylist([{"image_idx": i, "image_path": str(i)} | (bad if i == 70 else row) for i in range(150)])
    (out,) = run(iter([batch]))
    assert out["image_idx"].to_pylist() == list(range(150))
    assert [i for i, e in enumerate(out["error"].to_pylist()) if e is not None] == [70] and out["crop_idx"][70].as_py() is None and out["crop_idx"][0].as_py() == 0


def test_pages_that_go_on_in_the_next_batch():
    keys = [(1, "a")] * 3 + [(2, "a")] * 5 + [(2, "b")] + [(3, "c")] * 4 + [(None, "d")] * 2
    rows = pa.table({"image_idx": pa.array([k for k, _ in keys], pa.int64()), "image_path": [p for _, p in keys], "n": range(len(keys))})
    for size in range(1, len(keys) + 1):
        got = [[table["n"].to_pylist()[i] for i in part] for table, parts in stages._pages(iter(rows.to_batches(size))) for part in parts]
        assert got == [[0, 1, 2], [3, 4, 5, 6, 7], [8], [9, 10, 11, 12], [13, 14]]


def test_pages_are_dealt_over_all_cores(spark):
    plan = queries.engine_pages(spark, SF)._jdf.queryExecution().toString()
    assert "RepartitionByExpression [vec_id" in plan and f"], {4 * spark.sparkContext.defaultParallelism}" in plan
