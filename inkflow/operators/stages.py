"""The stages of a page as DataFrame operators: prepare, detect, classify, recognise, assemble.

The three network stages are Arrow-batched iterators that pipeline within a task, so no shuffle comes
between them; what follows is native. A page that fails has its error in ``error`` and no crops.
"""

from __future__ import annotations

import time
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import decode, geometry, text
from ..sources.models import Scorers
from . import pixels

QUAD = "array<struct<x: float, y: float>>"
CROPS = f"image_idx long, image_path string, crop_idx int, box {QUAD}, box_page {QUAD}, det_score float, line_id int, height int, width int, data binary, det_ms long, error string"
TURNED = CROPS + ", cls_label string, cls_score float, cls_ms long"
READ = TURNED.replace("data binary, ", "") + ", best array<struct<i: int, v: float>>, wh_ratio float, max_wh_ratio float, rec_ms long"

#: Bytes of crops from which a batch of rows is handed on, and images that are unpacked at a time.
BATCH_BYTES, IMAGES = 8 << 20, 64
_QUAD = pa.list_(pa.struct([("x", pa.float32()), ("y", pa.float32())]))
_BEST = pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float32())]))
_CROPS = pa.schema([("image_idx", pa.int64()), ("image_path", pa.string()), ("crop_idx", pa.int32()), ("box", _QUAD), ("box_page", _QUAD), ("det_score", pa.float32()), ("line_id", pa.int32()),
    ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary()), ("det_ms", pa.int64()), ("error", pa.string())])


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """What is no number is null, as pandas has it."""
    return pa.array(values, kind, from_pandas=True)


def _ms(since: float) -> int:
    return int((time.perf_counter() - since) * 1000)


def _image(data: bytes, height: int, width: int) -> np.ndarray:
    return pixels.colour(data, int(height), int(width))


def plan_sizes(images: DataFrame, config: Config) -> DataFrame:
    """Target sizes of every image, natively: within bounds, padded, and for the detector."""
    sized = images.withColumn("b", geometry.resize_bounds("width", "height", config.max_side_len, config.min_side_len))
    padded = sized.withColumn("pad", geometry.vertical_padding("b.w", "b.h", config.width_height_ratio, config.min_height))
    return padded.withColumn("d", geometry.limit_resize("b.w", "(b.h + 2 * pad)", config.detector.limit_type, config.detector.limit_side_len)).withColumn("error", F.coalesce("error", "b.error"))


def detect(images: DataFrame, config: Config, scorers: Scorers) -> DataFrame:
    """CROPS in reading order; a page without text has one row without a crop."""
    det = config.detector

    def quad(points: np.ndarray) -> list:
        return [{"x": x, "y": y} for x, y in points.astype(float).tolist()]

    def page(row) -> list[tuple]:
        since = time.perf_counter()
        image = pixels.pad_rows(pixels.resize(_image(row.data, row.height, row.width), int(row.b_w), int(row.b_h)), int(row.pad))
        norm = {} if config.version == "v5" else {"mean": det.mean, "std": det.std}
        scaled = pixels.resize(image, int(row.d_w), int(row.d_h))
        tensor = scorers.prepare(scaled) if scorers.prepare else pixels.planar(scaled, **norm)[None]
        prob = np.asarray(scorers.detect(tensor))[0, 0]
        boxes = (scorers.find or pixels.boxes_of)(prob, image.shape[1], image.shape[0], det)
        found = pixels.in_reading_order(boxes, det.line_gap)
        ms = _ms(since)
        out = []
        for i, (box, score, line) in enumerate(found):
            crop = pixels.crop_quad(image, box)
            on_page = np.clip((box - (0, int(row.pad))) * (row.b_rw, row.b_rh), 0, (row.width, row.height))
            out.append((row.image_idx, row.image_path, i, quad(box), quad(on_page), score, line, *crop.shape[:2], crop.tobytes(), ms, None))
        return out or [(row.image_idx, row.image_path, None, None, None, None, None, None, None, None, ms, None)]

    def rows_of(row) -> list[tuple]:
        error = row.error
        if error is None:
            try:
                return page(row)
            except Exception as e:  # one bad page must not end the others
                error = f"{type(e).__name__}: {e}"
        return [(row.image_idx, row.image_path, None, None, None, None, None, None, None, None, 0, error)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image, out, held = namedtuple("image", batch.schema.names), [], 0
            for at in range(0, batch.num_rows, IMAGES):
                for row in map(image._make, zip(*(c.to_pylist() for c in batch.slice(at, IMAGES).columns))):
                    rows = rows_of(row)
                    out += rows
                    held += sum(len(r[9] or b"") for r in rows)
                    if held >= BATCH_BYTES:
                        yield _batch(out)
                        out, held = [], 0
            if out:
                yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([_column(c, f.type) for c, f in zip(zip(*rows), _CROPS)], schema=_CROPS)

    planned = plan_sizes(images, config).select(
        "image_idx", "image_path", "height", "width", "data", "error", "pad", F.col("b.w").alias("b_w"), F.col("b.h").alias("b_h"), F.col("b.ratio_w").alias("b_rw"), F.col("b.ratio_h").alias("b_rh"), F.col("d.w").alias("d_w"), F.col("d.h").alias("d_h"))
    return planned.mapInArrow(run, CROPS)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[range]]]:
    """Tables of whole pages, though a page may go on in the next batch, and the rows of each page."""
    held, open_page = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = list(zip(batch["image_idx"].to_pylist(), batch["image_path"].to_pylist()))
        last = len(ids) - 1
        while last and ids[last - 1] == ids[-1]:
            last -= 1
        if held and (last or ids[0] != open_page):
            yield _cut(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        elif held or not last:
            held.append(batch)
        else:
            yield _cut(pa.Table.from_batches([batch.slice(0, last)]))
            held = [batch.slice(last)]
        open_page = ids[-1]
    if held:
        yield _cut(pa.Table.from_batches(held))


def _cut(rows: pa.Table) -> tuple[pa.Table, list[range]]:
    ids = list(zip(rows["image_idx"].to_pylist(), rows["image_path"].to_pylist()))
    begins = [i for i, key in enumerate(ids) if i == 0 or key != ids[i - 1]]
    return rows, [range(a, b) for a, b in zip(begins, [*begins[1:], len(ids)])]


def _crops_of(rows: pa.Table) -> list[tuple[bytes, int, int] | None]:
    """Data, height and width of each row, None without a crop."""
    return [None if x[0] is None else x for x in zip(*(rows[c].to_pylist() for c in ("data", "height", "width")))]


def _with(rows: pa.Table, **columns: tuple[list, pa.DataType]) -> list[pa.RecordBatch]:
    """The rows with columns added, or in place of those of the same name."""
    for name, (values, kind) in columns.items():
        values, at = _column(values, kind), rows.schema.get_field_index(name)
        rows = rows.append_column(name, values) if at < 0 else rows.set_column(at, name, values)
    return rows.combine_chunks().to_batches()


def _failed(errors: list, rows: range, error: Exception) -> None:
    """Gives a page's rows that have no error this one."""
    for i in rows:
        if errors[i] is None:
            errors[i] = f"{type(error).__name__}: {error}"


def classify(crops: DataFrame, config: Config, scorers: Scorers, batch_num: int | None = None) -> DataFrame:
    """Adds cls_label and cls_score, and turns the crops that are upside down; without a model, nulls."""
    if scorers.classify is None:
        return crops.selectExpr("*", "cast(null as string) as cls_label", "cast(null as float) as cls_score", "0L as cls_ms")
    size, labels, least = batch_num or config.classifier.batch_num, config.classifier.labels, config.classifier.thresh
    _, height, width = config.cls_shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, pages in _pages(batches):
            crops, errors, data, n = _crops_of(table), table["error"].to_pylist(), table["data"].to_pylist(), table.num_rows
            names, sure, took = [None] * n, [None] * n, [0] * n
            for rows in pages:
                has = [i for i in rows if crops[i]]
                for at in range(0, len(has), size):
                    since, part = time.perf_counter(), has[at : at + size]
                    images = [_image(*crops[i]) for i in part]
                    tensor = np.stack([pixels.line_tensor(x, height, min(int(np.ceil(height * np.float32(x.shape[1] / x.shape[0]))), width), width) for x in images])
                    try:
                        scores = np.asarray(scorers.classify(tensor))
                        best = pixels.best_class(scores, 1)
                    except Exception as e:  # the page's lines stay as they are
                        _failed(errors, rows, e)
                        break
                    took[part[0]] = _ms(since)
                    for k, (i, b, image) in enumerate(zip(part, best, images)):
                        names[i], sure[i] = labels[b], float(scores[k, b])
                        if labels[b] == "180" and scores[k, b] > least:
                            data[i] = pixels.turn_half(image).tobytes()
            yield from _with(table, data=(data, pa.binary()), error=(errors, pa.string()), cls_label=(names, pa.string()), cls_score=(sure, pa.float32()), cls_ms=(took, pa.int64()))

    return crops.mapInArrow(run, TURNED)


def recognise(crops: DataFrame, config: Config, scorers: Scorers, batch_num: int | None = None) -> DataFrame:
    """READ: crops with the best class of each step. Lines of a batch are padded to the widest of them."""
    size = batch_num or config.recognizer.batch_num
    _, height, least = config.recognizer.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, pages in _pages(batches):
            crops, errors, n = _crops_of(table), table["error"].to_pylist(), table.num_rows
            steps, ratio, widest, took = [None] * n, [None] * n, [None] * n, [0] * n
            for rows in pages:
                has = [i for i in rows if crops[i]]
                for at in range(0, len(has), size):
                    since, part = time.perf_counter(), has[at : at + size]
                    images = [_image(*crops[i]) for i in part]
                    ratios = [np.float32(x.shape[1] / x.shape[0]) for x in images]
                    own = [max(np.float32(least / height), r) for r in ratios]
                    width = int(np.rint(float(np.float32(height) * max(own))))
                    tensor = np.stack([pixels.line_tensor(x, height, min(int(np.ceil(np.float32(height) * r)), int(np.rint(float(np.float32(height) * o)))), width) for x, r, o in zip(images, ratios, own)])
                    try:
                        probs = np.asarray(scorers.recognize(tensor))
                        index = pixels.best_class(probs, 2)
                    except Exception as e:  # the page's lines that were read before stay
                        _failed(errors, rows, e)
                        break
                    value = np.take_along_axis(probs, index[:, :, None], axis=2)[:, :, 0]
                    took[part[0]] = _ms(since)
                    for k, (i, classes, scores) in enumerate(zip(part, index.tolist(), value.tolist())):
                        steps[i] = [{"i": c, "v": v} for c, v in zip(classes, scores)]
                        ratio[i], widest[i] = float(ratios[k]), float(max(own))
            yield from _with(table.drop_columns(["data"]), error=(errors, pa.string()), best=(steps, _BEST), wh_ratio=(ratio, pa.float32()), max_wh_ratio=(widest, pa.float32()), rec_ms=(took, pa.int64()))

    return crops.mapInArrow(run, READ)


def decoded(read: DataFrame, alphabet: list[str]) -> DataFrame:
    """READ with label, score, line_txt_len, valid_cols, chars and confs in place of the steps, natively."""
    step = read.withColumn("alphabet", F.array(*(F.lit(x) for x in alphabet))).withColumn("valid_cols", decode.kept_steps("best"))
    step = step.withColumn("chars", decode.chars("best", "valid_cols", "alphabet")).withColumn("confs", decode.confidences("best", "valid_cols"))
    step = step.withColumns({"label": F.array_join("chars", ""), "score": decode.mean_score("confs").cast("float"), "line_txt_len": decode.line_length("size(best)", "wh_ratio", "max_wh_ratio")})
    has = F.col("best").isNotNull()
    return step.withColumns({c: F.when(has, F.col(c)) for c in ("label", "score", "line_txt_len", "valid_cols", "chars", "confs")}).drop("best", "alphabet", "wh_ratio", "max_wh_ratio")


def word_boxes(lines: DataFrame, config: Config) -> DataFrame:
    """Adds word_boxes, array of struct(word, conf, box), to lines with their crop's height and width, box, chars,
    valid_cols, confs and line_txt_len. Cells are found within the crop and then placed on the page."""
    step = lines.withColumn("rect", F.expr("named_struct('x_min', 0D, 'y_min', 0D, 'x_max', cast(width as double), 'y_max', cast(height as double))")).withColumn("words", text.segment_words("chars", "valid_cols", "confs"))
    step = step.withColumn("cell_w", F.expr("(rect.x_max - rect.x_min) / line_txt_len")).withColumn("mean_w", text.average_width("words", "cell_w", "(rect.x_max - rect.x_min)", "size(chars)"))
    step = step.withColumn("cells", text.boxes("words", "mean_w", "cell_w", "rect.x_min", "rect.x_max", config.return_single_char_box))
    # neighbours that overlap each give up half
    apart = """transform(cells, (c, i) -> named_struct('word', c.word, 'conf', c.conf,
        'left', c.left + if(i > 0, greatest(0D, cells[greatest(i - 1, 0)].right - c.left) / 2, 0D),
        'right', c.right - if(i < size(cells) - 1, greatest(0D, c.right - cells[least(i + 1, size(cells) - 1)].left) / 2, 0D)))"""
    step = step.withColumn("cells", F.expr(geometry.bound("cells", "cells", apart))).withColumn("direction", geometry.direction("box"))

    @F.pandas_udf(f"array<{QUAD}>")
    def placed(boxes: pd.Series, rects: pd.DataFrame, cells: pd.Series, directions: pd.Series) -> pd.Series:
        out = []
        for box, (_, rect), own, way in zip(boxes, rects.iterrows(), cells, directions):
            if box is None or own is None or not len(own):
                out.append([])
                continue
            quad = np.array([[p["x"], p["y"]] for p in box], float)
            flat = np.array([[[c["left"], rect.y_min], [c["right"], rect.y_min], [c["right"], rect.y_max], [c["left"], rect.y_max]] for c in own], float)
            try:
                on_page = pixels.to_page(quad, flat, way == "VERTICAL")
            except np.linalg.LinAlgError:
                on_page = flat
            out.append([[{"x": float(x), "y": float(y)} for x, y in cell] for cell in on_page])
        return pd.Series(out)

    step = step.withColumn("quads", placed("box", "rect", "cells", "direction"))
    return step.withColumn("word_boxes", F.expr(f"transform(cells, (c, i) -> named_struct('word', c.word, 'conf', c.conf, 'box', transform(array(quads[i]), q -> {geometry.order_points_sql('q')})[0]))")).drop("rect", "words", "cell_w", "mean_w", "cells", "direction", "quads")


def assembled(lines: DataFrame, config: Config) -> DataFrame:
    """One row for each page: its text, boxes, classes, lines, times and error."""
    if config.return_word_box:
        lines = word_boxes(lines, config)
    rec = ["label", "score", "line_txt_len", "valid_cols", "confs"] + ["word_boxes"] * config.return_word_box
    sort = lambda *cols: F.array_sort(F.collect_list(F.when(F.col("crop_idx").isNotNull(), F.struct("crop_idx", *cols))))
    said = F.array_sort(F.collect_list(F.when(F.col("score") > config.recognizer.text_score, F.struct("crop_idx", "label"))))
    return lines.groupBy("image_idx", "image_path").agg(
        F.array_join(F.transform(said, lambda s: s.label), " ").alias("text_blocks"), sort("box", "box_page", "det_score", "line_id").alias("det"), sort("cls_label", "cls_score").alias("cls"), sort(*rec).alias("rec"),
        F.coalesce(F.max("det_ms"), F.lit(0)).alias("det_ms"), F.coalesce(F.sum("cls_ms"), F.lit(0)).alias("cls_ms"), F.coalesce(F.sum("rec_ms"), F.lit(0)).alias("rec_ms"), F.max("error").alias("error"))
