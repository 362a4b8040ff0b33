"""The engine end to end with scorers that read coloured bars instead of models."""

import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from inkflow.config import Config, Detector
from inkflow.operators import pixels
from inkflow.plans.engine import Engine
from inkflow.sources import images as sources
from inkflow.sources import sinks
from inkflow.sources.models import OnnxScorer, Scorers, alphabet, alphabet_of_model

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
ALPHABET = alphabet("a\nb\nc")


def detect(tensor):
    """Bright pixels are text."""
    return (tensor.mean(axis=1, keepdims=True) > 0.4).astype(np.float32) * 0.9


def recognize(tensor):
    """Four steps: the letter of the brightest channel (red a, green b, blue c), a blank, the letter twice."""
    out = np.full((len(tensor), 4, 5), 0.01, np.float32)
    letter = tensor.mean(axis=(2, 3)).argmax(axis=1) + 1
    rows = np.arange(len(tensor))
    out[rows, 0, letter], out[rows, 1, 0], out[rows, 2, letter], out[rows, 3, letter] = 0.8, 0.99, 0.9, 0.7
    return out


def classify(tensor):
    """Upside down if the left half is darker than the right."""
    half = tensor.shape[3] // 2
    dark = tensor[:, :, :, :half].mean(axis=(1, 2, 3)) < tensor[:, :, :, half:].mean(axis=(1, 2, 3))
    return np.stack([np.where(dark, 0.05, 0.95), np.where(dark, 0.95, 0.05)], axis=1).astype(np.float32)


def picture(*bars):
    """256 x 192, with bars of a colour (blue, green, red) at (x, y)."""
    image = np.zeros((192, 256, 3), np.uint8)
    for x, y, colour in bars:
        image[y : y + 24, x : x + 90] = colour
    return image


RED, GREEN, BLUE = (160, 160, 255), (160, 255, 160), (255, 160, 160)
CONFIG = Config(detector=Detector(limit_side_len=192))


def engine(spark, config=CONFIG, cls=None):
    return Engine(spark, Scorers(detect, recognize, cls), ALPHABET, config)


def save(folder, **named):
    for name, image in named.items():
        (folder / f"{name}.png").write_bytes(pixels.png(image))


def test_array_in_memory(spark):
    image = picture((150, 20, GREEN), (20, 24, RED), (20, 100, BLUE))
    row = engine(spark).recognize(image)
    assert row.text_blocks == "aa bb cc" and row.error is None
    assert [d.line_id for d in row.det] == [0, 0, 1]
    assert [(c.cls_label, c.cls_score) for c in row.cls] == [(None, None)] * 3
    assert row.rec[0].valid_cols == [0, 2] and abs(row.rec[0].score - 0.85) < 1e-6
    box = np.array([[p.x, p.y] for p in row.det[0].box_page])
    assert box[0, 0] < 20 < 100 < box[1, 0] and box[0, 1] < 24 < 48 < box[2, 1]
    assert engine(spark).recognize_seq(image).text_blocks == row.text_blocks


def test_folder_list_and_modes_agree(spark, tmp_path):
    save(tmp_path, one=picture((20, 20, RED)), two=picture((20, 20, GREEN), (20, 100, RED)), none=picture())
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("no image either")
    own = engine(spark)
    want = {"one": "aa", "two": "bb aa", "none": "", "broken": ""}
    for rows in (own.batch(str(tmp_path)), own.batch_parallel(str(tmp_path)), list(own.foreach(str(tmp_path))), list(own.foreach_parallel(str(tmp_path)))):
        assert {os.path.basename(r.image_path)[:-4]: r.text_blocks for r in rows} == want
        assert [r.error is not None for r in rows] == ["broken" in r.image_path for r in rows]
    names = [os.path.basename(r.image_path)[:-4] for r in own.batch(str(tmp_path))]
    assert names == sorted(names)
    paths = [str(tmp_path / f"{n}.png") for n in ("two", "one", "two")] + [str(tmp_path / "note.txt")]
    rows = own.batch(paths)
    assert [r.text_blocks for r in rows] == ["bb aa", "aa", "bb aa"] and [r.image_path for r in rows] == paths[:3]


def test_orientation(spark):
    image = picture((20, 20, RED))
    image[20:44, 20:65] //= 2
    image[20:44, 20:65] += 70
    row = engine(spark, cls=classify).recognize(image)
    assert [c.cls_label for c in row.cls] == ["180"] and row.text_blocks == "aa"


def test_word_boxes(spark):
    for single, words in ((False, ["aa"]), (True, ["a", "a"])):
        config = Config(detector=CONFIG.detector, return_word_box=True, return_single_char_box=single)
        row = engine(spark, config).recognize(picture((20, 20, RED)))
        got = row.rec[0].word_boxes
        assert [w.word for w in got] == words
        xs = [(w.box[0].x, w.box[1].x) for w in got]
        assert all(a < b for a, b in xs) and all(b <= c for (_, b), (c, _) in zip(xs, xs[1:]))


def test_annotated_images_and_reports(spark, tmp_path):
    save(tmp_path, one=picture((20, 20, RED)))
    out = tmp_path / "out"
    rows = engine(spark).batch(str(tmp_path), save_dir=str(out))
    assert len(rows) == 1 and os.listdir(out) == ["res_one.png"]
    back = sources.scan_images(spark, str(out)).first()
    assert (back.height, back.width) == (192, 512)
    pages = engine(spark).pages(sources.memory_images(spark, [picture((20, 20, RED))]))
    assert "1 boxes" in sinks.report(pages).first().report


def test_stream(spark, tmp_path):
    files, seen = tmp_path / "in", []
    files.mkdir()
    save(files, one=picture((20, 20, RED)), two=picture((20, 20, GREEN)))
    own = engine(spark)
    query = own.stream(str(files), str(tmp_path / "state"), lambda pages, n: seen.extend(r.text_blocks for r in pages.collect()))
    assert query.awaitTermination(120)
    save(files, three=picture((20, 20, BLUE)))
    assert own.stream(str(files), str(tmp_path / "state"), lambda pages, n: seen.extend(r.text_blocks for r in pages.collect())).awaitTermination(120)
    assert sorted(seen) == ["aa", "bb", "cc"]  # a restart goes on after what was read


def test_checks(spark, tmp_path):
    with pytest.raises(ValueError):
        sources.check_image("")
    with pytest.raises(ValueError):
        sources.check_image("a.txt")
    with pytest.raises(FileNotFoundError):
        sources.check_image(str(tmp_path / "a.png"))
    with pytest.raises(ValueError):
        sources.check_folder(spark, str(tmp_path))
    with pytest.raises(ValueError):
        sources.list_images(spark, ["a.txt"])
    with pytest.raises(ValueError):
        Config(batch_pool_size=0)
    with pytest.raises(ValueError):
        Config(version="v3")
    (tmp_path / "B.PNG").write_bytes(pixels.png(picture()))
    assert [os.path.basename(r.path) for r in sources.scan_files(spark, str(tmp_path)).select("path").collect()] == ["B.PNG"]


def test_alphabet():
    assert ALPHABET == ["blank", "a", "b", "c", " "]


def _png_of(image, kind):
    """A PNG file of grey (kind 0) or RGBA (kind 6) pixels."""
    import zlib

    chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, kind, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def test_grey_and_transparent_images_and_missing_paths(spark, tmp_path):
    page = picture((20, 20, RED))
    (tmp_path / "grey.png").write_bytes(_png_of(page.max(axis=2), 0))
    (tmp_path / "clear.png").write_bytes(_png_of(np.dstack([page[:, :, ::-1], np.full(page.shape[:2], 200, np.uint8)]), 6))
    save(tmp_path, plain=page)
    paths = [f"{tmp_path}/{x}.png" for x in ("grey", "clear", "gone")] + [f"file://{tmp_path}/plain.png", f"{tmp_path}/plain.png"]
    images = sources.list_images(spark, paths)
    assert "BroadcastNestedLoopJoin" not in images._jdf.queryExecution().toString()
    got = {r.image_idx: r for r in engine(spark).pages(images).collect()}
    assert [got[i].image_path for i in range(5)] == paths
    assert got[2].error == "the file isn't there"
    assert [got[i].text_blocks for i in (1, 3, 4)] == ["aa"] * 3
    assert got[0].error is None and len(got[0].det) == 1


def test_a_failing_model_call_ends_its_page_only(spark):
    def fails_on_green(tensor):
        if tensor.mean(axis=(2, 3))[:, 1].max() > tensor.mean(axis=(2, 3))[:, 0].max():
            raise RuntimeError("no green, please")
        return recognize(tensor)

    def all_nan(tensor):
        return np.full((len(tensor), 2), np.nan, np.float32)

    images = sources.memory_images(spark, [picture((20, 20, RED)), picture((20, 20, GREEN))])
    pages = {r.image_idx: r for r in Engine(spark, Scorers(detect, fails_on_green, all_nan), ALPHABET, CONFIG).pages(images).collect()}
    assert (pages[0].text_blocks, pages[0].error, pages[0].cls[0].cls_label) == ("aa", None, "0")
    assert pages[1].text_blocks == "" and "no green" in pages[1].error


def _varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + _varint(n >> 7)


def _message(*fields):
    """Fields (number, integer, text or message) in the wire format of model files."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


def _model(alphabet_lines):
    """A model that takes the mean over the channels, with an alphabet in its metadata."""
    shape = _message(*((1, _message((2, n))) for n in "nchw"))
    tensor = lambda name: _message((1, name), (2, _message((1, _message((1, 1), (2, shape))))))
    node = _message((1, "x"), (2, "y"), (4, "ReduceMean"), (5, _message((1, "axes"), (8, 1), (20, 7))))
    graph = _message((1, node), (2, "g"), (11, tensor("x")), (12, tensor("y")))
    return _message((1, 8), (7, graph), (8, _message((1, ""), (2, 13))), (14, _message((1, "character"), (2, alphabet_lines))))


def test_model_files_reach_the_executors(spark, tmp_path):
    path = tmp_path / "mean.onnx"
    path.write_bytes(_model("a\nb\nc"))
    assert alphabet_of_model(str(path)) == ALPHABET
    sent = OnnxScorer(str(path)).shipped(spark)
    assert sent.path == "mean.onnx"
    row = Engine(spark, Scorers(sent, recognize), ALPHABET, CONFIG).recognize(picture((20, 20, RED)))
    assert (row.text_blocks, row.error) == ("aa", None)
    with pytest.raises(ValueError):
        OnnxScorer("m.onnx", "abacus")(np.zeros((1, 3, 4, 4), np.float32))


def test_own_preparation_and_boxes(spark):
    def dark(image):
        return 1 - pixels.planar(image)[None]

    def one(prob, width, height, config):
        assert prob[0, 0] > 0.5
        return [(np.array([[20, 20], [110, 20], [110, 44], [20, 44]], float), 0.75)]

    row = Engine(spark, Scorers(detect, recognize, prepare=dark, find=one), ALPHABET, CONFIG).recognize(picture((20, 20, RED)))
    assert row.text_blocks == "aa" and [d.det_score for d in row.det] == [0.75]


def test_callbacks_on_a_stream_and_saving_on_iterators(spark, tmp_path):
    files, out, seen = tmp_path / "in", str(tmp_path / "out"), tmp_path / "seen"
    files.mkdir(), seen.mkdir()
    save(files, one=picture((20, 20, RED)), two=picture((20, 20, GREEN)))
    own = engine(spark)
    said = lambda page: (seen / page.text_blocks).touch()
    batches = []
    assert own.stream(str(files), str(tmp_path / "state"), lambda pages, n: batches.append(pages.count()), callback=said).awaitTermination(120)
    assert sorted(os.listdir(seen)) == ["aa", "bb"] and sum(batches) == 2
    assert sorted(r.text_blocks for r in own.foreach_parallel(str(files), save_dir=f"file://{out}")) == ["aa", "bb"]
    assert sorted(os.listdir(out)) == ["res_one.png", "res_two.png"]


def test_a_box_without_area_covers_its_own_pixels_only():
    prob = np.arange(16.0).reshape(4, 4)
    assert pixels.score_fast(prob, np.array([[1.6, 1.6]] * 4)) == prob[2, 2]
    assert pixels.score_fast(prob, np.array([[0.6, 1], [1.6, 1], [1.6, 1], [0.6, 1]])) == prob[1, 1:3].mean()
