"""What becomes of pages: ordered rows, callbacks, annotated images, text reports."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import pixels


def collected(pages: DataFrame, order: str = "image_idx") -> list[Row]:
    """Pages in order; for the driver's use, so only of what fits there."""
    return pages.orderBy(order).collect()


def each(pages: DataFrame) -> Iterator[Row]:
    """Pages by partition, the next one fetched meanwhile. The networks run in the stage before, on all partitions at once."""
    return pages.toLocalIterator(prefetchPartitions=True)


def call(pages: DataFrame, function: Callable[[Row], None]) -> None:
    """The function is called on an executor with each page; its errors end the job."""
    pages.foreach(function)


def report(pages: DataFrame) -> DataFrame:
    """(image_path, report): a line of text about each page."""
    total = F.expr("det_ms + cls_ms + rec_ms")
    return pages.select("image_path", F.format_string("%s: %d boxes, %d ms (detect %d, classify %d, recognise %d)%s", "image_path", F.size("det"), total, "det_ms", "cls_ms", "rec_ms", F.concat(F.lit("\n"), F.coalesce("error", "text_blocks"))).alias("report"))


def annotated(images: DataFrame, pages: DataFrame, text_score: float = 0.5) -> DataFrame:
    """(image_path, name, content): each page beside a panel of its boxes, as a PNG file's bytes."""
    boxes = pages.select(F.col("image_idx").alias("i"), F.col("image_path").alias("p"), F.expr("transform(det, d -> named_struct('box', d.box_page, 'score', d.det_score))").alias("boxes"))
    both = images.where("data is not null").join(boxes, (F.col("image_idx") == F.col("i")) & (F.col("image_path") == F.col("p")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                image = pixels.colour(row.data, row.height, row.width)
                found = [(np.array([[q["x"], q["y"]] for q in b["box"]], float), b["score"]) for b in row.boxes]
                name = "res_" + os.path.splitext(os.path.basename(row.image_path))[0] + ".png"
                yield pd.DataFrame([(row.image_path, name, pixels.png(pixels.draw(image, found, text_score)))], columns=["image_path", "name", "content"])

    return both.select("image_path", "height", "width", "data", "boxes").mapInPandas(run, "image_path string, name string, content binary")


def save_annotated(drawn: DataFrame, folder: str) -> None:
    """Writes annotated images into a folder that all executors reach, replacing files of that name.

    The folder is a path or an address that Arrow's file systems know, such as file, hdfs, s3 or gs."""
    place = folder if "://" in folder else os.path.abspath(folder)
    system, base = FileSystem.from_uri(place)
    system.create_dir(base, recursive=True)

    def write(rows: Iterator[Row]) -> None:
        system, base = FileSystem.from_uri(place)
        for row in rows:
            part = f"{base}/{row.name}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as f:
                f.write(bytes(row.content))
            system.move(part, f"{base}/{row.name}")  # a task that runs again leaves the same file

    drawn.foreachPartition(write)
