"""The engine: images in, a row of text, boxes and confidences for each page out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators import stages
from ..sources import images as sources
from ..sources import sinks
from ..sources.models import Scorers
from ..streaming import pages as streaming


class Engine:
    """Plans of the stages over images.

    Without an orientation model its stage isn't in the plan. Methods with ``seq`` give a model one
    line at a time; the others give it batches of a page's lines, which are padded to the widest."""

    def __init__(self, spark: SparkSession, scorers: Scorers, alphabet: list[str], config: Config | None = None):
        self.spark, self.scorers, self.alphabet, self.config = spark, scorers, alphabet, config or Config()

    def lines(self, images: DataFrame, batch_num: int | None = None) -> DataFrame:
        """A row for each line of the images, or one without a line."""
        crops = stages.detect(images, self.config, self.scorers)
        turned = stages.classify(crops, self.config, self.scorers, batch_num)
        return stages.decoded(stages.recognise(turned, self.config, self.scorers, batch_num), self.alphabet)

    def pages(self, images: DataFrame, batch_num: int | None = None) -> DataFrame:
        """A row for each image."""
        return stages.assembled(self.lines(images, batch_num), self.config)

    def images(self, source: str | list[str] | np.ndarray | DataFrame) -> DataFrame:
        """Images of a folder, a list of paths, an array, or as they are."""
        if isinstance(source, DataFrame):
            return source
        if isinstance(source, np.ndarray):
            return sources.memory_images(self.spark, [source])
        if isinstance(source, list):
            return sources.list_images(self.spark, source)
        return sources.scan_images(self.spark, sources.check_folder(self.spark, source))

    def recognize(self, image: str | np.ndarray, save_dir: str | None = None, batch_num: int | None = None) -> Row:
        """One image; lines go to the models in batches."""
        images = self.images([sources.check_image(image)] if isinstance(image, str) else image)
        return self.batch(images, save_dir, batch_num=batch_num)[0]

    def recognize_seq(self, image: str | np.ndarray, save_dir: str | None = None) -> Row:
        """One image; lines go to the models one by one."""
        return self.recognize(image, save_dir, batch_num=1)

    def batch(self, source, save_dir: str | None = None, callback: Callable[[Row], None] | None = None, batch_num: int | None = 1) -> list[Row]:
        """All images, in the order of the input, a folder's by path; the callback runs on executors."""
        images = self.images(source)
        pages = self.pages(images, batch_num)
        if save_dir or callback:
            pages = pages.cache()
        try:
            if callback:
                sinks.call(pages, callback)
            if save_dir:
                sinks.save_annotated(sinks.annotated(images, pages, self.config.recognizer.text_score), save_dir)
            return sinks.collected(pages, "image_path" if isinstance(source, str) else "image_idx")
        finally:
            pages.unpersist()

    def batch_parallel(self, source, save_dir: str | None = None, callback: Callable[[Row], None] | None = None) -> list[Row]:
        """As ``batch``, with lines in batches."""
        return self.batch(source, save_dir, callback, batch_num=None)

    def foreach(self, source, batch_num: int | None = 1, save_dir: str | None = None) -> Iterator[Row]:
        """Pages one after the other, none of them kept at the driver; annotated images are written before."""
        images = self.images(source)
        pages = self.pages(images, batch_num)
        return self._saved(images, pages, save_dir) if save_dir else sinks.each(pages)

    def _saved(self, images: DataFrame, pages: DataFrame, save_dir: str) -> Iterator[Row]:
        pages = pages.cache()
        try:
            sinks.save_annotated(sinks.annotated(images, pages, self.config.recognizer.text_score), save_dir)
            yield from sinks.each(pages)
        finally:
            pages.unpersist()

    def foreach_parallel(self, source, save_dir: str | None = None) -> Iterator[Row]:
        """As ``foreach``, with lines in batches."""
        return self.foreach(source, batch_num=None, save_dir=save_dir)

    def stream(self, folder: str, checkpoint: str, function: Callable[[DataFrame, int], None] | None = None, batch_num: int | None = None, available_now: bool = True, callback: Callable[[Row], None] | None = None) -> StreamingQuery:
        """A streaming query over the files that come to a folder.

        The function gets each batch's pages, at the driver; the callback each page, on an executor."""
        files = sources.stream_images(self.spark, folder, self.config.batch_pool_size)

        def done(pages: DataFrame, number: int) -> None:
            if callback and function:
                pages = pages.cache()
            try:
                if callback:
                    sinks.call(pages, callback)
                if function:
                    function(pages, number)
            finally:
                pages.unpersist()

        return streaming.run(files, lambda images: self.pages(images, batch_num), checkpoint, done, available_now)
