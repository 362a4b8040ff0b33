"""Scans of image files and their checks, and what is written of results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import IMAGE_EXTENSIONS, is_image

IMAGE = T.StructType([
    T.StructField("image_idx", T.LongType()), T.StructField("image_path", T.StringType()), T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()), T.StructField("n_channels", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType()),
])


def glob_of(extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> str:
    """A file pattern that finds the extensions in either case; it acts before anything is read."""
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" for c in e[1:])
    return "*.{" + ",".join(map(either, extensions)) + "}"


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the image files below a folder; column pruning leaves contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob_of()).load(folder)


def _decoded(images: DataFrame) -> DataFrame:
    """Rows of the built-in image source as IMAGE without an index; files that can't be decoded have an error."""
    ok = F.col("image.height") > 0
    bad = F.when(~ok, "the file is no image that can be decoded").when(~F.col("image.nChannels").isin(1, 3, 4), "only images of one, three or four channels are read")
    part = lambda c: F.when(bad.isNull(), F.col(f"image.{c}"))
    return images.select(F.col("image.origin").alias("image_path"), part("height").alias("height"), part("width").alias("width"), part("nChannels").alias("n_channels"), part("data").alias("data"), bad.alias("error"))


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """IMAGE rows of a folder, read and decoded on the executors; the index is a hash of the path."""
    files = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", glob_of()).load(folder)
    return _decoded(files).select(F.xxhash64("image_path").alias("image_idx"), "*")


def stream_images(spark: SparkSession, folder: str, files_per_batch: int = 30) -> DataFrame:
    """A stream of IMAGE rows of the files that come to a folder."""
    files = spark.readStream.format("image").schema(_IMAGE_SOURCE).option("recursiveFileLookup", "true").option("pathGlobFilter", glob_of()).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return _decoded(files).select(F.xxhash64("image_path").alias("image_idx"), "*")


_IMAGE_SOURCE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def list_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """IMAGE rows of the images among the paths; the index is the place in the list.

    A path that is there twice gives two rows, one that isn't there a row with an error. The list is the
    caller's, so it fits the driver."""
    kept = [(i, p) for i, p in enumerate(paths) if os.path.splitext(p)[1].lower() in IMAGE_EXTENSIONS]
    if not kept:
        raise ValueError("the list has no image")
    whole = {p: _qualified(spark, p) for _, p in kept}
    there = sorted({q for q, exists in whole.values() if exists})
    wanted = spark.createDataFrame([(i, p, whole[p][0]) for i, p in kept], "image_idx long, given string, place string").withColumn("place", _plain("place"))
    files = _decoded(spark.read.format("image").load(there)) if there else spark.createDataFrame([], IMAGE).drop("image_idx")
    found = wanted.join(files.withColumn("place", _plain("image_path")), "place", "left")
    return found.select("image_idx", F.col("given").alias("image_path"), "height", "width", "n_channels", "data", F.when(F.col("image_path").isNull(), "the file isn't there").otherwise(F.col("error")).alias("error"))


def _qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """A path with its file system, and whether there is a file."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if "://" in path else "file://" + os.path.abspath(path))
    system = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(found).toString(), system.exists(found)


def _plain(path: str):
    """A path with one slash after its scheme, as names of one file may have one or more."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def memory_images(spark: SparkSession, images: list) -> DataFrame:
    """IMAGE rows of uint8 arrays (height, width), or (height, width, channels) with 1, 3 or 4 of them."""
    rows = [(i, f"memory:{i}", x.shape[0], x.shape[1], x.shape[2] if x.ndim > 2 else 1, bytearray(x.tobytes()), None if x.ndim == 2 or x.ndim == 3 and x.shape[2] in (1, 3, 4) else "only images of one, three or four channels are read") for i, x in enumerate(images)]
    return spark.createDataFrame(rows, IMAGE)


def filter_images(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path has an image's extension."""
    return paths.where(is_image(path))


def check_image(path: str) -> str:
    """The path, if it is that of a local image file; else an error."""
    if not path:
        raise ValueError("no path is given")
    if os.path.splitext(path)[1].lower() not in IMAGE_EXTENSIONS:
        raise ValueError(f"{path} is no image file")
    if "://" not in path and not os.path.isfile(path):
        raise FileNotFoundError(path)
    return path


def check_folder(spark: SparkSession, folder: str) -> str:
    """The folder, if there is an image below it; else an error."""
    if not folder:
        raise ValueError("no folder is given")
    if "://" not in folder and not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    if not scan_files(spark, folder).select("path").take(1):
        raise ValueError(f"{folder} has no image")
    return folder
