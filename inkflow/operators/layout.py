"""Order of boxes and lines, joins of a page's parts, and per-page aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINE_GAP = 10.0


def reading_order(boxes: DataFrame, image: str, x: str, y: str, ties: list[str], gap: float = LINE_GAP) -> DataFrame:
    """Adds line_id and position (both from 0). A box opens a line if its y is at least ``gap`` below
    the box before it by y, so slow drift stays in one line; lines are read by x. ``ties`` makes the
    order total. All three windows share one shuffle by image."""
    by_y = Window.partitionBy(image).orderBy(y, x, *ties)
    opens = F.when(F.col(y) - F.lag(y).over(by_y) >= gap, 1).otherwise(0)
    lined = boxes.withColumn("line_id", opens).withColumn("line_id", F.sum("line_id").over(by_y.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return lined.withColumn("position", (F.row_number().over(Window.partitionBy(image).orderBy("line_id", x, y, *ties)) - 1).cast("long"))


def adjust_overlap(boxes: DataFrame, line: list[str], order: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """Neighbours that overlap each give up half of it; every step tests edges that no other step moves."""
    w = Window.partitionBy(*line).orderBy(*order)
    after, before = F.col(right) - F.lead(left).over(w), F.lag(right).over(w) - F.col(left)
    half = lambda d: F.when(d > 0, d / 2).otherwise(F.lit(0.0))
    return boxes.withColumn("_after", half(after)).withColumn("_before", half(before)).withColumn(right, F.col(right) - F.col("_after")).withColumn(left, F.col(left) + F.col("_before")).drop("_after", "_before")


def text_blocks(lines: DataFrame, image: str, order: str, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(image, text_blocks): labels of a page in order, joined by spaces; scores must exceed the threshold.

    A page without such a line has an empty text."""
    kept = F.when(F.col(score) > threshold, F.struct(F.col(order), F.col(label)))
    return lines.groupBy(image).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s[label]), " ").alias("text_blocks"))


def with_recognitions(boxes: DataFrame, lines: DataFrame, keys: list[str], optional: bool = False) -> DataFrame:
    """Boxes with what was read of them; ``optional`` keeps boxes of which nothing was."""
    return boxes.join(lines, keys, "left" if optional else "inner")


def batches(crops: DataFrame, order: str, size: int = 6) -> DataFrame:
    """Adds batch_no: ``size`` crops of a page by their order go to a model together."""
    return crops.withColumn("batch_no", F.floor(F.col(order) / size).cast("long"))


def batch_ratio(crops: DataFrame, keys: list[str], ratio: str, least: float = 320 / 48) -> DataFrame:
    """Adds max_wh_ratio: the greatest ratio of a batch, which sets the width it is padded to."""
    most = F.max(ratio).over(Window.partitionBy(*keys))
    return crops.withColumn("max_wh_ratio", F.greatest(most.cast("float"), F.lit(least).cast("float")))


def stage_times(rows: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """Total and number of steps by key."""
    return rows.groupBy(*keys).agg(F.sum(ms).alias("total"), F.count("*").alias("steps"))


def first_candidates(contours: DataFrame, image: str, order: list[str], most: int = 1000) -> DataFrame:
    """At most ``most`` contours of each page, the first ones."""
    return contours.withColumn("_n", F.row_number().over(Window.partitionBy(image).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def largest(polygons: DataFrame, keys: list[str], area: str, ties: list[str]) -> DataFrame:
    """The polygon of the greatest area of each key."""
    return polygons.groupBy(*keys).agg(F.max(F.struct(F.col(area), *ties)).alias("_top")).select(*keys, "_top.*")
