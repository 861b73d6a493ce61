"""Text that is drawn but not seen: covered, off the page, hidden.

``words(doc_id, page, word_no, x, y, width, height, hidden)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAGE = ["doc_id", "page"]
GRID_POINTS = 64.0


def covered_text(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page, covered): visible words inside opaque black boxes drawn after the first text.

    ``boxes(doc_id, page, x0, y0, x1, y1, fill, after_text)``. Words and boxes meet on grid squares, so
    only neighbours are ever paired."""
    cell = lambda c: F.floor(c / GRID_POINTS).cast("bigint")
    b = boxes.filter("after_text AND lower(fill) = '#000000' AND x1 - x0 >= 8 AND y1 - y0 >= 5")
    b = b.withColumn("gx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1")))))
    b = b.withColumn("gy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    w = words.filter("NOT hidden").select(
        *PAGE, (F.col("x") + F.col("width") * 0.25).alias("wl"), (F.col("x") + F.col("width") * 0.75).alias("wr"),
        (F.col("y") - F.col("height") * 0.1).alias("wb"), (F.col("y") + F.col("height") * 0.75).alias("wt"))
    w = w.withColumn("gx", cell(F.col("wl"))).withColumn("gy", cell(F.col("wb")))
    inside = (
        (F.col("wl") >= F.col("x0")) & (F.col("wr") <= F.col("x1")) & (F.col("wb") >= F.col("y0")) & (F.col("wt") <= F.col("y1")))
    return w.join(b, [*PAGE, "gx", "gy"]).filter(inside).groupBy(*PAGE).agg(F.count("*").alias("covered"))


def _off(words: DataFrame, pages: DataFrame, *more: str) -> DataFrame:
    """Words with ``off`` and ``more`` of their page. Pages are one row each, so words are shuffled by page, not sorted."""
    d = words.join(pages.select(*PAGE, F.col("width").alias("pw"), F.col("height").alias("ph"), *more).hint("shuffle_hash"), PAGE)
    outside = (F.col("x") < -5) | (F.col("y") < -5) | (F.col("x") > F.col("pw") + 5) | (F.col("y") > F.col("ph") + 5)
    return d.withColumn("off", outside)


def offpage_text(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, items) with text more than 5 points outside the page."""
    return _off(words, pages).filter("off").groupBy(*PAGE).agg(F.count("*").alias("items"))


def hidden_text_class(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, hidden, images, classification); ``pages`` carry their image count."""
    d = _off(words, pages, "images").groupBy(*PAGE, "images").agg(
        F.count("*").alias("total"), F.sum((F.col("hidden") & ~F.col("off")).cast("bigint")).alias("hidden")).filter("hidden > 0")
    layer = (F.col("images") > 0) & (F.col("hidden") >= 12) & (F.col("hidden") >= F.col("total") * 0.75)
    kind = F.when(layer, "search layer").when(F.col("images") > 0, "uncertain").otherwise("suspicious hidden text")
    return d.select(*PAGE, "hidden", "images", kind.alias("classification"))
