"""Media, text and JSON files: admission checks with reject reasons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


# Fixed limits.
MAX_IMAGE_BYTES = 20 * 1024 * 1024
MAX_SIDE = 16_384
MAX_PIXELS = 64_000_000
MAX_DOCUMENT_BYTES = 100 * 1024 * 1024
MAX_TEXT_BYTES, MAX_TEXT_CHARACTERS = 10 * 1024 * 1024, 500_000
MAX_JSON_BYTES, MAX_JSON_CHARACTERS = 20 * 1024 * 1024, 20_000_000


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length) of the files under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", "length")


def _jpeg_size(content: bytes) -> tuple[int, int] | None:
    """Frame size by walking the segment markers."""
    at, n = 2, len(content)
    while at + 9 < n:
        if content[at] != 0xFF:
            return None
        marker = content[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD9 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7: at + 9]), int.from_bytes(content[at + 5: at + 7])
        at += 2 + int.from_bytes(content[at + 2: at + 4])
    return None


def _jpeg(content: pd.Series) -> pd.DataFrame:
    sizes = [(None if c is None else _jpeg_size(c)) or (None, None) for c in content]
    return pd.DataFrame(sizes, columns=["w", "h"]).astype("Int32")


def scan_media(files: DataFrame) -> DataFrame:
    """path, length, claimed, detected, width, height, reason (``ok`` or why the file is refused)."""
    h = lambda start, n: F.hex(F.substring("content", start, n))
    number = lambda start, n: F.conv(h(start, n), 16, 10).cast("bigint")
    little = lambda start: (F.conv(F.concat(h(start + 1, 1), h(start, 1)), 16, 10).cast("bigint"))
    little3 = lambda start: F.conv(F.concat(h(start + 2, 1), h(start + 1, 1), h(start, 1)), 16, 10).cast("bigint")
    header = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    detected = (
        F.when(h(1, 8) == "89504E470D0A1A0A", "png").when(h(1, 3) == "FFD8FF", "jpeg")
        .when((h(1, 4) == "52494646") & (h(9, 4) == "57454250"), "webp").when(F.instr(header, "%PDF-") > 0, "pdf")
    )
    name = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    claimed = F.when(name.isin("jpg", "jpeg"), "jpeg").when(name.isin("png", "webp", "pdf"), name)
    d = files.withColumns({"detected": detected, "claimed": claimed})
    # Only JPEG headers need a walk; other contents are not sent to Python.
    d = d.withColumn("j", F.pandas_udf(_jpeg, "struct<w:int,h:int>")(F.when(F.col("detected") == "jpeg", F.col("content"))))
    chunk = F.decode(F.substring("content", 13, 4), "ISO-8859-1")
    mask = lambda c: F.col(c).bitwiseAND(F.lit(16383)) if isinstance(c, str) else c.bitwiseAND(F.lit(16383))
    lossless = F.conv(F.concat(h(25, 1), h(24, 1), h(23, 1), h(22, 1)), 16, 10).cast("bigint")
    size = lambda png, vp8, vp8l, vp8x, j: (
        F.when(F.col("detected") == "png", png).when(F.col("detected") == "jpeg", F.col("j")[j].cast("bigint"))
        .when(chunk == "VP8 ", vp8).when(chunk == "VP8L", vp8l).when(chunk == "VP8X", vp8x))
    image = F.col("detected").isin("png", "jpeg", "webp")
    d = d.withColumns({
        "width": F.when(image, size(number(17, 4), mask(little(27)), mask(lossless) + 1, little3(25) + 1, "w")),
        "height": F.when(image, size(number(21, 4), mask(little(29)), mask(F.shiftright(lossless, 14)) + 1, little3(28) + 1, "h")),
    })
    reason = (
        F.when(F.col("length") == 0, "empty-file").when(F.col("claimed").isNull() & F.col("detected").isNull(), "unsupported-type")
        .when(F.col("detected").isNull() | (F.coalesce("claimed", "detected") != F.col("detected")), "type-mismatch")
        .when(F.col("length") > F.when(F.col("detected") == "pdf", MAX_DOCUMENT_BYTES).otherwise(MAX_IMAGE_BYTES), "file-too-large")
        .when(image & (F.col("width").isNull() | (F.col("width") < 1) | (F.col("height") < 1)), "unreadable-dimensions")
        .when(image & ((F.greatest("width", "height") > MAX_SIDE) | (F.col("width") * F.col("height") > MAX_PIXELS)), "dimensions-too-large")
        .otherwise("ok")
    )
    return d.select("path", "length", "claimed", "detected", "width", "height", reason.alias("reason"))


def media_audit(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("reason", F.coalesce("detected", F.lit("none")).alias("detected")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("bytes"))


def _over(size: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else F.coalesce(size > limit, F.lit(False))


def admit_texts(files: DataFrame, max_bytes: int | None = None, max_characters: int | None = None) -> DataFrame:
    """path, text, truncated, reason. Whole texts, unless limits are given: then files over ``max_bytes`` are refused
    and longer texts keep ``max_characters``."""
    over, long = _over(F.col("bytes"), max_bytes), _over(F.length("text"), max_characters)
    text = F.col("text") if max_characters is None else F.left("text", F.lit(max_characters))
    return files.select(
        "path", F.when(~over, text).alias("text"), (~over & long).alias("truncated"), F.when(over, "file-too-large").otherwise("ok").alias("reason"))


def read_text_corpus(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    return admit_texts(_files(spark, path), **limits)


def admit_json(files: DataFrame, max_bytes: int | None = None, max_characters: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) by extension, and by size where a limit is given."""
    reason = (
        F.when(~F.lower("path").endswith(".json"), "wrong-extension").when(_over(F.col("bytes"), max_bytes), "file-too-large")
        .when(_over(F.length("text"), max_characters), "content-too-large"))
    d = files.withColumn("reason", reason)
    return d.filter("reason IS NULL").drop("reason"), d.filter("reason IS NOT NULL").select("path", "bytes", "reason")


def read_json_documents(spark: SparkSession, path: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    return admit_json(_files(spark, path), **limits)


