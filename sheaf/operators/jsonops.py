"""JSON validation, re-formatting and quarantine."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sheaf.functions import jsontext
from sheaf.functions.text import col, is_blank

SCHEMA = (
    "ok boolean, root_type string, output string, message string, position bigint, line bigint, `column` bigint"
)
BLANK_MESSAGE = "blank input"


def json_column(text: Column | str, operation: str = "minify") -> Column:
    """STRUCT of outcome, root type, text and error place; blank input never reaches Python."""
    if operation not in ("minify", "format"):
        raise ValueError(operation)
    indent = 2 if operation == "format" else None

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        return jsontext.process(texts, indent)

    t = col(text)
    return run(F.when(~is_blank(t), t))


def json_process(df: DataFrame, text: str, operation: str = "minify") -> DataFrame:
    """Input columns plus ok, root_type, output, message, position, line, column."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\A\x{feff}", "")
    d = df.withColumn("__t", t).withColumn("__j", json_column("__t", operation))
    j = F.col("__j")
    return d.select(
        *df.columns, F.coalesce(j["ok"], F.lit(False)).alias("ok"), j["root_type"].alias("root_type"),
        j["output"].alias("output"),
        F.when(j["ok"].isNull(), F.lit(BLANK_MESSAGE)).otherwise(j["message"]).alias("message"),
        j["position"].alias("position"), j["line"].alias("line"), j["column"].alias("column"),
    )


def quarantine(processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of a processed table."""
    return (
        processed.filter("ok").drop("message", "position", "line", "column"),
        processed.filter("NOT ok").drop("output", "root_type"),
    )


def json_profile(processed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return processed.groupBy(*by, "ok", F.coalesce("root_type", F.lit("none")).alias("root_type")).agg(
        F.count("*").alias("n")
    )


def latest_response(df: DataFrame, key: str, generation: Sequence[str]) -> DataFrame:
    """Only the newest row of every key; a combinable aggregate, so a hot key shrinks map-side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*generation)).alias("r")).select(key, "r.*")
