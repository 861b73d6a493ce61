"""Exact copies by a content sort: equal texts become neighbours and are compared in full."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sheaf.llm.common import without_spaces
from sheaf.session import stage

#: Characters of a normalised text in a splitter.
SPLITTER = 32
PLACE = [T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("head", T.BooleanType()),
         T.StructField("sha", T.StringType())]


def content_runs(df: DataFrame, text: str, doc_id: str, keep: list[str]) -> DataFrame:
    """Rows in content order with the run of equal normalised texts each belongs to.

    Sampled splitters cut (front of the normalised text, its hash, code points descending, id) into ranges, so a
    text with very many copies spreads over as many tasks as its rows need, and splitters stay short however long the
    texts. Tasks sort externally, by the whole text behind front and hash, and compare each row with the one before
    in full. Columns: ``row`` (a struct of ``keep``), cps, id, part, run, head (first of its run), sha.

    Of a run, the head has the most code points and then the smallest id, nulls last."""
    raw = df.select(F.struct(*keep).alias("row"), F.col(text).alias("text"), F.col(doc_id).alias("id"))
    if text in keep:
        raw = raw.select("row", F.col("row")[text].alias("text"), "id")
    norm, cps = without_spaces(F.col("text")).alias("norm"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("cps")

    def spread(rows: DataFrame, content: Column, points: Column) -> DataFrame:
        return rows.repartitionByRange(F.substring(content, 1, SPLITTER), F.xxhash64(content), points.desc(), F.col("id").asc_nulls_last())

    if text in keep:  # the row holds the text, so its normalised form is made anew behind the exchange
        inner = F.col("row")[text]
        dealt = spread(raw.select("row", "id"), without_spaces(inner), F.coalesce(F.length(inner), F.lit(0)))
        dealt = dealt.select("row", "id", inner.alias("text")).select("row", "id", norm, cps)
    else:
        dealt = spread(raw.select("row", "id", norm, cps), F.col("norm"), F.col("cps"))
    dealt = dealt.select("*", F.substring("norm", 1, SPLITTER).alias("front"), F.xxhash64("norm").alias("hash"))
    order = ("front", "hash", "norm", F.col("cps").desc(), F.col("id").asc_nulls_last())
    sorted_rows = dealt.sortWithinPartitions(*order).select("row", "cps", "id", "norm")
    schema = T.StructType([*sorted_rows.drop("norm").schema.fields, *PLACE])

    def run(batches):
        part, at, last, sha = TaskContext.get().partitionId(), -1, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            norms = batch.column(batch.num_columns - 1)
            heads = np.ones(n, bool)
            heads[1:] = pc.not_equal(norms.slice(1), norms.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            heads[0] = last is None or norms[0].as_py() != last
            runs = at + np.cumsum(heads)
            shas = [sha] + [hashlib.sha256(norms[int(i)].as_py().encode()).hexdigest() for i in np.flatnonzero(heads)]
            named = pa.array(shas, pa.string()).take(pa.array(np.cumsum(heads)))
            at, last, sha = int(runs[-1]), norms[n - 1].as_py(), shas[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.full(n, part, np.int32)), pa.array(runs.astype(np.int64)), pa.array(heads), named],
                names=schema.names)

    return sorted_rows.mapInArrow(run, schema)


def exact_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Null text counts as empty. Of repeated rows exactly one is kept. A null id is kept only if no other id has as
    many code points. Runs of one text that lie on both sides of a range border are joined by their digest, one row
    per run. An empty table gives an empty result; other columns are not read."""
    rows = stage(content_runs(df, text, doc_id, [doc_id]).drop("row"))
    best = F.min(F.struct((-F.col("cps")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    runs = rows.groupBy("part", "run", "sha").agg(best.alias("best"), F.count("*").alias("n"))
    groups = runs.groupBy("sha").agg(F.min(F.struct("best", "part", "run")).alias("owner"), F.sum("n").alias("group_size"))
    placed = runs.select("part", "run", "sha").join(groups, "sha").select(
        "part", "run", "group_size", F.col("owner.best.id").alias("keep_id"),
        ((F.col("owner.part") == F.col("part")) & (F.col("owner.run") == F.col("run"))).alias("owns"))
    return rows.join(placed, ["part", "run"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("owns") & F.col("head")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without copies: of equal texts the one with the most code points, then the smallest id.

    All columns stay as they are. Only the first run of a range can continue the range before it, so at most one
    digest per range is looked up among the other heads."""
    heads = stage(content_runs(df, text, doc_id, df.columns).where("head").select("row", "part", "run", "sha"))
    borders = heads.where("run = 0").select("sha").distinct()  # one row per range at most
    owners = (heads.select("sha", "part").join(F.broadcast(borders), "sha", "left_semi")
              .groupBy("sha").agg(F.min("part").alias("owner")))
    return (heads.join(F.broadcast(owners), "sha", "left").where("owner IS NULL OR owner = part").select("row.*"))
