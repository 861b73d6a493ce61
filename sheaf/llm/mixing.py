"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheaf.llm.common import row_key, word_count
from sheaf.session import stage

BLOCK_ROWS = 8192


def targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, passes: int = 2) -> DataFrame:
    """(source, source_size, target): what each source gives to a mix of ``share`` times all sizes.

    Sources in code point order, null last, take the weights in turn. No target exceeds ``passes`` times its
    source; what that cuts off goes to the others by weight, until none is above. With the sources ordered by the
    level at which they fill up, that level is found in one pass over the table of sources (one row each)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("full_at", F.col("source_size") * float(passes) / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum(F.col("source_size") * passes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({
        "below": below, "open_w": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "budget": F.sum("source_size").over(Window.partitionBy()) * float(share),
    })
    per = per.withColumn("level", (F.col("budget") - F.col("below")) / F.col("open_w"))
    reached = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())["level"]
    per = per.withColumn("reached", reached)
    full = F.col("source_size") * float(passes)
    target = F.when(F.col("reached").isNull(), full).otherwise(F.least(full, F.col("reached") * F.col("w")))
    return per.select("source", "source_size", target.alias("target"))


def sized_rows(df: DataFrame, text: str, source: str, doc_id: str, *keep: Column) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *keep)


def mix(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, passes: int = 2, seed: str = "mix") -> DataFrame:
    """``sized`` (doc_id, source, size, …) with source_size, target and ``services``, one entry per pass.

    Documents of a source queue in an order shuffled by a hash of id and seed, ``passes`` times over. A service
    starts and ends at virtual times: the words queued before it, and with it, divided by the target. All queues
    drain together, so at virtual time 1 the words served make up the whole budget; there the mix ends. ``taken``
    of a service is what is served by then: all of it, nothing, or for one document of each source a part.

    The words queued before a document come from blocks of the hash range: a window inside (source, block) and one
    row per block for what precedes it, so no source is queued in one task. ``sized`` should be a written table."""
    keys = [c for c in sized.columns]
    blocks = max(1, math.ceil(sized.count() / BLOCK_ROWS))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    block = F.floor(F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / 2.0**32 * blocks).cast("bigint")
    d = sized.select(*keys, draw.alias("__draw")).withColumn("__block", block)
    inside = Window.partitionBy("source", "__block").orderBy("__draw", F.col("doc_id").asc_nulls_last(), "size")
    d = d.withColumn("__own", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    prior = Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy("source", "__block").agg(F.sum("size").alias("n")).select(
        F.col("source").alias("s"), F.col("__block").alias("b"), F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("__carry"))
    plan = carry.join(targets(sized, weights, share, passes).withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2")))
    d = d.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("__block") == F.col("b")))
    before, cut = F.col("__own") + F.col("__carry"), F.floor(F.col("target") + 0.5).cast("bigint")

    def service(k: int) -> Column:
        start = before + F.lit(k) * F.col("source_size")
        return F.struct(
            F.lit(k).alias("pass"), F.try_divide(start.cast("double"), "target").alias("starts"),
            F.try_divide((start + F.col("size")).cast("double"), "target").alias("ends"),
            F.greatest(F.lit(0), F.least(F.col("size"), cut - start)).cast("bigint").alias("taken"))

    return d.select(*keys, "source_size", "target", F.array(*[service(k) for k in range(passes)]).alias("services"))


def schedule(mixed: DataFrame) -> DataFrame:
    """The mix in the order in which its parts are served: one row per service that is taken, range-sorted by virtual
    finish time, with ``pass``, ``ends`` and ``taken``. The first row of the last partition but one precedes it, and so on."""
    rest = [c for c in mixed.columns if c != "services"]
    served = mixed.select(*rest, F.explode("services").alias("s")).where("s.taken > 0").select(*rest, "s.pass", "s.ends", "s.taken")
    order = (F.col("ends"), F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last())
    return served.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_sizes(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """doc_id, size, source, source_size, target and taken of every row, in order of first virtual finish time.

    A null text has size 0 and gives nothing; the null source is a source of its own; null ids share one draw and
    follow each other; repeated rows are documents of their own. Empty table: empty result. Other columns aren't read."""
    sized = stage(sized_rows(df, text, source, doc_id))
    d = mix(sized, **how).withColumn("taken", F.aggregate("services", F.lit(0).cast("bigint"), lambda a, s: a + s["taken"]))
    order = (F.element_at("services", 1)["ends"].asc_nulls_last(), F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last())
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    return d.select("doc_id", "size", "source", "source_size", "target", "taken")


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """The mix as rows of ``df``: every document as often as at least half of it is served, wholes only.

    Documents without words cost nothing and stay once. Rows equal in id, source and text are one document, given
    as often as all of them are served. All columns stay as they are; nulls as in ``mixed_sizes``."""
    key = row_key(F.col(doc_id), F.col(source), F.col(text))
    sized = stage(sized_rows(df, text, source, doc_id, key.alias("key")))
    times = F.when(F.col("size") == 0, 1).otherwise(F.size(F.filter("services", lambda s: s["taken"] * 2 >= F.col("size"))))
    copies = mix(sized, **how).groupBy("key").agg(F.sum(times).alias("__n")).where("__n > 0")
    packed = df.select(F.struct("*").alias("__row"), key.alias("key")).dropDuplicates(["key"])
    return packed.join(copies, "key").select("__row", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select("__row.*")
