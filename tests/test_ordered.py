"""Blocked running values equal plain windows, whatever the block size and partition count."""

from pyspark.sql import Window, functions as F

from sheaf.functions import ordered


def _rows(spark):
    return spark.range(400).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("o"), ((F.col("id") * 37) % 11).alias("v")
    ).filter("k <> 2 OR o < 30")


def test_running(spark):
    w = Window.partitionBy("k").orderBy("o")
    d = _rows(spark)
    for inclusive in (True, False):
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = d.select("k", "o", F.coalesce(F.sum("v").over(frame), F.lit(0)).alias("s"), F.max("v").over(frame).alias("m"))
        got = ordered.running(d, ["k"], ["o"], {"s": F.col("v")}, {"m": F.col("v")}, block=ordered.block_of("o", 7), inclusive=inclusive)
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.select("k", "o", "s", "m").collect())) if inclusive else (
            sorted(map(str, want.collect())) == sorted(map(str, got.select("k", "o", "s", "m").collect())))


def test_previous_and_islands(spark):
    d = _rows(spark)
    w = Window.partitionBy("k").orderBy("o")
    flag = F.when(F.lag("v").over(w).isNull() | (F.col("v") < F.lag("v").over(w)), 1).otherwise(0)
    want = d.withColumn("f", flag).select("k", "o", F.lag("v").over(w).alias("p"), F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("i"))
    for size in (1, 5, 1000):
        got = ordered.with_previous(d, ["k"], ["o"], ["v"], block=ordered.block_of("o", size), starts=lambda c, p: c("v") < p("v"))
        got = got.select("k", "o", F.col("prev.v").alias("p"), F.col("island").alias("i"))
        assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))
