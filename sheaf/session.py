"""Session settings for local runs and staged intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sheaf")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a fresh one only for local runs."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    folder = folder or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table once and read it back.

    Later steps read columns of a finished table instead of recomputing its plan, and a lost
    executor costs a re-read, not the lineage."""
    return _written(df, f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """Staged tables that one computation owns: they go when it leaves, or earlier with ``drop``.

    What outlives the computation must have been written (by ``stage``) before it ends."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> "Stages":
        return self

    def stage(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
        out = _written(df, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables whose last reader is done; others than staged ones are left alone."""
        for table in tables:
            if found := self.paths.pop(id(table), None):
                context = found[0].sparkSession.sparkContext
                folder = context._jvm.org.apache.hadoop.fs.Path(found[1])
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)

    def __exit__(self, *_) -> None:
        self.drop(*[table for table, _ in list(self.paths.values())])
