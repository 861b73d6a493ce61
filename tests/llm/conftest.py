import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for clash in ("fp", "run", "row", "key", "size", "target", "part", "taken", "component", "score", "id", "source_size", "__key"):
            df = df.selectExpr("*", f"'x' AS {clash}")
        return df
    return make
