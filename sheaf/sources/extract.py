"""User-supplied extractors: a text or binary column to rows of any declared schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: Rows in an output batch; a document's rows stay together.
ROWS_AT_ONCE = 10_000
_EXTRACTORS: dict[str, tuple[Callable[[object], Iterable[Mapping]], StructType]] = {}


def register_extractor(name: str, fn: Callable[[object], Iterable[Mapping]], schema: StructType | str) -> None:
    """``fn(content)`` yields one mapping per extracted row; ``schema`` declares their columns."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    _EXTRACTORS[name] = (fn, schema)


def extract(df: DataFrame, name: str, doc: str, content: str) -> DataFrame:
    """doc, extracted columns, inspection_ok, inspection_error.

    A failing document gives one row with ``inspection_ok`` false, so later steps fail closed. Documents
    stream through in Arrow batches; filter before this step, since filters do not pass through Python."""
    fn, schema = _EXTRACTORS[name]
    source = df.select(doc, content)
    out = StructType([
        source.schema[doc], *[StructField(f.name, f.dataType, True) for f in schema.fields],
        StructField("inspection_ok", BooleanType()), StructField("inspection_error", StringType()),
    ])
    names = [f.name for f in schema.fields]

    kinds = to_arrow_schema(out)
    failed = lambda key, e: (key, *[None] * len(names), False, f"{type(e).__name__}: {e}")

    def rows(key, value) -> list[tuple]:
        try:
            return [(key, *[r.get(n) for n in names], True, None) for r in fn(value)]
        except Exception as e:  # any failure of the user's function is a finding, not a crash
            return [failed(key, e)]

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), kinds)], schema=kinds)

    def tables(found: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        """One batch; if a value has another type than declared, one per document, and the document has failed."""
        if not found:
            return
        try:
            yield table([r for doc_rows in found for r in doc_rows])
        except (pa.ArrowException, TypeError, ValueError, OverflowError) as e:
            if len(found) == 1:
                yield table([failed(found[0][0][0], e)])
            else:
                for one in found:
                    yield from tables([one])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for k, v in zip(batch.column(0), batch.column(1)):
                if found := rows(k.as_py(), v.as_py()):
                    held.append(found)
                    n += len(found)
                if n >= ROWS_AT_ONCE:
                    yield from tables(held)
                    held, n = [], 0
            yield from tables(held)

    return source.mapInArrow(run, out)
