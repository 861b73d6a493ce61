"""Tokens of whole documents attributed to their fields and sections by character offsets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sheaf.llm.tokenizing import Vocabulary, slices, span_encoder

JOINER = "\n"


def owners(spans: np.ndarray, starts: np.ndarray, rule: str = "most") -> np.ndarray:
    """The section of each token span, for sections that begin at ``starts`` (ascending, the first at 0) and meet.

    A token inside one section belongs to it. One that crosses a border belongs, by ``rule``, to the section of its
    first or last character, or to that with most of its characters, the earlier of two with as many."""
    first = np.searchsorted(starts, spans[:, 0], side="right") - 1
    last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1
    if rule == "first":
        return first
    if rule == "last":
        return last
    out = first.copy()
    for i in np.flatnonzero(first != last):
        at, end = spans[i]
        held = [min(end, starts[k + 1] if k + 1 < len(starts) else end) - max(at, starts[k]) for k in range(first[i], last[i] + 1)]
        out[i] = first[i] + int(np.argmax(held))
    return out


def count_tokens(df: DataFrame, vocabulary: Vocabulary, fields: Sequence[str] = ("text",), doc_id: str = "doc_id",
                 rule: str = "most") -> DataFrame:
    """doc_id, field, section, start, end, n_tokens and doc_tokens, one row per section of every document.

    A document is its fields joined by a line end; it is encoded once as a whole. Each line of a field, with its line
    end, is a section (numbered from 0 within the field), ``start`` to ``end`` its characters in the document. Tokens
    are joined to sections by their character spans; those that cross a border go by ``rule`` (see ``owners``).
    Sections cover the document, so their counts add up to its tokens.

    Null fields count as empty; an empty field is one empty section. Null ids and repeated rows give rows of their
    own. An empty table gives an empty result; other columns are not read, so their names cannot clash."""
    if rule not in ("most", "first", "last"):
        raise ValueError("rule is most, first or last")
    fields = list(fields)
    slim = df.select(F.col(doc_id).alias("doc_id"), *[F.coalesce(F.col(f), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])
    whole = F.concat_ws(JOINER, *[F.col(f"f{i}") for i in range(len(fields))]).alias("text")
    slim = slim.select("doc_id", whole, F.array(*[F.length(f"f{i}") for i in range(len(fields))]).alias("sizes"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("field", T.StringType()), *[
        T.StructField(n, T.LongType()) for n in ("section", "start", "end", "n_tokens", "doc_tokens")]])

    def run(batches):
        encode = span_encoder(vocabulary).spans
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                spans, rows = encode(texts)
                yield _sections(batch.slice(at, len(texts)), spans, rows, fields, rule, schema)

    return slim.mapInArrow(run, schema)


def _sections(batch, spans, rows, fields, rule, schema) -> pa.RecordBatch:
    texts, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    rows_of, field_of, section_of, starts_of, ends_of, counts_of, totals_of = [], [], [], [], [], [], []
    for i, (text, widths) in enumerate(zip(texts, sizes)):
        field_starts = np.concatenate(([0], np.cumsum(np.array(widths) + 1)[:-1]))
        breaks = _line_starts(text)
        starts = np.unique(np.concatenate((field_starts, breaks[breaks < len(text)])))
        if len(field_starts) > 1:  # an empty last field begins where the document ends
            starts = np.unique(np.concatenate((starts, field_starts)))
        own = spans[rows[i]:rows[i + 1]]
        counts = np.bincount(owners(own, starts, rule), minlength=len(starts)) if len(own) else np.zeros(len(starts), np.int64)
        field = np.searchsorted(field_starts, starts, side="right") - 1
        rows_of.append(np.full(len(starts), i))
        field_of.append(field)
        section_of.append(np.arange(len(starts)) - np.searchsorted(starts, field_starts)[field])
        starts_of.append(starts)
        ends_of.append(np.append(starts[1:], len(text)))
        counts_of.append(counts)
        totals_of.append(np.full(len(starts), len(own)))
    joined = [np.concatenate(x).astype(np.int64) for x in (rows_of, field_of, section_of, starts_of, ends_of, counts_of, totals_of)]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(joined[0])), pa.array(fields, pa.string()).take(pa.array(joined[1])), *map(pa.array, joined[2:])],
        names=schema.names)


def _line_starts(text: str) -> np.ndarray:
    found, at = [0], text.find("\n")
    while at >= 0:
        found.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(found)
