"""Packing documents into training windows of several lengths.

Documents go to the tier of the shortest window that holds them; windows of the longest tier are packed first, and
the gap behind each document is filled from shorter documents. A task packs the documents of its own partition, a
bounded pool at a time, so nothing is shuffled but what says where pieces lie.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sheaf.llm.tokenizing import Vocabulary, encoder, slices
from sheaf.session import stage

TIERS = (512, 1024, 2048, 4096)
#: Tokens a task holds before it packs them.
POOL_TOKENS = 1 << 20


@dataclass(frozen=True)
class Part:
    """Some of the ids of a document: ``row`` names it, ``start`` of its ``total`` ids come before."""

    row: object
    start: int
    total: int
    ids: np.ndarray

    def cut(self, at: int) -> tuple["Part", "Part"]:
        return replace(self, ids=self.ids[:at]), replace(self, start=self.start + at, ids=self.ids[at:])


class Pool:
    """Parts that wait for a window, by length."""

    def __init__(self, parts: Sequence[Part]):
        self.parts = dict(enumerate(parts))
        self.order = sorted((len(p.ids), i) for i, p in self.parts.items())
        self.serial = len(self.parts)

    def add(self, part: Part) -> None:
        self.parts[self.serial] = part
        insort(self.order, (len(part.ids), self.serial))
        self.serial += 1

    def take(self, index: int) -> Part:
        return self.parts.pop(self.order.pop(index)[1])

    def longest_within(self, room: int) -> int:
        """Index of the longest part of at most ``room`` ids, or -1."""
        return bisect_right(self.order, (room, float("inf"))) - 1


def pack(parts: Sequence[Part], tiers: Sequence[int] = TIERS) -> tuple[list[tuple[int, list[Part]]], list[Part]]:
    """Windows (length, parts), all exactly full, and the parts left over, fewer ids than the longest window holds.

    From the longest tier to the shortest, the longest waiting part opens a window of its tier. The gap takes the
    longest part that fits, again and again; if none does, the shortest part that waits is cut to what is missing
    and its rest waits on. A part longer than the longest window fills whole ones first."""
    longest, windows, waiting = tiers[-1], [], []
    for part in parts:
        while len(part.ids) > longest:
            head, part = part.cut(longest)
            windows.append((longest, [head]))
        waiting.append(part)
    pool = Pool(waiting)
    left = sum(n for n, _ in pool.order)
    while pool.order:
        first = pool.take(-1)
        size = tiers[bisect_left(tiers, len(first.ids))]
        if left < size:  # no window of this tier can be filled any more
            return windows, [first, *pool.parts.values()]
        left -= size
        window, gap = [first], size - len(first.ids)
        while gap:
            at = pool.longest_within(gap)
            part = pool.take(max(at, 0))
            if at < 0:
                part, rest = part.cut(gap)
                pool.add(rest)
            window.append(part)
            gap -= len(part.ids)
        windows.append((size, window))
    return windows, []


def close(parts: Sequence[Part]) -> list[tuple[int, list[Part]]]:
    """The last parts of a task in windows that are powers of two and full, longest first."""
    left, windows, waiting = sum(len(p.ids) for p in parts), [], list(parts)
    while left:
        size = 1 << (left.bit_length() - 1)
        window, gap = [], size
        while gap:
            part = waiting.pop(0)
            if len(part.ids) > gap:
                part, rest = part.cut(gap)
                waiting.insert(0, rest)
            window.append(part)
            gap -= len(part.ids)
        windows.append((size, window))
        left -= size
    return windows


def packed(docs: Iterator[tuple[object, np.ndarray]], tiers: Sequence[int] = TIERS) -> Iterator[tuple[int, list[Part]]]:
    """Windows of a stream of (row, ids); holds about ``POOL_TOKENS`` ids at a time."""
    parts, held = [], 0
    for row, ids in docs:
        parts.append(Part(row, 0, len(ids), ids))
        held += len(ids)
        if held >= POOL_TOKENS:
            windows, parts = pack(parts, tiers)
            parts = [replace(p, ids=p.ids.copy()) for p in parts]
            held = sum(len(p.ids) for p in parts)
            yield from windows
    windows, parts = pack(parts, tiers)
    yield from windows
    yield from close(parts)


def token_pieces(df: DataFrame, vocabulary: Vocabulary, end_id: int = 2, text: str = "text", doc_id: str = "doc_id",
                 tiers: Sequence[int] = TIERS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, seq, tier, place, offset), numbered inside a task's partition.

    ``tier`` is the window's length, or 0 for one of a task's last windows; ``place`` counts windows of a tier."""
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "part", "seq", "tier", "place", "offset")]])
    tiers = tuple(tiers)

    def run(batches):
        part, end = TaskContext.get().partitionId(), np.array([end_id], np.uint32)
        encode = encoder(vocabulary).ids

        def docs():
            for batch in batches:
                for at, texts in slices(batch.column(1)):
                    ids, rows = encode(texts)
                    for i in range(len(texts)):
                        yield batch.column(0)[at + i], np.concatenate((ids[rows[i]:rows[i + 1]], end))

        rows, places = [], dict.fromkeys((0, *tiers), 0)
        for seq, (size, window) in enumerate(packed(docs(), tiers)):
            tier, offset = size if size in places else 0, 0
            for p in window:
                rows.append((p.row.as_py(), p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, part, seq, tier, places[tier], offset))
                offset += len(p.ids)
            places[tier] += 1
            if len(rows) >= 20_000:
                yield _batch(rows, schema)
                rows = []
        yield _batch(rows, schema)

    return slim.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)


def pack_documents(df: DataFrame, vocabulary: Vocabulary, end_id: int = 2, text: str = "text", doc_id: str = "doc_id",
                   tiers: Sequence[int] = TIERS, step_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, step_group.

    All windows are full, so none is padded; a task's last few have smaller powers of two as lengths. Step groups
    hold about ``step_tokens`` tokens each and an equal share of every tier, so steps cost alike.

    Null and empty texts are documents of the end id alone. Repeated rows and null ids are documents of their own.
    An empty table gives an empty result; other columns are not read. Numbers of windows follow the partitions; only
    one row per task and tier is collected to number them."""
    pieces = stage(token_pieces(df, vocabulary, end_id, text, doc_id, tiers))
    per = pieces.groupBy("part", "tier").agg((F.max("place") + 1).alias("n"), F.sum("length").alias("tokens"))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ahead = Window.partitionBy("part")
    per = per.withColumns({
        "of_part": F.sum("n").over(ahead), "tier_before": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "tier_all": F.sum("n").over(Window.partitionBy("tier")), "steps": F.ceil(F.sum("tokens").over(whole) / step_tokens),
    })
    parts = per.groupBy("part").agg(F.first("of_part").alias("n")).select(
        F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    numbers = per.join(parts, F.col("part") == F.col("p")).select("part", "tier", "first", "tier_before", "tier_all", "steps")
    placed = pieces.join(F.broadcast(numbers), ["part", "tier"])  # one row per task and tier
    step = F.floor((F.col("tier_before") + F.col("place")) * F.col("steps") / F.col("tier_all")).cast("bigint")
    lengths = F.sum("length").over(Window.partitionBy("part", "seq"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("seq")).alias("sequence_id"),
                         "offset", lengths.alias("sequence_tokens"), step.alias("step_group"))
