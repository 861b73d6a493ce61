"""Token ids on disk in patched frame-of-reference blocks.

A shard is one byte string: header, document table, block index, blocks. Ids are cut into blocks of 1,024. A block
stores its minimum, then all differences to it at the width that holds nine tenths of them, and the others whole in an
exception list. The index holds where each block starts, so a range of ids is read without the rest.

    header      4 bytes "PFR1", then unsigned 32-bit: documents, ids (two words), ids per block
    documents   ids of each document, unsigned 32-bit
    index       start of each block from the first block, unsigned 64-bit, and the end of the last
    block       unsigned 32-bit: minimum, width, exceptions; packed differences, low bit first; exceptions as pairs of
                position and difference, unsigned 32-bit

All numbers are little-endian. Spark writes shards as rows of a table (first column the order, then the bytes), so any
store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sheaf.llm.tokenizing import Vocabulary, encoder, slices
from sheaf.session import stage

MAGIC, BLOCK, SHARE = b"PFR1", 1024, 0.9
#: Ids after which a shard ends with the document.
SHARD_IDS = 1 << 20


def encode_shard(sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The shard of documents with ``sizes`` ids each, whose ids follow one another in ``ids``."""
    n = len(ids)
    starts = np.arange(0, n, block)
    ids = ids.astype(np.uint32)
    low = np.minimum.reduceat(ids, starts) if n else np.empty(0, np.uint32)
    padded = np.concatenate((ids - np.repeat(low, np.diff(np.append(starts, n))), np.zeros(-n % block, np.uint32))).reshape(-1, block)
    filled = np.diff(np.append(starts, n))
    widths = _bits(padded)
    widths[np.arange(block) >= filled[:, None]] = 0
    rank = np.minimum(np.ceil(filled * SHARE).astype(np.int64) + (block - filled), block) - 1  # the padding sorts first
    width = np.take_along_axis(np.sort(widths, axis=1), np.maximum(rank, 0)[:, None], axis=1)[:, 0] if len(padded) else np.empty(0, np.int64)
    over = widths > width[:, None]
    payload: list[bytes] = [b""] * len(padded)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        rows = np.where(over[at], 0, padded[at])
        packed = _pack(rows, int(w))
        for k, b in enumerate(at):
            payload[b] = packed[k, :(int(filled[b]) * int(w) + 7) // 8].tobytes()
    where = np.nonzero(over)
    lists = np.stack((where[1].astype("<u4"), padded[where].astype("<u4")), axis=1) if len(padded) else np.empty((0, 2), "<u4")
    each = over.sum(axis=1) if len(padded) else np.empty(0, np.int64)
    list_at = np.cumsum(each) - each
    blocks = [np.array((low[b], width[b], each[b]), "<u4").tobytes() + payload[b] + lists[list_at[b]:list_at[b] + each[b]].tobytes()
              for b in range(len(padded))]
    index = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = MAGIC + np.array((len(sizes), n & 0xFFFFFFFF, n >> 32, block), "<u4").tobytes()
    return b"".join([head, sizes.astype("<u4").tobytes(), index.tobytes(), *blocks])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.empty((len(rows), 0), np.uint8)
    raw = rows.astype("<u4").view(np.uint8).reshape(*rows.shape, 4)[..., :(width + 7) // 8]
    bits = np.unpackbits(raw, axis=-1, bitorder="little")[..., :width]
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(rows, axis=1, bitorder="little")[:, :count * width].reshape(len(rows), count, width)
    raw = np.zeros((len(rows), count, 4), np.uint8)
    packed = np.packbits(bits, axis=-1, bitorder="little")
    raw[..., :packed.shape[-1]] = packed
    return raw.view("<u4")[..., 0]


class Shard:
    """Reads a shard."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.raw = raw
        docs, low, high, self.block = (int(x) for x in np.frombuffer(raw, "<u4", 4, 4))
        self.count = low | high << 32
        self.sizes = np.frombuffer(raw, "<u4", docs, 20).astype(np.int64)
        blocks = -(-self.count // self.block)
        self.index = np.frombuffer(raw, "<u8", blocks + 1, 20 + 4 * docs).astype(np.int64)
        self.base = 20 + 4 * docs + 8 * (blocks + 1)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop``, from the blocks that hold them only."""
        stop = self.count if stop is None else min(stop, self.count)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        heads = [np.frombuffer(self.raw, "<u4", 3, self.base + int(self.index[b])) for b in range(first, last + 1)]
        sizes = [min(self.block, self.count - b * self.block) for b in range(first, last + 1)]
        out = np.empty((last - first + 1, self.block), np.uint32)
        kinds: dict[tuple[int, int], list[int]] = {}
        for k, (h, n) in enumerate(zip(heads, sizes)):
            kinds.setdefault((int(h[1]), n), []).append(k)
        for (width, n), at in kinds.items():
            size = (n * width + 7) // 8
            if width:
                rows = np.stack([np.frombuffer(self.raw, np.uint8, size, self.base + int(self.index[first + k]) + 12) for k in at])
                out[at, :n] = _unpack(rows, width, n)
            else:
                out[at, :n] = 0
        for k, (h, n) in enumerate(zip(heads, sizes)):
            if h[2]:
                pairs = np.frombuffer(self.raw, "<u4", 2 * int(h[2]), self.base + int(self.index[first + k]) + 12 + (n * int(h[1]) + 7) // 8)
                out[k, pairs[::2]] = pairs[1::2]
            out[k, :n] += h[0]
        return out.reshape(-1)[start - first * self.block:stop - first * self.block]


SHARDS = T.StructType([T.StructField("part", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("n_ids", T.LongType()),
                       T.StructField("raw", T.BinaryType())])


def shards(df: DataFrame, vocabulary: Vocabulary, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(part, shard, n_ids, doc_ids, raw): shards of all documents, each with ``end_id`` behind, in ascending id order.

    Range partitions by id and a sort inside each put documents in order; (part, shard) orders the shards."""
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = (F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    placed = slim.repartitionByRange(order[0], F.xxhash64("text")).sortWithinPartitions(order[0], F.xxhash64("text"), order[1])
    schema = T.StructType([*SHARDS.fields[:3], T.StructField("doc_ids", T.ArrayType(slim.schema["doc_id"].dataType)), SHARDS["raw"]])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        part, shard = TaskContext.get().partitionId(), 0
        kind = pa.list_(to_arrow_type(slim_type))
        for names, sizes, ids in _filled(batches, vocabulary, end_id):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names], kind),
                 pa.array([encode_shard(sizes, ids)], pa.binary())], names=schema.names)
            shard += 1

    slim_type = slim.schema["doc_id"].dataType
    return placed.mapInArrow(run, schema)


def _filled(batches, vocabulary: Vocabulary, end_id: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents of about ``SHARD_IDS`` ids at a time: their ids of document, sizes and token ids."""
    encode, names, sizes, held, n = encoder(vocabulary).ids, [], [], [], 0
    for batch in batches:
        for at, texts in slices(batch.column(1)):
            ids, rows = encode(texts)
            own = np.diff(rows) + 1
            full = np.full(len(ids) + len(own), end_id, np.uint32)
            keep = np.ones(len(full), bool)
            keep[np.cumsum(own) - 1] = False
            full[keep] = ids
            known, ends, first = batch.column(0).slice(at, len(texts)).to_pylist(), np.cumsum(own), 0
            while first < len(own):
                done = int(ends[first - 1]) if first else 0
                stop = min(int(np.searchsorted(ends, done + SHARD_IDS - n)) + 1, len(own))
                names += known[first:stop]
                sizes.append(own[first:stop])
                held.append(full[done:int(ends[stop - 1])])
                n += len(held[-1])
                first = stop
                if n >= SHARD_IDS:
                    yield names, np.concatenate(sizes), np.concatenate(held)
                    names, sizes, held, n = [], [], [], 0
    if names:
        yield names, np.concatenate(sizes), np.concatenate(held)


def read_documents(written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards alone; ``start`` counts over all shards."""
    # two steps: one row per part in one task, then the shards of each part
    parts = written.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    at = written.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own")).join(before, "part")
    numbers = at.select("part", "shard", (F.col("first") + F.col("own")).alias("start"))
    kind = written.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("doc_id", kind),
                           *[T.StructField(n, T.LongType()) for n in ("inner", "n_tokens", "ids_crc32")]])

    def run(batches):
        for batch in batches:
            for part, shard, names, raw in zip(*(batch.column(i) for i in range(4))):
                read = Shard(raw.as_py())
                ids, ends = read.ids().astype("<u4"), np.cumsum(read.sizes)
                starts = ends - read.sizes
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int64()), pa.array([shard.as_py()] * n, pa.int64()), names.values,
                     pa.array(starts), pa.array(read.sizes), pa.array(crcs, pa.int64())], names=schema.names)

    docs = written.select("part", "shard", "doc_ids", "raw").mapInArrow(run, schema)
    return docs.join(numbers, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(df: DataFrame, vocabulary: Vocabulary, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write all documents as shards to the shared folder and return what ``read_documents`` reads from them.

    Null and empty texts are the end id alone. Null ids come last; equal ids lie side by side in an order given by
    their texts. An empty table writes no shard. Other columns are not read."""
    return read_documents(stage(shards(df, vocabulary, end_id, text, doc_id)))
