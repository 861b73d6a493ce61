"""SimHash fingerprints, and links between close ones found through shared blocks of bits."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sheaf.llm.common import row_key
from sheaf.llm.components import components
from sheaf.session import stage

BITS = 64
ROWS_AT_ONCE = 1 << 14


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a UTF-8 text, A-Z lower-cased, as a signed 64-bit number.

    Shingles count as often as they occur; with fewer words the whole sequence is the only one; without words, or
    for null, the fingerprint is zero. Words end at ASCII spaces only."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    width = min(words, len(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    ends = (starts + sizes - 1)[width - 1:]
    total = len(ends)
    digest = xxhash.xxh64_digest

    def hashed():
        for at in range(0, total, ROWS_AT_ONCE):
            s, e = starts[at:min(at + ROWS_AT_ONCE, total)].tolist(), ends[at:at + ROWS_AT_ONCE].tolist()
            yield np.frombuffer(b"".join([digest(joined[i:j], seed) for i, j in zip(s, e)]), np.uint8).reshape(-1, 8)

    return majority(hashed(), total)


def majority(hashed: Iterable[np.ndarray], total: int) -> int:
    """The bits that more than half of ``total`` hashes have, as a signed 64-bit number.

    ``hashed`` gives the hashes some at a time, eight bytes each, high byte first."""
    ones = np.zeros(BITS, np.int64)
    for raw in hashed:
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 3,
                 seed: int = 42) -> DataFrame:
    """The columns ``keep`` and ``fp``, one row per row of ``df``; null and empty texts get 0."""
    slim = df.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([*slim.select(*keep).schema.fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            values = [fingerprint(t.as_py(), words, seed) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.int64())], names=schema.names)

    return slim.mapInArrow(run, schema)


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(blocks: int, shared: int) -> list[int]:
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    whole = [sum(c) for c in combinations(parts, shared)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in whole]


def links(fps: DataFrame, distance: int = 2, blocks: int = 5, largest_block: int = 32,
          stage: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """(src, dst) that link all fingerprints of the distinct column ``fp`` that differ in ``distance`` (0, 1 or 2) bits or fewer.

    Of ``blocks`` blocks two close fingerprints share at least ``blocks - distance``; they meet on every such
    choice of blocks, and pairs are verified in the join. A choice of blocks that more than ``largest_block``
    fingerprints share isn't paired: close ones among its members are exactly those that share a value one bit or
    less away from both, at most 65 for each value, and these are chained to the smallest (for distance 1 to the
    value itself). So pairs stay linear in the fingerprints and no link is lost, though not every link is spelt out."""
    if distance not in (0, 1, 2):
        raise ValueError("distance is 0, 1 or 2")
    if distance == 0:
        return fps.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    keys = F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
        for i, m in enumerate(_masks(blocks, blocks - distance))
    ])).alias("k")
    blocked = fps.select("fp", keys).select("fp", "k.choice", "k.part")
    sizes = blocked.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(blocked.join(sizes, ["choice", "part"]))
    few = met.where(F.col("n") <= largest_block).drop("n")
    other = few.select("choice", "part", F.col("fp").alias("dst"))
    near = (few.join(other, ["choice", "part"]).where((F.col("fp") > F.col("dst")) & (_differing(F.col("fp"), F.col("dst")) <= distance))
            .select(F.col("fp").alias("src"), "dst").distinct())
    flips = F.explode(F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(BITS)]))
    around = (met.where(F.col("n") > largest_block).select("fp").distinct().select("fp", flips.alias("flip"))
              .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("z")).agg(F.collect_list("fp").alias("fps"))
              .where(F.size("fps") > 1))
    centre = F.array_min("fps") if distance == 2 else F.when(F.array_contains("fps", F.col("z")), F.col("z"))
    chained = (around.select(F.explode("fps").alias("src"), centre.alias("dst")).where("src <> dst").distinct())
    return near.unionByName(chained).distinct()


def near_groups(marked: DataFrame, order: str = "doc_id", distance: int = 2) -> DataFrame:
    """``marked`` (with ``fp``) and ``component``: the smallest ``order`` reached over links; null where all are null."""
    firsts = stage(marked.groupBy("fp").agg(F.min(order).alias("first")))
    roots = components(links(firsts.select("fp"), distance))
    labelled = firsts.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component"))
    return marked.join(labelled.join(least, "root").select("fp", "component"), "fp")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows each give a row. Null
    ids are kept; a group of null ids only has a null component. An empty table gives an empty result. Other
    columns are not read, so their names cannot clash."""
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = stage(fingerprints(slim, words=words))
    return near_groups(marked, distance=distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``df``, of each group of near-duplicates only the document with the smallest id.

    Rows equal in id and text are one document and stay or go together; null ids come last in their group. All
    columns are kept as they are."""
    key = row_key(F.col(doc_id), F.col(text))
    slim = df.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), key.alias("key")).alias("place"),
                     F.col(text).alias("text"))
    marked = stage(fingerprints(slim, keep=("place",), words=words))
    stays = near_groups(marked, "place", distance).where("place = component").select(F.col("place.key").alias("__key")).distinct()
    packed = df.select(F.struct("*").alias("__row"), key.alias("__key"))
    return packed.join(stays, "__key", "left_semi").select("__row.*")
