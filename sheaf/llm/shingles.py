"""Near copies by the Jaccard similarity of their word shingles: candidates by SimHash and MinHash bands, verified on the whole sets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sheaf.llm import simhash
from sheaf.llm.common import row_key
from sheaf.llm.components import components
from sheaf.session import Stages, stage

#: Longs of the parity sketch of a set.
LONGS = 8
#: Sets of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS: all but 5 in 100,000 at 0.8.
BANDS, ROWS = 25, 5
#: Nodes that a band's first one leaves aside and that are still held against all of the band; beyond it ``_rare`` is used.
LARGEST_REST = 128
#: Bands that gather large groups before the others are looked at.
FIRST = 5
#: Bits of the map of texts whose sets are compared in full, and places of the table of common shingles.
FILTER_BITS = 1 << 23
#: Numbers of sets of a crowd beyond which a shingle counts as more common.
COMMON = (1, 4, 16, 64, 256, 1024, 4096)
_DRAWS = np.random.default_rng(20)
_FACTORS = _DRAWS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _DRAWS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]
SETS_AT_ONCE = 4096


def shingles(text: bytes | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles of a UTF-8 text, A-Z lower-cased, in order.

    With fewer words the whole sequence is the only shingle; a text without words, or null, has none. Words end at
    ASCII spaces only."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    width = min(words, len(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[i:j], seed) for i, j in zip(starts.tolist(), ends[width - 1:].tolist())])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def _name(found: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(found.tobytes()), "big", signed=True) if len(found) else 0


def _fingerprint(found: np.ndarray) -> int:
    """SimHash of a set, each shingle once; zero without any."""
    raw = found.astype(">u8").view(np.uint8).reshape(-1, 8)
    return simhash.majority((raw[at:at + SETS_AT_ONCE] for at in range(0, len(raw), SETS_AT_ONCE)), len(raw))


def _sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the shingles per bit: two sketches never differ in more bits than the sets do in shingles."""
    odd = np.bincount((found & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _minima(found: np.ndarray) -> np.ndarray:
    """The least value of the set under each of BANDS * ROWS hash functions."""
    high, least = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), SETS_AT_ONCE):
        part = high[at:at + SETS_AT_ONCE, None] * _FACTORS + _SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys; equal where all minima of a band are."""
    rows = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[1], rows.shape[:2]).copy()
    for r in range(ROWS):
        keys = (keys ^ rows[:, :, r]) * _MIX[0]
        keys ^= keys >> np.uint64(29)
        keys *= _MIX[2]
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


SKETCH = [f"s{i}" for i in range(LONGS)]


def _marked(slim: DataFrame, words: int) -> DataFrame:
    """``place``, node (a hash of the set), n (its size), fp (its SimHash), the sketch and the band keys, one row per row."""
    schema = T.StructType([slim.schema["place"], T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in SKETCH], T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for t in part.column(1):
                    found = shingles(t.as_py(), words)
                    rows.append((_name(found), len(found), _fingerprint(found), _sketch(found), _minima(found)))
                bits = np.array([r[3] for r in rows], np.int64).reshape(len(rows), LONGS)
                keys = band_keys(np.array([r[4] for r in rows], np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], *[pa.array(bits[:, i]) for i in range(LONGS)],
                     pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))], names=schema.names)

    return slim.mapInArrow(run, schema)


def _bit_maps(rows: DataFrame, conditions: tuple[str, ...] = ("true",)) -> np.ndarray:
    """(conditions, FILTER_BITS) booleans: the values of ``bit`` in the rows that meet each condition.

    The driver gets at most FILTER_BITS / 32768 rows of 4 KB a condition, whatever the input."""
    maps = [F.expr(f"bitmap_construct_agg(bit & 32767) FILTER (WHERE {c})").alias(f"map{i}") for i, c in enumerate(conditions)]
    there = np.zeros((len(conditions), FILTER_BITS >> 15, 1 << 15), bool)
    for r in rows.groupBy(F.shiftright("bit", 15).alias("part")).agg(*maps).collect():
        for i in range(len(conditions)):
            there[i, r["part"]] = np.unpackbits(np.frombuffer(r[f"map{i}"], np.uint8), bitorder="little")
    return there.reshape(len(conditions), FILTER_BITS)


def _sets(slim: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(node, found) of the nodes ``needed`` (node, text_key): the shingles of one text of each.

    A map of FILTER_BITS bits, whatever the input, tells nearly all other texts apart before they are hashed or moved;
    the join settles the rest."""
    bit = lambda key: F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    shared = slim.sparkSession.sparkContext.broadcast(np.packbits(_bit_maps(needed.select(bit("text_key").alias("bit")))[0]))

    def run(batches):
        bits = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            for i in np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).tolist():
                found = shingles(batch.column(1)[i].as_py(), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names=["text_key", "found"])

    keyed = slim.select(F.col("place.key").alias("text_key"), "text", bit("place.key").alias("bit"))
    return keyed.mapInArrow(run, "text_key string, found array<bigint>").dropDuplicates(["text_key"]).join(needed, "text_key").select("node", "found")


def _may_be_similar(a: str, b: str) -> Column:
    """Never false for sets of similarity 0.8 or more."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH])
    return (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (bits * 9 <= n + m)


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that sizes and sketches don't rule out, at the first of their common keys."""
    a, b = F.col("a.node"), F.col("b.node")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & _may_be_similar("a", "b")
    met &= F.get(F.array_intersect("a.keys", "b.keys"), F.lit(0)) == F.col("a.key")
    return left.alias("a").join(right.alias("b"), met).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct()


def _similar(own: Stages, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have a similarity of 0.8 or more."""
    one = sets.select(F.col("node").alias("src"), F.col("found").alias("a"))
    other = sets.select(F.col("node").alias("dst"), F.col("found").alias("b"))
    return own.stage(pairs.join(one, "src").join(other, "dst")
                     .where(F.size(F.array_intersect("a", "b")) * 9 >= (F.size("a") + F.size("b")) * 4).select("src", "dst"))


def rarest(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Of a set's shingles, ordered by level and value, those among the first n - ceil(0.8 n) + 1 that other sets may have.

    Sets of similarity 0.8 or more share one of them, whatever the levels: the order is one for all sets."""
    level = levels[found & (len(levels) - 1)]
    first = np.lexsort((found, level))[:len(found) - (4 * len(found) + 4) // 5 + 1]
    return found[first[level[first] > 0]]


def _rare(own: Stages, crowd: DataFrame, sets: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs of the nodes ``crowd`` (node, root) that share one of their rarest shingles.

    How many of the crowd have a shingle is kept as a level in a table of FILTER_BITS bytes, whatever the input: level 0
    stands for shingles of one set, the others for more sets than COMMON says. Shingles that meet in a place of the table
    take the highest level of them, which costs pairs to look at and loses none. Passages that many documents hold come
    last, so what brings such documents together is what few others have."""
    sets = own.stage(sets.join(crowd, "node", "left_semi"))
    often = sets.select(F.explode("found").alias("key")).groupBy("key").agg(F.count("*").alias("of")).where(f"of > {COMMON[0]}")
    bits = often.select(F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit"), "of")
    table = _bit_maps(bits, tuple(f"of > {n}" for n in COMMON)).sum(axis=0, dtype=np.uint8)
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        levels = shared.value
        for batch in batches:
            keys = [rarest(found.values.to_numpy(), levels) for found in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    rows = sets.select("node", "found").mapInArrow(run, "node bigint, keys array<bigint>")
    rows = own.stage(rows.withColumn("key", F.explode("keys")).join(crowd, "node").join(info.drop("bands"), "node"))
    return _pairs(rows, rows.select([F.col(c) for c in rows.columns]))


def _to_least(keys: DataFrame, slim: DataFrame) -> DataFrame:
    """Pairs of each node with the smallest of each of its keys, where sizes and sketches don't rule them out."""
    hubs = keys.groupBy("key").agg(F.min("node").alias("dst"), F.max("node").alias("most")).where("dst < most").drop("most")
    return _alike(keys.withColumnRenamed("node", "src").join(hubs, "key").where("src <> dst").select("src", "dst").distinct(), slim)


def _alike(pairs: DataFrame, slim: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches don't rule out."""
    return pairs.join(slim.alias("a"), F.col("src") == F.col("a.node")).join(
        slim.alias("b"), (F.col("dst") == F.col("b.node")) & _may_be_similar("a", "b")).select("src", "dst")


def _close(own: Stages, info: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints differ in two bits at most: each node with the smallest of its fingerprint, and
    these with each other as :func:`simhash.links` chains them, so equal fingerprints are never paired among themselves."""
    least = own.stage(info.groupBy("fp").agg(F.min("node").alias("hub")))
    same = info.select("node", "fp").join(least, "fp").where("node <> hub").select(F.col("node").alias("src"), F.col("hub").alias("dst"))
    near = simhash.links(least.select("fp"), stage=own.stage)
    a, b = (least.select(F.col("fp").alias(c), F.col("hub").alias("hub_" + c)) for c in ("src", "dst"))
    near = near.join(a, "src").join(b, "dst").select(F.col("hub_src").alias("src"), F.col("hub_dst").alias("dst"))
    return own.stage(same.unionByName(near))


def links(own: Stages, slim: DataFrame, marked: DataFrame, words: int = 5) -> DataFrame:
    """(src, dst) whose components are those of all pairs of nodes with a Jaccard similarity of 0.8 or more that share a band or have close
    fingerprints.

    Nodes with fingerprints within two bits are compared first; bands find what differs in more bits. Then every node is held against the smallest of each of its first FIRST bands, which gathers large groups of near
    copies. Of all bands only those that still hold several components go on: again every node is held against the
    smallest one, then what that leaves elsewhere against all of the band that are in other components; where it leaves
    more than LARGEST_REST nodes of a band, against those that share a rare shingle. So a large group of near copies
    costs a few pairs a copy, a crowded band is never paired with itself, and no pair of a band is left out. Sketches are
    compared in the joins, sets in full after them."""
    info = own.stage(marked.where("n > 0").groupBy("node").agg(F.min("place.key").alias("text_key"), *[F.first(c).alias(c) for c in ("n", "fp", *SKETCH, "bands")]))
    keys = info.select("node", F.explode("bands").alias("key"))
    met = own.stage(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key"))
    close = _close(own, info)
    paired = close.select(F.col("src").alias("node")).unionByName(close.select(F.col("dst").alias("node")))
    needed = own.stage(keys.join(met, "key", "left_semi").select("node").unionByName(paired).distinct().join(info.select("node", "text_key"), "node"))
    sets = own.stage(_sets(slim, needed, words))
    info = own.stage(info.drop("text_key", "fp").join(needed.select("node"), "node", "left_semi"))
    slim = info.drop("bands")
    first = _alike(close, slim).unionByName(_to_least(info.select("node", F.explode(F.slice("bands", 1, FIRST)).alias("key")), slim))
    first = _similar(own, first.distinct(), sets)
    roots = components(first, own.stage)
    rooted = info.join(roots, "node", "left").select("node", "bands", F.coalesce("root", "node").alias("root"))
    rooted = own.stage(rooted.select("node", "root", F.explode("bands").alias("key")))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    open_ = own.stage(rooted.join(mixed, "key", "left_semi"))
    own.drop(rooted)
    first = own.stage(first.unionByName(_similar(own, _to_least(open_.select("node", "key"), slim), sets)))
    roots = components(first, own.stage)
    hubs = open_.groupBy("key").agg(F.min("node").alias("hub"))
    placed = open_.drop("root").join(hubs, "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hub_roots = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    placed = own.stage(placed.join(hub_roots, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub")))
    outside = placed.where("root <> hub_root")
    rest = own.stage(outside.groupBy("key").agg(F.count("*").alias("outside")))
    few, crowded = (rest.where(c).select("key") for c in (f"outside <= {LARGEST_REST}", f"outside > {LARGEST_REST}"))
    info = info.withColumnRenamed("bands", "keys")
    full = lambda rows: rows.join(few, "key", "left_semi").select("key", "node", "root").join(info, "node")
    out = first.unionByName(_similar(own, _pairs(full(outside), full(placed.where("node <> hub"))), sets))
    if not crowded.isEmpty():
        crowd = own.stage(placed.join(crowded, "key", "left_semi").select("node", "root").distinct())
        out = out.unionByName(_similar(own, _rare(own, crowd, sets, slim), sets))
    return out


def drop_near_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5) -> DataFrame:
    """The rows of ``df``, of each group of near copies only the document with the smallest id.

    Texts with a Jaccard similarity of 0.8 or more of their word shingles are linked (found by close SimHash fingerprints
    of these, else by bands with a chance of 0.99995 at 0.8 itself, more above it); a group is what links reach. Rows equal in id and text are one document and stay or go
    together; null ids come last in their group. Null texts and texts without words are one group. An empty table gives
    an empty result. All columns are kept as they are."""
    key = row_key(F.col(doc_id), F.col(text))
    slim = df.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), key.alias("key")).alias("place"),
                     F.col(text).cast("binary").alias("text"))
    with Stages() as own:
        marked = own.stage(_marked(slim, words))
        firsts = own.stage(marked.groupBy("node").agg(F.min("place").alias("first")))
        roots = components(links(own, slim, marked, words), own.stage)
        labelled = firsts.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
        stays = stage(labelled.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("__key")))
    packed = df.select(F.struct("*").alias("__row"), key.alias("__key"))
    return packed.join(stays, "__key", "left_semi").select("__row.*")
