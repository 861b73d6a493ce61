"""Approximate nearest neighbours over robust-pruned directed graphs, one graph per shard.

A shard is a bounded number of vectors, drawn by a hash. Its graph grows batch by batch: a beam search finds where new
vectors lie, pruning keeps of the found ones those that no kept one makes superfluous, and edges back are pruned alike.
All searches of a batch advance in step as matrix operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sheaf.session import stage

#: Components up to this size have finite sums of squares.
SAFE = 1e145
#: Stands for a null id where ids settle ties: after all others.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    degree: int = 24
    beam: int = 48
    relax: float = 1.2
    entries: int = 8
    batch: int = 256
    search_beam: int = 96


def search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, squared distances) of a beam per query, nearest first; -1 and infinity where fewer were reached."""
    n, b = len(x), len(queries)
    width = max(beam, len(entry))
    ids, near, open_ = np.full((b, width), -1), np.full((b, width), np.inf), np.zeros((b, width), bool)
    seen = np.zeros((b, n + 1), bool)  # the last column stands for no vector
    seen[:, n] = True
    ids[:, :len(entry)] = entry
    own = (queries ** 2).sum(axis=1)[:, None]
    near[:, :len(entry)] = np.maximum(norms[entry][None] - 2 * queries @ x[entry].T + own, 0)
    open_[:, :len(entry)] = True
    seen[:, entry] = True
    order = np.argsort(near, axis=1)
    ids, near, open_ = (np.take_along_axis(a, order, axis=1) for a in (ids, near, open_))
    every = np.arange(b)
    while True:
        active = open_.any(axis=1)
        rows = every[active]
        if not len(rows):
            return ids, near
        first = open_[rows].argmax(axis=1)
        open_[rows, first] = False
        found = graph[ids[rows, first]]
        found = np.where(seen[rows[:, None], found], -1, found)  # -1 reads the last column
        seen[rows[:, None], found] = True
        d = np.maximum(norms[found] - 2 * np.einsum("brd,bd->br", x[found], queries[rows]) + own[rows], 0)
        d[found < 0] = np.inf
        all_ids = np.concatenate((ids[rows], found), axis=1)
        all_near = np.concatenate((near[rows], d), axis=1)
        all_open = np.concatenate((open_[rows], found >= 0), axis=1)
        order = np.argsort(all_near, axis=1, kind="stable")[:, :width]
        ids[rows], near[rows], open_[rows] = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_near, all_open))


def prune(x: np.ndarray, norms: np.ndarray, candidates: np.ndarray, near: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each row of candidates (-1: none) with their squared distances, the kept ones, filled up with -1.

    Again and again the nearest candidate left is kept, and those dropped that are nearer to it, by the factor
    ``relax``, than to the vector itself."""
    b, c = candidates.shape
    near = np.where(candidates < 0, np.inf, near)
    points = x[candidates]
    size = norms[candidates]
    mutual = np.maximum(size[:, :, None] + size[:, None, :] - 2 * points @ points.transpose(0, 2, 1), 0)
    left, kept, every = near.copy(), np.full((b, degree), -1), np.arange(b)
    for k in range(degree):
        pick = left.argmin(axis=1)
        good = np.isfinite(left[every, pick])
        if not good.any():
            break
        kept[good, k] = candidates[every, pick][good]
        left[every, pick] = np.inf
        left[(relax * relax * mutual[every, pick] <= near) & good[:, None]] = np.inf
    return kept


def build(x: np.ndarray, settings: Settings = Settings(), seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Graph (neighbours of each vector, -1 where fewer) and the entry points of distinct vectors ``x``."""
    rng, n = np.random.default_rng(seed), len(x)
    norms = (x ** 2).sum(axis=1)
    graph = np.full((n, settings.degree), -1)
    middle = int((norms - 2 * x @ x.mean(axis=0)).argmin())
    order = rng.permutation(n)
    order = np.concatenate(([middle], order[order != middle]))
    entry = order[:min(settings.entries, n)]
    graph[entry[0]] = np.append(np.resize(entry[1:], 0), np.full(settings.degree, -1))[:settings.degree]
    done = 1
    while done < n:
        new = order[done:done + min(settings.batch, done)]
        ids, near = search(x, norms, graph, entry[:min(len(entry), done)], x[new], settings.beam)
        if len(new) > 1:  # those of the batch don't find each other yet
            mates = np.where(np.eye(len(new), dtype=bool), -1, np.broadcast_to(new, (len(new), len(new))))
            apart = np.maximum(norms[new][:, None] + norms[new] - 2 * x[new] @ x[new].T, 0)
            apart[np.eye(len(new), dtype=bool)] = np.inf
            some = np.argsort(apart, axis=1)[:, :16]
            ids = np.concatenate((ids, np.take_along_axis(mates, some, axis=1)), axis=1)
            near = np.concatenate((near, np.take_along_axis(apart, some, axis=1)), axis=1)
        graph[new] = prune(x, norms, ids, near, settings.degree, settings.relax)
        _back(x, norms, graph, new, settings)
        done += len(new)
    return graph, entry


def _back(x, norms, graph, new, settings) -> None:
    """Edges from the neighbours of new vectors back to them; full neighbour lists are pruned."""
    to, back = graph[new].ravel(), np.repeat(new, graph.shape[1])
    to, back = to[to >= 0], back[to >= 0]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    targets, first, each = np.unique(to, return_index=True, return_counts=True)
    widest = int(each.max()) if len(each) else 0
    for low, high in ((0, 16), (16, 64), (64, widest)):  # similar widths together
        some = np.flatnonzero((each > low) & (each <= high))
        for at in range(0, len(some), settings.batch):
            part = some[at:at + settings.batch]
            if high > 64:
                part_groups = [part[i:i + 1] for i in range(len(part))]
            else:
                part_groups = [part]
            for group in part_groups:
                wide = int(each[group].max())
                place = np.arange(wide)
                added = np.where(place < each[group][:, None], back[np.minimum(first[group][:, None] + place, len(back) - 1)], -1)
                added = np.where((added[:, :, None] == graph[targets[group]][:, None, :]).any(axis=2), -1, added)
                both = np.concatenate((graph[targets[group]], added), axis=1)
                near = norms[both] + norms[targets[group]][:, None] - 2 * np.einsum("bcd,bd->bc", x[both], x[targets[group]])
                graph[targets[group]] = prune(x, norms, both, np.maximum(near, 0), settings.degree, settings.relax)


def clean_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """row, vec_id and embedding (doubles) of the vectors that take part: not null, not zero, all components finite.

    ``row`` tells rows apart that repeat an id or have none; it holds once the result is written."""
    v = F.col("embedding")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("vec_id"),
                     F.col(embedding).cast("array<double>").alias("embedding"))
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return rows.where(v.isNotNull()).where(fine)


def _within_range(x: np.ndarray, largest: float) -> np.ndarray:
    """The vectors at a scale at which sums of squares are finite; nearness keeps its order."""
    return x if largest <= SAFE else x / (largest / SAFE)


def _distances(x: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances of (b, c, d) vectors from (b, d) queries; very large ones are scaled before they are squared."""
    apart = np.abs(x - queries[:, None])
    largest = apart.max(axis=2, initial=0.0)
    scale = np.where((largest > SAFE) & np.isfinite(largest), largest, 1.0)[:, :, None]
    return np.sqrt(((apart / scale) ** 2).sum(axis=2)) * scale[:, :, 0]


def build_index(vectors: DataFrame, shard_rows: int = 4096, settings: Settings = Settings()) -> DataFrame:
    """(shard, pos, node, vec_id, embedding, neighbours, entry): every vector in the graph of its shard.

    ``vectors`` is a written result of ``clean_vectors``. Equal vectors would only point at each other, so they are
    indexed once, as ``node`` (their least row) with their smallest id. Vectors of different lengths never share a shard."""
    distinct = stage(vectors.groupBy("embedding").agg(F.min("row").alias("node"), F.coalesce(F.min("vec_id"), F.lit(NO_ID)).alias("vec_id")))
    shards = max(1, math.ceil(distinct.count() / shard_rows))
    placed = distinct.select((F.size("embedding").cast("bigint") * shards + F.pmod(F.xxhash64("node"), F.lit(shards))).alias("shard"), "node", "vec_id", "embedding")
    schema = "shard bigint, pos int, node bigint, vec_id bigint, embedding array<double>, neighbours array<int>, entry boolean"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        n = table.num_rows
        x = table["embedding"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        graph, entry = build(_within_range(x, np.abs(x).max()), settings)
        marks = np.zeros(n, bool)
        marks[entry] = True
        rows = pa.FixedSizeListArray.from_arrays(pa.array(graph.astype(np.int32).ravel()), graph.shape[1]).cast(pa.list_(pa.int32()))
        return pa.table([table["shard"], pa.array(np.arange(n, dtype=np.int32)), table["node"], table["vec_id"], table["embedding"], rows, pa.array(marks)],
                        names=["shard", "pos", "node", "vec_id", "embedding", "neighbours", "entry"])

    return placed.groupBy("shard").applyInArrow(run, schema)


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 4096, settings: Settings = Settings()) -> DataFrame:
    """(query, node, vec_id, score): the ``k`` + 1 nearest indexed vectors that each shard's beam search finds for each query.

    ``query`` is the row of the query in ``queries`` (row, embedding), a part of a written ``clean_vectors``. A query is in one block of about ``query_block``; every shard meets every block, so no task holds all queries.
    Distances are computed anew in double precision from the given vectors."""
    blocks = max(1, math.ceil(queries.count() / query_block))
    numbered = queries.select(F.col("row").alias("query"), "embedding", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    shards = index.select(F.col("shard").alias("s"), F.size("embedding").alias("n")).distinct()  # one row per shard
    asked = numbered.join(F.broadcast(shards), F.size("embedding") == F.col("n")).select(
        F.col("s").alias("shard"), F.col("block").alias("part"), "query", F.col("embedding").alias("vector"))
    spread = index.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    schema = "query bigint, node bigint, vec_id bigint, score double"
    kinds = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        left = left.sort_by("pos").combine_chunks()
        n, m = left.num_rows, right.num_rows
        x = left["embedding"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        q = right["vector"].combine_chunks().flatten().to_numpy().reshape(m, -1)
        graph = left["neighbours"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        entry, names, asked_by = np.flatnonzero(left["entry"].to_numpy()), left["vec_id"].to_numpy(), right["query"].to_numpy()
        nodes, largest, out = left["node"].to_numpy(), max(np.abs(x).max(), np.abs(q).max()), []
        near_x, near_q = _within_range(x, largest), _within_range(q, largest)
        norms = (near_x ** 2).sum(axis=1)
        for at in range(0, m, settings.batch):
            ids, _ = search(near_x, norms, graph, entry, near_q[at:at + settings.batch], settings.search_beam)
            ids = ids[:, :4 * (k + 1)]
            exact = _distances(x[ids], q[at:at + settings.batch])
            order = np.lexsort((names[ids], exact, ids < 0), axis=1)[:, :k + 1]
            near, who = np.take_along_axis(exact, order, axis=1), np.take_along_axis(ids, order, axis=1)
            row, col = np.nonzero(who >= 0)
            found = who[row, col]
            out.append(pa.table([pa.array(asked_by[at + row]), pa.array(nodes[found]), pa.array(names[found]), pa.array(near[row, col])], schema=kinds))
        return pa.concat_tables(out)

    return spread.groupBy("shard", "block").cogroup(asked.groupBy("shard", "part")).applyInArrow(run, schema)


def nearest(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, k: int = 10, shard_rows: int = 4096,
            settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest other vectors found for each vector whose id ``every`` divides.

    Nearness is Euclidean distance, ties go to the smaller id, null ids come last. Every row but the query's own is a
    candidate: rows that repeat an id are neighbours of each other, a row without an id is found but asks nothing, and
    each row of a repeated id asks for itself. Copies of a vector are found with it: at most ``k`` + 1 of the smallest
    ids of equal vectors can be among the nearest, so no more are looked at. Null, zero and non-finite vectors take no
    part. Fewer candidates than ``k``: all of them. An empty table gives an empty result; other columns are not read."""
    vectors = stage(clean_vectors(df, vec_id, embedding))
    index = stage(build_index(vectors, shard_rows, settings))
    queries = vectors.where(F.col("vec_id") % every == 0)
    found = stage(search_index(index, queries, k, settings=settings))
    first = Window.partitionBy("query").orderBy("score", "vec_id", "node")
    top = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select(
        "query", "node", "score", F.when(F.col("vec_id") < NO_ID, F.col("vec_id")).alias("vec_id"))
    same = vectors.groupBy("embedding").agg(F.min("row").alias("node"), F.count("*").alias("n")).where("n > 1").select("node", "embedding")
    copy = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row")
    spread = vectors.join(same, "embedding").select("node", copy.alias("copy"))
    nth = F.row_number().over(Window.partitionBy("node", F.pmod(F.xxhash64("copy.row"), F.lit(64))).orderBy("copy"))
    few = spread.withColumn("n", nth).where(F.col("n") <= k + 1).groupBy("node").agg(F.slice(F.sort_array(F.collect_list("copy")), 1, k + 1).alias("copies"))
    # a vector without copies is its own node, so its id is that of the row
    single = F.array(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", F.col("node").alias("row")))
    widened = top.join(few, "node", "left").select("query", "score", F.explode(F.coalesce("copies", single)).alias("copy"))
    nearest_first = Window.partitionBy("query").orderBy("score", "copy")
    ranked = (widened.where(F.col("query") != F.col("copy.row")).withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k))
    return ranked.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select(
        "query_id", "rank", F.col("copy.vec_id").alias("vec_id"), "score")
