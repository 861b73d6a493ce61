"""Prefix trie of conversations: members, children, leaves and saved tokens of every distinct run of first turns.

Turns are dictionary-encoded, conversations become sequences of ids and are range-partitioned in their order. Each
range shard builds a ternary search tree, its median sequence first, and sums up its nodes from the last made to the
first. Only prefixes of a shard's first or last sequence can occur in other shards too: they are boundary nodes, merged
by a key of their path. What lies beyond the turns that two conversations share is a path with one member, and needs no
tree; so a conversation that holds a third of all turns is never held whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from sheaf.llm.common import word_count
from sheaf.session import stage

#: Turns between the places at which it is looked up whether two conversations still agree.
STRIDE = 512
#: Turns in the sequences of one tree.
SHARD_TURNS = 1 << 18
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = ("kind int, depth bigint, conv_id bigint, parent_conv_id bigint, parent_key binary, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string, key binary, words bigint, spines array<bigint>")
CLOSED, BOUNDARY = 0, 1


class Tree:
    """Ternary search tree over sequences of ids; node 0 is the root, and a node is made after its parent."""

    def __init__(self):
        self.ids, self.low, self.high, self.first, self.parent, self.words = [0], [-1], [-1], [-1], [-1], [0]
        self.ends: dict[int, tuple] = {}

    def _make(self, id_: int, parent: int, words: int) -> int:
        for values, value in ((self.ids, id_), (self.low, -1), (self.high, -1), (self.first, -1), (self.parent, parent), (self.words, words)):
            values.append(value)
        return len(self.ids) - 1

    def add(self, ids: list[int], words: list[int], end: tuple) -> None:
        at, own, low, high, first = 0, self.ids, self.low, self.high, self.first
        for id_, w in zip(ids, words):
            links, place = first, at
            while (node := links[place]) >= 0 and own[node] != id_:
                links, place = (low if id_ < own[node] else high), node
            if node < 0:
                node = links[place] = self._make(id_, at, w)
            at = node
        self.ends[at] = end

    def path(self, ids: list[int]) -> list[int]:
        """The nodes of a sequence that has been added, the root first."""
        at, out = 0, [0]
        for id_ in ids:
            node = self.first[at]
            while self.ids[node] != id_:
                node = self.low[node] if id_ < self.ids[node] else self.high[node]
            at = node
            out.append(at)
        return out


def medians(n: int):
    """0 to n - 1, middles first."""
    spans = [(0, n)]
    for low, high in spans:  # grows meanwhile
        if low < high:
            middle = (low + high) // 2
            yield middle
            spans += ((low, middle), (middle + 1, high))


def shard_nodes(rows: list[dict], shard: int) -> list[tuple]:
    """NODE rows of the tree of distinct sequences in order; ``shard`` tells its spines from those of others."""
    tree = Tree()
    for i in medians(len(rows)):
        r = rows[i]
        tree.add(r["ids"], r["words"], (r["n"], r["least"], r["continues"], r["ends"]))
    n = len(tree.ids)
    members, least, children, leaves, saved, depth = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n, [0] * n
    spines = {}
    for side, r in enumerate((rows[0], rows[-1])):
        for node in tree.path(r["ids"]):
            spines.setdefault(node, []).append(2 * shard + side)
    for i in range(1, n):
        depth[i] = depth[tree.parent[i]] + 1
    for i in range(n - 1, -1, -1):
        count, smallest, continues, _ = tree.ends.get(i, (0, None, False, None))
        members[i] += count
        least[i] = smallest if least[i] is None or smallest is not None and smallest < least[i] else least[i]
        if continues:  # one leaf lies further down its own path
            children[i], leaves[i] = children[i] + 1, leaves[i] + 1
        if i not in spines:
            leaves[i] += not children[i]
            saved[i] += (members[i] - 1) * tree.words[i]
        if i:
            up = tree.parent[i]
            members[up] += members[i]
            least[up] = least[i] if least[up] is None or least[i] < least[up] else least[up]
            leaves[up] += leaves[i]
            saved[up] += saved[i]
            children[up] += i not in spines
    keys = {0: b""}
    for i in sorted(spines):
        if i:
            keys[i] = hashlib.md5(keys[tree.parent[i]] + tree.ids[i].to_bytes(8, "big", signed=True)).digest()
    out = []
    for i in range(n):
        up, ends = tree.parent[i], tree.ends.get(i, (0, None, False, None))[3] or NOBODY
        if i in spines:
            out.append((BOUNDARY, depth[i], least[i], None, keys[up] if i else None, members[i], children[i], leaves[i], saved[i], ends, keys[i], tree.words[i], spines[i]))
        else:
            inner = up not in spines
            out.append((CLOSED, depth[i], least[i], least[up] if inner else None, None if inner else keys[up], members[i], children[i], leaves[i], saved[i], ends, None, None, None))
    return out


def _positions(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``pos``, from 0 in each conversation, and ``turns``, how many it has.

    One sort of the whole table by ranges; a conversation over several of them meets as one row for each."""
    marked = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()))
    marked = marked.withColumn("part", F.shiftright("m", 33))
    runs = marked.groupBy("conv_id", "part").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                       F.sum("n").over(Window.partitionBy("conv_id")).alias("turns"))
    return marked.join(runs, ["conv_id", "part"]).withColumn("pos", F.col("m") - F.col("first") + F.col("before")).drop("m", "part", "first", "before")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, id, words), (conv_id, length)): conversations with the first turns of the first of their twenty.

    Of ``turns`` with pos and turns (from ``_positions``), written. As many first turns are replaced as the checksum of
    the id leaves when divided by 4. Twenties start at multiples of 20, of negative ids too."""
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % 4
    convs = turns.where("pos = 0").select("conv_id", "turns", head.alias("h"), (c - F.pmod(c, F.lit(20))).alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = stage(convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0)))))
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "id", "words")
    firsts = turns.where((F.col("pos") < 3) & (c % 20 == 0)).select(F.col("conv_id").alias("base"), "pos", "id", "words")
    heads = convs.where("taken > 0").join(firsts, "base").where("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "id", "words")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("h"))).alias("length"))
    return own.unionByName(heads), lengths


def _limits(rows: DataFrame, lengths: DataFrame, stride: int) -> DataFrame:
    """(conv_id, length, limit): the depth beyond which a conversation of more than ``stride`` turns shares none.

    Every ``stride`` turns the path so far has a key; where no other conversation has it, nothing further is shared."""
    long = lengths.where(F.col("length") >= stride)
    parts = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", (F.floor((F.col("depth") - 1) / stride) + 1).alias("k")).agg(
        F.expr("bit_xor(xxhash64(id, depth))").alias("x"), F.expr("bit_xor(xxhash64(depth, id, 1L))").alias("y"), F.count("*").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("k")
    keyed = parts.withColumns({"x": F.expr("bit_xor(x)").over(upto), "y": F.expr("bit_xor(y)").over(upto)}).where(F.col("n") == stride)
    shared = keyed.groupBy("k", "x", "y").agg(F.count("*").alias("of"), F.min("conv_id").alias("conv_id"))
    # a key of one conversation, the first on its path, is where sharing ends
    alone = shared.where("of = 1").groupBy("conv_id").agg((F.min("k") * stride).alias("limit"))
    return lengths.join(alone, "conv_id", "left").select("conv_id", "length", F.coalesce(F.least("limit", "length"), F.col("length")).alias("limit"))


def _ends(sequences: DataFrame) -> DataFrame:
    """(key, n, least, ends): of each distinct sequence its conversations, and the digest of their ids in order.

    A digest is a chain over all ids, so those of one sequence stream through one task, without being held."""
    def run(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != last:
                    if state:
                        out.append(state)
                    last, state = key, [key, 0, conv, hashlib.sha256()]
                state[3].update(f",{conv}".encode() if state[1] else str(conv).encode())
                state[1] += 1
            yield batch_of(out)
        if state:
            yield batch_of([state])

    def batch_of(states):
        cols = [[s[0] for s in states], [s[1] for s in states], [s[2] for s in states], [s[3].hexdigest() for s in states]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["key", "n", "least", "ends"])

    return sequences.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(
        run, "key string, n bigint, least bigint, ends string")


def _trees(distinct: DataFrame, shard_turns: int) -> DataFrame:
    """NODE rows of all shards: ranges of the sequences in order, cut where they exceed ``shard_turns``."""
    def run(batches):
        part, k, rows, held = TaskContext.get().partitionId() << 30, 0, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if rows and held + len(r["ids"]) > shard_turns:
                    yield from tables(shard_nodes(rows, part + k))
                    k, rows, held = k + 1, [], 0
                rows.append(r)
                held += len(r["ids"]) + 1
        if rows:
            yield from tables(shard_nodes(rows, part + k))

    def tables(nodes):
        types = [pa.int32(), *[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        names = [f.split()[0] for f in NODE.split(", ")]
        for at in range(0, len(nodes), 1 << 16):
            some = nodes[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], t) for i, t in enumerate(types)], names=names)

    place = F.slice("ids", 1, 64)
    return distinct.repartitionByRange(place).sortWithinPartitions("ids").mapInArrow(run, NODE)


def _merged(partial: DataFrame) -> DataFrame:
    """Boundary nodes over all shards, with what lies below them.

    Each boundary node counts once for all that lie above it: on the smallest of the spines it is on, of which the
    sums from the end up reach every node that the spine passes."""
    sums = partial.groupBy("key").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words"),
        F.max(F.when(F.col("ends_sha256") != NOBODY, F.col("ends_sha256"))).alias("ends"), F.min(F.array_min("spines")).alias("home"))
    below = sums.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    nodes = sums.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = stage(nodes.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0), "own": (F.col("n_convs") - 1) * F.col("words")}))
    at_home = F.col("spine") == F.col("home")
    placed = partial.select("key", F.explode("spines").alias("spine")).join(nodes.select("key", "depth", "leaf", "own", "home"), "key")
    up = Window.partitionBy("spine").orderBy(F.col("depth").desc())
    running = lambda c: F.sum(F.when(at_home, F.col(c)).otherwise(0)).over(up)
    reached = placed.select("key", running("leaf").alias("leaves"), running("own").alias("saved"))
    reached = reached.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return nodes.join(reached, "key").select(
        "key", "depth", "conv_id", "parent_key", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))


def encoded_turns(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, id, words): each distinct pair of role and text has one id."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.length(filled(role)).cast("string"), F.lit(":"), filled(role), filled(text)))
    rows = stage(df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), key.alias("turn_key"), word_count(filled(text)).alias("words")))
    dictionary = stage(rows.select("turn_key").distinct().withColumn("id", F.monotonically_increasing_id()))
    return rows.join(dictionary, "turn_key")


def prefix_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True,
                stride: int = STRIDE, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every trie node.

    Turns are taken in order of their number, null first, equal numbers by the MD5 of role and text; repeated rows are
    turns of their own; a null role or text is empty. ``rebuild`` first gives conversations the first turns of others.
    Rows with a null conv_id belong to no conversation and take no part. An empty table gives no node, not even a root.
    Texts of any length are read whole; other columns are not read. The turns that two conversations share, and up to
    ``stride`` more, must fit a task; what follows them need not."""
    turns = encoded_turns(df, conv_id, turn, role, text)
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("turn_key").asc()]
    turns = stage(_positions(turns, *order).drop("turn", "turn_key"))
    if rebuild:
        rows, lengths = rebuilt(turns)
    else:
        rows, lengths = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "id", "words"), turns.where("pos = 0").select("conv_id", F.col("turns").alias("length"))
    rows = stage(rows)
    limits = stage(_limits(rows, lengths, stride))
    reach = rows.join(limits, "conv_id")
    near = reach.where("depth <= limit").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "id", "words"))).alias("turns"))
    sequences = limits.join(near, "conv_id", "left").select(
        "conv_id", (F.col("length") > F.col("limit")).alias("continues"), F.coalesce("turns.id", F.array().cast("array<bigint>")).alias("ids"),
        F.coalesce("turns.words", F.array().cast("array<bigint>")).alias("words"))
    sequences = stage(sequences.withColumn("key", F.md5(F.array_join("ids", ","))))
    kinds = sequences.groupBy("key").agg(F.first("ids").alias("ids"), F.first("words").alias("words"), F.bool_or("continues").alias("continues"))
    ended = kinds.join(_ends(sequences), "key").select("ids", "words", "continues", "n", "least", F.when(~F.col("continues"), F.col("ends")).alias("ends"))
    nodes = stage(_trees(stage(ended), shard_turns))
    merged = stage(_merged(nodes.where(F.col("kind") == BOUNDARY)))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    above = merged.select(F.col("key").alias("above"), F.col("conv_id").alias("above_conv"))
    closed = nodes.where(F.col("kind") == CLOSED).select(*columns, "parent_key")
    inner = closed.where("parent_key IS NULL").select(*columns)
    outer = closed.where("parent_key IS NOT NULL").drop("parent_conv_id").unionByName(merged.drop("key"))
    outer = outer.join(above, F.col("parent_key") == F.col("above"), "left").withColumn("parent_conv_id", F.col("above_conv")).select(*columns)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tails = reach.where("depth > limit").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("depth") < F.col("length"), one).otherwise(none).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOBODY)).alias("ends_sha256"))
    return inner.unionByName(outer).unionByName(tails)
