"""Repair of conversation structure: the cheapest edits that give role initials ``(s?(ua)+)?``, of equals the least audit.

Conversations are cut into chunks of consecutive turns wherever a block of the sorted table ends, so one that holds a
third of all turns is many chunks. Costs run backwards through a chunk from a vector of four costs, one for each state
after its last turn. For a chunk with turns behind it that vector is a guess; passes then run chunks again whose next
chunk found another vector, until vectors differ by constants only. What a few passes leave open is settled by the
chunks' whole min-plus matrices. With all vectors known, a chunk's letters follow from the state at its start, and these
states are stitched from what each chunk makes of all four.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sheaf.llm.common import SPACES
from sheaf.session import stage

START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: The state after an inserted or rerolled turn, by the state before it.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Costs of closing a conversation, by state.
CLOSING = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
OK, BLANK, DUPLICATE, CUT = range(4)

BLOCK_ROWS = 2048
BLOCK_BYTES = 8 << 20
PASSES = 4


def damage(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, n) after damage; nulls of role and text are one space, also in the drawn key."""
    c, t = F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn")
    shown = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(shown(F.col(conv_id)), F.lit(":"), shown(F.col(turn))).cast("binary")) % 20
    rows = df.select(c, t, shown(F.col(role)).alias("role"), shown(F.col(text)).alias("text"), draw.alias("draw")).where("draw <> 0")
    unended = rows["text"]
    for sign in ".!?":
        unended = F.replace(unended, F.lit(sign), F.lit(""))
    return rows.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, unended).otherwise(F.col("text")).alias("text"),
        F.when(F.col("draw") == 3, 2).otherwise(1).alias("n"))


def as_given(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    shown = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    return df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), shown(role).alias("role"), shown(text).alias("text"),
                     F.lit(1).alias("n"))


def back(end: tuple, initial: str, cut: bool) -> tuple:
    """Costs before a turn that may be kept, from those after it."""
    extra, kept = (TRUNCATED if cut else 0), KEPT.get(initial, {})
    x = [min(DELETE + end[s], REROLE + extra + end[NEXT[s]], extra + end[kept[s]] if s in kept else FAR) for s in range(4)]
    u, a = min(x[USER], INSERT + x[ASSISTANT]), min(x[ASSISTANT], INSERT + x[USER])
    return min(x[START], INSERT + u), min(x[SYSTEM], INSERT + u), u, a


def costs(turns: list[tuple[str, bool]], end: tuple) -> list[tuple]:
    """The cost vectors before each turn, and ``end`` after the last."""
    out = [tuple(end)]
    for initial, cut in reversed(turns):
        out.append(back(out[-1], initial, cut))
    return out[::-1]


def letters(turns: list[tuple[str, bool]], vectors: list[tuple], state: int) -> tuple[list[str], list[list[int]], int]:
    """The least cheapest edits of each turn, the states after each edit, and the state at the end."""
    out, states = [], []
    for i, (initial, cut) in enumerate(turns):
        here, after = vectors[i], vectors[i + 1]
        extra, kept = (TRUNCATED if cut else 0), KEPT.get(initial, {})
        word, passed = "", []
        while True:
            if DELETE + after[state] == here[state]:
                word += "D"
            elif INSERT + here[NEXT[state]] == here[state]:
                word, state = word + "I", NEXT[state]
                passed.append(state)
                continue
            elif state in kept and extra + after[kept[state]] == here[state]:
                word, state = word + "K", kept[state]
            else:
                word, state = word + "R", NEXT[state]
            passed.append(state)
            break
        out.append(word)
        states.append(passed)
    return out, states, state


def _like(v) -> tuple:
    """A vector less its smallest entry."""
    least = min(v)
    return tuple(x - least for x in v)


def _last(text: Column) -> Column:
    return F.rtrim(text, F.lit("".join(SPACES)))


def _blocks(rows: DataFrame) -> DataFrame:
    """The sorted rows with ``m`` (their order) and ``block``, a stretch of bounded rows and bytes of one partition."""
    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.LongType()), T.StructField("m", T.LongType())])

    def run(batches):
        part, k, n, size, m = TaskContext.get().partitionId() << 32, 0, 0, 0, 0
        for batch in batches:
            block = []
            for width in pc.binary_length(batch.column("text")).to_pylist():
                if n >= BLOCK_ROWS or n and size + width > BLOCK_BYTES:
                    k, n, size = k + 1, 0, 0
                n, size = n + 1, size + width
                block.append(part + k)
            order = pa.array(range(part + m, part + m + len(block)), pa.int64())
            m += len(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64()), order], names=schema.names)

    return rows.mapInArrow(run, schema)


def _pieces(table: pa.Table):
    """(conversation, rows) of consecutive rows of a block, sorted by ``m``."""
    rows = table.sort_by("m").to_pylist()
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end]["conv_id"] == rows[at]["conv_id"]:
            end += 1
        yield rows[at]["conv_id"], rows[at:end]
        at = end


def _free(rows: list[dict]) -> list[tuple[str, bool]]:
    return [(r["initial"], r["kind"] == CUT) for r in rows if r["kind"] in (OK, CUT)]


def _chunk_runs(rows: DataFrame, kind: str, make) -> DataFrame:
    """``made``, what ``make(free turns, vector)`` gives for each chunk of ``rows``, which carry the chunk's ``vector``."""
    def run(table: pa.Table) -> pa.Table:
        out = [(conv, mine[0]["block"], make(_free(mine), mine[0]["vector"])) for conv, mine in _pieces(table)]
        return pa.table([pa.array([o[0] for o in out], table.schema.field("conv_id").type), pa.array([o[1] for o in out], pa.int64()),
                         pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["conv_id", "block", "made"])

    schema = f"conv_id {kind}, block bigint, made array<bigint>"
    return rows.groupBy("block").applyInArrow(run, schema)


def _with(rows: DataFrame, more: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by conversation (a null one too) and block."""
    other = more.withColumnsRenamed({"conv_id": "__c", "block": "__b"})
    return rows.join(other, (F.col("block") == F.col("__b")) & F.col("conv_id").eqNullSafe(F.col("__c")), how).drop("__c", "__b")


def _settled(free: DataFrame, chunks: DataFrame, kind: str, passes: int) -> DataFrame:
    """(conv_id, block, vector): the costs after each chunk up to a constant, exact after the last of a conversation."""
    order = Window.partitionBy("conv_id").orderBy("block")
    closing = F.array(*[F.lit(x).cast("bigint") for x in CLOSING])
    forward = lambda turns, v: list(_like(costs(turns, tuple(v))[0]))
    state = chunks.select("conv_id", "block", closing.alias("vector"))
    state = stage(_with(state, _chunk_runs(_with(free, state), kind, forward)))
    for _ in range(passes):
        found = state.withColumn("next", F.coalesce(F.lead("made").over(order), closing))
        open_ = stage(found.where("next <> vector").select("conv_id", "block", F.col("next").alias("vector")))
        if open_.isEmpty():
            return state.select("conv_id", "block", "vector")
        fixed = _with(open_, _chunk_runs(_with(free, open_), kind, forward))
        state = stage(_with(state, open_.select("conv_id", "block"), "left_anti").unionByName(fixed))

    def matrix(turns, v):
        units = [tuple(0 if s == t else FAR for t in range(4)) for s in range(4)]
        return [min(x, FAR) for u in units for x in costs(turns, u)[0]]

    def fold(table: pa.Table) -> pa.Table:
        vector, out = CLOSING, []
        for made in reversed(table.sort_by("block")["made"].to_pylist()):
            out.append(list(vector))
            vector = _like([min(made[4 * s + t] + vector[s] for s in range(4)) for t in range(4)])
        table = table.sort_by("block")
        return pa.table([table["conv_id"], table["block"], pa.array(out[::-1], pa.list_(pa.int64()))], names=["conv_id", "block", "vector"])

    still = state.withColumn("next", F.coalesce(F.lead("made").over(order), closing)).where("next <> vector").select("conv_id").distinct()
    still = still.select(F.col("conv_id").alias("__c"))
    same = F.col("conv_id").eqNullSafe(F.col("__c"))
    whole = stage(_chunk_runs(_with(free, state.join(still, same, "left_semi").select("conv_id", "block", "vector")), kind, matrix))
    exact = whole.groupBy("conv_id").applyInArrow(fold, f"conv_id {kind}, block bigint, vector array<bigint>")
    return state.join(still, same, "left_anti").select("conv_id", "block", "vector").unionByName(exact)


def _entries(free: DataFrame, pieces: DataFrame, vectors: DataFrame, kind: str) -> DataFrame:
    """``pieces`` (conv_id, block, last) of conversations of several blocks with vector and the state at their start."""
    exits = _chunk_runs(_with(free, vectors), kind, lambda turns, v: [letters(turns, costs(turns, tuple(v)), s)[2] for s in range(4)])

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        state, out = START, []
        for made in table["made"].to_pylist():
            out.append(state)
            state = made[state] if made else state
        return table.select(["conv_id", "block", "last", "vector"]).append_column("entry", pa.array(out, pa.int32()))

    known = _with(_with(pieces, vectors, "left"), exits, "left")
    return known.groupBy("conv_id").applyInArrow(fold, f"conv_id {kind}, block bigint, last boolean, vector array<bigint>, entry int")


def _edited(rows: list[dict], vector, entry: int, last: bool) -> tuple[int, str, list[str], int]:
    """(cost, audit, repaired lines, pairs of neighbours that don't alternate) of one piece."""
    turns = _free(rows)
    words, states, state = letters(turns, costs(turns, tuple(vector)), entry)
    audit, lines, cost, at, illegal, before = [], [], 0, 0, 0, None
    for r in rows:
        initial, n = r["initial"], r["n"]
        illegal += (before is not None and before + initial not in ("su", "ua", "au")) + n - 1
        before = initial
        if r["kind"] in (OK, CUT):
            for letter, now in zip(words[at], states[at] + [None]):
                if letter == "I":
                    lines.append(NAMES[now] + ":")
                    cost += INSERT
                elif letter == "D":
                    cost += DELETE
                else:
                    role = r["role"] if letter == "K" else NAMES[now]
                    lines.append(f"{role}:{r['text']}")
                    cost += (REROLE if letter == "R" else 0) + (TRUNCATED if r["kind"] == CUT else 0)
            audit.append(words[at])
            at += 1
            n -= 1
        audit.append("D" * n)
        cost += DELETE * n
    while last and CLOSING[state]:
        state = NEXT[state]
        audit.append("I")
        lines.append(NAMES[state] + ":")
        cost += INSERT
    return cost, "".join(audit), lines, illegal


def _finished(pieces: DataFrame, kind: str) -> DataFrame:
    """One row per conversation of several pieces; its rows stream by in order, since a digest is a chain over all its text."""
    names = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        conv, open_ = None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if open_ is None or r["conv_id"] != conv:
                    if open_ is not None:
                        done.append(open_)
                    conv, open_ = r["conv_id"], {"conv_id": r["conv_id"], "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "any": False, "tail": None}
                open_["illegal"] += r["illegal"] + (open_["tail"] is not None and open_["tail"] + r["head"] not in ("su", "ua", "au"))
                open_["tail"] = r["tail"]
                open_["cost"] += r["cost"]
                open_["audit"].append(r["audit"])
                if r["repaired"] is not None:
                    open_["hash"].update((b"\n" if open_["any"] else b"") + r["repaired"])
                    open_["any"] = True
            yield batch_of(done, batch.schema.field("conv_id").type)
        if open_ is not None:
            yield batch_of([open_], batch.schema.field("conv_id").type)

    def batch_of(done, conv_type):
        values = [(d["conv_id"], d["illegal"], d["cost"], "".join(d["audit"]), d["hash"].hexdigest()) for d in done]
        types = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], t) for i, t in enumerate(types)], names=names)

    slim = pieces.select("conv_id", "block", "illegal", "cost", "audit", "head", "tail", "repaired")
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        run, f"conv_id {kind}, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def _edits(blocked: DataFrame, turns: DataFrame, kind: str) -> DataFrame:
    """One row per piece: its share of cost and audit, and the repaired text or, of a whole conversation, its digest."""
    conv = blocked.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {conv}, block bigint, split boolean, illegal bigint, cost bigint, audit string, head string, tail string, repaired binary, "
              "repaired_sha256 string")
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = {r["m"]: r for r in left.to_pylist()}
        out = []
        for c, rows in _pieces(right):
            for r in rows:
                r.update(role=texts[r["m"]]["role"], text=texts[r["m"]]["text"])
            split = rows[0]["entry"] is not None
            cost, audit, lines, illegal = _edited(rows, rows[0]["vector"] or CLOSING, rows[0]["entry"] or START, rows[0]["last"] or not split)
            whole = "\n".join(lines).encode()
            out.append((c, rows[0]["block"], split, illegal, cost, audit, rows[0]["initial"], rows[-1]["initial"],
                        whole if split and lines else None, None if split else hashlib.sha256(whole).hexdigest()))
        kinds = [right.schema.field("conv_id").type, *types]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)],
                        names=["conv_id", "block", "split", "illegal", "cost", "audit", "head", "tail", "repaired", "repaired_sha256"])

    texts = blocked.select("block", "m", "role", "text")
    return texts.groupBy("block").cogroup(turns.groupBy("block")).applyInArrow(run, schema)


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damaged: bool = False,
           passes: int = PASSES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    Turns are taken in order of their number, null first, equal numbers by the MD5 of role and text; equal rows are
    neighbours and count as often as they occur. A null role or text is one space (such a role can't be kept, such a
    text is blank); a null conv_id is a conversation of its own. Turns of any length are digested whole. ``damaged``
    first damages rows by a hash of conversation and turn; a conversation that this leaves without turns has zeros, an
    empty audit and the digest of an empty text. An empty table gives an empty result. Other columns are not read.

    The digest of a conversation is a chain over its text, so the pieces of one conversation end in one task, in order
    and without being held; everything before that is spread over blocks of at most 2048 turns."""
    ends = _last(F.col("text"))
    fault = F.when(ends == "", BLANK).when(~F.substring(ends, -1, 1).isin(".", "!", "?"), CUT).otherwise(OK)
    given = (damage if damaged else as_given)(df, conv_id, turn, role, text)
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    rows = given.withColumn("key", key).groupBy("conv_id", "turn", "key").agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.sum("n").cast("int").alias("n"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "key")]
    blocked = stage(_blocks(rows.repartitionByRange(*order).sortWithinPartitions(*order)))
    kind = blocked.schema["conv_id"].dataType.simpleString()
    slim = blocked.select("block", "m", "conv_id", "turn", "key", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    firsts = slim.groupBy(F.col("conv_id").alias("__c"), F.col("key").alias("__k")).agg(F.min("m").alias("__m"))
    turns = slim.join(firsts.select("__m"), F.col("m") == F.col("__m"), "left")
    turns = stage(turns.withColumn("kind", F.when(F.col("fault") == BLANK, BLANK).when(F.col("__m").isNull(), DUPLICATE).otherwise(F.col("fault")))
                  .drop("__m", "fault"))
    once = F.when(F.col("kind") == DUPLICATE, F.col("n")).when(F.col("kind") == BLANK, 0).otherwise(F.col("n") - 1)
    counts = turns.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(F.col("kind") == BLANK, F.col("n")).otherwise(0)).alias("blank"), F.sum(once).alias("duplicate"),
        F.sum(F.when(F.col("kind") == CUT, 1).otherwise(0)).alias("truncated"))
    own = Window.partitionBy("conv_id")
    pieces = turns.groupBy("conv_id", "block").agg(F.max(F.when(F.col("kind").isin(OK, CUT), 1).otherwise(0)).alias("free"))
    split = stage(pieces.withColumns({"of": F.count("*").over(own), "last": F.max("block").over(own) == F.col("block")}).where("of > 1"))
    free = turns.where(F.col("kind").isin(OK, CUT))
    vectors = stage(_settled(free, split.where("free = 1"), kind, passes))
    entries = stage(_entries(free, split.select("conv_id", "block", "last"), vectors, kind))
    edits = stage(_edits(blocked, _with(turns.drop("turn", "key"), entries, "left"), kind))
    done = edits.where("not split").select("conv_id", "illegal", "cost", "audit", "repaired_sha256").unionByName(
        _finished(edits.where("split"), kind))
    found = counts.join(done.withColumnRenamed("conv_id", "__c"), F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    every = df.select(F.col(conv_id).alias("__all")).distinct()
    out = every.join(found, F.col("__all").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("__all", "conv_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
