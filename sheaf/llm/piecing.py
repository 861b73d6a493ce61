"""SentencePiece ids of whole texts for merge-type (BPE) vocabularies, and texts of ids.

The symbols of a text start as its characters. An agenda holds every adjacent pair of symbols that is a piece, best
score first, then leftmost; the first entry that still stands is merged and its new neighbours join the agenda. Where no
piece of the vocabulary holds a white space mark behind another character, nothing merges across that border, so a text
is cut there and equal parts are computed once per process. Every part met for the first time is compared with what the
sentencepiece library makes of it, batch by batch; a difference stops the job.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sheaf.llm.tokenizing import SEPARATORS, _ragged, slices

MARK = "▁"
#: Parts kept per process, and their bytes; others are computed again in the slices in which they occur.
PARTS_KEPT, BYTES_KEPT = 800_000, 32 << 20
# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
BPE = 2
#: Characters of a part whose agenda is kept as a list.
SHORT = 32
NEVER = float("inf")


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of an encoded protocol buffer message."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = message[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = message[at:at + size], at + size
        else:
            width = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if kind == 1 else "<f", message[at:at + width])[0], at + width
        yield tag >> 3, value


class Pieces:
    """A model file as tables: the score of each piece that may be merged, ids, bytes, and how texts are normalised."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.own: dict[str, int] = {}  # ids of pieces that texts can hold
        self.kinds, names = [], []
        trainer, normalizer = {}, {3: 1, 4: 1, 5: 1}
        for number, value in _fields(self.library.serialized_model_proto()):
            if number == 1:
                piece = dict(_fields(value))
                name, kind = piece.get(1, b"").decode(), piece.get(3, NORMAL)
                if kind in (NORMAL, USER_DEFINED, UNUSED):
                    self.scores[name], self.own[name] = piece.get(2, 0.0), len(names)
                self.kinds.append(kind)
                names.append(name)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer |= dict(_fields(value))
        if trainer.get(3, 1) != BPE:
            raise ValueError("the vocabulary is not of the merge type")
        self.costs = {p: -x for p, x in self.scores.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.unused = {p for p, i in self.own.items() if self.kinds[i] == UNUSED}
        self.bytes_at = {int(n[3:5], 16): i for i, n in enumerate(names) if self.kinds[i] == BYTE}
        self.byte_fallback = bool(trainer.get(35)) and len(self.bytes_at) == 256
        defined = sorted((p for p, i in self.own.items() if self.kinds[i] == USER_DEFINED), key=len, reverse=True)
        self.defined = re.compile("|".join(map(re.escape, defined))) if defined else None
        self.prefixed = bool(normalizer[3])
        self.strips = bool(normalizer[3] or normalizer[4])
        #: Texts are normalised by marking their spaces alone.
        self.plain = not normalizer.get(2) and bool(normalizer[3] and normalizer[5]) and not normalizer[4] and not trainer.get(24)
        #: Nothing merges across the border before a mark.
        self.cuts = self.plain and self.byte_fallback and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.own)
        surface = (trainer.get(44) or " ⁇ ".encode()).decode()
        self.shown = [("" if k == CONTROL else surface if k == UNKNOWN else n.replace(MARK, " ")).encode() for n, k in zip(names, self.kinds)]
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        for i, b in self.byte_of.items():
            self.shown[i] = bytes([b])
        self.shown = pa.array(self.shown, pa.binary())
        self.marked = np.array([n.startswith(MARK) and k not in (CONTROL, UNKNOWN, BYTE) for n, k in zip(names, self.kinds)])
        self.silent = np.array([k == CONTROL for k in self.kinds])
        self.is_byte = np.array([k == BYTE for k in self.kinds])

    def merged(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        if len(text) <= SHORT and not self.unused and self.defined is None:
            out: list[int] = []
            for s in self._short(text):
                self._place(s, {}, out)
            return out
        frozen: set[int] = set()
        if self.defined is None:
            symbols = list(text)
        else:
            symbols, done = [], 0
            for m in self.defined.finditer(text):
                symbols += text[done:m.start()]
                frozen.add(len(symbols))
                symbols.append(m[0])
                done = m.end()
            symbols += text[done:]
        n, scores = len(symbols), self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        halves: dict[str, tuple[str, str]] = {}
        agenda = []

        def entry(left: int, right: int):
            if left < 0 or right >= n or left in frozen or right in frozen:
                return None
            piece = symbols[left] + symbols[right]
            score = scores.get(piece)
            if score is None:
                return None
            if piece in self.unused:
                halves[piece] = symbols[left], symbols[right]
            return -score, left, right, piece

        agenda = [e for i in range(n - 1) if (e := entry(i, i + 1))]
        heapify(agenda)
        while agenda:
            _, left, right, piece = heappop(agenda)
            if symbols[left] is None or after[left] != right or symbols[right] is None or symbols[left] + symbols[right] != piece:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = piece, None
            after[left] = following = after[right]
            if following < n:
                before[following] = left
            for e in (entry(before[left], left), entry(left, following)):
                if e:
                    heappush(agenda, e)
        out = []
        for s in symbols:
            if s is not None:
                self._place(s, halves, out)
        return out

    def _short(self, text: str) -> list[str]:
        """As ``merged`` with the agenda as a list in text order, of which the best entry is looked for."""
        symbols, get = list(text), self.costs.get
        agenda = [get(a + b, NEVER) for a, b in zip(text, text[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], NEVER)
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], NEVER)
        return symbols

    def _place(self, symbol: str, halves: dict, out: list[int]) -> None:
        if not halves and symbol in self.own:
            out.append(self.own[symbol])
            return
        stack = [symbol]
        while stack:
            s = stack.pop()
            if s in self.unused and s in halves:  # unused pieces fall back to what they were merged from
                stack += reversed(halves[s])
            elif (at := self.own.get(s)) is not None:
                out.append(at)
            elif self.byte_fallback:
                out += [self.bytes_at[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:  # neighbouring unknown symbols are one
                out.append(self.unknown)

    def decoded(self, ids: pa.Array) -> pa.Array:
        """The texts of a column of lists of ids; null counts as no ids. Bytes that are no UTF-8 give U+FFFD each."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.kinds)):
            raise ValueError("an id is not in the vocabulary")
        ends = np.cumsum(sizes)
        taken = self.shown.take(pa.array(flat, pa.int32()))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[:len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        data = memoryview(taken.buffers()[2] or b"")
        parted = bool(self.silent[flat].any())  # such ids end a run of byte pieces
        out = []
        for n, end in zip(sizes.tolist(), ends.tolist()):
            start = end - n
            lo, hi = int(offsets[start]), int(offsets[end])
            if self.strips and n:
                first = start
                while first < end - 1 and self.silent[flat[first]]:
                    first += 1
                lo += bool(self.marked[flat[first]])
            try:
                shown = bytes(data[lo:hi]).decode()
            except UnicodeDecodeError:  # runs of byte pieces that are no text
                shown = None
            if shown is None or parted and self.silent[flat[start:end]].any():
                shown = self._with_bytes(flat[start:end])
            out.append(shown)
        return pa.array(out, pa.string())

    def _with_bytes(self, ids: np.ndarray) -> str:
        out, run, opening = [], bytearray(), self.strips
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run, opening = bytearray(), False
            if i is not None:
                shown = self.shown[i].as_py().decode()
                out.append(shown[1:] if opening and self.marked[i] else shown)
                opening = opening and not self.marked[i] and not shown
        return "".join(out)


def _lenient(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for width in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + width].decode())
                    at += width
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Encoder:
    """Encodes columns of texts; ``check`` compares each newly met part (or text) with the library."""

    def __init__(self, path: str, check: bool = True):
        self.pieces, self.check = Pieces(path), check
        self.parts, self.table, self.counts = pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.int64)

    def _fresh(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts that start with a mark; the library sets the first mark itself, but none before an empty text."""
        ids = [self.pieces.merged(p) for p in parts]
        if self.check:
            given = self.pieces.library.encode([p[1:] for p in parts], num_threads=1)
            for part, mine, theirs in zip(parts, ids, given):
                if mine != theirs and part != MARK:
                    raise AssertionError(f"{part!r} gives {mine}, the library {theirs}")
        return ids

    def _cut(self, texts: pa.Array) -> pa.ListArray | None:
        found = next((s for s in SEPARATORS if not pc.any(pc.match_substring(texts, s)).as_py()), None)
        if found is None:
            return None
        marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK), MARK, found + MARK)
        runs = pc.replace_substring(pc.binary_join_element_wise(found + MARK, marked, ""), MARK + found, MARK)
        filled = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", runs)  # an empty text has no prefix either
        return pc.split_pattern(filled, found)  # the part before the first separator is empty

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column in one array, and where each text's ids start (one more entry than texts)."""
        texts = pc.fill_null(texts, "")
        parts = self._cut(texts) if self.pieces.cuts else None
        if parts is None:
            each = [self._whole(t) for t in texts.to_pylist()]
            return np.array([i for e in each for i in e], np.int32), np.cumsum([0, *map(len, each)])
        flat = parts.flatten()
        row_at = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))))
        code = pc.index_in(flat, value_set=self.parts)
        table, counts = self.table, self.counts
        if code.null_count:
            unknown = pc.is_null(code)
            new = flat.filter(unknown).dictionary_encode()
            words = new.dictionary.to_pylist()
            learned = iter(self._fresh([w for w in words if w]))
            learned = [next(learned) if w else [] for w in words]
            at = code.fill_null(0).to_numpy(zero_copy_only=False).copy()
            at[unknown.to_numpy(zero_copy_only=False)] = new.indices.to_numpy() + len(counts)
            table = np.concatenate((table, np.array([i for e in learned for i in e], np.int32)))
            counts = np.concatenate((counts, np.fromiter(map(len, learned), np.int64, len(learned))))
            if len(self.parts) < PARTS_KEPT and self.parts.nbytes < BYTES_KEPT:
                kept = min(len(counts), PARTS_KEPT)
                self.parts = pa.concat_arrays([pa.concat_arrays([self.parts, new.dictionary]).slice(0, kept)])
                self.counts = counts[:kept].copy()
                self.table = table[:int(self.counts.sum())].copy()
        else:
            at = code.to_numpy(zero_copy_only=False)
        return table[_ragged(at, counts)], np.concatenate(([0], np.cumsum(counts[at])))[row_at]

    def _whole(self, text: str) -> list[int]:
        if self.pieces.plain:
            normal = MARK + text.replace(" ", MARK) if text else ""
        else:
            normal = self.pieces.library.normalize(text)
        ids = self.pieces.merged(normal)
        if self.check and ids != (theirs := self.pieces.library.encode(text)):
            raise AssertionError(f"{text[:80]!r} gives {ids[:20]}, the library {theirs[:20]}")
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, check: bool = True) -> Encoder:
    """One encoder per process and model: parts stay known from task to task."""
    return Encoder(path, check)


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False, check: bool = True) -> DataFrame:
    """``keep`` columns and ``ids`` (array<int>) of every row, with ``decoded`` also the text that these ids give.

    No begin or end ids are added. Null texts count as empty and have no ids; texts of any length are encoded whole;
    repeated rows each give a row, an empty table gives an empty result. Columns that aren't kept are not read, so their
    names cannot clash."""
    slim = df.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = [*slim.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + ([T.StructField("decoded", T.StringType())] if decoded else []))

    def run(batches):
        e = encoder(path, check)
        for batch in batches:
            for at, texts in slices(batch.column(batch.num_columns - 1)):
                ids, starts = e.ids(texts)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                more = [e.pieces.decoded(lists)] if decoded else []
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(texts)) for c in batch.columns[:-1]], lists, *more], names=schema.names)

    return slim.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the text of the ids of every row; null ids count as none, unknown ids fail the job."""
    slim = df.select(*keep, F.col(ids).cast("array<int>").alias("__ids"))
    schema = T.StructType([*slim.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        e = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], e.pieces.decoded(batch.column(batch.num_columns - 1))], names=schema.names)

    return slim.mapInArrow(run, schema)
