"""Token ids of whole texts from a tokenizer file, pieced together from what each word gives.

Byte-level and word-end tokenizers of this kind never let a token hold a white space character behind another kind of
character, so a text may be cut before a space or line end (the exceptions, long runs of white space, are cut with
more care). Equal words give equal ids, so Arrow finds the distinct words of a batch and the tokenizer runs once for
each that the task hasn't met. The result equals that of the whole text (tested).
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sheaf.llm.common import give_back, known_codes

#: Where a text may be cut whatever surrounds it.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
SPACE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
#: Texts in which a cut before each space might fall inside a token.
RUNS = SPACE + "{3}|" + SPACE + r"{2}\z"
SEPARATORS = [chr(c) for c in (0, *range(1, 9), *range(14, 28), 127, *range(0xFDD0, 0xFDE0))]
#: Letters of one code point each that lower-casing and NFC leave or map one by one.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įıĲ-ƿ]+")
TAILS = frozenset(".,;:!?|")
#: Words kept per process, in Arrow memory; others are encoded again in the slices in which they occur.
WORDS_KEPT = 800_000
#: Bytes of text encoded at once.
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file, and whether it drops white space (word ends) or keeps it (byte level)."""

    path: str
    drops_space: bool


@lru_cache(maxsize=4)
def encoder(vocabulary: Vocabulary) -> "Encoder":
    """One encoder per process and tokenizer: words stay known from task to task."""
    return Encoder(vocabulary)


@lru_cache(maxsize=2)
def span_encoder(vocabulary: Vocabulary) -> "SpanEncoder":
    return SpanEncoder(vocabulary)


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a column of some megabytes each, or of a single longer text, with the row each starts at."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop
    give_back()


class Encoder:
    """Encodes columns of texts as the tokenizer does, strings of special tokens included; null counts as empty."""

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary.path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space = vocabulary.drops_space
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words are kept here
        self.words = pa.array([], pa.string())
        self.table, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.tails: dict[str, bytes] = {}
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_signs = {c: "".join(p for p, _ in shown.pre_tokenize_str(c)) for c in map(chr, range(33, 0x1C0)) if LETTERS.fullmatch(c)}

    def pieces(self, texts: pa.Array) -> pa.ListArray | None:
        """For each text the parts that may be encoded one by one; None if no separator is free."""
        found = next((s for s in SEPARATORS if not pc.any(pc.match_substring(texts, s)).as_py()), None)
        if found is None:
            return None
        if self.drops_space:
            marked = pc.replace_substring(pc.replace_substring(pc.ascii_lower(texts), "\n", found), " ", found)
            return pc.split_pattern(marked, found)
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", found + "\n"), " ", found + " ")
        odd = pc.match_substring_regex(texts, RUNS)
        if pc.any(odd).as_py():
            careful = [found.join(CUT.split(t)) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist())]
            marked = pc.if_else(odd, pa.array(careful, pa.string()), marked)
        return pc.split_pattern(marked, found)

    def _encode(self, part: str) -> bytes:
        """What the tokenizer gives for one part."""
        if not part:
            return b""
        core = part[:-1]
        if core and part[-1] in TAILS and (core[-1].isascii() and core[-1].isalpha() or LETTERS.fullmatch(core[-1])):
            return self._encode(core) + self._tail(part[-1])
        start, word = ("Ġ", part[1:]) if part[0] == " " and not self.drops_space else ("", part)
        if word.isascii() and word.isalpha():  # signs of these bytes are themselves; upper case is gone where it goes
            return array("I", [t.id for t in self.model.tokenize(start + word)]).tobytes()
        if LETTERS.fullmatch(word):
            signs = self.byte_signs
            shown = "".join([signs[c.lower()] for c in word] if self.drops_space else [signs[c] for c in word])
            return array("I", [t.id for t in self.model.tokenize(start + shown)]).tobytes()
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _tail(self, sign: str) -> bytes:
        if sign not in self.tails:
            self.tails[sign] = array("I", self.tokenizer.encode(sign, add_special_tokens=False).ids).tobytes()
        return self.tails[sign]

    def _apart(self, texts: pa.Array, one, many, width: int):
        """``many`` of the texts, those that hold a string of a special token through ``one``, each as a whole."""
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        found, at = many(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        if not odd.any():
            return found, at
        parts = [np.array(one(texts[i].as_py()), found.dtype).reshape((-1, width) if width > 1 else -1) if o else found[at[i]:at[i + 1]] for i, o in enumerate(odd.tolist())]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column in one array, and where each text's ids start (one more entry than texts)."""
        return self._apart(pc.fill_null(texts, ""), lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids, self._ids, 1)

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = self.pieces(texts)
        if parts is None:
            each = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, np.uint32), *each]), np.cumsum([0, *map(len, each)])
        code, _, table, counts, row_at = self._coded(parts)
        return table[_ragged(code, counts)], np.concatenate(([0], np.cumsum(counts[code])))[row_at]

    def _coded(self, parts: pa.ListArray, width: int = 1):
        """Code of each part, the words by code, the table of all codes, entries per code, and the parts before each text."""
        flat = parts.flatten()
        row_at = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))))
        code, new = known_codes(flat, self.words)
        words, table, counts = self.words, self.table, self.counts
        if len(new):
            learned = [self._encode(w) for w in new.to_pylist()]
            words = pa.concat_arrays([words, new])
            table = np.concatenate((table, np.frombuffer(b"".join(learned), np.uint32)))
            counts = np.concatenate((counts, np.fromiter(map(len, learned), np.int64, len(learned)) // (4 * width)))
            if len(self.words) < WORDS_KEPT:
                kept = min(len(words), WORDS_KEPT)
                self.words, self.counts = pa.concat_arrays([words.slice(0, kept)]), counts[:kept].copy()
                self.table = table[:int(self.counts.sum()) * width].copy()
        return code, words, table, counts, row_at


def _ragged(code: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions in a table of ``counts`` entries per code, for a sequence of codes."""
    first = np.cumsum(counts) - counts
    each = counts[code]
    ends = np.cumsum(each)
    return np.repeat(first[code] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)


class SpanEncoder(Encoder):
    """Gives the character span of every token of a byte-level tokenizer instead of its id."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.drops_space:
            raise ValueError("spans need a tokenizer that keeps white space")
        super().__init__(vocabulary)

    def _encode(self, part: str) -> bytes:
        if part.isascii() and part[-1:] in TAILS and part[-2:-1].isalpha():
            end = len(part)
            return self._encode(part[:-1]) + array("I", (end - 1, end)).tobytes()
        return array("I", [x for span in self.tokenizer.encode(part, add_special_tokens=False).offsets for x in span]).tobytes()

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, 2): first and past-the-last character of each token in its text, and where each text's tokens start.

        Tokens that hold parts of one character all span it."""
        return self._apart(pc.fill_null(texts, ""), lambda t: self.tokenizer.encode(t, add_special_tokens=False).offsets, self._spans, 2)

    def _spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = self.pieces(texts)
        if parts is None:
            each = [np.array(self.tokenizer.encode(t, add_special_tokens=False).offsets, np.int64).reshape(-1, 2) for t in texts.to_pylist()]
            return np.concatenate([np.empty((0, 2), np.int64), *each]), np.cumsum([0, *map(len, each)])
        code, words, table, counts, row_at = self._coded(parts, 2)
        chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        before = np.cumsum(chars) - chars
        texts_before = np.concatenate((before, [before[-1] + chars[-1] if len(before) else 0]))[row_at[:-1]]
        before = before - np.repeat(texts_before, np.diff(row_at))
        flat = table.reshape(-1, 2)[_ragged(code, counts)].astype(np.int64)
        return flat + np.repeat(before, counts[code])[:, None], np.concatenate(([0], np.cumsum(counts[code])))[row_at]
