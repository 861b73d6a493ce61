"""Numbers of fixed width for each white-space separated word of a column of texts, each distinct word computed once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sheaf.llm.common import known_codes

#: Words kept per process; others are computed again in the slices in which they occur.
WORDS_KEPT = 500_000


class WordScores:
    """``score`` maps a lower-cased word (with its punctuation; possibly empty) to ``width`` numbers, or ``many`` a list of
    words to as many rows of them."""

    def __init__(self, score: Callable[[str], Sequence[float]] | None, width: int, many: Callable[[list[str]], np.ndarray] | None = None):
        self.many, self.width = many or (lambda words: [score(w) for w in words]), width
        self.words, self.table = pa.array([], pa.string()), np.empty((0, width), np.float32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, width) numbers of all words in order, the words before each text (one more entry than texts), and
        codes by which equal words are known."""
        parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        row_at = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))))
        flat = parts.flatten()
        at, new = known_codes(flat, self.words)
        table = self.table
        if len(new):
            fresh = np.array(self.many(new.to_pylist()), np.float32).reshape(-1, self.width)
            table = np.concatenate((table, fresh))
            if len(self.table) < WORDS_KEPT:
                kept = min(len(table), WORDS_KEPT)
                self.words = pa.concat_arrays([pa.concat_arrays([self.words, new]).slice(0, kept)])
                self.table = table[:kept].copy()
        return table[at], row_at, at
