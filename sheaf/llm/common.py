"""Column expressions and helpers that several operators of this package use."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Only glibc has it; other allocators return free memory by themselves.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def without_spaces(text: Column) -> Column:
    """The text without any of the six ASCII space characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4. A null id is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def row_key(*columns: Column) -> Column:
    """One 128-bit key of several values, nulls included; rows equal in all of them share it."""
    shown = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    sized = [F.concat(F.length(s).cast("string"), F.lit(":"), s) for s in shown]
    return F.md5(F.concat(*sized))


def known_codes(values: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Position of each value in the distinct ``known``, those it lacks numbered on by first occurrence; and the latter.

    Only the distinct values are hashed and ``known`` is looked up among them, since it is much the larger."""
    coded = values.dictionary_encode()
    found = pc.index_in(known, value_set=coded.dictionary)
    at = np.full(len(coded.dictionary), -1)
    at[found.drop_null().to_numpy()] = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    missing = np.flatnonzero(at < 0)
    at[missing] = len(known) + np.arange(len(missing))
    return at[coded.indices.to_numpy()], coded.dictionary.take(pa.array(missing))


def give_back() -> None:
    """Return free memory to the system: workers live on, and what a batch took shouldn't stay with them."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
