"""Toxicity of whole texts: bags of subword vectors, averaged, under a linear softmax, trained jointly in numpy.

A text is read in overlapping windows of a few words, so that one insult in a long text isn't averaged away: each
window is a bag, and the text is as toxic as its most toxic window. Since averaging and the softmax are linear up to
the end, a trained model is one number per subword bucket.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sheaf.llm.tokenizing import slices
from sheaf.llm.wordscores import WordScores

BUCKETS, DIMENSIONS = 1 << 18, 12
NGRAMS = (3, 4, 5)
WINDOW, STRIDE = 8, 4
THRESHOLD = 0.3
#: Windows judged at once in training.
WINDOWS_AT_ONCE = 1 << 15
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def subwords(word: str) -> list[int]:
    """Buckets of a word's character n-grams and of the word itself; none for a word without letter or digit."""
    word = EDGES.sub("", word)
    if not word:
        return []
    padded = f"<{word}>"
    if padded.isascii():
        raw = padded.encode()
        return [zlib.crc32(raw[i:i + n]) % BUCKETS for n in NGRAMS for i in range(len(raw) - n + 1)] + [zlib.crc32(raw) % BUCKETS]
    grams = [padded[i:i + n] for n in NGRAMS for i in range(len(padded) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in (*grams, padded)]


@dataclass
class Model:
    """``weights`` of the buckets in the difference of the two logits, its ``bias``, and the share of toxic rows."""

    weights: np.ndarray
    bias: float
    base: float

    def piece(self, piece: str) -> tuple[float, float]:
        own = subwords(piece)
        return (float(self.weights[own].sum()), float(len(own))) if own else (0.0, 0.0)

    def score(self, values: np.ndarray, row_at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Score of each text from the numbers of its words; the base rate for texts without words."""
        fresh = _fresh(codes, row_at)
        values = np.column_stack((values.astype(np.float64), fresh))
        values[~fresh, 0] = 0
        logits, rows = _windows(values, row_at, self.bias)
        out = np.full(len(row_at) - 1, self.base)
        if len(logits):
            best = np.full(len(out), -np.inf)
            np.maximum.at(best, rows, logits)
            filled = np.isfinite(best)
            out[filled] = 1 / (1 + np.exp(-np.clip(best[filled], -500, 500)))
        return out


def _fresh(codes: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Words that none of the few words before repeats: only these speak in a window, though all weigh in its mean."""
    fresh = np.ones(len(codes), bool)
    place = np.arange(len(codes)) - np.repeat(row_at[:-1], np.diff(row_at))
    for back in range(1, min(WINDOW, len(codes))):
        fresh[back:] &= (codes[back:] != codes[:-back]) | (place[back:] < back)
    return fresh


def _window_starts(row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last word of every window, and its text."""
    sizes = np.diff(row_at)
    each = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1) * (sizes > 0)
    rows = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each)
    starts = row_at[rows] + nth * STRIDE
    return starts, np.minimum(starts + WINDOW, row_at[rows + 1]), rows


def _windows(values: np.ndarray, row_at: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = _window_starts(row_at)
    total = np.concatenate((np.zeros((1, 3)), np.cumsum(values, axis=0, dtype=np.float64)))
    sums = total[ends] - total[starts]
    filled = (sums[:, 1] > 0) & (sums[:, 2] > 0)  # a window that only repeats says nothing new
    return sums[filled, 0] / sums[filled, 1] + bias, rows[filled]


def _differences(sums: np.ndarray, sequence: np.ndarray, fresh: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean of what the fresh words of each window speak, less the bias; -inf for a window that says nothing new. A
    bounded run of windows at a time, since the numbers of all words at once would take the driver's memory."""
    out = np.empty(len(starts))
    for at in range(0, len(starts), WINDOWS_AT_ONCE):
        low, high = starts[at], ends[at:at + WINDOWS_AT_ONCE].max()
        new = fresh[low:high]
        spoken = np.column_stack((sums[sequence[low:high]], new))
        spoken[~new, 0] = 0
        total = np.concatenate((np.zeros((1, 3)), np.cumsum(spoken, axis=0)))
        spread = total[ends[at:at + WINDOWS_AT_ONCE] - low] - total[starts[at:at + WINDOWS_AT_ONCE] - low]
        out[at:at + WINDOWS_AT_ONCE] = np.where((spread[:, 1] > 0) & (spread[:, 2] > 0), spread[:, 0] / np.maximum(spread[:, 1], 1), -np.inf)
    return out


def train(texts: Iterable[str], labels: np.ndarray, base: float, epochs: int = 8, batch: int = 256, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit vectors, softmax weights and biases together by Adagrad on cross-entropy.

    Every epoch each text gives the window that is most toxic under the model so far, with the text's label, and each
    clean text a random one besides; every batch also holds empty bags as clean, so that a window with little to say
    scores low. At first, toxic texts give the window around the word that speaks most for
    toxic texts by how many texts of either kind hold its subwords."""
    rng = np.random.default_rng(seed)
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(w, len(words)) for w in t.lower().split()], np.int32) for t in texts]
    buckets, sizes = array("i"), array("i")  # plain numbers: lists of them would take the driver's memory
    for word in words:
        own = subwords(word)
        buckets.extend(own)
        sizes.append(len(own))
    flat, counts = np.array(buckets, np.int32), np.array(sizes, np.int64)
    del words, buckets, sizes
    first = np.cumsum(counts) - counts
    row_at = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    sequence = np.concatenate([np.empty(0, np.int32), *docs])
    starts, ends, rows = _window_starts(row_at)
    fresh = _fresh(sequence, row_at)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    out[1], out[0] = 1.0, -1.0
    seen_v, seen_o, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full(out.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    if not len(rows) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((base + 1e-3) / (1 - base + 1e-3))), base)
    telling, texts_read, some = _telling(docs, labels, flat, first, counts), len(docs), np.flatnonzero(counts)
    del docs

    for epoch in range(epochs):
        if epoch == 0:
            held = np.append(telling[sequence], -np.inf)
            logits = np.maximum.reduceat(held, np.stack((starts, ends), axis=1).ravel())[::2]
            del held
        else:
            per = (vectors @ (out[1] - out[0]))[flat]
            sums = np.stack((np.zeros(len(counts)), counts), axis=1)
            sums[some, 0] = np.add.reduceat(per, first[some], dtype=np.float64)
            logits = _differences(sums, sequence, fresh, starts, ends)
        best = np.lexsort((-logits, rows))
        best = best[np.concatenate(([True], rows[best][1:] != rows[best][:-1]))]
        group = np.searchsorted(rows, np.arange(texts_read))
        size = np.bincount(rows, minlength=texts_read)
        clean = np.flatnonzero((labels == 0) & (size > 0))
        chosen = np.concatenate((best, group[clean] + (rng.random(len(clean)) * size[clean]).astype(np.int64)))
        rng.shuffle(chosen)
        for at in range(0, len(chosen), batch):
            pick = chosen[at:at + batch]
            lengths = ends[pick] - starts[pick]
            places = np.repeat(starts[pick] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            window = np.repeat(np.arange(len(pick)), lengths)
            held_by = np.bincount(window, weights=counts[sequence[places]], minlength=len(pick))
            window, inner = window[fresh[places]], sequence[places[fresh[places]]]
            n = counts[inner]
            ids = flat[np.repeat(first[inner] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            bag = np.repeat(window, n)
            used = np.unique(bag)
            if not len(used):
                continue
            mean = np.add.reduceat(vectors[ids], np.searchsorted(bag, used), axis=0) / held_by[used, None]
            mean = np.concatenate((mean, np.zeros((len(used) // 4 + 1, DIMENSIONS), np.float32)))
            truth = np.concatenate((labels[rows[pick[used]]], np.zeros(len(mean) - len(used), np.int64)))
            scores = mean @ out.T + bias
            scores -= scores.max(axis=1, keepdims=True)
            share = np.exp(scores)
            share /= share.sum(axis=1, keepdims=True)
            share[np.arange(len(mean)), truth] -= 1
            share *= len(mean) ** -0.5
            g_out, g_bias = share.T @ mean, share.sum(axis=0)
            g_bag = np.zeros((len(pick), DIMENSIONS), np.float32)
            g_bag[used] = (share @ out)[:len(used)]
            touched, place = np.unique(ids, return_inverse=True)
            g = np.zeros((len(touched), DIMENSIONS), np.float32)
            np.add.at(g, place, (g_bag / np.maximum(held_by, 1)[:, None])[bag])
            seen_v[touched] += (g ** 2).mean(axis=1)
            vectors[touched] -= rate * g / np.sqrt(seen_v[touched])[:, None]
            seen_o += g_out ** 2
            out -= rate * 0.2 * g_out / np.sqrt(seen_o)
            seen_b += g_bias ** 2
            bias -= rate * 0.2 * g_bias / np.sqrt(seen_b)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), base)


def _telling(docs: list[np.ndarray], labels: np.ndarray, flat: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word, how much the texts that hold one of its subwords speak for toxic ones: toxic holders times log
    odds, of the subword for which that is most."""
    held = np.zeros((2, BUCKETS))
    for d, y in zip(docs, labels):
        own = np.unique(d)
        n = counts[own]
        held[y, flat[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] += 1
    texts = np.bincount(labels, minlength=2)
    odds = np.log((held[1] + 0.5) / (texts[1] + 1)) - np.log((held[0] + 0.5) / (texts[0] + 1))
    speaks = np.append((held[1] * odds)[flat], 0.0)
    out = np.zeros(len(counts))
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.maximum.reduceat(speaks, first[some])
    return out


def fit(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", train_rows: Column | None = None,
        max_rows_a_class: int = 3_000, max_chars: int = 20_000) -> Model:
    """Train on at most ``max_rows_a_class`` labelled texts of each class, those with the least hash of their id among
    the rows that ``train_rows`` admits; of texts over ``max_chars`` characters none is used. The driver holds that
    sample, whose size these bounds set. Labels other than 0 and 1, and labels of a null id, are left out; an id with
    both counts as toxic. Without labels of both classes every score is the base rate (0 without any)."""
    ids = df.where(F.lit(True) if train_rows is None else train_rows).select(
        F.col(doc_id).alias("id"), (F.length(text) <= max_chars).alias("short")).where("short").select("id")
    marks = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    known = ids.distinct().join(marks, "id")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows_a_class) for y in (0, 1)]
    sample = (df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.length("text") <= max_chars)
              .join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").dropDuplicates(["id"]).select("id", "text", "y"))
    rows = sample.toArrow().sort_by("id")
    base = sizes.get(1, 0) / total if total else 0.0
    if not len(rows):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((base + 1e-3) / (1 - base + 1e-3))), base)
    return train((t.as_py() for t in rows.column("text")), rows.column("y").to_numpy().astype(np.int64), base)


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, score (0 to 1) and predicted (1 from ``threshold`` on) of every row.

    All windows of the whole text are scored. Null, empty and wordless texts score the base rate of the labels.
    Repeated rows each give a row; an empty table gives an empty result. Other columns are not read."""
    slim = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*slim.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, scores in _scored(batches, shared.value, batch_text=-1):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=schema.names)

    return slim.mapInArrow(run, schema)


def _scored(batches: Iterable[pa.RecordBatch], model: Model, batch_text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the scores of the texts in their column ``batch_text``."""
    words = WordScores(model.piece, 2)
    for batch in batches:
        found = [model.score(*words(texts)) for _, texts in slices(batch.column(batch_text % batch.num_columns))]
        yield batch, np.concatenate([np.empty(0), *found])


def drop_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, all columns as they are.

    A row goes to Python once, its text not beside it a second time, and comes back only if it stays."""
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, scores in _scored(batches, shared.value, at):
            yield batch.filter(pa.array(scores < threshold))

    return df.mapInArrow(run, df.schema)
