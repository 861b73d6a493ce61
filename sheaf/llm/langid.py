"""Language of whole texts: known words by frequency, unknown ones by ever shorter character n-grams."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sheaf.llm.tokenizing import slices
from sheaf.llm.wordscores import WordScores
from sheaf.session import stage

#: Word characters that are neither decimal digits nor low lines; number signs such as a half are left out after that.
LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
SMOOTHING = 0.5


def letter_words(text: str) -> list[str]:
    """The runs of letters in a text."""
    found = LETTERS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


@dataclass
class Model:
    """Log frequencies per language of words and of n-grams; ``langs`` in code point order."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    word_logs: np.ndarray = None
    gram_logs: np.ndarray = None
    _scores: WordScores = None

    def word(self, word: str) -> np.ndarray:
        """Evidence of one word of letters only, zero where nothing is known."""
        return self.pieces([word])[0, :-1]

    def _speaking(self, word: str) -> list[int]:
        """Rows of the word logs, then the gram logs, whose mean is the evidence of one word of letters only; none where
        nothing is known.

        An unknown word takes the longest order of which half its n-grams or more are known, else the longest with
        any."""
        if (at := self.words.get(word)) is not None:
            return [at]
        padded, spare = f"<{word}>", None
        for order in ORDERS:
            text = padded if order > 1 else word  # the marks of begin and end say nothing by themselves
            grams = [text[i:i + order] for i in range(len(text) - order + 1)]
            known = [at for g in grams if (at := self.grams.get(g)) is not None]
            if known and len(known) * 2 >= len(grams):
                break
            if known and spare is None:
                spare = known
        else:
            known = spare or []
        return [len(self.words) + at for at in known]

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """For each white-space separated piece the summed evidence of its words, and whether it has a letter.

        The rows that speak for all pieces are summed at once: an array for each word would cost more than its lookup."""
        rows, shares, each = array("i"), array("f"), array("i")
        out = np.zeros((len(pieces), len(self.langs) + 1), np.float32)
        for i, piece in enumerate(pieces):
            before = len(rows)
            if (at := self.words.get(piece)) is not None:  # words are letters only, so the piece is one
                rows.append(at)
                shares.append(1)
                out[i, -1] = 1
            elif found := letter_words(piece):
                out[i, -1] = 1
                for word in found:
                    own = self._speaking(word)
                    rows.extend(own)
                    shares.extend([1 / len(own)] * len(own) if own else ())
            each.append(len(rows) - before)
        if rows and self.langs:
            logs = np.concatenate((self.word_logs, self.gram_logs))[np.array(rows)] * np.array(shares, np.float64)[:, None]
            each = np.array(each)
            out[each > 0, :-1] = np.add.reduceat(logs, (np.cumsum(each) - each)[each > 0], axis=0)
        return out

    def scores(self) -> WordScores:
        """Scores that a process keeps with the model from task to task; they go with its broadcast."""
        if self._scores is None:
            self._scores = WordScores(None, len(self.langs) + 1, self.pieces)
        return self._scores


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n), one row per word and task at most before the sum."""
    schema = "lang string, word string, n bigint"

    def run(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                langs = batch.column(0).slice(at, len(texts))
                for lang in pc.unique(langs).to_pylist():
                    own = pc.utf8_lower(texts.filter(pc.equal(langs, lang)))
                    pieces = pc.value_counts(pc.utf8_split_whitespace(own).flatten())
                    for piece, n in zip(pieces.field("values").to_pylist(), pieces.field("counts").to_pylist()):
                        for word in letter_words(piece):
                            seen.setdefault(lang, Counter())[word] += n
            if sum(map(len, seen.values())) > 200_000:
                yield from _emit(seen)
                seen = {}
        yield from _emit(seen)

    return sample.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_counts(counted: DataFrame) -> DataFrame:
    """(lang, key, n) of the n-grams of all orders in the words between their marks."""

    def run(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                counts, padded = seen.setdefault(lang, Counter()), f"<{word}>"
                for order in ORDERS:
                    for i in range(len(padded) - order + 1):
                        gram = padded[i:i + order]
                        counts[gram] = counts.get(gram, 0) + n
            if sum(map(len, seen.values())) > 200_000:
                yield from _emit(seen)
                seen = {}
        yield from _emit(seen)

    found = counted.select("lang", "word", "n").mapInArrow(run, "lang string, word string, n bigint")
    return found.withColumnRenamed("word", "key").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _emit(seen: dict[str, Counter]):
    for lang, counts in seen.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "word", "n"])


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train: Column | None = None, max_docs: int = 20_000,
        max_words: int = 60_000, max_grams: int = 60_000) -> Model:
    """Learn from at most ``max_docs`` documents a language, those with the least hash of their key among the rows that
    ``train`` admits and that have text and language. Counting is a Spark job; the model keeps the ``max_words`` most
    frequent words and the ``max_grams`` most frequent n-grams of each language, so it grows with the languages only."""
    rows = df.where(F.lit(True) if train is None else train).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    present = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    chosen = _of_each(rows.select("lang", "key").distinct(), present, max_docs, F.xxhash64("key"), F.col("key"))
    counted = stage(_counts(rows.join(F.broadcast(chosen), ["lang", "key"], "left_semi")))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    model = Model(sorted(totals))
    model.words, model.word_logs = _table(counted.withColumnRenamed("word", "key"), model.langs, totals, max_words)
    grams = stage(_gram_counts(counted))
    sums = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    model.grams, model.gram_logs = _table(grams, model.langs, sums, max_grams)
    return model


def _of_each(rows: DataFrame, langs: list[str], most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of each language."""
    return reduce(DataFrame.unionByName, [rows.where(F.col("lang") == x).orderBy(*order).limit(most) for x in langs], rows.limit(0))


def _table(counted: DataFrame, langs: list[str], totals: dict[str, int], most: int) -> tuple[dict[str, int], np.ndarray]:
    """Position and log frequencies, less their mean over the languages, of each language's ``most`` most frequent keys."""
    top = _of_each(counted, langs, most, F.col("n").desc(), F.col("key")).select("key").distinct()
    per = counted.join(F.broadcast(top), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    # Arrow columns, not row objects: the driver holds the keys and one number a language.
    by = F.transform(F.array(*map(F.lit, langs)), lambda x: F.coalesce(F.try_element_at("by", x), F.lit(0))) if langs else F.array().cast("array<bigint>")
    rows = per.orderBy(F.col("all").desc(), "key").select("key", by.alias("by")).toArrow()
    counts = rows["by"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), len(langs))
    logs = np.log((counts + SMOOTHING) / (np.array([totals.get(x, 0) for x in langs]) + SMOOTHING * (len(rows) + 1)))
    logs -= logs.mean(axis=1, keepdims=True) if len(langs) else 0
    return {key: i for i, key in enumerate(rows["key"].to_pylist())}, logs.astype(np.float32)


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row.

    The evidence of all words of the whole text is summed; the score is the softmax share of the best language (the
    first in code point order among equals). Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if nothing was learned. Repeated rows each give a row; an empty table gives an empty result."""
    slim = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*slim.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known, names = shared.value, None
        scores = known.scores()
        names = pa.array([*known.langs, UNDETERMINED], pa.string())
        for batch in batches:
            picks, shares = [], []
            for _, texts in slices(batch.column(batch.num_columns - 1)):
                values, row_at, _ = scores(texts)
                sums = np.add.reduceat(values, row_at[:-1], axis=0, dtype=np.float64)
                pick, share = np.full(len(texts), len(known.langs)), np.zeros(len(texts))
                lettered = (sums[:, -1] > 0) & bool(known.langs)
                if lettered.any():
                    logits = sums[lettered, :-1]
                    logits -= logits.max(axis=1, keepdims=True)
                    odds = np.exp(logits)
                    pick[lettered], share[lettered] = odds.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)
                picks.append(pick)
                shares.append(share)
            pick = np.concatenate(picks) if picks else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], names.take(pa.array(pick)), pa.array(np.concatenate(shares) if shares else np.empty(0))], names=schema.names)

    return slim.mapInArrow(run, schema)
