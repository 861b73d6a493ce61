import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import annsearch, langid, queries, toxicity
from sheaf.llm.common import held_out
from sheaf.llm.wordscores import WordScores


def test_held_out_is_crc_of_the_id(spark):
    rows = spark.range(500).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in queries.table(spark, sf, "documents").collect()}
    got = [r for r in queries.op2_language_id(spark, sf).collect()]
    tested = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in tested]) > 0.95


def test_language_edges(spark, docs_of):
    rows = [(i, t, "s") for i, t in enumerate(["the house and the dog", "das haus und der hund"] * 20)]
    df = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = langid.fit(df, train=~held_out(F.col("doc_id")))
    assert model.langs == ["de", "en"]
    odd = docs_of([(1, None), (2, ""), (3, "12 . 34"), (None, "HUNDE haus"), (5, "doggy " * 30000), (5, "doggy"), (6, "日本語"), (7, "½ ② ² Ⅷ"), (8, "½haus")])
    got = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 3)) for r in langid.identify(odd, model).collect())
    assert [g[:2] for g in got] == [("1", "und"), ("2", "und"), ("3", "und"), ("5", "en"), ("5", "en"), ("6", "de"), ("7", "und"), ("8", "de"), ("None", "de")]
    assert langid.identify(odd.limit(0), model).count() == 0
    nothing = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_unknown_words_back_off_to_shorter_ngrams():
    model = langid.Model(["a", "b"], {"known": 0}, {"<kno": 0, "kn": 1, "z": 2}, np.array([[3.0, -3.0]]), np.array([[1.0, 0], [0.5, 0], [0, 9.0]]))
    assert model.word("known").tolist() == [3, -3]
    assert model.word("kno").tolist() == [1, 0]  # one of two 4-grams of <kno>
    assert model.word("zz").tolist() == [0, 9]
    assert model.word("qqq").tolist() == [0, 0]


def test_scores_equal_those_of_a_plain_scorer(spark, docs_of):
    """Word by word over the fitted model, without slices, caches or Arrow."""
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    model = langid.fit(docs, train=~held_out(F.col("doc_id")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.identify(docs, model).collect():
        words, run = [], ""
        for c in (texts[r["doc_id"]] or "").lower() + " ":
            if c.isalpha():
                run += c
            else:
                words, run = words + [run] * bool(run), ""
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        sums = np.sum([model.word(w) for w in words], axis=0, dtype=np.float64)
        odds = np.exp(sums - sums.max())
        assert abs(r["score"] - odds.max() / odds.sum()) < 1e-3
        assert r["lang_pred"] == model.langs[int(sums.argmax())] or np.sort(odds)[-2] > 0.999


def toxic_text(rng, bad):
    words = ["".join(rng.choice(["the", "an", "on", "er", "st", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([5, 60, 300]))]
    for w in bad:
        words.insert(rng.randrange(len(words) + 1), w)
    return " ".join(words)


def test_toxicity_learns_and_shares_subwords():
    rng = random.Random(4)
    stems = ["idiot", "moron", "loweian", "loweiun", "loweiei", "loweius"]
    texts, labels = [], []
    for i in range(800):
        labels.append(i % 4 == 0)
        texts.append(toxic_text(rng, [rng.choice(stems)] if labels[-1] else []))
    model = toxicity.train(texts, np.array(labels, np.int64), 0.25)
    words = WordScores(model.piece, 2)
    score = lambda t: model.score(*words(pa.array(t)))
    clean, bad = score([toxic_text(rng, []) for _ in range(200)]), score([toxic_text(rng, ["idiot"]) for _ in range(100)])
    assert (clean >= 0.3).mean() < 0.03 and (bad >= 0.3).mean() > 0.97
    assert (score([toxic_text(rng, ["loweiar"]) for _ in range(100)]) >= 0.3).mean() > 0.8  # never seen
    assert score(["then " * 400])[0] < 0.3 and score([None, "", " . "]).tolist() == [0.25] * 3
    assert (words(pa.array(["idiot idiot x"]))[0] == WordScores(model.piece, 2)(pa.array(["idiot idiot x"]))[0]).all()


def test_toxicity_held_out_and_edges(spark, docs_of):
    sf = "/root/testdata/sf0.1"  # a quarter of its toxic labels stand at texts without any sign of it
    labels = {r["doc_id"]: r["toxic"] for r in queries.table(spark, sf, "labels").collect()}
    tested = [r for r in queries.op7_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    hit = [r for r in tested if labels[r["doc_id"]] == 1]
    assert np.mean([r["predicted"] for r in hit]) > 0.6
    assert np.mean([r["predicted"] for r in tested if labels[r["doc_id"]] == 0]) < 0.01
    df = docs_of([(1, None), (2, ""), (None, "text"), (4, "word " * 50000), (4, "word")])
    none = toxicity.fit(df, spark.createDataFrame([(None, 1), (1, None), (9, 7)], "doc_id bigint, toxic int"))
    assert {(r["score"] >= 0.3, r["predicted"]) for r in toxicity.score(df, none).collect()} == {(False, 0)}
    kept = toxicity.drop_toxic(df, none)
    assert kept.columns == df.columns and kept.count() == 5 and toxicity.drop_toxic(df.limit(0), none).count() == 0


def exact_nearest(rows, every, k):
    """Counts of (query_id, rank, vec_id, score) over all rows (id, vector) but the query's own."""
    out = Counter()
    for at, (q, v) in enumerate(rows):
        if q is not None and q % every == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i is None, i or 0)
                          for n, (i, w) in enumerate(rows) if n != at and len(w) == len(v))[:k]
            out.update((q, r + 1, None if none else i, float(f"{d:.9g}")) for r, (d, none, i) in enumerate(near))
    return out


def found_nearest(df, **settings):
    return Counter((r["query_id"], r["rank"], r["vec_id"], float(f"{r['score']:.9g}")) for r in annsearch.nearest(df, **settings).collect())


VECTORS = "vec_id bigint, embedding array<double>"


def test_small_search_is_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [1.0] * 6) for i in range(60)]  # many copies
    rows += [(300, [1.0, 2.0]), (400, [2.0, 2.0]), (401, [2.0, 2.0]), (None, [1.0] * 6), (None, [2.0, 2.0])]
    rows += [(7, rows[7][1]), (7, [v + 1 for v in rows[7][1]]), (40, rows[40][1]), (40, [0.5] * 6)]
    bad = [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, [None] * 6), (1005, [])]
    df = spark.createDataFrame([*rows, *bad], VECTORS).withColumn("shard", F.lit("x"))
    assert found_nearest(df, every=20, shard_rows=40) == exact_nearest(rows, 20, 10)
    assert annsearch.nearest(df.limit(0)).count() == 0


def test_search_repeated_and_missing_ids(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [0.0, 1.0])]
    got = found_nearest(spark.createDataFrame(rows, VECTORS))
    assert got == exact_nearest(rows, 100, 10) and got[(100, 1, 100, 0.0)] == 2 and sum(got.values()) == 8
    none = [(None, [1.0, 0.0]), (None, [1.0, 0.0])]
    assert annsearch.nearest(spark.createDataFrame(none, VECTORS)).count() == 0


def test_search_of_very_large_components(spark):
    rows = [(i * 100, [float(i) * 1e200, 1e200, -3e180]) for i in range(1, 40)]
    got = annsearch.nearest(spark.createDataFrame(rows, VECTORS)).where("query_id = 2000 and rank <= 2").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1900, pytest.approx(1e200)), (2100, pytest.approx(1e200))]


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_search_recall(spark, folder):
    sf = f"/root/testdata/{folder}"
    rows = queries.table(spark, sf, "embeddings").collect()
    names = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], np.float64)
    found = {}
    for r in queries.op6_nearest(spark, sf).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    shares = []
    for i in np.flatnonzero(names % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        shares.append(len(found[names[i]] & set(names[np.lexsort((names, d))[:10]])) / 10)
    assert len(shares) == len(found) and np.mean(shares) >= 0.9


def test_language_model_reaches_the_driver_without_row_objects(docs_of, monkeypatch):
    """Keys and counts come as columns; only one row a language is collected."""
    from pyspark.sql.classic.dataframe import DataFrame

    collect = DataFrame.collect

    def few(df):
        rows = collect(df)
        assert len(rows) <= 2
        return rows

    df = docs_of([(i, f"alpha {chr(98 + i)} gamma") for i in range(9)] + [(9 + i, f"uno {chr(98 + i)}{chr(98 + i)} tres") for i in range(9)])
    df = df.withColumn("lang", F.when(F.col("doc_id") < 9, "b").otherwise("a"))
    monkeypatch.setattr(DataFrame, "collect", few)
    model = langid.fit(df)
    assert model.langs == ["a", "b"] and len(model.words) == 22 and list(model.words)[:4] == ["alpha", "gamma", "tres", "uno"]
    assert np.sign(model.word_logs[model.words["alpha"]]).tolist() == [-1, 1]



def test_learned_grams_have_the_orders_asked_for(docs_of):
    """Every n-gram of 1 to 5 characters of the words between their marks, and nothing longer, shorter or skipped."""
    words = ["alpha", "öl", "x"]
    model = langid.fit(docs_of([(1, " ".join(words))]).withColumn("lang", F.lit("a")))
    assert set(model.grams) == {p[i:i + k] for p in (f"<{w}>" for w in words) for k in range(1, 6) for i in range(len(p) - k + 1)}


def test_pieces_of_many_words_at_once():
    """Punctuation, several words in a piece, unknown words and pieces without letters, and a process learns a word once."""
    model = langid.Model(["a", "b"], {"known": 0}, {"kno": 0}, np.array([[3, -3]], np.float32), np.array([[1, 0]], np.float32))
    found = model.pieces(["known", "(known),", "known-known", "kno!", "qqq", "12", "", "known qqq"])
    assert found.tolist() == [[3, -3, 1], [3, -3, 1], [6, -6, 1], [1, 0, 1], [0, 0, 1], [0, 0, 0], [0, 0, 0], [3, -3, 1]]
    assert model.scores() is model.scores()


def test_dropping_sends_each_text_once(docs_of):
    """A row goes to Python as it is, not packed with its text beside it."""
    df = docs_of([(1, "an idiot"), (2, "a stone")])
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    weights[toxicity.subwords("idiot")] = 9
    kept = toxicity.drop_toxic(df, toxicity.Model(weights, -2.0, 0.1))
    assert kept.collect() == df.where("doc_id = 2").collect()
    assert "struct(" not in kept._jdf.queryExecution().optimizedPlan().toString()
