"""Key traps, decimal traps and complex keys against brute force."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from sheaf.functions.numbers import NumberRule, decimal_key
from sheaf.functions.text import nfc, normalize_text
from sheaf.operators import reconcile as r

RULE = NumberRule(".", ",", "$", 2)


def _token(c):
    return unicodedata.category(c)[0] in "LNM" or c in "_./-"


def _count(text, key):
    n, at = 0, 0
    while (at := text.find(key, at)) >= 0:
        before, after = text[at - 1:at], text[at + len(key):at + len(key) + 1]
        n += not (before and _token(before)) and not (after and _token(after))
        at += max(1, len(key))
    return n


def _hits(spark, texts, keys):
    spans = spark.createDataFrame([(0, 0, i, t) for i, t in enumerate(texts)], "doc_id long, page long, span_no long, text string")
    records = spark.createDataFrame([(k,) for k in keys], "norm_key string")
    return {(x.span_no, x.key): x.occurrences for x in r.find_key_hits(spans, records).collect()}


def test_key_traps(spark):
    texts = ["312", "0012", "12.5", "X/12", "aBC-001", "ABC001", "see 12, then 12", "ABC-001"]
    assert _hits(spark, texts, ["12", "ABC-001"]) == {(6, "12"): 2, (7, "ABC-001"): 1}


def test_complex_keys_match_brute_force(spark):
    rng = random.Random(7)
    alphabet = "a1 -#("
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n)).strip()
    texts = [word(rng.randint(1, 14)) for _ in range(150)]
    keys = sorted({w for w in (word(rng.randint(1, 4)) for _ in range(60)) if w})
    want = {(i, k): _count(t, k) for i, t in enumerate(texts) for k in keys if _count(t, k)}
    assert _hits(spark, texts, keys) == want


def test_decimal_traps(spark):
    cases = {"0012": None, "18/81": None, "245-9": None, "BS-03": None, "12,00,001": None, "1.234": None, "€20": None, "NaN": None,
             "$62,500.00": "6250000", "62500": "6250000", "-0.00": "0", "$ -5": "-500", "-$5": None, "1,234.5": "123450", ".5": None,
             "5.": None, "9" * 50: "9" * 50 + "00", "9" * 51: None}
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {x.t: x.v for x in d.select("t", decimal_key(normalize_text("t"), RULE).alias("v")).collect()}
    assert got == cases


def test_nfc(spark):
    texts = ["é", "plain", "가", "é", "ạ̇", "Å"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x.n for x in d.select(nfc("t").alias("n")).collect()] == [unicodedata.normalize("NFC", t) for t in texts]


def test_spans_keep_columns_apart(spark):
    rows = [(0, 1, 0, "Total:", 40.0, 50.0, 36.0, 12.0), (0, 1, 1, "5", 79.0, 50.0, 6.0, 12.0), (0, 1, 2, "far", 200.0, 50.0, 18.0, 12.0),
            (0, 1, 3, "low", 40.0, 64.0, 18.0, 12.0), (0, 1, 4, "er", 58.0, 64.0, 12.0, 12.0)]
    items = spark.createDataFrame(rows, "doc_id long, page long, idx int, text string, x double, y double, advance double, size double")
    got = r.build_spans(items).orderBy("span_no").collect()
    assert [x.text for x in got] == ["Total: 5", "far", "lower"]
    assert [tuple(p) for p in got[0].parts] == [(0, 0, 6), (1, 7, 8)]


def test_setup_problems():
    setup = r.Setup("ID", "Key:", (r.FieldRule("Serial", "S:", "number", RULE), r.FieldRule("Serial", "T", "exact")))
    assert len(r.setup_problems(setup, ["ID", "Serial"])) == 3
