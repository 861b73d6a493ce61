import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from sheaf.llm import piecing, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(3)
ODD = ["", " ", "  ", "a", " a", "a  b", "a ", "\n", "a\n\nb", "▁a ▁", "▁▁▁", "<s>x</s>", "<0x41>", "<unk>", "é ́x", "🙂🙂 x", "a\0b c", "　x y", "ﬁ", "日本語 テキスト",
       "\x01a\x02 b", "".join(map(chr, range(1, 32))) + " \x7f", "x" * 3000, "word " * 30000]
ODD += ["".join(RNG.choice("  \nab'Sé.,1▁ thegin") for _ in range(RNG.randint(1, 60))) for _ in range(3000)]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_librarys(library):
    e, texts = piecing.Encoder(PATH, check=False), pa.array([None, *ODD])
    for _ in range(2):  # parts unknown, then known
        ids, at = e.ids(texts)
        for i, t in enumerate(texts.to_pylist()):
            assert ids[at[i]:at[i + 1]].tolist() == library.encode(t or ""), t
    lists = [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))]
    assert e.pieces.decoded(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [library.decode(x) for x in lists]


def test_whole_texts_without_cutting(library):
    e = piecing.Encoder(PATH)
    e.pieces.cuts = False
    some = pa.array(ODD[:20] + ODD[24:400])
    ids, at = e.ids(some)
    assert all(ids[at[i]:at[i + 1]].tolist() == library.encode(t) for i, t in enumerate(some.to_pylist()))


def test_texts_of_any_ids(library):
    pieces = piecing.Pieces(PATH)
    lists = [[RNG.choice([0, 1, 2, RNG.randrange(3, 259), RNG.randrange(3, 259), 28705, 259, RNG.randrange(32000)]) for _ in range(RNG.randint(0, 6))] for _ in range(4000)]
    lists += [[241, 131, 131], [241], [28705], [1, 28705], [13], [28705, 13]]
    got = pieces.decoded(pa.array(lists, pa.list_(pa.int32()))).to_pylist()
    assert [(x, g) for x, g in zip(lists, got) if g != library.decode(x)] == []
    with pytest.raises(ValueError):
        pieces.decoded(pa.array([[32000]], pa.list_(pa.int32())))


def test_merges_by_score_then_from_the_left():
    """A small vocabulary by hand: unused pieces are taken apart again, defined ones are never merged."""
    p = piecing.Pieces.__new__(piecing.Pieces)
    p.scores = {"ab": -1.0, "bc": -0.5, "aa": -2.0, "abab": -3.0, "<x>": 0.0, "a": -9.0, "b": -9.0, "c": -9.0}
    p.own = {k: i + 1 for i, k in enumerate(p.scores)}
    p.unused, p.byte_fallback, p.unknown, p.defined = {"ab"}, False, 0, piecing.re.compile("<x>")
    shown = {i: k for k, i in p.own.items()} | {0: "?"}
    cut = lambda text: [shown[i] for i in p.merged(text)]
    assert cut("abc") == ["a", "bc"] and cut("aaa") == ["aa", "a"] and cut("abab") == ["abab"]
    assert cut("ab") == ["a", "b"] and cut("a<x>b") == ["a", "<x>", "b"] and cut("azzb") == ["a", "?", "b"] and cut("") == []


def test_short_parts_merge_as_long_ones_do(monkeypatch):
    p = piecing.Pieces(PATH)
    some = ["▁" + "".join(RNG.choice("thesanioré.,1▁") for _ in range(RNG.randint(0, 31))) for _ in range(3000)]
    short = [p.merged(t) for t in some]
    monkeypatch.setattr(piecing, "SHORT", 0)
    assert [p.merged(t) for t in some] == short


def test_query_over_whole_tables(spark, library):
    sf = "/root/testdata/sf0.01"
    want = set()
    for r in queries.table(spark, sf, "documents").collect():
        ids = library.encode(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = queries.op11_pieces(spark, sf).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_odd_documents(docs_of, library):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (4, "long text " * 50000), (5, " ")]
    out = piecing.encode(docs_of(rows), PATH, decoded=True)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in out.collect()) == sorted((str(i), library.encode(t or ""), t or "") for i, t in rows)
    again = piecing.decode(out.select("doc_id", "ids", "decoded").withColumnRenamed("decoded", "was"), PATH, keep=("was",))
    assert all(r["was"] == r["decoded"] for r in again.collect())
    assert piecing.encode(docs_of(rows).limit(0), PATH).count() == 0


def test_a_difference_stops_the_job():
    e = piecing.Encoder(PATH)
    del e.pieces.costs["▁the"]
    with pytest.raises(AssertionError):
        e.ids(pa.array(["the thing then"]))
    assert np.array_equal(piecing.Encoder(PATH).ids(pa.array([], pa.string()))[1], [0])
