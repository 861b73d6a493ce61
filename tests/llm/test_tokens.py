import random
import timeit
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from sheaf.llm import packing, tokencounts, tokenfiles, tokenizing
from sheaf.llm.common import known_codes
from sheaf.llm.queries import byte_vocabulary, word_vocabulary

RNG = random.Random(1)
ODD = ["", " ", "\n", "  a", "a  b", " a b ", "a \n b", "a\n\n\nb", "x  ", "x \n", "don't  it's", "é ́x", "\x1cfoo\x1c bar", "a b　 c",
       "ΑΣ ΣΑΣ", "a\0b c", "<|endoftext|> x<|endoftext|>", "🙂🙂 é\tb\r\nc", "日本語 テキスト", "1234 5 678", "İstanbul K ŉ ǆ", "Word, word. Word! WORD"]
ODD += ["".join(RNG.choice(" \n\tab'Sé.,1́ İß|") for _ in range(RNG.randint(1, 30))) for _ in range(2000)] + ["long word " * 20000]
ODD += ["".join(RNG.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "a", "Word.", "\n", "<|", "|>", "é"]) for _ in range(RNG.randint(1, 9))) for _ in range(600)]


def whole(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False)


@pytest.mark.parametrize("vocabulary, name", [(word_vocabulary(), "word_bpe_49k.json"), (byte_vocabulary(), "byte_bpe_50k.json")])
def test_ids_equal_those_of_whole_texts(vocabulary, name):
    encode, texts = whole(name), pa.array([None, *ODD])
    e = tokenizing.Encoder(vocabulary)
    for _ in range(2):  # words unknown, then known
        ids, at = e.ids(texts)
        assert all(ids[at[i]:at[i + 1]].tolist() == encode(t).ids for i, t in enumerate(texts.to_pylist()))


def test_spans_equal_those_of_whole_texts():
    encode, texts = whole("byte_bpe_50k.json"), pa.array(ODD)
    spans, at = tokenizing.SpanEncoder(byte_vocabulary()).spans(texts)
    assert all(list(map(tuple, spans[at[i]:at[i + 1]].tolist())) == encode(t).offsets for i, t in enumerate(ODD))


def documents():
    some = [(i, " ".join(RNG.choice(["alpha", "beta,", "Gamma", "éé"]) for _ in range(RNG.choice([1, 30, 600, 1500])))) for i in range(60)]
    return some + [(70, None), (71, ""), (None, "no id"), (3, some[3][1]), (3, "same id"), (80, "tail " * 9000)]


def test_packing_places_every_id_once(docs_of, monkeypatch):
    rows = documents()
    pieces = packing.pack_documents(docs_of(rows).repartition(3), word_vocabulary(), step_tokens=8192).collect()
    encode = whole("word_bpe_49k.json")
    want = sorted((str(i), len(encode(t).ids) + 1) for i, t in rows)
    got, sequences = [], {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
        if p["start"] == 0:
            got.append((str(p["doc_id"]), p["doc_tokens"]))
    assert sorted(got) == want and sum(p["length"] for p in pieces) == sum(n for _, n in want)
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == [sum(q["length"] for q in s[:k]) for k in range(len(s))]
        total = sum(p["length"] for p in s)
        assert total <= 4096 and total & (total - 1) == 0 and all(p["sequence_tokens"] == total for p in s)
    full = {i: [*encode(t).ids, 2] for i, t in rows if i not in (3, None)}
    for p in pieces:
        if p["doc_id"] in full:
            ids = np.array(full[p["doc_id"]][p["start"]:p["start"] + p["length"]], "<u4")
            assert zlib.crc32(ids.tobytes()) == p["ids_crc32"] and len(ids) == p["length"]
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack_documents(docs_of(rows).limit(0), word_vocabulary()).count() == 0


def test_pack_fills_windows_from_any_lengths():
    for seed in range(30):
        rng = random.Random(seed)
        sizes = [rng.choice([1, 5, 200, 511, 512, 513, 3000, 4096, 4097, 20000]) for _ in range(rng.randint(0, 40))]
        parts = [packing.Part(i, 0, n, np.arange(n, dtype=np.uint32)) for i, n in enumerate(sizes)]
        windows, left = packing.pack(parts)
        assert all(sum(len(p.ids) for p in w) == n and n in packing.TIERS for n, w in windows) and sum(len(p.ids) for p in left) < 4096
        rest = packing.close(left)
        seen = {i: [] for i in range(len(sizes))}
        for _, w in windows + rest:
            for p in w:
                assert p.ids[0] == p.start
                seen[p.row].append((p.start, len(p.ids)))
        for i, n in enumerate(sizes):
            at = 0
            for start, length in sorted(seen[i]):
                assert start == at
                at += length
            assert at == n


def test_shards_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for top in (1, 2, 300, 60000, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[::97] = rng.integers(0, 2**32, len(ids[::97]), dtype=np.uint64).astype(np.uint32)
            sizes = np.array([n // 2, 0, n - n // 2])
            shard = tokenfiles.Shard(tokenfiles.encode_shard(sizes, ids))
            assert (shard.ids() == ids).all() and shard.sizes.tolist() == sizes.tolist()
            assert (shard.ids(n // 3, n // 3 + 1500) == ids[n // 3:n // 3 + 1500]).all()
    even = tokenfiles.encode_shard(np.array([4096]), np.tile(np.arange(16, dtype=np.uint32), 256))
    assert len(even) < 4096  # four bits an id


def test_files_hold_all_documents_in_order(docs_of, monkeypatch):
    rows = documents()
    got = tokenfiles.write_and_read(docs_of(rows).repartition(4), byte_vocabulary()).collect()
    encode, at, want = whole("byte_bpe_50k.json"), 0, []
    assert len(got) == len(rows)
    crcs = lambda t: (len(encode(t).ids) + 1, zlib.crc32(np.array([*encode(t).ids, 0], "<u4").tobytes()))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted([i for i, _ in rows if i is not None]) + [None]
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), *crcs(t)) for i, t in rows)
    assert tokenfiles.write_and_read(docs_of(rows).limit(0), byte_vocabulary()).count() == 0


@pytest.mark.parametrize("rule", ["most", "first", "last"])
def test_token_counts_by_section(docs_of, rule):
    rows = [(1, "one\ntwo three\n\n\nfour"), (2, ""), (3, None), (4, "\n"), (5, "🙂\n🙂 é"), (None, "x\n"), (5, "again"), (6, "w " * 30000)]
    got = tokencounts.count_tokens(docs_of(rows), byte_vocabulary(), ("text", "source"), rule=rule).collect()
    encode, want = whole("byte_bpe_50k.json"), []
    for i, t in rows:
        fields, at, sections = (t or "", "s"), 0, []
        for name, value in zip(("text", "source"), fields):
            lines = (value + ("\n" if name == "text" else "")).splitlines(keepends=True) or [""]
            for k, line in enumerate(lines):
                sections.append([name, k, at, at + len(line), 0])
                at += len(line)
        tokens = encode((t or "") + "\ns").offsets
        for a, b in tokens:
            held = [max(0, min(b, s[3]) - max(a, s[2])) for s in sections]
            touched = [k for k, h in enumerate(held) if h]
            sections[touched[0] if rule == "first" else touched[-1] if rule == "last" else held.index(max(held))][4] += 1
        want += [(str(i), *s, len(tokens)) for s in sections]
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_known_words_are_not_hashed_again_for_every_slice():
    """What looks words up hashes those of the slice only, and numbers new ones behind the known."""
    known = pa.array(["b", "a", "e"], pa.string())
    code, new = known_codes(pa.array(["a", "c", "a", "", "c", "b"], pa.string()), known)
    assert code.tolist() == [1, 3, 1, 4, 3, 0] and new.to_pylist() == ["c", ""]
    code, new = known_codes(pa.array([], pa.string()), known)
    assert not len(code) and not len(new)
    many = pa.array([str(i) for i in range(600_000)])
    few = pa.array(["7", "x"] * 10)
    best = lambda f: min(timeit.repeat(f, number=1, repeat=5))
    assert best(lambda: known_codes(few, many)) < best(lambda: pc.index_in(few, value_set=many))
