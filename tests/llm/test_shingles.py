import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sheaf.llm import queries, shingles, simhash
from test_dedup import texts


def plain_set(text, words=5):
    parts = (text or "").encode().lower().split()
    return frozenset(b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def similar_pairs(sets):
    """All pairs of 0.8 or more, by brute force over inverted lists of any length."""
    lists, out = defaultdict(list), set()
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in lists[x]:
                shared[j] += 1
            lists[x].append(i)
        out |= {(j, i) for j, n in shared.items() if n * 9 >= 4 * (len(s) + len(sets[j]))}
    return out | {(i, j) for i in sets for j in sets if i < j and not sets[i] and not sets[j]}


def least_of_groups(sets):
    pairs = similar_pairs(sets)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return pairs, {i for i in sets if find(i) == i}


def test_similar_sets_share_a_band():
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    met, tried = 0, 0
    for n in [*range(4, 60, 4), 146, 396, 1000, 9000]:
        for _ in range(60):
            both = draw(n)
            most = n // 4  # 0.8 holds as long as n of n + most are shared
            mine = int(rng.integers(0, most + 1))
            minima = [shingles._minima(np.unique(np.concatenate((both, draw(k))))) for k in (mine, most - mine)]
            a, b = shingles.band_keys(np.array(minima))
            met, tried = met + bool((a == b).any()), tried + 1
    assert met >= tried - 1
    unlike = shingles.band_keys(np.array([shingles._minima(draw(300)) for _ in range(200)]))
    assert len(np.unique(unlike)) == unlike.size


def crowd():
    """Near copies of two texts, each with some words changed or a stretch left out, and short and odd texts."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", "a", "a b", "a  b", "A b c d e", "a b c d e", "a b c d e f"]
    for base in ([rng.choice(words) for _ in range(150)] for _ in range(2)):
        for _ in range(120):
            w = list(base)
            if rng.random() < 0.4:
                at = rng.randrange(100)
                del w[at:at + rng.randrange(45)]
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return out + texts()


def test_groups_of_a_crowd_are_those_of_all_pairs(docs_of):
    rows = list(enumerate(crowd()))
    _, want = least_of_groups({i: plain_set(t) for i, t in rows})
    df = docs_of([*rows, rows[7], (None, rows[20][1]), (None, "only this one text")])
    kept = shingles.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*map(str, want), "None"] + (["7"] if 7 in want else []))
    assert shingles.drop_near_copies(df.limit(0)).count() == 0


def boilerplate():
    """Documents that share most of their words with many others, few of them with a near copy."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(4000)]
    shared = [rng.choice(words) for _ in range(150)]
    out = []
    for k in range(150):
        own = [rng.choice(words) for _ in range(60)]
        out.append(" ".join(shared + own))
        if k % 10 == 0:
            own[rng.randrange(50)] = "other"
            out.append(" ".join(shared + own))
    return out


@pytest.mark.parametrize("largest", [shingles.LARGEST_REST, 4])
def test_crowded_bands_lose_no_pair(docs_of, monkeypatch, largest):
    monkeypatch.setattr(shingles, "LARGEST_REST", largest)
    rows = list(enumerate(boilerplate() + crowd()))
    _, want = least_of_groups({i: plain_set(t) for i, t in rows})
    assert {r["doc_id"] for r in shingles.drop_near_copies(docs_of(rows)).collect()} == want


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_pipeline_stage_finds_every_similar_pair(spark, folder):
    sf = f"/root/testdata/{folder}"
    docs = queries.table(spark, sf, "documents")
    pairs, want = least_of_groups({r["doc_id"]: plain_set(r["text"]) for r in docs.collect()})
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf).select("doc_id").collect()}
    assert pairs and got == want


def test_rarest_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    levels = rng.integers(1, 4, 1 << 10).astype(np.uint8)
    for n in [1, 2, 4, 5, 6, 9, 10, 11, 50, 333]:
        for _ in range(20):
            one = np.unique(rng.integers(-1 << 62, 1 << 62, n))
            swapped = len(one) // 9  # overlap n - k of a union of n + k: 0.8 or more while k is at most n / 9
            other = np.unique(np.concatenate((one[rng.permutation(len(one))[swapped:]], rng.integers(-1 << 62, 1 << 62, swapped))))
            assert set(shingles.rarest(one, levels)) & set(shingles.rarest(other, levels))
    levels[:] = 0
    assert not len(shingles.rarest(one, levels))
    assert not len(shingles.rarest(one[:0], levels))


def test_bit_maps_hold_the_ends(spark):
    last = shingles.FILTER_BITS - 1
    rows = spark.createDataFrame([(0, 1), (32767, 2), (32768, 9), (last, 9), (last, 1)], "bit bigint, of bigint")
    every, common = shingles._bit_maps(rows, ("true", "of > 8"))
    assert np.flatnonzero(every).tolist() == [0, 32767, 32768, last] and np.flatnonzero(common).tolist() == [32768, last]
    assert not shingles._bit_maps(rows.limit(0)).any()


def test_near_copies_are_found_by_simhash(docs_of, monkeypatch):
    """Fingerprints within two bits link near copies that share no band; unlike texts of close fingerprints stay apart."""
    rng = random.Random(3)
    base = [f"u{rng.randrange(5000)}" for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(base[1:])), (4, " ".join(f"u{rng.randrange(5000)}" for _ in range(400)))]
    fps = [shingles._fingerprint(shingles.shingles(t.encode())) for _, t in rows]
    assert fps[0] == simhash.fingerprint(rows[0][1].encode(), words=5) and shingles._fingerprint(shingles.shingles(b"")) == 0
    assert all((fps[0] ^ f).bit_count() <= 2 for f in fps[1:3])
    apart = lambda minima: minima.astype(np.int64).sum(axis=1)[:, None] * 64 + np.arange(shingles.BANDS)  # no two sets share a band
    monkeypatch.setattr(shingles, "band_keys", apart)
    assert sorted(r["doc_id"] for r in shingles.drop_near_copies(docs_of(rows)).collect()) == [1, 4]
    monkeypatch.setattr(shingles, "_fingerprint", lambda found: 7)
    assert sorted(r["doc_id"] for r in shingles.drop_near_copies(docs_of(rows)).collect()) == [1, 4]
