import hashlib
import random
import re
from collections import defaultdict

import xxhash

from sheaf.llm import components, exactdedup, simhash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gämma", "delta", "eps", "ZETA", "eta"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 40, 80, 400)]
    out = [None, "", " \n\t ", *base]
    for t in base[3:]:
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return out + [base[3], "word " * 5000, "日本語 テキスト です"]


def test_fingerprints_and_components(docs_of):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, texts()[3]), (None, "alpha beta gamma delta")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    fps = {t: brute_fingerprint(t) for _, t in rows}
    text_of = dict(rows)
    assert all(r["fingerprint"] == f"{fps[text_of[r['doc_id']]]:016x}" for r in got)
    root = groups_of(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(lambda: float("inf"))
    for i, t in rows:
        if i is not None:
            least[root[fps[t]]] = min(least[root[fps[t]]], i)
    assert all(r["component_id"] == (None if least[root[fps[text_of[r["doc_id"]]]]] == float("inf") else least[root[fps[text_of[r["doc_id"]]]]]) for r in got)


def test_links_in_crowded_blocks_are_complete(spark):
    rng = random.Random(5)
    seen = set()
    for centre in (rng.getrandbits(64) for _ in range(6)):
        seen |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in seen]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for distance in (0, 1, 2):
        for largest in (4, 1000):  # chains and pairs
            edges = simhash.links(fps, distance, largest_block=largest)
            got = {r["node"]: r["root"] for r in components.components(edges).collect()}
            want = groups_of(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= distance)
            assert {n: got.get(n, n) for n in signed} == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 0), (5, 5)], "src bigint, dst bigint")
    got = {(r["node"], r["root"]) for r in components.components(edges).collect()}
    assert got == {(n, 0) for n in [*range(301), 1000]}


def test_near_duplicate_stage_keeps_rows_whole(docs_of):
    df = docs_of([(i, t) for i, t in enumerate(texts())])
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def exact_rows():
    return [(5, "a b"), (2, "ab"), (9, " a b"), (1, None), (7, ""), (8, " \t\n"), (3, "x" * 50000), (4, "x " * 50000), (6, "a b"),
            (6, "a b"), (None, "ab c"), (11, "abc"), (None, "only")] + [(100 + i, "hot text") for i in range(300)]


def test_exact_groups(docs_of):
    rows = exact_rows()
    got = exactdedup.exact_groups(docs_of(rows).repartition(7)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        want.append((i, min(g)[2], len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_stage_keeps_one_row_of_each_text(docs_of, spark):
    df = docs_of(exact_rows()).repartition(5)
    kept = exactdedup.drop_copies(df)
    assert kept.columns == df.columns
    want = sorted(str(r["doc_id"]) for r in exactdedup.exact_groups(df).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert exactdedup.drop_copies(df.limit(0)).count() == 0 and exactdedup.exact_groups(df.limit(0)).count() == 0
