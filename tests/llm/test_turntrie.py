import hashlib
import random
import re
import zlib

import pytest

from sheaf.llm import queries, turntrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, rebuild=True):
    """All nodes from a dictionary of prefixes."""
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    full = own
    if rebuild:
        full = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            full[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(full[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def check_rows(got, want):
    found = sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got)
    assert len(found) == len(want)
    assert found == want, next((a, b) for a, b in zip(found, want) if a != b)


def some_rows():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 140), 205, 399, 400, -3]:
        if c % 20 == 0 and c in (40, 60):
            continue  # absent bases
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            text = rng.choice(["hi", "hello there", "what is this", None, "", "a  b\tc"]) if rng.random() < 0.7 else f"w {rng.randrange(50)}"
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), text))
    rows += [(500 + i, t, "user", f"copy {t}") for i in range(60) for t in range(4)] + [(700, 0, "user", "twice")] * 3
    rows += [(None, 0, "user", "nobody")] * 3 + [(41, 1, "user", "long " * 50000)]
    rows += [(800, t, "user", f"deep {t}") for t in range(70)] + [(801, t, "user", f"deep {t}") for t in range(33)] + [(802, t, "user", f"deep {t}") for t in range(64)]
    return rows + [(803, t, "user", f"deep {t}") for t in range(16)] + [(804, t, "user", f"deep {t}" if t < 40 else f"else {t}") for t in range(90)]


@pytest.mark.parametrize("stride, shard_turns", [(512, 1 << 18), (8, 40), (1, 1)])
def test_against_all_prefixes(spark, stride, shard_turns):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS pos", "2 AS depth", "3 AS words", "'y' AS key").repartition(6)
    for rebuild in (True, False):
        check_rows(turntrie.prefix_trie(df, rebuild=rebuild, stride=stride, shard_turns=shard_turns).collect(), plain(rows, rebuild))


def test_small_tables(spark):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    assert turntrie.prefix_trie(df.limit(0)).count() == 0 and turntrie.prefix_trie(df.where("conv_id IS NULL")).count() == 0
    one = [(3, 0, "user", "a b")]  # its base is absent
    check_rows(turntrie.prefix_trie(spark.createDataFrame(one, SCHEMA)).collect(), plain(one))


def test_tree_is_balanced_by_medians():
    assert sorted(turntrie.medians(100)) == list(range(100)) and next(turntrie.medians(100)) == 50
    tree = turntrie.Tree()
    for i in turntrie.medians(1023):
        tree.add([i, 7], [1, 1], (1, i, False, None))
    deepest, frontier = 0, [(tree.first[0], 1)]
    while frontier:
        node, d = frontier.pop()
        deepest = max(deepest, d)
        frontier += [(x, d + 1) for x in (tree.low[node], tree.high[node]) if x >= 0]
    assert deepest == 10 and tree.path([5, 7])[0] == 0


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_query_over_whole_tables(spark, folder):
    sf = f"/root/testdata/{folder}"
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    check_rows(queries.op13_prefix_trie(spark, sf).collect(), plain(rows))
