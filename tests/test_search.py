import random

import pytest

from sheaf.operators import layout, web

ITEM = "item_no bigint, href string, name string, description string, category string, keywords array<string>, available boolean"


def test_search_by_rarest_gram(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 6)))
    items = [(i, None if i % 17 == 0 else f"/{i}", word(), word(), rng.choice("xy"), [word(), word()], i % 5 > 0) for i in range(200)]
    queries = [(i, rng.choice([word(), word() + word(), "", " ", "A", "b c", "zzz", "x"])) for i in range(150)]
    got = web.search_catalog(spark.createDataFrame(items, ITEM), spark.createDataFrame([("x", "Ex")], "category string, category_name string"),
                             spark.createDataFrame(queries, "query_no bigint, query string"), k=3).collect()
    want = []
    for no, query in queries:
        q, rank = query.strip().lower(), 0
        for i, href, name, description, category, keywords, available in items:
            text = " ".join([name, description, category, "Ex" if category == "x" else "", " ".join(keywords)]).lower()
            if q and available and href and q in text and rank < 3:
                rank += 1
                want.append((no, rank, i, href))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_covered_share_counts_overlaps_once(spark):
    rng = random.Random(4)
    intervals = [(rng.choice("pq"), float(a), float(a + rng.randrange(0, 30))) for a in (rng.randrange(3000) for _ in range(120))]
    windows = [(rng.choice("pqr"), float(a), float(a + rng.randrange(0, 200))) for a in (rng.randrange(3000) for _ in range(80))]
    windows += windows[:3]
    got = layout.covered_share(spark.createDataFrame(intervals, "page string, start double, end double"),
                               spark.createDataFrame(windows, "page string, w_start double, w_end double"), ["page"]).collect()
    plain = lambda p, a, b: sum(any(i[0] == p and i[1] <= x < i[2] for i in intervals) for x in range(int(a), int(b))) / (b - a) if b > a else 0.0
    want = sorted((p, a, b, plain(p, a, b)) for p, a, b in windows)
    assert len(got) == len(want)
    for g, w in zip(sorted(tuple(r) for r in got), want):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3])
