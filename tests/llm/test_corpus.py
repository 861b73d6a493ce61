import hashlib
import re
from collections import Counter

import pytest

import check
import corpus_pipeline
from sheaf.llm import mixing, queries, toxicity, urlrules
from sheaf.session import stage


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_oracle(spark, name, folder):
    sf = f"/root/testdata/{folder}"
    rows, verdict = check.compare(spark, check.connect(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert verdict == "ok", verdict


def fitting(pattern, target):
    """The pattern language by hand."""
    start = pattern.startswith("||")
    body = re.escape(pattern.removeprefix("||").removesuffix("|")).replace(r"\^", r"(?:[^A-Za-z0-9_.%-]|\Z)").replace(r"\*", ".*")
    return re.search("(?s)" + (r"^(?:[^/?#]*\.)?" if start else "") + body + (r"\Z" if pattern.endswith("|") else ""), target)


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/EN/", "http://notexample.com/en/a",
        "http://example.com", "http://com/", "http://a.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.org/login", "http://a.org/login?x", "http://a.org/logins",
        "http://a.org/blogin/", "http://a.org/tag/x/page/2", "http://ads.a.org/", "http://bads.a.org/", "http://a.org/a.jpg", "http://a.org/a.jpgx", "http://a.org/?utm_source=x",
        "http://a.org/?xutm_source=x", "http://user@a.com:80/p", "http://a.org/feed/", "http://a.org/feed/x", "http://a.org/é/login/", "x://y://z.com/", "http://a.com/\nq",
        "http://a.org/K/login/", "http://a.org/" + "x/" * 30000 + "cart/", "http://a.com/en", "http://a.com/en", "http://é.com/"]


def test_url_verdicts(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(None, "http://a.com/"), (0, "http://a.com/")], "page_id bigint, url string").selectExpr(
        "*", "'x' AS address", "'y' AS token", "'z' AS target", "1 AS r")
    got = urlrules.judge(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        host = "".join(c.lower() if c.isascii() else c for c in re.match(r"[^/?#]*", rest)[0])
        tail = rest[len(host):]
        path = re.match(r"[^?#]*", tail)[0]
        rules = [(len(s), s, v) for s, _, v in urlrules.HOST_RULES for h, p in [s.split("/", 1)]
                 if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule, verdict = max(rules)[1:] if rules else (None, "block" if any(fitting(p, host + tail) for p, _ in urlrules.PATTERN_RULES) else "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), r["url"]
    assert urlrules.judge(df.limit(0)).count() == 0


def test_rules_without_tokens_are_tried_on_all(spark):
    pages = spark.createDataFrame([(1, "http://a.org/xyz"), (2, "http://a.org/q")], "page_id bigint, url string")
    rules = spark.createDataFrame([(1, None, "xy", "block"), (1, None, "*q|", "block"), (0, "shown", "never", "allow")], "rank int, shown string, pattern string, verdict string")
    assert {r["verdict"] for r in urlrules.judge(pages, rules).collect()} == {"block"}


def waterfill(sizes, weights, budget):
    level, full = dict.fromkeys(sizes, 0.0), set()
    while True:
        open_w = sum(weights[s] for s in sizes if s not in full)
        if not open_w:
            return {s: 2.0 * sizes[s] for s in sizes}
        each = (budget - sum(2 * sizes[s] for s in full)) / open_w
        over = {s for s in sizes if s not in full and each * weights[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else each * weights[s] for s in sizes}
        full |= over


def test_mix(docs_of, spark):
    rows = [(i, "w " * (i % 50), f"s{i % 7 if i % 3 else 0}") for i in range(600)] + [(700, None, "s1"), (701, "", None), (702, "a b", None), (None, "x y", "s1"),
            (5, "w w", "s5"), (5, "w w", "s5"), (800, "big " * 20000, "s2"), (801, None, "empty")]
    df = docs_of(rows).repartition(6)
    got = mixing.mixed_sizes(df).collect()
    assert len(got) == len(rows) and mixing.mixed_sizes(df).count() == len(rows)
    per = Counter()
    for _, t, s in rows:
        per[s] += len((t or "").split())
    order = sorted(per, key=lambda s: (s is None, s or ""))
    targets = waterfill(per, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(per.values()))
    taken = Counter()
    for r in got:
        assert r["source_size"] == per[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in per)
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(mixing.mixed_sizes(df.repartition(2)).collect()) == key(got)
    ends = [r["ends"] for r in mixing.schedule(mixing.mix(stage(mixing.sized_rows(df, "text", "source", "doc_id")))).collect()]
    assert ends == sorted(ends)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and max(Counter(r["doc_id"] for r in out.collect() if r["doc_id"] != 5).values()) <= 2
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.mixed_sizes(df.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark, docs_of):
    """Each stage against a plain version of its rule, on its own input."""
    import test_shingles as plain

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    model = queries.toxicity_model(spark, docs, sf)
    bad = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"]}
    one = stage(steps["toxicity"](spark, docs, sf))
    rows = {r["doc_id"]: r for r in one.collect()}
    assert one.columns == docs.columns and set(rows) == {r["doc_id"] for r in docs.collect()} - bad
    two = stage(steps["exact_dedup"](spark, one, sf))
    best = {}
    for r in rows.values():
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"]).encode()).hexdigest()
        best[digest] = min(best.get(digest, (1, 0)), (-len(r["text"]), r["doc_id"]))
    left = {r["doc_id"]: r["text"] for r in two.collect()}
    assert two.columns == docs.columns and set(left) == {i for _, i in best.values()}
    three = stage(steps["near_dedup"](spark, two, sf))
    _, firsts = plain.least_of_groups({i: plain.plain_set(t) for i, t in left.items()})
    assert three.columns == docs.columns and sorted(r["doc_id"] for r in three.collect()) == sorted(firsts)
    four = stage(steps["mixing"](spark, three, sf))
    served = {r["doc_id"]: r["taken"] / r["size"] if r["size"] else None for r in mixing.mixed_sizes(three).collect()}
    times = Counter(r["doc_id"] for r in four.collect())
    assert four.columns == docs.columns
    for i, share in served.items():
        assert times[i] == 1 if share is None else abs(times[i] - share) <= 0.5
    five = steps["packing"](spark, four, sf).collect()
    assert Counter(r["doc_id"] for r in five if r["start"] == 0) == times
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(five)


def test_pipeline_of_odd_documents(docs_of, spark):
    df = docs_of([(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, "x " * 40000, None)])
    for name, step in corpus_pipeline.STAGES:
        for given in (df, df.limit(0)):
            out = step(spark, given, "/root/testdata/sf0.001")
            assert name == "packing" or out.columns == df.columns
            assert bool(out.count()) == (given is df)
