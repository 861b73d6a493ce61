"""Steps that only larger tables tell apart: plans, exact medians, long keys."""

import random

import duckdb
from pyspark.sql import functions as F

from sheaf.functions.stabbing import stretches
from sheaf import fixtures
from sheaf.operators import layout, reconcile, tables, textops, visibility
from sheaf.plans import ingest


def test_key_search_broadcasts_nothing(spark):
    """Estimates of packed files are small; the keys and texts in them are not."""
    spans = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("span_no"), F.concat(F.lit("Order no. "), "id", F.lit(" § 7")).alias("text"))
    keys = spark.range(20).select(F.concat(F.lit("Order no. "), "id").alias("norm_key")).union(spark.createDataFrame([("§",), ("7",)], "norm_key string"))
    hits = reconcile.find_key_hits(spans, keys)
    assert hits.count() == 20 + 50 + 50
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()


def test_rollup_median_is_exact(spark, monkeypatch):
    """More distinct word counts than an approximate percentile keeps apart."""
    monkeypatch.setattr(textops, "text_stats", lambda df, text, by: df)
    zero = [F.lit(0).alias(c) for c in ("characters", "sentences", "paragraphs")]
    stats = spark.range(1000001).select(F.lit("x").alias("g"), ((F.col("id") * 7919) % 1000003).alias("words"), *zero)
    got = textops.corpus_rollup(stats, "t", ["g"]).collect()[0]
    assert got["median_words"] == sorted(i * 7919 % 1000003 for i in range(1000001))[500000]
    assert stats.agg(F.percentile_approx("words", 0.5, 10000)).collect()[0][0] != got["median_words"]


def test_record_keys_of_seven_digits(spark, tmp_path):
    """The SQL keeps keys beyond 999,999 whole, as the query does."""
    customers = spark.createDataFrame([(1000001 + i * 10, f"C{i}", 1.0) for i in range(40)], "c_custkey bigint, c_name string, c_acctbal double")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = ingest.QUERIES["s1_record_violations"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ingest.ORACLES["s1_record_violations"]).fetchall())


def test_record_files_of_a_table_with_empty_splits(spark, tmp_path):
    """One row group read in many splits: the first ones hold no customer, and write no file."""
    rows = spark.range(1, 3001).select(F.col("id").alias("c_custkey"), F.sha2(F.col("id").cast("string"), 256).alias("c_name"), F.lit(1.0).alias("c_acctbal"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 30000)
    try:
        first = spark.read.parquet(f"{tmp_path}/customer.parquet").rdd.glom().map(len).collect()[0]
        got = ingest.QUERIES["s1_record_violations"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert first == 0
    assert sorted(map(tuple, got)) == sorted(con.execute(ingest.ORACLES["s1_record_violations"]).fetchall())


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_pages_take_one_shuffle_a_state(spark):
    """A shuffle by page, and one behind each state, are all that lines, segments, runs and bands take; lines equal a plain
    walk down the page."""
    rng = random.Random(8)
    rows = [(p % 2, p, i, "w", float(rng.randrange(300)), rng.randrange(400) / 4, 5.0, float(rng.randrange(2, 14))) for p in range(6) for i in range(60)]
    spans = spark.createDataFrame(rows, "doc_id int, page int, span_no int, text string, x double, y double, width double, size double")
    for mode, limit in (("word", lambda a, s: max(1.0, 0.3 * min(a, s))), ("text", lambda a, s: 0.45 * max(a, s, 1.0))):
        got = {(r.page, r.span_no): r.line_no for r in layout.cluster_lines(spans, mode).collect()}
        for page in range(6):
            line, anchor, size = 0, None, 0.0
            for r in sorted((r for r in rows if r[1] == page), key=lambda r: (r[5], r[4], r[2])):
                if anchor is None or r[5] - anchor > limit(size, r[7]):
                    line, anchor, size = line + 1, r[5], 0.0
                size = max(size, r[7])
                assert got[page, r[2]] == line
    lined = layout.cluster_lines(spans)
    words = lined.withColumns({"x0": F.col("x"), "x1": F.col("x") + F.col("width")})
    rules = spans.select("doc_id", "page", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), (F.col("y") + 9).alias("y1"))
    tables = layout.detect_tables(layout.segmented(layout.segment_lines(words)))
    for df, most in ((layout.line_text(lined), 2), (tables, 3), (layout.merge_intervals(rules, False, "vector"), 2)):
        assert _exchanges(df) <= most


def test_table_checks_shuffle_cells_once(spark):
    """Types, merges, total rows and sections of a table follow one shuffle of its cells; grand totals sum the sections before."""
    rows = [("t", r, c, x) for r, line in enumerate([("Item", "A"), ("a", "1"), ("b", "2"), ("Subtotal", "3"), ("c", "4"), ("d", "5"), ("Subtotal", "9"), ("Grand total", "12")])
            for c, x in enumerate(line)]
    cells = spark.createDataFrame(rows, "table_id string, row int, col int, text string")
    headers = spark.createDataFrame([("t", 1)], "table_id string, header_rows int")
    merges = spark.createDataFrame([("t", 1, 0, 0, 0, 1)], "table_id string, merge_no int, start_row int, end_row int, start_col int, end_col int")
    totals = tables.reconcile_totals(tables.conservative_cast(cells, headers), merges, headers)
    assert _exchanges(totals) <= 10
    assert sorted((r["row"], r["label"], r["status"], int(r["expected"])) for r in totals.collect()) == [
        (3, "subtotal", "PASS", 3), (6, "subtotal", "PASS", 9), (7, "grand-total", "PASS", 12)]


def test_tables_of_many_merges(spark):
    """Tables with more merges than are looked through one by one give the same cells."""
    cells = spark.createDataFrame([(t, r, c, "x") for t in "fm" for r in range(200) for c in range(3)], "table_id string, row int, col int, text string")
    some = [("f", i, 9 * i, 9 * i + 2, 0, 1) for i in range(20)] + [("m", i, 2 * i, 2 * i + 1, 1, 2) for i in range(tables.FEW_MERGES + 20)]
    merges = spark.createDataFrame(some, "table_id string, merge_no int, start_row int, end_row int, start_col int, end_col int")
    want = {(t, r, c) for t, _, r0, r1, c0, c1 in some for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if r < 200 and (r, c) != (r0, c0)}
    assert {tuple(r)[:3] for r in tables._flag_subordinates(cells, merges).filter("subordinate").collect()} == want
    evidence = spark.createDataFrame([(t, r0, c0, r0, "e") for t, _, r0, _, c0, _ in some], "table_id string, row int, col int, page int, source_text string")
    traced = {(r["table_id"], r["row"], r["col"]): (r["anchor_row"], r["page"]) for r in tables.trace_cell(cells, evidence, merges, cells).filter("notice = 'merged-subordinate'").collect()}
    first = {(t, r, c): r0 for t, _, r0, r1, c0, c1 in some for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}
    assert traced == {k: (first[k], first[k]) for k in want}


def test_stretches_look_at_as_many_levels_as_the_interval_has(spark):
    one = spark.range(1).select(stretches(F.lit(7), F.lit(7)).alias("s"))
    assert "sequence(0, 62" not in one._jdf.queryExecution().analyzed().toString() and one.first()["s"] == [(0, 7)]


def test_covered_share_shuffles_once(spark):
    intervals = spark.createDataFrame([("p", 0.0, 4.0), ("p", 2.0, 6.0), ("p", 6.0, 6.0), ("q", 1.0, 2.0)], "page string, start double, end double")
    windows = spark.createDataFrame([("p", 1.0, 7.0, "a"), ("p", 1.0, 7.0, "a"), ("q", 2.0, 2.0, "b"), ("r", 0.0, 1.0, "c")], "page string, w_start double, w_end double, note string")
    df = layout.covered_share(intervals, windows, ["page"])
    assert _exchanges(df) == 1
    assert sorted((r["page"], r["note"], round(r["share"], 9)) for r in df.collect()) == [("p", "a", 0.833333333)] * 2 + [("q", "b", 0.0), ("r", "c", 0.0)]


def test_bands_follow_their_first_rule_or_median(spark):
    """In one shuffle, for positions that repeat, drift and jump."""
    rng = random.Random(4)
    rows = [(0, p, x, 10.0 * i, x, 10.0 * i + 5) for p in range(8) for i, x in enumerate(rng.choice([20, 40]) + rng.randrange(24) / 4 for _ in range(30))]
    rules = spark.createDataFrame(rows, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    for mode in ("word", "vector"):
        df = layout.merge_intervals(rules, False, mode)
        assert _exchanges(df) == 1
        got = {(r["page"], r["band_no"], r["start"]) for r in df.collect()}
        want = set()
        for page in range(8):
            band, group = 0, []
            for x, y in sorted((r[2], r[3]) for r in rows if r[1] == page):
                held = group and (group[0] if mode == "word" else group[len(group) // 2])
                if not group or (x - held >= 1.5 if mode == "word" else x - held > 1.5):
                    band, group = band + 1, []
                group.append(x)
                want.add((page, band, y))
        assert got == want


def test_narrow_bands_are_not_walked(spark):
    """Rules close to their first are one band without a fold, and no fold lists a page's positions again at each step."""
    rows = [(0, 0, x, 10.0 * i, x, 10.0 * i + 10) for i in range(600) for x in (20.0, 20.75, 90.0)]
    rules = spark.createDataFrame(rows, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    for mode, first in (("word", 20.0), ("vector", 20.75)):
        df = layout.merge_intervals(rules, False, mode)
        assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, df.collect())) == [(0, 0, 1, first, 0.0, 6000.0), (0, 0, 2, 90.0, 0.0, 6000.0)]


def test_lines_and_runs_take_one_shuffle_and_no_python(spark):
    """Lines, segments and runs of a page follow in its one shuffle; only pages with wide lines or runs are walked."""
    rows = [(1, p, 10 * r + c, "w", 100.0 * c, 20.0 * r + p * c, 5.0, 9.0) for p in (0, 2) for r in range(6) for c in range(3)]
    spans = spark.createDataFrame(rows, "doc_id int, page int, span_no int, text string, x double, y double, width double, size double")
    lined = layout.cluster_lines(spans)
    words = lined.withColumns({"x0": F.col("x"), "x1": F.col("x") + F.col("width")})
    runs = layout.detect_tables(layout.segmented(layout.segment_lines(words)))
    for df in (lined, runs):
        assert _exchanges(df) == 1 and "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.page, r.span_no): r.line_no for r in lined.collect()} == {
        (p, 10 * r + c): r + 1 if p == 0 else 2 * r + 1 + (c == 2) for p in (0, 2) for r in range(6) for c in range(3)}
    assert {(r.page, r.run_no, r.line_no, r.columns) for r in runs.collect()} == {(0, 1, r + 1, 3) for r in range(6)}


def test_words_meet_their_page_unsorted(spark, sf):
    """Whatever the size: one shuffle of words, one of pages, no sort; grid cells are not joined with their components again."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = spark.createDataFrame([(1, 1, 5.0, 5.0, True), (1, 1, 900.0, 5.0, True), (1, 2, 5.0, 5.0, False)], "doc_id int, page int, x double, y double, hidden boolean")
        pages = spark.createDataFrame([(1, 1, 612.0, 792.0, 0), (1, 2, 612.0, 792.0, 1)], "doc_id int, page int, width double, height double, images int")
        edges = pages.select("doc_id", "page", F.array(F.lit(0.0), F.lit(600.0)).alias("xs"), F.array(F.lit(0.0), F.lit(700.0)).alias("ys"))
        placed = words.select("doc_id", "page", F.lit(1).alias("word_no"), F.lit("w").alias("text"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(9.0).alias("size"))
        off, hidden, counts = visibility.offpage_text(words, pages), visibility.hidden_text_class(words, pages), layout.assign_words_to_grid(placed, edges)[1]
        for df in (off, hidden, counts):
            assert _exchanges(df) == 2 and "Sort" not in df._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in off.collect()] == [(1, 1, 1)]
        assert [tuple(r) for r in hidden.collect()] == [(1, 1, 1, 0, "suspicious hidden text")]
        assert sorted(map(tuple, counts.collect())) == [(1, 1, 2, 1), (1, 2, 1, 1)]
        cells = spark.createDataFrame([(1, 1, r, c) for r in range(2) for c in range(2)], "doc_id int, page int, row int, col int")
        sides = spark.createDataFrame([(1, 1, 0, 0, 0, 1)], "doc_id int, page int, row int, col int, to_row int, to_col int")
        grid = layout.grid_components(cells, sides)
        assert _exchanges(grid) <= 4 and grid._jdf.queryExecution().executedPlan().toString().count("Join") == 1
        assert [tuple(r)[2:6] for r in layout.component_merges(grid).collect()] == [(0, 0, 0, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_pages_of_words_are_found_once(spark, sf):
    """Titles, numbers and footers read one table of pages instead of looking for the pages of all words three times."""
    plan = fixtures.load(spark, sf, "fx_spans")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan



def test_text_layers_meet_in_one_shuffle(spark):
    """Layers meet by page alone, whether a token is rare or fills a page; the result is that of comparing all words of a page."""
    rng = random.Random(18)
    new, old = [], []
    for page in range(6):
        n = 400 if page % 3 == 0 else 14
        for i in range(n):
            token = "a" if page % 3 == 0 else rng.choice("abcd")
            new.append((1, page, i, token, rng.uniform(0, 600), rng.uniform(0, 780), 0.0, rng.choice((8.0, 20.0, 45.0)), rng.choice((9.0, 14.0))))
        for i, w in enumerate(rng.sample(new[-n:], n * 2 // 3)):
            old.append((*w[:2], i, w[3], w[4] + rng.uniform(-9, 9) * page / 2, w[5] + rng.uniform(-4, 4), 0.0, w[7], w[8], page % 2 == 1 or i % 2 == 0))
    # two hidden words that only one recognised word serves
    new += [(1, 9, 0, "z", 100.0, 100.0, 0.0, 5.0, 10.0), (1, 9, 1, "q", 300.0, 300.0, 0.0, 5.0, 10.0)]
    old += [(1, 9, 0, "z", 101.0, 100.0, 0.0, 5.0, 10.0, True), (1, 9, 1, "z", 102.0, 100.0, 0.0, 5.0, 10.0, True), (1, 9, 2, "q", 300.0, 300.0, 0.0, 5.0, 10.0, False)]
    fields = "doc_id int, page int, word_no int, text string, x double, y double, angle double, width double, height double"
    a, b = spark.createDataFrame(new, fields), spark.createDataFrame(old, fields + ", hidden boolean")
    pages = a.select("doc_id", "page").distinct().withColumns({"width": F.lit(620.0), "height": F.lit(790.0)})

    centre = lambda w: (w[4] + w[7] / 2, w[5] + w[8] / 2)
    far = lambda v, w: ((centre(v)[0] - centre(w)[0]) ** 2 + (centre(v)[1] - centre(w)[1]) ** 2) ** 0.5

    def lies(v, w):
        ratio = lambda i: max(v[i], w[i]) / max(1, min(v[i], w[i]))
        return v[1] == w[1] and v[3] == w[3] and ratio(7) <= 4 and ratio(8) <= 4 and far(v, w) <= max(10, v[8] * 1.6, w[8] * 1.6, min(v[7], w[7]) * 0.3)

    bad = set()
    for page in {w[1] for w in old}:
        taken = set()
        for e in sorted((e for e in old if e[1] == page and e[9]), key=lambda e: e[2]):
            places = sorted((far(e, w), w[2]) for w in new if lies(e, w))
            free = next((w for _, w in places if (e[3], w) not in taken), None)
            taken.add((e[3], free))
            odd = not (-4 <= centre(e)[0] <= 624 and -4 <= centre(e)[1] <= 794)
            if odd or free is None and any(w[1] == page and w[3] == e[3] for w in new):
                bad.add((1, page))
    kept = [e for e in old if not (e[9] and (1, e[1]) in bad)]
    left = {w[:3] for w in new if not any(lies(w, e) for e in kept)}
    found = layout.hidden_layer_unreliable(a, b, pages)
    assert 0 < len(bad) < 7 and {tuple(r) for r in found.collect()} == bad
    got = layout.dedupe_text_layer(a, b, pages)
    rows = got.select("doc_id", "page", "word_no").collect()
    assert {tuple(r) for r in rows} == left and len(rows) == len(left) and got.columns == a.columns
    for df in (got, layout.hidden_layer_unreliable(a, b, pages)):
        assert _exchanges(df) <= 3
