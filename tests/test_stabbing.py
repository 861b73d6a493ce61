import random

from pyspark.sql import functions as F

from sheaf.functions.stabbing import covering, stretches
from sheaf.operators import tables

AREA = "table_id string, merge_no int, start_row bigint, end_row bigint, start_col bigint, end_col bigint"


def test_stretches_make_up_the_interval(spark):
    rng = random.Random(1)
    spans = [(a, b) for a in range(9) for b in range(a, 17)] + [(a, a + rng.randrange(300)) for a in (rng.randrange(5000) for _ in range(200))]
    rows = spark.createDataFrame(spans, "a bigint, b bigint").select("a", "b", stretches(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        held = [x for p in r["s"] for x in range(p["at"] << p["level"], (p["at"] + 1) << p["level"])]
        assert sorted(held) == list(range(r["a"], r["b"] + 1)), (r["a"], r["b"])
    big = spark.createDataFrame([(3, 10**15)], "a bigint, b bigint").select(stretches(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert len(big) <= 100 and sum(1 << p["level"] for p in big) == 10**15 - 2


def test_points_in_rectangles(spark):
    rng = random.Random(2)
    points = [(rng.choice("xy"), rng.randrange(40), rng.randrange(12)) for _ in range(300)]
    areas = [(rng.choice("xyz"), i, a, a + rng.randrange(20), c, c + rng.randrange(6)) for i in range(60) for a, c in [(rng.randrange(40), rng.randrange(12))]]
    got = covering(spark.createDataFrame(points, "table_id string, row bigint, col bigint"), spark.createDataFrame(areas, AREA), ["table_id"]).collect()
    want = sorted((*p, m[1]) for p in points for m in areas if p[0] == m[0] and m[2] <= p[1] <= m[3] and m[4] <= p[2] <= m[5])
    assert sorted((r["table_id"], r["row"], r["col"], r["merge_no"]) for r in got) == want


def test_a_merge_of_any_size_costs_a_few_rows(spark):
    cells = spark.createDataFrame([("t", r, c, f"{r}{c}") for r in range(3) for c in range(3)] + [("u", 0, 0, "a"), ("u", 1, 0, "")], "table_id string, row bigint, col bigint, text string")
    merges = spark.createDataFrame([("t", 0, 1, 10**9, 1, 10**9), ("t", 1, 5, 2, 0, 0), ("u", 0, 0, 1, 0, 0), ("u", 1, 0, 10**9, 0, 10**9), ("u", 2, -1, 3, 0, 0)], AREA)
    flagged = {(r["table_id"], r["row"], r["col"]) for r in tables._flag_subordinates(cells, merges).filter("subordinate").collect()}
    assert flagged == {("t", 1, 2), ("t", 2, 1), ("t", 2, 2), ("u", 1, 0)}
    outcomes = {(r["table_id"], r["merge_no"]): r["outcome"] for r in tables.plan_merges(cells, merges).collect()}
    assert outcomes == {("t", 0): "skipped", ("t", 1): "skipped", ("u", 0): "applied", ("u", 1): "skipped", ("u", 2): "skipped"}
    evidence = spark.createDataFrame([("t", 1, 1, 4, "here")], "table_id string, row bigint, col bigint, page int, source_text string")
    chosen = spark.createDataFrame([("t", 2, 2), ("t", 0, 0), ("t", 10**8, 5)], "table_id string, row bigint, col bigint")
    notices = {r["row"]: (r["notice"], r["anchor_row"], r["source_text"]) for r in tables.trace_cell(cells, evidence, merges, chosen).collect()}
    assert notices == {2: ("merged-subordinate", 1, "here"), 0: ("no-source-location", None, None), 10**8: ("merged-subordinate", 1, "here")}
