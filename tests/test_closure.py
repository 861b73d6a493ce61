import pytest

from sheaf.functions import graphs


def test_closure_goes_past_any_depth(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(40)], "doc_id int, src int, dst int")
    roots = spark.createDataFrame([(1, 0)], "doc_id int, node int")
    assert graphs.closure(roots, edges, ["doc_id"]).count() == 41
    with pytest.raises(ValueError):
        graphs.closure(roots, edges, ["doc_id"], 3)


def test_long_chains_of_removed_nodes(spark, monkeypatch):
    """A chain of 2,000 in 11 doubled rounds; cycles, branches, ends without a successor and no rows at all."""
    rounds, write = [], graphs.stage
    monkeypatch.setattr(graphs, "stage", lambda df: rounds.append(1) or write(df))
    chain = [(1, i, i + 1) for i in range(2000)]
    others = [(2, 1, 2), (2, 2, 1), (2, 2, 9), (3, 1, 1), (4, 1, 2), (5, 1, 7), (5, 1, 8), (5, 2, 1)]
    nexts = spark.createDataFrame(chain + others, "doc_id int, src int, dst int")
    gone = [(1, i) for i in range(2000)] + [(2, 1), (2, 2), (3, 1), (4, 1), (4, 2), (5, 1), (5, 2)]
    got = graphs.successors_outside(spark.createDataFrame(gone, "doc_id int, node int"), nexts, ["doc_id"]).collect()
    assert sorted(map(tuple, got)) == sorted([(1, i, 2000) for i in range(2000)] + [(2, 1, 9), (2, 2, 9), (5, 1, 7), (5, 1, 8), (5, 2, 7), (5, 2, 8)])
    assert len(rounds) <= 13
    empty = spark.createDataFrame([], "doc_id int, node int")
    assert graphs.successors_outside(empty, nexts, ["doc_id"]).count() == 0
