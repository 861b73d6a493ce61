import os
from sheaf.session import Stages, shared_folder, stage


def test_owned_stages_are_deleted(spark):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with Stages() as own:
        a = own.stage(spark.range(5))
        b = own.stage(a.selectExpr("id + 1 AS id"))
        own.drop(a, spark.range(1))
        assert len(set(os.listdir(folder)) - before) == 1 and b.count() == 5
        out = stage(b)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() == 5
