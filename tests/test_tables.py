import os
from types import SimpleNamespace

import pytest

from rivulet import tables


def test_no_folder_is_left(spark):
    tables.close(spark)
    where = tables.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    work = tables.Work(spark, "test")
    kept = work.put(spark.range(5))
    dropped = work.put(spark.range(7))
    assert kept.count() == 5 and len(set(os.listdir(where)) - before) == 1
    work.drop(dropped)
    assert os.listdir(os.path.join(where, *(set(os.listdir(where)) - before))) == ["1"]
    tables.close(spark)
    assert set(os.listdir(where)) == before


@pytest.mark.parametrize(("master", "alone"), [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("k8s://https://x", False), ("spark://h:7077", False)])
def test_a_cluster_needs_a_shared_folder(master, alone):
    assert tables.on_one_machine(master) == alone
    context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    if not alone:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_dir(session)


def test_skew_join_keeps_every_row(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 99), (None, 100)], "k string, v int")
    right = spark.createDataFrame([("hot", "x"), ("cold", "y"), ("other", "z")], "k string, w string")
    for how, n in (("inner", 51), ("left", 52), ("left_semi", 51), ("left_anti", 1)):
        assert tables.skew_join(left, right, "k", ["hot"], how, "v").count() == n
        assert tables.skew_join(left, right, "k", [], how, "v").count() == n
