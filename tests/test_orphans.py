from datetime import datetime
from inspect import signature

import pytest
from pyspark.sql import functions as F

from rivulet.operators.orphans import Reference, Table, knowledge_base_orphans, orphans, orphans_by_month

from .conftest import collected

T1, T2, T3 = datetime(2024, 1, 5), datetime(2024, 2, 5), datetime(2024, 3, 5)


def test_direct_and_inherited(spark):
    a = spark.createDataFrame([(1, T1, None), (2, T1, T3), (3, T3, None)], "id long, made timestamp, gone timestamp")
    b = spark.createDataFrame([(10, 1, T2), (11, 2, T2), (12, 9, T2), (13, 3, T2), (14, None, T2), (15, 9, None), (15, 9, None)], "id long, a_id long, made timestamp")
    c = spark.createDataFrame([(100, 12), (101, 10), (102, 13), (103, None)], "id long, b_id long")
    d = spark.createDataFrame([(7, 100)], "id long, c_id long")
    tables = [
        Table("a", a, F.col("id"), F.col("id"), F.col("made"), F.col("gone")), Table("b", b, F.col("id"), F.col("id"), F.col("made")),
        Table("c", c, F.col("id"), F.col("id")), Table("d", d, F.col("id"), F.col("id")),
    ]
    found = orphans(spark, tables, [Reference("b", "a", F.col("a_id")), Reference("c", "b", F.col("b_id")), Reference("d", "c", F.col("c_id"))])
    got = {(r["table_name"], r["record_key"], r["reason"], r["level"], r["ref_month"]) for r in found.collect()}
    assert got == {
        ("b", "11", "deleted", 1, "2024-02"), ("b", "12", "missing", 1, "2024-02"), ("b", "13", "late", 1, "2024-02"), ("b", "15", "missing", 1, "unknown"),
        ("c", "100", "inherited", 2, "unknown"), ("d", "7", "inherited", 3, "unknown"),
    }
    counts = {(r["table_name"], r["kind"]): r["n"] for r in orphans_by_month(found).collect()}
    assert counts["d", "inherited"] == 1


def test_cyclic_references_end(spark):
    p = spark.createDataFrame([(1, 2), (2, 1), (3, 99), (4, 3), (5, 4)], "id long, next long")
    found = orphans(spark, [Table("p", p, F.col("id"), F.col("id"))], [Reference("p", "p", F.col("next"))])
    assert {(r["record_key"], r["level"]) for r in found.collect()} == {("3", 1), ("4", 2), ("5", 3)}


def test_no_silent_end_of_the_cascade(spark):
    assert signature(orphans).parameters["max_rounds"].default is None
    p = spark.createDataFrame([(i, i - 1) for i in range(1, 6)], "id long, next long")
    run = lambda **more: orphans(spark, [Table("p", p, F.col("id"), F.col("id"))], [Reference("p", "p", F.col("next"))], **more)
    assert {(r["record_key"], r["level"]) for r in run().collect()} == {(str(i), i) for i in range(1, 6)}
    with pytest.raises(RuntimeError):
        run(max_rounds=3)


def test_rings_without_keys_end(spark):
    p = spark.createDataFrame([(1, 2, None), (2, 1, None), (1, 99, "a")], "id long, next long, name string")
    found = orphans(spark, [Table("p", p, F.col("name"), F.col("id"))], [Reference("p", "p", F.col("next"))], max_rounds=8)
    assert {(r["record_key"], r["level"]) for r in found.collect()} == {("a", 1), (None, 2), (None, 3)}


def test_empty_tables(spark, tmp_path):
    t = {
        "bridges": "id long, created_at timestamp, deleted_at timestamp", "bridge_examples": "id long, bridge_id long, created_at timestamp",
        "centrality": "subject string, created_at timestamp", "entries": "id long, subject string, object string",
    }
    for name, schema in t.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert knowledge_base_orphans(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(1, 5, T1), (2, None, T1)], t["bridge_examples"]).write.mode("overwrite").parquet(f"{tmp_path}/bridge_examples.parquet")
    spark.createDataFrame([(" X ", None), ("!!", None), (None, T1), (" X ", None)], t["centrality"]).write.mode("overwrite").parquet(f"{tmp_path}/centrality.parquet")
    got = collected(knowledge_base_orphans(spark, str(tmp_path)).select("table_name", "record_key", "ref_month", "reason"))
    assert got == [("bridge_examples", "1", "2024-01", "missing"), ("centrality", " X ", "unknown", "missing"), ("centrality", " X ", "unknown", "missing")]
