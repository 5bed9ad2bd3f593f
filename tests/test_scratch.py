import os

from lodestream import scratch


def test_tables_live_in_the_configured_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "checkpoint_root", lambda s: f"file://{tmp_path}")
    t = scratch.materialize(spark.range(5).withColumnRenamed("id", "x"), "t")
    assert t.count() == 5 and t.columns == ["x"]
    one = os.path.join(tmp_path, "lodestream", spark.sparkContext.applicationId)
    assert len(os.listdir(one)) == 1
    scratch.release(t)
    assert os.listdir(one) == []
    scratch.materialize(spark.range(5), "u")
    scratch.clear_scratch(spark)
    assert not os.path.exists(one)


def test_empty_and_partitioned_tables(spark):
    assert scratch.materialize(spark.range(0), "e").columns == ["id"]
    p = scratch.materialize(spark.range(10).selectExpr("id", "id % 2 AS part"), "p", partition_by="part")
    assert p.where("part = 1").count() == 5
