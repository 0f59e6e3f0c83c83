from __future__ import annotations

import pytest

from tests.conftest import rows
from tidemark import session
from tidemark.catalog import Catalog
from tidemark.sources.tables import load_texts


def test_stage_survives_its_source_and_can_be_swept(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    kept = session.stage(df, "t")
    assert kept.schema == df.schema and rows(kept) == rows(df)
    path = session._made[spark.sparkContext.applicationId][-1]
    assert path.startswith(session.scratch_root(spark)) and rows(spark.read.parquet(path)) == rows(df)
    session.sweep(spark)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)


def test_small_tables_are_dealt_out(spark, tmp_path):
    spark.range(100).selectExpr("id", "'t' AS text", "1 AS other").coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    df = load_texts(spark, str(tmp_path), "d", "id", "text")
    assert df.columns == ["id", "text"] and df.count() == 100 and df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_catalog_refuses_a_name_twice():
    c, d = Catalog(), Catalog()
    for x in (c, d):
        x.query("q", "SELECT 1")(lambda spark, path: None)
    for again in (lambda: c.query("q")(lambda spark, path: None), lambda: c.include(d)):
        try:
            again()
        except ValueError:
            continue
        raise AssertionError


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Away:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext, conf = Away(), {}

    with pytest.raises(RuntimeError, match="share"):
        session.scratch_root(Session())
    Away.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="share"):
        session.scratch_root(Session())
