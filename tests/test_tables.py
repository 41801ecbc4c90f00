"""The folder of intermediate tables."""

from types import SimpleNamespace

import pytest

from quirelake.sources import tables


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k.replace(".", "_"), default)), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_folder(session(master))
        assert tables.shared_folder(session(master, spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert tables.shared_folder(session("local[4]")).startswith("file:///") and tables.shared_folder(session("local")) == tables.shared_folder(session("local[*]"))


def test_settings_stay_and_tables_go(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    at = tables.mark()
    one = tables.written(spark.range(5), "test")
    kept = tables.mark()
    two = tables.written(spark.range(7), "test")
    assert one.count() == 5 and two.count() == 7 and spark.conf.get("spark.checkpoint.dir", None) == before
    tables.clean(spark, kept)
    assert tables.mark() == kept and one.count() == 5
    with pytest.raises(Exception):
        spark.catalog.clearCache()
        spark.read.parquet(two.inputFiles()[0] if two.inputFiles() else "/nowhere").count()
    tables.clean(spark, at)
    assert tables.mark() == at
