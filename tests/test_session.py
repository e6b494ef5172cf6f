"""Lineage cuts and spreading."""

import pytest

from millrace.session import cut_lineage, ensure_checkpoint_dir, spread


def test_checkpoints_lie_in_one_folder(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder and ensure_checkpoint_dir(spark)
    df = cut_lineage(spark.range(10).selectExpr("id * 2 AS x"))
    assert df.count() == 10 and "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_spreading_only_where_it_helps(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert one.rdd.getNumPartitions() == 1 and spread(one).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many) is many
    shuffled = one.groupBy("id").count()
    assert spread(shuffled) is shuffled
    assert sorted(r.id for r in spread(one).collect()) == list(range(100))


def test_only_one_machine_makes_its_own_folder():
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None
            self._jsc = self
        sc = lambda self: self
        getCheckpointDir = lambda self: type("None_", (), {"isDefined": lambda _: False})()

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, named=None):
            self.sparkContext = Context(master)
            self.conf = type("Conf", (), {"get": lambda _, key, default: named})()

    assert ensure_checkpoint_dir(Session("local[4]")).startswith("file://")
    assert ensure_checkpoint_dir(Session("spark://host:7077", "hdfs://shared/x")) == "hdfs://shared/x"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(Session(master))
