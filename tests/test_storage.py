import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from helixmark import storage


def files(df):
    return os.path.isdir(df._helixmark_path.removeprefix("file://"))


def test_tables_are_written_and_removed(spark):
    a = storage.materialise(spark.range(5), "a")
    assert a.count() == 5 and files(a) and a._helixmark_path.startswith(storage.work_dir(spark))
    storage.discard(a, spark.range(1))
    assert not files(a)
    with storage.Scope() as made:
        b, c = storage.materialise(spark.range(1), "b"), storage.materialise(spark.range(2), "c")
        made.release(c)
    d = storage.materialise(spark.range(1), "d")
    assert not files(b) and files(c) and files(d) and c.count() == 2
    storage.discard(c, d)


def test_a_cluster_must_name_its_folder():
    conf = SimpleNamespace(get=lambda k, default=None: default)
    for master in ("yarn", "spark://x:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    given = SimpleNamespace(get=lambda k, default=None: "hdfs://n/ck/")
    assert storage.shared_dir(SimpleNamespace(conf=given)) == "hdfs://n/ck"


def test_few_files_keep_the_plan_s_tasks(spark):
    """Of a small result from many partitions, a file a core at most; the partitions themselves stay tasks of their own."""
    rows = spark.range(0, 400, 1, 40).select("id", F.spark_partition_id().alias("part"))
    attempt = F.udf(lambda _: __import__("pyspark").TaskContext.get().taskAttemptId(), "long").asNondeterministic()
    out = storage.materialise(rows.withColumn("task", attempt("id")), "few", few=True)
    assert out.count() == 400 and out.select("task").distinct().count() == 40
    assert len(out.inputFiles()) <= spark.sparkContext.defaultParallelism
