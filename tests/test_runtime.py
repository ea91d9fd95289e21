from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from salvor import runtime


def fake(master, named=None):
    conf = SimpleNamespace(get=lambda key, default=None: named if named else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_shared_folder_is_the_named_one_and_required_on_a_cluster():
    assert runtime.shared_folder(fake("spark://host", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(fake("spark://host"))
    local = fake("local[2]")
    assert runtime.shared_folder(local) == runtime.shared_folder(local)


def test_cut_counts_rows_while_writing_and_drops_lineage(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    table, n = runtime.cut_counted(df, "t", all=F.lit(True), small=F.col("id") < 10)
    assert n == {"all": 100, "small": 10} and table.count() == 100
    assert "Range" not in table._jdf.queryExecution().optimizedPlan().toString()
    empty, n = runtime.cut_counted(df.filter("id < 0"), "t", all=F.lit(True))
    assert n == {"all": 0} and empty.count() == 0


def test_broadcast_hint_needs_a_small_count(spark):
    df = spark.range(3)
    hint = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hint(runtime.small(df, 10)) and not hint(runtime.small(df, runtime.BROADCAST_ROWS + 1))
