"""Session settings, shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A broadcast side is at most this many narrow rows (about 100 bytes each).
BROADCAST_ROWS = 500_000
# Rows of a bucket, about.
BUCKET_ROWS = 2_000_000


def build_session(app: str = "salvor", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# Folders made for local sessions without a configured one, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Where nothing is configured, a local master gets a fresh temporary folder;
    on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_FOLDERS[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result has no lineage beyond that table, so a lost executor costs a
    re-read and not a recomputation of all earlier rounds.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more; others are left alone.

    Only for tables whose readers have been written themselves: what is still lazy
    would find its files gone. The driver's garbage is collected too, since Spark
    lets go of shuffle files with the plans that made them.
    """
    if tables:
        tables[0].sparkSession._jvm.System.gc()
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark lets go of shuffle files with the plans that made them.

    Spark's listeners hold a plan for a moment after its job, so it is done twice.
    """
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.5)


def bucket_count(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def cut_bucketed(df: DataFrame, label: str, columns: list[str], rows: int, dealt: bool = False) -> DataFrame:
    """``cut`` into files dealt by ``columns``.

    A join on these columns reads the table as it lies and shuffles only the other
    side. The table's files are in the shared folder; its name is for this session.
    ``dealt``: the rows come from as many partitions by the same columns already.
    """
    spark = df.sparkSession
    buckets = bucket_count(spark, rows)
    name = f"{label}_{uuid.uuid4().hex}"
    # One task per bucket, so that a bucket is one file and not one per task.
    writer = (df if dealt else df.repartition(buckets, *columns)).write.option("compression", "zstd")
    writer.bucketBy(buckets, *columns).sortBy(*columns).option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


class Pile:
    """Tables that are added one at a time and read together.

    Two neighbours are rewritten as one when the later has as many rows, so a pile
    of n tables is read from a logarithmic number of them and each row is rewritten
    a logarithmic number of times.
    """

    def __init__(self, label: str) -> None:
        self.label, self.parts, self.rows = label, [], 0

    def add(self, df: DataFrame, rows: int) -> None:
        self.rows += rows
        self.parts.append((df, rows))
        whole, total, taken = df, rows, 1
        while taken < len(self.parts) and total >= self.parts[-taken - 1][1]:
            whole, total, taken = self.parts[-taken - 1][0].unionByName(whole), self.parts[-taken - 1][1] + total, taken + 1
        if taken > 1:
            self.parts[-taken:] = [(cut(whole, self.label), total)]

    def all(self) -> DataFrame:
        return union_all([df for df, _ in self.parts])


def cut_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut`` that also counts rows while they are written, without another job.

    Each count is the number of rows for which its condition holds.
    """
    seen = Observation()
    rows = [F.count_if(condition).alias(name) for name, condition in counts.items()]
    table = cut(df.observe(seen, *rows), label)
    return table, {name: int(value or 0) for name, value in seen.get.items()}


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted number of rows is within the limit."""
    return F.broadcast(df) if rows <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """Keep a table of any number of rows from being broadcast.

    Left alone, Spark goes by the size of a table's files, as a share of its columns'
    widths. Packed URNs take some hundredth of the room that they need in the driver.
    """
    return df.hint("merge")


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` within the limit and ``shuffled`` beyond it."""
    return small(df, rows, limit) if rows <= limit else shuffled(df)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
