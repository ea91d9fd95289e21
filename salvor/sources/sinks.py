"""Sinks: sorted snapshots, versioned tables with a digest gate, write-once receipts."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salvor.functions.digests import (
    default_kinds,
    digest_from_sums,
    lane_sums,
    multiset_digest,
    with_lanes,
)

POINTERS = (
    "table_name string, version string, path string, digest string, row_count bigint, "
    "schema string, seq bigint"
)
POINTER_FIELDS = [f.split(" ")[0] for f in POINTERS.split(", ")]


def write_snapshot(df: DataFrame, path: str, order: list[str]) -> None:
    """Zstandard Parquet, sorted inside every file so that row-group statistics are narrow."""
    df.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)


@dataclass(frozen=True)
class Materialized:
    table_name: str
    digest: str
    executed: bool
    row_count: int
    path: str


class TableStore:
    """Tables as immutable versions below one folder, with an append-only pointer log.

    A write goes to a new version first; the pointer row makes it current. Readers
    never see half a table and a failed job leaves the old version in place.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._log = f"{self.root}/_pointers"
        self._known: dict[str, Row] | None = None
        spark.createDataFrame([], POINTERS).write.mode("append").parquet(self._log)

    def pointers(self) -> DataFrame:
        """The current version of every table."""
        log = self.spark.read.schema(POINTERS).parquet(self._log)
        newest = F.max_by(F.struct(*[F.col(c) for c in log.columns]), "seq").alias("p")
        return log.groupBy("table_name").agg(newest).select("p.*")

    def _pointer(self, table: str) -> Row | None:
        """The pointer of a table. This store is the only writer of its log, so the
        pointers (one short row per table) are read once and kept up to date here."""
        if self._known is None:
            self._known = {r["table_name"]: r for r in self.pointers().collect()}
        return self._known.get(table)

    def _current(self, table: str) -> Row:
        row = self._pointer(table)
        if row is None or row["path"] is None:
            raise KeyError(table)
        return row

    def _point(
        self, table: str, version: str, path: str | None, digest: str | None, rows: int, schema: str | None
    ) -> None:
        row = (table, version, path, digest, rows, schema, time.time_ns() // 1000)
        df = self.spark.createDataFrame([row], POINTERS).coalesce(1)
        df.write.mode("append").parquet(self._log)
        if self._known is not None:
            self._known[table] = Row(*POINTER_FIELDS)(*row)

    def exists(self, table: str) -> bool:
        row = self._pointer(table)
        return row is not None and row["path"] is not None

    def read(self, table: str) -> DataFrame:
        row = self._current(table)
        schema = StructType.fromJson(json.loads(row["schema"]))
        return self.spark.read.schema(schema).parquet(row["path"])

    def digest(self, table: str) -> str:
        """The digest recorded for the current version; versions never change."""
        return self._current(table)["digest"]

    def _stage(self, df: DataFrame, path: str, kinds: dict[str, str]) -> tuple[str, int]:
        """Write ``df`` and hash its rows while they are written."""
        writer = lambda d: d.write.option("compression", "zstd").parquet(path)
        seen = Observation()
        lanes = with_lanes(df, kinds).observe(seen, F.count(F.lit(1)).alias("row_count"), *lane_sums())
        writer(lanes.select(*df.columns))
        return digest_from_sums(list(kinds), seen.get), int(seen.get["row_count"] or 0)

    def materialize(
        self, table: str, df: DataFrame, kinds: dict[str, str] | None = None
    ) -> Materialized:
        """Make ``df`` the content of ``table`` unless it already is.

        Where there is a current version, the digest is taken first and nothing is
        written if it is the same. Else the result is staged as the next version and
        hashed in the same pass.
        """
        kinds = kinds or default_kinds(df)
        current = self._pointer(table)
        if current is not None and current["path"] is not None:
            row = multiset_digest(df, kinds).first()
            if row["digest"] == current["digest"]:
                return Materialized(table, row["digest"], False, row["row_count"], current["path"])
        version = uuid.uuid4().hex
        path = f"{self.root}/{table}/{version}"
        digest, rows = self._stage(df, path, kinds)
        self._point(table, version, path, digest, rows, df.schema.json())
        return Materialized(table, digest, True, rows, path)

    def write_document(self, name: str, document: DataFrame) -> Materialized:
        """Store a one-row, one-column text document unless its bytes are current already."""
        text = document.select(F.col(document.columns[0]).alias("value"))
        digest = text.select(F.sha2(F.concat("value", F.lit("\n")), 256)).first()[0]
        current = self._pointer(name)
        if current is not None and current["path"] is not None and current["digest"] == digest:
            return Materialized(name, digest, False, 1, current["path"])
        version = uuid.uuid4().hex
        path = f"{self.root}/{name}/{version}"
        text.coalesce(1).write.text(path)
        self._point(name, version, path, digest, 1, None)
        return Materialized(name, digest, True, 1, path)

    def document(self, name: str) -> DataFrame:
        return self.spark.read.text(self._current(name)["path"], wholetext=True)

    def drop(self, tables: list[str]) -> list[str]:
        """Remove tables from the inventory; returns the ones that were there."""
        gone = [t for t in sorted(tables) if self.exists(t)]
        for table in gone:
            self._point(table, "dropped", None, None, 0, None)
        return gone

    def inventory(self) -> DataFrame:
        return self.pointers().select("table_name", F.col("path").isNotNull().alias("available"))


def receipt_verdicts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Compare receipts with stored ones by run: ``new``, ``identical`` or ``conflict``.

    Both sides have ``run_id`` and ``body``; ``stored`` holds one row per run.
    Receipts of one run with equal bodies are one receipt; different bodies for a
    run that has none stored are all in conflict, as none of them was first.
    """
    seen = stored.select("run_id", F.sha2("body", 256).alias("stored_sha256"))
    digest = F.col("receipt_sha256")
    once = incoming.select("run_id", F.sha2("body", 256).alias("receipt_sha256")).distinct()
    bodies = once.groupBy("run_id").agg(F.count(F.lit(1)).alias("bodies"))
    return once.join(bodies, "run_id").join(seen, "run_id", "left").select(
        "run_id",
        "receipt_sha256",
        F.when(F.col("stored_sha256").isNull() & (F.col("bodies") > 1), "conflict")
        .when(F.col("stored_sha256").isNull(), "new")
        .when(F.col("stored_sha256") == digest, "identical")
        .otherwise("conflict")
        .alias("verdict"),
    )


def append_new_receipts(incoming: DataFrame, stored: DataFrame, path: str) -> DataFrame:
    """Append receipts of runs that have none yet; returns all verdicts."""
    verdicts = receipt_verdicts(incoming, stored)
    fresh = incoming.join(verdicts.filter("verdict = 'new'").select("run_id"), "run_id", "left_semi")
    fresh = fresh.groupBy("run_id").agg(*[F.first(c).alias(c) for c in incoming.columns if c != "run_id"]).select(incoming.columns)
    fresh.write.mode("append").parquet(path)
    return verdicts


def write_receipts(receipts: DataFrame, path: str) -> None:
    receipts.write.mode("append").json(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Append events, one folder per day; a folder per run would be millions of files."""
    ledger.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def write_bundle(reports: DataFrame, path: str, json_path: str, markdown_path: str) -> None:
    """Write report rows with portable paths instead of local ones."""
    reports.withColumns(
        {"report_json_path": F.lit(json_path), "report_markdown_path": F.lit(markdown_path)}
    ).write.json(path)
