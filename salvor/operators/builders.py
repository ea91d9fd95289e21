"""Rebuilding tables and derived records: restore, transforms, feature, model, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salvor.functions.text import json_number, json_object, json_string
from salvor.sources.sinks import Materialized, TableStore

# The constants written into the derived records.
MODEL_ALGORITHM = "deterministic_demo_threshold"
HIGH_VALUE = 100
REUSED = "reused_verified_output"
ACTIONS = {
    "snapshot_restore": "restored_snapshot",
    "sql_transform": "executed_sql_transform",
    "python_build": "executed_python_build",
    "report_refresh": "refreshed_report",
}
EVIDENCE = (
    "adapter string, action string, executed boolean, idempotency_key string, target string, "
    "output_sha256 string, details map<string,string>"
)
# Sums are taken in decimals, so a total does not depend on the order of additions.
EXACT = "decimal(28,6)"


class UnsupportedBuild(ValueError):
    """No builder is registered for an adapter and its parameter."""


def stg_orders(orders: DataFrame) -> DataFrame:
    return orders.select("order_id", "customer_id", F.col("amount").cast("double").alias("amount"))


def customer_revenue(customers: DataFrame, staged: DataFrame) -> DataFrame:
    """Revenue per customer, zero for customers without orders.

    Orders are summed per customer before the join, so one heavy customer becomes
    one row per map task and never a heavy join key. The final grouping keeps the
    join's partitioning, so each side is shuffled once.
    """
    sums = staged.groupBy("customer_id").agg(F.sum(F.col("amount").cast(EXACT)).alias("amount"))
    total = F.coalesce(F.sum("amount"), F.lit(0).cast(EXACT))
    return (
        customers.select("customer_id", "customer_name")
        .join(sums, "customer_id", "left")
        .groupBy("customer_id", "customer_name")
        .agg(F.round(total, 2).cast("double").alias("total_revenue"))
    )


def customer_value(revenue: DataFrame) -> DataFrame:
    band = F.when(F.col("total_revenue") >= HIGH_VALUE, "high").otherwise("standard")
    return revenue.select(
        "customer_id", F.round("total_revenue", 2).alias("lifetime_value"), band.alias("value_band")
    )


def executive_revenue(revenue: DataFrame, fingerprint: str) -> DataFrame:
    total = F.coalesce(F.sum(F.col("total_revenue").cast(EXACT)), F.lit(0).cast(EXACT))
    return revenue.agg(
        F.lit("dashboards.executive_revenue").alias("artifact"),
        F.count(F.lit(1)).alias("customer_count"),
        F.lit(fingerprint).alias("input_fingerprint"),
        F.round(total, 2).cast("double").alias("total_revenue"),
    )


def churn_model(records: DataFrame, fingerprint: str, accuracy: Column) -> DataFrame:
    """The record of a model; ``accuracy`` is what was measured, an aggregate over the
    records or a literal."""
    return records.agg(
        F.lit("models.churn_model").alias("artifact"),
        F.lit(MODEL_ALGORITHM).alias("algorithm"),
        F.lit(fingerprint).alias("input_fingerprint"),
        F.create_map(F.lit("accuracy"), accuracy.cast("double")).alias("metrics"),
        F.count(F.lit(1)).alias("trained_records"),
    )


def feature_header(records: DataFrame, fingerprint: str, digest: str) -> DataFrame:
    """The document of a feature table: its records stay a table of their own."""
    return records.agg(F.count(F.lit(1)).alias("n")).select(
        json_object(
            {
                "artifact": F.lit('"features.customer_value"'),
                "input_fingerprint": json_string(F.lit(fingerprint)),
                "record_count": F.col("n").cast("string"),
                "records_digest": json_string(F.lit(digest)),
            }
        ).alias("document")
    )


def model_document(model: DataFrame) -> DataFrame:
    metrics = json_object({"accuracy": json_number(F.col("metrics")["accuracy"])})
    return model.select(
        json_object(
            {
                "algorithm": json_string(F.col("algorithm")),
                "artifact": json_string(F.col("artifact")),
                "input_fingerprint": json_string(F.col("input_fingerprint")),
                "metrics": metrics,
                "trained_records": F.col("trained_records").cast("string"),
            }
        ).alias("document")
    )


def report_document(report: DataFrame) -> DataFrame:
    return report.select(
        json_object(
            {
                "artifact": json_string(F.col("artifact")),
                "customer_count": F.col("customer_count").cast("string"),
                "input_fingerprint": json_string(F.col("input_fingerprint")),
                "total_revenue": json_number(F.col("total_revenue")),
            }
        ).alias("document")
    )


@dataclass(frozen=True)
class Estate:
    """Where rebuilds read from and write to."""

    store: TableStore
    orders: DataFrame
    customers: DataFrame
    # Accuracy measured for the model; null where none was.
    accuracy: float | None = None

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _revenue(self) -> tuple[DataFrame, str]:
        name = "analytics.customer_revenue"
        return self.store.read(name), self.store.digest(name)

    def restore_orders(self) -> Materialized:
        return self.store.materialize("raw.orders", self.orders)

    def build_stg_orders(self) -> Materialized:
        return self.store.materialize("analytics.stg_orders", stg_orders(self.store.read("raw.orders")))

    def build_customer_revenue(self) -> Materialized:
        revenue = customer_revenue(self.customers, self.store.read("analytics.stg_orders"))
        return self.store.materialize("analytics.customer_revenue", revenue)

    def build_customer_value(self) -> Materialized:
        revenue, fingerprint = self._revenue()
        records = customer_value(revenue)
        table = self.store.materialize("features.customer_value.records", records)
        document = feature_header(self.store.read(table.table_name), fingerprint, table.digest)
        return self.store.write_document("features.customer_value", document)

    def build_churn_model(self) -> Materialized:
        fingerprint = self.store.digest("features.customer_value")
        records = self.store.read("features.customer_value.records")
        return self.store.write_document(
            "models.churn_model", model_document(churn_model(records, fingerprint, F.lit(self.accuracy)))
        )

    def build_executive_revenue(self) -> Materialized:
        revenue, fingerprint = self._revenue()
        return self.store.write_document(
            "dashboards.executive_revenue", report_document(executive_revenue(revenue, fingerprint))
        )


# adapter -> (parameter that selects the build, {value: build})
BUILDS: dict[str, tuple[str, dict[str, Callable[[Estate], Materialized]]]] = {
    "snapshot_restore": ("table", {"raw.orders": Estate.restore_orders}),
    "sql_transform": (
        "model",
        {"stg_orders": Estate.build_stg_orders, "customer_revenue": Estate.build_customer_revenue},
    ),
    "python_build": (
        "job",
        {"customer_value": Estate.build_customer_value, "churn_model": Estate.build_churn_model},
    ),
    "report_refresh": ("report", {"executive_revenue": Estate.build_executive_revenue}),
}


def action_label(adapter: str, executed: bool) -> str:
    return ACTIONS[adapter] if executed else REUSED


def run_build(estate: Estate, adapter: str, parameters: dict[str, str], key: str) -> tuple:
    """Run one registered build; returns an evidence row in the order of ``EVIDENCE``."""
    if adapter not in BUILDS:
        raise UnsupportedBuild(f"adapter is not registered: {adapter}")
    name, builds = BUILDS[adapter]
    value = parameters.get(name, "")
    if value not in builds:
        raise UnsupportedBuild(f"unsupported {name} for {adapter}: {value}")
    made = builds[value](estate)
    details = {name: value, "row_count": str(made.row_count)}
    return (
        adapter, action_label(adapter, made.executed), made.executed, key, made.table_name,
        made.digest, details,
    )


def rebuild_all(estate: Estate, key: str = "rebuild") -> DataFrame:
    """Rebuild every registered target in dependency order; returns evidence rows."""
    order = [
        ("snapshot_restore", "raw.orders"),
        ("sql_transform", "stg_orders"),
        ("sql_transform", "customer_revenue"),
        ("python_build", "customer_value"),
        ("python_build", "churn_model"),
        ("report_refresh", "executive_revenue"),
    ]
    rows = [run_build(estate, a, {BUILDS[a][0]: v}, f"{key}:{v}") for a, v in order]
    return estate.spark.createDataFrame(rows, EVIDENCE)


def inspect(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """Presence of every wanted asset; absent from the inventory means not available."""
    return wanted.join(inventory, "table_name", "left").select(
        "table_name", F.coalesce("available", F.lit(False)).alias("available")
    )


def inspect_counts(state: DataFrame) -> DataFrame:
    return state.agg(
        F.count_if("available").alias("healthy_asset_count"), F.count(F.lit(1)).alias("asset_count")
    )
