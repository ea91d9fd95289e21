"""URN parsing, scope rules and safe run names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted shapes of a dataset URN and of a run name.
DATASET_URN = (
    r"^urn:li:dataset:\(urn:li:dataPlatform:([^,()]+),([^,()]+),([^,()]+)\)\z"
)
RUN_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,79}\z"

OUTSIDE = "outside the namespace"
WRONG_DOMAIN = "wrong domain"
NO_TAG = "lacks required tag"


@dataclass(frozen=True)
class Scope:
    """Where assets must live: name prefix, domain and tag."""

    prefix: str
    domain: str
    tag: str


def urn_parts(urn: Column) -> list[Column]:
    return [
        F.regexp_extract(urn, DATASET_URN, 1).alias("platform_name"),
        F.regexp_extract(urn, DATASET_URN, 2).alias("dataset_name"),
        F.regexp_extract(urn, DATASET_URN, 3).alias("environment"),
    ]


def in_namespace(urn: Column, prefix: str) -> Column:
    name = F.regexp_extract(urn, DATASET_URN, 2)
    return F.coalesce(name.startswith(prefix) & (name != prefix), F.lit(False))


def scope_reason(scope: Scope) -> Column:
    """The first broken scope rule of an asset row, or null."""
    return (
        F.when(~in_namespace(F.col("urn"), scope.prefix), OUTSIDE)
        .when(~F.col("domain").eqNullSafe(F.lit(scope.domain)), WRONG_DOMAIN)
        .when(~F.coalesce(F.array_contains("tags", scope.tag), F.lit(False)), NO_TAG)
    )


def scope_violations(assets: DataFrame, scope: Scope) -> DataFrame:
    return assets.select("urn", scope_reason(scope).alias("reason")).filter("reason IS NOT NULL")


def safe_run_name(run_id: Column) -> Column:
    return F.coalesce(run_id.rlike(RUN_NAME), F.lit(False))
