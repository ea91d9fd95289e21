"""Declared data-quality checks as one join between check specs and table facts.

Facts are gathered with one aggregation per target, whatever the number of
checks on it; evaluating a check is then a column expression.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvor.functions.digests import combine_lanes, default_kinds, lane_sums, with_lanes
from salvor.sources.documents import is_json_object, object_keys

# Name of a business rule -> a predicate every row must meet, as SQL over the table.
RULES: dict[str, str] = {"revenue_nonnegative": "total_revenue >= 0"}
# What a check says about a rule; a rule without a text is described by its predicate.
RULE_TEXTS: dict[str, str] = {"revenue_nonnegative": "all customer revenue values are nonnegative"}

SPECS = (
    "target_urn string, kind string, parameters map<string,string>, required boolean"
)


def step_specs(plan_steps: DataFrame) -> DataFrame:
    """One row per declared check of every plan step."""
    return plan_steps.select(
        "plan_id", "step_id", "target_urn", F.posexplode("validations").alias("pos", "v")
    ).select(
        "plan_id", "step_id", "target_urn", "pos", "v.kind", "v.parameters", "v.required"
    )


def table_facts(
    df: DataFrame,
    target: str,
    expected_columns: list[str] | None = None,
    rule: str | list[str] | None = None,
    measure: str | None = None,
    kinds: Mapping[str, str] | None = None,
    digest: bool = True,
    rules: Mapping[str, str] = RULES,
) -> DataFrame:
    """All facts of one table from one pass: count, digest, least measure, breaks of each rule.

    ``rule_breaks`` maps each declared rule to the rows that break it or give null.
    """
    named = [rule] if isinstance(rule, str) else list(rule or [])
    kinds = dict(kinds or default_kinds(df))
    aggs = [F.count(F.lit(1)).alias("row_count")]
    source = df
    if digest:
        source = with_lanes(df, kinds)
        aggs += lane_sums()
    if measure:
        aggs.append(F.min(F.col(measure).cast("double")).alias("least"))
    aggs += [F.count_if(~F.coalesce(F.expr(rules[name]), F.lit(False))).alias(f"_rule{i}") for i, name in enumerate(named)]
    one = source.agg(*aggs)
    expected = F.array(*[F.lit(c) for c in expected_columns]) if expected_columns else None
    return one.select(
        F.lit(target).alias("target_urn"),
        F.lit(True).alias("present"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        (expected if expected is not None else F.lit(None).cast("array<string>")).alias("expected_columns"),
        "row_count",
        (combine_lanes(list(kinds)) if digest else F.lit(None).cast("string")).alias("digest"),
        (F.col("least") if measure else F.lit(None).cast("double")).alias("least"),
        _text_map({name: F.col(f"_rule{i}") for i, name in enumerate(named)}, "bigint").alias("rule_breaks"),
        _text_map({name: F.lit(RULE_TEXTS.get(name, f"no row breaks {rules[name]}")) for name in named}, "string").alias("rule_texts"),
    )


def _text_map(items: Mapping[str, Column], kind: str) -> Column:
    pairs = [x for name, value in items.items() for x in (F.lit(name), value)]
    return F.create_map(*pairs).cast(f"map<string,{kind}>")


def text_number(value: Column, places: int) -> Column:
    """Fixed notation, rounded half to even on the exact binary value."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def evaluate(specs: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Judge every check. Missing facts fail the check and never the job.

    ``facts`` has one row per ``target_urn`` with any of: present, columns,
    expected_columns, row_count, digest, claimed_digest, rule_breaks, rule_texts,
    least, document, modified_at, input_digest. A business rule passes when the
    table has rows and none of them breaks it. Specs keep their other columns.
    """
    have = set(facts.columns)
    types = {
        "present": "boolean", "columns": "array<string>", "expected_columns": "array<string>",
        "row_count": "bigint", "digest": "string", "claimed_digest": "string",
        "rule_breaks": "map<string,bigint>", "rule_texts": "map<string,string>",
        "least": "double", "document": "string", "modified_at": "timestamp", "input_digest": "string",
    }
    full = facts.select(
        "target_urn",
        *[(F.col(c) if c in have else F.lit(None).cast(t).alias(c)) for c, t in types.items()],
    )
    j = specs.join(full, "target_urn", "left")
    p = lambda name: F.try_element_at("parameters", F.lit(name))
    number = lambda c: c.try_cast("double")
    kind = F.col("kind")
    least_rows = F.coalesce(p("minimum").try_cast("bigint"), F.lit(0))
    metric_path = F.concat(F.lit("$.metrics."), p("metric"))
    metric_value = number(F.call_function("get_json_object", F.col("document"), metric_path))
    metric_floor = number(p("minimum"))
    age = F.greatest(
        F.lit(0.0), (F.unix_micros(now) - F.unix_micros("modified_at")) / F.lit(1_000_000.0)
    )
    max_age = number(p("maximum_age_seconds"))
    stored_input = F.get_json_object("document", "$.input_fingerprint")
    is_object = is_json_object(F.col("document"))

    breaks = F.try_element_at("rule_breaks", p("rule"))

    # kind -> (error or null, passed, detail, evidence)
    table = F.col("row_count").isNull()
    error = (
        F.when((kind == "schema") & F.col("expected_columns").isNull(), "KeyError")
        .when(kind.isin("row_count", "checksum") & table, "KeyError")
        .when((kind == "row_count") & p("minimum").isNotNull() & p("minimum").try_cast("bigint").isNull(), "ValueError")
        .when((kind == "business_rule") & (F.col("row_count").isNull() | breaks.isNull()), "RuleNotRegistered")
        .when((kind == "business_rule") & (F.col("row_count") == 0), "ValueError")
        .when((kind == "freshness") & F.col("modified_at").isNull(), "FileNotFoundError")
        .when((kind == "freshness") & p("maximum_age_seconds").isNull(), "KeyError")
        .when((kind == "freshness") & max_age.isNull(), "ValueError")
        .when(kind.isin("artifact_load", "metric_threshold", "input_fingerprint") & F.col("document").isNull(), "FileNotFoundError")
        .when(kind.isin("artifact_load", "metric_threshold", "input_fingerprint") & ~is_object, "ValueError")
        .when((kind == "metric_threshold") & (p("metric").isNull() | p("minimum").isNull()), "KeyError")
        .when((kind == "metric_threshold") & metric_value.isNull(), "KeyError")
        .when((kind == "metric_threshold") & metric_floor.isNull(), "ValueError")
        .when((kind == "input_fingerprint") & stored_input.isNull(), "KeyError")
    )
    passed = (
        F.when(kind == "exists", F.coalesce("present", F.lit(False)))
        .when(kind == "schema", F.col("columns") == F.col("expected_columns"))
        .when(kind == "row_count", F.col("row_count") >= least_rows)
        .when(kind == "checksum", F.col("digest") == F.col("claimed_digest"))
        .when(kind == "business_rule", breaks == 0)
        .when(kind == "freshness", age <= max_age)
        .when(kind == "artifact_load", F.size(F.json_object_keys("document")) > 0)
        .when(kind == "metric_threshold", metric_value >= metric_floor)
        .when(kind == "input_fingerprint", stored_input == F.col("input_digest"))
        .otherwise(False)
    )
    detail = (
        F.when(kind == "exists", F.when(F.col("present"), "target exists").otherwise("target is missing"))
        .when(kind == "schema", F.when(passed, "schema matches").otherwise("schema mismatch"))
        .when(kind == "row_count", F.concat(F.lit("row count "), F.col("row_count").cast("string"), F.lit(" >= "), least_rows.cast("string")))
        .when(kind == "checksum", F.lit("output checksum matches adapter evidence"))
        .when(
            kind == "business_rule",
            F.when(passed, F.try_element_at("rule_texts", p("rule")))
            .otherwise(F.concat(breaks.cast("string"), F.lit(" rows break "), p("rule"))),
        )
        .when(kind == "freshness", F.concat(F.lit("artifact age "), text_number(age, 3), F.lit("s <= "), text_number(max_age, 3), F.lit("s")))
        .when(kind == "artifact_load", F.lit("artifact loaded as JSON object"))
        .when(kind == "metric_threshold", F.concat(p("metric"), F.lit(" "), text_number(metric_value, 2), F.lit(" >= "), text_number(metric_floor, 2)))
        .when(kind == "input_fingerprint", F.lit("report input fingerprint matches recovered revenue table"))
        .otherwise(F.concat(F.lit("unsupported validation kind: "), kind))
    )
    evidence = (
        F.when(kind == "exists", F.create_map(F.lit("target_urn"), F.col("target_urn")))
        .when(kind == "schema", F.create_map(F.lit("actual"), F.array_join("columns", ","), F.lit("expected"), F.array_join("expected_columns", ",")))
        .when(kind == "row_count", F.create_map(F.lit("actual"), F.col("row_count").cast("string"), F.lit("minimum"), least_rows.cast("string")))
        .when(kind == "checksum", F.create_map(F.lit("actual_sha256"), F.col("digest"), F.lit("adapter_sha256"), F.col("claimed_digest")))
        .when(kind == "business_rule", F.create_map(F.lit("minimum_revenue"), F.col("least").cast("string"), F.lit("rows_broken"), breaks.cast("string"), F.lit("rule"), p("rule")))
        .when(kind == "freshness", F.create_map(F.lit("age_seconds"), age.cast("string"), F.lit("maximum_age_seconds"), max_age.cast("string")))
        .when(kind == "artifact_load", F.create_map(F.lit("keys"), F.array_join(object_keys(F.col("document")), ",")))
        .when(kind == "metric_threshold", F.create_map(F.lit("metric"), p("metric"), F.lit("actual"), metric_value.cast("string"), F.lit("minimum"), metric_floor.cast("string")))
        .when(kind == "input_fingerprint", F.create_map(F.lit("actual"), stored_input, F.lit("expected"), F.col("input_digest")))
    )
    none = F.create_map().cast("map<string,string>")
    judged = j.withColumn("_error", error)
    return judged.select(
        *[c for c in specs.columns if c not in ("parameters",)],
        (F.col("_error").isNull() & F.coalesce(passed, F.lit(False))).alias("passed"),
        F.when(F.col("_error").isNotNull(), F.concat(F.lit("validation error: "), F.col("_error")))
        .otherwise(detail).alias("detail"),
        F.when(F.col("_error").isNotNull(), none).otherwise(F.coalesce(evidence, none)).alias("evidence"),
    )


def rule_report(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows checked and rows that break each rule, all rules in one pass."""
    aggs = [F.count(F.lit(1)).alias("rows_checked")]
    aggs += [
        F.count_if(~F.coalesce(F.expr(sql), F.lit(False))).alias(f"_{i}")
        for i, sql in enumerate(rules.values())
    ]
    one = df.agg(*aggs)
    items = [
        F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("rows_broken"))
        for i, name in enumerate(rules)
    ]
    return one.select("rows_checked", F.explode(F.array(*items)).alias("r")).select(
        "r.rule", "rows_checked", "r.rows_broken",
        ((F.col("r.rows_broken") == 0) & (F.col("rows_checked") > 0)).alias("passed"),
    )


def gate(results: DataFrame, keys: list[str]) -> DataFrame:
    """Steps pass when every required check passed; lists the required kinds that failed.

    The list is a set of check kinds, so its size is bounded by the number of kinds.
    """
    failed = F.col("required") & ~F.col("passed")
    kinds = F.array_sort(F.collect_set(F.when(failed, F.col("kind"))))
    return results.groupBy(*keys).agg(
        F.bool_and(~failed).alias("passed"),
        F.count(F.lit(1)).alias("checks"),
        F.array_join(kinds, ",").alias("failed_required"),
    )


def event_freshness(df: DataFrame, at: str, keys: list[str], now: Column, max_age: float) -> DataFrame:
    """Freshness by event time: age of the newest row per group."""
    newest = df.groupBy(*keys).agg(F.max(F.unix_micros(F.col(at).cast("timestamp"))).alias("_newest"))
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.col("_newest")) / F.lit(1_000_000.0))
    return newest.select(*keys, age.alias("age_seconds"), (age <= max_age).alias("passed"))
