import json
import math
import random
from decimal import Decimal

import brute
import pytest
from canonical import canonical_table_digest
from pyspark.sql import functions as F

from salvor.functions.digests import lane_state, moved_state, multiset_digest, state_digest
from salvor.functions.text import canonical_json, json_number, json_string
from salvor.operators import builders as B
from salvor.sources import documents, sinks, tables

# Ties, a null amount, parts of a cent, a refund, and an order of nobody known.
ORDERS = [
    ("a-9", "k7", 10.005), ("a-1", "k7", 10.005), ("b-3", "k2", None), ("b-4", "k2", 0.125), ("c-5", "k2", -3.5),
    ("d-6", "gone", 999.0), ("e-7", "k4", 64.0), ("e-8", "k4", 35.999),
]
PEOPLE = [("k7", "Odd Ünal", "river"), ("k2", "", "river"), ("k4", "Pim", "coast"), ("k5", "Quiet", None)]
REVENUE = {"k7": 20.01, "k2": -3.38, "k4": 100.0, "k5": 0.0}


@pytest.fixture
def estate(spark, tmp_path):
    orders = spark.createDataFrame(ORDERS, tables.ORDERS)
    people = spark.createDataFrame(PEOPLE, tables.CUSTOMERS)
    return B.Estate(sinks.TableStore(spark, str(tmp_path / "store")), orders, people, accuracy=0.5)


def test_rebuild(estate):
    made = {r["target"]: r for r in B.rebuild_all(estate).collect()}
    assert all(r["executed"] for r in made.values())
    assert made["raw.orders"]["output_sha256"] == made["analytics.stg_orders"]["output_sha256"]
    assert {r["customer_id"]: r["total_revenue"] for r in estate.store.read("analytics.customer_revenue").collect()} == REVENUE
    value = {r["customer_id"]: (r["lifetime_value"], r["value_band"]) for r in estate.store.read("features.customer_value.records").collect()}
    assert value == {c: (v, "high" if v >= 100 else "standard") for c, v in REVENUE.items()}
    read = lambda name: json.loads(estate.store.document(name).first()[0])
    revenue = made["analytics.customer_revenue"]["output_sha256"]
    feature = read("features.customer_value")
    assert feature == {
        "artifact": "features.customer_value", "input_fingerprint": revenue, "record_count": 4,
        "records_digest": estate.store.digest("features.customer_value.records"),
    }
    assert read("models.churn_model") == {
        "artifact": "models.churn_model", "algorithm": B.MODEL_ALGORITHM, "metrics": {"accuracy": 0.5}, "trained_records": 4,
        "input_fingerprint": made["features.customer_value"]["output_sha256"],
    }
    assert read("dashboards.executive_revenue") == {
        "artifact": "dashboards.executive_revenue", "customer_count": 4, "input_fingerprint": revenue, "total_revenue": 116.63,
    }


def test_canonical_table_digest(spark):
    rows = [r for r in ORDERS if r[2] is not None]
    df = spark.createDataFrame(rows, tables.ORDERS).repartition(3)
    assert canonical_table_digest(df).first()["digest"] == brute.table_digest(["order_id", "customer_id", "amount"], rows)


def test_second_rebuild_reuses_and_dropped_tables_return(estate):
    first = {r["target"]: r["output_sha256"] for r in B.rebuild_all(estate).collect()}
    assert {r["action"] for r in B.rebuild_all(estate).collect()} == {B.REUSED}
    assert estate.store.drop(["raw.orders", "never.there"]) == ["raw.orders"]
    third = {r["target"]: (r["action"], r["output_sha256"]) for r in B.rebuild_all(estate).collect()}
    assert third["raw.orders"] == ("restored_snapshot", first["raw.orders"])
    assert {action for target, (action, _) in third.items() if target != "raw.orders"} == {B.REUSED}


@pytest.mark.parametrize(("old", "new"), [(0.831, 0.834), (1.0, math.nextafter(1.0, 2)), (1e18, math.nextafter(1e18, 0)), (5e-324, 0.0), (math.inf, 1e308), (None, 0.0)])
def test_a_change_in_the_last_bit_is_written(spark, tmp_path, old, new):
    store = sinks.TableStore(spark, str(tmp_path / "bits"))
    frame = lambda v: spark.createDataFrame([(1, v)], "k int, v double")
    first = store.materialize("t", frame(old))
    assert not store.materialize("t", frame(old)).executed
    second = store.materialize("t", frame(new))
    assert second.executed and second.digest != first.digest
    assert store.read("t").first()["v"] == new


def test_digest_of_special_numbers(spark):
    digest = lambda rows, kind: multiset_digest(spark.createDataFrame(rows, f"v {kind}")).first()["digest"]
    assert digest([(-0.0,)], "double") == digest([(0.0,)], "double")
    assert digest([(math.nan,)], "double") == digest([(-math.nan,)], "double")
    values = [math.nan, math.inf, -math.inf, 1e18, -1e18, 9e15, 1e300, 1e-300, 0.1, 0.01, 0.001, -0.1, None]
    assert len({digest([(v,)], "double") for v in values}) == len(values)
    assert digest([(0.1,)], "float") != digest([(0.1,)], "double")
    assert digest([(Decimal("0.0012"),)], "decimal(10,4)") != digest([(Decimal("0.0041"),)], "decimal(10,4)")
    assert digest([([0.5, None],)], "array<double>") != digest([([0.5],)], "array<double>")
    assert digest([([0.25, 0.5],)], "array<float>") != digest([([0.5, 0.25],)], "array<float>")


def test_unknown_builds(estate):
    with pytest.raises(B.UnsupportedBuild):
        B.run_build(estate, "report_refresh", {"report": "tides"}, "k")
    with pytest.raises(B.UnsupportedBuild):
        B.run_build(estate, "divination", {}, "k")


def test_revenue_keeps_repeated_customer_rows(spark):
    people = spark.createDataFrame([*PEOPLE, PEOPLE[1], PEOPLE[3]], tables.CUSTOMERS)
    staged = B.stg_orders(spark.createDataFrame(ORDERS, tables.ORDERS))
    got = {r["customer_id"]: r["total_revenue"] for r in B.customer_revenue(people, staged).collect()}
    assert got == REVENUE | {"k2": -6.75}


def test_numbers_and_strings_as_json(spark):
    numbers = [0.0, -0.0, 1.0, 0.1, 1234567.0, 12345678.0, 1e15, 1e16, 1.5e300, 0.001, 0.0001, 0.00012345, 1e-5, 2.5e-7, -3.25e8]
    df = spark.createDataFrame([(n,) for n in numbers], "n double")
    assert [r[0] for r in df.select(json_number(F.col("n"))).collect()] == [json.dumps(n) for n in numbers]
    texts = ['plain', 'q"q', 'b\\s', "tab\tnl\ncr\r", "bell\x07 vt\x0b esc\x1b", "é ☃ 😀", "\\u000B \x0b", "\x7f", "", "}", "a}}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("j", json_string(F.col("t")))
    rows = df.select("t", canonical_json(F.col("j"), True).alias("a"), canonical_json(F.col("j"), False).alias("u")).collect()
    for r in rows:
        assert r["a"] == json.dumps(r["t"])
        assert r["u"] == json.dumps(r["t"], ensure_ascii=False)


def test_digests(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None), (2, None, None)], "k int, t string, v double")
    one = multiset_digest(df).first()
    assert multiset_digest(df.repartition(5).orderBy(F.rand())).first() == one
    assert multiset_digest(df.distinct()).first()["digest"] != one["digest"]
    assert multiset_digest(df.limit(0)).first()["row_count"] == 0
    groups = {r["k"]: r["row_count"] for r in multiset_digest(df, by=["k"]).collect()}
    assert groups == {1: 1, 2: 2}


def test_sources(spark, tmp_path):
    csv = tmp_path / "p.csv"
    csv.write_text("customer_id,customer_name,segment\nc1,Ana,big\n")
    assert tables.scan_csv(spark, str(csv), tables.CUSTOMERS).collect()[0]["customer_name"] == "Ana"
    inline = tables.inline_values(spark, ["sku", "units"], [("a'b", 4), (None, 2)])
    assert sorted(map(tuple, inline.collect()), key=str) == [("a'b", 4), (None, 2)]
    ordered = tables.in_full_order(inline).collect()
    assert [r["sku"] for r in ordered] == ["a'b", None]
    inv = tables.table_inventory({"p": inline})
    assert inv.first()["columns"] == ["sku", "units"]
    wanted = spark.createDataFrame([("p",), ("q",)], "table_name string")
    assert [r[0] for r in tables.missing_tables(wanted, inv).collect()] == ["q"]
    assert tables.table_exists(spark, "nothing_here") is False


def test_documents_and_receipts(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.json").write_text('{"metrics": {"accuracy": 0.9}, "b": 1}')
    (folder / "b.json").write_text("[1, 2]")
    (folder / "c.json").write_text("{broken")
    found = {r["path"].rsplit("/", 1)[1]: r for r in documents.read_artifacts(spark, str(folder)).collect()}
    assert [found[f"{n}.json"]["is_object"] for n in "abc"] == [True, False, False]
    assert found["a.json"]["sha256"] == brute.sha('{"metrics": {"accuracy": 0.9}, "b": 1}')
    payload = documents.artifact_payload(documents.read_artifacts(spark, str(folder)), "a.json", "metrics map<string,double>")
    assert payload.first()["metrics"] == {"accuracy": 0.9}

    stored = spark.createDataFrame([("r1", "x"), ("r2", "y")], "run_id string, body string")
    batch = [("r1", "x"), ("r2", "z"), ("r3", "w"), ("r3", "w"), ("r4", "one"), ("r4", "two")]
    incoming = spark.createDataFrame(batch, "run_id string, body string")
    path = str(tmp_path / "receipts")
    verdicts = {r["run_id"]: r["verdict"] for r in sinks.append_new_receipts(incoming, stored, path).collect()}
    assert verdicts == {"r1": "identical", "r2": "conflict", "r3": "new", "r4": "conflict"}
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("r3", "w")]

    lines = tmp_path / "lines.json"
    lines.write_text('{"run_id":"a","verified":true}\n{oops\n')
    read = documents.read_receipts(spark, str(lines)).cache()
    assert sorted(r["readable"] for r in read.collect()) == [False, True]


def test_snapshot_and_bundles(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, t string").coalesce(1)
    path = str(tmp_path / "snap")
    sinks.write_snapshot(df, path, ["k"])
    assert [r["k"] for r in spark.read.parquet(path).collect()] == [1, 2, 3]
    sinks.write_bundle(df, str(tmp_path / "bundle"), "out/report.json", "out/report.md")
    assert {r["report_json_path"] for r in spark.read.json(str(tmp_path / "bundle")).collect()} == {"out/report.json"}
    sinks.write_receipts(df, str(tmp_path / "plain"))
    assert spark.read.json(str(tmp_path / "plain")).count() == 3
    ledger = df.withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    sinks.write_ledger(ledger, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 3


def test_restore_scan_pushes_its_filter_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 2.0)], "k int, t string, v double").write.parquet(path)
    plan = tables.scan_parquet(spark, path, ["k"], F.col("v") > 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,1.0)" in plan and "ReadSchema: struct<k:int,v:double>" in plan


KINDS = {"a": "number", "b": "text"}


def _state_of(spark, rows):
    return spark.createDataFrame(rows, "k string, a bigint, b string")


@pytest.mark.parametrize("by", [[], ["k"]])
def test_digest_from_changed_rows_alone(spark, by):
    rng = random.Random(21)
    rows = [(rng.choice("xyz"), rng.choice([None, *range(9)]), rng.choice([None, "", "p", "q"])) for _ in range(300)]
    kinds = KINDS if by else {"k": "text", **KINDS}
    full = lambda r: sorted(map(tuple, multiset_digest(_state_of(spark, r), kinds, by).collect()))
    state = lane_state(_state_of(spark, rows), kinds, by)
    for _ in range(4):
        out = rng.sample(rows, 60)
        new = [("w", 1, None), *[(rng.choice("xyzw"), rng.randrange(9), "r") for _ in range(40)]]
        both = [("x", 5, "kept")]
        for row in out:
            rows.remove(row)
        rows += new
        state = moved_state(state, _state_of(spark, new + both), _state_of(spark, out + both), kinds, by)
        state = spark.createDataFrame(state.collect(), state.schema)
        assert sorted(map(tuple, state_digest(state, list(kinds), by).collect())) == full(rows)


def test_digest_of_removed_groups_and_of_rows_that_never_were(spark):
    rows = [("x", 1, "p"), ("x", 1, "p"), ("y", None, None)]
    none, state = _state_of(spark, []), lane_state(_state_of(spark, rows), KINDS, ["k"])
    left = moved_state(state, none, _state_of(spark, rows[:2]), KINDS, ["k"])
    assert [tuple(r) for r in state_digest(left, list(KINDS), ["k"]).collect()] == [tuple(r) for r in multiset_digest(_state_of(spark, rows[2:]), KINDS, ["k"]).collect()]
    assert moved_state(left, none, _state_of(spark, rows[2:]), KINDS, ["k"]).count() == 0
    wrong = state_digest(moved_state(left, none, _state_of(spark, [("z", 7, "never")]), KINDS, ["k"]), list(KINDS), ["k"])
    assert {r.k: (r.row_count, r.digest is None) for r in wrong.collect()} == {"y": (1, False), "z": (-1, True)}
    empty = moved_state(lane_state(none), none, none)
    assert state_digest(empty, ["k", "a", "b"]).first() == multiset_digest(none).first()
