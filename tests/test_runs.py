import datetime as dt
import os

import fixtures as X
import pytest

from pyspark.sql import functions as F

from salvor import schemas
from salvor.functions.scope import Scope
from salvor.operators import catalog as CT
from salvor.operators import ledger as L
from salvor.operators import validate as V
from salvor.sources import documents
from salvor.sources.catalog_json import read_snapshots

NOW = dt.datetime(2024, 1, 2)
NAMES = CT.CatalogNames("urn:li:domain:shop", "urn:li:tag:shop-managed", "urn:li:tag:shop-verified", "shop", "Shop")


def results(spark, specs, facts, schema):
    s = spark.createDataFrame([(f"t{i:02d}", k, p, True) for i, (k, p) in enumerate(specs)], V.SPECS)
    f = spark.createDataFrame([(f"t{i:02d}", *row) for i, row in enumerate(facts)], schema)
    out = V.evaluate(s, f, F.lit("2024-01-02").cast("timestamp")).collect()
    return [(r["passed"], r["detail"]) for r in sorted(out, key=lambda r: r["target_urn"])]


def test_table_checks(spark):
    schema = "target_urn string, present boolean, columns array<string>, expected_columns array<string>, row_count bigint, digest string, claimed_digest string, rule_breaks map<string,bigint>, rule_texts map<string,string>"
    rule = {"rule": "cheap"}
    ok = (True, ["a"], ["a"], 3, "d", "d", {"cheap": 0}, {"cheap": "all is cheap"})
    got = results(
        spark,
        [("exists", {}), ("exists", {}), ("schema", {}), ("schema", {}), ("row_count", {}), ("row_count", {"minimum": "4"}),
         ("checksum", {}), ("business_rule", rule), ("business_rule", rule)],
        [ok, (False, *ok[1:]), ok, (True, ["a", "b"], ["b", "a"], *ok[3:]), ok[:3] + (0, *ok[4:]), ok, ok[:5] + ("e", *ok[6:]),
         ok, (*ok[:6], {"cheap": 2, "other": 0}, ok[7])],
        schema,
    )
    assert got == [
        (True, "target exists"), (False, "target is missing"), (True, "schema matches"), (False, "schema mismatch"),
        (True, "row count 0 >= 0"), (False, "row count 3 >= 4"), (False, "output checksum matches adapter evidence"),
        (True, "all is cheap"), (False, "2 rows break cheap"),
    ]


def test_artifact_checks(spark):
    schema = "target_urn string, document string, modified_at timestamp, input_digest string"
    doc = '{"metrics":{"accuracy":0.83},"input_fingerprint":"f"}'
    metric = {"metric": "accuracy", "minimum": "0.7"}
    age = {"maximum_age_seconds": "300"}
    got = results(
        spark,
        [("artifact_load", {}), ("artifact_load", {}), ("artifact_load", {}), ("metric_threshold", metric), ("metric_threshold", metric),
         ("input_fingerprint", {}), ("input_fingerprint", {}), ("freshness", age), ("freshness", age), ("freshness", {}), ("other", {})],
        [(doc, NOW, "f"), ("{}", NOW, "f"), ("[]", NOW, "f"), (doc, NOW, "f"), ('{"metrics":{}}', NOW, "f"), (doc, NOW, "f"), (doc, NOW, "g"),
         (doc, NOW + dt.timedelta(days=1), "f"), (doc, NOW - dt.timedelta(seconds=300.5), "f"), (doc, NOW, "f"), (doc, NOW, "f")],
        schema,
    )
    assert got == [
        (True, "artifact loaded as JSON object"), (False, "artifact loaded as JSON object"), (False, "validation error: ValueError"),
        (True, "accuracy 0.83 >= 0.70"), (False, "validation error: KeyError"),
        (True, "report input fingerprint matches recovered revenue table"), (False, "report input fingerprint matches recovered revenue table"),
        (True, "artifact age 0.000s <= 300.000s"), (False, "artifact age 300.500s <= 300.000s"),
        (False, "validation error: KeyError"), (False, "unsupported validation kind: other"),
    ]


def test_checks_follow_plan_steps_and_gate(spark, tmp_path):
    _, assets, _ = read_snapshots(spark, X.write(tmp_path / "s.json", X.document()))
    steps = assets.select(F.lit("p").alias("plan_id"), F.col("urn").alias("step_id"), F.col("urn").alias("target_urn"), "validations")
    specs = V.step_specs(steps)
    assert specs.count() == 4
    table = spark.createDataFrame([(1, 2.0), (2, 9.0), (3, 0.5)], "k int, total_revenue double")
    facts = V.table_facts(table, X.urn("feed.tides"), ["k"], "revenue_nonnegative", "total_revenue")
    judged = V.evaluate(specs, facts, F.lit(NOW))
    gate = {r["step_id"]: (r["passed"], r["failed_required"]) for r in V.gate(judged, ["step_id"]).collect()}
    assert gate[X.urn("feed.tides")] == (True, "")  # its schema differs, but that is not required
    assert gate[X.urn("slot.plan")] == (True, "")
    report = V.rule_report(table, {"positive": "total_revenue > 5", "any": "k IS NOT NULL"})
    assert {r["rule"]: (r["rows_broken"], r["passed"]) for r in report.collect()} == {"positive": (2, False), "any": (0, True)}


def events(spark, rows):
    data = [("run", s, f"t:{s}", i, st, NOW, None, None, None) for i, (s, st) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.LEDGER)


def test_failure_and_resume(spark):
    deps = spark.createDataFrame([("run", b, a) for a, b in zip("123", "234")], "run_id string, step string, needs string")
    ledger = [(s, "pending") for s in "1234"] + [(s, x) for s in "123" for x in ("running", "verified")] + [("4", "running"), ("4", "failed")]
    steps = L.latest_steps(events(spark, ledger))
    assert {r["step_id"]: (r["status"], r["attempts"]) for r in steps.collect()} == {
        "1": ("verified", 1), "2": ("verified", 1), "3": ("verified", 1), "4": ("failed", 1),
    }
    assert L.run_summary(steps).first()["status"] == "failed"
    ready = L.resume_frontier(steps.withColumnRenamed("step_id", "step").select("run_id", "step", "status"), deps, ["run_id"])
    assert {r["step"]: r["frontier"] for r in ready.collect()} == {"1": "done", "2": "done", "3": "done", "4": "ready"}
    done = L.latest_steps(events(spark, ledger + [("4", "running"), ("4", "verified")]))
    assert {r["step_id"]: r["attempts"] for r in done.collect()}["4"] == 2
    assert L.run_summary(done).first()["status"] == "completed"
    early = L.latest_steps(events(spark, ledger[:4] + [("1", "running")]))
    blocked = L.resume_frontier(early.withColumnRenamed("step_id", "step").select("run_id", "step", "status"), deps, ["run_id"])
    assert {r["step"]: r["frontier"] for r in blocked.collect()} == {"1": "ready", "2": "blocked", "3": "blocked", "4": "blocked"}


def test_failure_text_is_cut_to_240_characters(spark):
    df = spark.createDataFrame([("é" * 300,)], "text string")
    row = L.failure_event(df, F.lit("RuntimeError"), F.col("text")).first()
    assert row["error_detail"] == "é" * 240 and row["error_type"] == "RuntimeError"


def test_approvals(spark):
    runs = spark.createDataFrame(
        [(r, "p", "f" if r != "stale" else "g", "completed" if r == "done" else "approved")
         for r in ("ok", "none", "other", "blank", "stale", "done", "bad run")],
        "run_id string, plan_id string, graph_fingerprint string, status string",
    )
    approvals = spark.createDataFrame(
        [("ok", "p", " dana "), ("other", "q", "dana"), ("blank", "p", "  "), ("stale", "p", "dana"), ("done", "p", "dana"), ("bad run", "p", "dana")],
        "run_id string, approved_plan_id string, approved_by string",
    )
    got = {r["run_id"]: (r["verdict"], r["approved_by"]) for r in L.approval_gate(runs, approvals, F.lit("f")).collect()}
    assert got["ok"] == ("go", "dana")
    assert {k: v for k, (v, _) in got.items() if k != "ok"} == {
        "none": "approval_required", "other": "approval_mismatch", "blank": "approver_blank", "stale": "stale",
        "done": "already_completed", "bad run": "invalid_run_id",
    }


def test_report_text(spark, tmp_path):
    runs = spark.createDataFrame(
        [("r", "plan-1", "completed", "fp", "captured_datahub_fixture", 1, 2, "not_configured", "none", None)],
        "run_id string, plan_id string, status string, graph_fingerprint string, context_mode string, verified_steps int, total_steps int, outcome string, outcome_detail string, approved_by string",
    )
    steps = spark.createDataFrame(
        [("r", 1, "u1", "verified", 1, "restored_snapshot"), ("r", 2, "u2", "failed", 2, None)],
        "run_id string, position int, target_urn string, status string, attempts int, action string",
    )
    checks = spark.createDataFrame([("r", 1, 0, True, "exists", "target exists")], "run_id string, position int, pos int, passed boolean, kind string, detail string")
    waves = spark.createDataFrame([("r", 1, "u1"), ("r", 1, "u2")], "run_id string, wave int, target_urn string")
    lines = L.report_lines(runs, steps, checks, waves, "Shop Report")
    text = [r["line"] for r in sorted(lines.collect(), key=lambda r: (r["section"], r["pos"], r["sub"]))]
    assert text[0] == "# Shop Report" and "- Verified steps: `1/2`" in text and "- Approval: `missing`" in text
    assert "".join(text[text.index("1. `u1`"):][:2]) == "1. `u1`, `u2`"
    at = text.index("- `u1` — **verified**, attempts `1`, action `restored_snapshot`")
    assert text[at + 1] == "  - PASS `exists`: target exists"
    assert text[at + 2] == "- `u2` — **failed**, attempts `2`, action `not produced`"
    L.write_report(lines, str(tmp_path / "report"), 2)
    assert spark.read.parquet(str(tmp_path / "report")).count() == len(text)


def test_aspect_feed_and_upserts(spark, tmp_path):
    _, assets, edges = read_snapshots(spark, X.write(tmp_path / "s.json", X.document()))
    feed = CT.aspect_feed(assets, edges, NAMES)
    controls = CT.control_aspects(spark, NAMES, "Shop", "shop-managed", "shop-verified")
    # 3 controls, 4 per asset, 2 owners, 7 assets with upstreams
    assert feed.unionByName(controls).count() == 3 + 4 * 12 + 2 + 7
    props = feed.filter((F.col("aspect_name") == "datasetProperties") & (F.col("entity_urn") == X.urn("feed.tides")))
    doc = props.select(F.from_json("document", "customProperties map<string,string>, name string").alias("d")).first()["d"]
    assert doc["customProperties"]["shop.adapter_parameters"] == '{"share":0.25,"table":"feed.tides"}'
    assert doc["customProperties"]["shop.requires_approval"] == "true" and doc["name"] == "feed.tides"
    assert CT.lineage_items(edges).count() == 12

    seeded = feed.withColumn("seq", F.lit(1).cast("bigint"))
    gone = CT.soft_delete(assets, F.lit(2).cast("bigint"))
    assert CT.active_assets(CT.latest_aspects(seeded.unionByName(gone))).count() == 0
    back = feed.withColumn("seq", F.lit(3).cast("bigint"))
    assert CT.active_assets(CT.latest_aspects(seeded.unionByName(gone).unionByName(back))).count() == 12

    target = spark.createDataFrame([(X.urn("yard.load"), "run-1", 4)], "target_urn string, run_id string, seq bigint")
    marked = CT.latest_aspects(seeded.unionByName(CT.writeback(target, NAMES)))
    assert CT.verify_writeback(target, marked, NAMES).first()["verified"] is True
    overwritten = marked.unionByName(feed.withColumn("seq", F.lit(9).cast("bigint")))
    assert CT.verify_writeback(target, CT.latest_aspects(overwritten), NAMES).first()["verified"] is False

    wrong = spark.createDataFrame(
        [(X.urn("yard.load"), "r", 1), (X.urn("nowhere"), "r", 1), ("urn:x", "r", 1), (X.urn("yard.load"), "a b", 1)],
        "target_urn string, run_id string, seq bigint",
    )
    refused = {(r["target_urn"], r["reason"]) for r in CT.writeback_refusals(wrong, assets, Scope(X.PREFIX, X.DOMAIN, X.TAG)).collect()}
    assert refused == {(X.urn("nowhere"), "absent_from_catalog"), ("urn:x", "outside_namespace"), (X.urn("yard.load"), "invalid_run_id")}


def test_lineage_proof_reports_the_missing_edge(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "upstream_urn string, downstream_urn string")
    page = CT.read_page(edges, 1)
    got = {(r["upstream_urn"], r["downstream_urn"], r["truncated"]) for r in CT.unproven_edges(edges, page, 1).collect()}
    assert got == {("a", "c", True)}
    assert CT.page_limit() == 100 and CT.page_limit(30) == 30 and CT.page_limit(500) == 100 and CT.page_limit(0) == 100


@pytest.mark.parametrize(
    "body,keys,found",
    [
        ('{"a":{"Api_Key":"x"}}', "apikey", False),
        ('{"a":[{"refresh-token":1},{"SECRET":2}]}', "refreshtoken,secret", False),
        ('{"note":"token: not a key"}', None, None),
        ('{"say":"he said \\"token\\": yes"}', None, None),
        ('{"x":"abc sk-1 def"}', "", True),
        ('{"sk-1":"x"}', None, None),
    ],
)
def test_secret_screen(spark, body, keys, found):
    df = spark.createDataFrame([("p", body)], "id string, body string")
    rows = CT.secret_screen(df, "body", "sk-1").collect()
    assert [(r["forbidden_keys"], r["token_found"]) for r in rows] == ([] if keys is None else [(keys, found)])


def test_slice_and_readiness(spark):
    parts = spark.createDataFrame(
        [("r", "seed", True, 1), ("r", "context", True, 2), ("r", "writeback", False, 3), ("r", "writeback", True, 4), ("q", "seed", True, 1)],
        "run_id string, operation string, verified boolean, seq bigint",
    )
    got = {r["run_id"]: r["verified"] for r in CT.slice_receipts(parts, ["seed", "context", "writeback"]).collect()}
    assert got == {"r": True, "q": False}
    resets = spark.createDataFrame(
        [("p", "reset", "started", 1), ("p", "reset", "failed", 2), ("p", "reset", "completed", 3)],
        "project string, operation string, status string, seq bigint",
    )
    assert CT.operation_state(resets).first()["status"] == "completed"


def test_evidence_of_a_catalog_without_fingerprint(spark):
    """A catalog that cannot be fingerprinted is judged after the receipt itself and before its age."""
    receipts = spark.createDataFrame(
        [(p, p, CT.SLICE_OPERATION, p != "unproven", f, True, {}, 1) for p, f in (("none", None), ("lost", "x"), ("stale", "x"), ("unproven", "x"))],
        "project string, named_project string, operation string, verified boolean, fingerprint string, readable boolean, paths map<string,string>, seq bigint",
    )
    projects = spark.createDataFrame(
        [("none", None, "/a"), ("lost", None, "/a"), ("stale", "y", "/a"), ("unproven", None, "/a")], "project string, fingerprint string, folder string"
    )
    files = spark.createDataFrame([], "project string, file_name string")
    got = {r["project"]: (r["ready"], r["detail"]) for r in CT.slice_evidence(receipts, projects, files).collect()}
    want = {"none": "unbound", "lost": "unbound", "stale": "stale", "unproven": "unproven"}
    assert got == {p: (False, CT.EVIDENCE_TEXT[code]) for p, code in want.items()}


def test_secret_screen_reads_texts_with_very_many_escapes(spark):
    body = '{"note":"' + "line\\\\n" * 200_000 + '","token":"x"}'
    rows = CT.secret_screen(spark.createDataFrame([("p", body)], "id string, body string"), "body", "sk-1").collect()
    assert [(r["forbidden_keys"], r["token_found"]) for r in rows] == [("token", False)]


def test_reset_invalidates_evidence_first(spark):
    resets = spark.createDataFrame([("p", 10, None), ("q", 20, "IOError")], "project string, seq bigint, error_type string")
    receipts = CT.reset_receipts(resets)
    order = [(r["operation"], r["status"]) for r in sorted(receipts.filter("project = 'p'").collect(), key=lambda r: r["seq"])]
    assert order == [(CT.INVALIDATED, "invalidated"), (CT.RESET, "started"), (CT.RESET, "completed")]
    last = CT.operation_state(receipts).filter("project = 'q' AND operation = 'datahub_fixture_reset'").first()
    assert (last["status"], last["partial_mutation_possible"], last["error_type"]) == ("failed", True, "IOError")


def test_graph_diff(spark, tmp_path):
    read = lambda name, doc: read_snapshots(spark, X.write(tmp_path / name, doc))[1:]
    old = read("a.json", X.document())
    changed = [a | {"risk": "high"} if a["display_name"] == "crew.rota" else a for a in X.base_assets()][1:]
    new = read("b.json", X.document(changed, X.base_edges()[1:]))
    got = {(r["item"], r["urn"], r["change"]) for r in CT.graph_diff(old[0], new[0], old[1], new[1]).collect()}
    assert got == {
        ("asset", X.urn("feed.tides"), "removed"), ("asset", X.urn("crew.rota"), "changed"), ("edge", X.urn("feed.tides"), "removed"),
    }


def test_freshness_of_stored_files(spark, tmp_path):
    """Files with known change times, from the listing to the verdict."""
    ages = {"fresh": [4000, 120, 900], "edge": [300, 301], "stale": [300.5, 9000], "ahead": [-60, 5000], "gone": None}
    rows = []
    for name, seconds in ages.items():
        if seconds is None:
            rows.append((name, None))
            continue
        folder = str(tmp_path / name)
        spark.range(60).repartition(len(seconds)).write.parquet(folder)
        files = sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))
        assert len(files) == len(seconds)
        for file, age in zip(files, seconds, strict=True):
            os.utime(f"{folder}/{file}", (NOW.timestamp() - age,) * 2)
        newest = documents.newest_change(spark, folder).select(F.unix_micros("modified_at")).first()[0]
        assert newest == round((NOW.timestamp() - min(seconds)) * 1e6)
        rows.append((name, dt.datetime.fromtimestamp(newest / 1e6)))
    age = {"maximum_age_seconds": "300"}
    got = results(spark, [("freshness", age)] * len(rows), [(at,) for _, at in rows], "target_urn string, modified_at timestamp")
    assert got == [
        (True, "artifact age 120.000s <= 300.000s"), (True, "artifact age 300.000s <= 300.000s"),
        (False, "artifact age 300.500s <= 300.000s"), (True, "artifact age 0.000s <= 300.000s"),
        (False, "validation error: FileNotFoundError"),
    ]
