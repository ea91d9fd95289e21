"""Plans over the harbour catalog and over random catalogs with several incidents."""

import itertools

import brute
import fixtures as X
import pytest
from canonical import canonical_graph_digest
from pyspark.sql import functions as F

from salvor import schemas
from salvor.functions.scope import Scope
from salvor.plans import compile as C
from salvor.plans import workload
from salvor.sources.catalog_json import extra_keys, read_snapshots

SCOPE = Scope(X.PREFIX, X.DOMAIN, X.TAG)


@pytest.fixture
def plan(spark, tmp_path):
    numbers = itertools.count()

    def run(assets=None, edges=None, requests=None, registry=X.REGISTRY, **extra):
        path = X.write(tmp_path / f"catalog{next(numbers)}.json", X.document(assets, edges, **extra))
        snapshots, a, e = read_snapshots(spark, path)
        fingerprint = canonical_graph_digest(a, e, snapshots.first()["source_instance"]).first()[0]
        rows = spark.createDataFrame(requests or [X.request()], schemas.REQUESTS)
        return C.compile_plans(rows, a, e, registry, SCOPE, fingerprint)

    return run


def verdicts(book):
    return {r["request_id"]: (r["verdict"], r["detail"]) for r in book.plans.collect()}


def test_identifiers_come_from_the_canonical_documents(plan):
    book = plan()
    fingerprint = brute.sha(brute.canonical(X.with_defaults(X.document())))
    assert book.fingerprint == fingerprint
    body = {"compiler_version": "0.1.0", "graph_fingerprint": fingerprint, "request": X.request()}
    plan_id = "plan-" + brute.sha(brute.canonical(body))[:20]
    row = book.plans.first()
    assert (row["plan_id"], row["verdict"], row["target_count"], row["wave_count"]) == (plan_id, "ok", 8, 5)
    for s in book.steps.collect():
        step = "step-" + brute.sha(f"{plan_id}:{s['target_urn']}")[:16]
        assert (s["step_id"], s["idempotency_key"]) == (step, f"{plan_id}:{step}")


def test_the_lost_inputs_of_a_diamond_are_planned_too(plan):
    book = plan()
    waves = {r["target_urn"]: r["wave"] for r in book.steps.collect()}
    by_wave = [("feed.ships", "feed.tides"), ("dock.queue", "slot.plan"), ("yard.load",), ("yard.cost", "yard.delay"), ("board.daily",)]
    assert waves == {X.urn(n): i for i, names in enumerate(by_wave, start=1) for n in names}
    needs = {(r["step_id"], r["precondition_urn"]) for r in book.preconditions.collect()}
    steps = {r["target_urn"]: r["step_id"] for r in book.steps.collect()}
    assert needs == {(steps[X.urn(a)], X.urn(b)) for a, b in (("slot.plan", "ref.berths"), ("dock.queue", "ref.berths"), ("yard.load", "feed.cranes"))}
    fan = {r["target_urn"]: (r["dependency_count"], r["precondition_count"], r["risk"], r["requires_approval"]) for r in book.steps.collect()}
    assert fan[X.urn("yard.load")] == (2, 1, "low", False) and fan[X.urn("feed.tides")] == (0, 0, "high", True)
    decided = C.plan_selections(book.assets, C.selections(book.targets, book.parents), "storm").collect()
    excluded = {r["urn"] for r in decided if r["decision"] == "excluded"}
    assert len(decided) == 12 and excluded == {X.urn("crew.rota"), X.urn("crew.pay")}
    assert schemas.step_for_urn(book.steps, X.urn("board.daily")).count() == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_catalogs_with_several_incidents(plan, seed):
    assets, edges = X.random_catalog(seed)
    lost = sorted(a["urn"] for a in assets if a["availability"] == "unavailable")
    requests = [X.request(f"r{i}", lost[i::5], depth) for i, depth in enumerate((0, 1, 2, 9))]
    book = plan(assets, edges, requests)
    pairs = [(e["upstream_urn"], e["downstream_urn"]) for e in edges]
    state = {a["urn"]: a["availability"] for a in assets}
    for r in requests:
        targets = brute.closure(pairs, brute.reach(pairs, r["unavailable_asset_urns"], r["max_blast_radius_depth"]), state)
        wave, stuck = brute.waves(pairs, targets)
        steps = sorted((s for s in book.steps.collect() if s["request_id"] == r["request_id"]), key=lambda s: s["position"])
        assert not stuck
        assert [s["target_urn"] for s in steps] == brute.least_first_order(pairs, targets)
        assert {s["target_urn"]: s["wave"] for s in steps} == wave


def test_plans_do_not_depend_on_order_or_capture_time(plan):
    assets, edges = X.random_catalog(7, nodes=12)
    one = plan(assets, edges, [X.request(seeds=[assets[0]["urn"]])])
    two = plan(sorted(assets, key=lambda a: a["urn"]), edges[3:] + edges[:3], [X.request(seeds=[assets[0]["urn"]])], captured="2031-01-01T00:00:00Z")
    assert one.plans.first()["plan_id"] == two.plans.first()["plan_id"]
    assert one.plans.first()["plan_id"] != plan(assets, edges[1:], [X.request(seeds=[assets[0]["urn"]])]).plans.first()["plan_id"]


def test_each_verdict_goes_before_the_next(plan):
    """Faults are taken away one at a time, from the first verdict to the last."""
    back, loose = ("board.daily", "slot.plan"), ("feed.fog", "feed.tides")
    unknown = {"availability": "unknown"}
    requests = [X.request("bad", ["feed.tides", "feed.fog"]), X.request("good")]
    few = ["snapshot_restore", "sql_transform"]

    def assets(outside):
        rows = X.changed("feed.cranes", **unknown)
        return [a | {"domain": "Elsewhere"} if outside and a["urn"] == X.urn("crew.pay") else a for a in rows]

    found = verdicts(plan(assets(True), X.base_edges(back, loose), requests, few))
    assert found == {r: ("out_of_scope", X.urn("crew.pay")) for r in ("bad", "good")}
    found = verdicts(plan(assets(False), X.base_edges(back, loose), requests, few))
    assert {v for v, _ in found.values()} == {"invalid_lineage"} and found["good"][1] == X.urn("feed.fog")
    found = verdicts(plan(assets(False), X.base_edges(back), requests, few))
    assert found["bad"] == ("unknown_asset", X.urn("feed.fog"))
    core = sorted(X.urn(n) for n in ("board.daily", "slot.plan", "yard.cost", "yard.delay", "yard.load"))
    assert found["good"] == ("cycle", core[0])
    found = verdicts(plan(assets(False), None, requests, few))
    assert found["good"] == ("missing_adapter", min(X.urn("board.daily"), X.urn("yard.cost")))
    found = verdicts(plan(assets(False), None, requests))
    assert found["good"] == ("unresolved_prerequisite", f"{X.urn('yard.load')} requires {X.urn('feed.cranes')} with state unknown")
    assert verdicts(plan(None, None, requests))["good"] == ("ok", None)


def test_a_cycle_is_refused_only_where_it_is_recovered(plan):
    crew = ("crew.pay", "crew.pay")
    book = plan(X.changed("crew.rota", availability="unavailable"), X.base_edges(crew), [X.request("storm"), X.request("strike", ["crew.pay"])])
    assert verdicts(book)["storm"][0] == "ok"
    assert verdicts(book)["strike"] == ("cycle", X.urn("crew.pay"))
    assert {(r["request_id"], r["urn"]) for r in book.cycles.collect()} == {("strike", X.urn("crew.pay"))}
    book.raise_on_refusal("storm")
    with pytest.raises(C.PlanRefused, match="cycle"):
        book.raise_on_refusal("strike")
    with pytest.raises(KeyError):
        book.raise_on_refusal("nobody")


def test_depth_cuts_the_radius_but_not_the_lost_inputs(plan):
    book = plan(requests=[X.request("flat", ["yard.load"], 0), X.request("near", ["yard.load"], 1)])
    distance = {(r["request_id"], r["urn"]): r["distance"] for r in book.targets.collect()}
    inputs = {X.urn(n): None for n in ("slot.plan", "dock.queue", "feed.tides", "feed.ships")}
    near = {X.urn("yard.cost"): 1, X.urn("yard.delay"): 1}
    want = {("flat", u): d for u, d in ({X.urn("yard.load"): 0} | inputs).items()}
    want |= {("near", u): d for u, d in ({X.urn("yard.load"): 0} | inputs | near).items()}
    assert distance == want


def test_seeds_are_a_sorted_set(spark):
    rows = spark.createDataFrame([X.request(seeds=["urn:z", "urn:k", "urn:z", "urn:a"])], schemas.REQUESTS)
    assert schemas.normalize_requests(rows).first()["unavailable_asset_urns"] == ["urn:a", "urn:k", "urn:z"]


def test_reader_names_unknown_keys_and_fails_on_broken_documents(spark, tmp_path):
    doc = X.document(X.changed("crew.pay", mood="calm", wind=3)[-1:], []) | {"weather": "fog"}
    found = {(r["level"], r["key"]) for r in extra_keys(spark, X.write(tmp_path / "x.json", doc)).collect()}
    assert found == {("snapshot", "weather"), ("assets", "mood"), ("assets", "wind")}
    broken = tmp_path / "broken.json"
    broken.write_text('{"edges": "none"')
    with pytest.raises(Exception):
        read_snapshots(spark, str(broken))[2].collect()


def test_contracts(spark):
    swapped = X.edge("p", "q")
    swapped["evidence"]["upstream_urn"] = "q"
    edges = spark.createDataFrame([X.edge("p", "r"), swapped], schemas.EDGES)
    assert [r["broken_rules"] for r in schemas.rejected_edges(edges).collect()] == [["evidence upstream_urn differs from the edge"]]
    rows = [X.asset("one", risk="low"), X.asset("one", availability="gone", risk="low"), X.asset("two", display_name="", risk="wild")]
    assets = spark.createDataFrame(rows, schemas.ASSETS)
    assert sorted(tuple(r["broken_rules"]) for r in schemas.rejected_assets(assets).collect()) == [("availability is not allowed",), ("display_name is empty", "risk is not allowed")]
    assert [(r["urn"], r["copies"]) for r in schemas.duplicate_urns(assets).collect()] == [(X.urn("one"), 2)]


@pytest.mark.parametrize("name", ["harbour.", "harbor.feed", "", "x.harbour.feed", "harbour.feed,PROD),x"])
def test_names_outside_the_namespace(spark, name):
    from pyspark.sql import functions as F

    from salvor.functions.scope import in_namespace

    rows = [(f"urn:li:dataset:(urn:li:dataPlatform:harbour.store,{name},PROD)",), (X.urn("feed.tides"),), (X.urn("feed.tides") + "\n",), (name,)]
    found = spark.createDataFrame(rows, "u string").select("u", in_namespace(F.col("u"), X.PREFIX).alias("inside")).collect()
    assert {r["u"] for r in found if r["inside"]} == {X.urn("feed.tides")}


def test_catalog_follows_changed_tables(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = workload.catalog(spark, str(tmp_path))
    assert workload.catalog(spark, str(tmp_path)) is first
    n = first.assets.count()
    fewer = spark.read.parquet(f"{data}/orders.parquet").where("o_orderkey >= 100").withColumn("o_note", F.lit("x"))
    lost = spark.read.parquet(f"{data}/orders.parquet").count() - fewer.count()
    fewer.write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert "o_note" in workload.table(spark, str(tmp_path), "orders").columns
    assert lost > 0 and workload.catalog(spark, str(tmp_path)).assets.count() == n - lost
