import os
import random
from collections import Counter

import brute
import pytest

from pyspark.sql import functions as F

from salvor import runtime
from salvor.operators import catalog as CT
from salvor.operators import graph as G
from salvor.operators import ledger as L
from salvor.operators import skew
from salvor.operators.skew import number_rows, previous_in_key
from salvor.plans import compile as C
from salvor.plans import staleness, workload
from salvor.sources import catalog_json


def make(spark, rng, nodes, edges, cyclic):
    names = [f"n{i:02d}" for i in range(nodes)]
    rng.shuffle(names)
    pairs = set()
    while len(pairs) < edges:
        a, b = rng.sample(range(nodes), 2)
        if cyclic or a < b:
            pairs.add((names[a], names[b]))
    # One hub takes part in about a third of all edges.
    hub = names[nodes // 2]
    for i in range(nodes):
        if i != nodes // 2 and rng.random() < 0.6:
            pairs.add((names[i], hub) if i < nodes // 2 else (hub, names[i]))
    state = {n: rng.choice(["healthy", "unavailable", "unknown"]) for n in names}
    assets = spark.createDataFrame(list(state.items()), "urn string, availability string")
    rows = list(pairs) + list(pairs)[:5]
    edge_rows = spark.createDataFrame(rows, "upstream_urn string, downstream_urn string")
    return names, pairs, state, assets, edge_rows


@pytest.mark.parametrize("seed,cyclic,hub_rows,limit", [(1, False, 1000, 10**6), (2, False, 3, 0), (3, True, 3, 12), (4, True, 1000, 10**6)])
def test_walks_against_plain_python(spark, seed, cyclic, hub_rows, limit):
    rng = random.Random(seed)
    names, pairs, state, assets, edges = make(spark, rng, 18, 24, cyclic)
    graph = G.build_graph(assets, edges, hub_rows=hub_rows)
    assert (graph.up_hubs.table is not None) == (hub_rows == 3)
    requests = {f"r{i}": (rng.sample(names, 2), rng.choice([0, 1, 2, 25])) for i in range(4)}
    seeds = spark.createDataFrame(
        [(r, s, d) for r, (ss, d) in requests.items() for s in ss], "request_id string, urn string, max_depth int"
    )
    reach = G.blast_radius(seeds, graph)
    targets = G.prerequisite_closure(reach, graph)
    parents = G.target_parents(targets, graph)
    waves, stuck, left = G.recovery_waves(targets, parents, graph, limit)
    found = {r: {} for r in requests}
    for row in targets.collect():
        found[row["request_id"]][row["urn"]] = row["distance"]
    roles = {(r["request_id"], r["urn"], r["upstream_urn"]): r["role"] for r in parents.collect()}
    layers = {(r["request_id"], r["urn"]): (r["wave"], r["order_key"]) for r in waves.collect()}
    core = {(r["request_id"], r["urn"]) for r in G.cycle_core(stuck, parents, graph).collect()} if left else set()
    assert left == stuck.count()
    ring = {r: {} for r in requests}
    if left:
        for row in G.one_cycle(G.cycle_core(stuck, parents, graph), parents, graph).collect():
            ring[row["request_id"]][row["pos"]] = row["urn"]
    for r, (ss, depth) in requests.items():
        near = brute.reach(pairs, ss, depth)
        all_targets = brute.closure(pairs, near, state)
        assert found[r] == {n: near.get(n) for n in all_targets}
        expected = {}
        for u, v in pairs:
            if v in all_targets:
                role = "dependency" if u in all_targets else "precondition" if state[u] == "healthy" else "unresolved"
                expected[(r, v, u)] = role
        assert {k: v for k, v in roles.items() if k[0] == r} == expected
        wave, rest = brute.waves(pairs, all_targets)
        assert {n: w for (q, n), (w, _) in layers.items() if q == r} == wave
        assert {n for q, n in core if q == r} == brute.cyclic_core(pairs, all_targets)
        path = [ring[r][i] for i in range(len(ring[r]))]
        assert bool(path) == bool(brute.cyclic_core(pairs, all_targets))
        assert all((u, v) in pairs for u, v in zip(path, path[1:] + path[:1]))
        assert len(set(path)) == len(path) and (not path or path[0] == min(path))
        if not rest:
            ordered = sorted((k, n) for (q, n), (_, k) in layers.items() if q == r)
            assert [n for _, n in ordered] == brute.least_first_order(pairs, all_targets)


def test_many_requests_share_words(spark):
    """More requests than a word has bits, with depths of their own."""
    rng = random.Random(11)
    names, pairs, state, assets, edges = make(spark, rng, 14, 20, True)
    graph = G.build_graph(assets, edges)
    requests = {f"r{i:03d}": (rng.sample(names, rng.randrange(1, 3)), rng.randrange(4)) for i in range(150)}
    seeds = spark.createDataFrame(
        [(r, s, d) for r, (ss, d) in requests.items() for s in ss], "request_id string, urn string, max_depth int"
    )
    reach = G.blast_radius(seeds, graph)
    rows = G.prerequisite_closure(reach, graph).collect()
    assert len(rows) == len({(r["request_id"], r["urn"]) for r in rows})
    found = {r: {} for r in requests}
    for row in rows:
        found[row["request_id"]][row["urn"]] = row["distance"]
    for r, (ss, depth) in requests.items():
        near = brute.reach(pairs, ss, depth)
        assert found[r] == {n: near.get(n) for n in brute.closure(pairs, near, state)}
    none = seeds.limit(0)
    assert G.prerequisite_closure(G.blast_radius(none, graph), graph).count() == 0


def test_deep_chain_is_one_job(spark):
    """A chain of 1,000 assets and a node beside it: waves and order without a round per link."""
    chain = [f"c{i:04d}" for i in range(1000)]
    targets = spark.createDataFrame([("r", n) for n in [*chain, "a"]], "request_id string, urn string")
    parents = spark.createDataFrame(
        [("r", v, u, 0, "unavailable", "dependency") for u, v in zip(chain, chain[1:])],
        "request_id string, urn string, upstream_urn string, up_slot int, up_availability string, role string",
    )
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "deep")
    waves, _, left = G.recovery_waves(targets, parents, None)
    jobs = len(tracker.getJobIdsForGroup("deep"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert left == 0 and 0 < jobs <= 25
    rows = sorted(waves.collect(), key=lambda r: r["order_key"])
    assert [r["urn"] for r in rows] == ["a", *chain]
    assert {r["urn"]: r["wave"] for r in rows} == {"a": 1} | {n: i + 1 for i, n in enumerate(chain)}


def test_order_differs_from_waves(spark):
    """With a -> b and c alone, a and b come first although c is in wave 1."""
    assets = spark.createDataFrame([(n, "unavailable") for n in "abc"], "urn string, availability string")
    edges = spark.createDataFrame([("a", "b")], "upstream_urn string, downstream_urn string")
    graph = G.build_graph(assets, edges)
    targets = spark.createDataFrame([("r", n) for n in "abc"], "request_id string, urn string")
    waves, _, _ = G.recovery_waves(targets, G.target_parents(targets, graph), graph)
    numbered = number_rows(waves, ["request_id"], ["order_key"], "position")
    assert {r["urn"]: (r["position"], r["wave"]) for r in numbered.collect()} == {"a": (1, 1), "b": (2, 2), "c": (3, 1)}


def test_long_chain_and_self_loop(spark):
    chain = [f"c{i:03d}" for i in range(25)]
    names = [*chain, "loop"]
    assets = spark.createDataFrame([(n, "unavailable") for n in names], "urn string, availability string")
    edges = spark.createDataFrame([*zip(chain, chain[1:]), ("loop", "loop")], "upstream_urn string, downstream_urn string")
    graph = G.build_graph(assets, edges)
    targets = spark.createDataFrame([("r", n) for n in names], "request_id string, urn string")
    parents = G.target_parents(targets, graph)
    waves, stuck, left = G.recovery_waves(targets, parents, graph, limit=0)
    assert {r["urn"]: r["wave"] for r in waves.collect()} == {n: i + 1 for i, n in enumerate(chain)}
    assert left == 1 and [r["urn"] for r in stuck.collect()] == ["loop"]
    assert [r["urn"] for r in G.cycle_core(stuck, parents, graph).collect()] == ["loop"]


def test_numbering_and_lag_with_a_heavy_key(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at bigint, tie bigint")
    by_key = {}
    for k, at, tie in sorted(rows):
        by_key.setdefault(k, []).append((at, tie))
    got = number_rows(df, ["k"], ["at", "tie"], "n", parts=6).collect()
    assert {(r["k"], r["tie"]): r["n"] for r in got} == {
        (k, tie): i + 1 for k, v in by_key.items() for i, (_, tie) in enumerate(v)
    }
    spread = previous_in_key(df, "k", "at", "tie", "before").collect()
    assert {(r["k"], r["tie"]): r["before"] for r in spread} == {
        (k, tie): (v[i - 1][0] if i else None) for k, v in by_key.items() for i, (_, tie) in enumerate(v)
    }
    ranges = df.repartitionByRange(6, "k", "at", "tie").groupBy(F.spark_partition_id().alias("p")).count()
    assert max(r["count"] for r in ranges.collect()) < 1500


def test_walk_plan_scans_only_needed_columns(spark):
    assets = spark.createDataFrame([("a", "healthy"), ("b", "healthy")], "urn string, availability string")
    edges = spark.createDataFrame([("a", "b")], "upstream_urn string, downstream_urn string")
    links = G.build_graph(assets, edges).known.select("upstream_urn", "downstream_urn")
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(up_availability)" in plan and "EqualTo(down_known,true)" in plan


def _selected(pairs, state, seeds, depth):
    """Targets with distances and parents with roles of one request, in plain Python."""
    if not set(seeds) <= set(state):
        return {}, {}
    pairs = {(u, v) for u, v in pairs if u in state and v in state}
    reached = brute.reach(pairs, seeds, depth)
    targets = {n: reached.get(n) for n in brute.closure(pairs, reached, state)}
    role = lambda u: "dependency" if u in targets else "precondition" if state[u] == "healthy" else "unresolved"
    return targets, {(v, u): (state[u], role(u)) for u, v in pairs if v in targets}


@pytest.mark.parametrize("seed,cyclic,hub_rows", [(31, False, 1000), (32, True, 3)])
def test_stale_plans_against_two_full_selections(spark, seed, cyclic, hub_rows):
    rng = random.Random(seed)
    names, pairs, state, _, _ = make(spark, rng, 22, 22, cyclic)
    after, new_state = set(pairs), dict(state)
    after -= set(rng.sample(sorted(pairs), 2))
    after |= {tuple(rng.sample(names, 2)), (names[0], "late")}
    new_state["late"] = "unavailable"
    new_state[names[1]] = {"healthy": "unavailable"}.get(state[names[1]], "healthy")
    del new_state[names[2]]
    wanted = {f"r{i}": (rng.sample([*names, "late"], 1 + i % 2), rng.choice([0, 1, 3])) for i in range(24)}
    requests = spark.createDataFrame(
        [(r, ss, d) for r, (ss, d) in wanted.items()], "request_id string, unavailable_asset_urns array<string>, max_blast_radius_depth int"
    )
    graphs = [
        G.build_graph(
            spark.createDataFrame(list(s.items()), "urn string, availability string"),
            spark.createDataFrame(sorted(p), "upstream_urn string, downstream_urn string"), hub_rows=hub_rows,
        )
        for p, s in ((pairs, state), (after, new_state))
    ]
    stored = staleness.select(requests, graphs[0])
    stale, again = staleness.stale_plans(requests, stored, *graphs)
    want = {}
    for r, (ss, d) in wanted.items():
        counts = []
        for old, new in zip(_selected(pairs, state, ss, d), _selected(after, new_state, ss, d), strict=True):
            counts += [len(new.keys() - old.keys()), len(old.keys() - new.keys()), sum(old[k] != new[k] for k in old.keys() & new.keys())]
        if any(counts):
            want[r] = tuple(counts)
    assert {x[0]: tuple(x[1:]) for x in stale.select("request_id", *staleness.COUNTS).collect()} == want
    touched = {x[0] for x in staleness.touched_requests(requests, stored, *graphs).collect()}
    assert want.keys() <= touched and 0 < len(want) and len(touched) < len(wanted)
    for r in touched:
        targets, _ = _selected(after, new_state, *wanted[r])
        assert {x.urn: x.distance for x in again.targets.where(F.col("request_id") == r).collect()} == targets
    assert staleness.stale_plans(requests, stored, graphs[0], graphs[0])[0].count() == 0


def _broadcasts(df):
    """Relations that Spark's own estimate lets it broadcast, before a row is counted."""
    return str(df._jdf.queryExecution().executedPlan().toString()).count("BroadcastExchange")


def test_uncounted_tables_are_never_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    """A packed catalog is estimated far below the default limit; its rows would not fit the driver."""
    n = 200_000
    urn = F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:x,estate."), F.col("id").cast("string"), F.lit(",PROD)"))
    wide = [F.lit(None).cast("string").alias(f"c{i}") for i in range(12)]
    assets = runtime.cut(
        spark.range(n).select(urn.alias("urn"), F.lit("healthy").alias("availability"), F.lit(None).cast("string").alias("adapter"), *wide), "assets"
    )
    few = assets.limit(3)
    requests = few.select(F.col("urn").alias("request_id"), F.array("urn").alias("unavailable_asset_urns"), F.lit(1).alias("max_blast_radius_depth"))
    edges = runtime.cut(assets.select(F.col("urn").alias("upstream_urn"), F.col("urn").alias("downstream_urn")), "edges")
    targets = runtime.cut(assets.select(F.lit("r").alias("request_id"), "urn", F.lit(0).alias("distance")), "targets")
    written, made = [], G.cut_bucketed
    monkeypatch.setattr(G, "cut_bucketed", lambda df, *a, **k: written.append(df) or made(df, *a, **k))
    graph = G.build_graph(assets, edges)
    parents = runtime.cut(G.target_parents(targets, graph).drop("up_slot").withColumn("up_slot", F.lit(0)), "parents")
    plain = assets.select("urn").join(assets.select("urn"), "urn", "left_semi")
    assert _broadcasts(plain) == 1, "the estimate must be below the limit for this test to tell anything"
    found = [
        *written, G.unknown_seeds(requests, assets), G.dangling_pairs(assets, edges), G.target_parents(targets, graph),
        C.missing_adapters(targets, assets, ["a"]), C.plan_selections(assets, C.selections(targets, parents), "r"),
        L.missing_preconditions(assets.select(F.col("urn").alias("precondition_urn")), assets.select("urn", F.lit(True).alias("available"))),
        CT.aspect_feed(
            assets.select(
                "*", *[F.lit("x").alias(c) for c in ("display_name", "artifact_type", "platform", "owner", "parameters_json", "risk")],
                F.lit(False).alias("requires_approval"), F.lit(None).cast("array<struct<kind:string,parameters_json:string,required:boolean>>").alias("validations"),
            ), edges, CT.CatalogNames(domain_urn="d", tag_urn="t", marker_urn="m"),
        ),
    ]
    assert [_broadcasts(df) for df in found] == [0] * len(found)
    counted = runtime.sized(assets.select("urn"), runtime.BROADCAST_ROWS + 1)
    assert _broadcasts(assets.join(counted, "urn")) == 0
    assert _broadcasts(assets.join(runtime.sized(assets.select("urn"), n), "urn")) == 1


def _written(spark, *labels):
    """Scratch tables with such names that are there now."""
    top = os.path.join(runtime.shared_folder(spark).removeprefix("file://"), spark.sparkContext.applicationId)
    return {x for x in os.listdir(top) if x.rsplit("-", 1)[0] in labels}


@pytest.mark.parametrize("stored", [False, True])
def test_a_graph_keeps_its_links_only(spark, stored):
    """Equal edges collapse, odd ends stay, and what the build wrote on its way is gone."""
    pairs = [("a", "b"), ("a", "b"), ("b", "c"), ("x", "c"), ("a", "y"), (None, "b"), ("a", None)]
    assets = spark.createDataFrame([("a", "healthy"), ("b", None), ("c", "unavailable")], "urn string, availability string")
    edges = runtime.cut(spark.createDataFrame(pairs, "upstream_urn string, downstream_urn string"), "given")
    before = _written(spark, "edges", "ended", "given")
    for hub_rows in (1, 1000):
        graph = G.build_graph(assets, edges, hub_rows=hub_rows, stored=stored)
        state = {"a": "healthy", "b": "unknown", "c": "unavailable"}
        want = {(u, v, state.get(u), v in state) for u, v in set(pairs)}
        for links in (graph.links, graph.links_by_child):
            got = [tuple(x) for x in links.select("upstream_urn", "downstream_urn", "up_availability", "down_known").collect()]
            assert len(got) == len(want) and set(got) == want
    assert _written(spark, "edges", "ended", "given") == before


@pytest.mark.parametrize("hub_rows", [2, 7, 40])
def test_hubs_are_those_of_a_plain_count(spark, hub_rows, monkeypatch):
    rng = random.Random(hub_rows)
    rows = [(f"u{int(rng.paretovariate(0.6)) % 30}", f"d{rng.randrange(60)}") for _ in range(300)] + [(None, "d1")] * 9
    df = spark.createDataFrame(rows, "up string, down string")
    seen, made = [], skew.cut
    monkeypatch.setattr(skew, "cut", lambda d, label: seen.append(d) or made(d, label))
    hubs = skew.find_hubs(df, ["up", "down"], len(rows), hub_rows)
    for side, h in enumerate(hubs):
        want = {k: -(-n // hub_rows) for k, n in Counter(r[side] for r in rows).items() if n > hub_rows}
        assert {x["hub"]: x["slots"] for x in (h.table.collect() if h.table is not None else [])} == want
        assert h.widest == max(want.values(), default=1)
    # Rows are counted by key only where their part of the hash is over the limit.
    assert all("BroadcastExchange" in str(d._jdf.queryExecution().executedPlan().toString()) for d in seen)


def test_a_catalog_writes_only_what_is_asked_for(spark, monkeypatch):
    """``requests`` needs no stored assets or edges, and the evidence of edges is not stored."""
    ends = spark.createDataFrame([("a", "b"), ("b", "c"), (None, "c")], "upstream_urn string, downstream_urn string")
    written = []
    monkeypatch.setattr(workload, "cut", lambda df, label: written.append((label, df.columns)) or runtime.cut(df, label))
    monkeypatch.setattr(workload, "edges", lambda *a: workload.with_evidence(ends))
    monkeypatch.setattr(workload, "requests", lambda *a: "requests")
    c = workload.Catalog(spark, "nowhere")
    assert c.requests == "requests" and not written
    rows = {(x["upstream_urn"], x["downstream_urn"], tuple(x["evidence"])) for x in c.edges.collect()}
    assert rows == {(u, v, ("datahub_mcp", "get_lineage", u, v)) for u, v in [("a", "b"), ("b", "c"), (None, "c")]}
    assert c.edges.schema == workload.edges().schema and written == [("lineage", ["upstream_urn", "downstream_urn"])]


def test_edge_rows_are_packed_in_files_of_some_lines(spark, tmp_path):
    edges = workload.with_evidence(spark.range(95).coalesce(1).select(
        F.concat(F.lit("up "), F.col("id").cast("string")).alias("upstream_urn"), F.lit("down \u00e9").alias("downstream_urn")
    ))
    for _ in range(2):
        catalog_json.write_edge_rows(edges, str(tmp_path / "edges"), 10)
    files = sorted((tmp_path / "edges").glob("part-*"))
    assert len(files) == 20 and all(f.name.endswith(".json.gz") for f in files)
    back = catalog_json.read_edge_rows(spark, str(tmp_path / "edges"))
    assert back.exceptAll(edges).count() == 95 and edges.exceptAll(back).count() == 0 and back.count() == 190


def test_graph_diff_moves_short_digests(spark):
    names = ["urn", "display_name", "artifact_type", "platform", "domain", "owner", "adapter", "parameters_json", "availability", "risk"]
    schema = ", ".join(f"{n} string" for n in names) + ", requires_approval boolean, tags array<string>, validations array<struct<kind:string,parameters_json:string,required:boolean>>"
    row = lambda urn, owner: (urn, *["x"] * 4, owner, *["x"] * 4, False, ["t"], [])
    old, new = (spark.createDataFrame([row(*r) for r in rows], schema) for rows in ([("a", "o"), ("b", "o"), ("c", None)], [("a", "o"), ("b", "p"), ("d", "o")]))
    link = "upstream_urn string, downstream_urn string, evidence struct<source:string>"
    was, now = (spark.createDataFrame([(u, v, None if s is None else (s,)) for u, v, s in rows], link) for rows in (
        [("a", "b", "s"), ("a", "b", "r"), ("b", "c", "s"), ("c", "d", "s")], [("a", "b", "s"), ("b", "c", "t"), ("d", "c", "s")]
    ))
    found = CT.graph_diff(old, new, was, now)
    assert {tuple(x) for x in found.collect()} == {
        ("asset", "b", "", "changed"), ("asset", "c", "", "removed"), ("asset", "d", "", "added"),
        # Of equal edges the greatest digest counts.
        *([] if max(brute.sha('{"source":"r"}'), brute.sha('{"source":"s"}')) == brute.sha('{"source":"s"}') else [("edge", "a", "b", "changed")]),
        ("edge", "b", "c", "changed"), ("edge", "c", "d", "removed"), ("edge", "d", "c", "added"),
    }
    assert "unhex" in found._jdf.queryExecution().optimizedPlan().toString()
