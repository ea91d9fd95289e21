"""The catalog of a harbour: two lost feeds, two diamonds, and a part that stands alone."""

import json
import random

PREFIX, DOMAIN, TAG = "harbour.", "Harbour / Operations", "harbour-managed"
REGISTRY = ["snapshot_restore", "sql_transform", "python_build", "report_refresh"]

# name: availability, adapter, and what else it has
NODES = {
    "feed.tides": ("unavailable", "snapshot_restore", {
        "adapter_parameters": {"table": "feed.tides", "share": 0.25}, "owner": "urn:li:corpuser:mara", "risk": "high",
        "requires_approval": True,
        "validations": [{"kind": "exists"}, {"kind": "row_count", "parameters": {"minimum": 3}}, {"kind": "schema", "required": False}],
    }),
    "feed.ships": ("unavailable", "snapshot_restore", {"adapter_parameters": {"table": "feed.ships"}}),
    "feed.cranes": ("healthy", None, {}),
    "ref.berths": ("healthy", None, {"owner": "urn:li:corpuser:ivo"}),
    "slot.plan": ("unavailable", "sql_transform", {"display_name": 'Plan "ö" \\ ⚓', "validations": [{"kind": "schema", "required": False}]}),
    "dock.queue": ("unavailable", "sql_transform", {}),
    "yard.load": ("unavailable", "sql_transform", {"adapter_parameters": {"model": "load", "depth": 2}}),
    "yard.cost": ("unavailable", "python_build", {}),
    "yard.delay": ("unavailable", "python_build", {"risk": "medium"}),
    "board.daily": ("unavailable", "report_refresh", {"platform": "boards"}),
    "crew.rota": ("healthy", None, {}),
    "crew.pay": ("unavailable", "sql_transform", {"tags": [TAG, "finance"]}),
}
LINKS = [
    ("feed.tides", "slot.plan"), ("ref.berths", "slot.plan"), ("feed.ships", "dock.queue"), ("ref.berths", "dock.queue"),
    ("slot.plan", "yard.load"), ("dock.queue", "yard.load"), ("feed.cranes", "yard.load"),
    ("yard.load", "yard.cost"), ("yard.load", "yard.delay"), ("yard.cost", "board.daily"), ("yard.delay", "board.daily"),
    ("crew.rota", "crew.pay"),
]


def urn(name, platform=None):
    platform = platform or NODES.get(name, ("", None, {}))[2].get("platform", "store")
    return f"urn:li:dataset:(urn:li:dataPlatform:{platform},{PREFIX}{name},PROD)"


def asset(name, availability="unavailable", adapter="sql_transform", **extra):
    platform = extra.get("platform", "store")
    return {
        "urn": urn(name, platform), "display_name": name, "artifact_type": "dataset", "platform": platform,
        "domain": DOMAIN, "tags": [TAG], "availability": availability, "adapter": adapter,
    } | extra


def edge(up, down):
    return {
        "upstream_urn": up, "downstream_urn": down,
        "evidence": {"source": "catalog", "tool": "lineage", "upstream_urn": up, "downstream_urn": down},
    }


def base_assets():
    return [asset(name, state, adapter, **extra) for name, (state, adapter, extra) in NODES.items()]


def base_edges(*more):
    return [edge(urn(up), urn(down)) for up, down in [*LINKS, *more]]


def changed(name, **fields):
    """The assets with some fields of one of them replaced."""
    return [a | fields if a["urn"] == urn(name) else a for a in base_assets()]


def document(assets=None, edges=None, captured="2025-03-09T04:00:00Z"):
    return {
        "source_instance": "harbour-core", "captured_at": captured,
        "assets": base_assets() if assets is None else assets,
        "edges": base_edges() if edges is None else edges,
    }


def random_catalog(seed, nodes=24, chance=0.14):
    """Nodes whose edges lead from smaller to larger numbers, in a shuffled order."""
    rng = random.Random(seed)
    states = ["unavailable"] * 3 + ["healthy"]
    assets = [asset(f"n{i:02d}", rng.choice(states)) for i in range(nodes)]
    edges = [edge(assets[i]["urn"], assets[j]["urn"]) for i in range(nodes) for j in range(i + 1, nodes) if rng.random() < chance]
    rng.shuffle(assets)
    rng.shuffle(edges)
    return assets, edges


def with_defaults(doc):
    """The document as it is hashed: defaults filled in, sorted, no capture time."""
    defaults = {
        "availability": "unknown", "owner": None, "adapter": None, "adapter_parameters": {}, "validations": [],
        "risk": "low", "requires_approval": False,
    }
    assets = []
    for given in doc["assets"]:
        full = defaults | given
        assets.append(full | {"validations": [{"parameters": {}, "required": True} | v for v in full["validations"]]})
    return {
        "source_instance": doc["source_instance"],
        "assets": sorted(assets, key=lambda a: a["urn"]),
        "edges": sorted(doc["edges"], key=lambda e: (e["upstream_urn"], e["downstream_urn"])),
    }


def write(path, doc):
    path.write_text(json.dumps(doc, indent=1, ensure_ascii=False), encoding="utf-8")
    return str(path)


def request(request_id="storm", seeds=("feed.tides",), depth=10, **extra):
    return {
        "request_id": request_id, "incident_type": "feed_loss",
        "unavailable_asset_urns": [s if s.startswith("urn:") else urn(s) for s in seeds],
        "target_recovery_point": None, "max_blast_radius_depth": depth, "risk_mode": "demo", "requester": "mara",
    } | extra
