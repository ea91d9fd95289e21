"""Lineage graph: build, bounded reach, prerequisite closure, waves, order and cycles.

All walks are keyed by ``request_id`` so that many incidents run in one job. Each
round joins a frontier with the edges and writes its result as a table in the
shared folder; only row counts reach the driver.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvor.operators.skew import HUB_ROWS, MAX_HUBS, Hubs, find_hubs, number_rows
from salvor.runtime import (
    Pile, bucket_count, cut, cut_bucketed, cut_counted, free_shuffles, release, shuffled, sized, union_all,
)

# Targets and dependencies of a request that one task may order, about 100 MB.
ONE_TASK_ROWS = 200_000


@dataclass(frozen=True)
class LineageGraph:
    assets: DataFrame
    # upstream_urn, downstream_urn, up_slot, down_slot, up_availability, down_known;
    # dealt by the upstream end, and once more by the downstream end
    links: DataFrame
    links_by_child: DataFrame
    up_hubs: Hubs
    down_hubs: Hubs

    @property
    def known(self) -> DataFrame:
        """Links whose two ends are both assets."""
        return self.links.filter(F.col("up_availability").isNotNull() & F.col("down_known"))

    @property
    def known_by_child(self) -> DataFrame:
        return self.links_by_child.filter(F.col("up_availability").isNotNull() & F.col("down_known"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per (upstream, downstream); duplicates collapse."""
    return edges.groupBy("upstream_urn", "downstream_urn").agg(F.max("evidence").alias("evidence"))


def build_graph(
    assets: DataFrame, edges: DataFrame, hub_rows: int = HUB_ROWS, max_hubs: int = MAX_HUBS, stored: bool = False
) -> LineageGraph:
    """The links of a catalog, dealt by either end.

    ``stored``: the edges are a table that can be read again; others are written first.
    Edges are moved three times, and what a move leaves on disk goes before the next:
    to their downstream end, where equal ones collapse, to the upstream end and back.
    """
    spark, ends = edges.sparkSession, ["upstream_urn", "downstream_urn"]
    if stored:
        rows, total = edges.select(*ends), edges.count()
    else:
        rows, n = cut_counted(edges.select(*ends), "edges", all=F.lit(True))
        total = n["all"]
    up, down = find_hubs(rows, ends, total, hub_rows, max_hubs)
    # Without hubs all slots are 0 and joins use the name alone.
    by_up = ["upstream_urn", "up_slot"] if up.widest > 1 else ["upstream_urn"]
    by_down = ["downstream_urn", "down_slot"] if down.widest > 1 else ["downstream_urn"]
    state = assets.select("urn", F.coalesce("availability", F.lit("unknown")).alias("availability"))
    heads = up.spread(
        state.select(
            F.col("urn").alias("upstream_urn"), F.col("availability").alias("up_availability")
        ),
        "upstream_urn",
        "up_slot",
    ).select(*by_up, "up_availability")
    tails = down.spread(
        state.select(F.col("urn").alias("downstream_urn"), F.lit(True).alias("down_known")),
        "downstream_urn",
        "down_slot",
    ).select(*by_down, "down_known")

    def settle(*done: DataFrame) -> None:
        if total > hub_rows:
            free_shuffles(spark)
        release(*done)

    parts = bucket_count(spark, total)
    slotted = up.slot_of(rows, "upstream_urn", "downstream_urn", "up_slot")
    slotted = down.slot_of(slotted, "downstream_urn", "upstream_urn", "down_slot")
    # A link's slots follow from its ends, so equal edges meet in one partition.
    ended = cut(
        slotted.repartition(parts, *by_down).distinct()
        .join(shuffled(tails), by_down, "left")
        .withColumn("down_known", F.coalesce("down_known", F.lit(False))),
        "ended",
    )
    settle(*([] if stored else [rows]))
    links = ended.repartition(parts, *by_up).join(shuffled(heads), by_up, "left")
    links = cut_bucketed(links, "links", by_up, total, dealt=True)
    settle(ended)
    by_child = cut_bucketed(links, "links_by_child", by_down, total)
    settle()
    return LineageGraph(assets, links, by_child, up, down)


def dangling_edges(graph: LineageGraph) -> DataFrame:
    """Edges with an end that is no asset, and which ends those are."""
    missing = F.filter(
        F.array(
            F.when(F.col("up_availability").isNull(), F.col("upstream_urn")),
            F.when(~F.col("down_known"), F.col("downstream_urn")),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        graph.links.select("upstream_urn", "downstream_urn", missing.alias("missing_urns"))
        .filter(F.size("missing_urns") > 0)
    )


def dangling_pairs(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``dangling_edges`` straight from edges and assets, by an anti join for either end."""
    pairs = edges.select("upstream_urn", "downstream_urn").distinct()
    lost = None
    for side, end in enumerate(("upstream_urn", "downstream_urn")):
        one = pairs.join(shuffled(assets.select(F.col("urn").alias(end))), end, "left_anti")
        one = one.select("upstream_urn", "downstream_urn", F.struct(F.lit(side).alias("side"), F.col(end).alias("urn")).alias("missing"))
        lost = one if lost is None else lost.unionByName(one)
    both = lost.groupBy("upstream_urn", "downstream_urn").agg(F.sort_array(F.collect_list("missing")).alias("missing"))
    return both.select("upstream_urn", "downstream_urn", F.transform("missing", lambda m: m["urn"]).alias("missing_urns"))


def lineage_roots(edges: DataFrame) -> DataFrame:
    return edges.select("upstream_urn").distinct()


def request_seeds(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id",
        F.col("max_blast_radius_depth").alias("max_depth"),
        F.explode("unavailable_asset_urns").alias("urn"),
    )


def unknown_seeds(requests: DataFrame, assets: DataFrame) -> DataFrame:
    return request_seeds(requests).join(shuffled(assets.select("urn")), "urn", "left_anti").select(
        "request_id", "urn"
    )


def _numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """request_id, word, bit: every request's place in 64-bit words."""
    place = number_rows(ids.select("request_id").distinct(), [], ["request_id"], "_n")
    # Written per bit, since a shift wants a plain number on its left.
    bit = F.expr("shiftleft(1L, cast(pmod(_n - 1, 64) AS int))")
    numbered, n = cut_counted(
        place.select("request_id", F.floor((F.col("_n") - 1) / 64).alias("word"), bit.alias("bit")),
        "numbered",
        all=F.lit(True),
    )
    return numbered, n["all"]


def _in_words(rows: DataFrame, numbered: DataFrame, n: int) -> DataFrame:
    """urn, word, bits: one row for up to 64 requests that share a node."""
    return (
        rows.select("request_id", "urn").join(sized(numbered, n), "request_id")
        .groupBy("urn", "word").agg(F.bit_or("bit").alias("bits"))
    )


def _out_of_words(rows: DataFrame, numbered: DataFrame, n: int) -> DataFrame:
    """One row per request again."""
    return (
        rows.join(sized(numbered, n), "word")
        .filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        .drop("word", "bits", "bit")
    )


def _unseen(reached: DataFrame, seen: Pile) -> DataFrame:
    """The bits of ``reached`` that are in no row of ``seen``."""
    known = seen.all().groupBy("urn", "word").agg(F.bit_or("bits").alias("known"))
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("bigint"))))
    return (
        reached.join(sized(known, seen.rows), ["urn", "word"], "left")
        .select("urn", "word", left.alias("bits"))
        .filter(F.col("bits") != 0)
    )


def blast_radius(seeds: DataFrame, graph: LineageGraph) -> DataFrame:
    """Downstream reach of each request's seeds with the least distance.

    ``seeds`` has ``request_id, urn, max_depth``; the result adds ``distance``. A
    request's depth is the greatest of its rows. Requests are bits of words, so
    a round moves an edge once for up to 64 requests that share it.
    """
    links = graph.known.select(
        F.col("upstream_urn").alias("urn"), F.col("up_slot").alias("slot"), "downstream_urn"
    )
    numbered, requests = _numbered(seeds)
    depths = cut(
        seeds.groupBy("request_id").agg(F.max("max_depth").alias("max_depth"))
        .join(sized(numbered, requests), "request_id").select("word", "bit", "max_depth"),
        "depths",
    )

    def placed(rows: DataFrame, distance: int) -> tuple[DataFrame, dict[str, int]]:
        """Rows of one distance with the bits of the requests that go on from there."""
        further = depths.filter(F.col("max_depth") > distance).groupBy("word").agg(F.bit_or("bit").alias("further"))
        going = F.col("bits").bitwiseAND(F.coalesce("further", F.lit(0).cast("bigint")))
        rows = rows.join(sized(further, requests), "word", "left").select(
            "urn", "word", "bits", going.alias("going"), F.lit(distance).alias("distance")
        )
        return cut_counted(rows, "reach", all=F.lit(True), going=F.col("going") != 0)

    level, n = placed(_in_words(seeds, numbered, requests), 0)
    seen, distance = Pile("reach"), 0
    seen.add(level, n["all"])
    while n["going"]:
        step = level.filter("going <> 0").select("urn", "word", F.col("going").alias("bits"))
        step = graph.up_hubs.spread(step, "urn", "slot")
        reached = (
            links.join(sized(step, n["going"] * graph.up_hubs.widest), ["urn", "slot"])
            .groupBy(F.col("downstream_urn").alias("urn"), "word")
            .agg(F.bit_or("bits").alias("bits"))
        )
        distance += 1
        level, n = placed(_unseen(reached, seen), distance)
        seen.add(level, n["all"])
    return _out_of_words(seen.all().drop("going"), numbered, requests).select("request_id", "urn", "distance")


def prerequisite_closure(targets: DataFrame, graph: LineageGraph) -> DataFrame:
    """Add unavailable upstream assets until nothing changes.

    Added rows have no distance and do not expand downstream again. Requests are
    bits of words, as in ``blast_radius``.
    """
    lost = graph.known_by_child.filter(F.col("up_availability") == "unavailable").select(
        F.col("downstream_urn").alias("urn"), F.col("down_slot").alias("slot"), "upstream_urn"
    )
    targets = cut(targets.select("request_id", "urn", "distance"), "closure")
    numbered, requests = _numbered(targets)
    frontier, n = cut_counted(_in_words(targets, numbered, requests), "closure", all=F.lit(True))
    found, added = Pile("closure"), Pile("added")
    found.add(frontier, n["all"])
    while n["all"]:
        step = graph.down_hubs.spread(frontier, "urn", "slot")
        pulled = (
            lost.join(sized(step, n["all"] * graph.down_hubs.widest), ["urn", "slot"])
            .groupBy(F.col("upstream_urn").alias("urn"), "word")
            .agg(F.bit_or("bits").alias("bits"))
        )
        frontier, n = cut_counted(_unseen(pulled, found), "closure", all=F.lit(True))
        if n["all"]:
            found.add(frontier, n["all"])
            added.add(frontier, n["all"])
    if not added.parts:
        return targets
    more = _out_of_words(added.all(), numbered, requests)
    return targets.unionByName(more.select("request_id", "urn", F.lit(None).cast("int").alias("distance")))


def target_parents(targets: DataFrame, graph: LineageGraph) -> DataFrame:
    """Every direct parent of every target with its role.

    ``dependency``: the parent is a target too; ``precondition``: it is healthy;
    ``unresolved``: it is neither.
    """
    at_child = graph.down_hubs.spread(targets.select("request_id", "urn"), "urn", "slot")
    parents = (
        graph.known_by_child.withColumnRenamed("downstream_urn", "urn")
        .withColumnRenamed("down_slot", "slot")
        .join(shuffled(at_child), ["urn", "slot"])
        .select("request_id", "urn", "upstream_urn", "up_slot", "up_availability")
    )
    at_parent = graph.up_hubs.spread(
        targets.select("request_id", F.col("urn").alias("upstream_urn"), F.lit(True).alias("hit")),
        "upstream_urn",
        "up_slot",
    )
    role = (
        F.when(F.col("hit"), "dependency")
        .when(F.col("up_availability") == "healthy", "precondition")
        .otherwise("unresolved")
    )
    return parents.join(shuffled(at_parent), ["request_id", "upstream_urn", "up_slot"], "left").select(
        "request_id", "urn", "upstream_urn", "up_slot", "up_availability", role.alias("role")
    )


def _own_key(best: Column, urn: Column) -> Column:
    """Order key of a node from the greatest key among its parents.

    Keep the parent's labels that exceed the node's own, then add the node.
    """
    kept = F.filter(F.coalesce(best, F.array().cast("array<string>")), lambda x: x > urn)
    return F.concat(kept, F.array(urn))


def _gather(parts: list[DataFrame], label: str) -> DataFrame:
    """All parts as one table; many parts are rewritten as one to keep plans short."""
    whole = union_all(parts)
    return whole if len(parts) <= 16 else cut(whole, label)


def _peel(
    nodes: DataFrame, arcs: DataFrame, hubs: Hubs, with_key: bool
) -> tuple[DataFrame | None, DataFrame, int]:
    """Remove nodes without incoming arcs, layer by layer.

    ``arcs`` has ``request_id, src, dst, slot``. Returns the peeled nodes with
    their ``wave`` and the nodes that can never be peeled. Only unfinished rows
    are rewritten in a round.
    """
    empty_key = F.lit(None).cast("array<string>")
    arity = arcs.groupBy("request_id", F.col("dst").alias("urn")).agg(
        F.count(F.lit(1)).alias("waiting")
    )
    sizes_of = {"ready": F.col("waiting") == 0, "left": F.col("waiting") > 0}
    state, sizes = cut_counted(
        nodes.select("request_id", "urn")
        .join(shuffled(arity), ["request_id", "urn"], "left")
        .select(
            "request_id", "urn", F.coalesce("waiting", F.lit(0)).alias("waiting"),
            empty_key.alias("best"),
        ),
        "peel",
        **sizes_of,
    )
    layers: list[DataFrame] = []
    while sizes["ready"]:
        ready = state.filter(F.col("waiting") == 0).withColumn("wave", F.lit(len(layers) + 1))
        if with_key:
            ready = ready.withColumn("order_key", _own_key(F.col("best"), F.col("urn")))
        layers.append(ready)
        waiting = state.filter(F.col("waiting") > 0)
        if sizes["left"] == 0:
            state = waiting
            break
        sent = ready.select(
            "request_id", F.col("urn").alias("src"),
            (F.col("order_key") if with_key else empty_key).alias("order_key"),
        )
        sent = hubs.spread(sent, "src", "slot")
        # A key made in wave k has at most k labels.
        labels = sizes["ready"] * hubs.widest * len(layers)
        got = (
            arcs.join(sized(sent, labels), ["request_id", "src", "slot"])
            .groupBy("request_id", F.col("dst").alias("urn"))
            .agg(F.count(F.lit(1)).alias("done"), F.max("order_key").alias("key"))
        )
        state, sizes = cut_counted(
            waiting.join(got, ["request_id", "urn"], "left").select(
                "request_id",
                "urn",
                (F.col("waiting") - F.coalesce("done", F.lit(0))).alias("waiting"),
                F.greatest("best", "key").alias("best"),
            ),
            "peel",
            **sizes_of,
        )
    peeled = _gather(layers, "peeled").drop("waiting", "best") if layers else None
    return peeled, state.select("request_id", "urn"), sizes["left"] if not sizes["ready"] else 0


def _arcs(parents: DataFrame, up: str, down: str, slot: Column) -> DataFrame:
    return parents.filter(F.col("role") == "dependency").select(
        "request_id", F.col(up).alias("src"), F.col(down).alias("dst"), slot.alias("slot")
    )


def _orderer() -> Callable[[pa.Table], pa.Table]:
    """Made here, so that it goes to the workers with the job."""

    def ordered(group: pa.Table) -> pa.Table:
        """Wave and place of every node of one request; both null for those that never get ready.

        Rows are nodes (``src`` null) and arcs. The least ready node is taken each time.
        """
        waiting, children, wave = {}, defaultdict(list), {}
        for src, dst in zip(group.column("src").to_pylist(), group.column("urn").to_pylist(), strict=True):
            waiting.setdefault(dst, 0)
            if src is not None:
                waiting[dst] += 1
                children[src].append(dst)
        ready = [urn for urn, n in waiting.items() if not n]
        heapq.heapify(ready)
        place = {}
        while ready:
            urn = heapq.heappop(ready)
            place[urn] = f"{len(place):010d}"
            wave.setdefault(urn, 1)
            for child in children[urn]:
                waiting[child] -= 1
                wave[child] = max(wave.get(child, 1), wave[urn] + 1)
                if not waiting[child]:
                    heapq.heappush(ready, child)
        urns = list(waiting)
        return pa.table(
            {
                "request_id": pa.array([group.column("request_id")[0].as_py()] * len(urns), pa.string()),
                "urn": pa.array(urns, pa.string()),
                "wave": pa.array([wave[u] if u in place else None for u in urns], pa.int32()),
                "order_key": pa.array([[place[u]] if u in place else None for u in urns], pa.list_(pa.string())),
            }
        )

    return ordered


def recovery_waves(
    targets: DataFrame, parents: DataFrame, graph: LineageGraph, limit: int = ONE_TASK_ROWS
) -> tuple[DataFrame, DataFrame, int]:
    """Waves (from 1) and exact order keys of acyclic targets, the stuck rest and its size.

    Sorting a request's targets by ``order_key`` gives the order a worker would
    take that always picks the ready asset with the least URN.

    A request with at most ``limit`` targets and dependencies, counted before, is
    ordered as a whole in one task, however deep it is; all such requests together
    are one job. Larger ones are peeled by layers, a round each: there a key is
    the greatest, over all paths to the asset, of the labels on the path that
    exceed everything after them, built from the parents' keys while peeling.
    """
    arcs = _arcs(parents, "upstream_urn", "urn", F.col("up_slot"))
    rows = targets.select("request_id", F.lit(None).cast("string").alias("src"), "urn").unionByName(
        arcs.select("request_id", "src", F.col("dst").alias("urn"))
    )
    large = rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    large, n = cut_counted(large.select("request_id"), "large", all=F.lit(True))
    whole = rows.join(sized(large, n["all"]), "request_id", "left_anti") if n["all"] else rows
    made, found = cut_counted(
        whole.groupBy("request_id").applyInArrow(
            _orderer(), "request_id string, urn string, wave int, order_key array<string>"
        ),
        "ordered",
        stuck=F.col("wave").isNull(),
    )
    waves, stuck, left = made.filter("wave IS NOT NULL"), made.filter("wave IS NULL").select("request_id", "urn"), found["stuck"]
    if not n["all"]:
        return waves, stuck, left
    deep_waves, deep_stuck, deep_left = _layered(
        targets.join(sized(large, n["all"]), "request_id", "left_semi"),
        arcs.join(sized(large, n["all"]), "request_id", "left_semi"),
        graph,
    )
    return waves.unionByName(deep_waves), stuck.unionByName(deep_stuck), left + deep_left


def _layered(targets: DataFrame, arcs: DataFrame, graph: LineageGraph) -> tuple[DataFrame, DataFrame, int]:
    waves, stuck, left = _peel(targets, arcs, graph.up_hubs, with_key=True)
    if waves is None:
        waves = targets.limit(0).select(
            "request_id", "urn", F.lit(0).alias("wave"),
            F.lit(None).cast("array<string>").alias("order_key"),
        )
    return waves.select("request_id", "urn", "wave", "order_key"), stuck, left


def cycle_core(stuck: DataFrame, parents: DataFrame, graph: LineageGraph) -> DataFrame:
    """Stuck nodes that lie on a cycle or between cycles, after peeling from below."""
    deps = parents.filter(F.col("role") == "dependency").select(
        "request_id", "upstream_urn", "urn", "up_slot"
    )
    ends = graph.up_hubs.spread(
        stuck.select("request_id", F.col("urn").alias("upstream_urn")), "upstream_urn", "up_slot"
    )
    inner = deps.join(shuffled(ends), ["request_id", "upstream_urn", "up_slot"], "left_semi").join(
        shuffled(stuck.select("request_id", "urn")), ["request_id", "urn"], "left_semi"
    )
    backwards = cut(
        graph.down_hubs.slot_of(
            inner.select("request_id", F.col("urn").alias("src"), F.col("upstream_urn").alias("dst")),
            "src", "dst", "slot",
        ),
        "backwards",
    )
    return _peel(stuck, backwards, graph.down_hubs, with_key=False)[1]


def one_cycle(core: DataFrame, parents: DataFrame, graph: LineageGraph) -> DataFrame:
    """One cycle of every request with a cyclic core, as rows ``request_id, pos, urn``.

    Every core node points to its least child in the core. Following the pointers
    ends in a cycle; pointer doubling finds its nodes, its least node (position 0)
    and each node's place in a logarithmic number of rounds.
    """
    deps = parents.filter(F.col("role") == "dependency").select(
        "request_id", "upstream_urn", "urn", "up_slot"
    )
    members, n = cut_counted(core.select("request_id", "urn"), "core", all=F.lit(True))
    heads = graph.up_hubs.spread(
        members.withColumnRenamed("urn", "upstream_urn"), "upstream_urn", "up_slot"
    )
    step = (
        deps.join(sized(heads, n["all"] * graph.up_hubs.widest), ["request_id", "upstream_urn", "up_slot"], "left_semi")
        .join(sized(members, n["all"]), ["request_id", "urn"], "left_semi")
        .groupBy("request_id", F.col("upstream_urn").alias("urn"))
        .agg(F.min("urn").alias("next"))
    )
    rounds = max(1, n["all"].bit_length())

    def doubled(jump: DataFrame, value: str, combine) -> DataFrame:
        """Square the pointers ``rounds`` times, folding ``value`` along the way."""
        for _ in range(rounds):
            far = jump.select(
                "request_id", F.col("urn").alias("next"), F.col("next").alias("_next"),
                F.col(value).alias("_value"),
            )
            jump = cut(
                jump.join(sized(far, n["all"]), ["request_id", "next"]).select(
                    "request_id", "urn", F.col("_next").alias("next"),
                    combine(F.col(value), F.col("_value")).alias(value),
                ),
                "jump",
            )
        return jump

    step = cut(step, "step")
    ends = doubled(step.withColumn("least", F.lit(0)), "least", lambda a, b: a)
    # After at least as many steps as there are nodes only cycle nodes are reached.
    on_cycle = ends.select("request_id", F.col("next").alias("urn")).distinct()
    loops = cut(step.join(sized(on_cycle, n["all"]), ["request_id", "urn"]), "loops")
    led = doubled(loops.withColumn("least", F.col("urn")), "least", F.least)
    chosen = led.groupBy("request_id").agg(F.min("least").alias("leader"))
    mine = led.select("request_id", "urn", F.col("least").alias("leader")).join(
        chosen, ["request_id", "leader"]
    )
    ring = cut(loops.join(sized(mine, n["all"]), ["request_id", "urn"]), "ring")
    # Cut the ring open at its leader and count the steps from each node to it.
    is_leader = F.col("urn") == F.col("leader")
    opened = ring.select(
        "request_id", "urn", F.when(is_leader, F.col("urn")).otherwise(F.col("next")).alias("next"),
        F.when(is_leader, 0).otherwise(1).cast("bigint").alias("steps"),
    )
    counted = doubled(opened, "steps", lambda a, b: a + b)
    size = counted.groupBy("request_id").agg(F.count(F.lit(1)).alias("size"))
    return counted.join(size, "request_id").select(
        "request_id", ((F.col("size") - F.col("steps")) % F.col("size")).alias("pos"), "urn"
    )
