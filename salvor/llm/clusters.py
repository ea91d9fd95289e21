"""Exact k-means on integer vectors, rescanning only where heap-ordered bounds expire."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvor.runtime import cut, cut_bucketed, cut_counted

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
# Vectors that share one set of heaps.
BLOCK = 1024
# Components are held to this range, so that squared distances fit in 64 bits.
LARGEST = 1 << 26
# Bounds are kept apart by this share of their size, more than rounding can take away.
SLACK = 1e-9


class Heaps(NamedTuple):
    """The members of a block's clusters, cluster after cluster, each part a heap by ``key``.

    A member's key is its gap (distance to the second nearest centroid less that to
    its own) plus the drift its cluster had accumulated when the gap was measured.
    The gap is used up when the cluster's drift reaches the key.
    """

    member: np.ndarray
    key: np.ndarray
    ends: np.ndarray


def integer_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components of vectors that are whole; all others are left out."""
    whole = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))

    def part(x: Column) -> Column:
        # Held within the range before it becomes an integer.
        scaled = F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * scale))
        return F.floor(scaled).cast("int")

    return rows.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", part).alias("parts"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the least hash of their id; null ids come last."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(order.alias("order"), "parts").orderBy(F.asc_nulls_last("order"), "parts").limit(k).collect()
    return np.array([r["parts"] for r in rows], np.int64)


def _blocks(vectors: DataFrame, dimensions: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), BLOCK):
                part = batch.slice(low, BLOCK)
                matrix = part.column("parts").flatten().to_numpy().astype(np.int32)
                small = np.abs(matrix).max(initial=0) < 1 << 15
                raw = (matrix.astype(np.int16) if small else matrix).tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("vec_id"))
                yield pa.RecordBatch.from_arrays([part.column("at").slice(0, 1), ids, pa.array([raw], pa.binary())], ["block", "vec_ids", "matrix"])

    numbered = vectors.select(F.monotonically_increasing_id().alias("at"), "vec_id", "parts")
    return numbered.mapInArrow(pack, "block long, vec_ids array<long>, matrix binary")


def _matrix(raw: bytes, n: int, dimensions: int) -> np.ndarray:
    kind = np.int16 if len(raw) == 2 * n * dimensions else np.int32
    return np.frombuffer(raw, kind).reshape(n, dimensions).astype(np.int64)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (vectors**2).sum(axis=1)[:, None] - 2 * (vectors @ centroids.T) + (centroids**2).sum(axis=1)


def rescan(vectors: np.ndarray, heaps: Heaps | None, centroids: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray, np.ndarray]:
    """New heaps; the rows rescanned, their old clusters (-1: none) and their new ones.

    Members whose key the drift of their cluster has reached are popped and
    compared with all centroids; all others stay where they are unseen.
    """
    k = len(centroids)
    if heaps is None:
        piles = [[] for _ in range(k)]
        rows, old = np.arange(len(vectors)), np.full(len(vectors), -1)
    else:
        first = np.concatenate([[0], heaps.ends[:-1]])
        piles = [list(zip(heaps.key[a:b].tolist(), heaps.member[a:b].tolist(), strict=True)) for a, b in zip(first, heaps.ends, strict=True)]
        popped = []
        for j, pile in enumerate(piles):
            while pile and pile[0][0] <= drift[j]:
                popped.append((heapq.heappop(pile)[1], j))
        rows, old = (np.array([p[i] for p in popped], np.int64) for i in (0, 1))
    square = squared_distances(vectors[rows], centroids)
    new = square.argmin(axis=1) if k else old
    near = np.sqrt(square[np.arange(len(rows)), new].astype(float))
    far = np.full(len(rows), np.inf)
    if k > 1:
        others = square.copy()
        others[np.arange(len(rows)), new] = np.iinfo(np.int64).max
        far = np.sqrt(others.min(axis=1).astype(float))
    key = far - near - SLACK * (near + np.where(np.isinf(far), 0, far) + 1) + drift[new]
    for value, row, j in zip(key.tolist(), rows.tolist(), new.tolist(), strict=True):
        heapq.heappush(piles[j], (value, row))
    flat = [x for pile in piles for x in pile]
    ends = np.cumsum([len(pile) for pile in piles])
    return Heaps(np.array([x[1] for x in flat], np.int32), np.array([x[0] for x in flat], float), ends.astype(np.int32)), rows, old, new


def _assign(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, drift: np.ndarray, dimensions: int) -> DataFrame:
    """block, its heaps, how many rows were rescanned, and by how much sums and counts change."""
    k = len(centroids)
    names, begun = ["member", "key", "ends"], state is not None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = len(batch.column("vec_ids")[i].values)
                vectors = _matrix(batch.column("matrix")[i].as_py(), n, dimensions)
                heaps = None
                if begun:
                    heaps = Heaps(*(np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in zip(names, (np.int32, float, np.int32), strict=True)))
                heaps, rows, old, new = rescan(vectors, heaps, centroids, drift)
                change = np.zeros((k, dimensions + 1), np.int64)
                moved = old != new
                whole = np.column_stack([vectors[rows[moved]], np.ones(moved.sum(), np.int64)])
                np.add.at(change, new[moved], whole)
                known = old[moved] >= 0
                np.add.at(change, old[moved][known], -whole[known])
                changes = change.ravel() if moved.any() else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array([0, len(changes)], pa.int32()), pa.array(changes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(i, 1), *(pa.array([x.tobytes()], pa.binary()) for x in heaps), pa.array([len(rows)], pa.int64()), lists],
                    ["block", *names, "rescanned", "change"],
                )

    found = blocks.join(state.select("block", *names), "block") if begun else blocks
    return cut(found.mapInArrow(step, "block long, member binary, key binary, ends binary, rescanned long, change array<long>"), "heaps")


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much the gaps of each cluster's members may have shrunk: its own way and the longest of the others."""
    way = np.sqrt(((new - old) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
    longest = np.sort(way)[::-1]
    other = np.where(way == longest[0], longest[1] if len(way) > 1 else 0.0, longest[0]) if len(way) else way
    return way + other


def cluster_vectors(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) of every whole vector, the centroids, and how many vectors each round rescanned.

    Vectors with another number of components, or with one that is null or not
    finite, are left out; each component x becomes floor(scale * x), held to
    +-2**26. Centroids start as the vectors with the least hash of ``1:<vec_id>``.
    In each round every vector goes to the nearest centroid (squared distance,
    ties to the smaller number), and centroids that have vectors become the floor
    of their mean. Then vectors are assigned once more.

    Vectors lie in blocks. Every cluster has a heap in each block, ordered by the
    gap between the distance to the second nearest centroid and to the own one,
    offset by the drift that the cluster had accumulated when it was measured.
    Moving centroids only add to that drift; vectors whose gap it reaches are
    popped, compared with all centroids exactly, and pushed again. All others keep
    their cluster without being looked at. Only sums of moved vectors are added
    up; the driver holds k centroids. Heaps are a small table of their own, so
    vectors are written once and do not move.

    Rows that repeat count each; rows with a null vec_id are clustered too, and
    start no cluster while others can. Fewer than k vectors give as many
    clusters. Other columns are not read. An empty table gives no rows.
    """
    vectors, found = cut_counted(integer_vectors(rows, dimensions, scale), "vectors", rows=F.lit(True))
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        empty = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return empty, np.zeros((0, dimensions), np.int64), []
    blocks = cut_bucketed(_blocks(vectors, dimensions), "blocks", ["block"], 4 * found["rows"])
    drift, totals, state, rescanned = np.zeros(len(centroids)), np.zeros(len(centroids) * (dimensions + 1), np.int64), None, []
    for turn in range(rounds + 1):
        state = _assign(blocks, state, centroids, drift, dimensions)
        rescanned.append(state.agg(F.sum("rescanned")).first()[0])
        if turn == rounds:
            break
        changes = state.select(F.posexplode("change").alias("pos", "value")).where("value <> 0").groupBy("pos").agg(F.sum("value").alias("value"))
        for row in changes.collect():
            totals[row["pos"]] += row["value"]
        sums = totals.reshape(len(centroids), dimensions + 1)
        some = sums[:, -1] > 0
        new = centroids.copy()
        new[some] = sums[some, :-1] // sums[some, -1:]
        drift = drift + drifts(centroids, new)
        centroids = new
    return _members(blocks, state, centroids, dimensions), centroids, rescanned


def _members(blocks: DataFrame, state: DataFrame, centroids: np.ndarray, dimensions: int) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column("vec_ids")[i].values
                vectors = _matrix(batch.column("matrix")[i].as_py(), len(ids), dimensions)
                member, ends = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("member", "ends"))
                cluster = np.zeros(len(ids), np.int32)
                cluster[member] = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
                distance = ((vectors - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    joined = blocks.join(state.select("block", "member", "ends"), "block")
    return cut(joined.mapInArrow(unpack, "vec_id long, cluster int, distance long"), "members")


def with_inertia(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (sums of distance by cluster and over all, null beyond 64 bits) and centroid_sha256."""
    sums = {r["cluster"]: r["n"] for r in members.groupBy("cluster").agg(F.try_sum("distance").alias("n")).collect()}
    whole = None if None in sums.values() else sum(sums.values())
    whole = whole if whole is None or whole < 1 << 63 else None
    names = [",".join(map(str, c)) for c in centroids.tolist()]
    rows = [(i, n, whole, names[i]) for i, n in sorted(sums.items())]
    table = members.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, parts string")
    table = table.select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("parts").cast("binary"), 256).alias("centroid_sha256"))
    # One row per cluster.
    return members.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
