"""N-gram Jaccard join filtered by prefixes under several global token orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvor.llm.components import components
from salvor.llm.words import list_array, mix, pieces, shingle_sets, signed, unsigned, words_of
from salvor.runtime import cut, cut_counted, release, small

SKETCH_BITS = 18
SLICES = 64
# The further orders are those of two scrambled hashes; the first is by frequency.
ORDERS = 2
# Pivots of a list in the first round, how many times more in each next one, and after how
# many rounds the lists longer than LONG are compared block against block.
PIVOTS, MORE, ROUNDS, LONG = 4, 16, 1, 64
# Nodes and shingles of a block, about, and columns of a product at a time.
BLOCK_NODES, BLOCK_GRAMS, COLUMNS = 1024, 1 << 20, 4096
# Components of so many classes or fewer are compared as rows of pairs when links are counted.
FEW = 8


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, raw, at in pieces(texts):
        yield from shingle_sets(words_of(raw, at, lower=True), len(at) - 1, k)


def frequency_sketch(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many (document, shingle) pairs fall in each of 2**bits hash buckets.

    Any function of a shingle gives a valid global order; this one puts shingles
    that many documents share last. Its size does not grow with the data.
    """
    width = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.int64)
        for batch in batches:
            held = [np.zeros(0, np.uint64)]
            for found in _sets(batch.column("text"), k):
                held.append(found)
                if len(held) == 1024:
                    seen += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                    held = [np.zeros(0, np.uint64)]
            seen += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        parts = [seen[i * width : (i + 1) * width].tobytes() for i in range(SLICES)]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array(parts, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slice_, part in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[slice_] = sums.get(slice_, 0) + np.frombuffer(part, np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    kind = "slice int, counts binary"
    parts = docs.select("text").mapInArrow(count, kind).repartition(SLICES, "slice").mapInArrow(add, kind)
    out = np.zeros(1 << bits, np.int64)
    for row in parts.collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    return out


def _prefix_length(n: int, num: int, den: int) -> int:
    """A set of n and one with Jaccard num/den or more share one of its first that many."""
    return n - (n * num + den - 1) // den + 1


def signatures(docs: DataFrame, k: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, n, digest and the prefix p0 of each text's shingle set in the order by frequency."""
    shift = np.uint64(64 - int(len(sketch)).bit_length() + 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, prefixes = [], [], []
            for found in _sets(batch.column("text"), k):
                n = len(found)
                sizes.append(n)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                order = np.lexsort((found, sketch[(found >> shift).astype(np.int64)]))
                prefixes.append(signed(found[order[: _prefix_length(n, num, den) if n else 0]]))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), list_array(prefixes)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "p0"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, digest binary, p0 array<long>")


def _scrambled_prefix(found: np.ndarray, most: int, order: int) -> np.ndarray:
    """The first tokens of a set in one of the scrambled orders."""
    keys = mix(found, 31 + order)
    low = np.argpartition(keys, most - 1)[:most] if 0 < most < len(found) else np.arange(most)
    return signed(found[low[np.argsort(keys[low])]])


def other_prefixes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node, n and its prefixes p1, p2 in the orders of scrambled hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prefixes = [], [[] for _ in range(ORDERS)]
            for found in _sets(batch.column("text"), k):
                n = len(found)
                most = _prefix_length(n, num, den) if n else 0
                sizes.append(n)
                for i in range(ORDERS):
                    prefixes[i].append(_scrambled_prefix(found, most, i))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), *map(list_array, prefixes)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", *(f"p{i + 1}" for i in range(ORDERS))])

    return docs.mapInArrow(sign, "node long, n long, " + ", ".join(f"p{i + 1} array<long>" for i in range(ORDERS)))


def _linked(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, grams_a, grams_b) whose sets really are that similar.

    A column expression, so that long sets go through one pair at a time.
    """
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    sized = pairs.select("a", "b", both.alias("both"), (F.size("grams_a") + F.size("grams_b")).alias("all"))
    return sized.where((F.col("both") > 0) & (F.col("both") * (den + num) >= F.col("all") * num)).select("a", "b")


def _linked_texts(pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose sets really are that similar; a text takes less room than its set."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, two in zip(_sets(batch.column("text_a"), k), _sets(batch.column("text_b"), k), strict=True):
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(both > 0 and both * (den + num) >= (len(one) + len(two)) * num)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def _shared(rows: DataFrame, name: str, num: int, den: int) -> DataFrame:
    """(token, node, n, pos) of prefix ``name`` for tokens that several nodes have.

    What two sets have in common cannot come before their first shared token, so
    a row at place ``pos`` of n tokens leads to an overlap of n - pos at most. Rows
    that could not link even with the smallest set of the token's list are left out,
    and those larger than any set that a row of the list could link with.
    """
    spark = rows.sparkSession
    # Dealt by token once: Spark shuffles them again for the join unless the sums need the same columns
    # of the same rows; the join alone would leave out nulls (there are none) before the shuffle.
    lists = rows.where("node is not null and n is not null").select("node", "n", F.posexplode(name).alias("pos", "token"))
    lists = lists.where("token is not null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token")
    reach = (F.col("n") - F.col("pos")) * (num + den) - F.col("n") * num
    several = lists.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.min("n").alias("least_n"), F.max(reach).alias("reach")).where("least < most")
    other = F.greatest(F.col("least_n") * den, F.col("n") * num)
    enough = (F.col("n") - F.col("pos")) * (num + den) * den >= num * (F.col("n") * den + other)
    enough = enough & (F.col("n") * num <= F.col("reach"))
    kept = cut(lists.join(several.select("token", "least_n", "reach"), "token").where(enough).select("token", "node", "n", "pos"), "lists")
    several = kept.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("token")
    shared = cut(kept.join(several, "token", "left_semi"), "lists")
    release(kept)
    return shared


def _of(table: DataFrame, ids: DataFrame, rows: int, column: str = "node") -> DataFrame:
    """The rows of ``table`` whose id is among the (counted, distinct) ids."""
    return table.join(small(ids.select(F.col("node").alias(column)), rows), column, "left_semi")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs``.

    Two texts link when the Jaccard similarity of their sets of k-word shingles
    is num/den or more. component_id is the smallest doc_id reachable by links.
    n_links counts the other classes that the row's class links with, all of them;
    without ``count`` the column is left out.

    1. Texts with equal sets form a class; only one of each goes on.
    2. Under each of three global orders (by a frequency sketch, and two
       scrambled hashes) linked sets share one of their first tokens, early
       enough to leave room for the overlap. A class goes on only if it shares
       tokens with others under the first order, and then under the second.
    3. For every token of the first order, pivots are compared with the token's
       other classes that are of similar size, can still have the overlap behind
       the token, and are not yet in the same component;
       pairs must also share prefix tokens under the other orders, and then
       their whole sets are compared. Each round has sixteen times as many pivots
       in a list (chosen per hash bucket) and all pivots leave their list.
       After a round the components of all links found so far are worked out, and
       lists within one component end. So a large group of copies costs a few
       comparisons per copy, not one per pair.
    4. Lists that are still long after ``ROUNDS`` rounds hold many texts that do
       not link though they share much. They are compared in pairs of blocks, with
       the same filters, as products of incidence matrices: no row is made per
       pair, and of the links of a block pair only those that join components.
    5. Links are counted in the end, inside the components, in the same way; only
       sums per class are written.

    Null and empty texts have an empty set and link with nothing; a text of
    fewer than k words has one shingle, its whole sequence. A row with a null
    doc_id counts in no component (component_id null). Rows that repeat a doc_id
    are one node. Other columns are not read. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = cut(signatures(texts, k, num, den, frequency_sketch(docs, k)), "signatures")
    signed_docs = cut(made.select("doc_id", "n", "digest"), "signatures")
    classes = signed_docs.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    classes = cut(classes, "classes")
    first = made.select(F.col("doc_id").alias("node"), "n", "digest", "p0").join(classes, ["digest", "node"], "left_semi")
    lists = _shared(first, "p0", num, den)
    release(made)
    alive, found = cut_counted(lists.select("node").distinct(), "alive", rows=F.lit(True))
    signs = cut(other_prefixes(_of(texts, alive, found["rows"], "doc_id"), k, num, den), "prefixes")
    shared = _shared(signs, "p1", num, den)
    alive, found = cut_counted(shared.select("node").distinct(), "alive", rows=F.lit(True))
    release(shared)
    old, (lists, found) = lists, cut_counted(_of(lists, alive, found["rows"]), "lists", rows=F.lit(True))
    release(old)

    links, pivots, turn = None, PIVOTS, 0
    lists = lists.withColumn("label", F.col("node"))
    while found["rows"]:
        # A pivot is the first of the nodes of its list that share a hash bucket.
        bucket = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots))
        chosen = lists.groupBy("token", bucket.alias("bucket")).agg(F.min_by(F.struct("node", "n", "pos", "label"), F.struct(F.xxhash64("node"), "node")).alias("pivot"))
        chosen = cut(chosen.select("token", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.pos").alias("pivot_pos"), F.col("pivot.label").alias("pivot_label")), "pivots")
        overlap = F.least(F.col("n") - F.col("pos"), F.col("pivot_n") - F.col("pivot_pos"))
        near = (overlap * (num + den) >= (F.col("n") + F.col("pivot_n")) * num) & (F.least("n", "pivot_n") * den >= F.greatest("n", "pivot_n") * num)
        near = near & (F.col("label") != F.col("pivot_label")) & (F.col("node") != F.col("pivot"))
        pairs = lists.join(chosen, "token").where(near).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        pairs, seen = cut_counted(pairs, "pairs", rows=F.lit(True))
        close, seen = cut_counted(_overlapping(pairs, signs, seen["rows"]), "pairs", rows=F.lit(True))
        whole = _texts_of(texts, close.select(F.explode(F.array("a", "b")).alias("node")))
        new = _linked_texts(_with_both(close, whole, seen["rows"], ["text"]), k, num, den)
        links, roots, named = _joined(links, new)
        rest = lists.join(chosen.select("token", F.col("pivot").alias("node")), ["token", "node"], "left_anti")
        old, (lists, found) = lists, _unsettled(rest, roots, named)
        release(old, chosen, pairs, close, whole)
        pivots, turn = pivots * MORE, turn + 1
        if turn == ROUNDS and found["rows"]:
            sizes = lists.groupBy("token").agg(F.count("*").alias("size"), F.sum("n").alias("grams")).where(F.col("size") > LONG)
            sizes, long = cut_counted(sizes, "long", rows=F.lit(True))
            if long["rows"]:
                links, roots, named = _joined(links, _long_links(lists, found["rows"], sizes, long["rows"], texts, k, num, den))
                rest = lists.join(small(sizes.select("token"), long["rows"]), "token", "left_anti")
                old, (lists, found) = lists, _unsettled(rest, roots, named)
                release(old)
    release(signs)
    return _results(signed_docs, classes, links, texts if count else None, k, num, den)


def _joined(links: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Links that hold all components found so far together, the components, and the number of their nodes.

    Of links inside a component only one from each node to the root is kept.
    """
    roots, named = cut_counted(components(new if links is None else links.unionByName(new)), "roots", rows=F.lit(True))
    return roots.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")), roots, named["rows"]


def _unsettled(lists: DataFrame, roots: DataFrame, rows: int) -> tuple[DataFrame, dict[str, int]]:
    """The lists with new labels, without those inside one component."""
    named = roots.select(F.col("id").alias("node"), F.col("root").alias("label"))
    lists = lists.drop("label").join(small(named, rows), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = lists.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("token")
    return cut_counted(lists.select("token", "node", "n", "pos", "label").join(mixed, "token", "left_semi"), "lists", rows=F.lit(True))


def _blocks(size: Column, grams: Column) -> Column:
    return F.ceil(F.greatest(size / BLOCK_NODES, grams / BLOCK_GRAMS, F.lit(1))).cast("int")


def _in_blocks(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Rows of (group, node, blocks) once for each pair (i, j) of the group's blocks that theirs is in."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("node", group), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", *columns)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of block i and those of block j; the same ones in a block with itself."""
    block = group.column("block").to_numpy()
    return np.flatnonzero(block == group.column("i")[0].as_py()), np.flatnonzero(block == group.column("j")[0].as_py())


def _similar(group: pa.Table, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    both, n = _common(group.column("grams"), left, right), _lengths(group.column("grams"))
    return (both > 0) & (both * (den + num) >= (n[left][:, None] + n[right]) * num)


def _long_links(lists: DataFrame, places: int, sizes: DataFrame, rows: int, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between nodes of long lists that connect what all links of the lists connect."""
    long = lists.join(small(sizes, rows), "token").withColumn("blocks", _blocks(F.col("size"), F.col("grams")))
    long = cut(long.select("token", "node", "label", "blocks"), "long")
    sets = _sets_of(texts, long, k)

    def compare(group: pa.Table) -> pa.Table:
        left, right = _sides(group)
        label, node = group.column("label").to_numpy(), group.column("node").to_numpy()
        linked = label[left][:, None] != label[right]
        found = [unsigned(np.asarray(x.values)) for x in group.column("grams")]
        for i in range(ORDERS):
            if linked.any():
                prefixes = list_array([_scrambled_prefix(x, _prefix_length(len(x), num, den), i) for x in found])
                linked &= _common(pa.chunked_array([prefixes]), left, right) > 0
        if linked.any():
            linked &= _similar(group, left, right, num, den)
        one, two = np.nonzero(linked)
        tied = _spanning(label[left][one], label[right][two])
        return pa.table({"a": node[left][one[tied]], "b": node[right][two[tied]]})

    placed = _in_blocks(sets.join(small(long, places), "node"), "token", ["label", "grams"])
    links = cut(placed.groupBy("token", "i", "j").applyInArrow(compare, "a long, b long"), "links")
    release(long, sets)
    return links


def _spanning(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Places of edges (one, two) that connect whatever all the edges connect, without a cycle."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first = np.unique(np.stack([one, two]), axis=1, return_index=True)[1] if len(one) else np.zeros(0, np.int64)
    kept = []
    for place in np.sort(first).tolist():
        a, b = find(int(one[place])), find(int(two[place]))
        if a != b:
            root[a] = b
            kept.append(place)
    return np.array(kept, np.int64)


def _degrees(members: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, n_links) of members (node, root): how many others a node is really linked with.

    Links lie inside components only. Those of few classes are compared as rows of
    pairs, larger ones block against block, and only sums per node are written.
    """
    members, found = cut_counted(members, "members", rows=F.lit(True))
    rows = _sets_of(texts, members, k).join(small(members, found["rows"]), "node").withColumn("n", F.size("grams"))
    sizes = rows.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
    sizes, found = cut_counted(sizes, "sizes", rows=F.lit(True), large=F.col("size") > FEW)
    rows = rows.join(small(sizes, found["rows"]), "root")
    few = rows.where(F.col("size") <= FEW)
    pairs = few.select("root", F.col("node").alias("a"), F.col("grams").alias("grams_a")).join(few.select("root", F.col("node").alias("b"), F.col("grams").alias("grams_b")), "root").where("a < b")
    ends = _linked(pairs, num, den).select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n_links"))

    def count(group: pa.Table) -> pa.Table:
        left, right = _sides(group)
        linked = _similar(group, left, right, num, den)
        sums = np.zeros(group.num_rows, np.int64)
        if group.column("i")[0] == group.column("j")[0]:
            np.fill_diagonal(linked, False)
            sums[left] = linked.sum(axis=1)
        else:
            sums[left], sums[right] = linked.sum(axis=1), linked.sum(axis=0)
        some = np.flatnonzero(sums)
        return pa.table({"node": group.column("node").take(pa.array(some)), "n_links": pa.array(sums[some])})

    if found["large"]:
        large = rows.where(F.col("size") > FEW).withColumn("blocks", _blocks(F.col("size"), F.col("total")))
        ends = ends.unionByName(_in_blocks(large.select("root", "node", "blocks", "grams"), "root", ["grams"]).groupBy("root", "i", "j").applyInArrow(count, "node long, n_links long"))
    return cut(ends.groupBy("node").agg(F.sum("n_links").alias("n_links")), "degrees")


def _lengths(lists: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy().astype(np.int64)


def _common(lists: pa.ChunkedArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each list of the left has in common with each of the right; values of a list are distinct."""
    owner = np.repeat(np.arange(len(lists)), _lengths(lists))
    values = pc.list_flatten(lists).to_numpy()
    _, which, uses = np.unique(values, return_inverse=True, return_counts=True)
    owner, which = owner[uses[which] > 1], which[uses[which] > 1]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], np.unique(which[order], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int(which[-1]) + 1 if len(which) else 0, COLUMNS):
        part = slice(*np.searchsorted(which, [low, low + COLUMNS]))
        there = np.zeros((len(lists), COLUMNS), np.float32)
        there[owner[part], which[part] - low] = 1
        out += (there[left] @ there[right].T).astype(np.int64)
    return out


def _with_both(pairs: DataFrame, table: DataFrame, rows: int, names: list[str]) -> DataFrame:
    """Pairs (a, b) with columns of both; of ``table`` only the pairs' ids are moved."""
    one = table.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in names)).join(small(pairs, rows), "a")
    two = table.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in names))
    two = two.join(small(pairs.select("b"), rows), "b", "left_semi")
    return one.join(two, "b")


def _overlapping(pairs: DataFrame, signs: DataFrame, rows: int) -> DataFrame:
    """The pairs that share prefix tokens under all other orders."""
    joined = _with_both(pairs, signs, rows, [f"p{i + 1}" for i in range(ORDERS)])
    for i in range(ORDERS):
        joined = joined.where(F.arrays_overlap(f"p{i + 1}_a", f"p{i + 1}_b"))
    return joined.select("a", "b").distinct()


def _stored_sets(texts: DataFrame, k: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(s) for s in _sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(found)], ["node", "grams"])

    return texts.mapInArrow(make, "node long, grams array<long>")


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and the text that its whole set is made of, written for the given nodes only."""
    nodes, found = cut_counted(nodes.distinct(), "nodes", rows=F.lit(True))
    whole = cut(_of(texts, nodes, found["rows"], "doc_id").select(F.col("doc_id").alias("node"), "text"), "sets")
    release(nodes)
    return whole


def _sets_of(texts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and its whole set, written for the given nodes only: all sets take more room than the texts."""
    nodes, found = cut_counted(nodes.select("node").distinct(), "nodes", rows=F.lit(True))
    sets = cut(_stored_sets(_of(texts, nodes, found["rows"], "doc_id"), k), "sets")
    release(nodes)
    return sets


def _results(signed_docs: DataFrame, classes: DataFrame, links: DataFrame | None, texts: DataFrame | None, k: int, num: int, den: int) -> DataFrame:
    """Every row with its component, and with its number of links where ``texts`` are given."""
    rows = signed_docs.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    counts = [] if texts is None else ["n_links"]
    none = F.lit(0).cast("long").alias("n_links")
    if links is None:
        classes = classes.select("digest", "node", F.col("node").alias("root"), none)
    else:
        roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        classes = classes.join(roots, "node", "left").select("digest", "node", F.coalesce("root", "node").alias("root"))
        if texts is not None:
            degrees = _degrees(roots, texts, k, num, den)
            classes = classes.join(degrees, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    classes, found = cut_counted(classes.drop("node"), "classes", rows=F.lit(True))
    linked = F.col("n_shingles") > 0
    alone = rows.where(~linked).withColumn("n_links", none).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *counts)
    found = rows.where(linked).join(small(classes, found["rows"]), "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("root"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), *counts).unionByName(alone)
