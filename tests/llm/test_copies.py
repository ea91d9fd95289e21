"""Exact copies, near copies, repeated passages and components."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salvor.llm import exact_dedup, jaccard, substrings
from salvor.llm.components import components
from salvor.llm.fm_index import FMIndex
from tests.llm import brute


@pytest.fixture(scope="module")
def rows():
    return brute.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.table(spark, rows).repartition(5).cache()


def test_exact_groups(docs, rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, prefix_chars=4).collect()}
    assert got == want
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_repeated_rows_and_null_ids(spark):
    docs = brute.table(spark, [(3, "same"), (3, "same"), (1, "same"), (None, "lone"), (None, "twice"), (None, "twice"), (3, "other")])
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.exact_dedup(docs).collect()) == [(0, "lone"), (0, "twice"), (3, "other"), (3, "same")]


def test_exact_query_on_repeated_and_null_ids(spark, tmp_path):
    from salvor.llm.queries import op8_exact_dedup

    rows = [(2, "same"), (2, "same"), (1, "one"), (1, "other"), (None, "lone"), (None, "same"), (3, None)]
    brute.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id or 0, r.text_sha256, r.keep_id or 0, r.group_size, r.kept) for r in op8_exact_dedup(spark, str(tmp_path)).collect()))
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(2, "same", 2, 3, True), (2, "same", 2, 3, True), (1, "one", 1, 1, True), (1, "other", 1, 1, True), (0, "lone", 0, 1, True), (0, "same", 2, 3, False), (3, None, 3, 1, True)]
    assert got == sorted((i, digest(t), *rest) for i, t, *rest in want)


def test_exact_by_joins_that_shuffle(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "small", lambda df, n: df)
    assert exact_dedup.exact_dedup(docs).count() == len({t or "" for _, t in rows})


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard(docs, rows, k, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, num, den).collect()}
    assert got == brute.jaccard(rows, k, num, den)


def test_jaccard_chain_of_a_large_group(spark):
    """Each text differs from the one before by a few words: linked in a chain only."""
    rng = random.Random(3)
    text, rows = brute.prose(rng, 60, 10**6).split(), []
    for i in range(60):
        text[i % 60] = f"new{i}"
        rows.append((100 - i, " ".join(text)))
    want = brute.jaccard(rows, 3, 80, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(brute.table(spark, rows), 3, 80, 100).collect()}
    assert got == want


def test_repeats(docs, rows):
    for window in (35, 9):
        found = substrings.remove_repeats(docs, substrings.repeated_passages(docs, window, 4, 256), window)
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found.collect()}
        assert got == brute.repeats(rows, window)


@pytest.mark.parametrize("shard_words", [256, 1 << 20])
def test_repeats_with_null_and_repeated_ids(spark, shard_words):
    """Rows are judged one by one, whatever ids they share or lack."""
    rng = random.Random(12)
    passage = brute.prose(rng, 40, 10**6)
    own = [brute.prose(rng, n, 10**6) for n in (5, 10, 60, 30, 45)]
    texts = [(None, f"{own[0]} {passage}"), (1, f"{passage} {own[1]}"), (1, own[2]), (None, own[3]), (7, own[4]), (7, own[4]), (None, None), (1, f"{own[3]} {passage}")]
    found = substrings.remove_repeats(brute.table(spark, texts), substrings.repeated_passages(brute.table(spark, texts), shard_words=shard_words))
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found.collect())
    want = brute.repeats(list(enumerate(t for _, t in texts)), 35)
    assert got == sorted((i or 0, *want[place]) for place, (i, _) in enumerate(texts))
    assert sum(n for _, _, n, _ in got) == 3 * 40 + 2 * 45


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert jaccard.jaccard_components(none).count() == 0
    assert substrings.remove_repeats(none, substrings.repeated_passages(none)).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_matching_statistics():
    rng = np.random.default_rng(2)
    for symbols in (2, 5, 40):
        text = rng.integers(1, symbols + 1, 300)
        text[[80, 200, 299]] = 0
        found = FMIndex(text, symbols + 1, 9).matching_statistics(text, np.arange(300), 8)
        whole = text.tolist()
        for end in range(7, 300):
            if 0 in whole[max(0, end - 7) : end + 1]:
                continue
            best = 0
            for n in range(1, min(8, end + 1) + 1):
                part = whole[end - n + 1 : end + 1]
                if sum(whole[i : i + n] == part for i in range(300 - n + 1)) >= 2:
                    best = n
            assert found[end] == best


def test_null_ids_count_in_no_component(spark):
    docs = brute.table(spark, [(None, "a b c d e"), (4, "a b c d e"), (2, "a b c d e")])
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == [(0, None), (2, 2), (4, 2)]
    assert docs.where(F.col("doc_id").isNull()).count() == 1


def _link_counts(rows, k, num, den):
    """Per doc_id, with how many different texts its text links."""
    sets = {i: frozenset(brute.shingles(t or "", k)) for i, t in rows}
    kinds = [s for s in set(sets.values()) if s]
    counts = {a: sum(a is not b and len(a & b) * den >= len(a | b) * num for b in kinds) for a in kinds}
    return {i: counts.get(s, 0) for i, s in sets.items()}


def _near_copies(n, changed):
    """Copies of one text that differ in words of their own, so that few of them link."""
    rng = random.Random(n)
    base, rows = brute.prose(rng, 150, 10**6).split(), []
    for i in range(n):
        own = list(base)
        for place in rng.sample(range(150), changed):
            own[place] = f"own{i}x{place}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("blocks", [1024, 20])
def test_jaccard_of_copies_that_do_not_link(spark, monkeypatch, blocks):
    """A row is made for a pair only while pivots are compared; the rest goes block against block."""
    for name, value in (("BLOCK_NODES", blocks), ("LONG", 8), ("ROUNDS", 1), ("COLUMNS", 64)):
        monkeypatch.setattr(jaccard, name, value)
    pairs, plain = [], jaccard._overlapping
    monkeypatch.setattr(jaccard, "_overlapping", lambda p, s, n: pairs.append(n) or plain(p, s, n))
    seen = {}
    for n in (40, 120):
        rows = _near_copies(n, 3)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(brute.table(spark, rows), 5, 80, 100).collect()}
        links = _link_counts(rows, 5, 80, 100)
        assert got == {i: (*found, links[i]) for i, found in brute.jaccard(rows, 5, 80, 100).items()}
        seen[n] = sum(pairs)
        pairs.clear()
    assert seen[120] <= 4 * seen[40]


def test_spanning_links():
    rng = np.random.default_rng(4)
    one, two = rng.integers(0, 30, 200), rng.integers(0, 30, 200)
    kept = jaccard._spanning(one, two)
    parts = [set(p) for p in zip(one.tolist(), two.tolist(), strict=True)]

    def joined(pairs):
        out = []
        for pair in pairs:
            touched = [p for p in out if p & pair]
            out = [p for p in out if not p & pair] + [set.union(pair, *touched)]
        return sorted(map(sorted, (p for p in out if len(p) > 1)))

    assert joined(parts) == joined([parts[i] for i in kept])
    assert len(jaccard._spanning(one[:0], two[:0])) == 0


@pytest.mark.parametrize(("few", "block"), [(1, 4), (8, 1024), (100, 1024)])
def test_jaccard_counts_all_links(spark, docs, rows, monkeypatch, few, block):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_components(docs, 3, 80, 100).collect()}
    assert got == _link_counts(rows, 3, 80, 100)
    rng = random.Random(8)
    base = brute.prose(rng, 80).split()
    near = [(i, " ".join(f"new{rng.randrange(9)}x{i}" if rng.random() < 0.01 else w for w in base[: 80 - i % 5])) for i in range(60)]
    near += [(100 + i, near[i][1]) for i in range(0, 60, 7)] + [(200 + i, brute.prose(rng, 50)) for i in range(20)]
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_components(brute.table(spark, near), 3, 80, 100).collect()}
    want = _link_counts(near, 3, 80, 100)
    assert got == want and max(want.values()) >= 30


def test_jaccard_query_returns_links(spark, tmp_path):
    from salvor.llm.queries import op6_jaccard_join

    text = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*text, f"own{i}"])) for i in range(40)]
    brute.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op6_jaccard_join(spark, str(tmp_path)).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 39)}


def test_jaccard_writes_whole_sets_of_candidates_only(spark, monkeypatch):
    """Texts of 30 pieces, each shared with another text: most share prefix tokens, few need their whole sets."""
    rng, n = random.Random(21), 400
    texts = [[] for _ in range(n)]
    for _ in range(30):
        order = rng.sample(range(n), n)
        for i in range(0, n, 2):
            piece = brute.prose(rng, 3, 10**9)
            texts[order[i]].append(piece)
            texts[order[i + 1]].append(piece)
    rows = [(i, " ".join(parts)) for i, parts in enumerate(texts)] + [(n, " ".join(texts[0]) + " more")]
    written, cut = collections.Counter(), jaccard.cut

    def counted(df, label):
        table = cut(df, label)
        written[label] += table.count()
        return table

    monkeypatch.setattr(jaccard, "cut", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(brute.table(spark, rows), k=1, count=False).collect()}
    assert got == brute.jaccard(rows, 1, 90, 100)
    assert written["prefixes"] > n / 2
    assert 2 <= written["sets"] < n / 2


def test_jaccard_deals_prefixes_by_token_once(spark, tmp_path, monkeypatch):
    """The sums by token and the join with them read one exchange."""
    rows = [(i, 20, [j * (i % 3) for j in range(3)]) for i in range(30)]
    spark.createDataFrame(rows, "node long, n long, p0 array<long>").write.parquet(f"{tmp_path}/p0")
    plans, cut = [], jaccard.cut

    def explained(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, label)

    monkeypatch.setattr(jaccard, "cut", explained)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        jaccard._shared(spark.read.parquet(f"{tmp_path}/p0"), "p0", 90, 100)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert plans[0].count("ReusedExchange") == 1


def test_jaccard_keeps_texts_of_pairs_not_their_sets(spark, monkeypatch):
    """What is written for the comparison of pairs holds the texts, which are smaller."""
    rng = random.Random(5)
    text = brute.prose(rng, 100, 10**6)
    rows = [(0, text), (1, text + " more"), (2, text + " more words"), (3, brute.prose(rng, 100, 10**6)), (4, None)]
    columns, cut = {}, jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, label: columns.setdefault(label, df.columns) and cut(df, label))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(brute.table(spark, rows), count=False).collect()}
    assert got == brute.jaccard(rows, 3, 90, 100)
    assert columns["sets"] == ["node", "text"]


def test_components_of_stars_need_no_round(spark, monkeypatch):
    from salvor.llm import components as module

    written, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, label: written.append(label) or cut(df, label))
    stars = spark.createDataFrame([(1, 5), (6, 1), (2, 9), (3, 3)], "a long, b long")
    assert sorted(map(tuple, components(stars).collect())) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)]
    assert not written
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(41)}
    assert 0 < len(written) <= 8
