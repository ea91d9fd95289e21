"""Language, toxicity, suffix tree, licences and decontamination."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from salvor.llm import decontamination, language, licenses, suffix_tree, toxicity, words
from salvor.llm.words import fold_of, words_of
from tests.llm import brute

DATA = "/root/testdata/sf0.01"


def test_fold_is_crc32(spark):
    got = {r.doc_id: r.fold for r in spark.range(50).select(F.col("id").alias("doc_id"), fold_of(F.col("id")).alias("fold")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


def test_language(spark):
    rng = random.Random(4)
    words = {"aa": ["tion", "the", "ing", "and"], "bb": ["keit", "und", "\u00fcber", "sch"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    extra = [(900, None, "aa"), (901, "", None), (902, "12 ?!", "bb"), (903, "und " * 30000, None), (904, "\u4e2d\u6587", None), (905, "THE AND", None), (905, "THE AND", None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    model = language.fit_languages(docs.where("doc_id >= 20"))
    got = [(r.doc_id, r.nearest, r.score, r.lang, r.rejected) for r in language.predict_languages(docs.withColumn("nearest", F.lit("x")), model).collect()]
    assert len(got) == 87
    found = {d: (n, s, lang, far) for d, n, s, lang, far in got}
    assert all(found[i][0] == lang for i, _, lang in rows)
    assert [found[i][:2] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert found[903][0] == "bb"
    assert found[905][0] == "aa"
    assert found[904][2] == "und" and found[904][3]
    assert all(0 <= s <= 1 for _, s, _, _ in found.values())
    assert language.predict_languages(docs.limit(0), model).count() == 0
    assert language.fit_languages(docs.limit(0)) is None
    assert {r.nearest for r in language.predict_languages(docs, None).collect()} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit_languages(docs.where(fold_of(F.col("doc_id")) != 0))
    found = language.predict_languages(docs.where(fold_of(F.col("doc_id")) == 0), model).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id")
    assert found.select(F.avg((F.col("nearest") == F.col("true")).cast("int"))).first()[0] > 0.98


@pytest.fixture(scope="module")
def scorer(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit_toxicity(toxicity.labelled(docs, labels.where(fold_of(F.col("doc_id")) != 0)))


def test_toxicity_held_out(spark, scorer):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score_toxicity(docs, scorer).join(labels.where(fold_of(F.col("doc_id")) == 0), "doc_id").collect()
    good = [r.score for r in found if r.toxic == 1]
    bad = [r.score for r in found if r.toxic == 0]
    better = sum((g > b) + (g == b) / 2 for g in good for b in bad) / max(1, len(good) * len(bad))
    assert better > 0.9
    assert sum(b >= 0.5 for b in bad) <= 0.05 * len(bad)


def test_toxicity_edges(spark, scorer):
    rows = [(1, None), (2, ""), (3, "x" * 50000), (4, "you idiot you moron"), (4, "you idiot you moron"), (5, "1d!ot")]
    got = toxicity.score_toxicity(brute.table(spark, rows), scorer).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(brute.table(spark, rows).limit(0), scorer).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, label int")
    assert toxicity.fit_toxicity(empty).rate == 0.0
    one = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "b", None)], "doc_id long, text string, label int")
    assert {r.score for r in toxicity.score_toxicity(brute.table(spark, rows), toxicity.fit_toxicity(one)).collect()} == {1.0}


def test_toxicity_features():
    raw = np.frombuffer("You IDIOT!! id1ot".encode(), np.uint8)
    made = dict(zip(toxicity.FEATURES, toxicity._features(raw, np.array([0, len(raw)]), np.zeros(0, np.uint64), np.zeros(0))[0], strict=True))
    assert made["insult_hits"] == pytest.approx(math.log(3))
    assert made["near_hits"] == pytest.approx(math.log(3))
    assert made["hidden"] == pytest.approx(1 / 17)
    assert made["exclaims"] == pytest.approx(2 / 17)


def _kind(word):
    raw = np.frombuffer(word, np.uint8)
    return int(suffix_tree._kinds(words_of(raw, np.array([0, len(raw)])))[0])


def _suffix_tree_inputs():
    rng = np.random.default_rng(5)
    common = [" ".join(f"w{x}" for x in rng.zipf(1.4, 30) % 60) for _ in range(60)]
    passage = " ".join(f"rare{i}" for i in range(12))
    twice = [f"{passage} {common[0]}", f"Other {passage}", "x y x y x y x y", "", None, "\t\n", "Ärger é 中"]
    return brute.documents() + [(1000 + i, t) for i, t in enumerate(common + twice)]


@pytest.mark.parametrize("share,depth,least_gain", [(1 / (1 << 17), 2, 10.0), (0.01, 2, 0.5), (1.0, 1, 0.5)])
def test_suffix_tree_scores_as_a_plain_tree(spark, monkeypatch, share, depth, least_gain):
    monkeypatch.setattr(suffix_tree, "RUN_SHARE", 0.003)
    monkeypatch.setattr(suffix_tree, "WORD_SHARE", 0.02)
    rows = _suffix_tree_inputs()
    docs = brute.table(spark, rows + [rows[0]])
    training = docs.where(fold_of(F.col("doc_id")) != 1)
    counts = suffix_tree.count_words(training)
    tree = suffix_tree.fit_tree(training, suffix_tree.alphabet_of(counts, share), depth, least_gain, 3)
    found = suffix_tree.score_texts(docs, tree, counts).collect()
    assert len(found) == len(rows) + 1
    learned = [(i, t) for i, t in rows + [rows[0]] if zlib.crc32(str(i).encode()) % 5 != 1]
    scores, kept = brute.suffix_tree_scores([t for _, t in learned], rows, share, _kind, depth, suffix_tree.LEAST_SEEN, least_gain, 3)
    assert sorted(r.gain for r in tree.contexts.collect()) == pytest.approx(sorted(kept.values()))
    assert len(kept) > 1
    c = collections.Counter()
    for _, t in learned:
        c.update([w.encode() for w in brute.words(t, True)])
        c[None] += 1
    total, kinds, texts = sum(c.values()), len(c), dict(rows)
    for r in found:
        tokens = [w.encode() for w in brute.words(texts[r.doc_id], True)] + [None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens))
        assert r.score == pytest.approx(scores[r.doc_id])


def test_suffix_tree_keeps_all_contexts_that_pass(spark):
    """A model of more texts has more contexts; none is cut to a size."""
    rng = np.random.default_rng(7)
    lines = [" ".join(rng.permutation([f"t{i}x{j}" for j in range(8)])) for i in range(400)]
    sizes = []
    for n in (100, 400):
        docs = brute.table(spark, [(i, " ".join([lines[i]] * 40)) for i in range(n)])
        counts = suffix_tree.count_words(docs)
        sizes.append(suffix_tree.fit_tree(docs, suffix_tree.alphabet_of(counts)).contexts.count())
    assert sizes[1] > 3.5 * sizes[0] > 0


def test_suffix_tree_uses_the_longest_context(spark):
    text = "a b c d " * 40
    docs = brute.table(spark, [(i, text) for i in range(4)] + [(9, "d c b a " * 40)])
    counts = suffix_tree.count_words(docs.where("doc_id < 4"))
    tree = suffix_tree.fit_tree(docs.where("doc_id < 4"), suffix_tree.alphabet_of(counts))
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(docs, tree, counts).collect()}
    assert got[0] > got[9] / 3
    assert got[0] > 160 * math.log10(0.5)


def test_suffix_tree_without_training(spark):
    docs = brute.table(spark, [(1, "a b"), (2, None)])
    counts = suffix_tree.count_words(docs.limit(0))
    tree = suffix_tree.fit_tree(docs.limit(0), suffix_tree.alphabet_of(counts))
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in suffix_tree.score_texts(docs, tree, counts).collect()}
    assert got == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}
    assert suffix_tree.score_texts(docs.limit(0), tree, counts).count() == 0


def _plain_words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").translate(brute.LOWER).encode())


def test_licenses(spark):
    rng = random.Random(6)
    notices = dict(licenses.TEMPLATES)
    long_one = notices["gpl-3.0-notice"].split()
    rows = [(i, brute.prose(rng, 200) + "\n" + text + "\n" + brute.prose(rng, 90)) for i, (_, text) in enumerate(licenses.TEMPLATES)]
    rows += [(50, " ".join(w.upper() for w in long_one)), (51, " ".join(["word", *long_one[:12], "x", *long_one[13:]])), (52, brute.prose(rng, 400)), (53, None), (54, ""), (55, "Released under the"), (56, brute.prose(rng, 9000) + " Released under the MIT License")]
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(brute.table(spark, rows + rows[-1:])).collect()}
    want = set()
    for name, text in licenses.TEMPLATES:
        t = _plain_words(text)
        template = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        for i, body in rows:
            w = _plain_words(body)
            if len(template & {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) >= 0.8 * len(template):
                want.add((i, name))
    assert got == want
    assert (51, "gpl-3.0-notice") in got and (56, "mit") in got
    assert licenses.scan_licenses(brute.table(spark, rows).limit(0)).count() == 0
    assert licenses.scan_licenses(brute.table(spark, rows), ()).count() == 0


def test_license_with_words_inserted_at_every_offset(spark):
    rng = random.Random(16)
    notice = dict(licenses.TEMPLATES)["gpl-3.0-notice"].split()
    rows = []
    for n in (7, 10, 15):
        edited = notice[:15] + ["extra"] * n + notice[15:]
        rows += [(64 * n + at, " ".join([brute.prose(rng, at), *edited, brute.prose(rng, 70)])) for at in range(64)]
    got = {r.doc_id for r in licenses.scan_licenses(brute.table(spark, rows)).where("license = 'gpl-3.0-notice'").collect()}
    assert got == {i for i, _ in rows}


def test_license_templates_of_few_words(spark):
    rng = random.Random(17)
    templates = (("short", "All rights Reserved"), ("one", "copyleft"), ("none", " .,"), ("four", "use as you like"), licenses.TEMPLATES[2])
    rows = [(1, brute.prose(rng, 60) + " all rights reserved."), (2, "copyleft"), (3, "Use as you like, ALL RIGHTS"), (4, "rights reserved"), (5, "."), (6, None), (7, "Released under the MIT License. copyleft")]
    got = {(r.doc_id, r.license, r.containment) for r in licenses.scan_licenses(brute.table(spark, rows), templates).collect()}
    assert got == {(1, "short", 1.0), (2, "one", 1.0), (3, "four", 1.0), (7, "mit", 1.0), (7, "one", 1.0)}


def test_common_length():
    rng = random.Random(8)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontamination.common_length(masks, b) == best[-1][-1]


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, brute.prose(rng, rng.randrange(15, 60), 5000)) for i in range(20)] + [(90, None), (91, "")]
    rows = [(i, brute.prose(rng, rng.randrange(5, 400), 5000)) for i in range(60)]
    for i in range(20):
        rows.append((100 + i, brute.prose(rng, rng.randrange(0, 300), 5000) + " " + items[i][1] + " " + brute.prose(rng, 60, 5000)))
    words = items[0][1].split()
    changed = [w if i % 4 or i > len(words) - 6 else "other" for i, w in enumerate(words)]
    without_answer = [w if i % 4 else "other" for i, w in enumerate(words[:-5])] + ["no"] * 5
    rows += [(200, " ".join(changed)), (201, " ".join(without_answer)), (202, None), (203, ""), (204, items[3][1].upper())]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(brute.table(spark, rows), benchmark).collect()}
    want = {(100 + i, i) for i in range(20)} | {(200, 0), (204, 3)}
    assert got <= want
    assert len(got) >= 0.9 * len(want)
    assert (200, 0) in got
    none = brute.table(spark, rows).limit(0)
    assert decontamination.contaminated(none, benchmark).count() == 0
    assert decontamination.contaminated(brute.table(spark, rows), benchmark.limit(0)).count() == 0


def test_decontamination_recall_on_given_tables(spark):
    docs, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: b" " + b" ".join(_plain_words(r.text)) + b" " for r in benchmark.collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        body = b" " + b" ".join(_plain_words(r.text)) + b" "
        want |= {(r.doc_id, k) for k, item in items.items() if item in body}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert len(got - want) <= 0.05 * len(want)


def test_decontamination_finds_copies_beside_repeated_words(spark):
    """Copies whose window's vector is that of the words around them, and short items."""
    rng = random.Random(3)
    rows = [(i, brute.prose(rng, 120, 3000)) for i in range(300)]
    pool = sorted({w for _, text in rows for w in text.split()})
    items = [(i, " ".join(rng.sample(pool, n))) for i, n in enumerate([24, 40, 8, 5, 3, 60])]
    want = set()
    for i, text in items:
        for j, word in enumerate(rng.sample(pool, 5)):
            around = f"{word} " * 60
            rows += [(1000 + 10 * i + j, f"{text} {around}"), (1000 + 10 * i + j + 5, f"{around}{text} {around}")]
            want |= {(1000 + 10 * i + j, i), (1000 + 10 * i + j + 5, i)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(brute.table(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= want
    assert all(r.share == 1 for r in found if (r.doc_id, r.item_id) in want)


def test_latent_space_is_that_of_all_different_passages(spark):
    """Singular vectors as a plain decomposition of all passages has them, short and rare ones too."""
    rng = random.Random(12)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(60)]
    texts = [" ".join(rng.choices(common, k=34) + rng.choices(rare, k=rng.randrange(2))) for _ in range(20_000)]
    texts += [" ".join(rng.choices(rare, k=rng.randrange(1, 20))) for _ in range(300)] + [" ".join(rng.choices(common + rare, k=150)) for _ in range(50)]
    texts += texts[:2000] + [None, "", " . "]
    rank, skipped = 71, 1
    got = decontamination.fit_space(brute.table(spark, enumerate(texts)).repartition(8), rank, skipped).vectors

    given = [np.frombuffer(w.encode(), np.uint8) for w in common + rare]
    bucket = {w: int(decontamination._terms(licenses.license_words(raw, np.array([0, len(raw)])))[0]) for w, raw in zip(common + rare, given, strict=True)}
    assert len(set(bucket.values())) == len(bucket)
    place = {w: i for i, w in enumerate(bucket)}
    parts = [tuple(words[i : i + 64]) for words in ([w for w in (t or "").split() if w != "."] for t in texts) for i in range(0, len(words), 64)]
    seen = np.zeros(len(place))
    for part in parts:
        seen[[place[w] for w in set(part)]] += 1
    idf = np.log((1 + len(parts)) / (1 + seen)) + 0.1
    matrix = np.zeros((len(set(parts)), len(place)))
    for row, part in enumerate(sorted(set(parts))):
        for w in part:
            matrix[row, place[w]] += idf[place[w]]
        matrix[row] /= np.sqrt(sum(idf[place[w]] ** 2 for w in part))
    values, vectors = np.linalg.eigh(matrix.T @ matrix)
    best = np.argsort(values)[::-1][skipped : skipped + rank]
    want = vectors[:, best] / np.sqrt(np.maximum(values[best], values[best].max() * 1e-2)) * idf[:, None]
    got = got[list(bucket.values())]
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-3 * np.abs(want @ want.T).max()


def test_latent_space_sums_take_no_more_room_than_terms(spark, monkeypatch):
    """A table of few passages in many parts is multiplied by few tasks, as each writes whole sums."""
    parts, cut, summed = [], decontamination.cut, decontamination._summed

    def told(frames, width, kind):
        parts.append(frames.rdd.getNumPartitions())
        return summed(frames, width, kind)

    texts = [" ".join(f"w{i * j}" for j in range(64)) for i in range(1, 2001)]
    docs = brute.table(spark, enumerate(texts))
    whole = decontamination.fit_space(docs, 20, 1).vectors
    monkeypatch.setattr(decontamination, "cut", lambda df, label: cut(df.repartition(40), label))
    monkeypatch.setattr(decontamination, "_summed", told)
    apart = decontamination.fit_space(docs, 20, 1).vectors
    assert parts[0] > 1 and parts[1:] == [1] * decontamination.ROUNDS
    assert np.abs(apart @ apart[:100].T - whole @ whole[:100].T).max() < 1e-3 * np.abs(whole @ whole[:100].T).max()


def test_sums_of_runs_and_windows():
    rng = np.random.default_rng(3)
    table = np.append(rng.integers(-9, 9, (50, 6)), np.zeros((1, 6), int), axis=0).astype(np.float32)
    index = rng.integers(0, 50, 3000).astype(np.int16)
    for first in ([0], [0, 1, 2], [0, 8, 16, 17, 600, 2999], range(3000)):
        want = [table[own].sum(axis=0) for own in np.split(index, first)[1:]]
        assert (decontamination._run_sums(table, index, np.array(first)) == want).all()
    begin = np.arange(0, 50, 2)
    end = np.minimum(begin + rng.integers(1, 9, len(begin)), 50)
    for count in (1, 2, 4):
        want = [table[b : min(b + count, e)].sum(axis=0) for b, e in zip(begin, end, strict=True)]
        assert (decontamination._run_of(table, begin, end, count) == want).all()


def test_powers_of_word_hashes_are_made_once():
    made = words._powers(words._BASE, 1000)
    assert made is words._powers(words._BASE, 99) and len(made) == words.PIECE + 1
    assert (words._powers(words._BASE, words.PIECE + 5)[: len(made)] == made).all()
