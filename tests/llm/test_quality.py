"""The network over bytes: plain forward pass, numeric gradients, held-out accuracy, edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salvor.llm import quality
from salvor.llm.words import fold_of
from tests.llm import brute

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net():
    made = quality.start_net(0.8)
    return made._replace(offset=np.linspace(-0.2, 0.2, quality.FILTERS).astype(np.float32))


def plain(net, text):
    """The probability of one text by loops over chunks, positions and filters."""
    raw = text.encode()
    words, codes = [], list(raw)
    start = None
    for i, b in enumerate([*raw, 32]):
        if b in b" \t\n\x0b\x0c\r":
            if start is not None:
                words.append((raw[start:i], start, i))
            start = None
        elif start is None:
            start = i
    for n, (word, low, high) in enumerate(words):
        if any(word == other for other, _, _ in words[max(0, n - quality.LAST_WORDS) : n]):
            codes[low:high] = [c + quality.ECHOED for c in codes[low:high]]
    tops, step = [], quality.CHUNK - quality.OVERLAP
    for low in range(0, max(1, len(raw) - quality.OVERLAP), step):
        chunk = (codes[low : low + quality.CHUNK] + [quality.PAD] * quality.CHUNK)[: quality.CHUNK]
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            seen = np.concatenate([net.table[c] for c in chunk[at : at + quality.WIDTH]])
            best = np.maximum(best, seen @ net.filters)
        tops.append(np.maximum(best + net.offset, 0))
    pooled = np.concatenate([np.max(tops, axis=0), np.mean(tops, axis=0)])
    return 1 / (1 + np.exp(-(pooled @ net.weights + net.bias[0])))


def _joined(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    return raw, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])


def test_scores_as_plain_loops(net):
    rng = random.Random(2)
    texts = [brute.prose(rng, n, 30) for n in (1, 5, 80, 130, 300, 900)] + ["", "x", "é" * 300, "a a a b", "y" * 512, "y" * 513, "z" * 64, "z" * 65]
    got = quality.scores(net, *_joined(texts))
    assert got == pytest.approx([plain(net, t) for t in texts], rel=1e-4)
    assert quality.scores(net, *_joined(["", ""])) == pytest.approx([plain(net, "")] * 2, rel=1e-4)


def test_gradients_are_differences(net):
    rng = random.Random(4)
    texts = []
    for n in (3, 150, 400):
        raw, at = _joined([brute.prose(rng, n, 50)])
        texts.append(quality.chunk_codes(quality.byte_codes(raw, at), at, *quality.chunk_starts(np.diff(at))))
    labels = np.array([1, 0, 1], np.float32)
    wide = quality.Net(*(x.astype(float) for x in net))
    _, found = quality.gradients(wide, texts, labels)
    pick = np.random.default_rng(5)
    for which, part in enumerate(wide):
        used = np.argsort(-np.abs(found[which]).ravel())[:40]
        for place in pick.choice(used, min(5, part.size), replace=False):
            losses = []
            for way in (1e-5, -1e-5):
                moved = part.copy()
                moved.ravel()[place] += way
                losses.append(quality.gradients(wide._replace(**{quality.Net._fields[which]: moved}), texts, labels)[0])
            assert found[which].ravel()[place] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=0.02, abs=1e-5)


def test_chunks_cover_texts():
    owner, start = quality.chunk_starts(np.array([0, 1, 512, 513, 5000]))
    for i, size in enumerate((0, 1, 512, 513, 5000)):
        own = start[owner == i]
        assert own[0] == 0 and own[-1] + quality.CHUNK >= size
        assert (np.diff(own) == quality.CHUNK - quality.OVERLAP).all()
    assert np.bincount(owner)[:4].tolist() == [1, 1, 1, 2]


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return quality.fit_quality(quality.labelled(docs, labels.where(fold_of(F.col("doc_id")) != 0)))


def test_held_out(spark, fitted):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score_quality(docs, fitted).join(labels.where(fold_of(F.col("doc_id")) == 0), "doc_id").collect()
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    better = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert better > 0.9
    assert sum(g >= 0.3 for g in good) >= 0.95 * len(good)


def test_edges(spark, fitted):
    rows = [(1, None), (2, ""), (3, "x" * 50000), (4, "a b"), (4, "a b"), (None, "\x00"), (5, "中" * 700)]
    got = quality.score_quality(brute.table(spark, rows).withColumn("score", F.lit("x")), fitted).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.score_quality(brute.table(spark, rows).limit(0), fitted).count() == 0
    assert quality.fit_quality(spark.createDataFrame([], "doc_id long, text string, label int")) == 0.0
    one = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "b", None), (4, "c", 7)], "doc_id long, text string, label int")
    assert {r.score for r in quality.score_quality(brute.table(spark, rows), quality.fit_quality(one)).collect()} == {1.0}
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0)], "doc_id long, quality int")
    assert sorted((r.doc_id, r.label) for r in quality.labelled(brute.table(spark, rows), marks).collect()) == [(1, 1), (4, 0), (4, 0)]


def test_fit_repeats(spark):
    """Two fits on the same rows give the same net, in whatever order the rows lie."""
    rng = random.Random(1)
    rows = [(i, brute.prose(rng, 20, 50) if i % 3 else "!!! ### " * 20, int(i % 3 > 0)) for i in range(60)] + [(7, "again", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    one, two = (quality.fit_quality(d, rounds=1) for d in (docs.repartition(2), docs.repartition(5, "text")))
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(one, two, strict=True))
