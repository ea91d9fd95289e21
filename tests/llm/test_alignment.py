"""Links between tokenizers, against plain loops over spans."""

import bisect
import collections
import functools
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from salvor.llm import alignment
from tests.llm import brute

PARTS = ["a", "b ", "  ", "   ", "\n", "é", "the", " The", "\t", "▁", "中", " ", "ing", "!", " .", "0", "<s>", "'s", " 's", "\x1c", "\x85", " ", "　", "<|endoftext|>", "\U0001f600", "\r\n", "isn't", "́"]


@pytest.fixture(scope="module")
def both():
    return alignment.tokenizers(alignment.FOLDER)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(400)]
    return made + [t or "" for _, t in brute.documents()] + [" ", "  ", "x" * 3000, " " * 3000 + "x", "1" * 500]


@functools.cache
def libraries():
    a_side = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_BPE}")
    a_side.encode_special_tokens = True
    return a_side, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECE_BPE}")


def plain(text, both):
    """counts, groups text and linked pairs of one text, encoded as a whole."""
    a_side, b_side = libraries()
    ids = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
    entries = [both.bytes_a[i] for i in ids[0]], [both.bytes_b[i] for i in ids[1]]
    if not text or any(b"".join(x) != (" " + text).encode() for x in entries):
        return (0, 0, 0, 0, 0), "", {}
    spans = []
    for side in entries:
        ends = np.cumsum([len(x) for x in side]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    inside = [[[] for _ in cuts] for _ in ids]
    for side in (0, 1):
        for i, (_, end) in zip(ids[side], spans[side], strict=True):
            inside[side][bisect.bisect_left(cuts, end)].append(i)
    pairs = collections.Counter((i, j) for i, (p, q) in zip(ids[0], spans[0], strict=True) for j, (u, v) in zip(ids[1], spans[1], strict=True) if p < v and u < q)
    groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*inside, strict=True))
    shared = sum(len(x) * len(y) for x, y in zip(*inside, strict=True))
    return (len(ids[0]), len(ids[1]), len(cuts), sum(pairs.values()), shared), hashlib.sha256(groups.encode()).hexdigest(), pairs


@pytest.fixture(scope="module")
def rows(texts):
    texts = [t[:1000] for t in texts]
    return [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[7]), (None, texts[7]), (90000, None)]


def test_products_are_matrix_products():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, k, m = rng.integers(0, 9, 3)
        a, b = rng.integers(0, 3, (n, k)), rng.integers(0, 3, (m, k))

        def rows_of(x):
            at = np.nonzero(x)
            return alignment.CSR(np.concatenate([[0], np.cumsum((x > 0).sum(axis=1))]).astype(np.int64), at[1], x[at], x.shape[1])

        made = alignment.product(rows_of(a), alignment.transposed(rows_of(b)))
        dense = np.zeros((n, m), int)
        for i in range(n):
            dense[i, made.indices[made.indptr[i] : made.indptr[i + 1]]] = made.counts[made.indptr[i] : made.indptr[i + 1]]
        assert (dense == a @ b.T).all()
        sizes = alignment.product_sizes(rows_of(a), alignment.transposed(rows_of(b)))
        assert sizes.tolist() == ((a > 0).astype(int) @ (b > 0).T.astype(int)).sum(axis=1).tolist()


def test_texts_in_parts_equal_whole_texts(rows, both):
    assert both.divisible
    found = alignment.align_texts([t or "" for _, t in rows], both)
    for i, (_, text) in enumerate(rows):
        counts, digest, pairs = plain(text or "", both)
        low, high = found.pairs.indptr[i : i + 2]
        got = {divmod(p, len(both.bytes_b)): n for p, n in zip(found.pairs.indices[low:high].tolist(), found.pairs.counts[low:high].tolist(), strict=True)}
        assert (tuple(int(c[i]) for c in found.counts), found.digests[i], got) == (counts, digest, pairs)


def test_shared_links(both):
    made = alignment.align(both.encode(["isn't", "中文x", "thing"]), both)
    links = alignment.shared_links(made)
    assert np.diff(links.indptr).tolist() == made.shared.tolist()
    for i in range(len(made.a)):
        assert (made.group_b[links.indices[links.indptr[i] : links.indptr[i + 1]]] == made.group_a[i]).all()


@pytest.mark.parametrize("share", [1e-6, 0.01, 2.0])
def test_query_against_loops(spark, rows, both, share):
    docs = brute.table(spark, rows).repartition(3)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_shared")
    each = [(i, plain(t or "", both)) for i, t in rows]
    held = collections.Counter(p for _, (_, _, pairs) in each for p in pairs)
    most = collections.Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = sorted(((i is None, i or 0), *counts, sum(n for p, n in pairs.items() if held[p] == most[p[0]]), sum(held[p] * n for p, n in pairs.items()), digest) for i, (counts, digest, pairs) in each)
    got = alignment.align_tokenizers(docs, share=share).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), *(r[n] for n in names), r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


def test_empty_table(spark):
    assert alignment.align_tokenizers(brute.table(spark, [(1, "x")]).limit(0)).count() == 0


def test_worker_cache_lets_go(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 4)
    fresh = alignment.Tokenizers(alignment.FOLDER)
    words = [f"word{i % 7}" for i in range(40)]
    one = [fresh.encode([w])[0] for w in words]
    assert one == alignment.Tokenizers(alignment.FOLDER).encode(words)
    assert len(fresh._new) + len(fresh._old) <= 9
