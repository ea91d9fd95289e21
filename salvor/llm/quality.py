"""Text quality by a convolutional network over bytes, written in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvor.llm.words import pieces, words_of
from salvor.runtime import cut, cut_counted, small

# Bytes of a chunk, and how many of them the next chunk has too.
CHUNK, OVERLAP = 512, 64
# A filter sees so many bytes and moves on by so many.
WIDTH, STRIDE = 12, 4
FILTERS, CHANNELS = 32, 8
# A byte's code is its value, ECHOED more in a word that one of the last words repeats.
PAD, ECHOED, CODES, LAST_WORDS = 256, 257, 514, 8
# Labelled rows that the network is fitted on, at most (expected number), and chunks of a text
# among them, evenly spaced over the whole of it.
SAMPLE, SAMPLE_CHUNKS = 6_000, 48
# Parts of the sample that learn side by side, how often their weights are averaged, and passes between.
PARTS, AVERAGED, PASSES = 8, 6, 3
BATCH, RATE = 16, 0.004
CHUNKS_AT_ONCE = 128
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


class Net(NamedTuple):
    """Byte vectors, filters with offsets, and weights of the pooled values."""

    table: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def start_net(rate: float, seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.5, (CODES, CHANNELS))
    table[ECHOED:] = table[:ECHOED] + rng.normal(0, 0.2, (ECHOED, CHANNELS))
    filters = rng.normal(0, 1 / np.sqrt(WIDTH * CHANNELS), (WIDTH * CHANNELS, FILTERS))
    return Net(*(x.astype(np.float32) for x in (table, filters, np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.array([np.log(rate / (1 - rate))]))))


def byte_codes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = words_of(raw, at)
    echo = np.zeros(len(words.owner), bool)
    for back in range(1, min(LAST_WORDS, len(echo) - 1) + 1):
        echo[back:] |= (words.hash[back:] == words.hash[:-back]) & (words.owner[back:] == words.owner[:-back])
    step = np.zeros(len(raw) + 1, np.int8)
    step[words.start[echo]] += 1
    step[words.end[echo]] -= 1
    return raw.astype(np.int16) + np.cumsum(step[:-1], dtype=np.int8) * np.int16(ECHOED)


def chunk_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and start of the chunks that cover texts of these sizes; every text has one at least."""
    number = np.maximum(1, -(-(sizes - OVERLAP) // (CHUNK - OVERLAP)))
    owner = np.repeat(np.arange(len(sizes)), number)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    return owner, nth * (CHUNK - OVERLAP)


def chunk_codes(codes: np.ndarray, at: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The codes of some chunks, padded behind the end of a text."""
    place = start[:, None] + np.arange(CHUNK)
    inside = place < np.diff(at)[owner][:, None]
    if not len(codes):
        return np.full(place.shape, PAD, np.int16)
    return np.where(inside, codes[np.minimum(at[owner][:, None] + place, len(codes) - 1)], PAD)


def responses(net: Net, codes: np.ndarray) -> np.ndarray:
    """Each filter at each position of each chunk."""
    bytes_ = net.table[codes].reshape(len(codes), CHUNK * CHANNELS)
    seen = np.lib.stride_tricks.sliding_window_view(bytes_, WIDTH * CHANNELS, axis=1)[:, :: STRIDE * CHANNELS]
    return (seen.reshape(-1, WIDTH * CHANNELS) @ net.filters).reshape(len(codes), POSITIONS, FILTERS)


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def scores(net: Net, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The probability of each text, from all its chunks."""
    n = len(at) - 1
    codes = byte_codes(raw, at)
    owner, start = chunk_starts(np.diff(at))
    most, sums = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float64)
    for low in range(0, len(owner), CHUNKS_AT_ONCE):
        part = slice(low, low + CHUNKS_AT_ONCE)
        top = np.maximum(responses(net, chunk_codes(codes, at, owner[part], start[part])).max(axis=1) + net.offset, 0)
        first = np.flatnonzero(np.concatenate([[True], owner[part][1:] != owner[part][:-1]]))
        who = owner[part][first]
        most[who] = np.maximum(most[who], np.maximum.reduceat(top, first))
        sums[who] += np.add.reduceat(top, first)
    pooled = np.concatenate([most, sums / np.bincount(owner, minlength=n)[:, None]], axis=1)
    return _chance(pooled @ net.weights + net.bias)


def gradients(net: Net, texts: list[np.ndarray], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Log loss of some texts (chunk codes of each) and its gradient by all parts of the net."""
    codes, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    owner, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    top, place = np.empty((len(codes), FILTERS), net.table.dtype), np.empty((len(codes), FILTERS), np.int64)
    for low in range(0, len(codes), CHUNKS_AT_ONCE):
        found = responses(net, codes[low : low + CHUNKS_AT_ONCE])
        place[low : low + CHUNKS_AT_ONCE] = found.argmax(axis=1)
        top[low : low + CHUNKS_AT_ONCE] = found.max(axis=1)
    top = np.maximum(top + net.offset, 0)
    most, mean = np.maximum.reduceat(top, first), np.add.reduceat(top, first) / sizes[:, None]
    pooled = np.concatenate([most, mean], axis=1)
    chance = _chance(pooled @ net.weights + net.bias)
    loss = float(-np.where(labels > 0, np.log(chance + 1e-9), np.log(1 - chance + 1e-9)).mean())
    error = ((chance - labels) / len(labels)).astype(net.table.dtype)
    by_pool = error[:, None] * net.weights
    by_top = (by_pool[:, FILTERS:] / sizes[:, None])[owner]
    for i, (low, size) in enumerate(zip(first, sizes, strict=True)):
        by_top[low + top[low : low + size].argmax(axis=0), np.arange(FILTERS)] += by_pool[i, :FILTERS]
    by_top *= top > 0
    # Only the position that was pooled passes a gradient on.
    by_table, by_filters = np.zeros((CODES, CHANNELS)), np.zeros_like(net.filters)
    for low in range(0, len(codes), CHUNKS_AT_ONCE):
        part = slice(low, low + CHUNKS_AT_ONCE)
        rows = np.arange(len(codes[part]))[:, None, None]
        seen = codes[part][rows, place[part][:, :, None] * STRIDE + np.arange(WIDTH)]
        vectors = net.table[seen].reshape(*seen.shape[:2], WIDTH * CHANNELS)
        by_filters += np.einsum("cf,cfk->kf", by_top[part], vectors)
        by_bytes = (by_top[part][:, :, None] * net.filters.T).reshape(-1, CHANNELS)
        for c in range(CHANNELS):
            by_table[:, c] += np.bincount(seen.ravel(), weights=by_bytes[:, c], minlength=CODES)
    return loss, [by_table, by_filters, by_top.sum(axis=0), pooled.T @ error, error.sum(keepdims=True)]


def learn(net: Net, texts: list[np.ndarray], labels: np.ndarray, passes: int, rate: float, seed: int) -> Net:
    """Passes of Adam over the texts, in batches."""
    rng = np.random.default_rng(seed)
    net = [x.astype(np.float32).copy() for x in net]
    mean, square, step = [np.zeros_like(x) for x in net], [np.zeros_like(x) for x in net], 0
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            chosen = order[low : low + BATCH]
            _, found = gradients(Net(*net), [texts[i] for i in chosen], labels[chosen])
            step += 1
            for x, m, s, g in zip(net, mean, square, found, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return Net(*net)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their label; of several labels of a document the greatest holds."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    marks, found = cut_counted(marks.withColumnRenamed("doc_id", "_id"), "labels", rows=F.lit(True))
    return docs.select("doc_id", "text").join(small(marks, found["rows"]), F.col("doc_id") == F.col("_id")).drop("_id")


def _sampled(rows: DataFrame) -> DataFrame:
    """part, key, label and the codes of the chunks of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, at in pieces(batch.column("text")):
                codes, out = byte_codes(raw, at), []
                owner, start = chunk_starts(np.diff(at))
                bounds = np.searchsorted(owner, np.arange(high - low + 1))
                for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                    chosen = np.unique(np.linspace(first, last - 1, min(last - first, SAMPLE_CHUNKS)).astype(int))
                    out.append(chunk_codes(codes, at, owner[chosen], start[chosen]).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in ("part", "key", "label")), pa.array(out, pa.binary())], ["part", "key", "label", "codes"])

    return rows.mapInArrow(make, "part int, key long, label int, codes binary")


def _learner(net: Net, turn: int, rate: float) -> Callable[[pa.Table], pa.Table]:
    def own(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("label", "ascending")])
        texts = [np.frombuffer(x.as_py(), np.int16).reshape(-1, CHUNK) for x in group.column("codes")]
        made = learn(net, texts, group.column("label").to_numpy().astype(np.float32), PASSES, rate, turn)
        flat = np.concatenate([x.ravel() for x in made])
        return pa.table({"n": pa.array([len(texts)], pa.int64()), "part": group.column("part").slice(0, 1), "net": pa.array([flat.tobytes()], pa.binary())})

    return own


def fit_quality(rows: DataFrame, sample: int = SAMPLE, rounds: int = AVERAGED, seed: int = 11) -> Net | float:
    """Fit on rows of (doc_id, text, label 0 or 1); the rate of label 1 where only one label is there.

    At most about ``sample`` rows are used, those with the smallest id hashes, and
    of each text at most ``SAMPLE_CHUNKS`` chunks, evenly spaced over the whole of
    it; both bound what a task holds. The sample lies in parts. In every round each part
    starts from the same net, learns from its own rows in its own task, and the
    nets are averaged, weighted by rows; the driver sees one small net per part.
    """
    rows = rows.where("label in (0, 1)").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    total = rows.count()
    key = F.xxhash64(F.lit("quality"), "doc_id", "text")
    share = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "doc_id"), 11) / F.lit(float(1 << 53))
    drawn = rows.where(share * max(1.0, total / sample) < 1)
    drawn = drawn.select(F.pmod(F.xxhash64(F.lit("part"), key), F.lit(PARTS)).cast("int").alias("part"), key.alias("key"), "label", "text")
    drawn, found = cut_counted(_sampled(drawn), "sample", good=F.col("label") == 1, bad=F.col("label") == 0)
    if not found["good"] or not found["bad"]:
        return float(found["good"] > 0)
    net = start_net(found["good"] / (found["good"] + found["bad"]), seed)
    for turn in range(rounds):
        own = _learner(net, turn, RATE * (1 - turn / rounds))
        made = sorted(drawn.groupBy("part").applyInArrow(own, "n long, part int, net binary").collect(), key=lambda r: r["part"])
        flat = sum(r["n"] * np.frombuffer(r["net"], np.float32).astype(float) for r in made) / sum(r["n"] for r in made)
        ends = np.cumsum([x.size for x in net])[:-1]
        net = Net(*(x.reshape(old.shape).astype(np.float32) for x, old in zip(np.split(flat, ends), net, strict=True)))
    return net


def score_quality(docs: DataFrame, net: Net | float) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    Filters over bytes move along overlapping chunks that cover the whole text;
    each filter's greatest response in a chunk is pooled over the chunks by
    maximum and by mean, and both are combined into one probability. Null counts
    as empty; an empty text is one chunk of padding. Only doc_id and text are
    read; repeated rows are scored each. A text is worked on alone whatever its
    length, a few chunks at a time. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if isinstance(net, float):
        return rows.select("doc_id", F.lit(net).alias("score"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, at in pieces(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(scores(net, raw, at).astype(float))], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
