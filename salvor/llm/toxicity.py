"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvor.llm.words import bounds_of, lower_ascii, mix, pieces, range_hashes, signed, words_of
from salvor.runtime import cut, cut_counted, small

# Labelled rows that the classifier is fitted on, at most (expected number).
SAMPLE = 16_000
# Share of the sample that the trees are fitted on; the rest is for the calibration.
TREE_SHARE = 0.85
PREFIXES = (4, 5, 6, 8)
# A term of the lexicon occurs in so many toxic texts, and in this share of them, at least.
LEXICON_SIZE, LEAST_TOXIC_TEXTS, LEAST_TOXIC_SHARE = 4096, 3, 0.005
NEAR = 4
# Words that insult, and words that address the reader.
INSULTS = ("idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "jerk", "garbage", "imbecile", "hate", "kill", "shut", "ugly", "freak")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "youre", "tu", "te", "ti", "tus", "usted", "vosotros", "toi", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch")
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = (
    "lexicon_hits", "lexicon_density", "lexicon_weight", "insult_hits", "insult_density", "near_hits", "person_density",
    "capitals", "shouted", "exclaims", "questions", "punctuation", "digits", "hidden", "repeats", "length",
)


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(range_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def _fixed(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(np.array([_hash_of(w) for w in words], np.uint64))


def _inside(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in the sorted ``known`` or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _plain(raw: np.ndarray) -> np.ndarray:
    """Lower-case letters; a lookalike between letters undone, all else a space."""
    lookalike, letters = np.zeros(256, np.uint8), lower_ascii(np.arange(256, dtype=np.uint8))
    for sign, letter in LOOKALIKES.items():
        lookalike[ord(sign)] = ord(letter)
    letters[:128][~((letters[:128] >= 97) & (letters[:128] <= 122))] = 32
    out = letters[raw]
    solid = out != 32
    if len(raw) > 2:
        inside = np.flatnonzero(solid[:-2] & solid[2:] & (lookalike[raw[1:-1]] > 0)) + 1
        out[inside] = lookalike[raw[inside]]
    return out


def _terms(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Owners of plain words, and hashes of each whole word and its beginnings."""
    words = words_of(_plain(raw), at)
    hashes = [words.hash]
    for n in PREFIXES:
        part = range_hashes(words.bytes, words.start, np.minimum(words.start + n, words.end))
        hashes.append(np.where(words.end - words.start > n, mix(part, n), np.uint64(0)))
    return words.owner, hashes


def _features(raw: np.ndarray, at: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    owner, hashes = _terms(raw, at)
    strongest = np.zeros(len(owner))
    for values in hashes:
        place = _inside(values, known)
        strongest = np.maximum(strongest, np.where(place >= 0, weights[place] if len(weights) else 0, 0))
    hit, insult = strongest > 0, _inside(hashes[0], _fixed(INSULTS)) >= 0
    person = _inside(hashes[0], _fixed(SECOND_PERSON)) >= 0
    near = np.zeros(len(owner), bool)
    for step in range(1, NEAR + 1):
        same = owner[step:] == owner[:-step]
        near[step:] |= same & person[:-step]
        near[:-step] |= same & person[step:]
    count = lambda mask: np.bincount(owner[mask], minlength=n).astype(float)
    words, chars = np.maximum(np.bincount(owner, minlength=n), 1), np.maximum(np.diff(at), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1)
        np.cumsum(mask, out=sums[1:])
        return (sums[at[1:]] - sums[at[:-1]]) / chars

    capital = (raw >= 65) & (raw <= 90)
    letter = capital | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    sign = ~letter & ~space
    digit = (raw >= 48) & (raw <= 57)
    hidden, shouted, repeated = np.zeros(len(raw), bool), np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    if len(raw) > 2:
        hidden[1:-1] = letter[:-2] & sign[1:-1] & letter[2:]
        shouted[1:-1] = capital[:-2] & capital[1:-1] & capital[2:]
        repeated[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & ~space[2:]
    hits, insults = count(hit), count(insult)
    weight = np.bincount(owner, weights=strongest, minlength=n)
    columns = [
        np.log1p(hits), hits / words, weight / np.maximum(hits, 1), np.log1p(insults), insults / words, np.log1p(count((hit | insult) & near)), count(person) / words,
        share(capital), share(shouted), share(raw == 33), share(raw == 63), share(sign), share(digit), share(hidden), share(repeated), np.log1p(np.diff(at)),
    ]
    return np.stack(columns, axis=1)


def features(rows: DataFrame, known: np.ndarray, weights: np.ndarray) -> DataFrame:
    """The columns of ``rows`` but text, and the dense features of the text."""
    kept = [c for c in rows.columns if c != "text"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_features(raw, at, known, weights) for _, _, raw, at in pieces(batch.column("text"))]
            found = np.concatenate(made) if made else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(found[:, i]) for i in range(len(FEATURES)))], [*kept, *FEATURES])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{name} double" for name in FEATURES]
    return rows.mapInArrow(make, ", ".join(fields))


def _presences(rows: DataFrame, only: np.ndarray | None) -> DataFrame:
    """term, texts: in how many of the rows' texts a word or beginning occurs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in pieces(batch.column("text")):
                owner, hashes = _terms(raw, at)
                bounds, parts = bounds_of(owner, len(at) - 1), []
                for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                    own = np.unique(np.concatenate([h[low:high] for h in hashes]))
                    parts.append(own if only is None else own[_inside(own, only) >= 0])
                terms, texts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"term": pa.array(signed(terms)), "texts": pa.array(texts, pa.int64())})

    return rows.select("text").mapInArrow(make, "term long, texts long").where("term <> 0").groupBy("term").agg(F.sum("texts").alias("texts"))


class Scorer:
    """Lexicon, trees and calibration; without trees every score is ``rate``."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, trees=None, curve=None, rate: float = 0.0):
        self.known, self.weights, self.trees, self.curve, self.rate = known, weights, trees, curve, rate


def _lexicon(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The terms with the greatest log odds between toxic and clean texts."""
    rows = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = rows.get(1, 0), rows.get(0, 0)
    least = max(LEAST_TOXIC_TEXTS, int(toxic * LEAST_TOXIC_SHARE))
    found = _presences(texts.where("label = 1"), None).where(F.col("texts") >= least)
    found = found.orderBy(F.desc("texts"), "term").limit(LEXICON_SIZE * 16).collect()
    terms = np.array([r["term"] for r in found], np.int64).view(np.uint64)
    counts = {r["term"]: r["texts"] for r in _presences(texts.where("label = 0"), np.sort(terms)).collect()}
    odds = {}
    for row in found:
        bad, good = row["texts"], counts.get(row["term"], 0)
        # A lower bound of the toxic rate among texts that have the term, against the rate of all texts.
        lower = (bad + 0.5) / (toxic + 1) / ((good + 1.5) / (clean + 3))
        if lower >= 8 and bad >= 4 * good:
            odds[row["term"]] = float(np.log(lower))
    best = sorted(odds, key=lambda t: (-odds[t], t))[:LEXICON_SIZE]
    known = np.array(best, np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.array([odds[t] for t in best])[order]


def fit_toxicity(rows: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Scorer:
    """Fit on rows of (doc_id, text, label 0 or 1); null labels are left out.

    At most about ``sample`` rows are used, those with the smallest id hashes;
    this bounds the lexicon, the trees and the calibration. The trees see each
    half of the sample with the lexicon of the other half; the scorer has that of
    both. Without rows of both labels the scorer is the rate of label 1.
    """
    rows = rows.where("label in (0, 1)").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    total = rows.count()
    share = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "doc_id"), 11) / F.lit(float(1 << 53))
    drawn = rows.withColumn("part", share * max(1.0, total / sample)).where("part < 1")
    drawn, found = cut_counted(drawn, "labelled", toxic=F.col("label") == 1, clean=F.col("label") == 0)
    none = np.zeros(0, np.uint64), np.zeros(0)
    if not found["toxic"] or not found["clean"]:
        return Scorer(*none, rate=float(found["toxic"] > 0))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    one, two = drawn.where(half == 0), drawn.where(half == 1)
    made = features(one, *_lexicon(two)).unionByName(features(two, *_lexicon(one)))
    known, weights = _lexicon(drawn)
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made)
    made = cut(made.select("features", F.col("label").cast("double").alias("label"), "part", "doc_id"), "features")
    fitted = made.where(F.col("part") < TREE_SHARE)
    kinds = {r["label"] for r in fitted.select("label").distinct().collect()}
    if len(kinds) < 2:
        return Scorer(known, weights, rate=found["toxic"] / (found["toxic"] + found["clean"]))
    trees = GBTClassifier(maxIter=25, maxDepth=4, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=seed).fit(fitted.coalesce(4))
    rest = made.where(F.col("part") >= TREE_SHARE)
    rest = _raw(trees.transform(rest)).select("raw", "label")
    curve = None
    if len(rest.select("label").distinct().collect()) == 2:
        curve = IsotonicRegression(featuresCol="raw").fit(rest)
    return Scorer(known, weights, trees, curve)


def _raw(scored: DataFrame) -> DataFrame:
    return scored.withColumn("raw", vector_to_array("probability")[1])


def score_toxicity(docs: DataFrame, model: Scorer) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null text counts as empty.

    Only doc_id and text are read; repeated rows are scored each. The score is
    the calibrated probability, with a tenth of the trees' own mixed in so that
    it also orders texts within a step of the calibration.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if model.trees is None:
        return rows.select("doc_id", F.lit(model.rate).alias("score"))
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(rows, model.known, model.weights))
    scored = _raw(model.trees.transform(made.select("doc_id", "features"))).select("doc_id", "raw")
    if model.curve is None:
        return scored.select("doc_id", F.col("raw").alias("score"))
    scored = model.curve.transform(scored)
    return scored.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("prediction") * 0.9 + F.col("raw") * 0.1))).alias("score"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their label; of several labels of a document the greatest holds."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    marks, found = cut_counted(marks.withColumnRenamed("doc_id", "_id"), "labels", rows=F.lit(True))
    return docs.select("doc_id", "text").join(small(marks, found["rows"]), F.col("doc_id") == F.col("_id")).drop("_id")
