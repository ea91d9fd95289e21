"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvor.llm.words import lower_ascii, pieces
from salvor.runtime import cut, cut_counted, small

BUCKETS = 4096
CENTROIDS = 3
# Rows expected per language in the sample that the centroids are clustered from.
SAMPLE_A_LANGUAGE = 300
ROWS_AT_ONCE = 256
UNKNOWN = "und"


def gram_counts(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Counts of hashed 1-, 2- and 3-byte grams, a matrix for every few rows.

    A to Z are lowered and ASCII characters that are no letters become spaces.
    """
    table = lower_ascii(np.arange(256, dtype=np.uint8))
    table[:128][~((table[:128] >= 97) & (table[:128] <= 122))] = 32
    for low, high, raw, at in pieces(texts):
        for first in range(0, high - low, ROWS_AT_ONCE):
            last = min(first + ROWS_AT_ONCE, high - low)
            part, ends = table[raw[at[first] : at[last]]].astype(np.uint32), at[first : last + 1] - at[first]
            owner = np.repeat(np.arange(last - first, dtype=np.int64) * buckets, np.diff(ends))
            out = np.zeros((last - first) * buckets)
            code = np.zeros(len(part), np.uint32)
            for n in (1, 2, 3):
                if len(part) < n:
                    break
                code = (code[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
                same = owner[: len(code)] == owner[n - 1 :]
                place = (code * np.uint32(2654435761) + np.uint32(n * 977)) * np.uint32(2246822519) >> np.uint32(32 - int(buckets).bit_length() + 1)
                out += np.bincount((owner[: len(code)] + place)[same], minlength=len(out))
            yield out.reshape(last - first, buckets)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = (np.log1p(counts) * idf).astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids, least member cosines."""
    seeds = [vectors.mean(axis=0)]
    while len(seeds) < min(k, len(vectors)) + 1:
        nearest = (vectors @ np.array(seeds).T).max(axis=1)
        seeds.append(vectors[int(nearest.argmin())])
    centres = np.array(seeds[1:])
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.array([vectors[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosine = vectors @ centres.T
    own = cosine.argmax(axis=1)
    least = [np.quantile(cosine[own == i, i], 0.01) if (own == i).any() else 1.0 for i in range(len(centres))]
    return centres.astype(np.float32), np.array(least, np.float32)


class Centroids:
    """A fitted classifier; its size is bounded by languages times centroids."""

    def __init__(self, langs: list[str], centres: np.ndarray, least: np.ndarray, idf: np.ndarray):
        self.langs, self.centres, self.least, self.idf = langs, centres, least, idf


def fit_languages(rows: DataFrame, sample: int = SAMPLE_A_LANGUAGE, k: int = CENTROIDS) -> Centroids | None:
    """Fit on rows of (doc_id, text, lang); null texts and languages are left out.

    Document frequencies cover all rows. Centroids come from a sample: the rows
    of a language whose id hash lies below ``sample`` over its number of rows.
    One task clusters one language's sample. None if nothing can be learned.
    """
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for counts in gram_counts(batch.column("text")):
                seen += (counts > 0).sum(axis=0)
                total += len(counts)
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(BUCKETS + 1), pa.int32()), "n": pa.array([*seen, total], pa.int64())})

    sums = rows.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    seen = np.zeros(BUCKETS + 1)
    for row in sums.collect():
        seen[row["place"]] = row["n"]
    if not seen[-1]:
        return None
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)
    sizes, found = cut_counted(rows.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("n")), "languages", rows=F.lit(True))
    share = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 11) / F.lit(float(1 << 53))
    drawn = rows.join(small(sizes, found["rows"]), F.col("lang") == F.col("_lang")).where(share < F.lit(float(sample)) / F.col("n"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for counts in gram_counts(batch.column("text")):
                made = unit_vectors(counts, idf)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(at, len(made)), pa.array([v.tobytes() for v in made], pa.binary())], ["lang", "vector"])
                at += len(made)

    def clustered(group: pa.Table) -> pa.Table:
        found = np.array([np.frombuffer(v, np.float32) for v in sorted(group.column("vector").to_pylist())])
        centres, least = cluster(found, k)
        lang = group.column("lang")[0].as_py()
        return pa.table({"lang": [lang] * len(centres), "centre": [c.tobytes() for c in centres], "least": pa.array(least, pa.float32())})

    drawn = cut(drawn.select("text", "lang").mapInArrow(vectors, "lang string, vector binary"), "vectors")
    found = drawn.groupBy("lang").applyInArrow(clustered, "lang string, centre binary, least float").collect()
    found = sorted(found, key=lambda r: (r["lang"], bytes(r["centre"])))
    if not found:
        return None
    centres = np.array([np.frombuffer(r["centre"], np.float32) for r in found])
    return Centroids([r["lang"] for r in found], centres, np.array([r["least"] for r in found], np.float32), idf)


def predict_languages(docs: DataFrame, model: Centroids | None, slack: float = 0.05) -> DataFrame:
    """doc_id, lang, nearest, score and rejected for every row of ``docs``.

    ``nearest`` is the language of the centroid with the greatest cosine,
    ``score`` that cosine (0 to 1). A text is ``rejected``, and its ``lang``
    ``und``, if the cosine is more than ``slack`` below what 99 % of the
    centroid's members have. Null texts and texts without a letter are ``und``
    in both columns with score 0, as are all without a model; ties go to the
    first language in code point order. Rows that repeat give repeated rows;
    only doc_id and text are read.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.when(letters, F.col("text")).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            some = np.asarray(texts.is_valid())
            best, score = np.zeros(len(some), np.int64), np.zeros(len(some))
            if model is not None:
                found = [unit_vectors(counts, model.idf) @ model.centres.T for counts in gram_counts(texts)]
                cosine = np.concatenate(found) if found else np.zeros((0, len(model.langs)))
                best, score = cosine.argmax(axis=1), np.clip(cosine.max(axis=1), 0, 1).astype(float)
            far = some & (score < model.least[best] - slack) if model is not None else np.zeros(len(some), bool)
            nearest = [model.langs[b] if ok and model is not None else UNKNOWN for b, ok in zip(best, some, strict=True)]
            lang = [UNKNOWN if f else n for n, f in zip(nearest, far, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(nearest, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(far)],
                ["doc_id", "lang", "nearest", "score", "rejected"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, lang string, nearest string, score double, rejected boolean")
