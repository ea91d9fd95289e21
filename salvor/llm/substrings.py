"""Repeated passages by matching statistics over an FM-index per shard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvor.llm.fm_index import FMIndex
from salvor.llm.words import bounds_of, list_array, mix, pieces, signed, windows, words_of
from salvor.runtime import cut, cut_counted

WINDOW = 35
GRAM = 8
# Words that one shard indexes, about; more text makes more shards.
SHARD_WORDS = 1 << 20


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    return mix(windows(words, gram), 5)


def window_keys(least: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` gram hashes: equal windows of words, equal keys."""
    wide = 1
    while wide * 2 <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    return np.minimum(least[: len(least) - (span - wide)], least[span - wide :])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end index of each run of equal keys."""
    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], change]), np.concatenate([change, [len(keys)]])


def _digest(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _documents(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, raw, at in pieces(texts):
        words = words_of(raw, at)
        bounds = bounds_of(words.owner, len(at) - 1)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            yield words.hash[low:high]


def _outlines(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """one, two, doc_id, n_words, digest of the words, and the keys of the runs of windows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for words in _documents(batch.column("text")):
                sizes.append(len(words))
                digests.append(_digest(words))
                if len(words) < window:
                    keys.append(np.zeros(0, np.int64))
                    continue
                grams = gram_hashes(words, gram)
                own = window_keys(grams, window - gram + 1)
                own = own[_runs(own)[0]]
                # A run may hold a gram twice and so equal windows: its key counts once more.
                grams.sort()
                twice = grams[1:][grams[1:] == grams[:-1]]
                keys.append(signed(np.concatenate([own, own[np.isin(own, twice)]]) if len(twice) else own))
            names = ["one", "two", "doc_id"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), list_array(keys)], [*names, "n_words", "digest", "keys"])

    return docs.mapInArrow(make, "one long, two long, doc_id long, n_words long, digest binary, keys array<long>")


def _segments(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """one, two, first, key, words and digest of the runs of windows whose key is wanted."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, copies = (batch.column(name).to_pylist() for name in ("one", "two", "copies"))
            wanted = batch.column("wanted")
            out: dict[str, list] = {name: [] for name in ("one", "two", "first", "key", "words", "digest", "copies")}
            for i, words in enumerate(_documents(batch.column("text"))):
                own = window_keys(gram_hashes(words, gram), window - gram + 1)
                first, end = _runs(own)
                keep = np.isin(signed(own[first]), np.array(wanted[i].values))
                for low, high in zip(first[keep], end[keep], strict=True):
                    part = words[low : high + window - 1]
                    out["one"].append(one[i])
                    out["two"].append(two[i])
                    out["first"].append(int(low))
                    out["key"].append(int(signed(own[low : low + 1])[0]))
                    out["words"].append(part.tobytes())
                    out["digest"].append(_digest(part))
                    out["copies"].append(copies[i])
            kinds = {"one": pa.int64(), "two": pa.int64(), "first": pa.int32(), "key": pa.int64(), "words": pa.binary(), "digest": pa.binary(), "copies": pa.int64()}
            yield pa.RecordBatch.from_pydict({name: pa.array(out[name], kind) for name, kind in kinds.items()})

    return texts.mapInArrow(make, "one long, two long, first int, key long, words binary, digest binary, copies long")


def _search(shards: DataFrame, window: int) -> DataFrame:
    """digest and the starts of repeated windows, for segments that occur once.

    One partition is one shard: its segments are indexed together and streamed
    against the index.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, copies, parts = [], [], []
        for batch in batches:
            digests += batch.column("digest").to_pylist()
            copies += batch.column("copies").to_pylist()
            parts += [np.frombuffer(w.as_buffer(), np.uint64) for w in batch.column("words")]
        if not parts:
            return
        sizes = np.array([len(p) for p in parts])
        stop = np.cumsum(sizes + 1)
        start = stop - sizes - 1
        known, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        text = np.zeros(int(stop[-1]), np.int64)
        solid = np.ones(len(text), bool)
        solid[stop - 1] = False
        text[solid] = inverse + 1
        once = np.flatnonzero(np.array(copies) == 1)
        ends = [np.arange(start[i] + window - 1, stop[i] - 1) for i in once]
        if not ends:
            return
        counts = np.array([len(e) for e in ends])
        found = FMIndex(text, len(known) + 1, window + 1).matching_statistics(text, np.concatenate(ends), window) >= window
        at = np.concatenate([[0], np.cumsum(counts)])
        out = [np.flatnonzero(found[at[j] : at[j + 1]]) for j in range(len(once))]
        hit = [j for j in range(len(once)) if len(out[j])]
        yield pa.RecordBatch.from_arrays([pa.array([digests[once[j]] for j in hit], pa.binary()), list_array([out[j] for j in hit], pa.int32())], ["digest", "starts"])

    return shards.mapInArrow(search, "digest binary, starts array<int>")


def _single_windows(segments: DataFrame, window: int) -> DataFrame:
    """The same for segments of very frequent keys, by counting their windows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, copies, words in zip(batch.column("digest"), batch.column("copies"), batch.column("words"), strict=True):
                found = windows(np.frombuffer(words.as_buffer(), np.uint64), window)
                other = windows(mix(np.frombuffer(words.as_buffer(), np.uint64), 91), window)
                n = len(found)
                columns = [pa.array([digest.as_py()] * n, pa.binary()), pa.array(np.arange(n), pa.int32()), pa.array(signed(found)), pa.array(signed(other)), pa.array(np.full(n, copies.as_py()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "start", "one", "two", "copies"])

    rows = segments.mapInArrow(make, "digest binary, start int, one long, two long, copies long")
    # Written, so that the join has exchanges of its own and a very frequent window can be split.
    several = cut(rows.groupBy("one", "two").agg(F.sum("copies").alias("copies")).where("copies > 1").select("one", "two"), "windows")
    found = rows.where("copies = 1").join(several, ["one", "two"], "left_semi")
    return found.groupBy("digest").agg(F.collect_list("start").alias("starts"))


def _keyed(docs: DataFrame) -> DataFrame:
    """one, two, doc_id, text: two hashes of doc_id and text that name a row (and its repetitions)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct("doc_id", F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"))
    return rows.select(F.xxhash64(key).alias("one"), F.xxhash64(F.lit("second"), key).alias("two"), "doc_id", "text")


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """one, two, doc_id, n_words, all_repeated, starts for every doc_id and text: what repeats.

    ``one`` and ``two`` name a row by hashes of its doc_id and text.
    ``starts`` are the first words of the windows of ``window`` words whose word
    sequence starts at another place too, in this text or any other.
    ``all_repeated`` says that the whole text does, because another row has the
    same words; its starts are not listed.

    1. Rows with equal words are one class. A class of several rows with
       ``window`` words or more is repeated as a whole.
    2. Every window has a key, the least hash of its 8-word grams, so equal
       windows have equal keys. Runs of windows with a key that occurs in one
       place only are unique and go no further.
    3. The other runs become segments. Equal segments are counted as one. All
       segments of a key go to one shard; a shard's segments are put in an
       FM-index and each is streamed against it, which gives the longest match
       that ends at each word. Matches of ``window`` words that occur twice are
       reported.
    4. A key whose segments fill a quarter of ``shard_words``, as around a passage
       that very many texts share, has its windows counted one by one instead.

    Null and empty texts have no words; texts of fewer words than the window
    have no windows. Repeated rows are equal texts. Rows are told apart by doc_id
    and text, so a null or repeated doc_id changes nothing. Other columns are not
    read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = _keyed(docs)
    outlines = cut(_outlines(docs, window, gram), "outlines")
    # A class is represented by one of its rows; rows that repeat it wholly only count its keys again.
    classes = outlines.where(F.col("n_words") >= window).groupBy("digest").agg(F.min(F.struct("one", "two")).alias("row"), F.count("*").alias("copies"))
    classes = cut(classes.select("digest", "row.one", "row.two", "copies"), "classes")
    firsts = outlines.join(classes, ["digest", "one", "two"])
    keys = firsts.select("one", "two", "copies", F.explode("keys").alias("key"))
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = keys.join(several, "key", "left_semi").groupBy("one", "two").agg(F.collect_set("key").alias("wanted"), F.first("copies").alias("copies"))
    segments = cut(_segments(docs.drop("doc_id").join(wanted, ["one", "two"]), window, gram), "segments")
    distinct = segments.groupBy("digest").agg(F.first("key").alias("key"), F.first("words").alias("words"), F.sum("copies").alias("copies"))
    distinct = cut(distinct, "distinct")
    length = (F.octet_length("words") / 8).cast("long")
    total = distinct.agg(F.sum(length)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / shard_words))
    frequent = distinct.groupBy("key").agg(F.sum(length).alias("n")).where(F.col("n") > max(4 * window, shard_words // 4)).select("key")
    frequent = cut(frequent, "frequent")
    rare = distinct.join(frequent, "key", "left_anti").repartition(shards, "key")
    found = _search(rare.select("digest", "copies", "words"), window)
    found = found.unionByName(_single_windows(distinct.join(frequent, "key", "left_semi").select("digest", "copies", "words"), window))
    whole = distinct.where("copies > 1").select("digest", F.sequence(F.lit(0), (F.octet_length("words") / 8).cast("int") - window).alias("starts"))
    found = cut(found.unionByName(whole), "found")
    spans = segments.where("copies = 1").select("one", "two", "first", "digest").join(found, "digest")
    spans = spans.select("one", "two", F.transform("starts", lambda s: s + F.col("first")).alias("starts"))
    spans = spans.groupBy("one", "two").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    copies = classes.where("copies > 1").select("digest", F.lit(True).alias("again"))
    sizes = outlines.select("one", "two", "doc_id", "n_words", "digest").join(copies, "digest", "left")
    sizes = sizes.groupBy("one", "two", "doc_id").agg(F.max("n_words").alias("n_words"), F.max(F.coalesce("again", F.lit(False))).alias("all_repeated"))
    joined = sizes.join(spans, ["one", "two"], "left")
    return joined.select("one", "two", "doc_id", "n_words", "all_repeated", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))


def remove_repeats(docs: DataFrame, passages: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by a space) for every row."""
    rows = _keyed(docs).join(passages.select("one", "two", "all_repeated", "starts"), ["one", "two"], "left").drop("one", "two")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, everything, starts in zip(batch.column("text"), batch.column("all_repeated").to_pylist(), batch.column("starts"), strict=True):
                words = text.as_py().encode().split()
                totals.append(len(words))
                if everything and len(words) >= window:
                    removed.append(len(words))
                    kept.append("")
                    continue
                first = np.array(starts.values) if starts.is_valid else np.zeros(0, np.int64)
                if len(first):
                    depth = np.zeros(len(words) + window + 1, np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, first + window, -1)
                    covered = np.cumsum(depth)[: len(words)] > 0
                    words = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(make, "doc_id long, n_words long, n_removed long, kept string")
