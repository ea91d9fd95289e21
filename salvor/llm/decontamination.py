"""Benchmark decontamination by latent semantic retrieval and exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvor.llm.licenses import license_words
from salvor.llm.words import Words, bounds_of, mix, pieces
from salvor.runtime import cut, release

BUCKETS, RANK, EXTRA, ROUNDS = 8192, 96, 8, 2
# The leading singular vectors tell languages and common words apart; they are left out.
SKIPPED = 8
# Words of the passages that the singular vectors are fitted on, passages that are multiplied
# at once, and sums of rows that stay in a core's cache, about.
PASSAGE, AT_ONCE, CACHED = 64, 8192, 512
# Rows that are added up one by one in a run; so many sums are then added up at once.
ADDED = 8
BLOCK = 8
# Words of a run by which passages are found without their vector.
RUN = 5
LEAST_COSINE = 0.3
# Shares of an item's words in the longest common subsequence: for a copy, and
# for a paraphrase that also has the item's answer.
COPY, PARAPHRASE, ANSWER_WORDS = 0.8, 0.6, 5
ITEMS_AT_ONCE = 20_000
# Bits of a word's hash by which a window's words are first held against an item's.
CODE_BITS = 12
# Bits of a word's hash in the signatures of blocks, and in the map of known runs.
SIGN_BITS, RUN_BITS = 9, 20
_SLICES = 32
_PIECE = 1 << 18


def _terms(words: Words) -> np.ndarray:
    return (words.hash >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _starts(bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of each block of ``step`` words; blocks end with their text."""
    counts = -(-np.diff(bounds) // step)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * step + bounds[owner]
    return owner, first


def _summed(frames: DataFrame, width: int, kind: type) -> np.ndarray:
    """The sum of the arrays of all tasks, added up in slices by further tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slice_, part in zip(batch.column("slice").to_pylist(), batch.column("part"), strict=True):
                sums[slice_] = sums.get(slice_, 0) + np.frombuffer(part.as_buffer(), kind)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "part": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    found = {r["slice"]: np.frombuffer(r["part"], kind) for r in frames.repartition(_SLICES, "slice").mapInArrow(add, "slice int, part binary").collect()}
    return np.concatenate([found[i] for i in range(_SLICES)]) if found else np.zeros(width, kind)


def _sliced(total: np.ndarray) -> pa.RecordBatch:
    parts = [p.tobytes() for p in np.split(total, _SLICES)]
    return pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES), pa.int32()), "part": pa.array(parts, pa.binary())})


def passages(docs: DataFrame) -> DataFrame:
    """terms and n of every different passage of 64 words that occurs n times; the last one of a text is as long as it is."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in pieces(batch.column("text")):
                words = license_words(raw, at)
                _, first = _starts(bounds_of(words.owner, len(at) - 1), PASSAGE)
                ends = pa.array(np.append(first, len(words.hash)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(_terms(words), pa.int16()))], ["terms"])

    return docs.select("text").mapInArrow(make, "terms array<short>").groupBy("terms").agg(F.count("*").alias("n"))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Terms of some passages at a time, where each begins, and which passage each term is of."""
    for low in range(0, len(batch), AT_ONCE):
        lists = batch.column("terms").slice(low, AT_ONCE)
        ends = np.asarray(lists.offsets).astype(np.int64)
        yield lists.flatten().to_numpy(), ends[:-1] - ends[0], np.repeat(np.arange(len(lists)), np.diff(ends))


def passage_frequencies(passages: DataFrame) -> tuple[np.ndarray, int, int]:
    """In how many passages each term bucket occurs, all passages, and the terms of the different ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + _SLICES, np.int64)
        for batch in batches:
            low, times = 0, batch.column("n").to_numpy()
            for terms, first, whose in _parts(batch):
                rows = np.full((len(first), PASSAGE), BUCKETS, np.int16)
                rows[whose, np.arange(len(terms)) - first[whose]] = terms
                rows.sort(axis=1)
                new = rows < BUCKETS
                new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
                own = times[low : low + len(first)]
                seen[:BUCKETS] += np.bincount(rows[new], np.repeat(own, new.sum(axis=1)), BUCKETS).astype(np.int64)
                low += len(first)
                seen[BUCKETS + 1] += len(terms)
            seen[BUCKETS] += times.sum()
        yield _sliced(seen)

    total = _summed(passages.mapInArrow(count, "slice int, part binary"), BUCKETS + _SLICES, np.int64)
    return total[:BUCKETS], int(total[BUCKETS]), int(total[BUCKETS + 1])


class Space:
    """Term vectors of a latent space: idf times right singular vectors over singular values."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors

    def of(self, terms: np.ndarray) -> np.ndarray:
        found = self.vectors[terms].sum(axis=0)
        return found / max(float(np.linalg.norm(found)), 1e-12)


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])


def _run_sums(table: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``table[index]`` over the runs that begin at ``first``; the last row of ``table`` is zero.

    Runs are cut into short pieces, whose rows are added place by place, for so many
    pieces at a time that their sums stay in the cache; then the sums of each run likewise.
    """
    while True:
        ends = np.append(first, len(index))
        whose, begin = _starts(ends, ADDED)
        place = begin + np.arange(min(ADDED, int(np.diff(ends).max(initial=1))))[:, None]
        rows = np.where(place < ends[whose + 1], index[np.minimum(place, len(index) - 1)], len(table) - 1).astype(np.intp)
        sums, row = np.zeros((len(begin) + 1, table.shape[1]), table.dtype), np.empty((CACHED, table.shape[1]), table.dtype)
        for low in range(0, len(begin), CACHED):
            high = min(low + CACHED, len(begin))
            table.take(rows[0, low:high], axis=0, out=sums[low:high], mode="clip")
            for own in rows[1:, low:high]:
                table.take(own, axis=0, out=row[: high - low], mode="clip")
                sums[low:high] += row[: high - low]
        if len(begin) == len(first):
            return sums[:-1]
        table, index, first = sums, np.arange(len(begin)), np.searchsorted(begin, first)


def fit_space(docs: DataFrame, rank: int = RANK, skipped: int = SKIPPED, seed: int = 11) -> Space:
    """Randomised SVD of the TF-IDF matrix A of all different passages.

    Each is one row, so that copies of a text do not rule the singular vectors;
    inverse document frequencies count it as often as it occurs. A random matrix is
    multiplied by A and by its transpose in tasks, and only sums of terms times rank
    leave them; after two rounds the products are those with an orthonormal basis,
    from which the singular vectors follow (Nystrom). The ``skipped`` leading
    directions are left out and coordinates are divided by the singular values, so
    that no direction (a language, say) outweighs the others.

    A task's sums take 7 MB however few passages it has, so a table that lies in many
    small parts is read by no more tasks than its terms take that room.
    """
    kept = cut(passages(docs), "passages")
    seen, total, size = passage_frequencies(kept)
    idf = np.log((1.0 + total) / (1.0 + seen)).astype(np.float32) + np.float32(0.1)
    width = rank + skipped + EXTRA
    # Terms are shorts, sums doubles.
    tasks = max(1, size * 2 // (BUCKETS * width * 8))

    def multiplied(basis: np.ndarray) -> np.ndarray:
        scaled, squares = _with_zero(basis * idf[:, None]), idf**2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS, width))
            for batch in batches:
                for terms, first, whose in _parts(batch):
                    rows = _run_sums(scaled, terms, first) / np.add.reduceat(squares[terms], first)[:, None]
                    order = np.argsort(terms, kind="stable")
                    kinds, begin = np.unique(terms[order], return_index=True)
                    total[kinds] += _run_sums(_with_zero(rows), whose[order], begin)
            yield _sliced((total * idf[:, None]).ravel())

        return _summed(kept.select("terms").coalesce(tasks).mapInArrow(run, "slice int, part binary"), BUCKETS * width, np.float64).reshape(-1, width)

    basis = np.random.default_rng(seed).standard_normal((BUCKETS, width)).astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(basis)[0].astype(np.float32)
        last, basis = basis, multiplied(basis)
    release(kept)
    values, turn = np.linalg.eigh((last.T @ basis + basis.T @ last) / 2)
    able = values > max(float(values[-1]), 1e-9) * 1e-6
    vectors, values, _ = np.linalg.svd(basis @ (turn * np.where(able, np.where(able, values, 1) ** -0.5, 0)), full_matrices=False)
    best = slice(skipped, skipped + rank)
    scale = 1 / np.maximum(values[best], max(float(values[best].max()), 1e-9) * 1e-1)
    return Space((vectors[:, best] * scale * idf[:, None]).astype(np.float32))


def common_length(masks: dict[int, int], text: list[int]) -> int:
    """Length of the longest common subsequence, from bit masks of the item's words."""
    row = 0
    for word in text:
        seen = row | masks.get(word, 0)
        row = seen & ~(seen - ((row << 1) | 1))
    return row.bit_count()


class Items:
    """Benchmark items: words, latent vector, answer, and the window they are sought in.

    An item of m words is compared with windows of the least power of two w with
    m <= 3/4 w (32 at least), one at every quarter of w, so that a passage of its
    length lies in one window and fills 3/8 of it or more; items below 12 words
    fill less. Runs of five words of an item (the whole of a shorter one) are also
    looked up as they stand, whatever is around them.
    """

    def __init__(self, rows: list, space: Space):
        self.ids, self.words, self.answers, self.windows, vectors, self.masks = [], [], [], [], [], []
        for item_id, text, answer in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = license_words(raw, np.array([0, len(raw)]))
            if not len(words.hash):
                continue
            given = np.frombuffer((answer or "").encode(), np.uint8)
            own = license_words(given, np.array([0, len(given)])).hash.tolist() or words.hash[-ANSWER_WORDS:].tolist()
            masks: dict[int, int] = {}
            for i, word in enumerate(words.hash.tolist()):
                masks[word] = masks.get(word, 0) | 1 << i
            self.ids.append(item_id)
            self.words.append(words.hash.tolist())
            self.answers.append(own)
            self.windows.append(max(32, 1 << (math.ceil(len(words.hash) * 4 / 3) - 1).bit_length()))
            self.masks.append(masks)
            vectors.append(space.of(_terms(words)))
        self.sizes = np.array([len(w) for w in self.words])
        self.codes = np.full((len(self.words), max(map(len, self.words), default=1)), 1 << CODE_BITS)
        for i, words in enumerate(self.words):
            self.codes[i, : len(words)] = (np.array(words, np.uint64) >> np.uint64(64 - CODE_BITS)).astype(np.int64)
        signs = np.zeros((len(self.words), 1 << SIGN_BITS), bool)
        for i, words in enumerate(self.words):
            signs[i, _sign_bits(np.array(words, np.uint64))] = True
        self.signs = _packed(signs)
        self.vectors = np.array(vectors, np.float32).reshape(len(vectors), space.vectors.shape[1])
        self.runs, self.run_map = {}, {}
        for size in sorted({min(RUN, len(w)) for w in self.words}):
            own = [(h, i, at) for i, w in enumerate(self.words) if min(RUN, len(w)) == size for at, h in enumerate(_runs(np.array(w, np.uint64), size).tolist())]
            own = sorted(own)
            self.run_map[size] = np.zeros(1 << RUN_BITS, bool)
            self.run_map[size][[h >> 64 - RUN_BITS for h, _, _ in own]] = True
            self.runs[size] = np.array([h for h, _, _ in own], np.uint64), np.array([i for _, i, _ in own]), np.array([at for _, _, at in own])

    def standing(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and where the item would begin, for the places at which a run of an item stands."""
        whose, which, begins = [], [], []
        for size, (known, item, offset) in self.runs.items():
            found = _runs(words, size)
            place = np.flatnonzero(self.run_map[size][found >> np.uint64(64 - RUN_BITS)])
            text = np.searchsorted(bounds, place, side="right") - 1
            place, text = place[place + size <= bounds[text + 1]], text[place + size <= bounds[text + 1]]
            low, high = np.searchsorted(known, found[place]), np.searchsorted(known, found[place], side="right")
            count = high - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            text, place = np.repeat(text, count), np.repeat(place, count)
            whose.append(text)
            which.append(item[at])
            begins.append(np.maximum(place - offset[at], bounds[text]))
        if not whose:
            return (np.zeros(0, np.int64),) * 3
        rows = np.unique(np.stack([np.concatenate(x) for x in (whose, which, begins)]), axis=1)
        return rows[0], rows[1], rows[2]

    def may_stand(self, which: np.ndarray, signs: np.ndarray, rows: np.ndarray, least: float) -> np.ndarray:
        """Whether the least share of an item's words can stand in the windows with these signatures.

        Each bit of an item's signature that a window's lacks is a word that does not
        stand there, so none is missed.
        """
        out = np.zeros(len(which), bool)
        for low in range(0, len(which), 1 << 15):
            part = slice(low, low + (1 << 15))
            lacking = np.bitwise_count(self.signs[which[part]] & ~signs[rows[part]]).sum(axis=1, dtype=np.int64)
            out[part] = self.sizes[which[part]] - lacking >= least * self.sizes[which[part]]
        return out

    def may_match(self, which: np.ndarray, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, width: int, least: float) -> np.ndarray:
        """Whether the least share of an item's words stands between start and stop.

        No common subsequence is longer than the number of the item's words that
        stand there; words are compared by some bits of their hash, so none is missed.
        """
        out, none = np.zeros(len(which), bool), 1 << CODE_BITS
        for low in range(0, len(which), 4096):
            part = slice(low, low + 4096)
            first, row = np.unique(starts[part], return_inverse=True)
            last = np.zeros(len(first), np.int64)
            last[row] = stops[part]
            place = first[:, None] + np.arange(width)
            there = np.zeros((len(first), none + 1), bool)
            there[np.arange(len(first))[:, None], np.where(place < last[:, None], codes[np.minimum(place, len(codes) - 1)], none)] = True
            there[:, none] = False
            own = there[row[:, None], self.codes[which[part]]]
            out[part] = own.sum(axis=1) >= least * self.sizes[which[part]]
        return out

    def matches(self, item: int, text: list[int], copy: float, paraphrase: float) -> tuple[float, bool] | None:
        """The share of the item's words in common with the text, and whether it has the answer."""
        masks = self.masks[item]
        share = common_length(masks, text) / len(self.words[item])
        if share < min(copy, paraphrase):
            return None
        answer = self.answers[item]
        has = any(text[i : i + len(answer)] == answer for i in range(len(text) - len(answer) + 1))
        return (share, has) if share >= copy or share >= paraphrase and has else None


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = max(len(words) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out ^ words[i : i + n], 7)
    return out


def _sign_bits(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SIGN_BITS)).astype(np.int64)


def _packed(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs, axis=1).view(np.uint64)


def _window_signs(blocks: np.ndarray, owner: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Signatures from one step before each beginning to five steps after it, inside its text."""
    steps = np.bitwise_or.reduceat(blocks, begin, axis=0)
    total, whose = steps.copy(), owner[begin]
    for i in range(1, 5):
        total[:-i] |= np.where((whose[:-i] == whose[i:])[:, None], steps[i:], np.uint64(0))
    total[1:] |= np.where((whose[1:] == whose[:-1])[:, None], steps[:-1], np.uint64(0))
    return total


def _block_sums(vectors: np.ndarray, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the vectors of each block's terms, and a row of zeros; the last row of ``vectors`` is zero."""
    size = np.append(np.diff(np.append(first, len(terms))), 0)
    first, padded = np.append(first, len(terms)), np.append(terms, len(vectors) - 1)
    total, term = vectors[padded[first]], np.empty((len(first), vectors.shape[1]), vectors.dtype)
    for i in range(1, BLOCK):
        np.take(vectors, np.where(i < size, padded[np.minimum(first + i, len(terms))], len(vectors) - 1), axis=0, out=term, mode="clip")
        total += term
    return total


def _run_of(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, count: int) -> np.ndarray:
    """Sums of the ``count`` rows from each beginning on that lie before its end; the last row of ``sums`` is zero."""
    total, row = sums[begin], np.empty((len(begin), sums.shape[1]), sums.dtype)
    for i in range(1, count):
        at = begin + i
        np.take(sums, np.where(at < end, at, len(sums) - 1), axis=0, out=row, mode="clip")
        total += row
    return total


def _search(docs: DataFrame, items: Items, space: Space, least: float, copy: float, paraphrase: float) -> DataFrame:
    vectors = _with_zero(space.vectors)
    sizes = {w: np.array([i for i, own in enumerate(items.windows) if own == w]) for w in sorted(set(items.windows))}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], tuple] = {}

            def check(low, bounds, codes, hashes, window, whose, which, starts, stops, cosine, terms=None):
                able = items.may_match(which, codes, starts, stops, window + window // 2, min(copy, paraphrase))
                for k in np.flatnonzero(able):
                    text, item, start, stop = int(whose[k]), int(which[k]), int(starts[k]), int(stops[k])
                    old = found.get((low + text, item))  # noqa: B023
                    if old and old[0] == 1:
                        continue
                    match = items.matches(item, hashes[start:stop].tolist(), copy, paraphrase)
                    if match and (not old or match[0] > old[0]):
                        if terms is None:
                            near = float(cosine[k])
                        else:
                            own = vectors[terms[start:stop]].sum(axis=0)
                            near = float(own @ items.vectors[item] / max(float(np.linalg.norm(own)), 1e-12))
                        found[low + text, item] = (*match, near, start - int(bounds[text]))  # noqa: B023

            for low, _, raw, at in pieces(batch.column("text"), _PIECE):
                words = license_words(raw, at)
                bounds = bounds_of(words.owner, len(at) - 1)
                owner, first = _starts(bounds, BLOCK)
                if not len(first):
                    continue
                codes = (words.hash >> np.uint64(64 - CODE_BITS)).astype(np.int64)
                signs = np.zeros((len(first), 1 << SIGN_BITS), bool)
                signs[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words.hash)))), _sign_bits(words.hash)] = True
                signs = _packed(signs)
                blocks = _block_sums(vectors, _terms(words), first)
                block_end = np.searchsorted(owner, np.arange(len(at) - 1), side="right")
                begin_of = np.searchsorted(owner, np.arange(len(at) - 1))
                for window, group in sizes.items():
                    step = window // 4 // BLOCK
                    begin = np.flatnonzero((np.arange(len(owner)) - begin_of[owner]) % step == 0)
                    steps = _with_zero(_run_of(blocks, begin, block_end[owner[begin]], step))
                    rows = _run_of(steps, np.arange(len(begin)), np.searchsorted(owner[begin], owner[begin], side="right"), 4)
                    rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None], 1e-12)
                    cosine = rows @ items.vectors[group].T
                    r, c = np.divmod(np.flatnonzero(cosine >= least), len(group))
                    able = items.may_stand(group[c], _window_signs(signs, owner, begin), r, min(copy, paraphrase))
                    r, c = r[able], c[able]
                    whose, at_word = owner[begin[r]], first[begin[r]]
                    starts = np.maximum(at_word - window // 4, bounds[whose])
                    stops = np.minimum(at_word + window + window // 4, bounds[whose + 1])
                    check(low, bounds, codes, words.hash, window, whose, group[c], starts, stops, cosine[r, c])
                whose, which, begins = items.standing(words.hash, bounds)
                for window in sizes:
                    own = np.flatnonzero(np.array(items.windows)[which] == window)
                    at_word, texts, group = begins[own], whose[own], which[own]
                    starts = np.maximum(at_word - window // 4, bounds[texts])
                    stops = np.minimum(at_word + window + window // 4, bounds[texts + 1])
                    check(low, bounds, codes, words.hash, window, texts, group, starts, stops, None, _terms(words))
            keys, values = sorted(found), [found[k] for k in sorted(found)]
            column = lambda i, kind: pa.array([v[i] for v in values], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64())), pa.array([items.ids[k[1]] for k in keys], pa.int64()), column(0, pa.float64()), column(1, pa.bool_()), column(2, pa.float64()), column(3, pa.int64())],
                ["doc_id", "item_id", "share", "has_answer", "cosine", "first_word"],
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(search, f"doc_id {kind}, item_id long, share double, has_answer boolean, cosine double, first_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_COSINE, copy: float = COPY, paraphrase: float = PARAPHRASE) -> DataFrame:
    """doc_id, item_id, share, has_answer, cosine, first_word of every match.

    Words are runs of letters and digits, A-Z lowered. All windows of all texts
    are compared with the benchmark's items by cosine in a latent space (see
    ``fit_space``); those at ``least`` or above are checked, and all windows in
    which five words of the item stand in a row: a text matches an
    item if the longest common subsequence of words has ``copy`` of the item's
    words, or ``paraphrase`` of them when the item's answer also stands in the
    passage. The answer is the item's column ``answer`` if there is one, else
    its last five words. The best passage of each text is reported.

    Items are taken in blocks, every block against all texts. Null and empty
    texts and items match nothing; repeated rows match each. Other columns are
    not read. An empty table on either side gives no rows.
    """
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"), answer.alias("answer")).where("text is not null")
    blocks = max(1, math.ceil(items.count() / ITEMS_AT_ONCE))
    space, out = fit_space(docs), None
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        rows = items.where(block_of == block).orderBy("item_id", "text").collect()
        found = _search(docs, Items([tuple(r) for r in rows], space), space, least, copy, paraphrase)
        out = found if out is None else out.unionByName(found)
    return out
