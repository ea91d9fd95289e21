"""Links between the tokens of two tokenizers, as products of incidence matrices."""

from __future__ import annotations

import gc
import hashlib
import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvor.llm.words import pieces
from salvor.runtime import cut

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how the byte-level tokenizer divides a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Text that is worked on together, and encoded parts that a worker keeps, if they are short.
PIECE, KEPT, KEPT_CHARS = 1 << 21, 1 << 17, 32
# A single space between two signs that are no white space. Tokens of both sides end
# before it: neither has an entry with a space behind another sign.
_BETWEEN, _SIGN_SPACE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\S ")
# An id pair with at least this share of all (document, pair) rows is looked up on
# the mappers; there can be no more such pairs than one over the share.
LOOKED_UP = 1 / (1 << 20)
_HELD = 1 << 22


class CSR(NamedTuple):
    """A sparse matrix of counts by rows: row i has the columns indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    counts: np.ndarray
    width: int


def incidence(first: np.ndarray, last: np.ndarray, width: int) -> CSR:
    """Rows of ones: row i has the columns first[i] to last[i] - 1."""
    sizes = last - first
    indptr = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=indptr[1:])
    indices = np.arange(indptr[-1]) + np.repeat(first - indptr[:-1], sizes)
    return CSR(indptr, indices, np.ones(len(indices), np.int64), width)


def transposed(m: CSR) -> CSR:
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    order = slice(None) if _sorted(m.indices) else np.argsort(m.indices, kind="stable")
    indptr = np.zeros(m.width + 1, np.int64)
    np.cumsum(np.bincount(m.indices, minlength=m.width), out=indptr[1:])
    return CSR(indptr, rows[order], m.counts[order], len(m.indptr) - 1)


def _sorted(values: np.ndarray) -> bool:
    return bool((values[1:] >= values[:-1]).all())


def product_sizes(a: CSR, b: CSR) -> np.ndarray:
    """How many terms each row of the product adds up."""
    terms = np.zeros(len(a.indices) + 1, np.int64)
    np.cumsum(np.diff(b.indptr)[a.indices], out=terms[1:])
    return terms[a.indptr[1:]] - terms[a.indptr[:-1]]


def product(a: CSR, b: CSR) -> CSR:
    """a times b by Gustavson's rule: row i adds up the rows of b that row i of a names."""
    sizes = np.diff(b.indptr)[a.indices]
    row = np.repeat(np.repeat(np.arange(len(a.indptr) - 1), np.diff(a.indptr)), sizes)
    at = np.arange(len(row)) + np.repeat(b.indptr[a.indices] - (np.cumsum(sizes) - sizes), sizes)
    return _accumulated(row * b.width + b.indices[at], np.repeat(a.counts, sizes) * b.counts[at], len(a.indptr) - 1, b.width)


def _accumulated(key: np.ndarray, value: np.ndarray, rows: int, width: int) -> CSR:
    """The matrix of the sums of equal keys; a key is row times width plus column."""
    if not _sorted(key):
        order = np.argsort(key)
        key, value = key[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    indptr = np.searchsorted(key[new], np.arange(rows + 1) * width)
    counts = np.add.reduceat(value, new) if len(new) else np.zeros(0, np.int64)
    return CSR(indptr, key[new] % max(width, 1), counts, width)


class Tokenizers:
    """The two tokenizers, the bytes of their entries, and the ids of parts seen lately."""

    def __init__(self, folder: str):
        import os

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._bytes = Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        self._bytes.encode_special_tokens = True
        letters, added = _byte_letters(), {t.content for t in self._bytes.get_added_tokens_decoder().values()}
        vocabulary = self._bytes.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.bytes_a[number] = entry.encode() if entry in added else bytes(letters[c] for c in entry)
        # Entries merge in the order of their ids, so short parts may go through the faster library.
        ranks = {entry: number for number, entry in enumerate(self.bytes_a) if entry.decode(errors="replace") not in added}
        self._ranks = tiktoken.Encoding("by_rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        self.bytes_b = [_piece_bytes(self._pieces, i) for i in range(self._pieces.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.divisible = not any(_SIGN_SPACE.search(entry.decode(errors="replace")) for entry in self.bytes_a + self.bytes_b)
        # Ids as text, each with the sign after it: within a side, after side a, after side b.
        self.names = np.array([f"{i}{sign}" for sign in ",|;" for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)
        self._new, self._old = {}, {}

    def encode(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids (32 bits each) of a space and the part by either side; None where the bytes differ."""
        new, old, rest, out = self._new, self._old, [], [None] * len(parts)
        for i, part in enumerate(parts):
            found = new.get(part, rest)
            if found is rest:
                found = old.get(part, rest)
                if found is rest:
                    rest.append(i)
                    continue
                new[part] = found
            out[i] = found
        wanted = [parts[i] for i in rest]
        spaced = [" " + part for part in wanted]
        ids_a, ids_b = self._encode_a(spaced), self._pieces.encode(wanted, num_threads=1)
        raws = [part.encode() for part in spaced]
        same = [_same(self.bytes_a, self.sizes_a, ids_a, raws), _same(self.bytes_b, self.sizes_b, ids_b, raws)]
        for i, part, a, b, good in zip(rest, wanted, ids_a, ids_b, (same[0] & same[1]).tolist(), strict=True):
            out[i] = found = (array("i", a).tobytes(), array("i", b).tobytes()) if good else None
            if len(part) <= KEPT_CHARS:
                new[part] = found
        # Two generations: what was not asked for while one filled up is let go.
        if len(new) >= KEPT:
            self._new, self._old = {}, new
        return out

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        fast, whole = self._ranks.encode_ordinary, self._bytes.encode
        return [fast(t) if len(t) <= KEPT_CHARS else whole(t, add_special_tokens=False).ids for t in texts]


def _same(table: list[bytes], sizes: np.ndarray, ids: list[list[int]], raws: list[bytes]) -> np.ndarray:
    """Whether the bytes of each list of ids are those wanted."""
    flat = np.fromiter(chain.from_iterable(ids), np.int64)
    ends = np.cumsum([len(x) for x in ids]) if ids else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(sizes[flat])])[ends] if len(ends) else ends
    if b"".join(map(table.__getitem__, flat.tolist())) == b"".join(raws) and (at == np.cumsum([len(r) for r in raws])).all():
        return np.ones(len(ids), bool)
    return np.array([b"".join(map(table.__getitem__, x)) == raw for x, raw in zip(ids, raws, strict=True)], bool)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if it can be seen, else the next one from 256."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(model, number: int) -> bytes:
    piece = model.id_to_piece(number)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode()


def tokenizers(folder: str) -> Tokenizers:
    """One pair for each process: tasks come with functions of their own, but share ``sys``."""
    made = vars(sys).setdefault("_salvor_tokenizers", {})
    if folder not in made:
        made[folder] = Tokenizers(folder)
    return made[folder]


class Aligned(NamedTuple):
    """Tokens of some parts: ids, owners and groups of either side, the owner of each group,
    links as (token of a, token of b), and how many b tokens share the group of each a token."""

    a: np.ndarray
    owner_a: np.ndarray
    group_a: np.ndarray
    b: np.ndarray
    owner_b: np.ndarray
    group_b: np.ndarray
    groups: np.ndarray
    links: tuple[np.ndarray, np.ndarray]
    shared: np.ndarray


def align(parts: list[tuple[bytes, bytes] | None], both: Tokenizers) -> Aligned:
    """Groups and links of encoded parts, by products of their incidence matrices."""
    found = [part or (b"", b"") for part in parts]
    sides = [[part[side] for part in found] for side in (0, 1)]
    a, b = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in sides)
    owner_a, owner_b = (np.repeat(np.arange(len(x)), [len(ids) // 4 for ids in x]) for x in sides)
    size_a, size_b = both.sizes_a[a], both.sizes_b[b]
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    width = int(size_a.sum())
    overlap = product(incidence(end_a - size_a, end_a, width), transposed(incidence(end_b - size_b, end_b, width)))
    # Offsets where tokens of both sides end divide the bytes into groups.
    ends = np.zeros(width + 1, np.int8)
    ends[end_a] += 1
    ends[end_b] += 2
    before = np.zeros(width + 2, np.int64)
    np.cumsum(ends == 3, out=before[1:])
    group_a, group_b, n_groups = before[end_a], before[end_b], int(before[-1])
    by_group = transposed(incidence(group_b, group_b + 1, n_groups))
    shared = product_sizes(incidence(group_a, group_a + 1, n_groups), by_group)
    links = np.repeat(np.arange(len(a)), np.diff(overlap.indptr)), overlap.indices
    return Aligned(a, owner_a, group_a, b, owner_b, group_b, owner_a[ends[end_a] == 3], links, shared)


def shared_links(found: Aligned) -> CSR:
    """Which b tokens stand in the group of each a token: the product of the group incidences."""
    groups = len(found.groups)
    one = incidence(found.group_a, found.group_a + 1, groups)
    return product(one, transposed(incidence(found.group_b, found.group_b + 1, groups)))


def _group_texts(found: Aligned, names: np.ndarray, n: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3;`` of each of n parts."""
    size = len(names) // 3
    side = np.concatenate([found.group_a * 2, found.group_b * 2 + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
    sign = np.where(last, 1 + side % 2, 0)
    words = names[np.concatenate([found.a, found.b])[order] + sign * size].tolist()
    bounds = np.searchsorted(np.concatenate([found.owner_a, found.owner_b])[order], np.arange(n + 1)).tolist()
    return ["".join(words[low:high]) for low, high in zip(bounds[:-1], bounds[1:], strict=True)]


class Alignment(NamedTuple):
    """Of some texts: n_a, n_b, n_groups, n_links, n_shared; digests; and the distinct id pairs
    with how often each is linked, as a matrix of texts by pairs."""

    counts: list[np.ndarray]
    digests: list[str]
    pairs: CSR


def align_texts(texts: list[str], both: Tokenizers) -> Alignment:
    """Texts are divided where tokens of both sides must end; each distinct part is aligned once."""
    number: dict[str, int] = defaultdict(count().__next__)
    split = [(_BETWEEN.split(t) if both.divisible else [t]) if t else [] for t in texts]
    which = [list(map(number.__getitem__, parts)) for parts in split]
    encoded = both.encode(list(number))
    bad = np.array([x is None for x in encoded], bool)
    if bad.any():
        which = [[] if x and bad[x].any() else x for x in which]
    n, size_a, size_b = len(number), len(both.bytes_a), len(both.bytes_b)
    found = align(encoded, both)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in which])
    uses = np.fromiter(chain.from_iterable(which), np.int64, len(owner))
    at_a, at_b = found.links
    each = [np.bincount(x, minlength=n) for x in (found.owner_a, found.owner_b, found.groups, found.owner_a[at_a])]
    each.append(np.bincount(found.owner_a, weights=found.shared, minlength=n).astype(np.int64))
    counts = [np.bincount(owner, weights=x[uses], minlength=len(texts)).astype(np.int64) for x in each]
    words = _group_texts(found, both.names, n)
    digests = [hashlib.sha256("".join([words[i] for i in x])[:-1].encode()).hexdigest() if x else "" for x in which]
    key = found.owner_a[at_a] * (size_a * size_b) + found.a[at_a] * size_b + found.b[at_b]
    of_part = _accumulated(key, np.ones(len(key), np.int64), n, size_a * size_b)
    of_text = _accumulated(owner * n + uses, np.ones(len(uses), np.int64), len(texts), n)
    return Alignment(counts, digests, product(of_text, of_part))


def align_documents(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, pairs, times by document.

    ``pairs`` are the distinct linked id pairs (id of a times the size of b's
    vocabulary, plus id of b), ``times`` how often each is linked. The table is
    written once, so ``row`` numbers its rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(folder)
        # Very many small objects and no cycles: collecting would only search them.
        gc.disable()
        for batch in batches:
            for low, high, _, _ in pieces(batch.column("text"), PIECE):
                found = align_texts(batch.column("text").slice(low, high - low).to_pylist(), both)
                bounds = pa.array(found.pairs.indptr.astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (found.pairs.indices, found.pairs.counts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low), *map(pa.array, found.counts), pa.array(found.digests, pa.string()), *lists],
                    ["row", "doc_id", *names, "groups_sha256", "pairs", "times"],
                )
        gc.enable()

    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{name} long" for name in names)
    return cut(rows.mapInArrow(make, f"row long, doc_id {kind}, {fields}, groups_sha256 string, pairs array<long>, times array<int>"), "aligned")


def count_pairs(aligned: DataFrame, folder: str = FOLDER) -> DataFrame:
    """pair, n, best: in how many documents an id pair is linked, and whether no pair of its a id has more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0
        for batch in batches:
            found, n = np.unique(batch.column("pairs").flatten().to_numpy(), return_counts=True)
            held.append(found)
            counts.append(n)
            size += len(found)
            if size > _HELD:
                held, counts = map(lambda x: [x], _summed(held, counts))
                size = len(held[0])
                if size > _HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(counts[0])], ["pair", "n"])
                    held, counts, size = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _summed(held, counts))), ["pair", "n"])

    size_b = len(tokenizers(folder).bytes_b)
    sums = aligned.select("pairs").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    sums = cut(sums, "pairs")
    id_a = F.floor(F.col("pair") / size_b)
    most = sums.groupBy(id_a.alias("id_a")).agg(F.max("n").alias("most"))
    # One row per id of the vocabulary: small whatever the data.
    joined = sums.withColumn("id_a", id_a).join(F.broadcast(most), "id_a")
    return cut(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _summed(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(np.concatenate(held), return_inverse=True)
    return found, np.bincount(which, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def align_tokenizers(docs: DataFrame, folder: str = FOLDER, share: float = LOOKED_UP) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared of every row.

    Side a encodes a space and the text by the byte-level tokenizer, side b the
    text by the piece tokenizer (which adds the space); special tokens inside
    texts are plain text. The tokens of either side are rows of a token-byte
    incidence matrix in CSR form; the product of a's with the transpose of b's has
    one entry for each pair of tokens that overlap: the links. Since no token goes
    on over a space between two words, the matrices of a batch hold each distinct
    word once, and texts by words times words by id pairs gives each text's pairs.
    Byte offsets where tokens of both sides end cut them into groups, and
    the product of the group incidences has the pairs that share a group
    (``n_shared``, taken from the sizes of its rows; ``shared_links`` makes it).

    An id pair's count is the number of rows that hold it linked, over the whole
    table; ``n_best`` are the links whose count is the highest of their a id,
    ties included, ``count_sum`` the counts summed over links. Pairs are counted
    per task before the shuffle. Counts of pairs with ``share`` of all rows or
    more are looked up where the pairs are read; all others are joined.

    Texts that are null, empty, or whose joined token bytes differ on either side
    from space and text have zeros and an empty ``groups_sha256``. Repeated rows
    count each; null doc_ids are kept. Other columns are not read. A text is
    worked on alone whatever its length. An empty table gives no rows.
    """
    made = align_documents(docs, folder)
    counts = count_pairs(made, folder)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(2, int(np.ceil(total * share)))
    often = counts.where(F.col("n") >= least).toArrow()
    pair = often.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, n, best = pair[order], often.column("n").to_numpy()[order], often.column("best").to_numpy()[order]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            found = lists.flatten().to_numpy()
            rows = len(lists)
            owner = np.repeat(np.arange(rows), lists.value_lengths().to_numpy().astype(np.int64))
            place = np.minimum(np.searchsorted(pair, found), max(len(pair) - 1, 0))
            known = pair[place] == found if len(pair) else np.zeros(len(found), bool)
            place, mine, uses = place[known], owner[known], times[known]
            # Whole numbers beyond 2**53 would lose their last digits in a weighted bincount.
            sums = np.zeros(rows, np.int64)
            np.add.at(sums, mine, n[place] * uses)
            firsts = np.bincount(mine, weights=best[place] * uses, minlength=rows).astype(np.int64)
            bounds = np.searchsorted(owner[~known], np.arange(rows + 1)).astype(np.int32)
            rest, again = (pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[~known])) for x in (found, times))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(firsts), pa.array(sums), rest, again], ["row", "n_best", "count_sum", "rest", "times"])

    looked = made.select("row", "pairs", "times").mapInArrow(look_up, "row long, n_best long, count_sum long, rest array<long>, times array<int>")
    looked = cut(looked, "looked_up")
    tails = looked.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").cast("long").alias("times"))
    tails = tails.join(counts.where(F.col("n") < least), "pair")
    parts = tails.select("row", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).cast("long").alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    parts = parts.unionByName(looked.select("row", "n_best", "count_sum"))
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
    return made.drop("pairs", "times").join(sums, "row").select(names)
