"""Text scores by a probabilistic suffix tree over words, beside word counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvor.llm.words import Words, pieces, range_hashes, signed, words_of
from salvor.runtime import cut, cut_counted, release, small, union_all

# The alphabet: the end of a text, every word with at least this share of all
# tokens (no more than one over the share), a kind for every other word by its
# last bytes, and the start of a text.
SYMBOL_SHARE = 1 / (1 << 17)
KINDS, ENDING_BYTES = 512, 3
# A run of symbols is one number: its length above 56 bits, then 18 bits a symbol.
BITS, LENGTH_AT = 18, 56
# The longest context in symbols (at most two fit), how often one must occur to be
# tested, and the least gain in nats over the next shorter context.
DEPTH, LEAST_CONTEXT, LEAST_GAIN = 2, 32, 10.0
# How often a next symbol must follow a context of one symbol, or of two, to count.
LEAST_SEEN = (2, 4)
# A word or run with at least this share of all tokens is looked up on the mappers;
# there are no more of one length than one over the share. Rarer ones are joined, runs
# that the tree lacks left out beforehand by a bit per hash, of so many bits.
WORD_SHARE, RUN_SHARE, MARK_BITS = 1 / (1 << 20), 1 / (1 << 21), 27
_HELD = 1 << 20


class Counts(NamedTuple):
    """Training tokens: their number, the distinct ones, texts, and a table (word, kind, n)."""

    tokens: int
    distinct: int
    texts: int
    table: DataFrame


class Alphabet(NamedTuple):
    """Hashes of the frequent words (sorted) and the mass of every symbol: 0 is the end,
    then come the words, then the kinds. The number after the last one stands for the
    start of a text."""

    words: np.ndarray
    mass: np.ndarray


class Tree(NamedTuple):
    """Weights of runs of symbols, (run, weight, n) in a table.

    A run's weight is what its last symbol gains after the rest of the run, and,
    if the run is itself a context, what every next symbol loses by that.
    ``contexts`` has (context, gain, total, seen) of all contexts of the tree.
    """

    alphabet: Alphabet
    depth: int
    table: DataFrame
    contexts: DataFrame


def _kinds(words: Words) -> np.ndarray:
    ending = range_hashes(words.bytes, np.maximum(words.start, words.end - ENDING_BYTES), words.end, 3)
    return (ending % np.uint64(KINDS)).astype(np.int32)


def _merged(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    values, first, which = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
    counts = np.bincount(which, weights=np.concatenate([h[-1] for h in held])).astype(np.int64)
    middle = [pa.array(np.concatenate([h[i] for h in held])[first]) for i in range(1, len(held[0]) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(signed(values)), *middle, pa.array(counts)], names)


def _count_unique(found: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Distinct values (with what belongs to them) and counts, combined over many texts."""
    held: list[tuple] = []
    for values, *rest in found:
        distinct, first, counts = np.unique(values, return_index=True, return_counts=True)
        held.append((distinct, *(r[first] for r in rest), counts))
        if sum(len(h[0]) for h in held) > _HELD:
            yield _merged(held, names)
            held = []
    if held:
        yield _merged(held, names)


def count_words(texts: DataFrame) -> Counts:
    """Counts of all words of the texts; every text has one more token, its end."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for _, _, raw, at in pieces(batch.column("text")):
                words = words_of(raw, at, lower=True)
                yield words.hash, _kinds(words)

    counted = texts.select("text").mapInArrow(lambda batches: _count_unique(found(batches), ["word", "kind", "n"]), "word long, kind int, n long")
    table = cut(counted.groupBy("word").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")), "words")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    rows = texts.count()
    return Counts(total["n"] + rows, total["v"] + (rows > 0), rows, table)


def alphabet_of(counts: Counts, share: float = SYMBOL_SHARE) -> Alphabet:
    """All words with at least ``share`` of the tokens and, for all others, the kinds.

    A word has its count and one half; a kind has those of its words, and one
    half for all words that the training texts lack.
    """
    least = max(2, int(np.ceil(counts.tokens * share)))
    found = counts.table.where(F.col("n") >= least).select("word", "n").orderBy("word").toArrow()
    words, n = (found.column(c).to_numpy().astype(np.int64) for c in ("word", "n"))
    kinds = np.full(KINDS, 0.5)
    for row in counts.table.where(F.col("n") < least).groupBy("kind").agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():
        kinds[row["kind"]] += row["mass"]
    return Alphabet(words, np.concatenate([[counts.texts + 0.5], n + 0.5, kinds]))


def _look_up(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place among the known ones (sorted), and whether it is there."""
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def symbols_of(alphabet: Alphabet, words: Words, n: int, pad: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The texts as symbols, and the text of each.

    Every text begins with ``pad`` starts, the context of its first word, and has its end last.
    """
    place = np.arange(len(words.owner)) + words.owner * (pad + 1) + pad
    size = np.bincount(words.owner, minlength=n) + pad + 1
    out = np.full(len(words.owner) + n * (pad + 1), len(alphabet.mass), np.int64)
    at, frequent = _look_up(signed(words.hash), alphabet.words)
    out[place] = np.where(frequent, at + 1, len(alphabet.words) + 1 + _kinds(words))
    out[np.cumsum(size) - 1] = 0
    return out, np.repeat(np.arange(n), size)


def runs_of(out: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of so many symbols inside one text, and the place of the last symbol of each."""
    last = np.arange(length - 1, len(out))
    last = last[owner[last] == owner[last - length + 1]]
    code = np.full(len(last), length << LENGTH_AT, np.int64)
    for back in range(length):
        code |= out[last - back] << (BITS * back)
    return code, last


def _context(run: Column) -> Column:
    """The run without its last symbol."""
    length = F.shiftright(run, LENGTH_AT) - 1
    return F.shiftright(run.bitwiseAND(F.lit((1 << LENGTH_AT) - 1)), BITS).bitwiseOR(length * F.lit(1 << LENGTH_AT))


def _suffix(run: Column, length: int) -> Column:
    """A run of this length without its first symbol."""
    return run.bitwiseAND(F.lit((1 << BITS * (length - 1)) - 1)).bitwiseOR(F.lit((length - 1) << LENGTH_AT))


def count_runs(texts: DataFrame, alphabet: Alphabet, depth: int, length: int, contexts: np.ndarray | None = None) -> DataFrame:
    """run, n: how often each symbol stands after each context, for runs of one length.

    With ``contexts`` (of ``marks_of``), runs of which the context has no bit are left out.
    """
    start = len(alphabet.mass)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for _, _, raw, at in pieces(batch.column("text")):
                out, owner = symbols_of(alphabet, words_of(raw, at, lower=True), len(at) - 1, depth)
                code, last = runs_of(out, owner, length)
                taken = out[last] != start
                if contexts is not None:
                    before, end = runs_of(out, owner, length - 1)
                    there = np.zeros(len(out), bool)
                    there[end] = _marked(contexts, before)
                    taken &= there[last - 1]
                yield (code[taken],)

    counted = texts.select("text").mapInArrow(lambda batches: _count_unique(found(batches), ["run", "n"]), "run long, n long")
    return counted.groupBy("run").agg(F.sum("n").alias("n"))


def fit_tree(
    texts: DataFrame, alphabet: Alphabet, depth: int = DEPTH, least_gain: float = LEAST_GAIN, least_context: int = LEAST_CONTEXT
) -> Tree:
    """The tree of all texts, as a table.

    After a context with ``seen`` distinct next symbols, of which those that follow
    it at least LEAST_SEEN times do so ``total`` times together, the chance of one
    of these that does so c times is (c + seen * p) / (total + seen), and that of
    any other seen * p / (total + seen); p is its chance after the context without
    its first symbol. With no context the chances are the alphabet's masses.

    The divergence of a context is the sum, over its occurrences, of the logarithm
    of its own chance over p. Every context that occurs ``least_context`` times and
    whose divergence reaches ``least_gain`` is kept, whatever their number. One that
    is not has its suffix's chances, so the state of a place is its longest kept
    context. Both limits are the same for any number of texts, so the tree grows
    with them.
    """
    if (depth + 1) * BITS > LENGTH_AT:
        raise ValueError(f"a run of {depth + 1} symbols does not fit in {LENGTH_AT} bits")
    mass = pa.table({"suffix": np.arange(len(alphabet.mass)) + (1 << LENGTH_AT), "p": alphabet.mass / alphabet.mass.sum()})
    # One row a symbol; the share in alphabet_of bounds them.
    chances, marks = F.broadcast(texts.sparkSession.createDataFrame(mass)), None
    n, total, seen, others, p = (F.col(c) for c in ("n", "total", "seen", "others", "p"))
    own = (n + seen * p) / (total + seen)
    parts, contexts, gone = [], [], []
    for length in range(2, depth + 2):
        counted = cut(count_runs(texts, alphabet, depth, length, marks), "runs")
        often = n >= LEAST_SEEN[length - 2]
        sums = counted.withColumn("context", _context(F.col("run"))).groupBy("context").agg(
            F.sum(F.when(often, n).otherwise(0)).alias("total"),
            F.count("*").alias("seen"),
            F.sum(F.when(often, 0).otherwise(n)).alias("others"),
        )
        sums, size = cut_counted(sums.where((total > 0) & (total + others >= least_context)), "sums", rows=F.lit(True))
        rows = counted.where(often).select("run", "n", _context(F.col("run")).alias("context"), _suffix(F.col("run"), length).alias("suffix"))
        rows = rows.join(small(sums, size["rows"]), "context", "left").join(chances, "suffix").drop("suffix")
        rows = cut(rows, "chances")
        if length <= depth:
            # The start before a first word is a context, but no symbol follows to make it a run.
            start = sum(len(alphabet.mass) << (BITS * i) for i in range(length)) | (length << LENGTH_AT)
            starts = texts.sparkSession.range(1).select(F.lit(start).cast("long").alias("run"))
            marks = marks_of(counted.where(n >= least_context).select("run").unionByName(starts))
        gain = F.sum(n * F.log(own / p)) + F.max(others) * F.log(F.max(seen) / (F.max(total) + F.max(seen)))
        found = rows.where(total.isNotNull()).groupBy("context").agg(gain.alias("gain"), *(F.max(c).alias(c) for c in ("total", "seen", "others")))
        kept, size = cut_counted(found.where(F.col("gain") >= least_gain), "contexts", rows=F.lit(True))
        marked = rows.join(small(kept.select("context", F.lit(True).alias("kept")), size["rows"]), "context", "left")
        marked = cut(marked.select("run", "n", F.when(F.col("kept"), own).otherwise(p).alias("p"), F.when(F.col("kept"), F.log10(own / (seen * p) * (total + seen))).alias("weight")), "marked")
        release(rows, counted, sums)
        chances = marked.select(F.col("run").alias("suffix"), "p")
        parts.append(marked.where("weight is not null").select("run", "weight", "n"))
        parts.append(kept.select(F.col("context").alias("run"), F.log10(seen / (total + seen)).alias("weight"), (total + others).alias("n")))
        contexts.append(kept.select("context", "gain", "total", "seen"))
        gone.append(marked)
    weights = union_all(parts).groupBy("run").agg(F.sum("weight").alias("weight"), F.max("n").alias("n"))
    table = cut(weights, "weights")
    release(*gone)
    return Tree(alphabet, depth, table, union_all(contexts))


def _place(values: np.ndarray) -> np.ndarray:
    """The bit of each run."""
    x = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def marks_of(runs: DataFrame) -> np.ndarray:
    """A bit for each run, in 2**MARK_BITS bits whatever the number of runs.

    A run without its bit is not in the table; one with a bit may or may not be.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _place(batch.column("run").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> 15).astype(np.int32)), pa.array(bit & 0x7FFF)], ["block", "bit"])

    bits = runs.select("run").mapInArrow(make, "block int, bit long").repartition("block").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for row in bits.collect():
        out[row["block"] << 12 : (row["block"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return out


def _marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _place(values)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def score_texts(docs: DataFrame, tree: Tree, counts: Counts) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    A token is a word (A-Z lowered) or the end of the text; base_score adds up
    log10((c + 0.5) / (N + 0.5 * (V + 1))) from the training counts. score adds up
    log10 of the chance of each token's symbol after the longest context that the
    tree has, and for a word that is no symbol its share of its kind; words that
    the training texts lack share one half of their kind's mass. Both are sums of
    weights of words and runs: those with a large share of all tokens are looked
    up where the text is read, all others are joined with their table.

    Null text counts as empty and has one token. Rows that repeat doc_id and text
    have the same scores. Only doc_id and text are read. An empty table gives no
    rows; without training texts N is 0 and only the kinds have mass.
    """
    alphabet, depth = tree.alphabet, tree.depth
    least_word, least = (int(np.ceil(counts.tokens * share)) for share in (WORD_SHARE, RUN_SHARE))
    looked_up = counts.table.where(F.col("n") >= least_word).select("word", "n").orderBy("word").toArrow()
    word, log_counts = looked_up.column("word").to_numpy().astype(np.int64), np.log10(looked_up.column("n").to_numpy() + 0.5)
    single = F.shiftright("run", LENGTH_AT) == 1
    # Runs of one symbol are bounded by the alphabet, the others by their share.
    often = tree.table.where(single | (F.col("n") >= least)).select("run", "weight").orderBy("run").toArrow()
    run, weight = often.column("run").to_numpy().astype(np.int64), often.column("weight").to_numpy().astype(float)
    one = np.zeros(len(alphabet.mass) + 1)
    alone = run >> LENGTH_AT == 1
    one[run[alone] & ((1 << BITS) - 1)] = weight[alone]
    run, weight = run[~alone], weight[~alone]
    bits = marks_of(tree.table.where(~single))
    base = float(np.log10(counts.tokens + 0.5 * (counts.distinct + 1)))
    shift = base - float(np.log10(alphabet.mass.sum()))
    end, known_end, nothing = float(np.log10(counts.texts + 0.5)), int(counts.texts > 0), float(np.log10(0.5))
    # The number tells rows apart that repeat; it counts only as it is written below.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[order]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, at in pieces(batch.column("text")):
                n = high - low
                words = words_of(raw, at, lower=True)
                out, owner = symbols_of(alphabet, words, n, depth)
                number, known = _look_up(signed(words.hash), word)
                size = np.bincount(words.owner, minlength=n)
                sure = np.bincount(words.owner[known], minlength=n)
                # All words first count as unknown; what is known adds the difference.
                extra = np.bincount(words.owner[known], weights=log_counts[number[known]] - nothing, minlength=n)
                score = size * nothing + extra + end - (size + 1) * base
                # Of the starts only the last one stands before a word.
                weighs = np.ones(len(out), bool)
                weighs[:-1] = (out[:-1] != len(alphabet.mass)) | (out[1:] != len(alphabet.mass))
                gains, runs, owners = np.bincount(owner[weighs], weights=one[out[weighs]], minlength=n), [], []
                for length in range(2, depth + 2):
                    code, last = runs_of(out, owner, length)
                    there = _marked(bits, code) & weighs[last]
                    code, of = code[there], owner[last[there]]
                    place, hit = _look_up(code, run)
                    gains += np.bincount(of[hit], weights=weight[place[hit]], minlength=n)
                    runs.append(code[~hit])
                    owners.append(of[~hit])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(low, n) for c in ("row", "doc_id")),
                        *(pa.array(x) for x in (size + 1, sure + known_end, score, score + gains + (size + 1) * shift)),
                        lists(words.owner[~known], signed(words.hash[~known]), n),
                        lists(np.concatenate(owners), np.concatenate(runs), n),
                    ],
                    ["row", "doc_id", "n_tokens", "sure", "sure_score", "score", "words", "runs"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = cut(rows.mapInArrow(make, f"row long, doc_id {kind}, n_tokens long, sure long, sure_score double, score double, words array<long>, runs array<long>"), "scored")
    rare_words = counts.table.where(F.col("n") < least_word).select("word", (F.log10(F.col("n") + 0.5) - nothing).alias("gain"))
    rare_runs = tree.table.where(~single & (F.col("n") < least)).select("run", "weight")
    found = made.select("row", F.explode("words").alias("word")).join(rare_words, "word")
    found = found.groupBy("row").agg(F.count("*").alias("found"), F.sum("gain").alias("gain"), F.lit(0.0).alias("weight"))
    gained = made.select("row", F.explode("runs").alias("run")).join(rare_runs, "run")
    gained = gained.groupBy("row").agg(F.lit(0).cast("long").alias("found"), F.lit(0.0).alias("gain"), F.sum("weight").alias("weight"))
    sums = found.unionByName(gained).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("found", "gain", "weight")))
    joined = made.drop("words", "runs").join(sums, "row", "left").fillna(0, ["found", "gain", "weight"])
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("sure") + F.col("found")).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("sure_score") + F.col("gain")).alias("base_score"),
        (F.col("score") + F.col("gain") + F.col("weight")).alias("score"),
    )
