"""Plain versions of the operators, and small documents to compare them on."""

import collections
import hashlib
import math
import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, digest string, node long, key string"


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=5, n=40):
    """Texts with copies, near copies, shared passages, nulls, empties and one long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(3, 160)) for _ in range(n)]
    passage = prose(rng, 50)
    for i in range(6):
        base = texts[i].split()
        base[len(base) // 2] = "changed"
        texts.append(" ".join(base))
        texts.append(texts[i])
        texts.append(prose(rng, 20) + "\n" + passage + "\t" + prose(rng, 12))
    texts += [None, "", None, " \n\t ", "one", "one", "Two Words", "two words", "\u00e9\u0301 \u4e2d\u6587 \u00a0x", "ha " * 90, "a b " * 60, prose(rng, 6000), "x" * 20000]
    return [(i, t) for i, t in enumerate(texts)]


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), "x", "y", 1, "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def shingles(text, k):
    w = words(text, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard(rows, k, num, den):
    """doc_id -> (shingles, smallest doc_id reachable)."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, window):
    """doc_id -> (words, removed, sha256 of the kept ones)."""
    seen = collections.Counter()
    split = {i: words(t) for i, t in rows}
    for w in split.values():
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def suffix_tree_scores(training, rows, share, kind_of, depth, least_seen, least_gain, least_context):
    """doc_id -> score by a plain suffix tree, and its contexts with their gain.

    ``kind_of`` names the kind, one of 512, of a word that is no symbol.
    """
    split = [[w.encode() for w in words(t, True)] for t in training]
    n = collections.Counter(w for t in split for w in t)
    tokens = sum(n.values()) + len(split)
    least = max(2, math.ceil(tokens * share))
    mass = {("kind", k): 0.5 for k in range(512)} | {"end": len(split) + 0.5}
    for w, c in n.items():
        mass[symbol_of(w, n, least, kind_of)] = mass.get(symbol_of(w, n, least, kind_of), 0) + c + 0.5
    everything = sum(mass.values())

    def symbols(t):
        return ["start"] * depth + [symbol_of(w, n, least, kind_of) for w in t] + ["end"]

    after = collections.defaultdict(collections.Counter)
    for t in split:
        s = symbols(t)
        for i in range(depth, len(s)):
            for k in range(1, depth + 1):
                after[tuple(s[i - k : i])][s[i]] += 1
    kept = {}

    def chance(context, x):
        if not context:
            return mass[x] / everything
        p = chance(context[1:], x)
        if context not in kept:
            return p
        return own(context, x, p)

    def own(context, x, p):
        seen, total = len(after[context]), sum(c for c in after[context].values() if c >= least_seen[len(context) - 1])
        c = after[context][x]
        return ((c if c >= least_seen[len(context) - 1] else 0) + seen * p) / (total + seen)

    for context in sorted(after, key=len):
        gain = 0.0
        if sum(after[context].values()) >= least_context and max(after[context].values()) >= least_seen[len(context) - 1]:
            for x, c in after[context].items():
                p = chance(context[1:], x)
                gain += c * math.log(own(context, x, p) / p)
        if gain >= least_gain:
            kept[context] = gain
    scores = {}
    for i, t in rows:
        ws = [w.encode() for w in words(t, True)]
        s, score = symbols(ws), 0.0
        for at in range(depth, len(s)):
            score += math.log10(chance(tuple(s[at - depth : at]), s[at]))
            if isinstance(s[at], tuple) and s[at][0] == "kind":
                score += math.log10((n[ws[at - depth]] + 0.5) / mass[s[at]])
        scores[i] = score
    return scores, kept


def symbol_of(word, n, least, kind_of):
    return ("word", word) if n[word] >= least else ("kind", kind_of(word))
