"""Plain Python versions of the operators, and small tables with every awkward case in them."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Columns of documents, then columns whose names the operators use themselves.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score double, row string, "
    "node bigint, taken int, kind string, bucket string, a int, b int, component string, _part int, label string, id string"
)
N_EXTRA = SCHEMA.count(",") + 1 - 5


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=5):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared passages and all edge cases."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(20, 120)) for _ in range(30)]
    passage = prose(rng, 30)
    for k in range(8):
        texts.append(f"{prose(rng, 15)} {passage} {prose(rng, 10 + k)}")
    base = prose(rng, 100).split()
    for k in range(10):
        changed = list(base)
        for at in rng.sample(range(100), k % 3):
            changed[at] = f"other{k}"
        texts.append(" ".join(changed))
    texts += [texts[0], texts[0].upper(), texts[3].replace(" ", "\n\t "), None, "", "  \n ", "one", "one two three", "One  two\tthree"]
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g h", "x " * 300, "x y " * 40, prose(rng, 20_000), "wörter mit ümlaut " * 9]
    rows = [(i, t, "en", f"src{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[5])
    rows += [(None, texts[0], "en", "src0", 9), (None, None, None, None, None)]
    return rows


def frame(spark, rows, partitions=3):
    wide = [(*r, *[None] * N_EXTRA) for r in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(partitions)


def repeats(rows, window=13):
    """{doc_id: (n_words, n_removed, sha256)}"""
    first, out = {}, {}
    for doc, text in sorted({(d, t) for d, t, *_ in rows if d is not None}):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), doc)
    for doc, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(doc, text)] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, n=5):
    w = words((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def classes(rows, percent=80, n=5):
    """{doc_id: (set size, smallest id reachable)}"""
    sets = {d: shingles(t, n) for d, t, *_ in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                low, high = sorted((root(x), root(y)))
                parent[high] = low
    return {d: (len(s), root(d)) for d, s in sets.items()}


def figures(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = [False] * len(w)
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            twice[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * sum(twice) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(twice), failed
