"""Hard negatives, spelling variants and near copies of embeddings against plain Python."""

import random
import zlib
from collections import Counter
from math import floor, isfinite, sqrt

import numpy as np
import pyarrow as pa
import pytest

from runlens.llm import blocks, cells, negatives, spelling

EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, n bigint, cell int, rep bigint, v string, score double, tile int, a int, first string"


def f32(values):
    return [float(x) for x in np.array(values, np.float32)]


def vectors(seed=3, n=260, width=6):
    """(vec_id, embedding, label) with groups of near copies, ties, a hot vector and all edge cases."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = centres[i % 12] if i % 3 else [rng.gauss(0, 1) for _ in range(width)]
        v = [x + rng.gauss(0, 0.12) for x in c]
        size = sqrt(sum(x * x for x in v))
        rows.append((i, f32([x / size for x in v]), rng.choice([0, 1, 1, 1, 2, 9])))
    hot = rows[20][1]
    rows += [(1000 + k, hot, 1) for k in range(90)]
    rows += [(1200, [0.0] * width, 1), (1201, None, 1), (1202, [None, *hot[1:]], 1), (1203, [float("nan"), *hot[1:]], 1), (1204, hot, None)]
    rows += [(1205, [float("inf"), *hot[1:]], 1), (1206, [], 1), (None, hot, 1), (1207, f32([3e37 * x for x in hot]), 1), rows[7], (1208, hot[:3], 1)]
    return rows


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows], EMBEDDINGS).repartition(partitions)


def usable(row, nonzero=True):
    i, v, label = row
    fine = i is not None and label is not None and v is not None and all(x is not None and isfinite(x) for x in v)
    return fine and (not nonzero or any(v))


def cosine_groups(rows, threshold):
    """[(vec_id, n_links, component_id, kept)] by comparing all pairs."""
    live = [k for k, r in enumerate(rows) if usable(r)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in live}
    unit = {k: v / sqrt(v @ v) for k, v in unit.items()}
    links, parent = Counter(), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, a in enumerate(live):
        for b in live[n + 1 :]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[rows[a][0]] += 1
                links[rows[b][0]] += 1
                low, high = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[high] = low
    out = []
    for k, (i, *_) in enumerate(rows):
        r = root(i) if i is not None else None
        out.append((i, links[i] if k in unit else 0, r, i is None or r == i))
    return out


@pytest.mark.parametrize(("cell_rows", "block"), [(8, 1 << 20), (40, 20 * 6), (1000, 1 << 20)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(cells, "BLOCK_NUMBERS", block)
    rows = [r for k, r in enumerate(vectors()) if r[0] != 7 or k == 7]
    found = cells.near_copies(frame(spark, rows), threshold=0.93, cell_rows=cell_rows)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(cosine_groups(rows, 0.93), key=repr)


def test_a_repeated_row_links_with_its_twin(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]
    assert sorted(map(tuple, cells.near_copies(frame(spark, rows)).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_near_copies_without_rows(spark):
    assert cells.near_copies(frame(spark, [])).collect() == []
    assert list(map(tuple, cells.near_copies(frame(spark, [(4, None, None)])).collect())) == [(4, 0, 4, True)]


def test_visits_find_every_pair_at_the_threshold():
    rng = np.random.default_rng(0)
    x = cells.unit(rng.normal(size=(400, 8)))
    other = cells.unit(rng.normal(size=(400, 8)))
    other = cells.unit(other - (other * x).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + sqrt(1 - 0.93**2) * other
    centres = cells.spherical_kmeans(np.concatenate([x, y]), 40)
    for a, b in zip(_cells(x, centres), _cells(y, centres), strict=True):
        assert a[0] in b or b[0] in a


def _cells(x, centres):
    many, found = cells.cells_of(x, centres, sqrt(2 - 2 * 0.93) / 2)
    return [c.tolist() for c in np.split(found, np.cumsum(many)[:-1])]


def test_large_groups_meet_in_blocks(spark):
    rows = spark.range(103).selectExpr("id", "if(id < 90, null, id % 2) AS g")
    dealt = blocks.in_blocks(rows, ["g"], "id", 20).collect()
    met = Counter()
    for r in dealt:
        for s in dealt:
            if r["id"] < s["id"] and (r["g"], r["first"], r["second"]) == (s["g"], s["first"], s["second"]) and (r["chunk"] != s["chunk"]) == (r["first"] != r["second"]):
                met[r["id"], s["id"]] += 1
    group = {r["id"]: r["g"] for r in dealt}
    assert met == Counter({(i, j): 1 for i in group for j in group if i < j and group[i] == group[j]})
    assert max(Counter((r["g"], r["first"], r["second"]) for r in dealt).values()) < 80


def mined(rows):
    """{(anchor, positive, rank): (negative, positive score, negative score)} by scoring all pairs."""
    live = {}
    for i, v, label in rows:
        if usable((i, v, label), nonzero=False):
            whole = tuple(max(-(1 << 26), min(1 << 26, floor(256 * x))) for x in v)
            live[(i, (label + 1) % 10 if i % 7 == 0 else label, whole)] = None
    live = list(live)
    out = {}
    for anchor in sorted({i for i, *_ in live if i % 100 == 0}):
        _, own, v = min(r for r in live if r[0] == anchor)
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), i, label) for i, label, w in live if i != anchor]
        for p, i, label in sorted(x for x in scored if x[2] == own)[:5]:
            fit = sorted(x for x in scored if x[2] != own and 30 * -p <= 100 * -x[0] <= 90 * -p)
            for rank, (s, j, _) in enumerate(fit[:10], 1):
                out[anchor, i, rank] = (j, -p, -s)
    return out


@pytest.mark.parametrize("tile_rows", [30, 1000])
def test_negatives_equal_all_pairs(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(negatives, "LEAF", 8)
    rows = [r for r in vectors() if r[0] != 1207]
    rows = [(i if i is None or i % 3 else i * 100, v, label) for i, v, label in rows]
    found = negatives.hard_negatives(frame(spark, rows), tile_rows).collect()
    assert {(r[0], r[1], r[2]): (r[3], r[4], r[5]) for r in found} == mined(rows)
    assert len(found) == len(mined(rows)) > 100


def test_negatives_of_huge_components_and_of_nothing(spark):
    rows = [(i, f32([1e30 * (i % 5 - 2), 1.0, -1e30]), i % 2) for i in range(0, 300, 25)]
    found = negatives.hard_negatives(frame(spark, rows)).collect()
    assert {(r[0], r[1], r[2]): (r[3], r[4], r[5]) for r in found} == mined(rows)
    assert negatives.hard_negatives(frame(spark, [])).collect() == []
    assert negatives.hard_negatives(frame(spark, [(100, [1.0], 1), (1, [1.0], 1)])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_the_queue_stops_early_and_misses_nothing(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (30, 5))
    v = (centres[rng.integers(0, 30, 4000)] + rng.integers(-6, 7, (4000, 5))).astype(np.float64)
    labels, ids = rng.integers(0, 4, 4000), np.arange(4000)
    tree = negatives.Tree(v, labels, ids)
    read = []
    tree.vectors = type("Seen", (), {"__getitem__": lambda _, s, v=tree.vectors: (read.append(s), v[s])[1]})()
    wanted = negatives.Wanted(True, 5)
    lower, upper = negatives.intervals(v[:1], tree.low, tree.high)
    found = negatives.search(tree, wanted, 0, labels[0], v[0], (lower[0], upper[0]), np.array([[-np.inf, np.inf]]), np.array([-np.inf]))
    other = [(-(v[i] @ v[0]), i) for i in ids if i and labels[i] == labels[0]]
    assert set(found[0].tolist()) == {i for _, i in sorted(other)[:5]}
    assert len(read) < 4000 // negatives.LEAF // 4


def edits(word):
    """All words one edit away, by their patterns: where two words share one, they are near."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def spelled(docs):
    """{word: (form, root, n, n_near, form_n)} by plain Python."""
    n = Counter()
    for doc, text in docs:
        run, runs = "", []
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                runs.append(run)
                run = ""
        for r in runs:
            h = zlib.crc32(f"{'' if doc is None else doc}:{r}".encode())
            at = h % len(r)
            n[r[:at] + r[at + 1 :] if h % 97 == 0 else r] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    out = {}
    for w in n:
        near = []
        for o in n:
            same = len(w) == len(o) and sum(a != b for a, b in zip(w, o, strict=True)) == 1
            if same or w in edits(o) or o in edits(w):
                near.append((-n[o], o))
        form = min(near) if near and -min(near)[0] >= 2 * n[w] else None
        out[w] = [form and form[1], None, n[w], len(near), form and -form[0]]
    for w, row in out.items():
        at = w
        while out[at][0] is not None:
            at = out[at][0]
        row[1] = at
    return {w: tuple(r) for w, r in out.items()}


def misspelled(seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choice("etaoins rlhdcu".replace(" ", "")) for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "ééééé", "éèééé", "Straße", "straße", "ÉCOLE", "école", "x" * 3000, "x" * 3001]
    docs = []
    for doc in range(150):
        text = []
        for _ in range(60):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeiéz") + w[at:], w[:at] + "e" + w[at + 1 :]])
            text.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((doc, rng.choice([" ", "-", "_", "’", "1"]).join(text)))
    docs.append((300, "lmnope " * 3 + "lmnopes " * 7 + "lmnopest " * 20))
    return [*docs, docs[0], (None, docs[1][1]), (200, None), (201, ""), (202, "12 _ -- ŝŝŝŝŝŝ")]


@pytest.mark.parametrize("block", [50_000, 12])
def test_variants_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    docs = misspelled()
    table = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id bigint, text string, word string, n int, part int").repartition(3)
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spelling.word_counts(table)).collect()}
    expected = spelled(docs)
    assert found == expected
    assert any(r[0] and r[0] != r[1] for r in expected.values())


def test_variants_without_words(spark):
    table = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(spelling.word_counts(table)).collect() == []


def test_long_chains_reach_their_root(spark):
    chain = [("a" * (5 + k), 3 << k) for k in range(40)]
    found = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(chain, "word string, n bigint")).collect()}
    assert set(found.values()) == {chain[-1][0]}


@pytest.mark.parametrize(("a", "b", "near"), [("abcde", "abcde", False), ("abcde", "abde", True), ("abcde", "xabcde", True), ("abcde", "abxde", True), ("abcde", "abced", False), ("", "a", True), ("ab", "", False)])
def test_one_edit(a, b, near):
    assert spelling.one_edit(a, b) == spelling.one_edit(b, a) == near


def test_short_lists_are_filled_up():
    from runlens.llm.vectors import matrix

    assert matrix(pa.array([[1, 2], [], [3]]).slice(1), 2).tolist() == [[0, 0], [3, 0]]
