"""Toxicity, quality rules, decontamination and importance resampling."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.brute import FOLD, awkward, figures, frame, prose, words
from pyspark.sql import functions as F

from runlens.llm import decontaminate, importance, quality, toxicity
from runlens.llm.words import slices


def labelled(spark, rows):
    return spark.createDataFrame([(d, x, x, "extra") for d, x in rows], "doc_id bigint, toxic int, quality int, text string")


def test_folding():
    assert toxicity.fold("Id1ot, M0R0N! $tupid tr4sh") == ["idiot", "moron", "stupid", "trash"]
    assert toxicity.fold("іdіоt ｉｄｉｏｔ id​iot") == ["idiot"] * 3
    assert toxicity.fold("in 2014 word$$$ 5 km") == ["in", "word", "km"]
    assert toxicity.fold(None) == toxicity.fold("") == []


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng = random.Random(1)
    bad = ["vilword", "nastier", "grubling"]
    rows, labels = [], []
    for i in range(600):
        text = prose(rng, rng.randrange(5, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(text) // 15):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        elif i % 5 == 0:
            text.insert(1, "not nastier")
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(toxic)))
    return frame(spark, rows), labels


def test_toxic_words_are_learned_and_exceptions_spared(spark, toxic_corpus):
    docs, labels = toxic_corpus
    model = toxicity.learned(docs, labelled(spark, labels))
    truth = dict(labels)
    scored = docs.select("doc_id", toxicity.toxicity(model).alias("p")).collect()
    held = [r for r in scored if toxicity_held(spark, r["doc_id"])]
    assert all((r["p"] >= 0.7) == bool(truth[r["doc_id"]]) for r in held) and len(held) > 150
    assert "not nastier" in model.exceptions
    assert model.score("a v1lw0rd here") > 0.7 > model.score("all is well") == pytest.approx(model.score(None), abs=0.2)


def toxicity_held(spark, doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_labels_play_no_part(spark, toxic_corpus):
    docs, labels = toxic_corpus
    turned = [(d, 1 - x if toxicity_held(spark, d) else x) for d, x in labels]
    one, other = (toxicity.learned(docs, labelled(spark, rows)) for rows in (labels, turned))
    assert one.weights == other.weights and one.coefficients == other.coefficients


def test_toxicity_of_edge_cases(spark, toxic_corpus):
    docs, labels = toxic_corpus
    rows = frame(spark, awkward())
    model = toxicity.learned(docs, labelled(spark, labels))
    found = rows.select("doc_id", "text", toxicity.toxicity(model).alias("p")).collect()
    assert len(found) == len(awkward()) and all(0 <= r["p"] <= 1 for r in found)
    none = toxicity.learned(rows, labelled(spark, []))
    assert {r[0] for r in rows.select(toxicity.toxicity(none)).collect()} == {0.0}
    only = toxicity.learned(rows, labelled(spark, [(i, 1) for i in range(20)]))
    assert {r[0] for r in rows.select(toxicity.toxicity(only)).collect()} == {1.0}
    assert rows.limit(0).select(toxicity.toxicity(model)).count() == 0


def test_figures_equal_brute_force(spark):
    rows = [*awkward(), (900, "# a | b\n# a | b\n\n \nc <d> $5\n" * 4, "", "", 0), (901, "x!! Y!!", "", "", 0)]
    found = quality.assess(frame(spark, rows)).collect()
    texts = {d: t for d, t, *_ in rows if d is not None}
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            assert tuple(r[1:7]) == figures(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_the_order_of_rules_changes_no_verdict():
    import pyarrow as pa

    from runlens.llm.words import slices

    rng = random.Random(2)
    texts = [prose(rng, 40) for _ in range(20)] + ["LOUD WORDS " * 12, "a### b$$$ " * 12, "go go go go " * 9, "x! y! z! " * 9, "same line\n" * 20]
    (words,) = slices(pa.array(texts))
    alive = np.ones(len(texts), bool)
    expected = np.array([not any(rule.rejects(words)[r] for rule in quality.RULES) for r in range(len(texts))])
    for _ in range(5):
        assert (quality.verdict(words, rng.sample(quality.RULES, len(quality.RULES)), alive) == expected).all()
    assert expected[:20].all() and not expected[20:].any()


def test_the_best_rule_comes_first(spark):
    import time

    def slow(words):
        time.sleep(0.02)
        return np.zeros(words.n, bool)

    rules = [quality.Rule("slow", slow), quality.Rule("quick", lambda words: words.counts() > 30)]
    assert [r.name for r in quality.order_rules(frame(spark, awkward()), rules)] == ["quick", "slow"]
    assert quality.order_rules(frame(spark, awkward()).limit(0), rules) == rules
    assert quality.assess(frame(spark, awkward()).limit(0)).count() == 0


ITEMS = [
    (1, "A train leaves the old station at 9 with 120 people, and 9 of them leave the train before Boston by the river."),
    (2, "short item of six words"),
    (3, "12 34 56 78 90 11 22 33 44 55"),
    (4, None),
    (5, ""),
    (6, "too short"),
]


def found_in(spark, texts, items=ITEMS):
    docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])
    items = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id bigint, text string, doc_id string")
    found = decontaminate.contaminated(docs, items).collect()
    return {(r["doc_id"], r["item_id"]): r["changed"] for r in found}


def test_items_are_found_with_other_values(spark):
    rng = random.Random(4)
    item = ITEMS[0][1]
    other = item.replace("9 ", "7 ").replace("120", "350").replace("Boston", "Denver")
    uneven = item.replace("at 9", "at 7").replace("120", "350")
    texts = [
        f"{prose(rng, 30)}. {item} {prose(rng, 30)}",
        f"{prose(rng, 30)}. {other} {prose(rng, 30)}",
        f"{prose(rng, 30)}. {uneven} {prose(rng, 30)}",
        item.upper().replace(" ", "  "),
        prose(rng, 200),
        "Short item, of six words!",
        "12 34 56 78 90 11 22 33 44 55",
        "21 43 65 87 09 12 23 34 45 56",
        None,
        "",
    ]
    assert found_in(spark, texts) == {(0, 1): False, (1, 1): True, (3, 1): False, (5, 2): False, (6, 3): False}


def test_short_items_are_found_inside_sentences(spark):
    """A verbatim copy meets its item whatever stands before it."""
    items = [(1, "Which planet is known as the Red Planet?"), (2, "Name the river that runs through the old city of Prague."), (3, "Who wrote Faust there?")]
    texts = ['he asked, "Which planet is known as the Red Planet?"', "they had to Name the river that runs through the old city of Prague.", "and then - Who wrote Faust there?"]
    texts += ["which planet is known as the red planet"]
    found = found_in(spark, texts, items)
    assert found == {(0, 1): False, (1, 2): False, (2, 3): False, (3, 1): False}


def test_names_at_sentence_beginnings_and_parted_numbers(spark):
    items = [
        (1, "Tom had 12 apples. Tom gave 5 apples to Anna. How many apples does Tom have left?"),
        (2, "A shop sells 950 loaves of bread in the week and gives 4 loaves away. How many loaves does the shop sell?"),
        (3, "There are green birds in the old tree. The birds sing all day long. The farmer is glad to hear them sing."),
    ]
    texts = [
        "Bill had 31 apples. Bill gave 8 apples to Jane. How many apples does Bill have left?",
        "A shop sells 1,200 loaves of bread in the week and gives 3.5 loaves away. How many loaves does the shop sell?",
        "There are green birds in the old tree. Those birds sing all day long. The farmer is glad to hear them sing.",
        "Bill had 31 apples. Jack gave 8 apples to Jane. How many apples does Mary have left?",
    ]
    assert found_in(spark, texts, items) == {(0, 1): True, (1, 2): True, (2, 3): False}


def test_a_place_counts_once(spark):
    """A phrase said again and again is one place; an item held in two halves is held."""
    item = "every stone of this old bridge was carried up from some quarry far below the hills that frame our quiet valley"
    w = item.split()
    texts = [" and then ".join([" ".join(w[:8])] * 6), f"{' '.join(w[:12])} x y z {' '.join(w[8:])}", " ".join(w[:12]) + " q " + " ".join(w[:12])]
    assert found_in(spark, texts, [(1, item)]) == {(1, 1): False}


def test_a_shared_instruction_joins_nothing(spark, monkeypatch):
    rng = random.Random(11)
    start = "read the text below with care and then answer"

    def plain(n):
        return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))

    items = [(k, f"{start} {plain(12)}") for k in range(60)]
    texts = [f"{start} {plain(40)}", f"{plain(9)} {items[7][1]}", items[7][1]]
    joined = []
    met = decontaminate._met
    monkeypatch.setattr(decontaminate, "_met", lambda *a: (joined.append(met(*a)), joined[-1])[1])
    assert found_in(spark, texts, [*items, (100, items[7][1])]) == {(d, i): False for d in (1, 2) for i in (7, 100)}
    assert joined[0].where("id = 0").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_changed_items_against_plain_templates(spark, seed):
    """Lower-case items with numbers: what is held is decided by comparing templates window by window."""
    rng = random.Random(seed)
    vocabulary = [f"v{chr(97 + k)}" for k in range(26)]

    def text(n):
        return [str(rng.randrange(100, 999)) if rng.random() < 0.15 else rng.choice(vocabulary) for _ in range(n)]

    items = [text(rng.randrange(8, 25)) for _ in range(12)]
    docs = []
    for _ in range(60):
        w = list(rng.choice(items))
        new = {x: str(rng.randrange(100, 999)) for x in set(w) if x.isdigit()}
        w = [new.get(x, x) if rng.random() < 0.95 else "other" for x in w]
        docs.append(text(rng.randrange(0, 6)) + w[rng.randrange(0, 4) :] + text(rng.randrange(0, 6)))

    def template(w):
        return ["#" if x.isdigit() else x for x in w]

    def held(doc, item):
        places, n = set(), len(item) - 7
        open_ = sum(1 for i in range(n) if sum(not x.isdigit() for x in item[i : i + 8]) >= 5)
        for shift in range(-len(item), len(doc)):
            own, values, good = set(), set(), True
            for i in range(n):
                a, b = item[i : i + 8], doc[i + shift : i + shift + 8] if i + shift >= 0 else []
                literal = sum(not x.isdigit() for x in a)
                if a == b or (template(a) == template(b) and 5 <= literal < 8):
                    own.add(i)
                    values |= {(x, y) for x, y in zip(a, b, strict=True) if x.isdigit()}
            good = len({x for x, _ in values}) == len(values)
            places |= own if good else set()
        return len(places) >= min(6, max(open_, -(-n // 2))) and len(places) > 0

    found = found_in(spark, [" ".join(d) for d in docs], [(k, " ".join(i)) for k, i in enumerate(items)])
    assert set(found) == {(d, k) for d, x in enumerate(docs) for k, i in enumerate(items) if held(x, i)} and found


def test_blocks_change_nothing(spark):
    docs = frame(spark, [(i, ITEMS[0][1] + " more words", "", "", 0) for i in range(5)] + [(None, ITEMS[0][1], "", "", 0)])
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    whole = sorted(map(repr, decontaminate.contaminated(docs, items).collect()))
    assert whole == sorted(map(repr, decontaminate.contaminated(docs, items, block_size=3).collect())) and len(whole) == 6
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_the_draw_prefers_the_target(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        rows.append((i, prose(rng, 60) if good else " ".join(f"j{rng.randrange(60)}##" for _ in range(60)), "", "", 0))
        labels.append((i, int(good)))
    docs = frame(spark, rows)
    good, share = importance.good_docs(labelled(spark, labels[:200]))
    assert share == 0.75
    found = importance.resample(docs, good, share)
    kept = {r["doc_id"] for r in found.where("kept").collect()}
    assert kept == {d for d, x in labels if x}
    again = importance.resample(docs.repartition(7), good, share)
    assert kept == {r["doc_id"] for r in again.where("kept").collect()}


def test_weights_equal_brute_force(spark):
    docs = frame(spark, awkward())
    target, raw = importance.models(docs, 1 << 14, np.arange(20))
    ratio = importance.log_ratio(target, raw)
    n_words = sum(figures(t)[0] for _, t, *_ in awkward())
    n_pairs = sum(max(0, figures(t)[0] - 1) for _, t, *_ in awkward())
    assert raw.sum() == n_words + n_pairs
    assert np.exp(ratio) @ ((raw + 1) / (raw + 1).sum()) == pytest.approx(1)

    # Every weight, by counting n-grams in dictionaries; buckets are only looked up.
    def grams(text):
        w = words((text or "").translate(FOLD))
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    (every,) = slices(pa.array([" ".join(words(t or "")) for _, t, *_ in awkward()]), lower=True, most=1 << 30)
    buckets, at = {}, 0
    for _, text, *_ in awkward():
        w = words((text or "").translate(FOLD))
        pairs = every.window_hashes(np.arange(at, at + len(w) - 1), 2, 5) if len(w) > 1 else []
        buckets |= {x: int(h >> np.uint64(50)) for x, h in zip(w, every.hashes[at : at + len(w)], strict=True)}
        buckets |= {f"{a} {b}": int(h >> np.uint64(50)) for a, b, h in zip(w, w[1:], pairs, strict=False)}
        at += len(w)
    n, good = Counter(), Counter()
    for doc, text, *_ in awkward():
        n.update(buckets[g] for g in grams(text))
        if doc is not None and doc < 20:
            good.update(buckets[g] for g in grams(text))
    size, total, wins = 1 << 14, sum(n.values()), sum(good.values())
    expected = []
    for doc, text, *_ in awkward():
        logs = []
        for g in grams(text):
            prior = (n[buckets[g]] + 1) / (total + size)
            logs.append(np.log((good[buckets[g]] + size * prior) / (wins + size)) - np.log(prior))
        expected.append((doc, len(logs), round(sum(logs) / max(len(logs), 1) * min(len(logs), 200), 6)))
    found = [(r["doc_id"], r["n_grams"], round(r["log_weight"], 6)) for r in importance.importance(docs, ratio).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_models_grow_with_the_documents():
    assert [importance.buckets_for(n) for n in (0, 256_410, 10**7, 10**10)] == [1 << 16, 1 << 16, 1 << 18, 1 << 20]


@pytest.mark.parametrize("keep", [0, 1, 7, 500, 999, 1000])
def test_the_threshold_is_the_kth_highest(spark, keep):
    rng = random.Random(keep)
    values = [rng.choice([rng.gauss(0, 5), 1.25, -3.0]) for _ in range(1000)]
    found = importance.threshold(spark.createDataFrame([(v,) for v in values], "key double"), keep)
    if not keep:
        assert found is None
        return
    at, ties = found
    assert at == sorted(values, reverse=True)[keep - 1] and ties == keep - sum(v > at for v in values)


def test_importance_of_edge_cases(spark):
    docs = frame(spark, awkward())
    good, share = importance.good_docs(labelled(spark, []))
    assert share == 1.0
    found = importance.resample(docs, good, 0.5).collect()
    assert len(found) == len(awkward()) and abs(sum(r["kept"] for r in found) - len(found) / 2) <= 2
    assert importance.resample(docs.limit(0), good, 0.5).count() == 0
    noise = spark.range(20_000).select(importance.gumbel(F.col("id")).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert noise[0] == pytest.approx(0.5772, abs=0.05) and noise[1] == pytest.approx(1.2825, abs=0.05)
