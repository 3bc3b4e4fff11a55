"""Substring deduplication and the similarity join against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm.brute import awkward, classes, frame, prose, repeats, words
from pyspark.sql import functions as F

from runlens.llm import jaccard, substrings
from runlens.llm import repeats as keyed
from runlens.llm.components import components
from runlens.llm.words import slices


def test_words_are_those_of_the_pattern():
    texts = ["a  b\tc", None, "", " \n", "ünï cödé\x0bx", "one"]
    for most in (1, 5, 1 << 20):
        found = []
        for part in slices(pa.array(texts), most=most):
            for r in range(part.n):
                own = part.row == r
                found.append([bytes(part.data[s:e]).decode() for s, e in zip(part.starts[own], part.ends[own], strict=True)])
        assert found == [words(t) for t in texts]


def test_hashes_depend_on_the_words_alone():
    (one,) = slices(pa.array(["x hello world", "hello"]))
    (other,) = slices(pa.array(["", "padding hello"]))
    assert one.hashes[1] == one.hashes[3] == other.hashes[1] != one.hashes[2]
    (folded,) = slices(pa.array(["HeLLo É", "hello É", "hello é"]), lower=True)
    assert folded.hashes[0] == folded.hashes[2] and folded.hashes[1] == folded.hashes[3] != folded.hashes[5]
    at, hashes = one.windows(2)
    assert at.tolist() == [0, 1] and len(set(hashes.tolist())) == 2


@pytest.mark.parametrize("period", [1, 2, 3, 7, 13, 20])
def test_cover_has_every_difference(period):
    cover = substrings.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_repeats_equal_brute_force(spark):
    rows = awkward()
    found = substrings.remove_repeats(frame(spark, rows)).collect()
    expected = repeats(rows)
    texts = {d: t for d, t, *_ in rows if d is not None}
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == expected[(r["doc_id"], texts[r["doc_id"]])]
        else:
            assert r["n_removed"] == 0
    assert sum(r["n_removed"] > 0 for r in found) > 10


@pytest.mark.parametrize("window, period", [(13, 7), (8, 3), (5, 5)])
def test_every_alignment_of_a_shared_passage(spark, window, period):
    rng = random.Random(window)
    passage = prose(rng, window)
    rows = [(i, f"{prose(rng, i, 9999)} {passage} {prose(rng, 20 - i, 9999)}", "", "", 0) for i in range(20)]
    found = substrings.remove_repeats(frame(spark, rows), window, period).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in found) == [(i, window if i else 0) for i in range(20)]


def test_carried_rows_keep_every_column(spark):
    rows = awkward()
    docs = frame(spark, rows)
    found = substrings.remove_repeats(docs, carry=True).collect()
    assert sorted(map(repr, [r["row"]["doc_id"] for r in found])) == sorted(repr(r[0]) for r in rows)
    before = {(r[0], r[1]) for r in rows}
    assert all((r["doc_id"], r["text"]) in before for r in found if not r["n_removed"])
    assert set(found[0]["row"].asDict()) == set(docs.columns) - {"text"}


@pytest.mark.parametrize("tasks", [4, 32])
def test_each_owner_is_marked_by_one_task(spark, tasks):
    """Every task holds entries of every owner: what they send follows the owners, not the owners of each task."""
    found = spark.range(0, tasks * 600, 1, tasks).select((F.col("id") % 600).alias("owner"))
    found = found.select((F.col("owner") % 7).cast("int").alias("part"), F.array("owner").alias("owners"), F.array(F.lit(0)).alias("places"))
    owners = np.arange(600)
    marks = keyed.bitmap_of(keyed.owners_of(found), 20)
    assert marks.has(owners).all()
    assert keyed.bitmap_of(found.select("owners"), 20).data.tobytes() == marks.data.tobytes()
    sent = keyed.bits_set(keyed.owners_of(found), lambda batch: keyed.Bitmap.places(batch.column(0).flatten().to_numpy(), 20), 20)
    assert sent.count() <= len(owners)


def test_words_sent_for_bitmaps_follow_the_documents(spark, monkeypatch):
    """Copies of one text, read in many tasks: neither bitmap takes more words than there are documents."""
    rng, counts, bits_set = random.Random(17), [], keyed.bits_set

    def counted(frame, places, bits):
        sent = bits_set(frame, places, bits)
        counts.append(sent.count())
        return sent

    monkeypatch.setattr(keyed, "bits_set", counted)
    text = prose(rng, 400, 9999)
    rows = [(i, f"{prose(rng, 5, 9999)} {text}", "", "", 0) for i in range(300)]
    found = substrings.remove_repeats(frame(spark, rows, 24)).collect()
    expected = repeats(rows)
    assert all(tuple(r)[1:] == expected[rows[r["doc_id"]][:2]] for r in found) and len(found) == 300
    assert len(counts) == 2 and 0 < min(counts) and max(counts) <= 300


def test_empty_tables(spark):
    docs = frame(spark, awkward()).limit(0)
    assert substrings.remove_repeats(docs).count() == 0
    assert jaccard.jaccard_join(docs).count() == 0


@pytest.mark.parametrize("most_small, frequent", [(12, 64), (12, 2), (0, 3), (6, 10**9)])
def test_classes_equal_brute_force(spark, most_small, frequent):
    """Whatever is small and whatever is frequent, the links are the same."""
    rows = awkward()
    found = jaccard.jaccard_join(frame(spark, rows), most_small=most_small, frequent=frequent).collect()
    expected = classes(rows)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]


def test_small_sets_at_the_threshold(spark):
    """Single words as shingles: all sizes up to 14, with one to three elements replaced."""
    rng, rows = random.Random(3), []
    for size in range(1, 15):
        for gone in range(4):
            base = [f"s{size}x{k}" for k in range(size)]
            rows.append((len(rows), " ".join(base[gone:] + [f"n{len(rows)}y{k}" for k in range(rng.randrange(3))]), "", "", 0))
    found = jaccard.jaccard_join(frame(spark, rows), shingle=1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == classes(rows, n=1)


def test_boundary_follows_the_costs(spark):
    few = spark.createDataFrame([(s, list(range(100 * s, 101 * s))) for s in range(1, 9)], "size bigint, elements array<bigint>")
    many = spark.createDataFrame([(8, [1, 2, 3, 4, 5, 6, 7, k]) for k in range(400)], "size bigint, elements array<bigint>")
    assert jaccard.boundary(few) < jaccard.boundary(many) == 12 or jaccard.boundary(many) >= 8


def test_a_chain_is_one_component(spark):
    chain = [(i + 1, i) for i in range(1, 200)] + [(500, 501), (7, 7), (None, 3)]
    found = components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert sorted((r["node"], r["component"]) for r in found) == [(i, 1) for i in range(1, 201)] + [(500, 500), (501, 500)]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_overlap_is_what_the_threshold_asks_for():
    for s in range(1, 40):
        for t in range(1, 40):
            least = next((i for i in range(min(s, t) + 1) if 100 * i >= 80 * (s + t - i)), None)
            if least is not None:
                assert jaccard.overlap(s, t) == least
    assert np.all(jaccard.prefix(np.arange(1, 200)) >= 1)


def test_bitmaps_never_rule_a_link_out():
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.sample(base, rng.randrange(1, 60)) if k % 3 else base[: rng.randrange(20, 60)]) for k in range(80)]
    (words_,) = slices(pa.array(texts))
    sets = jaccard.Sets(words_, 1)
    flips, plain = sets.flips(), [set(t.split()) for t in texts]
    ruled_out = 0
    for i in range(80):
        for j in range(i):
            both, either = len(plain[i] & plain[j]), len(plain[i] | plain[j])
            possible = jaccard.may_link(flips[i], int(sets.sizes[i]), flips[j], int(sets.sizes[j]))
            assert possible or 100 * both < 80 * either
            ruled_out += not possible
    assert ruled_out > 1000
