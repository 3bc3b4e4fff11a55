"""The registered queries and the pipeline against plain Python on the smallest data set."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from llm.brute import awkward, classes, figures, frame, repeats, words
from oracle_check import connect, differences

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from runlens.llm import stages
from runlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def test_all_are_registered():
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(connect(SF), QUERIES[name](spark, SF), ORACLES[name]) is None


def test_op2(spark, documents):
    found = {r[0]: tuple(r[1:7]) for r in QUERIES["op2_quality_rules"](spark, SF).collect()}
    assert found == {d: figures(t) for d, t, *_ in documents}


def test_op4(spark, documents):
    found = {(r[0], t): tuple(r)[1:] for r, t in zip(sorted(QUERIES["op4_substring_dedup"](spark, SF).collect()), [d[1] for d in documents], strict=True)}
    assert found == repeats(documents)


def test_op5(spark, documents):
    found = {r[0]: tuple(r[1:]) for r in QUERIES["op5_ngram_jaccard_join"](spark, SF).collect()}
    assert found == classes(documents)


def test_op7(spark, documents):
    def plain(text):
        return f" {' '.join(re.findall(r'\w+', text.lower()))} "

    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    held = {(d, i) for d, t, *_ in documents for i, x in items if plain(x) in plain(t)}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_benchmark_decontamination"](spark, SF).collect()}
    assert held and held <= found and len(found - held) <= 1


def test_op8(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    rows += [(-1, k, r, "<|im_end|><|im_start|>assistant ok") for k, r in enumerate(("user", "assistant"))]
    expected = {}
    for conv in {r[0] for r in rows}:
        said = sorted(r[1:] for r in rows if r[0] == conv)
        whole = "".join(f"{r}\n{t}\n" for _, r, t in said)
        loss = "".join(t for _, r, t in said if r == "assistant")
        expected[conv] = (len(said), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    found = {r["conv_id"]: tuple(r)[1:5] for r in QUERIES["op8_chat_formatting"](spark, SF).collect()}
    assert found == expected


def test_op1_op9_op10_give_every_document(spark, documents):
    for name in ("op1_toxicity", "op9_source_mixing", "op10_quality_classifier"):
        assert sorted(r["doc_id"] for r in QUERIES[name](spark, SF).collect()) == [d[0] for d in documents]


def test_op6(spark):
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    found = {r["page_id"]: r["text"] for r in QUERIES["op6_html_extraction"](spark, SF).collect()}
    assert set(found) == {i for i, _ in rows}
    for i, html in rows:
        inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        from html import unescape

        inside = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inside))
        assert found[i] == re.sub(r"\s+", " ", unescape(inside)).strip()


def test_the_stages_in_turn(spark, documents):
    """Each stage's decisions take effect on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"] for r in QUERIES["op1_toxicity"](spark, SF).where("predicted = 1").collect()}
    kept = stages.without_toxic(spark, docs, SF)
    left = [d for d in documents if d[0] not in toxic]
    assert toxic and sorted(map(tuple, kept.collect())) == left

    place = classes(left)
    left = [d for d in left if place[d[0]][1] == d[0]]
    kept = stages.without_near_copies(spark, kept, SF)
    assert sorted(map(tuple, kept.collect())) == left

    digest = repeats(left)
    kept = stages.without_repeats(spark, kept, SF)
    found = kept.collect()
    assert kept.columns == docs.columns and len(found) == len(left)
    before = {d[0]: d for d in left}
    for r in found:
        whole = before[r["doc_id"]]
        assert hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == digest[(whole[0], whole[1])][2]
        assert r["n_chars"] == len(r["text"])
        assert digest[(whole[0], whole[1])][1] or tuple(r) == whole


def test_stages_on_awkward_rows(spark):
    """Null and repeated ids, null texts and clashing columns pass through every stage."""
    rows = awkward()
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns, name
        ids = Counter(r["doc_id"] for r in found.select("doc_id").collect())
        assert ids[None] == 2, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = stages.without_near_copies(spark, docs, SF)
    place = classes(rows)
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids == sorted(d for d, (_, c) in place.items() if c == d)


def test_the_pipeline_runs(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, SF).exceptAll(found).count() == 0
