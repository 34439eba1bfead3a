"""The pipeline stage by stage against brute force, each judged on its own input."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_checks import check_packing, reference_print

import corpus_pipeline
from fareindex.llm import secret_scan


@pytest.fixture(scope="module")
def steps(spark, sf):
    small = sf.replace("sf0.01", "sf0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "12 34 ...", "en", "s", 9), (9003, "stupid moron idiot trash scum loser", "en", "s", 35), (9004, "password = hunter2hunter2", "en", "s", 25)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).cache()
    found = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        found[name] = docs
    return found


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_stay(steps):
    names = steps["input"].columns
    assert all(steps[n].columns == names for n, _ in corpus_pipeline.STAGES[:-1])


def test_language_drops_letterless_only(steps):
    assert ids(steps["input"]) - ids(steps["language"]) == {9001, 9002}


def test_toxicity_drops_the_planted_and_keeps_most(steps):
    before, after = ids(steps["language"]), ids(steps["toxicity"])
    assert 9003 in before and 9003 not in after and after < before and len(after) > 0.8 * len(before)


def test_one_document_of_each_group_stays(steps):
    rows = steps["toxicity"].select("doc_id", "text").collect()
    prints = {r["doc_id"]: reference_print(r["text"], 5) for r in rows}
    words = {r["doc_id"]: (r["text"] or "").lower().split() for r in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for d, w in words.items()}

    def linked(a, b):
        return (prints[a] ^ prints[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    near = [(a, b) for a in prints for b in prints if a < b and linked(a, b)]
    least = {d: d for d in prints}
    for _ in range(len(prints)):  # spread the least id until nothing changes
        links = [(x, y) for a, b in near for x, y in ((a, b), (b, a)) if least[x] < least[y]]
        if not links:
            break
        for a, b in links:
            least[b] = min(least[b], least[a])
    assert ids(steps["near_duplicates"]) == set(least.values())


def test_secrets_are_masked_and_the_rest_is_kept(steps):
    before = {r["doc_id"]: r["text"] for r in steps["near_duplicates"].collect()}
    after = {r["doc_id"]: r for r in steps["secrets"].collect()}
    assert before.keys() == after.keys()
    for d, text in before.items():
        assert after[d]["n_chars"] == len(after[d]["text"])
        if not secret_scan.base_spans(text, secret_scan.runs(text)) and "<random>" not in after[d]["text"]:
            assert after[d]["text"] == text


def test_a_planted_secret_is_masked(spark, steps, sf):
    kept = corpus_pipeline.secret_stage(spark, steps["input"], sf).where("doc_id = 9004").first()
    assert kept["text"] == "<assign>" and kept["n_chars"] == 8


def test_packing_places_what_is_left(steps):
    check_packing(steps["secrets"].select("doc_id", "text").collect(), steps["packing"].collect())


def test_run_writes_every_stage(spark, sf):
    small = sf.replace("sf0.01", "sf0.001")
    pieces = corpus_pipeline.run(spark, small).collect()
    by_doc = defaultdict(int)
    for p in pieces:
        by_doc[p["doc_id"]] += p["length"]
    assert all(len(p["ids"]) == p["length"] and zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
    assert by_doc and all(by_doc[p["doc_id"]] == p["doc_tokens"] for p in pieces)
