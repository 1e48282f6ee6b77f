"""The pipeline's stages against plain versions, also on repeats, ties, long texts and extra columns."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from paneldrift.llm.queries import ORACLES, QUERIES  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    texts = [(brute.prose(i, 60), "ab"[i % 2], f"s{i % 3}") for i in range(40)]
    texts += [(texts[3][0], "b", "s1"), (texts[5][0] + " more", "a", None), (None, None, None), ("12 !", "a", "s0")]
    texts += [(brute.prose(99, 50) + " token=abcdef0123456789abcdef", None, "s2")]
    rows = [(i, t, lang, s, len(t or "")) for i, (t, lang, s) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    source = {r["doc_id"]: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        if name != "bpe_tokens":
            assert docs.columns == COLUMNS
    assert {r["doc_id"] for r in seen["language_id"]} == set(range(42)) | {44}
    assert {r["doc_id"] for r in seen["near_dedup"]} == set(range(40)) | {44}
    clean = {r["doc_id"]: r["text"] for r in seen["secret_scan"]}
    assert clean[44].endswith(" [SECRET]") and all(clean[i] == source[i]["text"] for i in range(40))
    sizes = {}
    for r in seen["secret_scan"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    target = brute.targets(sizes)
    taken = {}
    for r in seen["mix_sources"]:
        assert r["text"] == clean[r["doc_id"]]
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    assert all(abs(taken[s] - target[s]) <= 31 * 2 for s in target)
    assert len(seen["bpe_tokens"]) == len(seen["mix_sources"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == sorted(
        r["doc_id"] for r in seen["bpe_tokens"]
    )


def test_stages_on_repeats_ties_long_texts_and_extra_columns(spark, tmp_path):
    long = brute.prose(7, 40000)
    texts = [(i, brute.prose(i, 60), "ab"[i % 2], f"s{i % 2}") for i in range(30)]
    texts += [(3, texts[3][1], "b", "s1")] * 3  # rows repeated
    texts += [(40, long, "a", "s0"), (41, long + " end", "a", "s1"), (None, brute.prose(77, 60), "a", None)]
    secret = " token=abcdef0123456789abcdef" * 400
    texts += [(42, brute.prose(88, 900) + secret, "b", "s0")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, position double, row string, spans int, _id string"
    rows = [(i, t, lang, s, len(t), 0.5, "r", 1, "x") for i, t, lang, s in texts]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        assert name == "bpe_tokens" or docs.columns == names
        if name != "bpe_tokens":
            assert all((r["position"], r["row"], r["spans"], r["_id"]) == (0.5, "r", 1, "x") for r in seen[name])
    assert len(seen["language_id"]) == len(rows)
    left = [r["doc_id"] for r in seen["near_dedup"]]
    assert left.count(None) == 1 and sorted(i for i in left if i is not None) == [*range(30), 40, 42]
    clean = {r["doc_id"]: r["text"] for r in seen["secret_scan"]}
    assert clean[42].count("[SECRET]") == 400 and "abcdef0123" not in clean[42] and clean[40] == long
    assert all(r["n_chars"] == len(r["text"]) for r in seen["secret_scan"])
    counts: dict = {}
    for r in seen["mix_sources"]:
        assert r["text"] == clean[r["doc_id"]]
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts and max(counts.values()) <= 2
    assert len(seen["bpe_tokens"]) == len(seen["mix_sources"])


def test_stages_of_an_empty_table(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
