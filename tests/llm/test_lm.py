"""Elias-Fano tries, and language-model scores against a plain trigram model."""

from __future__ import annotations

import math
import mmap
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from paneldrift.llm import lm  # noqa: E402
from paneldrift.llm.elias_fano import Sequence, Trie, log10_of, quantised  # noqa: E402
from paneldrift.llm.queries import QUERIES  # noqa: E402

SCHEMA = "doc_id bigint, text string, block string, tokens int, held_out_by string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**56 - 1), max_size=60), st.lists(st.integers(0, 2**56), max_size=20), st.integers(0, 50))
def test_sequence_reads_and_searches(values, wanted, shift):
    v = np.sort(np.array(values, np.int64) >> shift)
    s = Sequence.of(v)
    assert s.get(np.arange(len(v))).tolist() == v.tolist()
    x = np.array(wanted, np.int64) >> shift
    found = s.successor(np.zeros(len(x), np.int64), np.full(len(x), len(v)), x)
    assert found.tolist() == np.searchsorted(v, x).tolist()


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("top", [3, 60, 1 << 38])
def test_trie_on_a_mapped_file(tmp_path, order, top):
    r = np.random.default_rng(order)
    for n in (0, 1, 400):
        rows = np.unique(r.integers(0, top, (n, order)), axis=0)
        codes = r.integers(1, 65536, len(rows))
        (tmp_path / f"{n}").write_bytes(Trie.of(list(rows.T), codes).tobytes())
        with open(tmp_path / f"{n}", "rb") as f:
            trie = Trie.open(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        known = dict(zip(map(tuple, rows.tolist()), codes.tolist()))
        asked = np.concatenate([rows, r.integers(0, top, (200, order))])
        assert trie.code(list(asked.T)).tolist() == [known.get(tuple(q), 0) for q in asked.tolist()]


def test_codes_and_packing():
    p = np.array([1.0, 0.5, 1e-9, 1e-20])
    assert np.abs(log10_of(quantised(p)) - np.log10(p)).max() < 1 / 5999
    for x in ([], [0], [255, 0, 3], [1 << 56, 7]):
        assert lm.unpack(lm.pack(np.array(x, np.int64))).tolist() == x


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def plain(texts, held):
    """n_tokens, n_known, train_tokens, base_score, score."""
    one, two, three, context = Counter(), Counter(), Counter(), Counter()
    for text, h in zip(texts, held):
        line = ["^", "^", *tokens(text)]
        for a, b, c in zip(line, line[1:], line[2:]):
            if not h:
                one[c] += 1
                two[b, c] += 1
                three[a, b, c] += 1
                context[a, b] += 1
                context[b] += 1
    n, v = sum(one.values()), len(one)

    def p(a, b, c):
        x = (one[c] + 1) / (n + v + 1)
        if context[b] >= lm.LEAST:
            x = (two[b, c] + lm.PRIOR * x) / (context[b] + lm.PRIOR)
        if context[a, b] >= lm.LEAST:
            x = (three[a, b, c] + lm.PRIOR * x) / (context[a, b] + lm.PRIOR)
        return x

    out = []
    for text in texts:
        line = ["^", "^", *tokens(text)]
        base = sum(math.log10((one[c] + 1) / (n + v + 1)) for c in line[2:])
        score = sum(math.log10(p(*g)) for g in zip(line, line[1:], line[2:]))
        out.append((len(line) - 2, sum(one[c] > 0 for c in line[2:]), n, base, score))
    return out


TEXTS = ["", None, " \t\n", "One one ONE one", "the end the end the end", "\x0b\x0c odd\rblanks ", "ÄÖ äö Äö", "lonely-word"]


@pytest.mark.parametrize(("block", "shard"), [(1 << 23, 1 << 20), (600, 40)])
def test_scores_match_plain_model(spark, monkeypatch, tmp_path, block, shard):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "SHARD_GRAMS", shard)
    texts = TEXTS + [brute.prose(i % 9, 40 + i) for i in range(60)] + ["a b c d " * 900] + [brute.prose(3, 30)] * 4
    rows = [(i, t, "b", 3, "x") for i, t in enumerate(texts)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op11_lm_score"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, (n, known, train, base, score) in enumerate(plain(texts, held)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-12)
        assert abs(r["score"] - score) <= n / 2500
        assert 0 > r["score"] or n == 0


def test_probabilities_of_a_context_add_up(spark):
    texts = ["a b", "a c", "a b", "d b c", "a"]
    words = [w for t in texts for w in tokens(t)]
    seen, v = set(words), len(set(words))
    probes = [f"a {w}" for w in sorted(seen - {"\n"})] + ["a unseen", "a"]
    frame = spark.createDataFrame([(i, t, i >= 5) for i, t in enumerate(texts + probes)], "doc_id bigint, text string, held_out boolean")
    got = {r["doc_id"]: r["score"] for r in lm.score(frame).collect()}
    want = dict(enumerate(plain(texts + probes, [i >= 5 for i in range(len(texts + probes))])))
    assert all(abs(got[i] - want[i][4]) < 0.003 for i in want) and v == 5


def test_repeats_nulls_and_nothing(spark):
    schema = "doc_id bigint, text string, held_out boolean"
    assert lm.score(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "x y", None), (None, "x y", None), (3, None, True), (3, "x", True)]
    got = sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in lm.score(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, False, 3, 3, 6), (0, False, 3, 3, 6), (3, True, 1, 1, 6), (3, True, 2, 2, 6)]
    alone = lm.score(spark.createDataFrame([(1, "all held out", True)], schema)).collect()[0]
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"], alone["score"]) == (0, 0, 0.0, 0.0)


def test_keys_are_numbered_in_order_with_their_first_places():
    r = np.random.default_rng(6)
    for keys in (r.integers(0, 50, 400), r.integers(0, 1 << 62, 400).repeat(2), np.zeros(0, np.int64), np.array([7])):
        for got, wanted in zip(lm.numbered(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True):
            assert np.array_equal(got, wanted)
    ids = [r.integers(0, 1 << 40, 300) for _ in range(2)]
    g = lm.Grams(ids, np.ones(300, np.int64), np.full(300, lm.LEAST), np.ones(300), lm.distinct(ids)[0])
    rows, shard = g.sent(3)
    assert np.array_equal(rows, np.lexsort([*ids[::-1], lm.shard_of(ids, 3)])) and np.array_equal(shard, lm.shard_of([c[rows] for c in ids], 3))


def test_keys_that_leave_no_room_for_their_places_are_sorted_as_numbers(monkeypatch):
    r = np.random.default_rng(8)
    wide = r.integers(0, 1 << 56, 3000).repeat(3)
    r.shuffle(wide)
    wanted = np.unique(wide, return_index=True, return_inverse=True)
    alike = np.array([1 << 61, (1 << 61) + 1, 5, 1 << 61])  # begin alike, so they are told apart by all bits
    also = np.unique(alike, return_index=True, return_inverse=True)
    for got, want in zip(lm.numbered(alike), also, strict=True):
        assert np.array_equal(got, want)
    monkeypatch.setattr(lm.np, "unique", None)
    for got, want in zip(lm.numbered(wide), wanted, strict=True):
        assert np.array_equal(got, want)


def test_neighbours_that_begin_alike_are_searched_once(monkeypatch):
    r = np.random.default_rng(9)
    rows = np.unique(r.integers(0, 40, (3000, 3)), axis=0)
    trie = Trie.of(list(rows[::2].T), np.arange(1, len(rows[::2]) + 1))
    searched = []
    successor = Sequence.successor
    monkeypatch.setattr(Sequence, "successor", lambda s, a, b, x: searched.append(len(x)) or successor(s, a, b, x))
    place = trie.find(list(rows.T))
    assert place[::2].tolist() == list(range(len(rows[::2]))) and (place[1::2] == -1).all()
    assert searched[0] == len(np.unique(rows[:, 0])) and searched[1] <= len(np.unique(rows[:, :2], axis=0))
    mixed = r.permutation(len(rows))
    assert np.array_equal(trie.find(list(rows[mixed].T)), place[mixed])


def test_only_ids_and_counts_travel():
    r = np.random.default_rng(10)
    line = np.unique(r.integers(0, 1 << 20, (4000, 2)), axis=0)
    p = r.random(len(line))
    g = lm.Grams(list(line.T), r.integers(0, 3, len(line)), r.integers(2, 40, len(line)), p, np.arange(len(line)))
    sent = list(lm.messages("b", g, 3))
    got = [a for m in sent for a in lm.answers(m["shard"], 3, [m])]
    besides = sum(len(v) for row in (*sent, *got) for c, v in row.items() if c != "ids" and isinstance(v, bytes))
    assert besides < len(line)  # one byte an n-gram, both ways
    (counts,) = lm.received(g, 3, got, "counts")
    assert counts.tolist() == g.counts.tolist()


def test_counts_are_read_from_tries(monkeypatch):
    g = lm.Grams([np.array([1, 1, 7]), np.array([2, 3, 2])], np.array([5, 0, 70_000]), np.full(3, 9), np.full(3, 0.5), np.arange(3))
    (sent,) = lm.messages("b", g, 1)
    twice = list(lm.answers(0, 1, [sent, sent | {"block": "c"}]))
    assert [lm.unpack(a["counts"]).tolist() for a in twice] == [[10, 0, 140_000]] * 2 and [a["known"] for a in twice] == [2, 0]
    monkeypatch.setattr(lm.Trie, "code", lambda trie, grams: np.zeros(len(grams[0]), np.int64))
    assert lm.unpack(next(lm.answers(0, 1, [sent]))["counts"]).tolist() == [0, 0, 0]


def test_scores_are_not_rounded(spark):
    texts = [brute.prose(i % 5, 40 + i) for i in range(20)]
    held = [i % 7 == 2 for i in range(20)]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(list(zip(range(20), texts, held)), "doc_id bigint, text string, held_out boolean")).collect()}
    assert [got[i] for i in range(20)] == pytest.approx([row[4] for row in plain(texts, held)], rel=1e-11)
