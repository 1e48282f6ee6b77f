"""Near-duplicates and copied strings against plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from paneldrift.llm import common, cover_tree, minhash, suffix_dedup  # noqa: E402

DOCS = "doc_id bigint, text string, node string, component_id int"


def docs_table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "x", 7) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def texts_with_copies() -> list:
    base = [brute.prose(s, 60) for s in range(12)]
    r = random.Random(5)
    texts = [None, "", " \n", "One two", "one TWO", "x", base[0]]
    for b in base[:6]:
        for _ in range(5):
            w = b.split()
            for _ in range(r.choice([0, 1, 2, 6])):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts + base + [base[3]] * 3 + [brute.prose(77, 6000)]


def test_minhash_links_near_texts_with_null_ids(spark):
    w = brute.prose(21, 120).split()
    far, middle, near = " ".join(w), " ".join([*w[:-9], *["p"] * 9]), " ".join([*["q"] * 9, *w[9:-9], *["p"] * 9])
    sets = [brute.shingles(t, 5) for t in (far, middle, near)]
    assert sorted(sorted(x) for x in brute.near_links(sets, 80)) == [[0, 1], [1, 2]]
    # the row without an id joins the two others
    got = minhash.near_duplicates(docs_table(spark, [far, middle, near], [4, None, 9])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(4, 4, True), (None, 4, False), (9, 4, False)}
    both = minhash.near_duplicates(docs_table(spark, [far, middle], [None, None])).collect()
    assert [(r["component_id"], r["kept"]) for r in both] == [(None, True)] * 2


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(200, 260)]
    edges = spark.createDataFrame(chain + hub + [(9, 9), (300, 301), (301, 300)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in common.components(edges).collect()}
    nodes = {x for e in chain + hub + [(300, 301)] for x in e}
    assert got == {k: v for k, v in brute.components(nodes, chain + hub + [(300, 301)]).items()}
    assert common.components(edges.limit(0)).collect() == []


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_minhash_finds_every_link(spark, size, percent):
    texts = texts_with_copies()
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_table(spark, texts), size, percent).collect()}
    sets = [brute.shingles(t, size) for t in texts]
    low = brute.components(range(len(texts)), brute.near_links(sets, percent))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        i: (len(s), low[i], low[i] == i) for i, s in enumerate(sets)
    }


def test_components_end_at_stars(spark, monkeypatch):
    names = []
    monkeypatch.setattr(common, "written", lambda df, name="table", f=common.written: names.append(name) or f(df, name))
    edges = spark.createDataFrame([(1, k) for k in range(2, 40)] + [(50, 51)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in common.components(edges).collect()}
    assert got == {k: 1 for k in range(1, 40)} | {50: 50, 51: 50}
    assert names == ["edges"]


def test_minhash_pairs_around_hubs_carry_no_differences(spark, monkeypatch):
    """Nodes of one hub meet as keys, and come out only if they are linked; each is apart from its hub."""
    base = list(range(100))
    odd = [base[:75] + [1000 + k for k in range(25)], base[:75] + [1000 + k for k in range(22)] + [2000, 2001, 2002]]
    odd += [base[:75] + [1000 + k for k in range(5)] + [3000 + k for k in range(20)]]
    held = dict(enumerate([base, *odd]))
    binary = [(k, np.array(sorted(v), np.uint64).tobytes()) for k, v in held.items()]
    sets = spark.createDataFrame(binary, "node bigint, shingles binary")
    near = spark.createDataFrame([(0, k) for k in held], "a bigint, b bigint")
    joined = spark.createDataFrame([], "id bigint, component bigint")
    tables = {}
    monkeypatch.setattr(minhash, "written", lambda df, name="table", f=minhash.written: tables.setdefault(name, f(df, name)))
    got = {tuple(sorted(r)) for r in minhash.around_hubs(near, sets, joined, 85).collect()}
    assert got == {(1, 2)} == {tuple(sorted((a + 1, b + 1))) for a, b in brute.near_links([set(x) for x in odd], 85)}
    assert {f.dataType.simpleString() for f in tables["hub_candidates"].schema} == {"bigint"}


def test_minhash_pairs_around_an_edited_hub(spark, monkeypatch):
    """An edit of the hub is a difference that all its nodes share, but it makes no candidates of them."""
    r, base = random.Random(8), list(range(148))

    def edited(n: int, own: int) -> set:
        lost = {3 * k + i for k in r.sample(range(49), n) for i in range(3)}
        return {x for x in base if x not in lost} | {1000 * own + i for i in range(3 * n)}

    tables, n_candidates = {}, []
    monkeypatch.setattr(minhash, "written", lambda df, name="table", f=minhash.written: tables.setdefault(name, f(df, name)))
    for nearest in (0, 1):
        tables.clear()
        held = [edited(1, 1), edited(nearest, 2)] + [edited(2 + k % 4, 3 + k) for k in range(80)]
        binary = [(k, np.array(sorted(v), np.uint64).tobytes()) for k, v in enumerate(held)]
        sets = spark.createDataFrame(binary, "node bigint, shingles binary")
        near = spark.createDataFrame([(0, k) for k in range(len(held))], "a bigint, b bigint")
        links = brute.near_links(held, 85)
        low = brute.components(range(len(held)), [p for p in links if 0 in p])
        joined = spark.createDataFrame(list(low.items()), "id bigint, component bigint")
        got = [tuple(x) for x in minhash.around_hubs(near, sets, joined, 85).collect()]
        assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in links}
        assert brute.components(low, got + list(low.items())) == brute.components(low, links)
        n_candidates.append(tables["hub_candidates"].count())
    # without a node in the middle, those of few edits meet those of many that lack one of the same shingles
    assert n_candidates[0] == 0 and n_candidates[1] <= 200


def test_minhash_open_lists_compare_like_sizes(spark, monkeypatch):
    """Texts that hold one long passage, of very different lengths, are no candidates."""
    asked = []

    def counted(pairs, *rest, f=minhash.agreeing):
        asked.append(pairs.count())
        return f(pairs, *rest)

    monkeypatch.setattr(minhash, "agreeing", counted)
    passage = brute.prose(1, 120)
    texts = [f"{passage} {brute.prose(900 + k, 40 if k % 2 else 110)}" for k in range(40)]
    got = minhash.near_duplicates(docs_table(spark, texts), size=3, percent=85).collect()
    sets = [brute.shingles(t, 3) for t in texts]
    assert brute.near_links(sets, 85) == [] and all(r["kept"] for r in got)
    like = sum(100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) for i, a in enumerate(sets) for b in sets[:i])
    assert asked[1] <= like


def test_minhash_miss_bound():
    assert minhash.least_agreements(100) == 32
    assert 10 <= minhash.least_agreements(80) < minhash.least_agreements(90)


def test_minhash_nulls_repeats_and_empty_tables(spark):
    t = brute.prose(1, 50)
    table = docs_table(spark, [t, t, t, None, "", "alone here"], [None, 4, 4, 5, 6, None])
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(table).collect())
    assert got == [(-1, -1, True), (-1, 4, False), (4, 4, True), (4, 4, True), (5, 5, True), (6, 6, True)]
    assert minhash.near_duplicates(table.limit(0)).collect() == []
    left = minhash.one_of_each(table)
    assert left.columns == table.columns
    assert sum(r["text"] == t for r in left.where("doc_id = 4").collect()) == 1


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(3)
    points = r.normal(size=(120, 8))
    near = points[:30].repeat(6, axis=0) + r.normal(scale=0.04, size=(180, 8))
    x = np.concatenate([points, near, points[:20], 3.5 * points[:5]])
    rows = [(i, [float(v) for v in p], "label") for i, p in enumerate(x)]
    n = len(rows)
    odd = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [], [1.0], [1.0, 0.0]]
    rows += [(n + i, v, "odd") for i, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>, cell string").repartition(5)
    got = {row["id"]: row for row in cover_tree.near_duplicates(frame, 0.95).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    low = brute.components(range(n), list(zip(*np.nonzero(close), strict=True)))
    for i in range(n):
        assert (got[i]["n_links"], got[i]["component_id"]) == (int(close[i].sum()), low[i])
        assert got[i]["kept"] == (low[i] == i)
    for i in range(n, n + len(odd)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert cover_tree.near_duplicates(frame.limit(0)).collect() == []


def test_tree_covers_and_halves():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(200, 4)), np.repeat(r.normal(size=(2, 4)), 100, 0) + r.normal(scale=1e-3, size=(200, 4))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    stack = [cover_tree.grow(x, np.arange(400), 0, 2.0, 0.01)]
    assert len(stack[0].members) == 400
    while stack:
        node = stack.pop()
        assert cover_tree.distances(x[node.members], x[node.centre][None]).max() <= node.radius
        assert node.centre in node.members
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
        stack += node.children


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("group", [1024, 2])
def test_copied_strings(spark, monkeypatch, keep_first, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    a, b, c = (brute.prose(s, 120) for s in (1, 2, 3))
    texts = [None, "", "short", a, a[:400] + b[:500], b[100:350] + c, c, c, "é" * 90 + a[50:300], "ab" * 400, a[:250] + "|" + a[:250]]
    texts += [brute.prose(50 + i, 40) + a[100:330] + brute.prose(90 + i, 40) for i in range(6)]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_copies(docs_table(spark, texts), 200, keep_first).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, mark in enumerate(brute.copied(raw, 200, keep_first)):
        kept = bytes(x for x, m in zip(raw[i], mark, strict=True) if not m)
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == brute.spans(mark), i
        assert hashlib.sha256(got[i]["kept"]).digest() == hashlib.sha256(kept).digest()
        assert got[i]["n_bytes"] == len(raw[i])


def test_each_window_belongs_to_its_first_smallest_seed(spark):
    texts = ["short", "a" * 300, "ab" * 150, brute.prose(1, 60), brute.prose(1, 60), brute.prose(2, 9) + brute.prose(1, 60)]
    r = np.random.default_rng(5)
    texts += ["".join(r.choice(list("xyz"), 400)) for _ in range(3)]
    got = {i: [] for i in range(len(texts))}
    for row in suffix_dedup.points(suffix_dedup._keyed(docs_table(spark, texts), "text", "doc_id"), 100).collect():
        got[row["doc"]] += [(row["pos"] - d, row["pos"]) for d in range(row["lo"], row["hi"] + 1)]
    for i, text in enumerate(texts):
        prefix, at = common.prefix_hashes(np.frombuffer(text.encode(), np.uint8)), np.arange(max(len(text) - suffix_dedup.SEED + 1, 0))
        seeds = common.range_hashes(prefix, at, at + suffix_dedup.SEED)
        first = [(x, x + int(np.argmin(seeds[x : x + 100 - suffix_dedup.SEED + 1]))) for x in range(len(text) - 99)]
        assert sorted(got[i]) == first, i


def test_copied_ranges_leave_only_ranges_on_disk(spark, monkeypatch):
    names = {}
    monkeypatch.setattr(suffix_dedup, "GROUP", 4)
    monkeypatch.setattr(
        suffix_dedup, "written", lambda df, name="table", f=common.written: names.setdefault(f(df, name), name) and list(names)[-1]
    )
    passage = brute.prose(3, 60)
    docs = docs_table(spark, [f"{brute.prose(10 + k, 30)} {passage} {brute.prose(40 + k, 30)}" for k in range(8)])
    keyed = suffix_dedup._keyed(docs, "text", "doc_id")
    assert suffix_dedup.copied_ranges(keyed, suffix_dedup.packed_texts(keyed), 100, True).count() > 0
    left = {n for t, n in names.items() if os.path.exists(t._durable_path.removeprefix("file:"))}
    assert "refined" in names.values() and left == {"ranges"}


def test_joins_by_hot_keys_read_tables_that_spark_can_split(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(suffix_dedup, "GROUP", 4)
    monkeypatch.setattr(
        suffix_dedup,
        "written",
        lambda df, name="table", f=common.written: plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df, name),
    )
    passage, line = brute.prose(3, 60), "the same line again and again, " * 60
    texts = [f"{brute.prose(10 + k, 30)} {passage} {brute.prose(40 + k, 30)} {line}" for k in range(8)]
    got = suffix_dedup.remove_copies(docs_table(spark, texts), 100, keep_first=False).collect()
    raw = [t.encode() for t in texts]
    for row, mark in zip(sorted(got, key=lambda r: r["doc_id"]), brute.copied(raw, 100, False), strict=True):
        assert [(s["start"], s["end"]) for s in row["spans"]] == brute.spans(mark)
    joins = {n: [p for p in made if "Join" in p] for n, made in plans.items() if n in ("shared_points", "chosen", "rest", "sized")}
    assert len(joins) == 4 and all(joins.values())
    assert [n for n, made in joins.items() for p in made if "Aggregate" in p] == []


def test_copied_strings_of_repeated_rows_and_empty_tables(spark):
    t = brute.prose(8, 100)
    table = docs_table(spark, [t, t, "other"], [None, None, 3])
    got = suffix_dedup.remove_copies(table, 200, keep_first=False).collect()
    assert sorted(len(r["kept"]) for r in got) == [0, 0, 5]
    table = docs_table(spark, [t, t, t[5:] + " end", "other"], [1, 1, 2, 3])
    got = sorted((r["doc_id"], len(r["spans"])) for r in suffix_dedup.remove_copies(table, 200, keep_first=True).collect())
    assert got == [(1, 0), (1, 0), (2, 1), (3, 0)]
    assert suffix_dedup.remove_copies(table.limit(0)).collect() == []


@pytest.mark.parametrize("keep_first", [True, False])
def test_contexts_that_agree_in_half_of_their_bits_are_not_copies(spark, keep_first):
    # found by search: around this passage, the upper 32 bits of both texts' context hashes agree
    passage = "ignsclghorqkixyljwkfelvhefipbuuz"
    texts = [f"{i:06d} " * 20 + passage + f" {i:06d}" * 20 for i in (35719, 66241)]
    found = suffix_dedup.points(suffix_dedup._keyed(docs_table(spark, texts), "text", "doc_id"), 200).where("pos = 140").collect()
    assert len({r["seed"] for r in found}) == 1 and len({r["context"] for r in found}) == 2
    got = suffix_dedup.remove_copies(docs_table(spark, texts), 200, keep_first).collect()
    assert [r["spans"] for r in got] == [[], []]
    assert sorted(r["kept"].decode() for r in got) == texts
