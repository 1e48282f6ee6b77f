"""Two tokenizers' alignment against a plain version, and the composition of fragments."""

from __future__ import annotations

import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from paneldrift.llm import alignment  # noqa: E402
from paneldrift.llm.queries import QUERIES  # noqa: E402

PATHS = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
SCHEMA = "doc_id bigint, text string, key string, block string, n_a int"
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def groups(text: str | None) -> list[tuple[list[int], list[int]]]:
    """Whole text at once, group by group."""
    t = alignment.tokenizers(*PATHS)
    if not text:
        return []
    a = t.a.encode(" " + text, add_special_tokens=False).ids
    b = t.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(t.bytes_a[i] for i in a) != raw or b"".join(t.bytes_b[i] for i in b) != raw:
        return []
    ends = []
    for ids, table in ((a, t.bytes_a), (b, t.bytes_b)):
        at, k = [], 0
        for i in ids:
            k += len(table[i])
            at.append(k)
        ends.append(at)
    common = set(ends[0]) & set(ends[1])
    out, now = [], ([], [])
    events = sorted([(e, 0, i) for i, e in enumerate(ends[0])] + [(e, 1, i) for i, e in enumerate(ends[1])])
    for e, side, i in events:
        now[side].append((a, b)[side][i])
        if side == 1 and e in common:
            out.append(now)
            now = ([], [])
    return out


def plain(texts):
    linked, count = [], Counter()
    for text in texts:
        c = Counter((x, y) for ga, gb in groups(text) for x in ga for y in gb)
        linked.append(c)
        count.update(c.keys())
    best: dict = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for text, c in zip(texts, linked):
        g = groups(text)
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
            sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
            hashlib.sha256(line.encode()).hexdigest() if g else "",
        ))
    return out


TEXTS = [
    "Hello world", " two  spaces ", "", None, "x  y　 z", "tabs\t and\n lines \n", "<|endoftext|> </s> <unk>",
    "mark ▁ inside", "日本語の文章です。これはペンです", "Ünïcödé — “quotes” … 😀 👩‍👩‍👧", "a", "a", " ", "\n\n\n",
    "deadbeef" * 40, "1234567890 " * 30, "https://example.org/a_b?c=d&e=%20", "don't we'll they've", "\x00\x01 b\x7f c",
    "aaaa" * 300 + " bbbb", "é é   x   y",
]


@pytest.mark.parametrize(("size", "block"), [(1 << 16, 1 << 22), (40, 500)])
def test_alignment_matches_plain(spark, monkeypatch, tmp_path, size, block):
    monkeypatch.setattr(alignment, "RANGE_CHARS", size)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "FAN", 3)
    monkeypatch.setattr(alignment, "LISTED", 5 if block == 500 else 4096)
    texts = TEXTS + [brute.prose(i, 30) for i in range(30)] + [brute.prose(1, 30)] * 3 + [brute.prose(5, 400) + " ▁ end"]
    rows = [(i, t, "k", "b", 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in QUERIES["op12_tokenizer_alignment"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(plain(texts)))


def test_repeats_nulls_and_nothing(spark):
    rows = [(None, "same text", "", "", 0), (None, "same text", "", "", 0), (4, "same text", "", "", 0), (4, None, "", "", 0)]
    got = sorted(
        (r["doc_id"] or -1, r["n_a"], r["count_sum"]) for r in alignment.align(spark.createDataFrame(rows, SCHEMA), *PATHS).collect()
    )
    assert [g[0] for g in got] == [-1, -1, 4, 4] and [g[2] for g in got] == [6, 6, 0, 6]
    assert alignment.align(spark.createDataFrame([], SCHEMA), *PATHS).collect() == []


def test_long_texts(spark):
    texts = [brute.prose(3, 60000), "x" * 300000, " " * 300000, "日本" * 60000 + " end", "0123456789" * 20000]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in alignment.align(spark.createDataFrame(rows, SCHEMA), *PATHS).collect()}
    assert got == dict(enumerate(plain(texts)))


def test_fragments_compose_from_any_byte_ranges():
    r = random.Random(2)
    t = alignment.tokenizers(*PATHS)
    for text in [x for x in TEXTS if x] + [brute.prose(9, 50)]:
        whole = alignment.stretch_fragment(text, t)
        if whole is None:
            continue
        a, _, b, _ = alignment.encoded([" " + text], t)
        ends_a, ends_b = np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b])
        for _ in range(5):
            cuts = sorted({0, int(ends_a[-1]), *(r.randrange(int(ends_a[-1]) + 1) for _ in range(6))})
            parts = []
            for lo, hi in zip(cuts, cuts[1:]):
                ia, ib = (ends_a > lo) & (ends_a <= hi), (ends_b > lo) & (ends_b <= hi)
                parts.append(alignment.fragment(a[ia], ends_a[ia], b[ib], ends_b[ib]))
            while len(parts) > 1:
                i = r.randrange(len(parts) - 1)
                parts[i : i + 2] = [alignment.compose(parts[i], parts[i + 1])]
            for got, want in zip(parts[0], whole):
                assert np.array_equal(got, want)


def test_byte_ranges_tile_the_text():
    for text in TEXTS:
        if text:
            parts = list(alignment.ranges(text, 7))
            assert " ".join(parts) == text
