"""Conversation repair against a best-first search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import os
import random
import re
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from paneldrift.llm import conversations  # noqa: E402
from paneldrift.llm.queries import QUERIES  # noqa: E402

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, audit string"
DIGITS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of the rows of one conversation."""
    turns = {t for _, t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, kinds = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "cut" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, said, lines = heapq.heappop(heap)
        if (i, said[-1:]) in done:
            continue
        done.add((i, said[-1:]))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            break
        options = [(3, "I", i, said + r[0], (*lines, r + ":")) for r in ("user", "assistant")]
        if i < len(rows):
            _, _, role, text = rows[i]
            options.append((4, "D", i + 1, said, lines))
            if kinds[i] in ("", "cut"):
                more = 3 if kinds[i] else 0
                options.append((more, "K", i + 1, said + (role[:1] or "-"), (*lines, f"{role}:{text}")))
                options += [(3 + more, "R", i + 1, said + r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
        for more, letter, to, now, new in options:
            if re.fullmatch("(s?(ua)*u?)?", now):
                heapq.heappush(heap, (cost + more, audit + letter, to, now, new))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("cut"), illegal, cost, audit, digest)


def conversations_of(seed: int, lengths: list[int]) -> list[tuple]:
    r, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "cut short", "", None, " \t\n", "ends. ", "Ümlaut…", "a.b", "One. Two."]
    for conv, n in enumerate(lengths):
        expected = "user"
        for turn in range(n):
            role = expected if r.random() < 0.8 else r.choice(["user", "assistant", "system", "tool", "", None])
            if turn == 0 and r.random() < 0.3:
                role = "system"
            expected = {"user": "assistant"}.get(role or "", "user")
            text = r.choice(texts) if r.random() < 0.4 else f"Row {r.randrange(40)}."
            rows.append((conv or None, None if r.random() < 0.05 else turn + (r.random() < 0.05), role, text))
    return rows


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in DIGITS) for r in df.collect()}


@pytest.mark.parametrize(("rows_each", "partitions"), [(4096, "8"), (3, "8"), (5, "1")])
def test_repair_matches_search(spark, monkeypatch, tmp_path, rows_each, partitions):
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", rows_each)
    rows = conversations_of(rows_each, [r % 9 for r in range(90)] + [60, 1, 47])
    rows += [(500, 7, "assistant", "Only.")] * 3 + [(501, None, None, None), (501, None, "user", "A."), (501, None, "user", "B")]
    # turns 10 to 18 of a conversation whose rows are all dropped
    gone = next(c for c in range(600, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Never seen."))
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = found(QUERIES["op13_conversation_repair"](spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    each: dict = {r[0]: [] for r in rows}
    for r in damaged(rows):
        each[r[0]].append(r)
    assert got == {c: plain(sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))) for c, v in each.items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table_and_long_conversation(spark, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damage(empty)).collect() == []
    monkeypatch.setattr(conversations, "SEGMENT_BYTES", 4000)
    n = 3000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{'word ' * (i % 7)}{i}." + ("x" * 100000 + "." if i == 5 else "")) for i in range(n)]
    rows = [r for r in rows if zlib.crc32(f"1:{r[1]}".encode()) % 20 > 4 or r[1] % 100 == 0]
    got = found(conversations.repair(conversations.damage(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))))
    assert got == {1: plain(damaged(rows))}


def test_ties_take_the_least_audit():
    costs = conversations.Costs()
    # a lone reply: dropping it costs 4, adding a question before it 3
    assert conversations.least_audits([(b"\x05", conversations.END, True)], costs)[0][0][0] == "IK"
    # two questions: insert a reply between (3 + 3 at the end) or change the second (3)
    assert conversations.least_audits([(b"\x03\x03", conversations.END, True)], costs)[0][0][0] == "KR"
