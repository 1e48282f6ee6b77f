"""Conversation structure repair: cheapest edits to turns that alternate, least audit among the cheapest.

A conversation is a line of rows; a node is a place in it and one of four states: nothing said, the
system spoke, the user spoke, the assistant spoke. Edits are arcs, and the cheapest way from every
node to the end comes from a dynamic program. Among the arcs of cheapest ways, nodes are ranked by the
first 1, 2, 4, ... letters of their audits (prefix doubling), and the least path is read off the
doubled pointers.

Long conversations are cut into segments of bounded size. A segment acts on costs as a 4 x 4 matrix
over (min, +), so segments are composed in order and then solved on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import required, written

#: A segment ends with this many rows or bytes of text of one conversation, whichever comes first.
SEGMENT_ROWS = 4096
SEGMENT_BYTES = 1 << 20

BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
INSERT, REROLE, DELETE, UNFINISHED = 3, 3, 4, 3
LETTERS = "DIKR"
#: State after a reply in a state: a user speaks, or an assistant after a user.
NEXT = (2, 2, 3, 2)
SPEAKER = {2: "user", 3: "assistant"}
#: State after a kept row, by the class of its role's initial (s, u, a, other); -1: not allowed.
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
CLASS = {"s": 0, "u": 1, "a": 2}
FAR = 1 << 40

SPOKEN = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# ---------------------------------------------------------------- rows


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults by crc32 of 'conv:turn' modulo 20; nulls count as one space.

    0 drops a row (it stays with present = false, so that its conversation is known), 1 empties its
    text, 2 removes sentence ends, 3 repeats it, 4 makes it the user's.
    """

    def filled(c: str):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    body = F.when(fault == 1, "").when(fault == 2, F.translate(filled(text), ENDINGS, "")).otherwise(filled(text))
    once = rows.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.when(fault == 4, "user").otherwise(filled(role)).alias("role"),
        body.alias("text"),
        (fault != 0).alias("present"),
        fault.alias("fault"),
    )
    copies = F.array_repeat(F.lit(True), F.when(F.col("fault") == 3, 2).otherwise(1).cast("int"))
    return once.select("conv_id", "turn", "role", "text", "present", F.explode(copies).alias("copy")).drop("copy")


def fingerprint(role: str, text: str) -> str:
    """Of a row's role and text; ``_fingerprints`` gives the same as an expression."""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def _fingerprints():
    return F.transform(
        F.arrays_zip("roles", "texts"),
        lambda r: F.sha2(F.concat(F.length(r["roles"]).cast("string"), F.lit(":"), r["roles"], r["texts"]), 256),
    )


def judged(roles: list[str], texts: list[str], late: set[str]) -> tuple[bytes, list[int]]:
    """Kind of each row and the numbers of blank, duplicate and truncated rows.

    Kind 0 must be deleted; others are 1 + 2 * class of the role's initial + truncated. ``late``
    holds the fingerprints that earlier segments of the conversation have.
    """
    seen: set[tuple[str, str]] = set()
    kinds, faults = bytearray(), [0, 0, 0]
    for role, text in zip(roles, texts):
        body = text.rstrip(BLANKS)
        known = (role, text) in seen or (bool(late) and fingerprint(role, text) in late)
        seen.add((role, text))
        if not body or known:
            faults[1 if body else 0] += 1
            kinds.append(0)
            continue
        cut = body[-1] not in ENDINGS
        faults[2] += cut
        kinds.append(1 + 2 * CLASS.get(role[:1], 3) + cut)
    return bytes(kinds), faults


def illegal(roles: list[str]) -> int:
    """Adjacent rows whose role initials are not su, ua or au."""
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


# ---------------------------------------------------------------- cost


def _row_arcs(kind: int, state: int) -> Iterator[tuple[int, int, int]]:
    """(letter, cost, next state) of the edits of a row."""
    yield 0, DELETE, state
    if kind:
        role, cut = divmod(kind - 1, 2)
        if KEPT[role][state] >= 0:
            yield 2, UNFINISHED * cut, KEPT[role][state]
        yield 3, REROLE + UNFINISHED * cut, NEXT[state]


class Costs:
    """One step of the dynamic program, remembered by kind and by costs ahead less their minimum."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[tuple, int, int]] = {}
        self.masks: list[tuple[int, ...]] = [(0, 0, 0, 0)]

    def step(self, kind: int, ahead: tuple[int, ...]) -> tuple[tuple, int, int]:
        """Costs before the row less their minimum, that minimum, and the number of its optimal arcs."""
        if (kind, ahead) not in self.known:
            through = [
                min(((c + ahead[to], letter) for letter, c, to in _row_arcs(kind, q)), default=(FAR, 0))[0]
                for q in range(4)
            ]
            reply = {2: min(through[2], INSERT + through[3]), 3: min(through[3], INSERT + through[2])}
            best = [reply[q] if q in reply else min(through[q], INSERT + reply[2]) for q in range(4)]
            mask = []
            for q in range(4):
                arcs = {letter for letter, c, to in _row_arcs(kind, q) if c + ahead[to] == best[q] < FAR}
                arcs |= {1} if INSERT + best[NEXT[q]] == best[q] < FAR else set()
                mask.append(sum(1 << letter for letter in arcs))
            low = min(best)
            self.masks.append(tuple(mask))
            self.known[kind, ahead] = tuple(min(b - low, FAR) for b in best), low, len(self.masks) - 1
        return self.known[kind, ahead]

    def back(self, kinds: bytes, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], list[int]]:
        """Costs from the start of the rows, and for each row the number of its optimal arcs."""
        low = min(ahead)
        state, arcs = tuple(min(a - low, FAR) for a in ahead), []
        for kind in reversed(kinds):
            state, more, at = self.step(kind, state)
            low += more
            arcs.append(at)
        return tuple(s + low if s < FAR else FAR for s in state), arcs[::-1]

    def matrix(self, kinds: bytes) -> list[int]:
        """Cheapest cost from each state before the rows to each state behind them, row by row."""
        columns = [self.back(kinds, tuple(0 if q == to else FAR for q in range(4)))[0] for to in range(4)]
        return [columns[to][q] for q in range(4) for to in range(4)]


#: Costs behind the last row: what must be inserted to end after an assistant, or with nothing said.
END = (0, 2 * INSERT, INSERT, 0)
_END_MASK = (0, 2, 2, 0)


# ---------------------------------------------------------------- least audits


def least_audits(parts: list[tuple[bytes, tuple[int, ...], bool]], costs: Costs) -> list[list[tuple[str, int]]]:
    """For each part (kinds, costs behind it, is it the last of its conversation) and each of the four
    entry states: the least audit of a cheapest way through it, and the state behind it.

    Nodes of all parts are ranked together. Round k ranks them by the first 2^k letters: a pair of
    the rank of a node and of the node 2^(k-1) letters on. A node's optimal arcs have different letters,
    so its least arc is the one with the least letter; two cheapest ways from a node never are
    prefixes of each other, as the longer one would cost an insertion more.
    """
    kinds = np.concatenate([np.frombuffer(k + b"\0", np.uint8) for k, _, _ in parts])
    at = np.zeros(len(kinds), np.int64)
    first = np.concatenate([[0], np.cumsum([len(k) + 1 for k, _, _ in parts])])
    for i, (k, ahead, _) in enumerate(parts):
        at[first[i] : first[i] + len(k)] = costs.back(k, ahead)[1]
    masks = np.array(costs.masks, np.int64)[at]
    ends = first[1:] - 1
    masks[ends] = [_END_MASK if last else (0, 0, 0, 0) for _, _, last in parts]
    mask = masks.ravel()

    kept = np.array([[-1] * 4] + [list(KEPT[(k - 1) // 2]) for k in range(1, 9)])
    node = np.arange(len(mask))
    state, following = node % 4, np.tile(NEXT, len(kinds))
    target = np.empty((len(mask), 4), np.int64)
    target[:, 0] = node + 4
    target[:, 1] = node - state + following
    target[:, 2] = node - state + 4 + kept[np.repeat(kinds, 4), state]
    target[:, 3] = node - state + 4 + following
    least = np.array([0] + [(m & -m).bit_length() for m in range(1, 16)])[mask]
    pointers = [np.where(least > 0, target[node, np.maximum(least, 1) - 1], node)]
    rank = least.copy()
    longest = 3 * int(np.diff(first).max()) + 4
    while 1 << len(pointers) < longest:
        rank = np.unique(rank * (rank.max() + 1) + rank[pointers[-1]], return_inverse=True)[1]
        pointers.append(pointers[-1][pointers[-1]])

    # equally ranked entries have the same audit, which is spelled once
    entries = (4 * first[:-1, None] + np.arange(4)).ravel()
    path = entries[:, None]
    for jump in pointers:
        if not least[path[:, -1]].any():
            break
        path = np.concatenate([path, jump[path]], axis=1) if path.shape[1] < longest else path
    letters = np.frombuffer(b"\0DIKR", np.uint8)[least[path]]
    spelled: dict[int, str] = {}
    out: list[list[tuple[str, int]]] = []
    for i, entry in enumerate(entries):
        key = int(rank[entry])
        if key not in spelled:
            spelled[key] = letters[i].tobytes().split(b"\0", 1)[0].decode()
        audit = spelled[key]
        leaves = path[i, len(audit)] % 4
        if i % 4 == 0:
            out.append([])
        out[-1].append((audit, int(leaves)))
    return out


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows as role:text."""
    lines, rows = [], iter(zip(roles, texts))
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            lines.append(f"{SPEAKER[state]}:")
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        if letter == "R":
            state = NEXT[state]
            role = SPEAKER[state]
        else:
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        lines.append(f"{role}:{text}")
    return lines


def price(audit: str, kinds: bytes) -> int:
    rows = audit.replace("I", "")
    kept = sum(UNFINISHED for letter, k in zip(rows, kinds) if letter != "D" and k and k % 2 == 0)
    return INSERT * audit.count("I") + REROLE * audit.count("R") + DELETE * audit.count("D") + kept


def _turns(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """Smallest and largest turn and the number of different ones, nulls ignored; turns are sorted."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


# ---------------------------------------------------------------- Spark

RESULT = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string,repaired_sha256:string>"


def _result(stats: list[int], turns: tuple[int | None, int | None, int], cost: int, audit: str, digest: str) -> dict:
    low, high, n = turns
    gaps = 0 if low is None else high - low + 1 - n
    return dict(zip(SPOKEN, [gaps, *stats, cost])) | {"audit": audit, "repaired_sha256": digest}


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, present): its faults, the cheapest
    repair's cost, the least audit among the cheapest and the SHA-256 of the repaired text.

    Rows are taken by turn, nulls first, equal turns by role and text; rows with present = false only
    name their conversation. A conversation without rows has zeros, an empty audit and the hash of
    nothing. Rows with a null conv_id form one conversation. Roles and texts must not be null.

    Rows are range-partitioned by (conv_id, turn, role, text), so a long conversation spreads over
    tasks. A conversation that lies inside a task and fits one segment is solved there. What is left, the
    segments of long conversations and of those at the edges of tasks, is composed: repeated rows
    of earlier segments by one aggregation, costs ahead by (min, +) matrices from the last segment to
    the first, audits segment by segment, and at last the text is hashed in order as a stream. Only
    that stream and the audit itself, one letter a row, are sequential in a conversation.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role", "text")]
    sorted_rows = (
        required(rows, ["conv_id", "turn", "role", "text", "present"])
        .withColumn("key", key)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    conv_type = rows.schema["conv_id"].dataType
    schema = T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("conv_id", conv_type),
            T.StructField("part", T.LongType()),
            T.StructField("seg", T.LongType()),
            T.StructField("result", T._parse_datatype_string(RESULT)),
            T.StructField("turns", T.ArrayType(T.LongType())),
            T.StructField("roles", T.ArrayType(T.StringType())),
            T.StructField("texts", T.ArrayType(T.StringType())),
        ]
    )
    segments = written(sorted_rows.mapInArrow(_segments(schema), schema), "segments")
    done = segments.where("result IS NOT NULL").select("conv_id", "result.*")
    left = segments.where("result IS NULL")
    return done.unionByName(_composed(left, conv_type))


def _segments(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, costs = TaskContext.get().partitionId(), Costs()
        seg, fresh, size, now = 0, True, 0, None
        held: list[tuple] = []
        inside: list[dict] = []

        def cut(whole: bool) -> dict:
            nonlocal held, size, seg
            out = {"key": now[0], "conv_id": now[1], "part": part, "seg": seg, "whole": whole}
            turns, roles, texts = (list(x) for x in zip(*held)) if held else ([], [], [])
            held, size, seg = [], 0, seg + 1
            return out | {"turns": turns, "roles": roles, "texts": texts}

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "conv_id", "turn", "role", "text", "present")]
            for k, conv, turn, role, text, present in zip(*columns):
                if now is None or k != now[0]:
                    if now is not None:
                        # the first conversation of a task may have begun in the one before
                        inside.append(cut(whole=fresh and seg > 0))
                    now, fresh = (k, conv), True
                if present:
                    if len(held) >= SEGMENT_ROWS or size + 4 * len(text) > SEGMENT_BYTES and held:
                        inside.append(cut(whole=False))
                        fresh = False
                    held.append((turn, role, text))
                    size += 4 * len(text)
            yield from _solved(inside, costs, arrow)
            inside = []
        if now is not None:
            yield from _solved([cut(whole=False)], costs, arrow)

    return run


def _solved(found: list[dict], costs: Costs, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Whole conversations with their results, others as they are."""
    whole = [s for s in found if s.pop("whole")]
    kinds = [judged(s["roles"], s["texts"], set()) for s in whole]
    # conversations of about the same length are ranked together, so that no path is padded much
    lengths: dict[int, list[int]] = {}
    for i, (k, _) in enumerate(kinds):
        lengths.setdefault(len(k).bit_length(), []).append(i)
    audits = [""] * len(whole)
    for same in lengths.values():
        for i, found_audits in zip(same, least_audits([(kinds[i][0], END, True) for i in same], costs)):
            audits[i] = found_audits[0][0]
    for s, (k, faults), letters in zip(whole, kinds, audits):
        lines = repaired(letters, 0, s["roles"], s["texts"])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        stats = [*faults, illegal(s["roles"])]
        s["result"] = _result(stats, _turns(s["turns"]), price(letters, k), letters, digest)
        s.update(turns=None, roles=None, texts=None)
    for i in range(0, len(found), 64):
        yield pa.RecordBatch.from_pylist([{"result": None} | s for s in found[i : i + 64]], schema=arrow)


def _composed(left: DataFrame, conv_type: T.DataType) -> DataFrame:
    place = ["key", "part", "seg"]
    prints = left.select(*place, F.explode(F.array_distinct(_fingerprints())).alias("print"))
    first = prints.groupBy("key", "print").agg(F.min(F.struct("part", "seg")).alias("first"))
    late = (
        prints.join(first, ["key", "print"])
        .where(F.col("first") < F.struct("part", "seg"))
        .groupBy("part", "seg")
        .agg(F.collect_set("print").alias("late"))
    )
    more = "kinds binary, matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint"
    fields = [*left.drop("result").schema.fields, *T._parse_datatype_string(more).fields]
    known = written(
        left.drop("result").join(late, ["part", "seg"], "left").mapInArrow(_kinds(T.StructType(fields)), T.StructType(fields)),
        "kinds",
    )
    backward = ["key", F.col("part").desc(), F.col("seg").desc()]
    ahead = (
        known.select(*place, "matrix")
        .repartition("key")
        .sortWithinPartitions(*backward)
        .mapInArrow(_costs_ahead, "part bigint, seg bigint, ahead array<bigint>, last boolean")
    )
    paths = T.StructType([*fields, T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("leaves", T.ArrayType(T.IntegerType()))])
    solved = known.join(ahead, ["part", "seg"]).mapInArrow(_audits(paths), paths)
    result = T.StructType([T.StructField("conv_id", conv_type), *T._parse_datatype_string(RESULT).fields])
    return solved.repartition("key").sortWithinPartitions(*place).mapInArrow(_folded(result), result)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, so that no more than a few segments are Python objects at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _kinds(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        for row in _rows(batches):
            kinds, faults = judged(row["roles"], row["texts"], set(row.pop("late") or ()))
            row |= {"kinds": kinds, "matrix": costs.matrix(kinds)}
            row |= dict(zip(["blank", "duplicate", "truncated"], faults))
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return run


def _costs_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs behind each segment, from the last segment of a conversation to its first."""
    key, ahead = None, END
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            last = row["key"] != key
            if last:
                key, ahead = row["key"], END
            out.append({"part": row["part"], "seg": row["seg"], "ahead": list(ahead), "last": last})
            m = row["matrix"]
            ahead = tuple(min(min(m[4 * q + to] + ahead[to] for to in range(4)), FAR) for q in range(4))
        schema = pa.schema([("part", pa.int64()), ("seg", pa.int64()), ("ahead", pa.list_(pa.int64())), ("last", pa.bool_())])
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _audits(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        for row in _rows(batches):
            found = least_audits([(row["kinds"], tuple(row.pop("ahead")), row.pop("last"))], costs)[0]
            row |= {"audits": [a for a, _ in found], "leaves": [q for _, q in found]}
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return run


def _folded(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def closed() -> pa.RecordBatch:
            row = {"conv_id": now["conv_id"]} | _result(
                now["stats"], (now["low"], now["high"], now["n"]), now["cost"], "".join(now["audit"]), now["digest"].hexdigest()
            )
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for row in _rows(batches):
            if now is None or row["key"] != now["key"]:
                if now is not None:
                    yield closed()
                now = {"key": row["key"], "conv_id": row["conv_id"], "stats": [0] * 4, "low": None, "high": None, "n": 0}
                now |= {"cost": 0, "audit": [], "digest": hashlib.sha256(), "state": 0, "said": False, "role": None}
            audit = row["audits"][now["state"]]
            lines = repaired(audit, now["state"], row["roles"], row["texts"])
            if lines:
                now["digest"].update(("\n" * now["said"] + "\n".join(lines)).encode())
                now["said"] = True
            now["audit"].append(audit)
            now["cost"] += price(audit, row["kinds"])
            now["state"] = row["leaves"][now["state"]]
            roles = row["roles"] if now["role"] is None else [now["role"], *row["roles"]]
            found = [row["blank"], row["duplicate"], row["truncated"], illegal(roles)]
            now["stats"] = [a + b for a, b in zip(now["stats"], found)]
            now["role"] = row["roles"][-1] if row["roles"] else now["role"]
            low, high, n = _turns(row["turns"])
            if low is not None:
                now["n"] += n - (low == now["high"])
                now["low"], now["high"] = low if now["low"] is None else now["low"], high
        if now is not None:
            yield closed()

    return run
