"""Exact substring dedup by winnowing: equal strings are found around shared sync points.

A byte string of ``length`` that occurs twice is found through a sync point: the smallest hash of its
``SEED``-byte substrings, which both occurrences share at the same offset. So only strings at offsets
around sync points are compared. Within the strings of one seed and offset, those with equal 64-bit hashes
are put in order of position; one with an equal string before it is a later copy, one with an equal
string after it has a later copy. Removing the former keeps first copies; removing both leaves none.
No suffix order and no longest-previous-factor array are built: a string of ``length`` bytes has a previous
factor that long exactly if an equal string stands before it, so equality decides the same removals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, prefix_hashes, range_hashes, slices, text_chunks, written

SEED = 32
#: Sync points of one seed that a task ranks together; larger groups are refined first.
GROUP = 1024
STRIP = 1 << 18
#: Texts and contexts that a task holds in Python at once.
TEXTS, CONTEXTS = 200, 2000
NO_ID = -(1 << 63)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each run of ``width`` values."""
    pick = np.minimum if least else np.maximum
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def sync_points(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Positions, least and largest distances, seed hashes and context fingerprints of the sync points of a slice of texts.

    A window of ``length`` bytes of a text belongs to one point, the first of its seeds with the smallest hash. The
    windows of a point begin at neighbouring places, lo to hi bytes before it; its context is all that they cover.
    """
    n, width = len(data), length - SEED + 1
    prefix = prefix_hashes(data)
    if n < length:
        return *[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2
    at = np.arange(n - SEED + 1)
    seeds = range_hashes(prefix, at, at + SEED)
    seeds[seeds == 0] = 1  # 0 stands for no window
    lowest = _sliding(seeds, width, True)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    lowest[np.arange(len(lowest)) + length > ends[: len(lowest)]] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), lowest, np.zeros(width - 1, np.uint64)])
    found = np.flatnonzero(_sliding(padded, width, False) == seeds)
    # neighbouring windows with the same smallest hash are a run; its points follow each other, like the runs
    new = np.diff(lowest, prepend=np.uint64(0)) != 0
    first = np.flatnonzero(new & (lowest != 0))
    last = np.flatnonzero(np.append(new[1:], True) & (lowest != 0))
    text = np.searchsorted(offsets, found, "right")
    begins = np.ones(len(found), bool)
    begins[1:] = (seeds[found[1:]] != seeds[found[:-1]]) | (text[1:] != text[:-1])
    run = np.cumsum(begins) - 1
    first, last = first[run], last[run]
    # of several points of a run, each has the windows behind the point before
    again = np.flatnonzero(~begins)
    first[again] = np.maximum(first[again], found[again - 1] + 1)
    last = np.minimum(last, found)
    used = first <= last
    found, first, last = found[used], first[used], last[used]
    # where the point lies in its context belongs to the fingerprint: a short text is the context of all its points
    context = mix(range_hashes(prefix, first, last + length) + (found - first).astype(np.uint64))
    return found, found - last, found - first, seeds[found], context


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.hash(body).alias("version"),
        body.alias("text"),
    )


def points(keyed: DataFrame, length: int) -> DataFrame:
    """doc, version, pos, lo, hi, seed, context: a row for each sync point.

    lo and hi are the least and the largest distance from the start of one of its windows to the point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, "text", STRIP):
            at, lo, hi, seeds, contexts = sync_points(data, offsets, length)
            of = np.searchsorted(offsets, at, "right") - 1
            pos = at - offsets[of]
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(rows),
                    batch.column("version").take(rows),
                    pa.array(pos.astype(np.int32)),
                    pa.array(lo.astype(np.int16)),
                    pa.array(hi.astype(np.int16)),
                    pa.array(seeds.view(np.int64)),
                    pa.array(contexts.view(np.int64)),
                ],
                names=["doc", "version", "pos", "lo", "hi", "seed", "context"],
            )

    return keyed.select("doc", "version", "text").mapInArrow(
        run, "doc bigint, version int, pos int, lo smallint, hi smallint, seed bigint, context bigint"
    )


def packed_texts(keyed: DataFrame) -> DataFrame:
    """doc_id, doc, version, size, body: texts as compressed bytes, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            raw = [x.as_py().encode() for x in batch.column("text")]
            body = [pa.compress(x, "zstd", asbytes=True) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(x) for x in raw], pa.int64()), pa.array(body, pa.binary())],
                names=["doc_id", "doc", "version", "size", "body"],
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, doc bigint, version int, size bigint, body binary")


def unpacked(size: pa.Scalar, body: pa.Scalar) -> bytes:
    return pa.decompress(body.as_py(), decompressed_size=size.as_py(), codec="zstd", asbytes=True) if size.as_py() else b""


CONTEXT = "key bigint, doc bigint, version int, pos int, lo smallint, hi smallint, wanted boolean, left smallint, around binary"


def contexts(chosen: DataFrame, bodies: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of chosen sync points cover: ``around`` begins ``left`` bytes before the point."""
    names = ["pos", "lo", "hi", "key", "wanted"]
    listed = chosen.groupBy("doc", "version").agg(F.collect_list(F.struct(*names)).alias("points"))
    # rows that repeat an id and a text share their points
    once = bodies.join(listed, ["doc", "version"]).select("doc", "version", "size", "body", "points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = unpacked(batch.column("size")[k], batch.column("body")[k])
                own = batch.column("points")[k].values
                pos = own.field("pos").to_numpy()
                lo, hi = own.field("lo").to_numpy(), own.field("hi").to_numpy()
                around = [raw[p - b : p - a + length] for p, a, b in zip(pos.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        own.field("key"),
                        pa.array([batch.column("doc")[k].as_py()] * len(pos), pa.int64()),
                        pa.array([batch.column("version")[k].as_py()] * len(pos), pa.int32()),
                        *[own.field(c) for c in ("pos", "lo", "hi", "wanted")],
                        pa.array(hi.astype(np.int16)),
                        pa.array(around, pa.binary()),
                    ],
                    names=["key", "doc", "version", "pos", "lo", "hi", "wanted", "left", "around"],
                )

    return once.mapInArrow(run, CONTEXT)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _prefix(around: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = around.to_pylist()
    first = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    return prefix_hashes(np.frombuffer(b"".join(raw), np.uint8)), first


def ranked(batch: pa.RecordBatch, length: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance whose string has another occurrence that counts; -1: none.

    For each distance, strings are grouped by their hashes and, where those are equal, put in order of position.
    """
    key, doc, version, pos, lo, hi, left = _numbers(batch, "key", "doc", "version", "pos", "lo", "hi", "left")
    prefix, first = _prefix(batch.column("around"))
    place = np.empty(len(key), np.int64)
    place[np.lexsort((pos, version, doc))] = np.arange(len(key))
    order = np.lexsort((pos, version, doc, key))
    rows = np.stack([key, doc, version, pos])[:, order]
    lo[order[1:][(rows[:, 1:] == rows[:, :-1]).all(axis=0)]] = length  # of repeated rows, one counts
    low, high = np.full(len(key), -1), np.full(len(key), -1)
    group = mix(key.view(np.uint64))
    for distance in range(int(lo.min()), int(hi.max()) + 1):
        use = np.flatnonzero((lo <= distance) & (distance <= hi))
        start = first[use] + left[use] - distance
        value = range_hashes(prefix, start, start + length) ^ group[use]
        order = np.lexsort((place[use], value)) if keep_first else np.argsort(value)
        same = value[order][1:] == value[order][:-1]
        copied = np.zeros(len(use), bool)
        copied[order[1:][same]] = True  # an equal string before
        if not keep_first:
            copied[order[:-1][same]] = True  # an equal string after
        hit = use[copied]
        low[hit] = np.where(low[hit] < 0, distance, low[hit])
        high[hit] = distance
    return low, high


def decided(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """doc, version, start, end: what is copied around sync points whose groups are complete in a task."""
    kind = "doc bigint, version int, start int, end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(table: pa.Table) -> pa.RecordBatch:
            batch = table.combine_chunks().to_batches()[0]
            low, high = ranked(batch, length, keep_first)
            hit = np.flatnonzero((low >= 0) & batch.column("wanted").to_numpy(zero_copy_only=False))
            pos = batch.column("pos").to_numpy()[hit]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array(hit)),
                    batch.column("version").take(pa.array(hit)),
                    pa.array((pos - high[hit]).astype(np.int32)),
                    pa.array((pos - low[hit] + length).astype(np.int32)),
                ],
                names=["doc", "version", "start", "end"],
            )

        for batch in slices(batches, CONTEXTS):
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if cut:
                yield out(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield out(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, kind)


def refined(rows: DataFrame, length: int) -> DataFrame:
    """Groups too large for a task, cut by what the strings of half of the distances have in common.

    ``key`` stands for those common bytes, ``hull`` for all bytes that these strings cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, CONTEXTS):
            key, lo, hi, left, near, wide = _numbers(batch, "key", "lo", "hi", "left", "from", "to")
            prefix, first = _prefix(batch.column("around"))
            middle = (near + wide) // 2
            for a, b in ((near, middle), (middle + 1, wide)):
                use = np.flatnonzero((lo <= b) & (hi >= a) & (a <= b))
                start = first[use] + left[use]
                core = range_hashes(prefix, start - a[use], start - b[use] + length)
                fresh = mix(core + (a[use] * 1000 + b[use]).astype(np.uint64)).view(np.int64)
                near_, wide_ = np.maximum(lo, a)[use], np.minimum(hi, b)[use]
                hull = range_hashes(prefix, start - wide_, start - near_ + length)
                hull = mix(hull + (near_ * 1000 + wide_).astype(np.uint64)).view(np.int64)
                part = batch.take(pa.array(use))
                columns = {c: part.column(c) for c in part.schema.names}
                columns |= {
                    "key": pa.array(fresh),
                    "lo": pa.array(near_.astype(np.int16)),
                    "hi": pa.array(wide_.astype(np.int16)),
                    "hull": pa.array(hull),
                    "from": pa.array(a[use].astype(np.int16)),
                    "to": pa.array(b[use].astype(np.int16)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, rows.schema)


def copied_ranges(keyed: DataFrame, bodies: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """doc, version, start, end: ranges of bytes whose strings of ``length`` occur elsewhere too
    (``keep_first``: at an earlier position of the corpus, by doc_id and offset)."""
    # counts are written before they are joined: Spark splits a hot key's rows where a join reads tables, not aggregates
    found = written(points(keyed, length), "sync_points")
    repeated = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    repeated = written(repeated, "repeated")
    shared = written(found.join(repeated, "seed"), "shared_points")
    discard(found, repeated)
    place = F.struct("doc", "version", "pos", "lo", "hi")
    # lo and hi tell how long a context is and where the point lies in it
    same = ["seed", "context", "lo", "hi"]
    alike = shared.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    alike = written(alike, "contexts")

    # points with the same context as another: all their strings are copied
    twins = alike.where("n > 1").select(*same, "first")
    whole = shared.join(twins, same)
    if keep_first:
        whole = whole.where(place != F.col("first"))
    whole = whole.select(
        "doc", "version", (F.col("pos") - F.col("hi")).cast("int").alias("start"), (F.col("pos") - F.col("lo") + length).cast("int").alias("end")
    )
    # ranges are written as they are found, so that the disk holds one step's tables and shuffles
    ranges = written(whole, "ranges")
    discard(shared)

    # the rest: one point for each distinct context of a seed that has several
    mixed = (
        alike.groupBy("seed")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
        .where((F.col("kinds") > 1) & (F.lit(keep_first) | (F.col("least") == 1)))
        .select("seed", "kinds")
    )
    mixed = written(mixed, "mixed")
    chosen = alike.join(mixed, "seed").select(
        F.col("seed").alias("key"), "kinds", "first.*", (F.lit(keep_first) | (F.col("n") == 1)).alias("wanted")
    )
    read = chosen = written(chosen, "chosen")
    discard(alike, mixed)
    small = contexts(chosen.where(F.col("kinds") <= GROUP), bodies, length)
    ranges = ranges.union(written(decided(small, length, keep_first), "ranges"))

    large = contexts(chosen.where(F.col("kinds") > GROUP), bodies, length)
    large = large.withColumns(
        {"from": F.lit(0).cast("smallint"), "to": F.lit(length - SEED).cast("smallint"), "hull": F.lit(0).cast("bigint")}
    )
    spot = F.struct("doc", "version", "pos")
    while not chosen.where(F.col("kinds") > GROUP).isEmpty():
        halves = written(refined(large, length), "refined")
        discard(read)
        alike = halves.groupBy("key", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("first"))
        alike = written(alike, "hulls")
        told = halves.join(alike, ["key", "hull"])
        # the same hull as another: all these strings are copied
        copies = told.where(F.col("wanted") & (F.col("n") > 1))
        if keep_first:
            copies = copies.where(spot != F.col("first"))
        copies = copies.select(
            "doc", "version", (F.col("pos") - F.col("hi")).cast("int").alias("start"), (F.col("pos") - F.col("lo") + length).cast("int").alias("end")
        )
        ranges = ranges.union(written(copies, "ranges"))
        # the rest: one for each distinct hull
        rest = told.where(spot == F.col("first")).withColumn("wanted", F.col("wanted") & (F.lit(keep_first) | (F.col("n") == 1)))
        rest = written(rest.drop("n", "first"), "rest")
        discard(halves, alike)
        sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or("wanted").alias("open"))
        sizes = written(sizes.where("kinds > 1 and open").drop("open"), "sizes")
        read = sized = written(rest.join(sizes, "key"), "sized")
        discard(rest, sizes)
        small = sized.where(F.col("kinds") <= GROUP).drop("kinds", "from", "to", "hull")
        ranges = ranges.union(written(decided(small, length, keep_first), "ranges"))
        chosen = sized.where(F.col("kinds") > GROUP)
        large = chosen.drop("kinds")
    discard(read)
    return ranges


def remove_copies(
    docs: DataFrame, length: int = 200, keep_first: bool = True, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end), kept (the bytes left): one row for each row of docs.

    Texts are UTF-8 bytes, null counts as empty, matches never cross documents. Removed is every byte
    covered by a string of ``length`` bytes that occurs at an earlier position too (``keep_first``;
    positions are ordered by doc_id and offset) or anywhere else. Overlaps count, and strings are judged on
    the input. Repeated rows are copies of each other; with ``keep_first`` they share one position,
    so that both stay. A document must fit a task.
    """
    keyed = _keyed(docs, text, doc_id)
    bodies = packed_texts(keyed)
    ranges = copied_ranges(keyed, bodies, length, keep_first)
    listed = ranges.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            spans, kept = [], []
            for k in range(batch.num_rows):
                raw = unpacked(batch.column("size")[k], batch.column("body")[k])
                own = batch.column("ranges")[k]
                merged: list[list[int]] = []
                if own.is_valid:
                    starts, ends = (own.values.field(c).to_numpy() for c in ("start", "end"))
                    for i in np.argsort(starts, kind="stable").tolist():
                        if merged and starts[i] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], int(ends[i]))
                        else:
                            merged.append([int(starts[i]), int(ends[i])])
                spans.append([{"start": a, "end": b} for a, b in merged])
                cuts = [0, *[x for s in merged for x in s], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("size"),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = bodies.join(listed, ["doc", "version"], "left").select("doc_id", "size", "body", "ranges")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
