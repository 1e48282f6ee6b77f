"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct text (as a set of word shingles) has a signature of K minima. It is posted under
coordinate-value pairs; two signatures that agree in at least m of K coordinates share one of the
K - m + 1 rarest pairs of each, so only those are posted (prefix) and pairs that nothing shares are
skipped. Agreements are then counted on the whole signatures, and what reaches m is confirmed on the
full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, components, mix, prefix_hashes, range_hashes, slices, text_chunks, written

COORDINATES = 32
#: Accepted chance that a pair exactly at the threshold agrees in fewer than m coordinates.
MISS = 1e-6
#: Sets that a task compares with their hubs' at once.
DIFFERENCES = 1000


def least_agreements(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Largest m for which a pair at the threshold has fewer than m agreements with chance <= miss."""
    p, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if below > miss:
            return max(m, 1)
    return coordinates


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and text number of each word of a slice of texts; A-Z are lowered."""
    lower = LOWER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    space = SPACE[data]
    before = np.concatenate([[True], space[:-1]]) if len(data) else space
    after = np.concatenate([space[1:], [True]]) if len(data) else space
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return range_hashes(prefix_hashes(lower), starts, ends), np.searchsorted(offsets, starts, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, fingerprint), sorted by both.

    A text with fewer words than ``size`` has its whole sequence as one shingle, one without words none.
    """
    h, of = words(data, offsets)
    counts = np.bincount(of, minlength=len(offsets) - 1)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    value, text = [], []
    for n in range(1, size + 1):
        if n < size:
            at = firsts[counts == n]
        else:
            at = np.arange(max(0, len(h) - size + 1))
            at = at[of[at] == of[at + size - 1]] if len(at) else at
        acc = h[at] + np.uint64(n)
        for k in range(1, n):
            acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[at + k])
        value.append(acc)
        text.append(of[at])
    value, text = np.concatenate(value), np.concatenate(text)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return text[fresh], value[fresh]


def _coefficients(n: int) -> np.ndarray:
    return np.random.default_rng(41).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, size: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, node (fingerprint of the shingle set), n_shingles, signature (4 bytes a coordinate)."""
    factors = _coefficients(coordinates)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node bigint, n_shingles bigint, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, "text"):
            text, value = shingles(data, offsets, size)
            n = np.bincount(text, minlength=batch.num_rows)
            used = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[used]
            node = np.zeros(batch.num_rows, np.uint64)
            sig = np.zeros((batch.num_rows, coordinates), np.uint32)
            if len(used):
                node[used] = mix(np.add.reduceat(mix(value), first) + n[used].astype(np.uint64))
                for k, factor in enumerate(factors):
                    sig[used, k] = np.minimum.reduceat(((value * factor) >> np.uint64(32)).astype(np.uint32), first)
            raw = sig.tobytes()
            width = 4 * coordinates
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(node.view(np.int64)),
                    pa.array(n.astype(np.int64)),
                    pa.array([raw[i * width : (i + 1) * width] for i in range(batch.num_rows)], pa.binary()),
                ],
                names=["doc_id", "node", "n_shingles", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def postings(nodes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """node, prefix, score: the rarest coordinate-value pairs under which each node is posted.

    Pairs that occur once are never posted, but fill a node's prefix first. ``score`` is how often all its
    pairs occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(coordinates, dtype=np.int64) << 32
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, coordinates)
            tokens = (sig.astype(np.int64) + places).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.array(np.repeat(batch.column("node").to_numpy(), coordinates))], names=["token", "node"]
            )

    tokens = nodes.select("node", "signature").mapInArrow(run, "token bigint, node bigint")
    listed = rarest(tokens, ["token"], ["node"], F.lit(coordinates), F.lit(coordinates - least + 1))
    return listed.where(F.size("prefix") > 0).select("node", "prefix", "score")


def rarest(items: DataFrame, token: list[str], keys: list[str], size: Column, room: Column) -> DataFrame:
    """keys, tokens, prefix, score: tokens of each key that occur more than once, rarest first, and those
    of them among the ``room`` rarest of all its ``size`` tokens."""
    common = items.groupBy(*token).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = items.join(common, token).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    left = F.greatest(room - (size - F.size("t")), F.lit(0))
    score = F.aggregate("t", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    return shared.select(
        *keys,
        F.col("t.token").alias("tokens"),
        F.slice("t.token", F.lit(1), left).alias("prefix"),
        score.alias("score"),
    )


def agreeing(pairs: DataFrame, nodes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``least`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, coordinates) for c in ("sa", "sb")
            )
            keep = pa.array((a == b).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    sig = nodes.select("node", "signature")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(a) + len(b)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                merged = np.sort(np.concatenate([a, b]), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * common >= percent * (both - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def centres(members: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, centre: the shingles that more than half of a hub's nodes hold, which need not be the set of any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, DIFFERENCES):
            hub = batch.column("a").to_numpy()
            order = np.argsort(hub, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(hub[order])) + 1):
                held = b"".join(batch.column("shingles").take(pa.array(part)).to_pylist())
                token, n = np.unique(np.frombuffer(held, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(token), hub[part[0]])), pa.array(token), pa.array(n)], names=["hub", "token", "n"]
                )

    held = members.join(sets, F.col("b") == F.col("node")).select("a", "shingles")
    often = held.mapInArrow(run, "hub bigint, token bigint, n bigint").groupBy("hub", "token").agg(F.sum("n").alias("n"))
    many = members.groupBy(F.col("a").alias("hub")).agg(F.count(F.lit(1)).alias("nodes"))
    return often.where("n > 1").join(many, "hub").where("2 * n > nodes").groupBy("hub").agg(F.collect_list("token").alias("centre"))


def differences(members: DataFrame, middle: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, node, group, size, tokens: the shingles in which a node (of ``size``) differs from the centre of its hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, DIFFERENCES):
            size, tokens = [], []
            for x, y in zip(batch.column("centre"), batch.column("shingles"), strict=True):
                held = np.frombuffer(y.as_py(), np.int64)
                size.append(len(held))
                tokens.append(np.setxor1d(x.values.to_numpy(), held, assume_unique=True) if x.is_valid else held)
            columns = [*batch.columns[:3], pa.array(size, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["hub", "node", "group", "size", "tokens"])

    both = members.join(sets, F.col("b") == F.col("node")).join(middle, F.col("a") == F.col("hub"), "left")
    kind = "hub bigint, node bigint, group bigint, size int, tokens array<bigint>"
    return both.select("a", "b", "group", "centre", "shingles").mapInArrow(run, kind)


def around_hubs(near: DataFrame, sets: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one hub's nodes that are linked, though they lie in different components. They hold
    together what all such pairs would.

    Two sets x, y with Jaccard similarity t or more differ in at most (1 - t) / t * |x| shingles, and so do
    their differences from any third set. So the rarest differences, one more than that many, share a
    token, unless the differences share none at all. The third set is what most of the hub's nodes
    hold: an edit of the hub itself would be a difference that all the others share. Near copies with edits
    of their own differ from it in rare shingles, and share few. With d and e differences, s of them
    shared, the sets themselves differ in d + e - 2 s shingles, which decides the pair exactly: they are
    linked if that is at most r * (|x| + |y|), r = (1 - t) / (1 + t).

    The nearest node z is the one with the least e - r * |z|. All meet it first: if x and y share no
    difference and are linked, then d - r * |x| <= r * |y| - e <= r * |z| - (differences of z), so x is
    linked to z, and so is y. Pairs of nodes that are joined to z are not looked at again.
    """
    grouped = near.join(joined, F.col("b") == F.col("id"), "left").select("a", "b", F.coalesce("component", "b").alias("group"))
    grouped = written(grouped, "hub_members")
    torn = grouped.groupBy("a").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("a")
    members = grouped.join(torn, "a")
    middle = written(centres(members, sets), "centres")
    items = written(differences(members, middle, sets).withColumn("diff", F.size("tokens")), "differences")

    def linked(shared: Column) -> Column:
        """Whether sets with so many shared differences have a Jaccard similarity of percent / 100 or more."""
        apart = (F.col("x_diff") + F.col("y_diff") - 2 * shared).cast("bigint")
        return (100 + percent) * apart <= (100 - percent) * (F.col("x_size").cast("bigint") + F.col("y_size"))

    names = ["node", "size", "diff", "group", "tokens"]
    far = F.struct((100 + percent) * F.col("diff").cast("bigint") - (100 - percent) * F.col("size").cast("bigint"), "node")
    nearest = items.groupBy("hub").agg(F.min_by(F.struct(*names), far).alias("z")).select("hub", *[F.col(f"z.{c}").alias(f"y_{c}") for c in names])
    met = items.select("hub", *[F.col(c).alias(f"x_{c}") for c in names]).join(nearest, "hub")
    met = met.select(
        "hub", F.col("y_node").alias("a"), F.col("x_node").alias("b"), F.col("x_group").alias("group"),
        linked(F.size(F.array_intersect("x_tokens", "y_tokens"))).alias("close"), (F.col("x_group") != F.col("y_group")).alias("fresh"),
    )
    met = written(met, "nearest")
    core = met.groupBy("hub", "group").agg((~F.bool_or("close")).alias("apart"))
    direct = met.where("close and fresh").select("a", "b")

    room = (F.floor(F.col("size") * ((100 - percent) / percent) + 1e-9) + 1).cast("int")
    each = items.select("hub", "node", "size", "diff", F.explode("tokens").alias("token"))
    posted = rarest(each, ["hub", "token"], ["hub", "node", "size", "diff"], F.col("diff"), room)
    posted = posted.where(F.size("prefix") > 0).join(items.select("hub", "node", "group"), ["hub", "node"]).join(core, ["hub", "group"])
    posted = written(posted.drop("score"), "hub_postings")
    # candidates meet by single tokens and sizes; whole differences are read once a pair
    light = posted.select(
        "hub", "node", "size", "diff", "group", "apart", F.size("tokens").alias("common"), F.posexplode("prefix").alias("at", "token")
    )
    x = light.where("apart").toDF(*[f"x_{c}" for c in light.columns])
    y = light.toDF(*[f"y_{c}" for c in light.columns])
    # both list their differences in one order, so few can be shared besides those behind the common one
    most = F.least("x_at", "y_at") + F.least(F.col("x_common") - F.col("x_at"), F.col("y_common") - F.col("y_at"))
    met = x.join(
        y,
        (F.col("x_hub") == F.col("y_hub"))
        & (F.col("x_token") == F.col("y_token"))
        & (F.col("x_group") != F.col("y_group"))
        & (~F.col("y_apart") | (F.col("x_node") < F.col("y_node")))
        & linked(most),
    )
    met = written(met.select("x_hub", "x_node", "y_node").distinct(), "hub_candidates")
    whole = posted.select("hub", "node", "size", "diff", "tokens")
    both = met.join(whole.toDF("x_hub", "x_node", "x_size", "x_diff", "x_tokens"), ["x_hub", "x_node"])
    y_key = (F.col("x_hub") == F.col("y_hub")) & (F.col("y_node") == F.col("_node"))
    both = both.join(whole.toDF("y_hub", "_node", "y_size", "y_diff", "y_tokens"), y_key)
    both = both.where(linked(F.size(F.array_intersect("x_tokens", "y_tokens"))))
    return written(both.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).union(direct), "hub_links")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, shingles (sorted fingerprints, 8 bytes each) for the wanted (node, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, "text"):
            text, value = shingles(data, offsets, size)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            nodes, sets = [], []
            for i in range(batch.num_rows):
                own = value[ends[i] : ends[i + 1]]
                if len(own):
                    nodes.append(int(mix(np.array([mix(own).sum() + np.uint64(len(own))]))[0].view(np.int64)))
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    asked = wanted.select(F.col("doc_id").alias("_asked")).distinct()
    found = docs.select("doc_id", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("_asked")), "left_semi")
    sets = found.mapInArrow(run, "node bigint, shingles binary")
    # an id may stand for several texts: keep what was asked for, each node once
    return sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, one of each component of near duplicates: the smallest doc_id.

    Rows that repeat a kept id with the same text leave one. Texts without words all stay.
    """
    found = near_duplicates(docs, text=text, doc_id=doc_id, **options)
    kept = found.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col(f"row.`{doc_id}`").alias("_id"), F.xxhash64(f"row.`{text}`").alias("_text"))
    rows = rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi")
    twins = Window.partitionBy("_id", "_text").orderBy(F.xxhash64("row"))
    return rows.withColumn("_twin", F.row_number().over(twins)).where("_twin = 1").select("row.*")


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    text: str = "text",
    doc_id: str = "doc_id",
    coordinates: int = COORDINATES,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Documents are linked if their sets of ``size``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more; component_id is the smallest doc_id reachable by links, kept marks
    it. Texts without words (null, empty, blank) have no shingles, are linked with nothing and are kept.
    Repeated rows and equal sets are one node, so rows that repeat a kept id and text are all kept; a
    null doc_id becomes a component's id only if the component has no other.

    Equal sets collapse by aggregation first. In each list of a token, members meet the list's hub,
    so a list of g near copies costs g comparisons, not g^2. What is not linked to its hub then meets
    those of the hub's nodes that differ from it in the same way (``around_hubs``), and members of a list
    with different hubs meet at their first common token. Every pair that shares a posted token is thus
    compared, shown not to be linked, or already in one component.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    least = least_agreements(percent, coordinates)
    signed = written(signatures(docs, size, coordinates), "signatures")
    nodes = written(
        signed.where("n_shingles > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.max("signature").alias("signature"), F.max("n_shingles").alias("size")),
        "nodes",
    )
    prefixes = written(postings(nodes, coordinates, least), "prefixes")
    posted = prefixes.select(F.explode("prefix").alias("token"), "node", "score")
    # a list's hub is the member whose pairs are the most common: of near copies, their original
    lists = posted.groupBy("token").agg(
        F.max_by("node", F.struct("score", "node")).alias("a"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("score").alias("top")
    )
    lists = written(lists.where("lo <> hi").select("token", "a", "top"), "lists")
    members = posted.join(lists, "token")
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    sets = written(shingle_sets(docs, wanted, size), "sets")

    first = members.where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.max("top").alias("top"))
    first = written(first, "hub_pairs")
    near = written(agreeing(first.select("a", "b"), nodes, coordinates, least), "agreeing")
    links = written(confirmed(near, sets, percent), "links")
    joined = written(components(links), "components")

    # what is not linked to its hub may be linked to others around it
    own = near.join(first, ["a", "b"]).groupBy("b").agg(F.max_by("a", F.struct("top", "a")).alias("a")).select("a", "b")
    own = written(own, "hubs")
    itself = own.select("a").distinct().join(own.select(F.col("b").alias("a")), "a", "left_anti").select("a", F.col("a").alias("b"))
    around = around_hubs(own.union(itself), sets, joined, percent)

    # and members of a list may have different hubs
    named = members.select("token", "node").join(joined, F.col("node") == F.col("id"), "left")
    named = named.join(own.select(F.col("b").alias("node"), F.col("a").alias("own_hub")), "node", "left").select(
        "token", "node", F.coalesce("component", "node").alias("group"), F.coalesce("own_hub", "node").alias("hub")
    )
    mixed = named.groupBy("token").agg(
        F.min("group").alias("lo"), F.max("group").alias("hi"), F.min("hub").alias("hub_lo"), F.max("hub").alias("hub_hi")
    ).where("lo <> hi and hub_lo <> hub_hi").select("token")
    named = written(named.join(mixed, "token"), "mixed_lists")
    sizes = named.groupBy("token", "hub").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("token").agg(F.max_by("hub", F.struct("n", "hub")).alias("largest"))
    named = named.join(largest, "token").join(prefixes.select("node", "prefix"), "node").join(nodes.select("node", "size"), "node")
    named = written(named, "open_lists")
    x = named.where(F.col("hub") != F.col("largest")).toDF(*[f"x_{c}" for c in named.columns])
    y = named.toDF(*[f"y_{c}" for c in named.columns])
    met = x.join(
        y,
        (F.col("x_token") == F.col("y_token"))
        & (F.col("x_group") != F.col("y_group"))
        & (F.col("x_hub") != F.col("y_hub"))
        & (100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size"))
        & ((F.col("y_hub") == F.col("y_largest")) | (F.col("x_node") < F.col("y_node")))
        & (F.get(F.array_intersect("x_prefix", "y_prefix"), F.lit(0)) == F.col("x_token")),
    )
    pairs = met.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
    across = written(agreeing(pairs, nodes, coordinates, least), "across")
    more = written(confirmed(across, sets, percent), "more_links")
    # stars of the components so far hold together what their links did, in fewer steps
    stars = joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
    whole = written(components(stars.union(around).union(more)), "all_components")

    reach = whole.join(nodes.select("node", "doc_id"), F.col("id") == F.col("node"))
    smallest = reach.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    of_node = (
        nodes.select("node", F.col("doc_id").alias("own"))
        .join(whole, F.col("node") == F.col("id"), "left")
        .join(smallest, "component", "left")
        .select(F.col("node").alias("_node"), F.coalesce("smallest", "own").alias("component_id"))
    )
    out = signed.join(of_node, (F.col("node") == F.col("_node")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        ((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(component)).alias("kept"),
    )
