"""Near-duplicate vectors by cover trees and dual traversal.

Unit vectors are cut into cells around pivots, cells into blocks of bounded size, and every block
becomes a cover tree: nested nodes whose radii halve from level to level. Two trees are walked together:
a pair of nodes is left out if their centres are further apart than the threshold plus both covering
radii, taken as a whole if even the furthest members are close enough, and opened otherwise.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_rows, matrix, pack, usable
from .common import components, written

#: Rows from which pivots are chosen, and pivots at most: what the driver holds of the data.
PIVOT_SAMPLE = 4096
PIVOTS = 256
#: Nodes of at most so many vectors are compared vector by vector.
LEAF = 48
SLACK = 1e-7


# ---------------------------------------------------------------- trees


class Node:
    """Members (positions in the block), a member as centre, the covering radius, and finer nodes."""

    __slots__ = ("centre", "radius", "members", "children")

    def __init__(self, centre: int, radius: float, members: np.ndarray, children: list[Node]) -> None:
        self.centre, self.radius, self.members, self.children = centre, radius, members, children


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def grow(x: np.ndarray, members: np.ndarray, centre: int, scale: float, least: float) -> Node:
    """A cover tree over ``members``: children lie within scale / 2 of their centres, which are members
    further than that from each other. Members without neighbours at that scale stay in one flat node."""
    own = distances(x[members], x[centre][None])[:, 0]
    node = Node(centre, float(own.max()) + SLACK, members, [])
    if len(members) <= LEAF or scale < least:
        return node
    half, rest, lone, groups = scale / 2, members, [], []
    at = centre
    while len(rest):
        near = distances(x[rest], x[at][None])[:, 0] <= half
        near[rest == at] = True
        group, rest = rest[near], rest[~near]
        if len(group) > 1:
            groups.append((at, group))
        else:
            lone.append(at)
        if len(rest):
            at = int(rest[0])
    if lone:
        lone = np.array(lone)
        node.children.append(Node(int(lone[0]), float(distances(x[lone], x[lone[0]][None]).max()) + SLACK, lone, []))
    if groups or not lone.size:
        node.children += [grow(x, group, at, half, least) for at, group in groups]
    else:
        node.children = []
    return node


class Links:
    """Link counts of both sides' vectors and edges that keep their connections."""

    def __init__(self, a: int, b: int) -> None:
        self.left, self.right = np.zeros(a, np.int64), np.zeros(b, np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.offset = 0, a

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.edges.append((i, j + self.offset))
        self.held += len(i)
        if self.held > 1 << 20:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        """The same connections with at most one edge for each vector."""
        a, b = (np.concatenate([e[k] for e in self.edges] or [np.zeros(0, np.int64)]) for k in (0, 1))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = places[: len(a)], places[len(a) :]
        low = np.arange(len(nodes))
        while True:
            least = np.minimum(low[a], low[b])
            new = low.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            np.minimum.at(new, low[a], least)
            np.minimum.at(new, low[b], least)
            new = new[new]
            if (new == low).all():
                break
            low = new
        moved = np.flatnonzero(low != np.arange(len(nodes)))
        self.edges, self.held = [(nodes[moved], nodes[low[moved]])], len(moved)
        return self.edges[0]


def saved(node: Node) -> tuple:
    """A tree as plain values, to be written with its block."""
    return node.centre, node.radius, node.members, [saved(c) for c in node.children]


def restored(values: tuple) -> Node:
    centre, radius, members, children = values
    return Node(centre, radius, members, [restored(c) for c in children])


def cosine_close(u: np.ndarray, v: np.ndarray, raw_u: np.ndarray, raw_v: np.ndarray, least: float) -> np.ndarray:
    """Matrix of pairs with cosine >= least, decided in double precision.

    Single precision only leaves out pairs that are clearly below the threshold."""
    close = u.astype(np.float32) @ v.astype(np.float32).T >= np.float32(least - 1e-4)
    i, j = np.nonzero(close)
    for first in range(0, len(i), 1 << 16):
        a, b = i[first : first + (1 << 16)], j[first : first + (1 << 16)]
        x, y = raw_u[a], raw_v[b]
        close[a, b] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= least
    return close


def traverse(a: Node, b: Node, ua, ub, ra, rb, na, nb, least: float, same: bool) -> Links:
    """Walk two trees; na, nb are how many rows each vector stands for.

    ``same``: both are one tree. Then every pair is seen twice, and only the left side is counted.
    """
    reach = float(np.sqrt(2.0 - 2.0 * least))
    out = Links(len(ua), len(ub))
    if same:
        out.offset = 0
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        apart = float(distances(ua[p.centre][None], ub[q.centre][None])[0, 0])
        if apart - p.radius - q.radius > reach + SLACK:
            continue
        if apart + p.radius + q.radius <= reach - SLACK:
            out.left[p.members] += nb[q.members].sum()
            if same and p is q:
                out.left[p.members] -= nb[p.members]
            if not same:
                out.right[q.members] += na[p.members].sum()
            out.add(p.members, np.full(len(p.members), q.members[0]))
            out.add(np.full(len(q.members), p.members[0]), q.members)
            continue
        if not p.children and not q.children:
            compare(p.members, q.members, ua, ub, ra, rb, na, nb, least, same, out)
            continue
        lefts = p.children or [p]
        rights = q.children or [q]
        near = distances(ua[[n.centre for n in lefts]], ub[[n.centre for n in rights]])
        bound = np.array([n.radius for n in lefts])[:, None] + np.array([n.radius for n in rights])[None, :]
        meet = near - bound <= reach + SLACK
        # pairs of nodes without children are compared at once, not one by one
        flat = np.ix_([not n.children for n in lefts], [not n.children for n in rights])
        if meet[flat].any():
            rows, columns = meet[flat].any(axis=1), meet[flat].any(axis=0)
            left = [n.members for n, use in zip([n for n in lefts if not n.children], rows, strict=True) if use]
            right = [n.members for n, use in zip([n for n in rights if not n.children], columns, strict=True) if use]
            compare(np.concatenate(left), np.concatenate(right), ua, ub, ra, rb, na, nb, least, same, out)
        meet[flat] = False
        stack += [(lefts[i], rights[j]) for i, j in zip(*np.nonzero(meet), strict=True)]
    return out


def compare(p, q, ua, ub, ra, rb, na, nb, least: float, same: bool, out: Links) -> None:
    """Vector by vector, in strips."""
    strip = max(1, (1 << 21) // max(1, len(q)))
    for first in range(0, len(p), strip):
        rows = p[first : first + strip]
        close = cosine_close(ua[rows], ub[q], ra[rows], rb[q], least)
        if same:
            close &= rows[:, None] != q[None, :]
        if close.any():
            out.left[rows] += close @ nb[q]
            if not same:
                out.right[q] += na[rows] @ close
            i, j = np.nonzero(close)
            out.add(rows[i], q[j])


# ---------------------------------------------------------------- on Spark


def pivots(units: DataFrame, width: int, n: int) -> np.ndarray:
    """Pivots: points of a bounded sample, each as far as possible from those before it."""
    sample = units.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("vector").toArrow()
    x = matrix(sample["vector"].combine_chunks(), width)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen, far = [0], distances(x, x[:1])[:, 0]
    for _ in range(min(PIVOTS, n, len(x)) - 1):
        at = int(far.argmax())
        if far[at] <= SLACK:
            break
        chosen.append(at)
        far = np.minimum(far, distances(x, x[at][None])[:, 0])
    return x[chosen]


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """id, n_links, component_id, kept: one row for each row of (id, vector array<double>).

    Two rows are linked if their cosine, in double precision, is ``least`` or more; n_links counts the
    other rows linked directly. Vectors that are null, zero, or hold null or non-finite components
    link with nothing, and neither do vectors of different lengths. Equal vectors are one node
    that stands for all its rows; repeated rows count as rows of their own.

    Blocks have a bounded size, whatever the size of a cell; the pairs of blocks that can hold a link
    come from bounds on pivots' cells and on blocks. A pair of blocks yields at most one count and
    one edge for each of its vectors, however many links it has.
    """
    vectors = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    fine = usable(F.col("vector")) & (F.coalesce(squares, F.lit(0.0)) > 0) & (squares < float("inf"))
    rows = vectors.withColumn("fine", F.coalesce(fine, F.lit(False)))
    key = F.struct(F.xxhash64("vector").alias("a"), F.hash("vector").alias("b"), F.size("vector").alias("size"))
    rows = written(rows.withColumn("key", F.when(F.col("fine"), key)), "vectors")
    nodes = written(
        rows.where("fine").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")),
        "nodes",
    )
    width, total = nodes.agg(F.coalesce(F.max(F.size("vector")), F.lit(1)), F.count(F.lit(1))).first()
    if total:
        counts, edges = _links(nodes, width, total, least)
    else:
        none = nodes.sparkSession.createDataFrame([], "x bigint, y bigint")
        counts, edges = none, none
    linked = counts.groupBy("x").agg(F.sum("y").alias("links"))
    groups = components(edges, "x", "y")
    by_node = (
        nodes.select("key", F.col("id").alias("own"), "n")
        .join(linked, F.col("own") == F.col("x"), "left")
        .join(groups, F.col("own") == F.col("id"), "left")
        .select(
            F.col("key").alias("_key"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("component", "own").alias("component"),
        )
    )
    out = rows.join(by_node, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("component", F.col("id"))
    return out.select(
        "id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _links(nodes: DataFrame, width: int, total: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Link counts (x: node id, y: rows linked) and edges (x, y) between nodes."""
    reach = float(np.sqrt(2.0 - 2.0 * least))
    centres = pivots(nodes, width, max(1, total // block_rows(width)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = matrix(batch.column("vector"), width)
            d = distances(raw / np.linalg.norm(raw, axis=1, keepdims=True), centres)
            cell = d.argmin(axis=1)
            sizes = batch.column("vector").value_lengths()
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), sizes.cast(pa.int64()), pa.array(d[np.arange(len(d)), cell]), *batch.columns],
                names=["cell", "size", "far", *batch.schema.names],
            )

    celled = nodes.select("id", "n", "vector").mapInArrow(
        assign, "cell bigint, size bigint, far double, id bigint, n bigint, vector array<double>"
    )
    # a cell that holds most rows is cut by distance from its pivot
    order = ["size", "cell", "far", "id"]
    celled = written(celled, "cells").repartitionByRange(*order).sortWithinPartitions(*order)

    def make(x: np.ndarray, columns: dict) -> dict:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        middle = unit[int(distances(unit, unit.mean(axis=0, keepdims=True)).argmin())]
        return {
            "centre": middle.tolist(),
            "radius": float(distances(unit, middle[None]).max()) + SLACK,
            "ids": columns["id"].astype(np.int64).tobytes(),
            "counts": columns["n"].astype(np.int64).tobytes(),
            "data": x.tobytes(),
            "tree": pickle.dumps(saved(grow(unit, np.arange(len(unit)), 0, 2.0, reach / 16))),
        }

    # every block carries its tree: pairs of blocks only walk
    schema = "cell bigint, size bigint, centre array<double>, radius double, ids binary, counts binary, data binary, tree binary"
    blocks = written(pack(celled, width, ["cell", "size"], make, schema), "blocks")

    # cells are at most PIVOTS, so their radii and pairs are a bounded list
    radius = {r["cell"]: r["far"] for r in celled.groupBy("cell").agg(F.max("far").alias("far")).collect()}
    between = distances(centres, centres)
    near_cells = [
        (a, b) for a in radius for b in radius if between[a, b] - radius[a] - radius[b] <= reach + 2 * SLACK
    ]
    cells = nodes.sparkSession.createDataFrame(near_cells, "a_cell bigint, next bigint")
    brief = blocks.select("cell", "size", "block", "centre", "radius")
    left = brief.toDF("a_cell", "a_size", "a", "a_centre", "a_radius")
    right = brief.toDF("b_cell", "b_size", "b", "b_centre", "b_radius")
    square = F.aggregate(
        F.zip_with("a_centre", "b_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )
    pairs = (
        left.join(cells, "a_cell")
        .join(right, (F.col("next") == F.col("b_cell")) & (F.col("a_size") == F.col("b_size")) & (F.col("a") <= F.col("b")))
        .where(F.sqrt(square) - F.col("a_radius") - F.col("b_radius") <= reach + SLACK)
        .select("a", "b")
    )
    load = blocks.select("block", "ids", "counts", "data", "tree")
    loaded = pairs.join(load.toDF("a", "a_ids", "a_counts", "a_data", "a_tree"), "a").join(
        load.toDF("b", "b_ids", "b_counts", "b_data", "b_tree"), "b"
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, tuple] = {}

        def tree(block: int, row: dict, side: str) -> tuple:
            if block not in trees:
                if len(trees) > 3:
                    trees.pop(next(iter(trees)))
                raw = np.frombuffer(row[f"{side}_data"], np.float64).reshape(-1, width)
                unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                root = restored(pickle.loads(row[f"{side}_tree"]))
                ids, counts = (np.frombuffer(row[f"{side}_{c}"], np.int64) for c in ("ids", "counts"))
                trees[block] = root, unit, raw, counts, ids
            return trees[block]

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                a, b = tree(row["a"], row, "a"), tree(row["b"], row, "b")
                same = row["a"] == row["b"]
                found = traverse(a[0], b[0], a[1], b[1], a[2], b[2], a[3], b[3], least, same)
                ids = a[4] if same else np.concatenate([a[4], b[4]])
                i, j = found.reduce()
                links = found.left if same else np.concatenate([found.left, found.right])
                at = np.flatnonzero(links)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([True, False], [len(at), len(i)])),
                            pa.array(np.concatenate([ids[at], ids[i]])),
                            pa.array(np.concatenate([links[at], ids[j]])),
                        ],
                        names=["is_count", "x", "y"],
                    )

    columns = ["a", "b", *[f"{side}_{c}" for side in "ab" for c in ("ids", "counts", "data", "tree")]]
    found = written(loaded.select(*columns).mapInArrow(walk, "is_count boolean, x bigint, y bigint"), "links")
    return found.where("is_count").select("x", "y"), found.where("not is_count").select("x", "y")
