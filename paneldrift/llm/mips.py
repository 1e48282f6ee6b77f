"""Exact top-k search by inner product.

Vectors are processed by descending length in blocks. Each block of queries first meets the longest
vectors, which gives every query a lower bound for its k-th score. Then a task holds a group of queries
and walks a shard of blocks, longest first, while the scores it finds raise the bounds. A block is skipped
if no product of lengths reaches a bound; inside a block, partial sums over the leading coordinates of an
SVD rotation, plus the Cauchy-Schwarz bound of what is left, drop vectors before scores are computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import block_rows, matrix, pack, usable
from .common import written

#: Share of the vectors' energy that the leading coordinates hold.
HEAD_ENERGY = 0.6
#: Shards of vector blocks, if there are as many blocks; more if a shard would have over SHARD_BLOCKS full ones.
SHARDS = 64
SHARD_BLOCKS = 128
#: Full blocks of queries that a task holds, on average.
QUERY_BLOCKS = 48
#: Queries that meet a block at once, and new scores that are sorted at once, about.
QUERIES_AT_ONCE = 256
SCORES_AT_ONCE = 1 << 18
#: Where partial sums leave more than this share of a block, all its scores are computed.
FEW = 1 / 64

WHOLE = {np.dtype(kind).itemsize: kind for kind in (np.int8, np.int16, np.int32, np.float64)}
LONG = np.iinfo(np.int64)


def rotation(vectors: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Right singular vectors of all vectors, strongest first, and how many hold HEAD_ENERGY.

    Tasks add up their second moments; the driver gets width x width sums.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("vector"), width)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, j, total)], names=["i", "j", "x"])

    sums = vectors.select("vector").mapInArrow(moments, "i bigint, j bigint, x double")
    rows = sums.groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    moment = np.zeros((width, width))
    moment[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["x"].to_numpy()
    values, basis = np.linalg.eigh(np.nan_to_num((moment + moment.T) / 2))
    values, basis = np.maximum(values[::-1], 0), basis[:, ::-1]
    head = int(np.searchsorted(np.cumsum(values), HEAD_ENERGY * values.sum())) + 1
    return np.ascontiguousarray(basis), min(head, width)


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold all of them."""
    low, high = (x.min(), x.max()) if x.size else (0, 0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max and np.array_equal(small := x.astype(kind), x):
            return small
    return x


def widened(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, whose bytes ``narrow`` made."""
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, WHOLE[len(data) // (len(ids) * width)]).reshape(-1, width)


class Search:
    """Queries and the k best ids that each has met: of an id's scores the highest, ties to the smaller id.

    Scores below a query's bound need not be found. Single precision is used where it is exact: sums of
    whole numbers stay below the product of two lengths.
    """

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, basis: np.ndarray, head: int, k: int) -> None:
        self.q, self.q_ids, self.bounds, self.basis, self.head, self.k = q, q_ids, bounds.copy(), basis, head, k
        self.norms = np.concatenate([np.linalg.norm(part.astype(np.float64), axis=1) for part in self.parts(q)])
        self.n = np.zeros(len(q), np.int64)
        self.scores, self.ids = np.full((len(q), k), LONG.min), np.full((len(q), k), LONG.max)
        self.turned: dict[type, np.ndarray] = {}

    @staticmethod
    def parts(x: np.ndarray) -> list[np.ndarray]:
        return [x[first : first + 4096] for first in range(0, len(x), 4096)]

    def heads(self, x: np.ndarray, kind: type) -> np.ndarray:
        """The leading coordinates after the rotation and the length of what is left."""
        out = np.empty((len(x), self.head + 1), kind)
        for part, to in zip(self.parts(x), self.parts(out), strict=True):
            turned = part @ self.basis
            to[:, :-1], to[:, -1] = turned[:, : self.head], np.linalg.norm(turned[:, self.head :], axis=1)
        return out

    def meet(self, x: np.ndarray, x_ids: np.ndarray) -> None:
        """Take the vectors of a block that may be in the top k of a query."""
        order = np.argsort(x_ids)
        x, x_ids = x[order], x_ids[order]
        longest = float(np.linalg.norm(x.astype(np.float64), axis=1).max())
        live = np.flatnonzero(self.norms * longest * (1 + 1e-9) >= self.bounds)
        if not len(live):
            return
        product = max(1.0, float(self.norms[live].max())) * max(1.0, longest)
        # of at most head + 1 products and two roundings, each 2^-24 of the lengths, and twice of that
        kind, error = (np.float32, (self.head + 9) * 2.0**-23) if product < 2.0**24 else (np.float64, 1e-9)
        # products of whole numbers are exact as long as their sums stay below 2^24 or 2^53
        scored = kind if product < 2.0**52 else np.int64
        if kind not in self.turned:
            self.turned[kind] = self.heads(self.q, kind)
        x_heads, xs = self.heads(x, kind).T, x.astype(scored)
        # among so many of the highest scores, ties in order of ids, are k ids that are not the query's
        enough = self.k + 1 + len(x_ids) - len(np.unique(x_ids))
        most, new, waiting = False, [], 0
        for first in range(0, len(live), QUERIES_AT_ONCE):
            part = live[first : first + QUERIES_AT_ONCE]
            bound, qs = self.bounds[part], self.q[part].astype(scored)
            if not most:
                upper = self.turned[kind][part] @ x_heads
                good = upper >= (bound - error * (1 + self.norms[part] * longest)).astype(kind)[:, None]
                most = np.count_nonzero(good) > FEW * good.size
            if most:
                scores = qs @ xs.T
                good = scores >= (bound.astype(kind) if scored is kind else bound)[:, None]
                if scores.shape[1] > enough and np.count_nonzero(good) > 8 * enough * len(part):
                    at = scores.shape[1] - enough
                    least = np.partition(scores, at, axis=1)[:, at, None]
                    good &= (scores > least) | ((tied := scores == least) & (np.cumsum(tied, axis=1, dtype=np.int32) <= enough))
                i, j = np.divmod(np.flatnonzero(good), len(x_ids))
                found = scores[i, j].astype(np.int64)
            else:
                i, j = np.divmod(np.flatnonzero(good), len(x_ids))
                found = np.einsum("ij,ij->i", qs[i], xs[j]).astype(np.int64)
            better = (found >= bound[i]) & (x_ids[j] != self.q_ids[part[i]])
            if scored is kind:  # bounds are exact
                last = np.where(self.scores[part, -1] == bound, self.ids[part, -1], LONG.max)
                better &= (found > bound[i]) | (x_ids[j] < last[i])
            new.append((part[i[better]], found[better], x_ids[j[better]]))
            waiting += len(new[-1][0])
            if waiting > SCORES_AT_ONCE:
                self.take(*map(np.concatenate, zip(*new, strict=True)))
                new, waiting = [], 0
        if waiting:
            self.take(*map(np.concatenate, zip(*new, strict=True)))

    def take(self, place: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge new scores of the queries at ``place`` and raise their bounds."""
        touched = np.unique(place)
        held = np.arange(self.k) < self.n[touched, None]
        place = np.concatenate([np.repeat(touched, self.n[touched]), place])
        scores = np.concatenate([self.scores[touched][held], scores])
        ids = np.concatenate([self.ids[touched][held], ids])
        order = np.lexsort((~scores, ids, place))
        place, scores, ids = place[order], scores[order], ids[order]
        keep = np.append(True, (place[1:] != place[:-1]) | (ids[1:] != ids[:-1]))
        place, scores, ids = place[keep], scores[keep], ids[keep]
        order = np.lexsort((ids, ~scores, place))
        place, scores, ids = place[order], scores[order], ids[order]
        n = np.bincount(np.searchsorted(touched, place), minlength=len(touched))
        rank = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        keep = rank < self.k
        self.scores[place[keep], rank[keep]], self.ids[place[keep], rank[keep]] = scores[keep], ids[keep]
        self.n[touched] = np.minimum(n, self.k)
        full = touched[n >= self.k]
        self.bounds[full] = np.maximum(self.bounds[full], self.scores[full, -1])

    def best(self) -> pa.RecordBatch:
        held = np.arange(self.k) < self.n[:, None]
        columns = np.repeat(self.q_ids, self.n), self.ids[held], self.scores[held]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score"])


def top_k(vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, id, score: the k vectors with the highest inner product for each query.

    ``vectors`` has id, vector (array of whole numbers) and is_query; every other row is a candidate,
    of any query; ties go to the smaller id. Vectors that are null or hold nulls take no part; shorter
    vectors count as filled up with zeros; equal rows count once, and a query never meets rows of its
    own id. Fewer than k candidates give fewer rows. Scores must fit a long.

    Blocks have at most BLOCK_BYTES. Queries reach each shard of vector blocks once, and a block of vectors
    each group of queries it may matter to; a task returns at most k rows a query.
    """
    rows = vectors.where(usable(F.col("vector"))).select(
        "id", F.col("vector").cast("array<double>").alias("vector"), F.coalesce("is_query", F.lit(False)).alias("is_query")
    )
    rows = rows.dropDuplicates(["id", "vector"])
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = written(rows.withColumn("norm", norm), "vectors")
    width = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 1)
    basis, head = rotation(rows, width)

    def packed(part: DataFrame, name: str) -> DataFrame:
        ordered = part.select("id", "norm", "vector").repartitionByRange(F.col("norm").desc(), "id")
        ordered = ordered.sortWithinPartitions(F.col("norm").desc(), "id")

        def make(x: np.ndarray, columns: dict) -> dict:
            return {"longest": float(columns["norm"].max()), "ids": columns["id"].astype(np.int64).tobytes(), "data": narrow(x).tobytes()}

        return written(pack(ordered, width, [], make, "longest double, ids binary, data binary"), name)

    candidates = packed(rows, "candidates")
    queries = packed(rows.where("is_query"), "queries")
    # every task sends its longest block's number, one task the block: at most BLOCK_BYTES
    longest = candidates.select("longest", "block").orderBy(F.desc("longest"), "block").limit(1).collect()
    if not longest:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    block = candidates.where(F.col("block") == longest[0]["block"]).select("ids", "data").collect()[0]
    first = vectors.sparkSession.sparkContext.broadcast((bytes(block["ids"]), bytes(block["data"])))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x_ids, x = widened(*first.value, width)
        for batch in batches:
            bounds, reach = [], []
            for ids, data in zip(batch.column("ids"), batch.column("data"), strict=True):
                q_ids, q = widened(ids.as_py(), data.as_py(), width)
                search = Search(q, q_ids, np.full(len(q), -np.inf), basis, head, k)
                search.meet(x, x_ids)
                bounds.append(search.bounds.tobytes())
                some = search.norms > 0
                needed = np.divide(search.bounds, search.norms, where=some, out=np.full(len(q), -np.inf))
                reach.append(float(needed.min()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bounds, pa.binary()), pa.array(reach, pa.float64())],
                names=[*batch.schema.names, "bounds", "reach"],
            )

    # reach: a shorter vector is in no top k of the block's queries
    seeded = written(
        queries.mapInArrow(seed, "block bigint, longest double, ids binary, data binary, bounds binary, reach double"), "seeded"
    )

    def size(blocks: DataFrame) -> tuple[int, float]:
        """Number of blocks, and of full blocks that would hold their rows."""
        n, ids = blocks.agg(F.count(F.lit(1)), F.sum(F.length("ids"))).first()
        return n, (ids or 0) / 8 / block_rows(width)

    n, full = size(candidates)
    shards = max(min(SHARDS, n), math.ceil(full / SHARD_BLOCKS))
    groups = max(1, math.ceil(size(seeded)[1] / QUERY_BLOCKS))

    def dealt(number: int):
        return F.pmod(F.xxhash64("block"), F.lit(number)).cast("int")

    seeded = seeded.withColumn("group", dealt(groups))
    reach = seeded.groupBy("group").agg(F.min("reach").alias("reach"))
    q = seeded.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "is_query": F.lit(True)})
    x = candidates.join(F.broadcast(reach), F.col("longest") * (1 + 1e-9) >= F.col("reach"))
    x = x.withColumns({"shard": dealt(shards), "is_query": F.lit(False), "bounds": F.lit(None).cast("binary")})
    columns = ["group", "shard", "is_query", "longest", "block", "ids", "data", "bounds"]
    # each cell of the grid is a task of its own
    met = q.select(columns).union(x.select(columns)).repartitionById(groups * shards, F.col("group") * shards + F.col("shard"))
    met = met.sortWithinPartitions("group", "shard", F.desc("is_query"), F.desc("longest"), "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, search = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                group, shard, is_query, ids, data, bounds = (
                    batch.column(c)[row].as_py() for c in ("group", "shard", "is_query", "ids", "data", "bounds")
                )
                if at != (group, shard):
                    if search:
                        yield search.best()
                    at, held, search = (group, shard), [], None
                ids, vectors = widened(ids, data, width)
                if is_query:
                    held.append((vectors, ids, np.frombuffer(bounds, np.float64)))
                    continue
                if search is None:
                    search, held = Search(*map(np.concatenate, zip(*held, strict=True)), basis, head, k), []
                search.meet(vectors, ids)
        if search:
            yield search.best()

    found = met.drop("longest", "block").mapInArrow(compare, "query_id bigint, id bigint, score bigint")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
