"""Language-model scoring with Elias-Fano n-gram tries.

The model is a trigram model of words with hierarchical Dirichlet smoothing:

    p(w)          = (c(w) + 1) / (N + V + 1)
    p(w | ctx)    = (c(ctx w) + K p(w | shorter ctx)) / (c(ctx) + K)    if c(ctx) >= LEAST,
                    p(w | shorter ctx)                                   otherwise,

counted over all training documents, the start of a document being part of the contexts. Contexts seen
only once give no distribution of their own; in all others the probabilities of a context add up to one.

Documents are packed into blocks. Order by order, a block sends its different n-grams with their
training counts to shards chosen by a hash of the whole n-gram, so that neither a hot word nor a hot
context meets in one task. A shard adds up the counts, builds the trie of its n-grams with their counts
and answers each block from it. The block knows the counts of the contexts from the order below and
smooths by itself, so only counts travel: they pack into a fraction of what probabilities take.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, discard, mix, prefix_hashes, range_hashes, required, text_chunks, written
from .elias_fano import Trie

#: Bytes of text of a block, and n-grams (as tokens that have a known context) for each shard.
BLOCK_BYTES = 1 << 22
SHARD_GRAMS = 1 << 19
#: Weight of the shorter context, in tokens, and the least count of a context with successors of its own.
PRIOR = 4.0
LEAST = 2
END = 0
START_ID = (1 << 40) - 1


# ---------------------------------------------------------------- packed numbers


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers: as many bytes as the largest needs, byte planes apart, compressed."""
    raw = np.ascontiguousarray(x, "<u8")
    width = max((int(raw.max()).bit_length() + 7) // 8, 1) if len(raw) else 1
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(raw).to_bytes(7, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n, width = int.from_bytes(b[:7], "little"), b[7]
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros(n, np.int64)
    for k, plane in enumerate(planes.reshape(width, n)):
        out |= plane.astype(np.int64) << 8 * k
    return out


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different non-negative keys in order, the first place of each and the number of each key.

    The leading bits of keys that leave room for their place in 63 bits are sorted with it, as plain numbers: several
    times faster than ``np.unique``, which sorts places by keys and is left for different keys that begin alike.
    """
    bits = max(len(keys) - 1, 1).bit_length()
    cut = max(int(keys.max()).bit_length() + bits - 63, 0) if len(keys) else 0
    both = np.sort(keys >> cut << bits | np.arange(len(keys)))
    place = both & (1 << bits) - 1
    both >>= bits
    items = keys[place] if cut else both
    new = np.ones(len(keys), bool)
    new[1:] = items[1:] != items[:-1]
    if cut and (new[1:] & (both[1:] == both[:-1])).any():
        return np.unique(keys, return_index=True, return_inverse=True)
    inverse = np.empty(len(keys), np.int64)
    inverse[place] = np.cumsum(new) - 1
    return items[new], place[new], inverse


def steps(x: np.ndarray) -> np.ndarray:
    """First value and differences of a non-decreasing array."""
    return np.diff(x, prepend=0)


# ---------------------------------------------------------------- blocks of tokens


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """56-bit fingerprints of the lower-cased words of texts, and the number of words of each text."""
    data = LOWER[data]
    dark = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(dark & (edge[:-1] | ~np.concatenate([[False], dark[:-1]])))
    last = np.flatnonzero(dark & (edge[1:] | ~np.concatenate([dark[1:], [False]]))) + 1
    n = np.bincount(np.searchsorted(offsets, first, "right") - 1, minlength=len(offsets) - 1) if len(first) else np.diff(offsets) * 0
    return (range_hashes(prefix_hashes(data), first, last) >> np.uint64(8)).astype(np.int64), n


def with_ends(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The words with one end behind each text's."""
    out = np.full(len(words) + len(n), END, np.int64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    return out


class Line:
    """A block's tokens as places in its lexicon, with what is known of its n-grams so far."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.tokens = unpack(row["tokens"])
        self.n = np.array(row["n_tokens"], np.int64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.train = np.repeat(~np.array(row["held_out"], bool), self.n)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[np.cumsum(self.n) - self.n] = True
        self.size = int(row["lexicon"])

    def counted(self, inverse: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(inverse, weights=self.train, minlength=n).astype(np.int64)

    def words(self, model: dict) -> None:
        self.ids = np.append(unpack(self.row["word_ids"]), START_ID)
        self.word_counts = unpack(self.row["word_counts"])
        self.p1 = (self.word_counts + 1.0) / (model["tokens"] + model["words"] + 1.0)

    def bigrams(self, model: dict) -> Grams:
        earlier = np.where(self.first, self.size, np.roll(self.tokens, 1))
        keys, _, self.at2 = numbered(earlier * (self.size + 1) + self.tokens)
        self.earlier, word = keys // (self.size + 1), keys % (self.size + 1)
        context = np.append(self.word_counts, model["documents"])[self.earlier]
        self.second = word
        rank = numbered(self.ids)[2]
        ranks = rank[self.earlier] * (self.size + 1) + rank[word]
        return Grams([self.ids[self.earlier], self.ids[word]], self.counted(self.at2, len(keys)), context, self.p1[word], ranks)

    def pair_counts(self, model: dict, counts2: np.ndarray) -> np.ndarray:
        """Count of the pair of words before each token."""
        return np.append(counts2, model["documents"])[np.where(self.first, len(counts2), np.roll(self.at2, 1))]

    def trigrams(self, model: dict, two: Grams, counts2: np.ndarray, p2: np.ndarray) -> Grams:
        none = len(counts2)
        before = np.where(self.first, none, np.roll(self.at2, 1))
        keys, at, self.at3 = numbered(before * (self.size + 1) + self.tokens)
        pair, word = keys // (self.size + 1), keys % (self.size + 1)
        ids = [np.append(c, START_ID)[pair] for c in two.columns]
        context = np.append(counts2, model["documents"])[pair]
        # the pair of starts is the last one
        ranks = np.append(numbered(two.ranks)[2], none)[pair] * (self.size + 1) + numbered(self.ids)[2][word]
        return Grams([*ids, self.ids[word]], self.counted(self.at3, len(keys)), context, p2[self.at2[at]], ranks)


class Grams:
    """Different n-grams of a block: ids, training counts, count of the context, probability of the
    shorter n-gram. ``sent`` are those whose context has successors of its own, by shard and ids; ``ranks``
    are different numbers in the order of the ids."""

    def __init__(
        self, columns: list[np.ndarray], counts: np.ndarray, context: np.ndarray, lower: np.ndarray, ranks: np.ndarray
    ) -> None:
        self.columns, self.counts, self.context, self.lower, self.ranks = columns, counts, context, lower, ranks

    def sent(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        held = np.flatnonzero(self.context >= LEAST)
        held = held[numbered(self.ranks[held])[1]]
        shard = shard_of([c[held] for c in self.columns], shards)
        # 16 bits are sorted by counting
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        return held[order], shard[order]

    def smoothed(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities from the counts of all training documents."""
        return np.where(self.context >= LEAST, (counts + PRIOR * self.lower) / (self.context + PRIOR), self.lower)


def shard_of(columns: list[np.ndarray], shards: int) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h + c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return (h % np.uint64(shards)).astype(np.int64)


# ---------------------------------------------------------------- rows between blocks and shards

MESSAGE = "shard bigint, block string, ids array<binary>, counts binary"
ANSWER = "shard bigint, block string, known bigint, counts binary, word_ids binary"


def messages(block: str, g: Grams, shards: int) -> Iterator[dict]:
    """One row per shard that the block has n-grams for."""
    rows, shard = g.sent(shards)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for part in np.split(rows, cuts) if len(rows) else []:
        columns = [c[part] for c in g.columns]
        yield {
            "shard": int(shard_of([c[:1] for c in columns], shards)[0]),
            "block": block,
            "ids": [pack(steps(columns[0])), *[pack(c) for c in columns[1:]]],
            "counts": pack(g.counts[part]),
        }


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's tuple in their order, and the first row of each different tuple."""
    number = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        items, first, inverse = numbered(c)
        # the first column's numbers are the tuples' so far
        _, first, number = (items, first, inverse) if c is columns[0] else numbered(number * len(items) + inverse)
    return number, first


def answers(shard: int, shards: int, sent: list[dict]) -> Iterator[dict]:
    """What the blocks asked of a shard: counts of all training documents (0: in none), and the ids of
    single words. Those of longer n-grams are read from the trie, which holds the ranks of the counts."""
    order = len(sent[0]["ids"])
    firsts = [np.cumsum(unpack(m["ids"][0])) for m in sent]
    upto = np.concatenate([[0], np.cumsum([len(f) for f in firsts])])
    columns = [np.concatenate(firsts), *[np.concatenate([unpack(m["ids"][k]) for m in sent]) for k in range(1, order)]]
    del firsts
    number, first = distinct(columns)
    counts = np.bincount(number, weights=np.concatenate([unpack(m["counts"]) for m in sent])).astype(np.int64)
    known = counts > 0
    if order > 1:
        grams = [c[first] for c in columns]
        del columns
        values, _, rank = numbered(counts[known])
        trie = Trie.open(Trie.of([c[known] for c in grams], rank + 1).tobytes())
        counts = np.append(0, values)[trie.code(grams)]
    for i, m in enumerate(sent):
        own = number[upto[i] : upto[i + 1]]
        yield {
            "shard": shard,
            "block": m["block"],
            "known": int(known.sum()) if i == 0 else 0,
            "counts": pack(counts[own]),
            "word_ids": pack(own * shards + shard) if order == 1 else None,
        }


def received(g: Grams, shards: int, answer: list[dict] | None, *columns: str) -> list[np.ndarray]:
    """Columns of the answers for all n-grams of a block, 0 for those that were not sent."""
    rows, _ = g.sent(shards)
    out = [np.zeros(len(g.counts), np.int64) for _ in columns]
    for x, c in zip(out, columns):
        if len(rows):
            x[rows] = np.concatenate([unpack(a[c]) for a in answer])
    return out


# ---------------------------------------------------------------- Spark


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out: str = "held_out") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased words (A-Z) and one end. Documents with held_out = true are scored but not
    learnt from; a null counts as false. n_known counts tokens that training documents hold, train_tokens
    is their number, base_score the log10 probability under p(w) alone, score under the trigram
    model. A null or empty text has its end as the only token. Repeated rows count and are scored each;
    without training documents all probabilities are one. Other columns are not read.

    Words are told apart by fingerprints of 56 bits. A document is read and scored in one task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = required(docs, [doc_id, held_out, text]).toDF("doc_id", "held_out", "text")
    rows = rows.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    id_field = T.StructField("ids", T.ArrayType(rows.schema["doc_id"].dataType))
    base = "block string, held_out array<boolean>, n_tokens array<bigint>, tokens binary, lexicon bigint"

    def fields(more: str) -> T.StructType:
        return T.StructType([id_field, *T._parse_datatype_string(f"{base}, {more}").fields])

    first = fields("words binary, counts binary, n_train bigint, d_train bigint")
    blocks = written(rows.mapInArrow(_blocks(to_arrow_schema(first)), first), "blocks")
    total = blocks.agg(F.sum("n_train"), F.sum("d_train"), F.sum("lexicon")).first()
    model = {"tokens": total[0] or 0, "documents": total[1] or 0}

    def shards(n: int | None) -> int:
        return -(-(n or 0) // SHARD_GRAMS) or 1

    s1 = shards(total[2])
    asked = _asked(blocks.select("block", "words", "counts"), lambda row: (_single(row), s1))
    found = written(_answered(asked, s1), "words")
    model["words"] = found.agg(F.sum("known")).first()[0] or 0

    second = fields("word_ids binary, word_counts binary, n_grams bigint")

    def with_words(row: dict) -> dict:
        counts, ids = received(_single(row), s1, row["answer"], "counts", "word_ids")
        return row | {"word_ids": pack(ids), "word_counts": pack(counts), "n_grams": sum(row["n_tokens"])}

    state = written(_mapped(_with_answers(blocks, found), with_words, second), "bigrams")
    discard(blocks, found)
    s2 = shards(state.agg(F.sum("n_grams")).first()[0])

    def two(row: dict) -> tuple[Line, Grams]:
        line = Line(row)
        line.words(model)
        return line, line.bigrams(model)

    # written, so that the messages' shuffle is gone before blocks and answers meet
    found = written(_answered(_asked(state, lambda row: (two(row)[1], s2)), s2), "answers")
    third = fields("word_ids binary, word_counts binary, bigram_counts binary, n_grams bigint")

    def three(row: dict) -> tuple[Line, Grams]:
        line, g = two(row)
        counts = unpack(row["bigram_counts"])
        return line, line.trigrams(model, g, counts, g.smoothed(counts))

    def with_bigrams(row: dict) -> dict:
        line, g = two(row)
        (counts,) = received(g, s2, row["answer"], "counts")
        return row | {"bigram_counts": pack(counts), "n_grams": int((line.pair_counts(model, counts) >= LEAST).sum())}

    bigrams, state = state, written(_mapped(_with_answers(state, found), with_bigrams, third), "trigrams")
    discard(bigrams, found)
    s3 = shards(state.agg(F.sum("n_grams")).first()[0])
    found = written(_answered(_asked(state, lambda row: (three(row)[1], s3)), s3), "answers")
    result = T.StructType(
        [
            T.StructField("doc_id", id_field.dataType.elementType),
            *T._parse_datatype_string(
                "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
            ).fields,
        ]
    )

    def scored(row: dict) -> dict:
        line, g = three(row)
        p3 = g.smoothed(received(g, s3, row["answer"], "counts")[0])
        n = len(line.n)

        def summed(x: np.ndarray) -> np.ndarray:
            return np.bincount(line.doc, weights=x, minlength=n)

        return {
            "doc_id": row["ids"],
            "held_out": row["held_out"],
            "n_tokens": line.n,
            "n_known": summed(line.word_counts[line.tokens] > 0).astype(np.int64),
            "train_tokens": np.full(n, model["tokens"]),
            "base_score": summed(np.log10(line.p1)[line.tokens]),
            "score": summed(np.log10(p3)[line.at3]),
        }

    return _mapped(_with_answers(state, found), scored, result, spread=True)


def _single(row: dict) -> Grams:
    words = unpack(row["words"]).cumsum()
    return Grams([words], unpack(row["counts"]), np.full(len(words), LEAST), np.zeros(len(words), np.int64), np.arange(len(words)))


def _blocks(arrow: pa.Schema):
    def closed(ids: list, held: list, words: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        lexicon, _, tokens = numbered(np.concatenate(words))
        n_tokens = np.concatenate(n)
        row = {"block": uuid.uuid4().hex, "ids": ids, "held_out": held, "n_tokens": n_tokens.tolist()}
        row |= {"tokens": pack(tokens), "lexicon": len(lexicon), "words": pack(steps(lexicon))}
        train = np.repeat(~np.array(held, bool), n_tokens)
        row |= {"counts": pack(np.bincount(tokens, weights=train, minlength=len(lexicon)).astype(np.int64))}
        row |= {"n_train": int(train.sum()), "d_train": len(held) - sum(held)}
        return pa.RecordBatch.from_pylist([row], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, words, n, size = [], [], [], [], 0
        for part, data, offsets in text_chunks(batches, "text"):
            found, each = word_hashes(data, offsets)
            ids += part.column("doc_id").to_pylist()
            held += part.column("held_out").to_pylist()
            words.append(with_ends(found, each))
            n.append(each + 1)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield closed(ids, held, words, n)
                ids, held, words, n, size = [], [], [], [], 0
        if ids:
            yield closed(ids, held, words, n)

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _mapped(df: DataFrame, f, schema: T.StructType, spread: bool = False) -> DataFrame:
    """f on each row; with ``spread`` its lists become rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            made = f(row)
            if spread:
                yield pa.RecordBatch.from_arrays([pa.array(made[c.name], c.type) for c in arrow], schema=arrow)
            else:
                yield pa.RecordBatch.from_pylist([made], schema=arrow)

    return df.mapInArrow(run, schema)


def _asked(blocks: DataFrame, grams) -> DataFrame:
    """The messages of all blocks; ``grams`` gives a block's n-grams and the number of shards."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(MESSAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            g, shards = grams(row)
            out = list(messages(row["block"], g, shards))
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[i : i + 256], schema=arrow)

    return blocks.mapInArrow(run, MESSAGE)


def _answered(asked: DataFrame, shards: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(ANSWER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["shard"] != held[0]["shard"]:
                    yield pa.RecordBatch.from_pylist(list(answers(held[0]["shard"], shards, held)), schema=arrow)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(list(answers(held[0]["shard"], shards, held)), schema=arrow)

    return asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, ANSWER)


def _with_answers(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Each block with its answers in the order of the shards."""
    each = F.sort_array(F.collect_list(F.struct("shard", "counts", "word_ids"))).alias("answer")
    return blocks.join(found.groupBy("block").agg(each), "block", "left")
