"""Language identification: multinomial naive Bayes over hashed character n-grams of the text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, text_chunks

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"


@dataclass
class Model:
    """Languages in order, their log priors and the log probabilities (buckets x languages)."""

    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray
    sizes: Sequence[int]


#: Bytes of text that are scored at once: n-grams of four sizes take many times that in a worker.
SCORED_BYTES = 1 << 18


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of case-folded texts, and their offsets."""
    raw = data.tobytes()
    ends = offsets.tolist()
    texts = [raw[a:b].decode("utf-8", "replace").casefold() for a, b in zip(ends, ends[1:])]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def _grams(data: np.ndarray, offsets: np.ndarray, sizes: Sequence[int], buckets: int):
    """Buckets of all n-grams of a slice's characters and, for each text, where its n-grams begin."""
    letters, offsets = _letters(data, offsets)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for n in sizes:
        if len(letters) < n:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        code = letters[: len(letters) - n + 1].copy()
        for k in range(1, n):
            code = code * np.uint64(0xD6E8FEB86659FD93) + letters[k : len(letters) - n + 1 + k]
        inside = np.arange(len(code)) + n <= ends[: len(code)]
        ids = (mix(code + np.uint64(n << 56)) % np.uint64(buckets)).astype(np.int64)
        counts = np.maximum(np.diff(offsets) - n + 1, 0)
        yield ids[inside], np.concatenate([[0], np.cumsum(counts)])


def train(
    labelled: DataFrame, text: str = "text", lang: str = "lang", sizes: Sequence[int] = SIZES, buckets: int = BUCKETS
) -> Model:
    """Fit on every row with a language: n-gram counts per language, with one added to each.

    Tasks emit their counts, Spark adds them up; the driver receives at most one number for each
    language and bucket, whatever the number of documents. Null texts add to the prior only.
    """
    rows = labelled.where(F.col(lang).isNotNull())
    schema = "lang string, bucket int, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch, data, offsets in text_chunks(batches, "text"):
            codes = batch.column("lang").dictionary_encode()
            code, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            for ids, starts in _grams(data, offsets, sizes, buckets):
                of = np.repeat(code, np.diff(starts))
                found = np.bincount(of.astype(np.int64) * buckets + ids, minlength=len(names) * buckets)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + found[k * buckets : (k + 1) * buckets]
            for k, name in enumerate(names):
                texts[name] = texts.get(name, 0) + int((code == k).sum())
        for name, n in texts.items():
            values = sums.get(name, np.zeros(buckets, np.int64))
            used = np.flatnonzero(values)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [name] * (len(used) + 1),
                    "bucket": pa.array(np.append(used, -1), pa.int32()),
                    "n": pa.array(np.append(values[used], n), pa.int64()),
                }
            )

    named = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    sums = named.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(sums["lang"].to_pylist()))
    if not languages:
        return Model([], np.zeros(0), np.zeros((buckets, 0)), tuple(sizes))
    where = {name: k for k, name in enumerate(languages)}
    column = np.array([where[x] for x in sums["lang"].to_pylist()])
    bucket, n = sums["bucket"].to_numpy(), sums["n"].to_numpy()
    counts, docs = np.ones((buckets, len(languages))), np.zeros(len(languages))
    docs[column[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], column[bucket >= 0]] += n[bucket >= 0]
    return Model(languages, np.log(docs / docs.sum()), np.log(counts / counts.sum(axis=0)), tuple(sizes))


def score_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its posterior probability for each text of a slice."""
    total = np.tile(model.prior, (len(offsets) - 1, 1))
    step = max(1, (1 << 21) // max(1, len(model.languages)))
    for ids, starts in _grams(data, offsets, model.sizes, len(model.log_prob)):
        of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for a in range(0, len(ids), step):
            part = of[a : a + step]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            total[part[first]] += np.add.reduceat(model.log_prob[ids[a : a + step]], first, axis=0)
    best = total.argmax(axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    return best, 1 / odds.sum(axis=1)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score (the posterior of the predicted language).

    A text that is null or has no letter is "und" with score 0; so is every text if the model knows
    no language. Ties go to the language that sorts first. The matrix travels as a broadcast of
    buckets x languages numbers. Rows stay where they are; repeated rows stay.
    """
    spark = docs.sparkSession
    # plain values: a broadcast is unpickled where the class may be unknown
    held = spark.sparkContext.broadcast((model.languages, model.prior, model.log_prob, model.sizes))
    names = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)],
        F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`")).alias("text"),
    )
    schema = T.StructType(
        [*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch, data, offsets in text_chunks(batches, "text", SCORED_BYTES):
            known = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
            if model.languages:
                best, score = score_texts(model, data, offsets)
                langs = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, score, 0.0)
            else:
                langs, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"]
            )

    found = rows.mapInArrow(run, schema)
    return found.withColumnsRenamed(dict(zip(names, keep, strict=True)))
