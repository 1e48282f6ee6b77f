"""Byte-level BPE with a local rank file: token ids and their raw bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import required

PIECE_CHARS = 1 << 16
#: A place after a non-space and before white space: no match of the usual patterns spans it.
SAFE = regex.compile(r"(?<=\S)(?=\s)")


_encodings: dict[tuple[str, str], tuple[tiktoken.Encoding, list[bytes]]] = {}


def encoding(ranks_path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoding of a rank file (base64 token and rank a line) and each id's bytes."""
    if (ranks_path, pattern) not in _encodings:
        _encodings[ranks_path, pattern] = _loaded(ranks_path, pattern)
    return _encodings[ranks_path, pattern]


def _loaded(ranks_path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


def pieces(text: str, pattern: str, size: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """Parts of a long text whose ids, joined, are the ids of the whole, and whether a part is one match.

    The text is cut before white space that follows a non-space. A stretch of more than ``size``
    characters without such a place is cut into single matches of the pattern.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        end = cut.start() if cut else len(text)
        if end - start <= 2 * size:
            yield text[start:end], False
        else:
            for match in regex.finditer(pattern, text[start:end]):
                yield match.group(), True
        start = end
    yield text[start:], False


def encode(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """Token ids of a text of any length; strings of special tokens are ordinary text.

    A single match is merged as bytes: the encoder's own pattern engine cannot take a million blanks.
    """
    enc, _ = encoding(ranks_path, pattern)
    if len(text) <= PIECE_CHARS:
        return np.asarray(enc.encode_ordinary(text), np.int32)
    ids = [
        enc._encode_single_piece(part.encode()) if single else enc.encode_ordinary(part)
        for part, single in pieces(text, pattern)
    ]
    return np.concatenate([np.asarray(x, np.int32) for x in ids])


def decode(ids: np.ndarray, ranks_path: str, pattern: str) -> bytes:
    """The bytes of token ids; a sequence that is cut inside a character stays as it is."""
    table = encoding(ranks_path, pattern)[1]
    return b"".join(map(table.__getitem__, ids.tolist()))


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, ids array<int>, decoded binary: each text's tokens and the bytes they decode to.

    One pass without a shuffle; every row is independent. A null or empty text has no tokens and
    decodes to no bytes; repeated rows stay; other columns are not read. Very long texts, runs of
    millions of blanks or letters included, are encoded in parts by the task that reads them.
    ``ranks_path`` is a file that every executor has.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("decoded", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            first, ids, raw, held = 0, [], [], 0
            for i in range(batch.num_rows):
                ids.append(encode(texts[i].as_py() or "", ranks_path, pattern))
                raw.append(decode(ids[-1], ranks_path, pattern))
                held += len(raw[-1])
                if held > 1 << 22 or i + 1 == batch.num_rows:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(first, i + 1 - first), tokens, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"]
                    )
                    first, ids, raw, held = i + 1, [], [], 0

    return required(docs, [doc_id, text]).mapInArrow(run, schema)
