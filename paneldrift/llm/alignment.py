"""Alignment of two tokenizers: groups of tokens between common ends, and how often ids meet.

A stretch of text yields a fragment: its tokens up to the first offset where tokens of both
tokenizers end (open, as more may stand before), the closed groups, and the tokens behind the last
such offset (open again). Fragments of neighbouring stretches compose, and composition is associative, so
a long document is cut into byte ranges that are encoded in tasks of their own and reduced as a tree.

Texts are cut where a space follows a character that is no white space. There a match of the byte-level
pattern ends and no piece of the other tokenizer reaches across (checked on its vocabulary), so
stretches are encoded on their own, and a block of documents encodes each different word once.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prefix_hashes, range_hashes, required, text_chunks, written

#: Texts with more characters are cut into byte ranges of about this size.
RANGE_CHARS = 1 << 16
#: Documents with about this many bytes of text make a block, whose id pairs are looked up once.
BLOCK_BYTES = 1 << 22
#: Fragments that one step of the tree reduction composes.
FAN = 16
#: Texts that are encoded at once, words that make one, and words of documents whose links are summed at once: bounds on memory.
ENCODED_WORDS = 256
JOINED_WORDS = 64
SUMMED_WORDS = 1 << 16
#: Links of a group that are listed one by one; larger groups multiply their ids' counts.
LISTED = 4096

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
SPACE_MARK = "▁"
_NONE = np.zeros(0, np.int64)


# ---------------------------------------------------------------- tokenizers


class Tokenizers(NamedTuple):
    """Two encoders with the bytes of each id."""

    a: object
    b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    sizes_a: np.ndarray
    sizes_b: np.ndarray


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """A byte-level BPE file (tokenizers) and a piece model (sentencepiece), loaded once a process.

    This module's globals travel with each task, so what is loaded is kept at a library's module.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    loaded = vars(sentencepiece).setdefault("_loaded_pairs", {})
    if (path_a, path_b) not in loaded:
        a = Tokenizer.from_file(path_a)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces):
            raise ValueError("a piece reaches across a space: texts cannot be cut there")
        alphabet = _byte_alphabet()
        bytes_a = [b""] * a.get_vocab_size(with_added_tokens=True)
        for token, i in a.get_vocab(with_added_tokens=True).items():
            bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        byte = re.compile("<0x([0-9A-F]{2})>")
        bytes_b = [
            bytes([int(m.group(1), 16)]) if (m := byte.fullmatch(p)) else p.replace(SPACE_MARK, " ").encode()
            for p in pieces
        ]
        sizes = [np.array([len(x) for x in table], np.int64) for table in (bytes_a, bytes_b)]
        loaded[path_a, path_b] = Tokenizers(a, b, bytes_a, bytes_b, *sizes)
    return loaded[path_a, path_b]


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: visible bytes of Latin-1 stand for themselves, the others
    follow in order from code point 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


def encoded(stretches: list[str], t: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and numbers of ids of stretches that begin with a space, by both tokenizers; the second adds
    that space itself."""
    found: tuple[list, ...] = ([], [], [], [])
    for i in range(0, len(stretches), ENCODED_WORDS):
        part = stretches[i : i + ENCODED_WORDS]
        ids_a = [e.ids for e in t.a.encode_batch_fast(part, add_special_tokens=False)]
        ids_b = t.b.encode([s[1:] for s in part], num_threads=1)
        for k, ids in ((0, ids_a), (2, ids_b)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            found[k].append(np.fromiter((i for one in ids for i in one), np.int64, int(n.sum())))
            found[k + 1].append(n)
    return tuple(np.concatenate([_NONE, *x]) for x in found)


def encoded_words(words: list[bytes], t: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``encoded`` of single words. Words that a text could be cut behind are encoded as one text of
    JOINED_WORDS, and the ends of its tokens tell the words apart; others alone."""
    joins = np.array([len(w) > 1 and 33 <= w[-1] < 127 for w in words], bool)
    order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
    stretches = []
    of = np.flatnonzero(joins).tolist()
    for i in range(0, len(of), JOINED_WORDS):
        stretches.append(b"".join([words[k] for k in of[i : i + JOINED_WORDS]]).decode())
    stretches += [words[k].decode() for k in np.flatnonzero(~joins).tolist()]
    a, n_a, b, n_b = encoded(stretches, t)
    sizes = np.fromiter((len(words[k]) for k in order.tolist()), np.int64, len(words))
    ends = np.cumsum(sizes)
    out: list[np.ndarray] = []
    for ids, n, table in ((a, n_a, t.sizes_a), (b, n_b, t.sizes_b)):
        # where tokens do not add up to the text, each word must be looked at alone
        held = np.diff(np.concatenate([[0], np.cumsum(table[ids])])[np.concatenate([[0], np.cumsum(n)])])
        whole = np.fromiter((len(s.encode()) for s in stretches), np.int64, len(stretches))
        if not np.array_equal(held, whole):
            return encoded([w.decode() for w in words], t)
        counts = np.diff(np.searchsorted(np.cumsum(table[ids]), ends, "right"), prepend=0)
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        first = np.cumsum(counts) - counts
        n_word = counts[back]
        at = np.repeat(first[back] - np.cumsum(n_word) + n_word, n_word) + np.arange(int(n_word.sum()))
        out += [ids[at], n_word]
    return out[0], out[1], out[2], out[3]


def cut_places(data: np.ndarray) -> np.ndarray:
    """Offsets of spaces behind a character that is surely no white space (in UTF-8 bytes).

    Multi-byte characters whose last two bytes are those of a white-space character do not count.
    """
    i = np.flatnonzero(data == 32)
    i = i[i > 0]
    last = data[i - 1]
    before = data[np.maximum(i - 2, 0)].astype(np.int64) << 8 | last
    blank = (before == 0xC285) | (before == 0xC2A0) | (before == 0x9A80) | (before == 0x819F)
    blank |= ((before >= 0x8080) & (before <= 0x808A)) | (before == 0x80A8) | (before == 0x80A9) | (before == 0x80AF)
    return i[(last > 32) & ~blank]


# ---------------------------------------------------------------- groups and fragments


class Groups(NamedTuple):
    """Groups of token ids: group k has ids a[at_a[k]:at_a[k + 1]] and b[at_b[k]:at_b[k + 1]]."""

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray


def links(g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id pair, times) of all pairs of ids that stand in one group: a pair is a * 2^32 + b."""
    na, nb = np.diff(g.at_a), np.diff(g.at_b)
    n = na * nb
    few = np.flatnonzero(n <= LISTED)
    group = np.repeat(few, n[few])
    within = np.arange(len(group)) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
    ia, ib = g.at_a[group] + within // nb[group], g.at_b[group] + within % nb[group]
    found = [(group, g.a[ia] << 32 | g.b[ib], np.ones(len(group), np.int64))]
    for k in np.flatnonzero(n > LISTED):
        a, times_a = np.unique(g.a[g.at_a[k] : g.at_a[k + 1]], return_counts=True)
        b, times_b = np.unique(g.b[g.at_b[k] : g.at_b[k + 1]], return_counts=True)
        pairs = (a[:, None] << 32 | b[None, :]).ravel()
        found.append((np.full(len(pairs), k), pairs, np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their times."""
    if len(keys) == 0:
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def spelled(g: Groups) -> list[str]:
    """Each group as a1,a2|b1. Pairs of single ids, the most common groups, need no joining."""
    a, b = list(map(str, g.a.tolist())), list(map(str, g.b.tolist()))
    plain = (np.diff(g.at_a) == 1) & (np.diff(g.at_b) == 1)
    at_a, at_b = g.at_a.tolist(), g.at_b.tolist()
    out = [f"{a[i]}|{b[j]}" if one else "" for i, j, one in zip(at_a, at_b, plain.tolist())]
    for k in np.flatnonzero(~plain).tolist():
        out[k] = f"{','.join(a[at_a[k] : at_a[k + 1]])}|{','.join(b[at_b[k] : at_b[k + 1]])}"
    return out


def spelled_lines(g: Groups, upto: np.ndarray) -> list[str]:
    """The groups upto[i] to upto[i + 1] as one line, for each i; SUMMED_WORDS lines at a time."""
    out: list[str] = []
    for i in range(0, len(upto) - 1, SUMMED_WORDS // 4):
        own = upto[i : i + SUMMED_WORDS // 4 + 1]
        at_a, at_b = g.at_a[own[0] : own[-1] + 1], g.at_b[own[0] : own[-1] + 1]
        part = Groups(g.a[at_a[0] : at_a[-1]], g.b[at_b[0] : at_b[-1]], at_a - at_a[0], at_b - at_b[0])
        groups, own = spelled(part), (own - own[0]).tolist()
        out += [";".join(groups[j:k]) for j, k in zip(own, own[1:])]
    return out


class Fragment(NamedTuple):
    """Tokens that end in a byte range. Without a common end in it, all tokens are in the head."""

    closing: bool
    head_a: np.ndarray
    head_b: np.ndarray
    text: str
    counts: tuple[int, int, int, int]
    pairs: np.ndarray
    times: np.ndarray
    tail_a: np.ndarray
    tail_b: np.ndarray


def _closed(g: Groups) -> tuple[str, tuple[int, int, int, int], np.ndarray, np.ndarray]:
    _, pairs, times = links(g)
    n = np.diff(g.at_a) * np.diff(g.at_b)
    return ";".join(spelled(g)), (len(g.a), len(g.b), len(n), int(n.sum())), *summed(pairs, times)


def fragment(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in one byte range, in order; ends are offsets."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if len(common) == 0:
        return Fragment(False, a, b, "", (0, 0, 0, 0), _NONE, _NONE, _NONE, _NONE)
    at_a, at_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
    inner = Groups(a[at_a[0] : at_a[-1]], b[at_b[0] : at_b[-1]], at_a - at_a[0], at_b - at_b[0])
    return Fragment(True, a[: at_a[0]], b[: at_b[0]], *_closed(inner), a[at_a[-1] :], b[at_b[-1] :])


def _joined(x: str, y: str) -> str:
    return f"{x};{y}" if x and y else x or y


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring byte ranges. Associative; the empty range is neutral."""
    if not x.closing:
        return y._replace(head_a=np.concatenate([x.head_a, y.head_a]), head_b=np.concatenate([x.head_b, y.head_b]))
    open_a, open_b = np.concatenate([x.tail_a, y.head_a]), np.concatenate([x.tail_b, y.head_b])
    if not y.closing:
        return x._replace(tail_a=open_a, tail_b=open_b)
    seam = _closed(Groups(open_a, open_b, np.array([0, len(open_a)]), np.array([0, len(open_b)])))
    pairs, times = summed(np.concatenate([x.pairs, seam[2], y.pairs]), np.concatenate([x.times, seam[3], y.times]))
    counts = tuple(i + j + k for i, j, k in zip(x.counts, seam[1], y.counts))
    return Fragment(
        True, x.head_a, x.head_b, _joined(_joined(x.text, seam[0]), y.text), counts, pairs, times, y.tail_a, y.tail_b
    )


#: A common end without tokens: in front of a fragment it closes the head, as a document's start does.
START = Fragment(True, _NONE, _NONE, "", (0, 0, 0, 0), _NONE, _NONE, _NONE, _NONE)


def stretch_fragment(text: str, t: Tokenizers) -> Fragment | None:
    """The fragment of space + text; None if the tokens' bytes differ from it."""
    a, _, b, _ = encoded([" " + text], t)
    whole = b" " + text.encode()
    if b"".join(map(t.bytes_a.__getitem__, a)) != whole or b"".join(map(t.bytes_b.__getitem__, b)) != whole:
        return None
    return fragment(a, np.cumsum(t.sizes_a[a]), b, np.cumsum(t.sizes_b[b]))


# ---------------------------------------------------------------- blocks of documents


class Block:
    """Documents with their words; a word is a stretch between two places where texts are cut."""

    def __init__(self, t: Tokenizers) -> None:
        self.t, self.size = t, 0
        self.known: dict[int, int] = {}
        self.words: list[bytes] = []
        self.ids: list = []
        self.used: list[np.ndarray] = []
        self.n_words: list[np.ndarray] = []

    def add(self, ids: list, data: np.ndarray, offsets: np.ndarray) -> None:
        """Texts as UTF-8 bytes and offsets; each gets a space in front, but empty ones."""
        lengths = np.diff(offsets)
        spaced = lengths + (lengths > 0)
        starts = np.cumsum(spaced) - spaced
        doc = np.repeat(np.arange(len(lengths)), lengths)
        line = np.full(int(spaced.sum()), 32, np.uint8)
        line[np.arange(len(data)) + (starts + 1 - offsets[:-1])[doc]] = data
        # a last space stays with the word before it: alone, it would leave nothing to encode
        inner = np.setdiff1d(cut_places(line), starts + spaced - 1)
        first = np.union1d(starts[lengths > 0], inner)
        ends = np.append(first, len(line))[1:]
        hashes = range_hashes(prefix_hashes(line), first, ends)
        different, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        raw = line.tobytes()
        place = np.empty(len(different), np.int64)
        for i, (h, k) in enumerate(zip(different.tolist(), at.tolist())):
            if h not in self.known:
                self.known[h] = len(self.words)
                self.words.append(raw[first[k] : ends[k]])
            place[i] = self.known[h]
        self.ids += ids
        self.used.append(place[back])
        of = np.searchsorted(starts[lengths > 0], first, "right") - 1
        self.n_words.append(np.bincount(np.flatnonzero(lengths > 0)[of], minlength=len(lengths)))
        self.size += len(data)

    def closed(self) -> dict:
        """The block as one row: counts and hash of each document, its id pairs as places in the
        block's list of pairs, and in how many of its documents a pair is linked."""
        t, words = self.t, self.words
        a, n_a, b, n_b = encoded_words(words, t)
        sizes = np.array([len(w) for w in words], np.int64)
        good = self._exact(a, n_a, b, n_b, sizes)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b, sizes = n_a * good, n_b * good, sizes * good
        ends_a, ends_b = np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a = np.concatenate([[0], np.searchsorted(ends_a, common) + 1])
        at_b = np.concatenate([[0], np.searchsorted(ends_b, common) + 1])
        g = Groups(a, b, at_a, at_b)
        word = np.searchsorted(np.cumsum(sizes), common)
        upto = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])
        text = spelled_lines(g, upto)
        n_groups = np.diff(upto)
        n_links = np.zeros(len(words), np.int64)
        np.add.at(n_links, word, np.diff(at_a) * np.diff(at_b))
        group, pair, times = links(g)
        pairs, place = np.unique(pair, return_inverse=True)
        # pairs of each word, with how often they are linked in it
        wide = max(len(pairs), 1)
        in_word, times = summed(word[group] * wide + place, times)
        word_pairs, word_of = in_word % wide, in_word // wide
        of_word = np.concatenate([[0], np.cumsum(np.bincount(word_of, minlength=len(words)))])

        used, n_words = np.concatenate(self.used), np.concatenate(self.n_words)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        broken = np.zeros(len(n_words), bool)
        broken[doc[~good[used]]] = True
        held = ~broken[doc]
        used, doc = used[held], doc[held]
        n_words = np.bincount(doc, minlength=len(n_words))
        totals = {}
        for name, of in zip(COUNTS, (n_a, n_b, n_groups, n_links)):
            upto_words = np.concatenate([[0], np.cumsum(of[used])])
            totals[name] = np.diff(upto_words[np.concatenate([[0], np.cumsum(n_words)])]).tolist()
        hashes, k = [], 0
        plain = used.tolist()
        for n in n_words.tolist():
            line = ";".join([text[w] for w in plain[k : k + n]])
            hashes.append(hashlib.sha256(line.encode()).hexdigest() if n else "")
            k += n
        parts = [(_NONE, _NONE)]
        upto_words = np.concatenate([[0], np.cumsum(n_words)])
        first = 0
        while first < len(n_words):
            last = int(np.searchsorted(upto_words, upto_words[first] + SUMMED_WORDS, "right")) - 1
            last = min(max(last, first + 1), len(n_words))
            here = slice(upto_words[first], upto_words[last])
            in_doc, often = summed(doc[here] * max(len(words), 1) + used[here], np.ones(here.stop - here.start, np.int64))
            w, d = in_doc % max(len(words), 1), in_doc // max(len(words), 1)
            n = of_word[w + 1] - of_word[w]
            at = np.repeat(of_word[w] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            parts.append(summed(np.repeat(d, n) * wide + word_pairs[at], times[at] * np.repeat(often, n)))
            first = last
        keys, links_of = (np.concatenate(x) for x in zip(*parts))
        return block_row(self.ids, totals, hashes, pairs, keys // wide, keys % wide, links_of)

    def _exact(self, a, n_a, b, n_b, sizes) -> np.ndarray:
        """Words whose tokens' bytes are the word, by both tokenizers."""
        good = np.ones(len(sizes), bool)
        for ids, n, table in ((a, n_a, self.t.bytes_a), (b, n_b, self.t.bytes_b)):
            upto = np.concatenate([[0], np.cumsum(n)]).tolist()
            plain = ids.tolist()
            for i, w in enumerate(self.words):
                if b"".join([table[j] for j in plain[upto[i] : upto[i + 1]]]) != w:
                    good[i] = False
        return good


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=8 * n, codec="zstd", asbytes=True), "<i8")


def block_row(ids, totals, hashes, pairs, doc, place, times) -> dict:
    """``doc``, ``place`` (in ``pairs``) and ``times`` of each linked pair of each document, by document."""
    return {
        "block": uuid.uuid4().hex,
        "ids": ids,
        **totals,
        "hashes": hashes,
        "n_pairs": np.bincount(doc, minlength=len(hashes)).tolist(),
        "places": _packed(place),
        "times": _packed(times),
        "pairs": pairs.tolist(),
        "seen": np.bincount(place, minlength=len(pairs)).tolist(),
    }


# ---------------------------------------------------------------- Spark


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both tokenizers encode space + text. Groups are cut where tokens of both end; all pairs of tokens
    in a group are links. The count of an id pair is the number of documents that link it; n_best counts
    the links whose count is the highest of their first id (ties too), count_sum adds up the counts.
    A null or empty text, and one that the tokens do not spell byte by byte, has zeros and an empty
    hash. Repeated rows are documents of their own; other columns are not read.

    Counts come back to blocks of documents: a block asks once for each of its different pairs, however
    many documents hold it. Texts of more than RANGE_CHARS characters are cut, written, encoded in tasks of
    their own and reduced as a tree; a stretch without a place to cut stays whole in one task.
    """
    id_type = docs.schema[doc_id].dataType
    rows = required(docs, [doc_id, text]).toDF("doc_id", "text")
    is_long = F.coalesce(F.length("text") > RANGE_CHARS, F.lit(False))
    blocks_schema = T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("ids", T.ArrayType(id_type)),
            *[T.StructField(c, T.ArrayType(T.LongType())) for c in COUNTS],
            T.StructField("hashes", T.ArrayType(T.StringType())),
            T.StructField("n_pairs", T.ArrayType(T.LongType())),
            T.StructField("places", T.BinaryType()),
            T.StructField("times", T.BinaryType()),
            T.StructField("pairs", T.ArrayType(T.LongType())),
            T.StructField("seen", T.ArrayType(T.LongType())),
        ]
    )
    short = rows.where(~is_long).mapInArrow(_blocks(blocks_schema, path_a, path_b), blocks_schema)
    roots = _reduced(rows.where(is_long), path_a, path_b)
    long = roots.mapInArrow(_root_blocks(blocks_schema), blocks_schema)
    blocks = written(short.unionByName(long), "blocks")

    seen = blocks.select(F.explode(F.arrays_zip("pairs", "seen")).alias("p")).select("p.pairs", "p.seen")
    counts = written(seen.groupBy("pairs").agg(F.sum("seen").alias("n")).withColumn("a", F.shiftright("pairs", 32)), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = counts.join(most, "a").select(F.col("pairs").alias("pair"), "n", (F.col("n") == F.col("most")).alias("best"))
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    answer = F.sort_array(F.collect_list(F.struct("at", "n", "best")))
    answers = asked.join(known, "pair").groupBy("block").agg(answer.alias("answer"))
    packed = answers.select("block", F.col("answer.n").alias("n"), F.col("answer.best").alias("best"))
    found = blocks.drop("pairs", "seen").join(packed, "block", "left")
    result = T.StructType(
        [
            T.StructField("doc_id", id_type),
            *[T.StructField(c, T.LongType()) for c in [*COUNTS, "n_best", "count_sum"]],
            T.StructField("groups_sha256", T.StringType()),
        ]
    )
    return found.mapInArrow(_finished(result), result)


def _blocks(schema: T.StructType, path_a: str, path_b: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        block = Block(t)
        for part, data, offsets in text_chunks(batches, "text"):
            block.add(part.column("doc_id").to_pylist(), data, offsets)
            if block.size >= BLOCK_BYTES:
                yield pa.RecordBatch.from_pylist([block.closed()], schema=arrow)
                block = Block(t)
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.closed()], schema=arrow)

    return run


def _fragment_schema(id_type: T.DataType) -> T.StructType:
    more = (
        "key string, piece bigint, exact boolean, closing boolean, head_a array<bigint>, head_b array<bigint>, text string, "
        "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, pairs array<bigint>, times array<bigint>, "
        "tail_a array<bigint>, tail_b array<bigint>"
    )
    return T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(more).fields])


_ARRAYS = ["head_a", "head_b", "pairs", "times", "tail_a", "tail_b"]


def _as_row(f: Fragment | None) -> dict:
    """A fragment as columns; a text that its tokens do not spell is not exact and has no more to say."""
    fields = (f or START)._asdict()
    counts = dict(zip(COUNTS, fields.pop("counts")))
    return {"exact": f is not None} | counts | {k: v.tolist() if k in _ARRAYS else v for k, v in fields.items()}


def _as_fragment(row: dict) -> Fragment | None:
    if not row["exact"]:
        return None
    fields = {k: np.array(row[k], np.int64) if k in _ARRAYS else row[k] for k in Fragment._fields if k != "counts"}
    return Fragment(**fields, counts=tuple(row[c] for c in COUNTS))


def _reduced(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One fragment per long document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = rows.schema["doc_id"].dataType
    schema = _fragment_schema(id_type)
    arrow = to_arrow_schema(schema)
    cut_schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string("key string, piece bigint, text string").fields])
    cut_arrow = to_arrow_schema(cut_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                key = uuid.uuid4().hex
                for piece, part in enumerate(ranges(row["text"])):
                    one = {"doc_id": row["doc_id"], "key": key, "piece": piece, "text": part}
                    yield pa.RecordBatch.from_pylist([one], schema=cut_arrow)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for batch in batches:
            for row in batch.to_pylist():
                one = {k: row[k] for k in ("doc_id", "key", "piece")} | _as_row(stretch_fragment(row["text"], t))
                yield pa.RecordBatch.from_pylist([one], schema=arrow)

    def composed(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["piece"])
        whole = _as_fragment(parts[0])
        for part in parts[1:]:
            other = _as_fragment(part)
            whole = None if whole is None or other is None else compose(whole, other)
        one = {"doc_id": parts[0]["doc_id"], "key": parts[0]["key"], "piece": parts[0]["piece"] // FAN} | _as_row(whole)
        return pa.Table.from_pylist([one], schema=arrow)

    pieces = written(rows.mapInArrow(cut, cut_schema), "pieces")
    last = pieces.agg(F.max("piece")).first()[0]
    fragments = pieces.repartition("key", "piece").mapInArrow(encode, schema)
    while last:
        # the key of a group is read from its rows, so extra grouping columns are not passed on
        fragments = fragments.groupBy("key", F.expr(f"piece div {FAN}")).applyInArrow(composed, schema)
        last //= FAN
    return fragments


def ranges(text: str, size: int = RANGE_CHARS) -> Iterator[str]:
    """Stretches of a text of about ``size`` characters, each without the space it begins with."""
    start = 0
    place = re.compile(r"(?<=[!-~]) (?=.)", re.DOTALL)
    while len(text) - start > size and (m := place.search(text, start + size)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def _root_blocks(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                f = _as_fragment(row)
                f = START if f is None else compose(START, f)
                totals = {c: [n] for c, n in zip(COUNTS, f.counts)}
                digest = hashlib.sha256(f.text.encode()).hexdigest() if f.counts[0] else ""
                n = np.arange(len(f.pairs))
                yield pa.RecordBatch.from_pylist(
                    [block_row([row["doc_id"]], totals, [digest], f.pairs, n * 0, n, f.times)], schema=arrow
                )

    return run


def _finished(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = row.column("ids").flatten()
                n_pairs = np.array(row.column("n_pairs").flatten(), np.int64)
                total = int(n_pairs.sum())
                place = _unpacked(row.column("places")[0].as_py(), total)
                times = _unpacked(row.column("times")[0].as_py(), total)
                n = np.array(row.column("n").flatten(), np.int64)
                best = np.array(row.column("best").flatten().cast(pa.int64()), np.int64)
                upto = np.concatenate([[0], np.cumsum(n_pairs)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(times * of[place] if total else times)])[upto]) for of in (best, n)]
                columns = [ids, *[row.column(c).flatten() for c in COUNTS], *map(pa.array, sums), row.column("hashes").flatten()]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return run
