"""License scans by diagonal voting.

Rolling word k-gram hashes of documents meet those of templates in an equi-join. A hit votes for
the diagonal (document position minus template position); votes are counted for each document,
template and diagonal, neighbouring diagonals are merged, and merged spans are verified by the
share of the template's k-grams that they hold. Only DataFrame functions.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound

# Words of a text, phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Openings of well-known license notices.
NOTICES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software",
    "apache-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the "
    "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer",
    "cc-notice": "This work is licensed under a Creative Commons Attribution",
}
# Whole texts of short licenses.
TEXTS = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
    "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
    "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
    "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
    "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the "
    "authors be held liable for any damages arising from the use of this software. Permission is granted to anyone "
    "to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
    "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment "
    "in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
    "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not "
    "be removed or altered from any source distribution.",
}
#: Diagonals at most this far apart belong together: words that an editor put in or left out.
SLACK = 3
#: Share of a notice's k-grams that a span must hold.
COVERAGE = 0.6
#: Places of the table that tells k-grams of no template apart before the join.
BUCKETS = 1 << 14


def words(text: Column) -> Column:
    """Words of a lower-cased text.

    ``lower`` also lowers letters beyond A-Z; that changes neither the number of words nor what equals
    a phrase.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def grams(w: Column) -> Column:
    """Hashes of the two words from each position of an array of words: every word is hashed once."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))

    def two(h: Column) -> Column:
        firsts = F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))
        return F.zip_with(firsts, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b))

    return bound(hashed, two)


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """label, kind, t_pos, two, four, n: k-grams of phrases (k = 2) and notices (k = 4)."""
    rows = [(label, "phrase", text) for text, label in phrases.items()]
    rows += [(label, "notice", text) for label, text in notices.items()]
    for label, kind, text in rows:
        least = 2 if kind == "phrase" else 4
        if len(re.findall(WORD, text.lower())) < least:
            raise ValueError(f"a {kind} needs {least} words or more: {label}: {text!r}")
    raw = spark.createDataFrame(rows, "label string, kind string, text string")
    rolled = _hashed(raw.select("label", "kind", words(F.col("text")).alias("w")), ["label", "kind"], None)
    return rolled.where((F.col("kind") == "phrase") | F.col("four").isNotNull()).select(
        "label",
        "kind",
        F.col("pos").alias("t_pos"),
        F.col("two").alias("t_two"),
        F.when(F.col("kind") == "notice", F.col("four")).alias("t_four"),
        F.count(F.lit(1)).over(Window.partitionBy("label", "kind")).alias("n"),
    )


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _hashed(df: DataFrame, keep: list[str], filled: Column | None) -> DataFrame:
    """A row for each word position with a k-gram: pos, two, four (null at the end of a text).

    The k-grams of all positions are hashed. With ``filled``, an array that tells which buckets
    template k-grams fall into, only those in such a bucket become rows.
    """
    def rows(two: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(two) - 1)
        if filled is not None:
            places = F.filter(places, lambda i: F.get(filled, _bucket(F.get(two, i))))
        some = F.transform(
            places,
            lambda i: F.struct(
                i.alias("pos"),
                F.get(two, i).alias("two"),
                F.when(F.get(two, i + 2).isNotNull(), F.xxhash64(F.get(two, i), F.get(two, i + 2))).alias("four"),
            ),
        )
        return F.when(F.size(two) > 0, some)

    return df.select(*keep, F.explode(bound(grams(F.col("w")), rows)).alias("g")).select(*keep, "g.pos", "g.two", "g.four")


def hits(docs: DataFrame, table: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, label, kind, n, pos, t_pos: where k-grams of texts meet those of templates.

    The templates are a fixed list: their k-grams are broadcast, and so is, as a folded literal, the
    table of the buckets they fall into, by which a text's k-grams are sorted out before they become rows.
    """
    taken = {r[0] for r in table.select(_bucket(F.col("t_two"))).distinct().collect()}
    filled = F.from_json(F.lit(json.dumps([i in taken for i in range(BUCKETS)])), "array<boolean>")
    rolled = _hashed(docs.select(*keys, words(F.col(text)).alias("w")), keys, filled)
    return rolled.join(
        F.broadcast(table),
        (F.col("two") == F.col("t_two")) & (F.col("t_four").isNull() | (F.col("four") == F.col("t_four"))),
    ).select(*keys, "label", "kind", "n", "pos", "t_pos")


def spans(found: DataFrame, keys: list[str], slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """keys, label, kind, start, end, score: verified spans in words, end exclusive.

    A phrase must hold all its k-grams on one diagonal. A notice's neighbouring diagonals are merged
    first, and a span needs the share ``coverage`` of its k-grams, each counted once.
    """
    diagonals = found.groupBy(*keys, "label", "kind", "n", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("held"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    near = Window.partitionBy(*keys, "label", "kind").orderBy("diagonal")
    apart = F.coalesce(
        (F.col("diagonal") - F.lag("diagonal").over(near) > slack) | (F.col("kind") == "phrase"), F.lit(True)
    )
    merged = (
        diagonals.withColumn("apart", apart.cast("int"))
        .withColumn("run", F.sum("apart").over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*keys, "label", "kind", "n", "run")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"),
            F.min("first").alias("start"),
            (F.max("last") + F.when(F.col("kind") == "phrase", 2).otherwise(4)).alias("end"),
        )
    )
    share = F.size("held") / F.col("n")
    need = F.when(F.col("kind") == "phrase", F.lit(1.0)).otherwise(F.lit(coverage))
    return merged.withColumn("score", share).where(F.col("score") >= need).select(
        *keys, "label", "kind", "start", "end", "score"
    )


def scan(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
) -> DataFrame:
    """doc_id, n_words, spans: array of (label, kind, start, end, score) in order of start.

    One row per row of docs. Spans are found once for each distinct (id, text) and joined back, so
    repeated rows get the same spans; a null or empty text has no words and no spans. The join
    of k-grams with templates is a broadcast of the fixed template list; documents are shuffled only
    as hits and as (id, text hash, number of words). The k-grams of every text are hashed and looked up. A
    phrase of one word and a notice of fewer than four words have no k-gram and raise a ValueError.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES | TEXTS if notices is None else notices
    table = templates(docs.sparkSession, phrases, notices)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )
    keys = ["doc_id", "text_hash"]
    found = spans(hits(rows, table, keys), keys)
    listed = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "kind", "score"))).alias("spans")
    )
    counted = rows.select(*keys, F.coalesce(F.regexp_count(F.lower("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_words"))
    named = listed.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    none = F.array().cast("array<struct<start:int,end:int,label:string,kind:string,score:double>>")
    return counted.join(named, on, "left").select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"))
