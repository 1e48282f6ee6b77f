"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def remainder(of: int) -> Column:
    """Fold of a document: crc32 of its id as text, that of nothing for a null id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


# ---------------------------------------------------------------- 2 mixing


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT, 0) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         list_extract([5, 2, 1], CAST(rank % 3 + 1 AS INT)) AS weight,
         list_extract([-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE], CAST(rank % 3 + 1 AS INT)) AS slope
  FROM sources),
steps AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS step, coalesce(sum(cap) OVER filling, 0) AS filled, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighted WINDOW filling AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((total - filled) / open, step) AS level FROM steps, (SELECT 1.5::DOUBLE * sum(source_size) AS total FROM sources)
  WHERE NOT cap <= weight * ((total - filled) / open)),
targets AS (
  SELECT source, source_size, slope, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target
  FROM weighted, level),
placed AS (
  SELECT doc_id, size, source_size, target, slope, CAST(floor(target) AS BIGINT) AS goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(0, least(size, goal - before)) + greatest(0, least(size, goal - before - source_size)) AS taken,
         least(greatest(before / target, 0.0), 1.0) AS part
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN 2 * part / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * part)) END AS position
FROM taken
"""


@query("op2_mix_sources", MIX_SQL)
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, folder), weights=(5, 2, 1), share=1.5, most=2).select(
        "doc_id", "size", "source_size", "target", "taken", "position"
    )


# ---------------------------------------------------------------- 7 byte-level BPE


@query("op7_bpe_round_trip")
def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_documents(documents(spark, folder), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# ---------------------------------------------------------------- 10 language


@query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from .langid import identify, train

    docs = documents(spark, folder).withColumn("held_out", remainder(3) == 1)
    learnt = train(docs.where(~F.col("held_out")).select("text", "lang"))
    return identify(docs, learnt, keep=("doc_id", "held_out"))


# ---------------------------------------------------------------- 5 secrets


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from . import secrets

    docs = documents(spark, folder).select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    base = F.filter("secrets", lambda s: s["order"] < 3)

    def n(k: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["order"] == k)).cast("bigint")

    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"),
        secrets.spelled(F.col("secrets")).alias("spans"),
    )


# ---------------------------------------------------------------- 6 quality


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from .common import written
    from .quality import fit, measured, score

    rows = written(measured(documents(spark, folder)), "statistics")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rules = fit(written(rows.join(labels, "doc_id").where(remainder(5) != 0), "labelled"))
    return score(rows, rules).select(
        "doc_id",
        (remainder(5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


# ---------------------------------------------------------------- 8 licenses


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from .licenses import scan

    found = scan(documents(spark, folder))
    base = F.filter("spans", lambda s: s["kind"] == "phrase")
    starts = F.transform(base, lambda s: s["start"].cast("bigint"))

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


# ---------------------------------------------------------------- 9 near-duplicates

MINHASH_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM worded),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) + any_value(b.n) AS total
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (total - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN lowest ON doc_id = a
"""


@query("op9_minhash_dedup", MINHASH_SQL)
def op9_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(documents(spark, folder), size=3, percent=85)


# ---------------------------------------------------------------- 3 exact top-k

TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query("op3_top_inner_products", TOPK_SQL)
def op3_top_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    from .blocks import usable
    from .mips import top_k

    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    vectors = embeddings(spark, folder).where(usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), whole.alias("vector"), (F.col("vec_id") % 50 == 0).alias("is_query")
    )
    return top_k(vectors, 5).withColumnRenamed("id", "vec_id")


# ---------------------------------------------------------------- 1 near-duplicate vectors

COVER_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN lowest l ON vec_id = l.a LEFT JOIN counted c ON vec_id = c.a
"""


@query("op1_cover_tree_dedup", COVER_SQL)
def op1_cover_tree_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .cover_tree import near_duplicates

    vectors = embeddings(spark, folder).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return near_duplicates(vectors, 0.95).withColumnRenamed("id", "vec_id")


# ---------------------------------------------------------------- 4 copied strings


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .suffix_dedup import remove_copies

    left = remove_copies(documents(spark, folder), length=200, keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return left.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# ---------------------------------------------------------------- 13 conversations


def _inserted(state: str, role: str) -> str:
    return f"{{'c': {state}.c + 3, 'a': {state}.a || 'I', 't': list_append({state}.t, '{role}:')}}"


def _deleted(state: str) -> str:
    return f"{{'c': {state}.c + 4, 'a': {state}.a || 'D', 't': {state}.t}}"


def _kept(state: str, initial: str) -> str:
    cost = f"CASE WHEN left(role, 1) = '{initial}' AND NOT gone THEN cut ELSE 1000000 END"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || 'K', 't': list_append({state}.t, role || ':' || text)}}"


def _reroled(state: str, role: str) -> str:
    cost = "CASE WHEN gone THEN 1000000 ELSE 3 + cut END"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || 'R', 't': list_append({state}.t, '{role}:' || text)}}"


_NOWHERE = "{'c': 1000000::BIGINT, 'a': '', 't': CAST([] AS VARCHAR[])}"
#: Forward walk over the rows: the least (cost, audit) of each state, its text beside it.
CONVERSATION_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(flatten(list_transform(range(1, len(k) + 1), lambda i: [CAST(ord(substr(k, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
         lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fault FROM keyed),
said AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE fault <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS body FROM said),
judged AS (
  SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         CASE WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS cut,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM numbered),
rows AS (SELECT *, blank OR again AS gone FROM judged),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': CAST([] AS VARCHAR[])}} AS s0,
         {_NOWHERE} AS s1, {_NOWHERE} AS s2, {_NOWHERE} AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, i, {_deleted('s0')}, list_min([{_deleted('s1')}, {_kept('s0', 's')}]),
         list_min([{_deleted('r2')}, {_kept('s0', 'u')}, {_kept('s1', 'u')}, {_kept('r3', 'u')},
                   {_reroled('s0', 'user')}, {_reroled('s1', 'user')}, {_reroled('r3', 'user')}]),
         list_min([{_deleted('r3')}, {_kept('r2', 'a')}, {_reroled('r2', 'assistant')}])
  FROM (SELECT *, list_min([s3, {_inserted('r2', 'assistant')}]) AS r3
        FROM (SELECT w.s0, w.s1, w.s3, r.conv_id, r.i, r.role, r.text, r.gone, r.cut,
                     list_min([s2, {_inserted('s0', 'user')}, {_inserted('s1', 'user')}, {_inserted('s3', 'user')}]) AS r2
              FROM walk w JOIN rows r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1))),
ended AS (
  SELECT conv_id, i, list_min([s0, s3, {_inserted('r2', 'assistant')}]) AS best
  FROM (SELECT *, list_min([s2, {_inserted('s0', 'user')}, {_inserted('s1', 'user')}, {_inserted('s3', 'user')}]) AS r2 FROM walk)),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (cut > 0 AND NOT gone) AS truncated,
         count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
       sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id WHERE e.i = coalesce(c.n, 0)
"""


@query("op13_conversation_repair", CONVERSATION_SQL)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from .conversations import damage, repair

    return repair(damage(spark.read.parquet(f"{folder}/conversations.parquet")))


# ---------------------------------------------------------------- 12 two tokenizers


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    paths = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align(documents(spark, folder), *paths)


# ---------------------------------------------------------------- 11 language model


@query("op11_lm_score")
def op11_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    from .lm import score

    return score(documents(spark, folder).withColumn("held_out", remainder(7) == 2))
