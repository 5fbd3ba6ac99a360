"""The registered queries of this subpackage, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.locate import spread

from . import chat, decontaminate, language, media, mixing, neardup, quality, substring, token_counts, toxicity
from .sample import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and whole texts, for operators that work in Python; dealt anew only if the file would leave cores idle."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


_SAID = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAID).alias("text"))
    rows = rows.unionByName(own)
    done = chat.formatted(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("content")))
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "length({0}) + length({0}) - length(replace({0}, chr(92), '')) + len(regexp_extract_all({0}, '<[|]|<(?:/?s|pad|unk)>|\\[/?INST\\]'))"
ORACLES["op2_chat_formatting"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = language.train(docs.where(remainder("doc_id", 5) != 0))
    said = language.predict(docs.select("doc_id", "text"), model, reject=False)
    return said.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.removals(documents(spark, sf_dir))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op4_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS key
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), low AS (SELECT key, min(doc_id) AS least FROM win GROUP BY key),
bad AS (SELECT DISTINCT doc_id, i FROM win JOIN low USING (key) WHERE win.doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM bad),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda p: ps IS NULL OR NOT list_contains(ps, p)), lambda p: ws[p]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id
"""


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared")


ORACLES["op7_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark WHERE text IS NOT NULL
), bs AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b WHERE len(ws) >= 5)
  UNION ALL SELECT DISTINCT item_id, array_to_string(ws, ' ') FROM b WHERE len(ws) BETWEEN 1 AND 4),
ks AS (SELECT DISTINCT least(len(ws), 5) AS k FROM b WHERE len(ws) > 0),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1),
k AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_shared FROM k JOIN n USING (item_id) WHERE n_shared * 100 >= n_shingles * 80
"""


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(documents(spark, sf_dir), shingle=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLES["op8_minhash_neardup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), sizes AS (SELECT doc_id, len(sh) AS n FROM sets),
el AS (SELECT doc_id, unnest(sh) AS s FROM sets),
inter AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM el a JOIN el b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT u, v FROM inter JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT reach.doc_id, both_ways.v FROM reach JOIN both_ways ON reach.other = both_ways.u)
SELECT sizes.doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(other) AS component_id, sizes.doc_id = min(other) AS kept
FROM sizes JOIN reach ON reach.doc_id = sizes.doc_id GROUP BY sizes.doc_id
"""


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = media.stored(documents(spark, sf_dir))
    known = media.described(store)
    page = F.concat(F.lit('<figure><img alt="payload" src="sha256:'), "digest", F.lit('"><figcaption>'), F.coalesce(F.col("n_bytes").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    pages = media.interleaved(store.select("doc_id", page.alias("html")))
    found = media.resolved(pages, known, "doc_id").where("kind = 'image'")
    return found.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 on raw web pages: their texts and media references in reading order."""
    pages = media.interleaved(table(spark, sf_dir, "pages").select("page_id", "html"))
    none = media.described(media.stored(table(spark, sf_dir, "documents").where("false")))
    return media.resolved(pages, none, "page_id").select("page_id", "position", "kind", "text", "address", "caption", "payload_bytes")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.counted(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES |= {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_chat_formatting,
        op3_language_id,
        op4_substring_dedup,
        op5_source_mixing,
        op6_toxicity,
        op7_benchmark_decontamination,
        op8_minhash_neardup,
        op9_media_columns,
        op10_token_counts,
        media_pages,
    )
}
