"""The operators applied to the whole test tables, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard_join, media, pii, quality, secrets, sentencepiece_trie, site_style, toxicity
from .common import read_table, session_for

#: Model file of the SentencePiece operator; read on the driver, sent to the executors.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _of_kind(spans: str, kind: int):
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), width=4, threshold=85)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.personal_data(docs, pii.fit(docs))
    own = F.transform("added", lambda s: F.struct(s["start"], (s["kind"] + len(pii.KINDS)).alias("kind"), s["end"]))
    counts = {f"n_{k}": _of_kind("base", i) for i, k in enumerate(pii.KINDS)}
    return found.select(
        "doc_id",
        *(c.alias(n) for n, c in counts.items()),
        F.sha2(pii.spans_text(F.array_sort("base")), 256).alias("base_sha256"),
        pii.spans_text(F.array_sort(F.concat("base", own))).alias("spans"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_for(spark)
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(hard).alias("prompt"), F.lit(hard).alias("response"))).alias("record"))
    records = chat.conversation_records(read_table(spark, sf_dir, "conversations")).unionByName(extra)
    return chat.read_back(chat.format_records(records))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.fit(docs.where(remainder != 0), labels.where(remainder != 0).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(SENTENCEPIECE_MODEL, "rb") as f:
        model = f.read()
    return sentencepiece_trie.encode_decode(read_table(spark, sf_dir, "documents"), model)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(read_table(spark, sf_dir, "pages"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.with_media(read_table(spark, sf_dir, "documents")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(read_table(spark, sf_dir, "documents"))
    counts = (_of_kind("base", k).alias(f"n_{secrets.KINDS[k]}") for k in range(3))
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"), secrets.spans_text(F.array_sort(F.concat("base", "linked"))).alias("spans"), secrets.links_text(F.col("links")).alias("links"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_pii, op3_chat_format, op4_decontaminate, op5_toxicity, op6_sentencepiece, op7_quality, op8_html, op9_media, op10_secrets)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def jaccard_sql(width: int, threshold: int) -> str:
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * both_ >= {threshold} * (p.n + q.n - both_)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def _escaped(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 1, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 2, 'assistant', '</s>[INST] ok [/INST]'
), parts AS (
  SELECT *, CASE WHEN role = 'assistant' THEN length({_escaped("text")}) + 4
    ELSE 7 + length(replace({_escaped("role")}, chr(10), '\n')) + 1 + length({_escaped("text")}) + 8 END AS size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(size))::BIGINT AS formatted_chars
FROM parts GROUP BY conv_id"""

ORACLE_SQL = {"op1_jaccard_join": jaccard_sql(4, 85), "op3_chat_format": CHAT_SQL}
