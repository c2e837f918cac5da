"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from causeway.llm import (
    chat_template, checking_sql, conversation_repair, decontaminate, hidden_markov, html_text, kdtree_topk, language_id, lattice_dedup,
    line_dedup, minhash_dedup, mixing, piece_sampling, spelling,
)
from causeway.llm.common import crc_remainder, table
from causeway.session import tune


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, folder, "documents"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    drawn = mixing.draw(table(spark, folder, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return drawn.select("doc_id", "size", "source_size", "target", taken)


def op3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by sampling and decoded again."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = piece_sampling.encode(docs)
    both = piece_sampling.decode(encoded.select("row.doc_id", "row.text", "piece_ids"))
    return both.select("row.doc_id", F.size("row.piece_ids").cast("bigint").alias("n_pieces"),
                       F.xxhash64("row.piece_ids").alias("pieces_hash"), F.length("decoded").cast("bigint").alias("n_chars"),
                       F.col("decoded").eqNullSafe(F.col("row.text")).alias("lossless"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = line_dedup.dedup_lines(docs)
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint")
    return made.select("doc_id", n_lines.alias("n_lines"), F.length("text").cast("bigint").alias("n_chars"),
                       F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = crc_remainder(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held))
    done = language_id.predict(docs.select("doc_id", "text"), model)
    return done.select("row.doc_id", (crc_remainder(F.col("row.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_markov.score_texts(table(spark, folder, "documents"))


def op7_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_template.digests(chat_template.format_conversations(rows.union(extra)))


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "html")
    return html_text.extract(pages).select("row.page_id", F.length("visible").cast("bigint").alias("n_chars"), "visible")


def op10_kdtree(spark: SparkSession, folder: str) -> DataFrame:
    return kdtree_topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants_of(table(spark, folder, "documents").select("doc_id", "text"))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, folder, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.audit(conversation_repair.damage(rows), rows)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


def _tuned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(tune(spark), folder)


QUERIES = {q.__name__: _tuned(q) for q in (
    op1_minhash, op2_mixing, op3_pieces, op4_line_dedup, op5_language, op6_hidden_markov, op7_lattice, op8_chat, op9_html,
    op10_kdtree, op11_spelling, op12_decontamination, op13_conversation_repair, pipeline)}

_MIXING_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([5.0, 2.0, 1.0]::DOUBLE[], 1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)) AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS everything FROM s
), levels AS (
  -- The level at which the sources up to one are full and the rest share what is left.
  SELECT a.source, any_value(a.cap / a.w) AS full_at,
         (any_value(a.everything) - coalesce(sum(b.cap) FILTER (WHERE b.cap / b.w < a.cap / a.w), 0))
         / sum(b.w) FILTER (WHERE b.cap / b.w >= a.cap / a.w) AS level
  FROM c a, c b GROUP BY a.source
), t AS (
  SELECT source, source_size, least(cap, w * (SELECT min_by(level, full_at) FROM levels WHERE full_at >= level)) AS target,
         ('0x' || left(md5('mix/' || coalesce('=' || source, '')), 5))::BIGINT / 1048576.0::DOUBLE AS u
  FROM c
), u AS (
  SELECT doc_id, source, size, count(*) AS n,
         sum(count(*)) OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - count(*) AS r
  FROM d GROUP BY doc_id, source, size
), m AS (
  SELECT u.*, source_size, target, u.u_, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM (SELECT u.*, t.source_size, t.target, t.u AS u_ FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source) u
)
SELECT doc_id, size, source_size, target,
       (size * least(3, floor((r + x + 1) * rate + u_) - floor((r + x) * rate + u_)))::BIGINT AS taken
FROM m, range(n) t(x)
"""

_CHAT_SQL = """
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>') AS t,
         replace(replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>'), ':', '\\:'),
                 chr(10), '\\' || chr(10)) AS r
  FROM a
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || r || ':' || chr(10) || t || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS p FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.p, v.p)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_LATTICE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a
)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = v.vec_id
JOIN (SELECT n, min(c) AS c FROM r GROUP BY n) m ON m.n = v.vec_id
"""

ORACLES = {
    "op2_mixing": _MIXING_SQL,
    "op7_lattice": _LATTICE_SQL,
    "op8_chat": _CHAT_SQL,
    "op10_kdtree": _TOPK_SQL,
    "op11_spelling": checking_sql.SPELLING,
    "op12_decontamination": checking_sql.LEAKS,
    "op13_conversation_repair": checking_sql.REPAIR,
}
