"""The operators' queries over the bundled tables, with production parameters, and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, chat, embeddings, licenses, minhash, mixing, packing, quality, rules, token_counts
from .tokenization import public_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_trees(chat.conversation_messages(rows), "mid", "parent", "conv_id")
    return chat.digests(formatted)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(_table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), weights, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(_table(spark, sf_dir, "embeddings"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(_table(spark, sf_dir, "documents"), keep=["doc_id"], clean=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.write_and_read(_table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_chat_formatting, op3_best_fit_packing, op4_quality_classifier, op5_license_scan,
        op6_embedding_near_dedup, op7_minhash_near_dedup, op8_quality_rules, op9_token_binary, op10_source_mixing, pipeline,
    )
}

_WORDS_SQL = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_OWN_WORDS = _WORDS_SQL.format("line")

ORACLES = {
    "op8_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
base AS (SELECT doc_id, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
lines AS (SELECT doc_id, line, {_OWN_WORDS} AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
marked AS (SELECT *, len(lw) AS n, len(list_filter(lw, lambda w: regexp_matches(w, {{shout}}))) AS shouts,
  length(regexp_replace(line, '[^{rules.BARS}]', '', 'g')) + len(list_filter(lw, lambda w: w IN ('/', '>'))) AS bars FROM lines WHERE len(lw) > 0),
judged AS (SELECT doc_id, line, list_sum(list_transform(lw, lambda w: length(w))) AS chars,
  NOT regexp_matches(line, '\p{{{{L}}}}') OR (n >= 4 AND 2 * shouts >= n) OR (bars >= 2 AND 3 * bars >= n - bars) OR (n < 4 AND NOT regexp_matches(lw[-1], {{terminal}}))
  OR (n <= 25 AND regexp_matches(lower(line), {{phrases}})) AS failed FROM marked),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(CAST(sum(chars) FILTER (WHERE NOT failed) AS BIGINT), 0) AS left_chars FROM judged GROUP BY doc_id),
runs AS (SELECT doc_id, i, w[i:i + 7] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r.doc_id, r.i FROM runs r JOIN (SELECT doc_id, run FROM runs GROUP BY doc_id, run HAVING count(*) > 1) t ON r.doc_id = t.doc_id AND r.run = t.run),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) t(k) GROUP BY doc_id),
whole AS (SELECT b.*, coalesce(p.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(p.left_chars, 0) AS left_chars
  FROM base b LEFT JOIN per p ON b.doc_id = p.doc_id LEFT JOIN covered c ON b.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * left_chars >= word_chars AS kept FROM whole""".format(
        shout=_quoted(rules.SHOUT), terminal=_quoted(rules.TERMINAL), phrases=_quoted("|".join(rules.BOILERPLATE_PHRASES))
    ),
    "op2_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(text) + length(regexp_extract_all(text, '\\|<\||\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS chars,
    length(role) + length(regexp_extract_all(role, '\\|<\||\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS role_chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(11 + role_chars + chars) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op6_embedding_near_dedup": r"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON l.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id""",
}
