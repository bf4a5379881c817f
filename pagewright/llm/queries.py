"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, langid, media, quality, shards, suffix_dedup, token_counts
from .common import documents, fold, held_out, workspace, HELD_OUT_REMAINDER


def vocabulary() -> str:
    """The public rank file that the tokenizer queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold() != HELD_OUT_REMAINDER)
    scored = quality.score(docs.select("doc_id", "text", "n_chars"), machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, delete the short, revise those with digits scrubbed, add a second tokenizer, repeat a batch."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    rollup = token_counts.Rollup(spark, workspace(spark, "token-counts"))
    short = docs.where(F.length("text") < 200)
    digits = docs.where((F.length("text") >= 200) & F.col("text").rlike("[0-9]"))
    rollup.commit("0001-load", token_counts.changes(docs, "insert", "words-1"))
    rollup.commit("0002-short", token_counts.changes(short, "delete", "words-1"))
    rollup.commit("0003-scrubbed", token_counts.changes(digits, "revise", "words-1", text=F.regexp_replace("text", "[0-9]+", "")))
    rollup.commit("0004-bpe", token_counts.changes(token_counts.with_bpe_counts(docs, vocabulary(), out="n_tokens"), "insert", BPE, n_tokens=F.col("n_tokens")))
    rollup.commit("0002-short", token_counts.changes(short, "delete", "words-1"))
    return rollup.totals()


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, fold() != HELD_OUT_REMAINDER)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(documents(spark, sf_dir))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(documents(spark, sf_dir))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    return chat.digests(rows.unionByName(extra))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(role, '\', '\0'), '<|', '<\1')) + length(replace(replace(text, '\', '\0'), '<|', '<\1')) + 8 + 8 + 8 AS size FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

BPE = "byte_bpe_50k"
#: White space as the vocabulary's pattern takes it, for a matcher whose own class is of ASCII alone.
SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+"


def op5_sql() -> str:
    """Words by a pattern; byte-pair tokens by merging, in distinct pieces, the pair of lowest rank until none is known.

    White space before a word is cut before its last character (U+E000 marks the place), as the matcher has no look-ahead.
    """
    return rf"""
WITH RECURSIVE ranks AS (
  SELECT hex(from_base64(t)) AS token, r FROM read_csv('{vocabulary()}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'INTEGER'}})),
words AS (
  SELECT source, lang, regexp_replace(text, '[0-9]+', '', 'g') AS body FROM documents WHERE coalesce(length(text) >= 200, true)),
cut AS (
  SELECT source, lang, unnest(string_split(regexp_replace(text, '([{SPACE}]+)([{SPACE}][^{SPACE}])', '\1' || chr(57344) || '\2', 'g'), chr(57344))) AS part FROM documents),
pieces AS (
  SELECT source, lang, hex(encode(piece)) AS piece, count(*) AS n FROM (SELECT source, lang, unnest(regexp_extract_all(part, '{PIECE.replace("'", "''")}')) AS piece FROM cut) GROUP BY ALL),
merged(piece, parts) AS (
  SELECT piece, list_transform(range(length(piece) // 2), lambda i: substr(piece, 2 * i + 1, 2))
  FROM (SELECT DISTINCT piece FROM pieces) WHERE piece NOT IN (SELECT token FROM ranks)
  UNION ALL
  SELECT piece, list_concat(list_concat(parts[1 : k - 1], [parts[k] || parts[k + 1]]), parts[k + 2 :])
  FROM (SELECT piece, parts, arg_min(i, CAST(r AS BIGINT) * 1000000 + i) AS k
    FROM (SELECT piece, parts, unnest(range(1, len(parts))) AS i FROM merged) JOIN ranks ON token = parts[i] || parts[i + 1] GROUP BY piece, parts)),
sizes AS (SELECT piece, min(len(parts)) AS tokens FROM merged GROUP BY piece),
bpe AS (SELECT source, lang, sum(n * coalesce(tokens, 1)) AS n_tokens FROM pieces LEFT JOIN sizes USING (piece) GROUP BY ALL),
loaded AS (SELECT source, lang, count(*) AS n_docs, coalesce(sum(length(text)), 0) AS n_chars FROM documents GROUP BY ALL)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, CAST(coalesce(sum(len(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))), 0) AS BIGINT) AS n_tokens,
  CAST(coalesce(sum(length(body)), 0) AS BIGINT) AS n_chars FROM words GROUP BY ALL
UNION ALL
SELECT l.source, l.lang, '{BPE}', l.n_docs, CAST(coalesce(b.n_tokens, 0) AS BIGINT), CAST(l.n_chars AS BIGINT)
FROM loaded l LEFT JOIN bpe b ON b.source IS NOT DISTINCT FROM l.source AND b.lang IS NOT DISTINCT FROM l.lang
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard": op6_jaccard,
    "op7_language": op7_language,
    "op8_chat_format": op8_chat_format,
    "op9_media": op9_media,
    "op10_shards": op10_shards,
}

ORACLES: dict[str, str] = {
    "op5_token_counts": op5_sql(),
    "op8_chat_format": OP8_SQL,
}
