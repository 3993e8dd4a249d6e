"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.llm import bpe, chat, exact, imatch, kneser_ney, langid, lexical, ngram_join, packing, simhash, substring, vector_codes, warc
from tonespark.llm.scratch import new_path

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(n: int):
    """Whether a row is in the fold that nothing is learned from; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~_held_out(3))
    made = langid.label(docs.select("doc_id", "text"), model)
    return made.select("doc_id", _held_out(3).alias("held_out"), "lang_pred", "score", "spans")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_id", "n_copies", "n_shingles")


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.with_edits(_table(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.parse_records(warc.read_records(spark, path)).drop("url")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_conversations(chat.format_conversations(turns.unionByName(extra)))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = kneser_ney.score(docs, kneser_ney.fit(docs, ~_held_out(5)))
    return scored.withColumn("held_out", _held_out(5))


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decide(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_ngram_join, op3_imatch, op4_warc_archive, op5_chat_format, op6_kneser_ney, op7_cost_packing, op8_substring_dedup, op9_exact_dedup, op10_byte_bpe, op11_vector_codes, op12_simhash, op13_lexical_search)}

_ESCAPED = "replace(coalesce(text, ''), '\\', '\\\\')"
for _c in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_RUN = "lpad(to_base(cast('0x' || substr(h, {}, 10) as bigint), 32), 8, '0')"

_SQUARE = " + ".join(f"(x[{k}] - y[{k}]) * (x[{k}] - y[{k}])" for k in range(1, 5))
_FLOOR = "(s{0} - ((s{0} % n) + n) % n) // n"
_ASSIGN = f"(SELECT r, part, x, min(struct_pack(d := d, e := e)) AS m FROM (SELECT r, p.part, x, e, {_SQUARE} AS d FROM p JOIN {{0}} c ON p.part = c.part) GROUP BY ALL)"
_IMPROVE = f"""{{0}} AS (SELECT c.part, c.e, CASE WHEN n IS NULL THEN y ELSE [{', '.join(_FLOOR.format(k) for k in range(1, 5))}] END AS y FROM {{1}} c LEFT JOIN
  (SELECT part, m.e AS e, count(*) AS n, {', '.join(f'cast(sum(x[{k}]) AS bigint) AS s{k}' for k in range(1, 5))} FROM {_ASSIGN.format('{1}')} GROUP BY ALL) a ON a.part = c.part AND a.e = c.e)"""

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"

ORACLE_SQL = {
    "op13_lexical_search": f"""
WITH t AS (SELECT doc_id, {_TERMS} FROM documents), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, cast(sum(n) AS bigint) AS total FROM n),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS bigint) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
s AS (SELECT item_id, doc_id, cast(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) AS bigint) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), g GROUP BY ALL)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10""",
    "op11_vector_codes": f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM v, range(16) t(part)),
c0 AS (SELECT part, r AS e, x AS y FROM p WHERE r < 64),
{_IMPROVE.format('c1', 'c0')},
{_IMPROVE.format('c2', 'c1')},
a AS (SELECT r, string_agg(format('{{:02x}}', m.e), '' ORDER BY part) AS code, cast(sum(m.d) AS bigint) AS error FROM {_ASSIGN.format('c2')} GROUP BY r)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) FROM c2) AS codebooks_sha256 FROM a JOIN v USING (r)""",
    "op4_warc_archive": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
e AS (SELECT *, translate({' || '.join(_RUN.format(1 + 10 * k) for k in range(4))}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  min(page_id) OVER (PARTITION BY h) AS head FROM d)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to FROM e""",
    "op5_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_ESCAPED} AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  cast(3 + sum(length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 28 + length(role) END) AS bigint) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
