"""Queries over the ten operators of this subpackage, one for each, on whole tables.

Six more show those columns of their results that SQL can express, beside that SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chat_format, decontaminate, gif_media, license_scan, lm_scoring, sentencepieces, simhash, toxicity, url_filter, warc
from lattica.session import prepare, table

#: A public model file; a parameter of the operators.
PIECES_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lm_scoring.score_split(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), PIECES_FILE)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), bad)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.store_and_read(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_windows(turns, model_file=PIECES_FILE))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.grades_of(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_gif_media": op5_gif_media,
    "op6_simhash": op6_simhash,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_license_scan": op10_license_scan,
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BITS = "flatten([[(CAST(ascii(k[i + 1]) AS BIGINT) >> j) & 1 for j in range(8)] for i in range(length(k))])"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BITS}), lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"

LM_BASE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS k, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT r, doc_id, {_CRC} % 7 = 2 AS held_out, w FROM d),
t AS (SELECT r, doc_id, held_out, unnest(list_append(w, ' end')) AS t FROM h),
c AS (SELECT t, count(*) AS c FROM t WHERE NOT held_out GROUP BY t), total AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM t LEFT JOIN c USING (t), total GROUP BY r, doc_id, held_out"""


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lm_scoring.base_split(table(spark, sf_dir, "documents")).withColumn("base_score", F.round("base_score", 4))


PIECE_ROUND_TRIP = "SELECT doc_id, sha256(replace(coalesce(text, ''), '\u2581', ' ')) AS decoded_sha256 FROM documents"


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_sentencepiece(spark, sf_dir).select("doc_id", "decoded_sha256")


_FITS = [f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{path}%' THEN '{host}{path}'" for _, host, path in sorted(url_filter.RULES, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r), reverse=True)]
URL_RULES = f"""WITH p AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {' '.join(_FITS)} END AS rule FROM p"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


MEDIA_PAYLOADS = """WITH p AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents), q AS (SELECT *, CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END AS pad FROM p)
SELECT doc_id, n AS n_bytes, n + pad AS payload_bytes, sha256(t || repeat(chr(0), pad)) AS payload_sha256 FROM q"""


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_gif_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


CHAT_DIGESTS = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256 FROM t GROUP BY conv_id"""


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_chat_format(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def _places(words: list[str]) -> str:
    stands = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words))
    return f"[i for i in range(greatest(len(w) - {len(words) - 1}, 0)) if {stands}]"


_PHRASES = {label: _places(phrase.split()) for phrase, label in license_scan.PHRASES}
LICENSE_PHRASES = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {', '.join(f'{sql} AS {label}' for label, sql in _PHRASES.items())} FROM d), q AS (SELECT *, flatten([{', '.join(_PHRASES)}]) AS every FROM p)
SELECT doc_id, len(w) AS n_words, len(every) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word, concat_ws(',', {', '.join(f"CASE WHEN len({label}) > 0 THEN '{label}' END" for label in sorted(_PHRASES))}) AS base_labels FROM q"""


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


ORACLE_SQL: dict[str, str] = {}
for _shown, _sql in ((lm_base, LM_BASE), (piece_round_trip, PIECE_ROUND_TRIP), (url_rules, URL_RULES), (media_payloads, MEDIA_PAYLOADS), (chat_digests, CHAT_DIGESTS), (license_phrases, LICENSE_PHRASES)):
    QUERIES[_shown.__name__] = _shown
    ORACLE_SQL[_shown.__name__] = _sql
