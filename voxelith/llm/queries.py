"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, lm, packing, pii, quality, simhash, url_filter, warc
from .common import fold, read


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert(warc.pages_as_arc(read(spark, sf_dir, "pages")), min_bytes=0)


def page_labels(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """Pages are labelled by the document that their path ends with: bad if toxic or of low quality."""
    _, path = url_filter.split_url(F.col("url"))
    number = F.expr("try_cast(n AS bigint)")
    docs = pages.select("page_id", F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).alias("n")).select("page_id", number.alias("doc_id"))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return docs.join(labels, "doc_id").select("page_id", "bad")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, page_labels(spark, sf_dir, pages))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), 10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lines = chat.transcript_lines(turns)
    model = chat.learn(lines.where(F.coalesce(fold(F.col("conv_id"), 5), F.lit(0)) != 0).withColumn("line_no", F.col("turn")))
    raw = lines.select("conv_id", chat.line_number(F.col("turn"), F.col("k")).alias("line_no"), "text")
    turn = F.nullif(F.shiftright("line_no", 32), F.lit(chat.NO_TURN))
    return chat.render(chat.decode(raw, model, 64 << 32), 64 << 32).select("conv_id", turn.alias("turn"), "line_no", "role", "n_lines", "rendered")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), packing.tokenizer_path("byte_bpe_50k.tiktoken"), label="lang")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("failed").bitwiseAND(quality.mask_of(quality.BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    model = langid.learn(docs.where(~held).select("text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), 3, 2)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), packing.tokenizer_path("word_bpe_49k.json")).drop("loss_tokens")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.when(F.col("base") == "", F.col("more")).when(F.col("more") == "", F.col("base")).otherwise(F.concat_ws(",", "base", "more"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), spans.alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_warc": op1_warc, "op2_url_filter": op2_url_filter, "op3_decontamination": op3_decontamination, "op4_chat_format": op4_chat_format, "op5_lm_score": op5_lm_score, "op6_quality_rules": op6_quality_rules,
        "op7_language_id": op7_language_id, "op8_simhash_dedup": op8_simhash_dedup, "op9_packing": op9_packing, "op10_pii": op10_pii, "pipeline": pipeline,
    }


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g, least(10, len(w)) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             len(regexp_extract_all(text, '!')) AS n_exclaims, len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals, len(regexp_extract_all(text, '[0-9]')) AS n_digits
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
             + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END + CASE WHEN 10 * word_chars < 25 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
             + CASE WHEN 10 * n_exclaims > 3 * n_words THEN 64 ELSE 0 END + CASE WHEN 10 * n_capitals > 4 * word_chars THEN 128 ELSE 0 END + CASE WHEN 10 * n_digits > 5 * word_chars THEN 256 ELSE 0 END AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 > 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": DECONTAMINATION_SQL, "op6_quality_rules": QUALITY_SQL}
