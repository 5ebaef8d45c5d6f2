"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, decontaminate, langid, ngram_join, quality, substring_dedup, toxicity, url_filter, webp
from sparkloom.sources import table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def fold(k: int) -> Column:
    """crc32 of doc_id as text, modulo k. The held-out folds are by it; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % k


def thresholded(scored: DataFrame, least: float) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold(3) != 1))
    return thresholded(toxicity.score(docs, model, "doc_id", (fold(3) == 1).alias("held_out")), 0.7)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = langid.train(docs.where(fold(5) != 0))
    return langid.predict(docs, trees, (fold(5) == 0).alias("held_out"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the two turns of conversation -7. If the table has a conversation -7 itself, its turns and these are one conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    return chat.summary(chat.format_chats(turns.unionByName(extra)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold(5) != 0))
    return thresholded(toxicity.score(docs, model, "doc_id", (fold(5) == 0).alias("held_out")), 0.3)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.read_back(webp.store_texts(table(spark, sf_dir, "documents")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_langid": op2_langid,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat": op4_chat,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_media": op7_media,
    "op8_url_filter": op8_url_filter,
    "op9_bpe": op9_bpe,
    "op10_ngram_join": op10_ngram_join,
}

#: SQL where SQL can say it. `chr(10)` is a line feed.
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": r"""
        WITH split AS (
            SELECT doc_id, row_number() OVER () AS row, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(t, '[\x20\x09-\x0D]+') END AS words
            FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM documents)),
        windows AS (
            SELECT row, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS h2
            FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM split)),
        repeated AS (SELECT h2 FROM windows GROUP BY h2 HAVING count(*) > 1),
        gone AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS k FROM windows SEMI JOIN repeated USING (h2)),
        words AS (SELECT doc_id, row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM split),
        kept AS (
            SELECT w.row, count(*) AS n_kept, string_agg(word, ' ' ORDER BY w.k) AS text FROM words w ANTI JOIN gone g ON w.row = g.row AND w.k = g.k GROUP BY w.row)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (row)""",
    "op8_url_filter": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
        rules(rule_host, rule_path, rule_verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        met AS (
            SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
                row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
            FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM met WHERE k = 1""",
    "op4_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        placed AS (
            SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS behind FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
                + CASE WHEN before IS DISTINCT FROM role THEN 5 + length(role) ELSE 6 END
                + CASE WHEN behind IS DISTINCT FROM role THEN 8 ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM placed GROUP BY conv_id""",
}
