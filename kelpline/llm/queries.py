"""The operators applied to the whole tables, with production parameters; ``QUERIES`` and ``ORACLE_SQL`` hold them by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_format, conv_quality, lexical_search, lm_scores, nn_descent, packing, quality_rules, simhash, substring_dedup, token_alignment, token_counts, url_filter
from .common import table

#: Vocabulary files; every machine has them at the same paths.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER, ("n_tokens", "ids_text", "decoded"))
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_conv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), F.col("query_id") % 50 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), TOKENIZER, PIECES, digest=True)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    awkward = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], talks.schema)
    return chat_format.read_digests(chat_format.format_conversations(talks.unionAll(awkward)))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_lm_scores, op3_substring_dedup, op4_url_filter, op5_packing, op6_quality_rules, op7_bpe_codec, op8_conv_quality, op9_nn_descent, op10_token_counts, op11_token_alignment, op12_chat_format, op13_lexical_search)}

#: Queries that DuckDB can express on the whole tables; the others rest on trained models, tokenizers or approximate search.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": """
WITH w AS (SELECT doc_id, words, len(words) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents)),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, n - 11)) AS i FROM w WHERE n >= 13)),
dup AS (SELECT doc_id, i FROM win JOIN (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g) USING (g) WHERE first_id < doc_id),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM dup CROSS JOIN (SELECT unnest(range(13)) AS k)),
tok AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, n + 1)) AS p FROM w),
kept AS (SELECT tok.doc_id, string_agg(word, ' ' ORDER BY tok.p) AS left_over, count(*) AS c FROM tok LEFT JOIN cov ON tok.doc_id = cov.doc_id AND tok.p = cov.p WHERE cov.p IS NULL GROUP BY 1)
SELECT w.doc_id, w.n AS n_words, w.n - coalesce(c, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op6_quality_rules": """
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest(range(3)) AS k) GROUP BY 1),
lines AS (SELECT r, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w),
base AS (SELECT r, doc_id, stratum, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w JOIN lines USING (r) LEFT JOIN rep USING (r)),
stats AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / nullif(word_chars, 0) AS v1, n_dup_lines / nullif(n_words, 0) AS v2, n_repeat_words / nullif(n_words, 0) AS v3, word_chars / nullif(n_words, 0) / 100 AS v4 FROM base),
held AS (SELECT * FROM stats WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1)),
cuts AS (SELECT list_transform(range(48), lambda i: round(0.95e0 * pow(0.9e0, i), 6)) AS c), places AS (SELECT unnest(range(48)) AS i),
sizes AS (SELECT stratum, n, m, sum(n) OVER (ORDER BY m DESC) - n AS smaller, count(*) OVER () AS strata FROM (SELECT stratum, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, stratum) AS m FROM held GROUP BY 1)),
split AS (SELECT coalesce(max(m) FILTER (WHERE n >= ln(0.05e0 / (m + CAST(m < strata AS INT))) / ln(1 - 0.01e0)), 0) AS alone, max(strata) AS strata FROM sizes),
shares AS (SELECT alone, alone < strata AS pooled, 0.05e0 / (alone + CAST(alone < strata AS INT)) AS level FROM split),
members AS (SELECT stratum AS g, stratum FROM sizes CROSS JOIN shares WHERE m <= alone
 UNION ALL SELECT NULL, stratum FROM sizes CROSS JOIN shares WHERE pooled AND (m > alone OR smaller < ln(level) / ln(1 - 0.01e0))),
trials AS (SELECT g, i, count(*) AS n, count(*) FILTER (WHERE v1 > c[i + 1] OR v2 > c[least(i, 10) + 1] OR v3 > c[least(i, 5) + 1] OR v4 > c[least(i, 16) + 1]) AS hit FROM held JOIN members USING (stratum) CROSS JOIN places CROSS JOIN cuts GROUP BY g, i),
sure AS (SELECT g, max(i) AS i FROM trials CROSS JOIN shares WHERE hit <= 0.01e0 * n AND list_sum(list_transform(range(hit + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.01e0) + (n - k) * ln(1 - 0.01e0)))) <= level GROUP BY g),
limits AS (SELECT stratum, c[i + 1] AS l1, c[least(i, 10) + 1] AS l2, c[least(i, 5) + 1] AS l3, c[least(i, 16) + 1] AS l4 FROM sizes CROSS JOIN shares JOIN sure ON sure.g IS NOT DISTINCT FROM CASE WHEN m <= alone THEN stratum END CROSS JOIN cuts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(v1 > l1, FALSE) AND NOT coalesce(v2 > l2, FALSE) AND NOT coalesce(v3 > l3, FALSE) AND NOT coalesce(v4 > l4, FALSE) AS kept
FROM stats LEFT JOIN limits USING (stratum)""",
    "op13_lexical_search": """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT count(*) AS big_n, sum(len(terms)) AS big_l FROM d WHERE len(terms) > 0),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf CROSS JOIN s GROUP BY term, big_n),
m AS (SELECT r, doc_id, 25 + (75 * len(terms) * big_n) // big_l AS m FROM d CROSS JOIN s WHERE len(terms) > 0),
scored AS (SELECT item_id, m.r, m.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
