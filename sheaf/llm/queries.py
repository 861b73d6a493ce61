"""Registered queries of the numbered operators, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheaf.llm import annsearch, exactdedup, langid, mixing, packing, piecing, simhash, tokencounts, tokenfiles, toxicity, turnrepair, turntrie, urlrules
from sheaf.llm.common import held_out
from sheaf.llm.tokenizing import Vocabulary


def word_vocabulary() -> Vocabulary:
    return Vocabulary(public_tokenizers.path("word_bpe_49k.json"), drops_space=True)


def byte_vocabulary() -> Vocabulary:
    return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), drops_space=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, train=~held_out(F.col("doc_id")))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_vocabulary())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.nearest(table(spark, sf_dir, "embeddings"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), train_rows=~held_out(F.col("doc_id")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), byte_vocabulary())


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.write_and_read(table(spark, sf_dir, "documents"), byte_vocabulary())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    encoded = piecing.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.repair(table(spark, sf_dir, "conversations"), damaged=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_language_id, op3_url_rules, op4_packing, op5_mixing, op6_nearest, op7_toxicity, op8_token_counts, op9_token_files,
    op10_exact_dedup, op11_pieces, op12_repair,
    op13_prefix_trie, pipeline)}


def _pattern_sql(pattern: str) -> str:
    """The regular expression of a pattern rule, as a SQL literal."""
    out = ""
    if pattern.startswith("||"):
        out, pattern = r"^([^/?#]*[.])?", pattern[2:]
    end = pattern.endswith("|")
    for c in pattern.rstrip("|"):
        out += {"*": ".*", "^": r"([^0-9A-Za-z_.%-]|\z)"}.get(c, c if c.isalnum() or c in "_-=/" else f"[{c}]")
    return "'(?s)" + out + (r"\z" if end else "") + "'"


_HOSTS = ", ".join("('{}', '{}', '{}', '{}')".format(shown, shown.split("/", 1)[0], "/" + shown.split("/", 1)[1], verdict)
                   for shown, _, verdict in urlrules.HOST_RULES)
_BLOCKED = " OR ".join(f"regexp_matches(target, {_pattern_sql(p)})" for p, _ in urlrules.PATTERN_RULES)

OP3_SQL = rf"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^/?#]*(.*)$', 1) AS tail FROM rest
), known AS (SELECT *, host || tail AS target, row_number() OVER () AS n FROM parts),
rules(rule, rule_host, rule_path, verdict) AS (VALUES {_HOSTS}),
fits AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM known, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict
FROM known LEFT JOIN fits USING (n)
"""

OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w
  FROM sized GROUP BY source
), filled AS (
  SELECT *, source_size * 2.0::DOUBLE / w AS full_at, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM per
), levels AS (
  SELECT *, (budget - coalesce(sum(source_size * 2) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled
), reached AS (SELECT min(level) FILTER (level <= full_at) AS unused, arg_min(level, full_at) FILTER (level <= full_at) AS reached FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN reached IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, reached * w) END AS target
  FROM levels, reached
), queued AS (
  SELECT s.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS cut, coalesce(sum(size) OVER (
    PARTITION BY s.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source, source_size, target,
       greatest(0, least(size, cut - start))::BIGINT + greatest(0, least(size, cut - start - source_size))::BIGINT AS taken FROM queued
"""

OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cps, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY cps DESC, doc_id NULLS LAST)
"""

ORACLES = {"op3_url_rules": OP3_SQL, "op5_mixing": OP5_SQL, "op10_exact_dedup": OP10_SQL}
