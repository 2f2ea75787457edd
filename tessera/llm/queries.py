"""The operN queries: each operator with production parameters over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table


def tokenizer_path() -> str:
    """The vocabulary file; a parameter, set by TESSERA_TOKENIZER where it is elsewhere."""
    return os.environ.get("TESSERA_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import classes

    return classes(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_model import score

    return score(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_id import predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f) and name[2].isdigit()}


OP10_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '(?s)^([^/?#]*)([^?#]*)', 1) AS raw_host, regexp_extract(rest, '(?s)^([^/?#]*)([^?#]*)', 2) AS path FROM cut
), named AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), ruled AS (
  SELECT *, '.' || host AS dotted,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM named
), globbed AS (
  SELECT *, host || path AS whole FROM ruled
), chosen AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN whole LIKE '%cheap-pills%' THEN '*cheap-pills*'
    WHEN whole LIKE '%/wp-login%' THEN '*/wp-login*'
    WHEN whole LIKE '%casino%' THEN '*casino*'
    WHEN whole LIKE '%viagra%' THEN '*viagra*'
    WHEN whole LIKE '%poker%' THEN '*poker*'
    WHEN whole LIKE '%.edu/%' THEN '*.edu/*'
    WHEN whole LIKE '%.gov/%' THEN '*.gov/*'
    WHEN whole LIKE '%porn%' THEN '*porn*'
    WHEN whole LIKE '%.exe' THEN '*.exe'
    WHEN whole LIKE '%.zip' THEN '*.zip' END AS glob_rule
  FROM globbed
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN glob_rule IN ('*.edu/*', '*.gov/*') OR glob_rule IS NULL THEN 'allow' ELSE 'block' END AS verdict, glob_rule
FROM chosen
"""

OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""

SQL = {"op1_exact_dedup": OP1_SQL, "op10_url_filter": OP10_SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
