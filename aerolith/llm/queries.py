"""Registered queries of the training-data operators, with SQL twins where SQL can express them.

Each query reads whole tables with production parameters and only reshapes its operator's result.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.exact_dedup import exact_groups
from aerolith.llm.hilbert_ann import nearest
from aerolith.llm.license_scan import license_scan, scan_sql
from aerolith.llm.line_dedup import line_dedup
from aerolith.llm.mixing import mixture
from aerolith.llm.sentencepiece_codec import round_trip
from aerolith.llm.simhash_dedup import simhash_groups
from aerolith.llm.substring_dedup import substring_dedup
from aerolith.llm.token_counts import token_counts
from aerolith.llm.toxicity import toxicity


def tokenizer_path(name: str) -> str:
    """Vocabulary file on the driver: AEROLITH_TOKENIZERS names the folder, else the installed package does."""
    folder = os.environ.get("AEROLITH_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), budget=2048)


def op3_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=3)
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("removed", "kept")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=35).drop("removed")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), max_epochs=2.5)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_token_counts": op2_token_counts,
    "op3_hilbert_ann": op3_hilbert_ann,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": scan_sql(),
    "op9_mixing": """
        WITH RECURSIVE d AS (
          SELECT doc_id, coalesce(source, '') AS source, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
          FROM documents),
        t AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS n_rows FROM d GROUP BY source),
        e AS (SELECT CAST(max(tokens) AS DOUBLE) AS most, CAST(min(tokens) AS DOUBLE) AS least, CAST(sum(tokens) AS DOUBLE) AS total
              FROM t WHERE tokens > 0),
        b(i, lo, hi) AS (
          SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
          UNION ALL
          SELECT i + 1,
                 CASE WHEN pow(most / least, 1 - (lo + hi) / 2) <= 2.5 THEN lo ELSE (lo + hi) / 2 END,
                 CASE WHEN pow(most / least, 1 - (lo + hi) / 2) <= 2.5 THEN (lo + hi) / 2 ELSE hi END
          FROM b, e WHERE i < 40),
        a AS (SELECT CASE WHEN most / least <= 2.5 THEN 0 ELSE hi END AS a, most FROM b, e WHERE i = 40),
        w AS (
          SELECT source, tokens, n_rows, a, most,
                 CASE WHEN tokens > 0 THEN pow(CAST(tokens AS DOUBLE), a) ELSE 0 END AS power FROM t, a),
        v AS (
          SELECT source, tokens, n_rows, round(power / sum(power) OVER (), 6) AS weight,
                 CASE WHEN tokens > 0 THEN round(power / tokens * max(tokens / power) FILTER (WHERE tokens > 0) OVER (), 6) ELSE 1 END AS epochs FROM w),
        u AS (
          SELECT *, CAST(floor(epochs) AS BIGINT) AS full_epochs, floor((epochs - floor(epochs)) * tokens + 1e-6) AS rest,
                 CAST(ceil(n_rows / 1024.0) AS BIGINT) AS blocks FROM v),
        r AS (
          SELECT d.*, weight, epochs, full_epochs, rest,
                 CAST('0x' || substr(md5('0|block|' || k), 1, 8) AS BIGINT) % blocks AS block
          FROM d JOIN u USING (source)),
        p AS (
          SELECT source, block, sum(n_tokens) AS in_block, md5('0|' || CAST(full_epochs AS VARCHAR) || '|' || CAST(block AS VARCHAR)) AS place
          FROM r GROUP BY source, block, full_epochs),
        q AS (
          SELECT source, block, coalesce(sum(in_block) OVER (PARTITION BY source ORDER BY place, block
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM p)
        SELECT doc_id, source, n_tokens, weight, epochs,
               CAST(full_epochs + CASE WHEN n_tokens > 0 AND done + sum(n_tokens) OVER (PARTITION BY source, block
                    ORDER BY md5('0|' || CAST(full_epochs AS VARCHAR) || '|row|' || k), k, n_tokens
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
        FROM r JOIN q USING (source, block)
    """,
    # every shortest run of 24 characters, from each line and up to each line, and the first document that holds it
    "op5_line_dedup": """
        WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
        k AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || t)) AS o FROM d),
        u AS (SELECT o, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM k),
        l AS (SELECT *, length(line) AS n, sum(length(line)) OVER (PARTITION BY o ORDER BY i) AS c FROM u),
        w AS (
          SELECT a.o, a.i AS s, min(b.i) AS e FROM l a JOIN l b ON b.o = a.o AND b.i >= a.i AND b.c - a.c + a.n >= 24 GROUP BY 1, 2
          UNION SELECT b.o, max(a.i), b.i FROM l a JOIN l b ON b.o = a.o AND b.i >= a.i AND b.c - a.c + a.n >= 24 GROUP BY b.o, b.i),
        r AS (SELECT w.o, s, e, string_agg(line, chr(10) ORDER BY i) AS run FROM w JOIN l ON l.o = w.o AND i BETWEEN s AND e GROUP BY 1, 2, 3),
        f AS (SELECT run, min(o) AS first FROM r GROUP BY run),
        g AS (SELECT DISTINCT l.o, l.i FROM r JOIN f ON f.run = r.run AND r.o > first JOIN l ON l.o = r.o AND l.i BETWEEN s AND e),
        x AS (
          SELECT l.o, count(*) AS n_lines, count(g.i) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
          FROM l LEFT JOIN g ON g.o = l.o AND g.i = l.i GROUP BY l.o)
        SELECT p.doc_id, n_lines, n_removed, kept_sha256
        FROM documents p JOIN k ON k.doc_id IS NOT DISTINCT FROM p.doc_id AND k.t = coalesce(p.text, '') JOIN x ON x.o = k.o
    """,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
}
