"""The corpus operators as named queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import (
    decontaminate,
    html_text,
    language,
    line_dedup,
    mixing,
    neighbours,
    phrases,
    pii,
    quality,
    search,
    secrets,
    sharding,
    simhash,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    return quality.quality_of_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_secret_scan(spark, sf_dir):
    return secrets.secrets_of_documents(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark, sf_dir):
    return pii.personal_data_of_documents(_table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return language.language_of_documents(_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op6_html_extraction(spark, sf_dir):
    return html_text.text_of_pages(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.line_duplicates_of_documents(_table(spark, sf_dir, "documents"))


def op8_mix_sources(spark, sf_dir):
    mix = mixing.pareto_mix(_table(spark, sf_dir, "documents"), importance=mixing.by_length())
    first = ["doc_id", "size", "source_size", "target", "taken"]
    return mix.select(*first, *(c for c in mix.columns if c not in first))


def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_classes(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_phrase_mining(spark, sf_dir):
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    return search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_hilbert_sharding(spark, sf_dir):
    return sharding.shards_of_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_secret_scan,
        op3_personal_data,
        op4_language_id,
        op5_nearest_neighbours,
        op6_html_extraction,
        op7_line_dedup,
        op8_mix_sources,
        op9_simhash_near_dedup,
        op10_benchmark_decontamination,
        op11_phrase_mining,
        op12_ranked_search,
        op13_hilbert_sharding,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {
    "op10_benchmark_decontamination": r"""
    WITH w AS (SELECT row_number() OVER () rid, doc_id,
                      coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) ws FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM benchmark),
    iw AS (SELECT DISTINCT item_id, least(10, len(ws)) n, array_to_string(ws[k:k + 9], ' ') g
           FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) k FROM i WHERE len(ws) > 0)),
    lens AS (SELECT DISTINCT n FROM iw),
    dw AS (SELECT rid, n, k, array_to_string(ws[k:k + n - 1], ' ') g
           FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) k FROM w, lens WHERE len(ws) >= n)),
    h AS (SELECT rid, dw.n, k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
    c AS (SELECT rid, count(DISTINCT p) n_hit FROM (SELECT rid, unnest(range(k, k + n)) p FROM h) GROUP BY rid),
    t AS (SELECT rid, count(*) n_items, string_agg(s, ',' ORDER BY s) names
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) s FROM h) GROUP BY rid)
    SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(names, '')) items_sha256,
           coalesce(n_hit, 0) > 0 contaminated
    FROM w LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)""",
}

ORACLE_SQL["op11_phrase_mining"] = phrases.SQL
ORACLE_SQL["op12_ranked_search"] = search.SQL
ORACLE_SQL["op13_hilbert_sharding"] = sharding.SQL
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
