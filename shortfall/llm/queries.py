"""The registered queries of this package, with DuckDB SQL where SQL can say them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortfall.llm import (
    alignment,
    dedup,
    fertility,
    grid_codes,
    html_paths,
    lang_filters,
    mixing,
    packing,
    quality_gam,
    sharding,
    simhash,
    token_cache,
    windows,
)
from shortfall.sources.workspace import scratch_path

SHARDS = 16

Plan = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold(count: int) -> Column:
    """Remainder of the checksum of the document's number as text."""
    return F.crc32(F.col("doc_id").cast("string")) % count


def vocabulary(name: str) -> str:
    from public_tokenizers import path

    return path(name)


def op1_pack_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.refine(table(spark, folder, "documents"))


def op3_shard_tree(spark: SparkSession, folder: str) -> DataFrame:
    tree = sharding.planned_tree(SHARDS)
    return sharding.assign(table(spark, folder, "documents"), tree, sharding.grown_tree(tree))


def op4_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality_gam.score(docs, quality_gam.fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality_gam.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_fertility_rules(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return fertility.quality_rules(
        table(spark, folder, "documents"),
        vocabulary("byte_bpe_multi_50k.tiktoken"),
        PATTERN,
        vocabulary("piece_bpe_32k.model"),
    )


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_cache.count_tokens(
        table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), scratch_path(spark, "token-cache")
    )


def op8_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_paths.extract(table(spark, folder, "pages"))


def language_filters(docs: DataFrame, bars: bool = True) -> lang_filters.Filters:
    return lang_filters.fit(docs.where(fold(4) != 2).select("doc_id", "text", "lang"), bars=bars)


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = lang_filters.predict(docs, language_filters(docs, bars=False))
    return found.select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage"
    )


def op10_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_groups(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_align_tokens(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    report = alignment.link_report(
        table(spark, folder, "documents"),
        vocabulary("byte_bpe_50k.json"),
        vocabulary("piece_bpe_32k.model"),
        groups=digest,
    )
    return report.withColumnRenamed("groups", "groups_sha256")


def op12_pack_online(spark: SparkSession, folder: str) -> DataFrame:
    packed = windows.pack_windows(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op13_grid_codes(spark: SparkSession, folder: str) -> DataFrame:
    found = grid_codes.compress(table(spark, folder, "embeddings"))
    entries = ",".join(map(str, found.codebooks.ravel().tolist()))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return found.frame.select(
        "vec_id",
        code.alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(entries.encode()).hexdigest()).alias("codebooks_sha256"),
    )


QUERIES: dict[str, Plan] = {
    plan.__name__: plan
    for plan in (
        op1_pack_best_fit,
        op2_exact_dedup,
        op3_shard_tree,
        op4_quality_gam,
        op5_fertility_rules,
        op6_mix_sources,
        op7_token_counts,
        op8_page_text,
        op9_language_id,
        op10_simhash_groups,
        op11_align_tokens,
        op12_pack_online,
        op13_grid_codes,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), best AS (
            SELECT text_sha256, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id, count(*) AS group_size
            FROM hashed GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM hashed JOIN best USING (text_sha256)
    """,
    "op6_mix_sources": r"""
        WITH rows AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS h
            FROM documents
        ), ranked AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS full_size,
                   CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
            FROM rows GROUP BY source
        ), levels AS (
            SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(full_size) OVER before, 0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM ranked
            WINDOW before AS (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), goals AS (
            SELECT source, source_size,
                   CAST(least(full_size, weight * coalesce((SELECT level FROM levels WHERE level * weight <= full_size
                        ORDER BY full_size / weight, level LIMIT 1), 1e300)) AS DOUBLE) AS target
            FROM levels
        ), ordered AS (
            SELECT rows.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds,
                   CAST(sum(size) OVER (PARTITION BY rows.source ORDER BY h) AS DOUBLE) AS upto,
                   CAST(sum(size) OVER (PARTITION BY rows.source, h) AS DOUBLE) AS here
            FROM rows JOIN goals ON rows.source IS NOT DISTINCT FROM goals.source
        )
        SELECT doc_id, source, size, source_size, target,
               CAST(size * (rounds + CASE
                   WHEN upto <= target - rounds * source_size THEN 1
                   WHEN upto - here <= target - rounds * source_size AND h = first_over
                        AND upto - (target - rounds * source_size) < (target - rounds * source_size) - (upto - here) THEN 1
                   ELSE 0 END) AS BIGINT) AS taken
        FROM (SELECT *, min(CASE WHEN upto > target - rounds * source_size THEN h END) OVER (PARTITION BY source) AS first_over FROM ordered)
    """,
}
