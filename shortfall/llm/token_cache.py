"""Token counts from a digest cache.

The cache is a table of (content digest, count), one folder per tokenizer version, itself the digest of
the vocabulary file. A run digests every text, finds the distinct digests that the cache lacks, encodes
one text for each and appends the counts; then all rows read their count from the cache. What is
shuffled is one narrow row per document and the texts once, to meet the rows chosen to be encoded.

Defined results: null is the empty text and has no tokens; rows with a null doc_id are counted like any
other; repeated rows are returned each; an empty table gives an empty result and leaves the cache alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.llm.common import by_value, light_slices, stored, text_or_empty

by_value(__name__)

LIMIT = 4096
CACHE_COLUMNS = "digest binary, n_tokens bigint, tokenizer string"


def vocabulary_digest(model: str) -> str:
    with open(model, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:32]


def token_counter(model: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts with the library that a vocabulary file is for."""
    if model.endswith(".json"):
        from tokenizers import Tokenizer

        fast = Tokenizer.from_file(model)
        fast.no_truncation()
        fast.no_padding()
        return lambda texts: [len(e.ids) for e in fast.encode_batch(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=model)
    return lambda texts: [len(pieces.encode(text)) for text in texts]


def cached_counts(spark, cache: str, version: str) -> DataFrame:
    """digest, n_tokens stored for a tokenizer version; two runs may have stored the same digest."""
    try:
        table = spark.read.schema(CACHE_COLUMNS).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], CACHE_COLUMNS)
    return table.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, model: str, cache: str, doc: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. `model` is a path that each worker has."""
    spark = docs.sparkSession
    version = vocabulary_digest(model)
    body = text_or_empty(text)
    digest = F.unhex(F.sha2(body, 256))
    rows = stored(
        docs.select(
            F.col(doc).alias("doc_id"), F.octet_length(body).cast("bigint").alias("n_bytes"), digest.alias("digest")
        ),
        "token-rows",
    )
    chosen = F.coalesce(F.col(doc), F.lit(-(2**63)))  # one row stands for a digest
    misses = (
        rows.groupBy("digest")
        .agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("stands"))
        .join(cached_counts(spark, cache, version), "digest", "left_anti")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, done = token_counter(model), set()  # rows of a digest are shuffled to one task
        for part in light_slices(batches, "body"):
            digests = part.column("digest").to_pylist()
            new = [i for i, d in enumerate(digests) if not (d in done or done.add(d))]
            bodies = part.column("body").take(pa.array(new, pa.int64())).to_pylist()
            counts = count(bodies) if bodies else []
            found = [pa.array([digests[i] for i in new], pa.binary()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(found, ["digest", "n_tokens"])

    counted = (
        docs.select(body.alias("body"), digest.alias("digest"), chosen.alias("stands"))
        .join(misses.hint("shuffle_hash"), ["digest", "stands"])
        .select("body", "digest")
        .mapInArrow(encode, "digest binary, n_tokens bigint")
    )
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # One stored row per digest at hand, so that the join below is free to split the rows of a hot text.
    known = stored(
        rows.select("digest").distinct().join(cached_counts(spark, cache, version), "digest"), "token-counts"
    )
    return rows.join(known, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
