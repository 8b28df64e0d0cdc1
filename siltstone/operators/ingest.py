"""Ingestion as one writing run: documents filtered, chunked, embedded and written as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import models as M

STRATEGIES = ("section_aware_v2", "fixed_overlap")


def accepted(docs: DataFrame, title: str, text: str) -> DataFrame:
    """Documents with a title and at least ``MIN_TEXT_CHARS`` characters, both without white space at their ends."""
    own = docs.withColumns({title: T.strip(F.col(title)), text: T.strip(F.col(text))})
    return own.where((F.length(title) > 0) & (F.length(text) >= T.MIN_TEXT_CHARS))


def chunked(docs: DataFrame, key: str, title: str, text: str, strategy: str) -> DataFrame:
    """(key, chunk_index, content, token_count, embedding_text, more): chunks of either strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if strategy == "section_aware_v2":
        return C.section_chunks(docs, key, title, text)
    made = C.with_ids(C.fixed_windows(docs, key, text), key)
    return made.withColumn("embedding_text", F.col("content"))


def ingest(docs: DataFrame, path: str, key: str = "doc_id", title: str = "title", text: str = "text", url: str = "url", strategy: str = "section_aware_v2", dataset: str = "corpus", provider: M.HashedEmbedder = M.HashedEmbedder(), embed_batch: int = 64) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Writes ``path``/documents and ``path``/chunks and gives both tables as they were written.

    documents: id, title, source_url, metadata (JSON: source, article_id, article_hash, text_chars,
    chunk_count, chunking_strategy), created_at. chunks: id, document_id, chunk_index, content,
    token_count, metadata (JSON), embedding; partitioned by strategy. Ids are hashes, so a run that is
    repeated after a failure gives equal rows. Documents without chunks, titles or enough text are
    left out. Chunks are embedded ``embed_batch`` at a time, with retry.
    """
    spark = docs.sparkSession
    base = accepted(docs.select(key, title, text, url), title, text)
    hash_ = F.sha2(text, 256)
    named = lambda k, h: T.stable_id(F.lit(strategy), F.col(k).cast("string"), h)
    chunks = chunked(base, key, title, text, strategy)
    about = [F.lit("wikipedia").alias("source"), F.lit(dataset).alias("dataset"), *[F.col(c) for c in chunks.columns if c not in (key, "content", "embedding_text", "token_count")], F.lit(strategy).alias("chunking_strategy")]
    ids = base.select(F.col(key).alias("_k"), named(key, hash_).alias("document_id"))
    rows = chunks.join(ids, chunks[key] == ids["_k"]).withColumn("metadata", F.to_json(F.struct(*about)))
    rows = M.embedded(rows, "embedding_text", provider=provider, batch=embed_batch)
    rows = rows.select(F.col("chunk_id").alias("id"), "document_id", "chunk_index", "content", "token_count", "metadata", "embedding", F.lit(strategy).alias("chunking_strategy"))
    rows.write.mode("append").partitionBy("chunking_strategy").parquet(f"{path}/chunks")
    written = spark.read.parquet(f"{path}/chunks").where(F.col("chunking_strategy") == strategy)
    counts = written.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    facts = base.select(named(key, hash_).alias("id"), title, F.col(url).alias("source_url"), F.struct(F.lit("wikipedia").alias("source"), F.lit(dataset).alias("dataset"), F.col(key).alias("article_id"), hash_.alias("article_hash"), F.length(text).alias("text_chars")).alias("m"))
    documents = facts.join(counts, facts["id"] == counts["document_id"]).select(
        "id", F.col(title).alias("title"), "source_url",
        F.to_json(F.struct("m.*", "chunk_count", F.lit(strategy).alias("chunking_strategy"), F.lit(T.MAX_TOKENS).alias("max_tokens_per_chunk"), F.lit(T.OVERLAP if strategy == "fixed_overlap" else 0).alias("chunk_overlap"))).alias("metadata"),
        F.current_timestamp().alias("created_at"), F.lit(strategy).alias("chunking_strategy"),
    )
    documents.write.mode("append").partitionBy("chunking_strategy").parquet(f"{path}/documents")
    return spark.read.parquet(f"{path}/documents").where(F.col("chunking_strategy") == strategy), written


def preview(docs: DataFrame, key: str, title: str, text: str, strategy: str = "section_aware_v2", documents: int = 1, chunks: int = 5) -> DataFrame:
    """The first ``chunks`` chunks of the first ``documents`` documents: nothing is embedded or written."""
    head = docs.orderBy(key).limit(documents)
    made = chunked(accepted(head.select(key, title, text), title, text), key, title, text, strategy)
    return made.where(F.col("chunk_index") < chunks).select(key, "chunk_index", "token_count", T.preview(F.col("content"), 200).alias("preview"))
