"""Merging rankings with provenance, neighbour expansion, routing, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import word_list


def merge(semantic: DataFrame, lexical: DataFrame, query_key: str, key: str, fields: list[str] | None = None) -> DataFrame:
    """All semantic rows in semantic order, then those only lexical in lexical order.

    Inputs: (query_key, key, rank, score) and the columns ``fields``. Columns: query_key, key,
    semantic_rank, lexical_rank, semantic_score, lexical_score, fields, provenance (semantic, lexical,
    both), candidate_rank. Each field is the semantic row's, or the lexical row's where that is null.
    Repeated keys in one list are merged first, at their best rank.
    """
    fields = fields or []

    def once(df: DataFrame, name: str) -> DataFrame:
        first = [F.min_by(F.struct(*fields), "rank").alias(f"_{name}")] if fields else []
        return df.groupBy(query_key, key).agg(F.min("rank").alias(f"{name}_rank"), F.max("score").alias(f"{name}_score"), *first)

    both = once(semantic, "semantic").join(once(lexical, "lexical"), [query_key, key], "full_outer")
    s, x = F.col("semantic_rank"), F.col("lexical_rank")
    provenance = F.when(s.isNotNull() & x.isNotNull(), "both").when(s.isNotNull(), "semantic").otherwise("lexical")
    w = Window.partitionBy(query_key).orderBy(s.asc_nulls_last(), x.asc_nulls_last(), key)
    filled = [F.coalesce(f"_semantic.{c}", f"_lexical.{c}").alias(c) for c in fields]
    both = both.select(query_key, key, s, x, "semantic_score", "lexical_score", *filled)
    return both.withColumn("provenance", provenance).withColumn("candidate_rank", F.row_number().over(w))


def merge_summary(merged: DataFrame, query_key: str) -> DataFrame:
    per = merged.groupBy(query_key).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("provenance") == "both").alias("o"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("c"), 6).alias("avg_candidates"), F.min("c").alias("min_candidates"), F.max("c").alias("max_candidates"), F.round(F.avg("o"), 6).alias("avg_overlap"))


def attribution(merged: DataFrame, query_key: str, k: int) -> DataFrame:
    """Per query, how many of the first ``k`` come from where."""
    head = merged.where(F.col("candidate_rank") <= k).groupBy(query_key)
    return head.agg(*[F.count_if(F.col("provenance") == p).alias(name) for p, name in (("semantic", "semantic_only"), ("lexical", "lexical_only"), ("both", "both_sources"))])


def neighbours(seeds: DataFrame, chunks: DataFrame, query_key: str, window: int = 1, same_section: bool = False) -> DataFrame:
    """Each seed passage with the chunks around it in its document.

    ``seeds``: (query_key, rank, document_id, chunk_index, and maybe id and content); ``chunks``:
    (document_id, chunk_index, id, section_path, content). The band join is an equi-join on exploded
    offsets. A seed met again keeps its first rank, a null index is left out. A seed without any chunk
    around it is its own passage. Columns: query_key, rank, document_id, chunk_index,
    neighbour_indexes, neighbour_ids, passage.
    """
    own = [F.col(c) if c in seeds.columns else F.lit(None).cast("string").alias(c) for c in ("id", "content")]
    known = seeds.where(F.col("chunk_index").isNotNull() & F.col("document_id").isNotNull()).select(query_key, "document_id", "chunk_index", "rank", *own)
    first = known.groupBy(query_key, "document_id", "chunk_index").agg(F.min("rank").alias("rank"), F.min_by(F.struct("id", "content"), "rank").alias("_seed"))
    around = first.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window)).alias("_i"))
    side = chunks.select(F.col("document_id").alias("_d"), F.col("chunk_index").alias("_c"), "id", "section_path", "content")
    met = around.join(side, (around["document_id"] == side["_d"]) & (around["_i"] == side["_c"]), "left")
    fits = F.col("_d").isNotNull()
    if same_section:
        home = chunks.select(F.col("document_id").alias("_sd"), F.col("chunk_index").alias("_sc"), F.col("section_path").alias("_own"))
        met = met.join(home, (met["document_id"] == home["_sd"]) & (met["chunk_index"] == home["_sc"]), "left")
        fits = fits & F.col("_sd").isNotNull() & F.col("section_path").eqNullSafe(F.col("_own"))
    headed = lambda i, section, content: F.concat(F.lit("[chunk_index="), i.cast("string"), F.lit(" section="), F.coalesce(section, F.lit("")), F.lit("]\n"), F.coalesce(content, F.lit("")))
    item = F.struct("_i", "id", headed(F.col("_i"), F.col("section_path"), F.col("content")).alias("t"))
    group = met.groupBy(query_key, "rank", "document_id", "chunk_index").agg(F.array_sort(F.collect_list(F.when(fits, item))).alias("n"), F.first("_seed").alias("_seed"))
    alone = F.array(F.struct(F.col("chunk_index").alias("_i"), F.col("_seed.id").alias("id"), headed(F.col("chunk_index"), F.lit(None), F.col("_seed.content")).alias("t")))
    n = group.withColumn("n", F.when(F.size("n") > 0, F.col("n")).otherwise(alone))
    return n.select(query_key, "rank", "document_id", "chunk_index", F.array_join(F.transform("n", lambda x: x["_i"].cast("string")), ",").alias("neighbour_indexes"), F.array_join("n.id", ",").alias("neighbour_ids"), F.array_join("n.t", "\n\n").alias("passage"))


def strategy_or_all(hits: DataFrame, query_key: str, wanted: Column) -> DataFrame:
    """Rows of the wanted strategy; where a query has none, all of its rows."""
    any_ = hits.groupBy(F.col(query_key).alias("_q")).agg(F.max(F.coalesce(wanted, F.lit(False))).alias("_any"))
    return hits.join(any_, hits[query_key] == any_["_q"]).where(F.coalesce(wanted, F.lit(False)) | ~F.col("_any")).drop("_q", "_any")


# Signals of exact-match queries, in order, and the terms that count as rare.
SIGNALS = {
    "acronym": r"\b[A-Z]{2,}\b",
    "number": r"\b[0-9]+(\.[0-9]+)?\b",
    "date": r"\b(19|20)[0-9]{2}\b",
    "quoted_phrase": "[\"“”']",
    "code_like_token": r"\b[a-zA-Z_][a-zA-Z0-9_]*\.[a-zA-Z0-9_.]+\b|\b[a-zA-Z_][a-zA-Z0-9_]*Exception\b|\b[A-Z]+_\w+\b|\b\w+@[0-9]+\b|\b[A-Za-z]+-[0-9]+\b",
}
RARE_TERMS = ["hnsw", "bm25", "pgvector", "ivfflat", "ndcg", "recall@5", "recall@10", "ndcg@10", "ef_search", "oauth", "cuda", "kubernetes", "sqs", "vacuum", "qwen2.5", "text-embedding-3-small", "gpt-4", "10-k", "iso 8601", "http 429", "401", "acid", "raid"]


def route(queries: DataFrame, text: str = "query") -> DataFrame:
    """``queries`` with matched_signals (comma-joined, in order), selected_route and routing_reason."""
    flags = [F.when(F.col(text).rlike(p), n) for n, p in SIGNALS.items()]
    flags.append(F.when(F.exists(F.array(*[F.lit(t) for t in RARE_TERMS]), lambda t: F.contains(F.lower(F.col(text)), t)), "rare_exact_term"))
    found = F.array_compact(F.array(*flags))
    out = queries.withColumn("matched_signals", F.array_join(found, ","))
    hit = F.col("matched_signals") != ""
    return out.withColumn("selected_route", F.when(hit, "hybrid").otherwise("semantic")).withColumn("routing_reason", F.when(hit, "lexical_signal_detected").otherwise("no_strong_lexical_signal"))


def routed(queries: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each branch runs on the queries routed to it; results are united by name."""
    parts = [run(queries.where(F.col("selected_route") == name)).withColumn("selected_route", F.lit(name)) for name, run in branches.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def routing_summary(routed: DataFrame) -> DataFrame:
    """One row over routed queries (selected_route, expected_route, candidates, overlap): counts, accuracy of labelled rows, averages of hybrid rows."""
    hit = F.col("selected_route")
    hybrid = lambda c: F.round(F.avg(F.when(hit == "hybrid", F.col(c))), 6).alias(f"avg_hybrid_{c}")
    return routed.agg(F.count(F.lit(1)).alias("queries"), F.count_if(hit == "hybrid").alias("hybrid"), F.count_if(hit == "semantic").alias("semantic"), F.count("expected_route").alias("labelled"), F.round(F.avg((hit == F.col("expected_route")).cast("int")), 6).alias("accuracy"), hybrid("candidates"), hybrid("overlap"))


def first_list(*lists: Column) -> Column:
    """The first of several arrays that is neither null nor empty; the last if none is."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in lists], lists[-1])


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's different words that the text has: the offline reranker's score."""
    q = F.array_distinct(word_list(query))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, word_list(text))), F.size(q)), F.lit(0.0)), 6)


def rerank(candidates: DataFrame, query_key: str, key: str, score: Column, limit: int = 20, k: int = 10) -> DataFrame:
    """The first ``limit`` candidates (by rank) scored, best ``k`` kept with original_rank and new rank.

    The limit stands before the score, so an expensive scorer sees only those rows.
    """
    head = candidates.where(F.col("rank") <= limit).withColumnRenamed("rank", "original_rank").withColumn("rerank_score", score)
    w = Window.partitionBy(query_key).orderBy(F.col("rerank_score").desc(), "original_rank", key)
    return head.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
