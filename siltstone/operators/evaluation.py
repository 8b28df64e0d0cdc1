"""Retrieval metrics, latency summaries, failure classes, judgment reports, comparison frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import numbers as N
from siltstone.functions.text import keywords


def ranking_metrics(exact: DataFrame, found: DataFrame, query_key: str, key: str, ks: list[int], capped: bool = False) -> DataFrame:
    """(query_key, k, recall, ndcg) of ``found`` against ``exact`` (both: query_key, key, rank from 1).

    Relevance of the exact item at rank r is k - r + 1. Recall is null where the exact list is
    shorter than k; with ``capped`` k becomes the length of the exact list and recall is over that.
    """
    k = F.explode(F.array(*[F.lit(i) for i in ks])).alias("k")
    size = exact.groupBy(query_key).agg(F.max("rank").alias("_size"))
    spread = exact.join(size, query_key).select(query_key, key, "rank", "_size", k)
    spread = spread.withColumn("_k", F.least("k", "_size") if capped else F.col("k")).where(F.col("rank") <= F.col("_k"))
    other = found.groupBy(query_key, key).agg(F.min("rank").alias("_rank"))
    joined = spread.join(other, [query_key, key], "left").withColumn("_in", F.col("_rank") <= F.col("_k"))
    relevance = F.col("_k") - F.col("rank") + 1
    sums = joined.groupBy(query_key, "k").agg(
        F.max("_size").alias("_size"), F.max("_k").alias("_kk"), F.count_if("_in").alias("_hits"),
        F.sum(relevance / F.log2(F.col("rank") + 1.0)).alias("_best"), F.sum(F.when(F.col("_in"), relevance / F.log2(F.col("_rank") + 1.0))).alias("_got"),
    )
    recall = F.col("_hits") / F.col("_kk") if capped else F.when(F.col("_size") >= F.col("k"), F.col("_hits") / F.col("k"))
    return sums.select(query_key, "k", F.round(recall, 6).alias("recall"), F.round(F.coalesce(F.col("_got"), F.lit(0.0)) / F.col("_best"), 6).alias("ndcg"))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Per k over the queries that have a recall: averages, least, median and 10th percentile (nearest rank)."""
    own = metrics.where(F.col("recall").isNotNull())
    return own.groupBy("k").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 6).alias("avg_recall"), F.min("recall").alias("min_recall"), F.round(F.avg("ndcg"), 6).alias("avg_ndcg"),
        F.min("ndcg").alias("min_ndcg"), F.round(F.median("ndcg"), 6).alias("median_ndcg"), N.nearest_rank("ndcg", 0.1).alias("p10_ndcg"),
    )


def latency_summary(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    v = F.col(value)
    stats = [F.count(v).alias("count"), F.round(F.avg(v), 6).alias("avg_ms"), *[F.round(N.interpolated(v, p / 100), 6).alias(f"p{p}_ms") for p in (50, 95, 99)], F.round(F.min(v), 6).alias("min_ms"), F.round(F.max(v), 6).alias("max_ms")]
    return df.groupBy(*by).agg(*stats)


def two_level(df: DataFrame, value: str, inner: str, by: str) -> DataFrame:
    """Percentiles over the medians of each ``inner`` group: latency of typical queries, not of calls."""
    per = df.groupBy(by, inner).agg(N.interpolated(F.col(value), 0.5).alias("_p"))
    return latency_summary(per, "_p", [by])


def short_latency(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The variant without count and 99th percentile; no row where there are no values."""
    out = latency_summary(df.where(F.col(value).isNotNull()), value, by).where(F.col("count") > 0)
    return out.drop("count", "p99_ms")


def latency_parts(df: DataFrame, parts: dict[str, str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Per part the 50th and 95th percentile; the totals are sums of the parts' percentiles, as the reports define them."""
    p = lambda c, q: N.interpolated(F.col(c), q)
    each = [F.round(p(c, q), 6).alias(f"{name}_p{int(100 * q)}") for name, c in parts.items() for q in (0.5, 0.95)]
    total = [F.round(sum((p(c, q) for c in list(parts.values())[1:]), p(next(iter(parts.values())), q)), 6).alias(f"total_p{int(100 * q)}") for q in (0.5, 0.95)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *each, *total)


# Topics of a query and the terms one expects in an answer to it; thresholds.
EXPECTED = {
    "hadoop": ["hadoop", "mapreduce", "hdfs"],
    "spark": ["apache spark", "spark", "cluster", "distributed"],
    "docker": ["docker", "container", "containerization"],
    "kubernetes": ["kubernetes", "container orchestration", "cluster"],
    "api": ["application programming interface", "api"],
    "cloud computing": ["cloud computing", "distributed computing", "virtual machine"],
}
LOW, GOOD = 0.30, 0.40


def any_in(terms: Column, text: Column) -> Column:
    return F.coalesce(F.exists(terms, lambda t: F.contains(text, t)), F.lit(False))


def expected_present(query: Column, text: Column) -> Column:
    """True if no topic occurs in the query or any of its expected terms is in the text."""
    q = F.lower(query)
    none: Column = F.lit(True)
    hit: Column = F.lit(False)
    for topic, terms in EXPECTED.items():
        asked = F.contains(q, F.lit(topic))
        none = none & ~asked
        for t in terms:
            hit = hit | (asked & F.contains(F.lower(text), F.lit(t)))
    return none | hit


def failure_class(query: Column, recall: Column, flat: tuple[Column, Column, Column], ann: tuple[Column, Column]) -> Column:
    """healthy, corpus_gap, semantic_ambiguity, ann_miss, minor_ranking_difference or uncertain.

    ``flat``: title and similarity of the first exact hit and the text of the first three; ``ann``:
    title and similarity of the first approximate hit. Missing recall counts as 0, similarity as 0.
    """
    terms = keywords(query)
    flat_title = any_in(terms, F.lower(F.coalesce(flat[0], F.lit(""))))
    ann_title = any_in(terms, F.lower(F.coalesce(ann[0], F.lit(""))))
    content = any_in(terms, F.lower(F.coalesce(flat[2], F.lit(""))))
    fs, hs, r = F.coalesce(flat[1], F.lit(0.0)), F.coalesce(ann[1], F.lit(0.0)), F.coalesce(recall, F.lit(0.0))
    return (
        F.when(r >= 1.0, "healthy")
        .when(~expected_present(query, F.coalesce(flat[2], F.lit(""))), "corpus_gap")
        .when((fs >= LOW) & (hs >= LOW) & ~flat_title & ~ann_title, "semantic_ambiguity")
        .when(((fs >= GOOD) | flat_title | content) & ~ann_title & (hs < fs), "ann_miss")
        .when(r >= 0.5, "minor_ranking_difference")
        .otherwise("uncertain")
    )


ANSWERABILITY = ["yes", "partial", "no", "error", "missing"]  # fixed values


def answerability(c: Column) -> Column:
    """yes, partial or no; anything else ``error``; null ``missing``."""
    x = F.lower(F.trim(c))
    return F.when(c.isNull(), "missing").when(x.isin("yes", "partial", "no"), x).otherwise("error")


def histogram(df: DataFrame, value: str, domain: list[str], name: str = "value") -> DataFrame:
    """Counts over a fixed domain with zeros, and their share in percent."""
    # One pass: a count for each value of the domain beside the total, then one row each.
    counts = df.agg(*[F.count_if(F.col(value) == d).alias(f"_{k}") for k, d in enumerate(domain)], F.count(F.lit(1)).alias("_all"))
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_{k}").alias("n")) for k, d in enumerate(domain)])).alias("r")
    return counts.select(rows, "_all").select(F.col("r.d").alias(name), F.col("r.n").alias("count"), N.percent(F.col("r.n"), F.col("_all")).alias("pct"))


def transitions(df: DataFrame, a: str, b: str, domain: list[str]) -> DataFrame:
    """The matrix of a to b, zero-filled, one row per value of a."""
    pivot = df.groupBy(F.col(a).alias("from_label")).pivot(b, domain).agg(F.count(F.lit(1)))
    rows = df.sparkSession.createDataFrame([(d,) for d in domain], "from_label string").join(pivot, "from_label", "left")
    return rows.select("from_label", *[F.coalesce(F.col(d), F.lit(0)).alias(f"to_{d}") for d in domain])


def compact_cases(context: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The 15 fields that compare a query's context judgment with its answer judgment, one row per query of either.

    ``context`` and ``answers`` have key and judgment; ``answers`` also source_titles, source_chunk_ids
    (arrays) and answer. What is missing is ``missing`` for labels, the empty text for texts, an empty
    list for lists and null for scores.
    """
    a = context.select(F.col(key), F.col("judgment").alias("_c"), F.lit(True).alias("_in_c"))
    b = answers.select(F.col(key), F.col("judgment").alias("_a"), "source_titles", "source_chunk_ids", "answer")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("source_titles", "source_chunk_ids")]
    return a.join(b, key, "full_outer").select(
        key, answerability(F.col("_c.answerability")).alias("context_answerability"), answerability(F.col("_a.answerability")).alias("answer_answerability"),
        text("_c.failure_type").alias("context_failure_type"), text("_a.failure_type").alias("answer_failure_type"),
        *[F.col(f"_c.{c}").alias(c) for c in ("context_relevance_score", "context_completeness_score")], F.col("_a.answerability_score").alias("answer_answerability_score"),
        F.col("_a.groundedness_score").alias("answer_groundedness_score"), F.col("_a.completeness_score").alias("answer_completeness_score"),
        *lists, text("answer").alias("answer"), text("_c.reason").alias("context_reason"), text("_a.reason").alias("answer_reason"),
    )


#: Cases that a comparison lists: name -> (answerability of the context, of the answer); None: any but yes.
CASES = {"A_context_partial_to_answer_yes": ("partial", "yes"), "B_context_no_to_answer_yes": ("no", "yes"), "C_context_yes_to_answer_no": ("yes", "no"), "questionable_context_not_yes_answer_yes": (None, "yes")}


def case_lists(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with ``case``: a row once for each of ``CASES`` that it belongs to."""
    fits = lambda x, y: ((F.col(a) == x) if x else (F.col(a) != "yes")) & (F.col(b) == y)
    return df.withColumn("case", F.explode(F.array_compact(F.array(*[F.when(fits(x, y), n) for n, (x, y) in CASES.items()]))))


def last_per(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row per key by ``order``; empty keys are dropped."""
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return df.where((F.col(key).isNotNull()) & (F.col(key) != "")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def suffixed(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """All columns but the keys renamed with a suffix, for frames that compare models side by side."""
    return df.select(*keys, *[F.col(c).alias(f"{c}_{suffix}") for c in df.columns if c not in keys])


def classification(df: DataFrame, label: str, predicted: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Confusion counts, precision, recall, F1, accuracy and error of 0/1 labels; ratios of nothing are 0."""
    y = F.col(label) == 1
    tp, fp, fn, tn = (F.count_if(c).alias(n) for c, n in ((y & predicted, "tp"), (~y & predicted, "fp"), (y & ~predicted, "fn"), (~y & ~predicted, "tn")))
    out = df.groupBy(*by).agg(tp, fp, fn, tn)
    p, r = N.safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), N.safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.select(*by, "tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(N.safe_ratio(2 * p * r, p + r), 6).alias("f1"), F.round(N.safe_ratio(F.col("tp") + F.col("tn"), n), 6).alias("accuracy"), F.round(N.safe_ratio(F.col("fp") + F.col("fn"), n), 6).alias("error"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks, without a window over all rows.

    Equal scores are counted first, then ranked in distributed form.
    """
    from siltstone.plans.ranks import average_ranks

    base = df.select(F.lit(0).alias("_g"), F.col(score).alias("_s"), F.col(label).alias("_y"))
    ranks = average_ranks(base, ["_g"], "_s", False, "_r").select(F.col("_s").alias("_v"), "_r")
    counts = base.groupBy("_s").agg(F.count_if(F.col("_y") == 1).alias("_p"), F.count_if(F.col("_y") != 1).alias("_n"))
    sums = counts.join(ranks, counts["_s"] == ranks["_v"]).agg(F.sum(F.col("_r") * F.col("_p")).alias("rs"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    return sums.select(F.round(F.try_divide(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")), 6).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at each distinct score, by distributed ranks of counted scores."""
    from siltstone.plans.ranks import average_ranks

    base = df.select(F.when(F.col(label) == 1, 1).otherwise(0).alias("_y"), F.col(score).alias("_s"))
    totals = base.agg(F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") == 0)).first()
    above = average_ranks(base, ["_y"], "_s", True, "_r").select("_y", "_s", (F.col("_r") + (F.col("_r_ties") - 1) / 2.0).cast("bigint").alias("_c"), F.col("_r_ties").alias("_t"))
    counts = above.groupBy("_s").agg(*[F.max(F.when(F.col("_y") == v, F.col("_t"))).alias(n) for v, n in ((1, "_tp"), (0, "_fp"))])
    place = average_ranks(counts.select(F.lit(0).alias("_g"), "_s"), ["_g"], "_s", True, "_o").select("_s", F.col("_o").cast("int").alias("i"))
    from siltstone.plans.ranks import running

    ordered = counts.join(place, "_s").withColumn("_g", F.lit(0))
    summed = running(ordered, "_g", "i", {"tp": ("sum", F.coalesce("_tp", F.lit(0)), True), "fp": ("sum", F.coalesce("_fp", F.lit(0)), True)})
    return summed.select(F.col("_s").alias("threshold"), "tp", "fp", F.round(N.safe_ratio(F.col("tp"), F.lit(totals[0])), 6).alias("tpr"), F.round(N.safe_ratio(F.col("fp"), F.lit(totals[1])), 6).alias("fpr"))


def value_summary(df: DataFrame, values: list[str]) -> DataFrame:
    """(metric, rows, avg, median, p10, p90, min, max) of several columns; nulls are skipped."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in values])).alias("s")
    return df.select(stack).select("s.*").groupBy("metric").agg(F.count("v").alias("rows"), F.round(F.avg("v"), 6).alias("avg"), F.round(F.median("v"), 6).alias("median"), N.nearest_rank("v", 0.1).alias("p10"), N.nearest_rank("v", 0.9).alias("p90"), F.min("v").alias("min"), F.max("v").alias("max"))


def run_summary(df: DataFrame, seconds: str, tokens: str, success: str, usd_per_hour: float) -> DataFrame:
    """One row: items, failures, seconds and tokens per item, rates and cost; nulls count as 0, rates of nothing are null."""
    s, t = F.sum(F.coalesce(F.col(seconds), F.lit(0.0))), F.sum(F.coalesce(F.col(tokens), F.lit(0)))
    n = F.count(F.lit(1))
    r = lambda c: F.round(c, 6)
    return df.agg(
        n.alias("items"), F.count_if(~F.col(success)).alias("failed"), r(s).alias("seconds"), t.alias("tokens"), r(F.try_divide(s, n)).alias("seconds_per_item"), r(F.try_divide(60 * n, s)).alias("items_per_minute"),
        r(F.try_divide(t, s)).alias("tokens_per_second"), r(s / 3600 * usd_per_hour).alias("usd"), r(F.try_divide(100 * s / 3600 * usd_per_hour, n)).alias("usd_per_100"),
    )
