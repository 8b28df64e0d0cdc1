"""Model calls behind providers, and the learning operators: splits, scaling, weights, classifiers.

Every remote model is an interface here with a deterministic offline stand-in: it keeps the flow of
data (inputs, order, nulls, schema), not the scores. A provider is created once per Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.json import embedded_object, field, summary_fault
from siltstone.functions.numbers import cost
from siltstone.functions.text import token_count


_BLANK = " \t\n\r\v\f"
_TOKEN = re.compile(r"[^ \t\n\r\v\f]+")

# Replies without a model call, and the answer that the prompt asks for.
NO_CONTEXT = "I don't know. I could not find relevant context in the knowledge base."
NOT_ASKED = "I don't know. I could not find this query in the reranked results file."
NOT_IN_CONTEXT = "I don't know based on the provided context."


def with_retry(call: Callable[[], object], tries: int = 5, pause: Callable[[int], float] = lambda n: min(2.0**n, 30.0), sleep: Callable[[float], None] = time.sleep) -> object:
    """Runs ``call`` up to ``tries`` times with growing pauses; the last error is raised."""
    for attempt in range(1, tries + 1):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if attempt == tries:
                raise
            sleep(pause(attempt))
    raise AssertionError


@dataclass(frozen=True)
class HashedEmbedder:
    """Signed hashed bag of words, unit length; a blank text has no vector."""

    dims: int = 64

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            v = np.zeros(self.dims)
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).astype(np.float32).tolist() if n else None)
        return out


def _words(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _covered(asked: str | None, text: str | None) -> float:
    """Share of the different words of ``asked`` that ``text`` has, 0 if it has none."""
    q = set(_words(asked))
    return len(q & set(_words(text))) / len(q) if q else 0.0


def _grade(share: float) -> int:
    """1 to 5."""
    return 1 + int(4 * share + 0.5)


@dataclass(frozen=True)
class OverlapJudge:
    """Judges a context by shared words; yes, partial or no by how much of the query the context has."""

    def judge(self, query: str, context: str) -> dict:
        share = _covered(query, context)
        label = "yes" if share >= 0.6 else "partial" if share >= 0.3 else "no"
        known = set(_words(context))
        missing = sorted(w for w in set(_words(query)) if w not in known)
        return {
            "answerability": label, "context_relevance_score": _grade(share), "context_completeness_score": _grade(share), "context_coherence_score": 5 if context else 1, "noise_score": _grade(1 - share),
            "missing_information": " ".join(missing), "failure_type": "none" if label == "yes" else "insufficient_detail" if label == "partial" else "retrieval_miss",
            "reason": f"{len(set(_words(query))) - len(missing)} of {len(set(_words(query)))} words found", "prompt_tokens": len(_words(query)) + len(_words(context)), "completion_tokens": 8,
        }


@dataclass(frozen=True)
class OverlapAnswerJudge:
    """Judges an answer: does it keep to the context (groundedness), and does it use the query's words?"""

    model: str = "offline-overlap"

    def judge(self, query: str, answer: str, context: str) -> dict:
        grounded, asked, shown = _covered(answer, context), _covered(query, answer), _covered(query, context)
        label = "yes" if asked >= 0.4 else "partial" if asked >= 0.2 else "no"
        return {
            "answerability": label, "answerability_score": _grade(asked), "groundedness_score": _grade(grounded), "completeness_score": _grade(asked), "context_relevance_score": _grade(shown), "context_completeness_score": _grade(shown),
            "failure_type": "none" if label == "yes" else "incomplete_answer" if label == "partial" else "unanswerable", "reason": "", "prompt_tokens": sum(len(_words(t)) for t in (query, answer, context)), "completion_tokens": 10,
        }


@dataclass(frozen=True)
class FirstSentenceAnswerer:
    """Answers with the first sentence of the context and its source, if the context has a word of the question."""

    def answer(self, question: str, context: str) -> str:
        if not _covered(question, context):
            return NOT_IN_CONTEXT
        return (context or "").split(". ")[0].strip(_BLANK) + " [Source 1]"


@dataclass(frozen=True)
class ExtractiveSummarizer:
    """First sentences as a structured summary; texts with few sentences give a faulty reply, as models do."""

    def reply(self, text: str, repair: bool = False) -> str:
        s = [y for x in (text or "").replace("\n", " ").split(". ") if (y := x.strip(_BLANK))]
        if repair and s:
            s = (s * 3)[: max(3, len(s))]
        body = {"summary": s[0] if s else "", "key_points": s[:5], "sentiment": "neutral", "entities": [w for w in _TOKEN.findall(s[0] if s else "") if w[:1].isupper()][:5], "why_it_matters": s[-1] if s else ""}
        return "Reply: " + json.dumps(body, ensure_ascii=False)


@dataclass(frozen=True)
class ScoreJudge:
    """Names the candidate with the greatest score as JSON; where all are missing its reply is no JSON."""

    def compare(self, scores: dict[str, float | None]) -> str:
        known = {n: v for n, v in scores.items() if v is not None}
        if not known:
            return "I cannot decide."
        best = max(known.values())
        winner = [n for n in scores if known.get(n) == best]
        return "Verdict: " + json.dumps({"winner": winner[0] if len(winner) == 1 else "tie", "margin": round(best - min(known.values()), 2)})


def embedded(df: DataFrame, text: str, out: str = "embedding", provider: HashedEmbedder = HashedEmbedder(), batch: int = 64) -> DataFrame:  # noqa: B008
    """``df`` with a vector per text, asked in batches with retry. Null and blank texts get null."""

    @F.pandas_udf("array<float>")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            rows: list = []
            for i in range(0, len(texts), batch):
                rows += with_retry(lambda i=i: provider.embed(texts[i : i + batch]))
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, call(F.col(text)))


def embed_query(text: str, provider: HashedEmbedder = HashedEmbedder()) -> tuple[list[float] | None, float]:  # noqa: B008
    """(vector, milliseconds) of one query."""
    began = time.perf_counter()
    vector = with_retry(lambda: provider.embed([text]))[0]
    return vector, 1000 * (time.perf_counter() - began)


def _calls(schema: str, call: Callable[..., dict], failed: dict, tries: int):
    """A pandas UDF of struct ``schema`` that runs ``call`` on each row of its text columns, with ``tries`` tries.

    A row whose call fails for good becomes ``failed`` with the error as its reason; it stops nothing.
    ``latency_ms``, where the schema has it, is the time of the call that succeeded.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(*columns: pd.Series) -> pd.DataFrame:
        rows = []
        for texts in zip(*[c.fillna("") for c in columns], strict=True):
            began = [0.0]

            def once(texts=texts, began=began) -> dict:
                began[0] = time.perf_counter()
                return call(*texts)

            try:
                row = with_retry(once, tries, lambda n: 2.0 * n)
                row = row | {"latency_ms": 1000 * (time.perf_counter() - began[0])}
            except Exception as fault:  # noqa: BLE001
                row = failed | {"reason": f"Judge failed after retries: {fault!r}"}
            rows.append(row)
        out = pd.DataFrame(rows, columns=names)
        for field in schema.split(", "):
            name, kind = field.split()
            out[name] = out[name].astype({"int": "Int32", "double": "Float64", "string": object}[kind])
        return out

    return run


_JUDGMENT = "answerability string, context_relevance_score int, context_completeness_score int, context_coherence_score int, noise_score int, missing_information string, failure_type string, reason string, prompt_tokens int, completion_tokens int"
_ANSWER_JUDGMENT = "answerability string, answerability_score int, groundedness_score int, completeness_score int, context_relevance_score int, context_completeness_score int, failure_type string, reason string, prompt_tokens int, completion_tokens int, latency_ms double"


def judged(df: DataFrame, query: str, context: str, provider: OverlapJudge = OverlapJudge(), tries: int = 4) -> DataFrame:  # noqa: B008
    """``df`` with a judgment struct; a failed call is a row with ``error``, not an exception. Nulls are empty texts."""
    call = _calls(_JUDGMENT, provider.judge, {"answerability": "error", "failure_type": "error", "missing_information": ""}, tries)
    return df.withColumn("judgment", call(F.col(query), F.col(context)))


def answers_judged(df: DataFrame, query: str, answer: str, context: str, provider: OverlapAnswerJudge = OverlapAnswerJudge(), per_million_in: float = 0.40, per_million_out: float = 1.60, tries: int = 4) -> DataFrame:  # noqa: B008
    """``df`` with a judgment struct of each answer, and model, total_tokens and cost_usd; of a failed call these are null."""
    call = _calls(_ANSWER_JUDGMENT, provider.judge, {"answerability": "error", "failure_type": "error"}, tries)
    out = df.withColumn("judgment", call(F.col(query), F.col(answer), F.col(context)))
    used = F.col("judgment.prompt_tokens"), F.col("judgment.completion_tokens")
    return out.withColumns({"model": F.lit(provider.model), "total_tokens": used[0] + used[1], "cost_usd": cost(*used, per_million_in, per_million_out)})


def answered(df: DataFrame, question: str, context: str, sources: str, found: str, provider: FirstSentenceAnswerer = FirstSentenceAnswerer()) -> DataFrame:  # noqa: B008
    """``df`` with ``answer``: the model's where there are ``sources`` (an array), else a fixed reply.

    ``found`` says whether the query is among those that were searched for. The model sees only rows
    that have sources: the others are parted off before the call.
    """
    call = F.pandas_udf(lambda q, c: pd.Series([with_retry(lambda a=a, b=b: provider.answer(a, b)) for a, b in zip(q.fillna(""), c.fillna(""), strict=True)], dtype=object), "string")
    has = F.coalesce(F.size(sources) > 0, F.lit(False)) & F.coalesce(F.col(found), F.lit(False))
    asked = df.where(has).withColumn("answer", call(F.col(question), F.col(context)))
    canned = F.when(F.coalesce(F.col(found), F.lit(False)), NO_CONTEXT).otherwise(NOT_ASKED)
    return asked.unionByName(df.where(~has).withColumn("answer", canned))


def candidates_judged(df: DataFrame, scores: dict[str, str], provider: ScoreJudge = ScoreJudge()) -> DataFrame:  # noqa: B008
    """``df`` with judge_raw_response, judge_success, judge_error, winner and margin for two or more candidates.

    ``scores``: candidate -> column. A reply that is no JSON object is a row with an error; other rows go on.
    """
    names = list(scores)

    @F.pandas_udf("string")
    def call(*columns: pd.Series) -> pd.Series:
        return pd.Series([with_retry(lambda r=r: provider.compare({n: None if pd.isna(v) else float(v) for n, v in zip(names, r, strict=True)})) for r in zip(*columns, strict=True)], dtype=object)

    raw = df.withColumn("judge_raw_response", call(*[F.col(c).cast("double") for c in scores.values()]))
    body = embedded_object(F.col("judge_raw_response"))
    ok = body.isNotNull() & F.try_parse_json(body).isNotNull()
    return raw.withColumns({"judge_success": ok, "judge_error": F.when(~ok, "No JSON object found in model output."), "winner": F.when(ok, field(body, "winner")), "margin": F.when(ok, field(body, "margin").cast("double"))})


def merged_metrics(first: DataFrame, repair: DataFrame, key: str) -> DataFrame:
    """Metrics (key, batch_time_sec, input_tokens, output_tokens) of a first and a repair pass as one row per batch.

    Missing values count as 0; tokens_per_sec is null without time; repair_used says whether there was a repair pass.
    """
    names = ("batch_time_sec", "input_tokens", "output_tokens")
    own = {"batch_time_sec": "time_sec", "input_tokens": "input_tokens", "output_tokens": "output_tokens"}
    again = repair.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_used"))
    both = first.join(again, first[key] == again["_k"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = {c: zero(c) + zero(f"_{c}") for c in names}
    tokens = total["input_tokens"] + total["output_tokens"]
    return both.select(
        key, *[zero(c).alias(f"first_pass_{own[c]}") for c in names], *[zero(f"_{c}").alias(f"repair_{own[c]}") for c in names], total["batch_time_sec"].alias("total_generation_time_sec"),
        total["input_tokens"].alias("total_input_tokens"), total["output_tokens"].alias("total_output_tokens"), tokens.alias("total_tokens"),
        F.when(total["batch_time_sec"] > 0, tokens / total["batch_time_sec"]).alias("tokens_per_sec"), F.coalesce("_used", F.lit(False)).alias("repair_used"),
    )


def summarized(df: DataFrame, key: str, text: str, provider: ExtractiveSummarizer = ExtractiveSummarizer()) -> DataFrame:  # noqa: B008
    """(key, success, repair_used, error, reply, input_tokens, output_tokens, seconds): asked once, a second time only where the reply is faulty.

    Both calls are made in one pass over the texts; tokens and seconds are those of both.
    """

    @F.pandas_udf("raw string, seconds double")
    def ask(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s.fillna(""):
            began = time.perf_counter()
            rows.append((with_retry(lambda x=x: provider.reply(x, False)), time.perf_counter() - began))
        return pd.DataFrame(rows, columns=["raw", "seconds"])

    @F.pandas_udf("raw string, seconds double")
    def again(s: pd.Series, needed: pd.Series) -> pd.DataFrame:
        rows = []
        for x, n in zip(s.fillna(""), needed, strict=True):
            began = time.perf_counter()
            rows.append((with_retry(lambda x=x: provider.reply(x, True)), time.perf_counter() - began) if n else (None, 0.0))
        return pd.DataFrame(rows, columns=["raw", "seconds"])

    first = df.select(key, text, ask(F.col(text)).alias("_a"))
    first = first.withColumn("_first", embedded_object(F.col("_a.raw"))).withColumn("_fault", summary_fault(F.col("_first")))
    faulty = F.col("_fault") != "valid"
    second = first.withColumn("_b", again(F.col(text), faulty)).withColumn("_second", embedded_object(F.col("_b.raw"))).withColumn("_more", summary_fault(F.col("_second")))
    ok = ~faulty | (F.col("_more") == "valid")
    asked, said = token_count(F.col(text)), token_count(F.col("_a.raw"))
    return second.select(
        key, ok.alias("success"), faulty.alias("repair_used"), F.when(~ok, F.col("_more")).alias("error"), F.when(~faulty, F.col("_first")).when(ok, F.col("_second")).alias("reply"),
        F.when(faulty, 2 * asked).otherwise(asked).alias("input_tokens"), (said + F.when(faulty, token_count(F.col("_b.raw"))).otherwise(0)).alias("output_tokens"), (F.col("_a.seconds") + F.col("_b.seconds")).alias("seconds"),
    )


def split_of(key: Column, parts: dict[str, int]) -> Column:
    """A split by a hash of the key: the same for any partitioning. ``parts`` are percentages."""
    at = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    out, edge = None, 0
    for name, share in parts.items():
        edge += share
        out = F.when(at < edge, name) if out is None else out.when(at < edge, name)
    return out


def standardized(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """(x - mean) / population deviation, fitted on the rows of ``fit_on``; a constant column becomes 0."""
    base = df.where(fit_on) if fit_on is not None else df
    stats = base.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.lit(stats[f"m_{c}"]), F.lit(stats[f"s_{c}"])), F.lit(0.0))
    return df.select(*[c for c in df.columns if c not in columns], *[scaled(c).alias(c) for c in columns])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, rows, weight) with weight n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total, classes = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    return counts.select(label, "rows", F.round(F.lit(total) / (F.lit(classes) * F.col("rows")), 6).alias("weight"))


def fitted(train: DataFrame, features: list[str], label: str, hidden: list[int] | None = None, penalty: float = 0.001):
    """A pipeline fitted on ``train``: logistic regression weighted by class, or a perceptron with ``hidden`` layers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    weights = class_weights(train, label).select(F.col(label).alias("_l"), "weight")
    ready = train.join(F.broadcast(weights), train[label] == weights["_l"]).drop("_l")  # one row per class
    if hidden is None:
        model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="weight", maxIter=30, regParam=penalty)
    else:
        model = MultilayerPerceptronClassifier(featuresCol="_x", labelCol=label, layers=[len(features), *hidden, 2], maxIter=30, seed=5)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model]).fit(ready)


def logistic_scores(df: DataFrame, key: str, features: list[str], label: str, hidden: list[int] | None = None, store: str | None = None) -> DataFrame:
    """(key, label, prob) by a weighted logistic regression, or by a perceptron with ``hidden`` layers.

    With ``store`` the fitted pipeline is written there and the scores come from the pipeline read again.
    """
    model = fitted(df, features, label, hidden)
    if store:
        from pyspark.ml import PipelineModel

        model.write().overwrite().save(store)
        model = PipelineModel.load(store)
    return model.transform(df).select(key, label, F.round(_probability(), 6).alias("prob"))


def sweep(df: DataFrame, key: str, features: list[str], label: str, widths: list[list[int]], penalties: list[float], fit_on: Column) -> DataFrame:
    """(model, setting, loss, accuracy) on the rows outside ``fit_on`` for each width of a perceptron and each L2 penalty of a regression."""
    train, test = df.where(fit_on), df.where(~fit_on)
    parts = None
    for name, setting, hidden, penalty in [*[("perceptron", "-".join(map(str, w)), w, 0.0) for w in widths], *[("regression", str(p), None, p) for p in penalties]]:
        scored = fitted(train, features, label, hidden, penalty).transform(test.withColumn("weight", F.lit(1.0)))
        p = F.least(F.greatest(_probability(), F.lit(1e-9)), F.lit(1 - 1e-9))
        loss = F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))
        one = scored.agg(F.lit(name).alias("model"), F.lit(setting).alias("setting"), F.round(loss, 6).alias("loss"), F.round(F.avg(((p >= 0.5).cast("int") == F.col(label)).cast("int")), 6).alias("accuracy"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def _probability() -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array("probability")[1]


def early_stopping(df: DataFrame, run: str, epoch: str, loss: str, patience: int = 10) -> DataFrame:
    """(run, best_epoch, best_loss, stopped_at): the running best, stopped ``patience`` epochs after its last gain.

    The running minimum is made over buckets of epochs, so one long run is not one task.
    """
    from siltstone.plans.ranks import running

    best = running(df, run, epoch, {"_best": ("min", F.col(loss), False)})
    gain = F.col("_best").isNull() | (F.col(loss) < F.col("_best"))
    at = running(best.withColumn("_gain", F.when(gain, F.col(epoch))), run, epoch, {"_at": ("max", F.col("_gain"), True)})
    stop = at.groupBy(F.col(run).alias("_r")).agg(F.min(F.when(F.col(epoch) - F.col("_at") >= patience, F.col(epoch))).alias("_stop"), F.max(epoch).alias("_last"))
    kept = at.join(stop, at[run] == stop["_r"]).where(F.col(epoch) <= F.coalesce("_stop", "_last"))
    return kept.groupBy(run).agg(F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.min(loss).alias("best_loss"), F.max(epoch).alias("stopped_at"))


def masked_labels(prompt: Column, response: Column, length: int, ignore: int = -100) -> Column:
    """Token ids for training on responses only: prompt and padding masked, cut at ``length``."""
    whole = F.slice(F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), response), 1, length)
    return F.concat(whole, F.array_repeat(F.lit(ignore), F.greatest(F.lit(0), length - F.size(whole))))
