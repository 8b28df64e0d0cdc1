"""Statistics of each text, a Gaussian mixture over them, and from it prose, list, table or junk."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import structure
from siltstone.llm.examples import EXAMPLES
from siltstone.llm.text import TOKEN
from siltstone.plans.cut import written

#: The statistics reported; those from ``running`` on enter the mixture, standardized.
COUNTS = ("tokens", "lines")
STATS = ("running", "common_words", "line_end_punctuation", "word_length", "symbol_ratio", "digit_ratio", "line_tokens", "marked_lines", "delimiters", "capitals", "odd_ratio", "size")
CLASSES = ("prose", "list", "table", "junk")
_FLOOR, _CEILING = 0.02, 1.5  # bounds of the variance of a standardized statistic in a component
#: Weight of the inspected start of a component, as a share of all rows: a kind that hardly occurs
#: stays at its examples instead of drifting to the outliers of another.
ANCHOR = 0.002


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, stats) of each text. An empty or blank text has 0 everywhere, but for the tokens that other than plain white space makes."""
    kinds = structure.char_classes(texts)
    counts = np.zeros((len(texts), len(COUNTS)), np.int32)
    stats = np.zeros((len(texts), len(STATS)), np.float64)
    for i, text in enumerate(texts):
        parts = text.split()
        lines = [x for x in text.splitlines() if x and not x.isspace()]
        counts[i] = len(TOKEN.findall(text)), len(lines)
        if not parts:
            continue
        marked = sum(structure.MARKER.match(x) is not None for x in lines)
        if marked:
            parts = [p for x in lines for p in structure.MARKER.sub("", x, count=1).split()] or parts
        flags = structure.sentence_flags(parts)
        n = len(parts)
        solid = max(1, int(kinds[i].sum() - kinds[i, structure.SPACE]))
        delimiters = text.count("|") + text.count("\t") + text.count("{") + text.count("<") + text.count("=") + text.count("/") + text.count("  ") + (text.count(",") - text.count(", "))
        stats[i] = (
            structure.running_share(flags), sum(flags) / n, sum(structure.SENTENCE_END.search(x.rstrip()) is not None for x in lines) / len(lines),
            min(solid / n, 40.0), (kinds[i, structure.SYMBOL] + kinds[i, structure.ODD]) / solid, kinds[i, structure.DIGIT] / solid,
            math.log1p(n / len(lines)), marked / len(lines), math.log1p(8 * delimiters / n), sum(map(str.isupper, [p[0] for p in parts])) / n,
            math.sqrt(kinds[i, structure.ODD] / solid), 0.25 * math.log1p(n),
        )
    return counts, stats


def text_statistics(chunks: DataFrame) -> DataFrame:
    """One row per id of ``chunks`` (id, content, token_count): counts and statistics of the content.

    ``token_count_trusted`` says whether the stored token_count equals the number of tokens; it is
    null where none is stored. Null content counts as empty: all statistics 0. Rows delivered again
    give one row; a null id is one record. Every text is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, stats = statistics([t or "" for t in batch.column(1).to_pylist()])
            stored = batch.column(2)
            trusted = [None if s is None else s == n for s, n in zip(stored.to_pylist(), counts[:, 0].tolist(), strict=True)]
            arrays = [batch.column(0), *[pa.array(counts[:, k]) for k in range(len(COUNTS))], pa.array(trusted, pa.bool_()), *[pa.array(stats[:, k].astype(np.float32)) for k in range(len(STATS))]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *COUNTS, "token_count_trusted", *STATS])

    schema = "id string, " + ", ".join(f"{c} int" for c in COUNTS) + ", token_count_trusted boolean, " + ", ".join(f"{c} float" for c in STATS)
    return chunks.select("id", "content", F.col("token_count").cast("int")).mapInArrow(run, schema).dropDuplicates(["id"])


class Mixture:
    """A mixture of Gaussians with diagonal covariances over standardized statistics."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, means: np.ndarray, variances: np.ndarray, weights: np.ndarray):
        self.centre, self.scale, self.means, self.variances, self.weights = centre, scale, means, variances, weights
        self.likelihoods: list[float] = []  # of each round, per row
        self.converged = False

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows by components, of raw statistics."""
        z = self.standard(x)
        inverse = 1 / self.variances
        squared = (z * z) @ inverse.T - 2 * z @ (self.means * inverse).T + (self.means**2 * inverse).sum(1)
        return np.log(self.weights) - 0.5 * (squared + np.log(self.variances).sum(1) + z.shape[1] * math.log(2 * math.pi))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responsibilities, log likelihood of each row)."""
        d = self.densities(x)
        top = d.max(1, keepdims=True)
        e = np.exp(d - top)
        total = e.sum(1, keepdims=True)
        return e / total, (top + np.log(total))[:, 0]


def fit(stats: DataFrame, rounds: int = 15, tolerance: float = 1e-3, least_tokens: int = 10) -> Mixture:
    """Expectation-maximization over all rows of ``stats`` with at least ``least_tokens`` tokens.

    Each round is one pass that sums sufficient statistics per component in every task and then in
    one small aggregation; only components x statistics numbers reach the driver. It starts from one
    component per kind of the inspected examples and is deterministic. The model tells the likelihood of
    each round and whether the gain fell below ``tolerance`` before the last.
    """
    rows = stats.where(F.col("tokens") >= least_tokens)
    first = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in STATS], *[F.stddev_pop(c).alias(f"s_{c}") for c in STATS]).first()
    centre = np.array([first[f"m_{c}"] or 0.0 for c in STATS])
    scale = np.array([max(first[f"s_{c}"] or 1.0, 1e-3) for c in STATS])
    _, known = statistics([t for _, _, t in EXAMPLES])
    kinds = list(dict.fromkeys(k for _, k, _ in EXAMPLES))
    start = Mixture(centre, scale, np.zeros((0, len(STATS))), np.zeros(0), np.zeros(0)).standard(known)
    means = np.array([start[[k == kind for _, k, _ in EXAMPLES]].mean(0) for kind in kinds])
    model = Mixture(centre, scale, means, np.full(means.shape, 0.3), np.full(len(kinds), 1 / len(kinds)))
    anchor, spark, likelihoods, converged = model, stats.sparkSession, [], False
    names = ["w", *(f"a{j}" for j in range(len(STATS))), *(f"q{j}" for j in range(len(STATS)))]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            k, d = m.means.shape
            total = np.zeros((k, 1 + 2 * d))
            like = 0.0
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
                if len(x):
                    r, own = m.shares(x)
                    z = m.standard(x)
                    total += np.column_stack([r.sum(0), r.T @ z, r.T @ (z * z)])
                    like += own.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), *[pa.array(total[:, j]) for j in range(1 + 2 * d)], pa.array(np.full(k, like / k))], names=["k", *names, "like"])

        sums = rows.select(*STATS).mapInArrow(run, "k bigint, " + ", ".join(f"{c} double" for c in [*names, "like"])).groupBy("k").agg(*[F.sum(c).alias(c) for c in [*names, "like"]]).orderBy("k").collect()
        shared.unpersist()
        if not sums or not sum(r["w"] for r in sums):
            break
        w = np.array([r["w"] for r in sums])
        d = len(STATS)
        a = np.array([[r[f"a{j}"] for j in range(d)] for r in sums])
        q = np.array([[r[f"q{j}"] for j in range(d)] for r in sums])
        tau = max(1.0, ANCHOR * w.sum())
        own = w[:, None] + tau
        means = (a + tau * anchor.means) / own
        squares = (q + tau * (anchor.variances + anchor.means**2)) / own
        model = Mixture(centre, scale, means, np.clip(squares - means**2, _FLOOR, _CEILING), (w + tau) / (w.sum() + tau * len(w)))
        like = sum(r["like"] for r in sums) / w.sum()
        likelihoods.append(float(like))
        if len(likelihoods) > 1 and like - likelihoods[-2] < tolerance:
            converged = True
            break
    model.likelihoods, model.converged = likelihoods, converged
    return model


def component_classes(model: Mixture) -> np.ndarray:
    """The class of each component: where most of the inspected examples that it explains belong."""
    _, known = statistics([t for _, _, t in EXAMPLES])
    share, _ = model.shares(known)
    votes = np.zeros((len(model.weights), len(CLASSES)))
    for own, (label, _, _) in zip(share, EXAMPLES, strict=True):
        votes[:, CLASSES.index(label)] += own / max(1, sum(c == label for c, _, _ in EXAMPLES)) + 1e-12
    # A component that explains no example takes the class of the example nearest to it.
    z = model.standard(known)
    for k in np.nonzero(votes.sum(1) < 1e-3)[0]:
        nearest = ((z - model.means[k]) ** 2 / model.variances[k]).sum(1).argmin()
        votes[k, CLASSES.index(EXAMPLES[nearest][0])] = 1
    return votes.argmax(1)


def classified(stats: DataFrame, model: Mixture) -> DataFrame:
    """``stats`` with ``kind`` (prose, list, table, junk) and ``prose`` (the probability of prose)."""
    shared = stats.sparkSession.sparkContext.broadcast((model, component_classes(model)))
    columns = stats.columns
    at = [columns.index(c) for c in STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, classes = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in at]).astype(np.float64)
            share, _ = model.shares(x) if len(x) else (np.zeros((0, len(classes))), None)
            by = np.column_stack([share[:, classes == c].sum(1) for c in range(len(CLASSES))])
            kind = [CLASSES[k] for k in by.argmax(1)] if len(by) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.string()), pa.array(np.round(by[:, 0], 4))], names=[*columns, "kind", "prose"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", kind string, prose double"
    return stats.mapInArrow(run, schema)


def assessed(chunks: DataFrame) -> DataFrame:
    """Statistics of every chunk and its kind by a mixture fitted on all chunks (see ``text_statistics``)."""
    stats = written(text_statistics(chunks), "quality")
    return classified(stats, fit(stats))
