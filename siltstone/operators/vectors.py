"""Exact and approximate vector top-k. Queries are a bounded block; the collection streams past it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries per block: a block of 64 numbers each is 2 MB, whatever the size of the collection.
BLOCK = 4096
#: Hits of a task that are held before all but the best are dropped.
HELD = 1_000_000


def unit(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors as float64; unusable ones (null, other length, not finite, zero) become NaN."""
    out = np.full((len(column), dims), np.nan)
    fit = np.nonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))[0]
    if len(fit):
        x = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        with np.errstate(all="ignore"):
            x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        x[~np.isfinite(x).all(axis=1)] = np.nan
        out[fit] = x
    return out


def _blocks(queries: DataFrame, query_key: str, vector: str, dims: int, more: list[str]) -> Iterator[tuple[list, np.ndarray, list]]:
    """The stated query set, one block on the driver at a time. Exact search costs a pass over the collection per block."""
    rows = queries.select(query_key, vector, *more).dropDuplicates([query_key]).orderBy(query_key)
    held: list = []

    def out() -> tuple[list, np.ndarray, list]:
        ids, vectors = [r[0] for r in held], pa.array([r[1] for r in held], pa.list_(pa.float64()))
        return ids, unit(vectors, dims), [r[2] for r in held] if more else []

    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield out()
            held = []
    if held:
        yield out()


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _best(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by query, score and key; the first ``k`` of each query."""
    order = np.lexsort((key, -score, query))
    query, score, key = query[order], score[order], key[order]
    if k is None or not len(query):
        return query, score, key
    first = np.nonzero(np.concatenate([[True], np.diff(query) != 0]))[0]
    keep = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]]))) < k
    return query[keep], score[keep], key[keep]


def scores(base: DataFrame, key: str, queries: DataFrame, query_key: str, vector: str = "embedding", dims: int = 64, k: int | None = None, least: float | None = None, among: list[str] | None = None) -> DataFrame:
    """(query_key, key, similarity): per task the best ``k`` of each query, or all, of at least ``least``.

    ``base`` may carry a column ``cell`` and ``queries`` ``cells`` (array) to restrict comparisons.
    Scoring is one matrix product per Arrow batch in float64; with ``k`` only k rows per query and task
    leave it, without it hits leave with their batch.
    """
    spark = base.sparkSession
    kinds = base.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    out_schema = pa.schema([(query_key, _arrow(kinds[1])), (key, _arrow(kinds[0])), ("similarity", pa.float64())])
    parts = []
    for ids, units, probes in _blocks(queries, query_key, vector, dims, ["cells"] if among else []):
        allowed = None
        if among:
            allowed = np.zeros((len(ids), 1 + max((max(c) for c in probes if c), default=0)), bool)
            for i, own in enumerate(probes):
                allowed[i, own or []] = True
        shared = spark.sparkContext.broadcast((ids, units, allowed))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, allowed = shared.value
            edge = np.full(len(ids), -np.inf if least is None else least)
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def shrunk() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                query, score, key_ = _best(*(np.concatenate([h[c] for h in held]) for c in range(3)), k)
                held[:] = [(query, score, key_)]
                if k is not None and len(query):
                    full = np.nonzero(np.bincount(query, minlength=len(ids)) >= k)[0]
                    last = np.searchsorted(query, full, "right") - 1
                    edge[full] = np.maximum(edge[full], score[last])
                return query, score, key_

            def rows(query: np.ndarray, score: np.ndarray, key_: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({query_key: [ids[i] for i in query.tolist()], key: key_.tolist(), "similarity": score}, schema=out_schema)

            for whole in batches:
                for a in range(0, whole.num_rows, 2048):
                    batch = whole.slice(a, 2048)
                    keys = batch.column(0).to_numpy(zero_copy_only=False)
                    keys = keys if keys.dtype.kind in "iu" else np.array(keys, dtype=str)
                    s = q @ unit(batch.column(1), dims).T
                    if allowed is not None:
                        cell = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                        known = (cell >= 0) & (cell < allowed.shape[1])
                        s[~(allowed[:, np.where(known, cell, 0)] & known)] = np.nan
                    s[np.isnan(s)] = -np.inf
                    bound = edge
                    if k is not None and s.shape[1] > k:
                        bound = np.maximum(edge, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                    # Ties with the edge stay for the exact tie-break.
                    i, j = np.nonzero((s >= bound[:, None]) & (s > -np.inf))
                    if k is None:
                        yield rows(i, s[i, j], keys[j])
                        continue
                    held.append((i, s[i, j], keys[j]))
                    if sum(len(h[0]) for h in held) > HELD:
                        shrunk()
            if held:
                yield rows(*shrunk())

        parts.append(base.where(F.col(key).isNotNull()).select(key, vector, *(["cell"] if among else [])).mapInArrow(run, f"{query_key} {kinds[1]}, {key} {kinds[0]}, similarity double"))
    if not parts:
        return spark.createDataFrame([], f"{query_key} {kinds[1]}, {key} {kinds[0]}, similarity double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked(hits: DataFrame, query_key: str, key: str, k: int, score: str = "similarity") -> DataFrame:
    """Rank from 1 per query by score, ties by key; the first ``k`` (partial limits before the shuffle)."""
    w = Window.partitionBy(query_key).orderBy(F.col(score).desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk(base: DataFrame, key: str, queries: DataFrame, query_key: str, k: int = 10, **options) -> DataFrame:
    """Exact top-k by cosine. Unusable vectors are neither found nor answered; rows without a key are left out."""
    return ranked(scores(base, key, queries, query_key, k=k, **options), query_key, key, k)


def within(base: DataFrame, key: str, queries: DataFrame, query_key: str, least: float, k: int, **options) -> DataFrame:
    """Up to ``k`` neighbours of at least ``least``."""
    return ranked(scores(base, key, queries, query_key, k=k, least=least, **options), query_key, key, k)


class Cells:
    """Spherical k-means cells fitted on a bounded sample; the effort knob is how many are probed."""

    def __init__(self, sample: np.ndarray, count: int, rounds: int = 12, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centres = sample[rng.permutation(len(sample))[: max(1, min(count, len(sample)))]].copy() if len(sample) else np.zeros((1, sample.shape[1]))
        for _ in range(rounds):
            near = (sample @ self.centres.T).argmax(1) if len(sample) else np.zeros(0, int)
            for c in range(len(self.centres)):
                own = sample[near == c]
                if len(own):
                    mean = own.mean(0)
                    self.centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
        self.probes = self.tuned(sample)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :n]

    def tuned(self, sample: np.ndarray, k: int = 10, asked: int = 500, goal: float = 0.97) -> int:
        """The least number of probes that finds ``goal`` of the ``k`` nearest, measured exactly within the sample."""
        if len(sample) <= k:
            return len(self.centres)
        q = sample[:: max(1, len(sample) // asked)]
        s = q @ sample.T
        near = np.argpartition(-s, k, axis=1)[:, : k + 1]
        home = (sample @ self.centres.T).argmax(1)
        place = np.argsort(self.nearest(q, len(self.centres)), axis=1)  # of each cell in the order of probing
        needed = np.sort(np.take_along_axis(place, home[near], 1).ravel()) + 1
        return int(needed[min(len(needed) - 1, int(np.ceil(goal * len(needed))))])


def fit_cells(base: DataFrame, vector: str, dims: int, count: int | None = None, fit_rows: int = 20_000) -> Cells:
    """Fits on at most ``fit_rows`` rows with the least hashes; every row is indexed afterwards.

    Without ``count`` there are about as many cells as rows in a cell, at most 1,024.
    """
    total = max(base.count(), 1)
    span = 1 << 30
    part = F.pmod(F.xxhash64(vector), F.lit(span)) < F.lit(min(span, -(-span * fit_rows // total)))
    x = unit(base.where(part).select(vector).limit(fit_rows).toArrow()[vector].combine_chunks(), dims)
    x = x[~np.isnan(x).any(1)]
    return Cells(x[np.lexsort(x.T)], count or max(1, min(1024, round(total**0.5))))


def with_cells(df: DataFrame, key: str, vector: str, cells: Cells, dims: int, probes: int, out: str) -> DataFrame:
    """``df`` (key, vector) with the nearest cell, or the array of the ``probes`` nearest cells."""
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.nan_to_num(unit(batch.column(1), dims))
            own = shared.value.nearest(x, probes) if len(x) else np.zeros((0, probes), np.int64)
            value = pa.array(own[:, 0], pa.int32()) if out == "cell" else pa.array(own.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), value], names=[key, vector, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).mapInArrow(run, f"{key} {kind}, {vector} array<float>, {out} " + ("int" if out == "cell" else "array<int>"))


def topk_cells(base: DataFrame, key: str, queries: DataFrame, query_key: str, k: int = 10, count: int | None = None, probes: int | None = None, vector: str = "embedding", dims: int = 64, cells: Cells | None = None) -> DataFrame:
    """Approximate top-k: only the ``probes`` cells nearest to a query are scored, exactly.

    Without ``probes`` as many are probed as gave a recall of 0.97 within the fitted sample. Unusable vectors are not found.
    """
    cells = cells or fit_cells(base, vector, dims, count)
    own = with_cells(base, key, vector, cells, dims, 1, "cell")
    asked = with_cells(queries, query_key, vector, cells, dims, min(probes or cells.probes, len(cells.centres)), "cells")
    return ranked(scores(own, key, asked, query_key, vector, dims, k=k, among=["cell"]), query_key, key, k)
