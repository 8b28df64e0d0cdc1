"""The most similar vectors of every vector: a forest of projection trees, then exact reranking.

The trees are fitted on a bounded sample; every vector is put into one leaf of each tree. Every
vector is also a query: one priority queue over all trees, ordered by the least margin on the way,
names the leaves it visits, and all members of these leaves are compared exactly (float32 dot
products of unit vectors). Eight neighbouring leaves form a cell; a vector is sent once to each
cell that it belongs to or visits. Splits are medians, so leaves have about equal numbers of rows
however the vectors lie together. The trees that all tasks know are bounded; where there are more
rows than their leaves can hold, a leaf is split again on its own members by the task that has it,
and a cell is cut into parts of members and of searching rows, every two of which meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.cut import written

CELL = 8  # leaves of a cell
LEAF_ROWS = 2300  # aimed at
FIT_ROWS = 40_000  # at most so many rows fit the trees
PART_ROWS = 400_000  # members, and searching rows, of a cell that one task compares
VISITS, DEEPER = 10, 1.6  # leaves visited in trees of depth 7, and for each level more so many times as many


class Forest:
    """``trees`` complete binary trees of equal ``depth``; splits as a heap per tree."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, visits: int, seed: int):
        self.trees, self.depth, self.visits = trees, depth, max(visits, trees)
        nodes = (1 << depth) - 1
        dims = sample.shape[1] if sample.ndim == 2 else 1
        self.weights = np.zeros((trees, nodes, dims), np.float32)
        self.offsets = np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            where = np.zeros(len(sample), np.int64)
            for d in range(depth):
                for k in range(1 << d):
                    own = sample[where == k]
                    at = (1 << d) - 1 + k
                    w = self.direction(own, rng, dims)
                    self.weights[t, at], self.offsets[t, at] = w, np.median(own @ w) if len(own) else 0.0
                at = (1 << d) - 1 + where
                where = 2 * where + (np.einsum("ij,ij->i", sample, self.weights[t][at]) > self.offsets[t][at])

    @staticmethod
    def direction(own: np.ndarray, rng: np.random.Generator, dims: int) -> np.ndarray:
        """A random projection adapted to the rows: the difference of two means grown from two random rows."""
        w = np.zeros(dims, np.float32)
        if len(own) > 1:
            a, b = own[rng.integers(len(own))], own[rng.integers(len(own))]
            for _ in range(4):
                side = own @ (a - b) > 0
                if side.all() or not side.any():
                    break
                a, b = own[side].mean(0), own[~side].mean(0)
                a, b = a / max(np.linalg.norm(a), 1e-9), b / max(np.linalg.norm(b), 1e-9)
            w = a - b
        if np.linalg.norm(w) < 1e-6:
            w = rng.standard_normal(dims).astype(np.float32)
        return (w / np.linalg.norm(w)).astype(np.float32)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, own): numbers tree * 2^depth + leaf of the visited leaves; which are the row's own.

        The queue is kept level by level: a leaf among the best ``visits`` has all its ancestors
        among the best ``visits`` of their levels, for priorities never rise on the way down.
        """
        n = len(x)
        tree = np.tile(np.arange(self.trees), (n, 1))
        node = np.zeros((n, self.trees), np.int64)
        best = np.full((n, self.trees), np.inf, np.float32)
        own = np.ones((n, self.trees), bool)
        for d in range(self.depth):
            first, width = (1 << d) - 1, 1 << d
            if self.trees * width <= 1024:
                w = self.weights[:, first : first + width].reshape(self.trees * width, -1)
                every = x @ w.T - self.offsets[:, first : first + width].reshape(-1)
                margin = np.take_along_axis(every, tree * width + node, 1)
            else:
                margin = np.empty(best.shape, np.float32)
                for a in range(0, n, 512):
                    s = slice(a, a + 512)
                    margin[s] = np.einsum("ij,ikj->ik", x[s], self.weights[tree[s], first + node[s]]) - self.offsets[tree[s], first + node[s]]
            right = margin > 0
            tree = np.concatenate([tree, tree], 1)
            node = np.concatenate([2 * node, 2 * node + 1], 1)
            best = np.concatenate([np.minimum(best, -margin), np.minimum(best, margin)], 1)
            own = np.concatenate([own & ~right, own & right], 1)
            if best.shape[1] > self.visits:
                # The own path of every tree has no negative margin, but let rounding lose none.
                keep = np.argpartition(-np.where(own, np.inf, best), self.visits - 1, axis=1)[:, : self.visits]
                tree, node, best, own = (np.take_along_axis(v, keep, 1) for v in (tree, node, best, own))
        return tree * (1 << self.depth) + node, own


def usable(vector: Column, dims: int | None) -> Column:
    """Not null, ``dims`` numbers, all finite, not all zero."""
    whole = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    some = F.exists(vector, lambda e: e != 0)
    fit = (F.size(vector) == dims) if dims else (F.size(vector) > 0)
    return F.coalesce(vector.isNotNull() & fit & whole & some, F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def visits_of(depth: int) -> int:
    """Leaves to visit: deeper trees have smaller leaves of the same space, so more of them are visited."""
    return max(VISITS, round(VISITS * DEEPER ** (depth - 7)))


def _fields(x: np.ndarray, members: np.ndarray, queries: np.ndarray, leaf_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, queries) to compare: all of them, or for a leaf of more than twice ``leaf_rows`` those of the leaves of a forest of its own."""
    depth = round(math.log2(len(members) / leaf_rows)) if len(members) > 2 * leaf_rows else 0
    if not depth:
        yield members, queries
        return
    step = max(1, len(members) // (64 << depth))
    forest = Forest(x[members[::step]], 3, depth, min(3 << depth, max(8, visits_of(depth + 4))), 13)
    for a in range(0, len(queries), 65_536):
        q = queries[a : a + 65_536]
        leaves, _ = forest.search(x[q])
        order = np.argsort(leaves, axis=None, kind="stable")
        number, who = leaves.ravel()[order], q[order // leaves.shape[1]]
        if not a:
            home, own = forest.search(x[members])
            home = np.where(own, home, -1)
            at, row = home.ravel(), np.repeat(np.arange(len(members)), home.shape[1])
            row = row[at >= 0]
            at = at[at >= 0]
            by = np.argsort(at, kind="stable")
            at, row = at[by], members[row[by]]
        for n in np.unique(number):
            i, j = np.searchsorted(number, [n, n + 1])
            u, v = np.searchsorted(at, [n, n + 1])
            yield row[u:v], who[i:j]


def top_of_cell(x: np.ndarray, leaf: np.ndarray, visits: np.ndarray, k: int, least: float, block: int = 1024, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, cosine) with the best ``k`` of every row over the leaves it visits here."""
    n = len(x)
    bound = np.full(n, least, np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k of each row, every neighbour once."""
        row, other, sim = (np.concatenate([f[c] for f in found]) for c in range(3))
        fit = sim >= bound[row]
        row, other, sim = row[fit], other[fit], sim[fit]
        order = np.lexsort((-sim, other, row))
        row, other, sim = row[order], other[order], sim[order]
        new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(other) != 0)]) if len(row) else np.zeros(0, bool)
        row, other, sim = row[new], other[new], sim[new]
        order = np.lexsort((other, -sim, row))
        row, other, sim = row[order], other[order], sim[order]
        first = np.concatenate([[0], np.nonzero(np.diff(row))[0] + 1]) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))
        found[:] = [(row[rank < k], other[rank < k], sim[rank < k])]
        return found[0]

    place = np.full(n, -1, np.int64)
    for number in range(CELL):
        own_members, own_queries = np.nonzero(leaf == number)[0], np.nonzero(visits >> number & 1)[0]
        if not len(own_members) or not len(own_queries):
            continue
        for members, queries in _fields(x, own_members, own_queries, leaf_rows):
            if not len(members):
                continue
            place[members] = np.arange(len(members))
            for a in range(0, len(queries), block):
                q = queries[a : a + block]
                for b in range(0, len(members), 8192):
                    m = members[b : b + 8192]
                    s = x[q] @ x[m].T
                    own = place[q] - b
                    inside = (own >= 0) & (own < len(m))
                    s[np.nonzero(inside)[0], own[inside]] = -3
                    parts = 4 * k
                    if len(m) >= 4 * parts:
                        # The k-th largest of the maxima of disjoint parts is at most the k-th largest of all.
                        width = len(m) // parts
                        tops = s[:, : parts * width].reshape(len(q), parts, width).max(2)
                        bound[q] = np.maximum(bound[q], np.partition(tops, parts - k, axis=1)[:, parts - k])
                    i, j = np.nonzero(s >= bound[q][:, None])
                    hit = s[i, j]
                    real = hit > -2
                    found.append((q[i[real]], m[j[real]], hit[real]))
                    held += len(i)
                    if held > 4_000_000:
                        held = len(best()[0])
            place[members] = -1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return best()


def class_neighbours(rows: DataFrame, dims: int, k: int, least: float, trees: int, visits: int | None, leaf_rows: int, fit_rows: int, part_rows: int, seed: int) -> DataFrame:
    """(v, near): for each distinct vector, up to ``k`` nearest other distinct vectors (cosine, v), best first.

    ``rows`` has v (a hash of the vector) and e (the vector), repeats allowed.
    """
    spark = rows.sparkSession
    total = max(rows.count(), 1)
    span = 1 << 30
    part = F.pmod(F.xxhash64("v"), F.lit(span)) < F.lit(min(span, math.ceil(span * fit_rows / total)))
    sample = rows.where(part).dropDuplicates(["v"]).limit(fit_rows).select("v", "e").toArrow().sort_by("v")
    fitted = _matrix(sample["e"].combine_chunks(), dims) if sample.num_rows else np.zeros((0, dims), np.float32)
    depth = max(0, min(round(math.log2(total / leaf_rows)), int(math.log2(max(len(fitted), 32) / 32))))
    forest = spark.sparkContext.broadcast(Forest(fitted, trees, depth, min(visits or visits_of(depth), trees << depth), seed))
    below = min(depth, int(math.log2(CELL)))
    # Rows of a cell from the number of all rows: leaves are halved at medians and hardly differ.
    grid = max(1, math.ceil((total << below) / (1 << depth) / part_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = forest.value
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            leaves, own = f.search(x)
            cells = leaves >> below
            bit = np.left_shift(1, leaves & ((1 << below) - 1))
            row = np.repeat(np.arange(len(x)), leaves.shape[1])
            order = np.lexsort((cells.ravel(), row))
            row, cell, bit, mine, leaf = row[order], cells.ravel()[order], bit.ravel()[order], own.ravel()[order], leaves.ravel()[order]
            if not len(row):
                continue
            new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(cell) != 0)])
            at = np.nonzero(new)[0]
            home = np.maximum.reduceat(np.where(mine, leaf & ((1 << below) - 1), -1), at)
            cell, row, asks = cell[at], row[at], np.bitwise_or.reduceat(bit, at)
            part = batch.column(0).to_numpy()[row].view(np.uint64) % np.uint64(grid)
            for p in range(grid):
                for q in range(grid):
                    # A row is a member in the parts of its line, and searches in those of its column.
                    in_, out = np.where(part == p, home, -1), np.where(part == q, asks, 0)
                    use = np.nonzero((in_ >= 0) | (out > 0))[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((cell[use] * grid + p) * grid + q, pa.int64()), batch.column(0).take(pa.array(row[use])), _binary(x[row[use]]), pa.array(in_[use].astype(np.int16)), pa.array(out[use].astype(np.int16))],
                        names=["cell", "v", "x", "leaf", "visits"],
                    )

    def compare(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group["x"].to_pylist()), np.float32).reshape(-1, dims)
        v = group["v"].to_numpy()
        row, other, sim = top_of_cell(x, group["leaf"].to_numpy(), group["visits"].to_numpy().astype(np.int64), k, least, leaf_rows=leaf_rows)
        rows, counts = np.unique(row, return_counts=True)
        near = pa.StructArray.from_arrays([pa.array(-sim.astype(np.float64)), pa.array(v[other])], names=["d", "w"])
        return pa.table({"v": v[rows], "near": _lists(counts, near)})

    classes = rows.groupBy("v").agg(F.first("e").alias("e"))
    routed = classes.mapInArrow(route, "cell bigint, v bigint, x binary, leaf smallint, visits smallint")
    found = routed.groupBy("cell").applyInArrow(compare, "v bigint, near array<struct<d:double,w:bigint>>")
    # A neighbour met in several trees may differ in the last bit: kept once, at its best.
    merged = found.groupBy("v").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("_all"))
    seen = F.aggregate(
        "_all", F.array().cast("array<struct<d:double,w:bigint>>"),
        lambda acc, x: F.when((F.size(acc) < k) & ~F.exists(acc, lambda y: y["w"] == x["w"]), F.array_append(acc, x)).otherwise(acc),
    )
    return merged.select("v", seen.alias("near"))


def nearest(vectors: DataFrame, k: int = 5, dims: int = 64, least: float = -1.0, trees: int = 3, visits: int | None = None, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS, part_rows: int = PART_ROWS, seed: int = 7) -> DataFrame:
    """For every id with a usable vector, the ids of the ``k`` most similar vectors by cosine.

    ``vectors`` has id and embedding. Columns: id, near_id, cosine, position (from 1). Ties go by
    id, so among equal vectors the smallest other ids are nearest. Null vectors, vectors of another
    length, with null, NaN or infinite numbers or all zero are unusable: no row, and nobody's
    neighbour. Rows repeated under one id count once; if one id has several vectors, each is
    searched. Equal vectors are searched once and carry their ``k`` + 1 smallest ids, so a vector
    held by most rows makes no large group. ``least`` drops neighbours below that cosine.
    An empty table gives no rows. Only the fit of the trees uses a sample (``fit_rows``).
    """
    ids = vectors.select("id", F.xxhash64("embedding").alias("v"), F.col("embedding").alias("e")).where(F.col("id").isNotNull() & usable(F.col("embedding"), dims))
    near = written(class_neighbours(ids.select("v", "e"), dims, k, least, trees, visits, leaf_rows, fit_rows, part_rows, seed), "near")
    members = ids.select("id", "v").distinct()
    ranked = members.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    heads = ranked.groupBy("v").agg(F.collect_list("id").alias("ids"))  # at most k + 1 each
    links = near.select("v", F.explode("near").alias("n")).select("v", F.col("n.d").alias("d"), F.col("n.w").alias("w"))
    across = links.join(heads.select(F.col("v").alias("w"), "ids"), "w").select("v", F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))).alias("c"))
    within = heads.where(F.size("ids") > 1).select("v", F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("id"))).alias("c"))
    lists = across.unionByName(within).groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k + 1).alias("c"))
    own = members.join(lists, "v").select("id", F.slice(F.filter("c", lambda x: x["id"] != F.col("id")), 1, k).alias("c"))
    return own.select("id", F.posexplode("c").alias("position", "n")).select("id", F.col("n.id").alias("near_id"), (-F.col("n.d")).alias("cosine"), (F.col("position") + 1).alias("position"))
