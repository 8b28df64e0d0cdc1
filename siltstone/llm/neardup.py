"""Near-duplicate texts by vertical partitioning of the global word order.

All words get one global order, rare words first. It is cut into fragments of about equal weight.
Two sets with a Jaccard similarity of t or more share a word in the rarest (1 - t) of each, so
candidates come from an equi-join on those words; what is left of them is sent to each fragment,
which holds its part of every set and counts the partial overlaps apart from the others, and the
partial overlaps are summed per pair. Nothing is approximate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.text import words
from siltstone.plans.cut import written

#: Words in at least one of so many rows get a counted rank; their number is at most RANKED times
#: the average number of different words of a row, whatever the size of the collection.
RANKED = 5000
FRAGMENTS, MAPS, SKETCH = 4, 4, 8
PARITY = [f"b{k}" for k in range(MAPS)] + [f"c{k}" for k in range(SKETCH)]
#: Rows of one word that are compared in one task; the list of a more frequent word is cut into
#: cells, each pair of which is a task of its own.
HOT = 20_000
#: Sets in pairs that are left, whose numbers (8 bytes each) are broadcast to leave the other sets' words out; more are joined by a shuffle.
WANTED = 1_000_000
RARE = 1 << 62  # ranked words are numbered from here, all others are below by their hash
#: Ids of one class that are paired in one task; a larger class is cut into parts, two of which make a task.
PART = 1000


def _grams(text: str, gram: int) -> set[str]:
    own = words(text)
    return set(own) if gram == 1 else {" ".join(own[i : i + gram]) for i in range(len(own) - gram + 1)}


def _number(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & (RARE - 1)


def gram_counts(rows: DataFrame, gram: int, least_grams: int) -> DataFrame:
    """(g, n): in how many rows of (id, text) each n-gram occurs. Counted in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(1).to_pylist():
                own = _grams(text, gram) if text else ()
                if len(own) >= least_grams:
                    seen.update(own)
            yield pa.RecordBatch.from_arrays([pa.array([_number(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["g", "n"])

    return rows.mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))


def ordered_sets(rows: DataFrame, gram: int, least_grams: int) -> DataFrame:
    """(id, s, n, copy, f0.., b0.., c0..): each row's n-grams in the global order, cut into fragments.

    ``s`` names the set, ``copy`` the exact text; b0 to b3 hold the parity of the set in 256 cells, so the number of cells
    in which two sets differ is a lower bound of their symmetric difference; c0 to c7 do so in 512.
    """
    spark = rows.sparkSession
    total = max(rows.count(), 1)
    least = max(2, total // RANKED)
    ranked = gram_counts(rows, gram, least_grams).where(F.col("n") >= least).toArrow().sort_by([("n", "ascending"), ("g", "ascending")])
    numbers, counts = ranked["g"].to_numpy(), ranked["n"].to_numpy()
    weight = np.cumsum(counts)
    cuts = [RARE + int(np.searchsorted(weight, weight[-1] * k / FRAGMENTS)) for k in range(1, FRAGMENTS)] if len(weight) else [RARE] * (FRAGMENTS - 1)
    shared = spark.sparkContext.broadcast((numbers, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, cuts = shared.value
        rank = dict(zip(numbers.tolist(), range(RARE, RARE + len(numbers)), strict=True))
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 1_000_000:
                known.clear()
            keys, flat, sizes, names, copies = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _grams(text, gram) if text else ()
                if len(own) < least_grams or key is None:
                    continue
                order = []
                for w in own:
                    k = known.get(w)
                    if k is None:
                        k = _number(w)
                        k = known[w] = rank.get(k, k)
                    order.append(k)
                order.sort()
                keys.append(key)
                flat += order
                sizes.append(len(order))
                copies.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
            all_, size = np.array(flat, np.int64), np.array(sizes, np.int64)
            start = np.concatenate([[0], np.cumsum(size)])
            names = [xxhash.xxh3_64_intdigest(all_[a:b].tobytes()) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            mixed = all_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            maps = []
            for bit, parts in ((mixed >> np.uint64(56), MAPS), ((mixed >> np.uint64(40)) & np.uint64(511), SKETCH)):
                one = np.left_shift(np.uint64(1), bit & np.uint64(63))
                part = bit >> np.uint64(6)
                maps += [np.bitwise_xor.reduceat(np.where(part == h, one, np.uint64(0)), start[:-1]) if len(keys) else np.zeros(0, np.uint64) for h in range(parts)]
            piece = np.searchsorted(np.array(cuts), all_, "right")
            lists = []
            for k in range(FRAGMENTS):
                inside = piece == k
                counts = np.add.reduceat(inside, start[:-1]) if len(keys) else np.zeros(0, int)
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(all_[inside])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(size.astype(np.int32)), pa.array(np.array(copies, np.uint64).view(np.int64)), *lists, *[pa.array(m.view(np.int64)) for m in maps]],
                names=["id", "s", "n", "copy", *(f"f{k}" for k in range(FRAGMENTS)), *PARITY],
            )

    fragments = ", ".join(f"f{k} array<bigint>" for k in range(FRAGMENTS))
    return rows.mapInArrow(run, f"id string, s bigint, n int, copy bigint, {fragments}, " + ", ".join(f"{c} bigint" for c in PARITY))


def _joined(t: float, rows: int = 200_000, most: int = 2_000_000):
    """A worker function: rows (g, c, i, s, n, p, b0..) sorted by (g, c, n) to candidate pairs (a, b)."""
    both = 2 * t / (1 + t)

    def met(g: np.ndarray, i: np.ndarray, s: np.ndarray, n: np.ndarray, p: np.ndarray, maps: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # Partners of a row: later rows of the same word and cell, not larger than n / t.
        widest = int(n.max()) + 1
        key = g * (2 * widest) + n
        end = np.searchsorted(key, g * (2 * widest) + np.minimum(np.floor(n / t + 1e-9).astype(np.int64), 2 * widest - 1), "right")
        count = np.where(p < n - np.ceil(n * both - 1e-9).astype(np.int64) + 1, end - np.arange(len(n)) - 1, 0)
        need = np.ceil(np.arange(2 * widest + 1) * (t / (1 + t)) - 1e-9).astype(np.int32)
        left, n = (n - p).astype(np.int32), n.astype(np.int32)
        total = np.cumsum(count)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
            own = count[a:b]
            x = np.repeat(np.arange(a, b), own)
            y = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + x + 1
            # A pair is met at its first common word, if anywhere: beyond it at most the rest is common.
            least = need[n[x] + n[y]]
            fit = np.nonzero((np.minimum(left[x], left[y]) >= least) & ((i[x] != i[y]) | (i[x] < 0)))[0]
            x, y, least = x[fit], y[fit], least[fit]
            apart = sum(np.bitwise_count(m[x] ^ m[y]).astype(np.int32) for m in maps)
            fit = apart <= n[x] + n[y] - 2 * least
            x, y = s[x[fit]], s[y[fit]]
            yield np.minimum(x, y), np.maximum(x, y)
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            g, c = table["g"].to_numpy(), table["c"].to_numpy()
            new = np.concatenate([[True], (np.diff(g) != 0) | (np.diff(c) != 0)])
            cut = len(g) if last else int(np.nonzero(new)[0][-1])
            held.clear()
            if cut < len(g):
                held.extend(table.slice(cut).combine_chunks().to_batches())
            if cut:
                part = table.slice(0, cut)
                col = lambda k: part[k].to_numpy()
                for a, b in met(np.cumsum(new[:cut]) - 1, col("i"), col("s"), col("n").astype(np.int64), col("p").astype(np.int64), [col(f"b{k}").view(np.uint64) for k in range(MAPS)]):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(h.num_rows for h in held) >= rows:
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def candidates(reps: DataFrame, t: float) -> DataFrame:
    """(a, b): pairs of different sets that share one of their rarest words and can reach ``t``."""
    n = F.col("n")
    reach = (n - F.ceil(F.round(n * t, 6)).cast("int") + 1).alias("reach")  # as the larger set of a pair
    maps = [f"b{k}" for k in range(MAPS)]
    entries = reps.select("s", "n", *maps, reach, F.concat(*[f"f{k}" for k in range(FRAGMENTS)]).alias("g"))
    entries = entries.select("s", "n", *maps, F.posexplode(F.slice("g", 1, F.col("reach"))).alias("p", "g"))
    hot = written(entries.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select(F.col("g").alias("h"), F.ceil(F.col("c") / HOT).cast("int").alias("r")), "hot")
    if hot.head(1):
        marked = entries.join(hot, entries["g"] == hot["h"], "left")
        i = F.when(F.col("r").isNull(), -1).otherwise(F.pmod(F.xxhash64("s"), F.col("r")).cast("int")).alias("i")
        j = F.explode(F.when(F.col("r").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("r") - 1))).alias("j")
        cells = marked.select("g", "s", "n", "p", *maps, "r", i, j)
        cell = F.when(F.col("i") < 0, 0).otherwise(F.least("i", "j") * F.col("r") + F.greatest("i", "j")).alias("c")
        # In a cell of one part with itself all rows are compared, else only rows of different parts.
        entries = cells.select("g", cell, F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("i")).alias("i"), "s", "n", "p", *maps)
    else:
        entries = entries.select("g", F.lit(0).alias("c"), F.lit(-1).alias("i"), "s", "n", "p", *maps)
    spread = entries.repartition("g", "c").sortWithinPartitions("g", "c", "n")
    return spread.mapInArrow(_joined(t), "a bigint, b bigint").distinct()


def similar_sets(sets: DataFrame, t: float) -> DataFrame:
    """(a, b, overlap, jaccard) of all pairs of different sets (rows of ``ordered_sets``) with a similarity of ``t`` or more."""
    columns = ["n", *(f"f{k}" for k in range(FRAGMENTS)), *PARITY]
    reps = written(sets.groupBy("s").agg(F.first(F.struct(*columns)).alias("r")).select("s", "r.*"), "sets")
    met = candidates(reps, t)
    # Most pairs fall to the finer parity, before any word list moves.
    sketch = lambda c: reps.select(F.col("s").alias(c), F.col("n").alias(f"{c}n"), *[F.col(f"c{k}").alias(f"{c}c{k}") for k in range(SKETCH)])
    apart = sum((F.bit_count(F.col(f"ac{k}").bitwiseXOR(F.col(f"bc{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("ac0").bitwiseXOR(F.col("bc0"))))
    need = F.ceil(F.round((F.col("an") + F.col("bn")) * (t / (1 + t)), 6))
    near = written(met.join(sketch("a"), "a").join(sketch("b"), "b").where(apart <= F.col("an") + F.col("bn") - 2 * need).select("a", "b", "an", "bn"), "near")
    wanted = near.select(F.col("a").alias("s")).union(near.select(F.col("b").alias("s"))).distinct()
    held = reps.join(F.broadcast(wanted) if wanted.count() <= WANTED else wanted, "s", "left_semi")
    # Vertical partitions: (fragment, set) is the key, so each fragment's overlaps are counted apart.
    parts = held.select("s", F.posexplode(F.array(*[f"f{k}" for k in range(FRAGMENTS)])).alias("k", "words")).where(F.size("words") > 0)
    pieces = near.select("*", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("k"))
    pieces = pieces.join(parts.select(F.col("s").alias("a"), "k", F.col("words").alias("u")), ["a", "k"]).join(parts.select(F.col("s").alias("b"), "k", F.col("words").alias("v")), ["b", "k"])
    partial = pieces.select("a", "b", "an", "bn", F.size(F.array_intersect("u", "v")).alias("o"))
    pairs = partial.groupBy("a", "b", "an", "bn").agg(F.sum("o").cast("int").alias("overlap"))
    return pairs.select("a", "b", "overlap", (F.col("overlap") / (F.col("an") + F.col("bn") - F.col("overlap"))).alias("jaccard")).where(F.col("jaccard") >= F.lit(t - 1e-12))


def near_duplicates(chunks: DataFrame, threshold: float = 0.7, gram: int = 1, least_grams: int = 40) -> tuple[DataFrame, DataFrame]:
    """(membership, links): classes of equal n-gram sets and the links between similar classes.

    ``chunks`` has id and content. membership: id, s (the class), n, copy (the exact text).
    links: a, b (classes), overlap, jaccard, for every pair of different classes with a similarity of ``threshold`` or more.
    Only texts with ``least_grams`` different n-grams take part: null, empty, blank and short
    texts, and null ids, give no row. A row delivered again counts once. One class may hold any
    share of the rows: it is one set in the join.
    """
    sets = written(ordered_sets(chunks.select("id", "content"), gram, least_grams), "ordered")
    return sets.select("id", "s", "n", "copy").distinct(), similar_sets(sets, threshold)


def pairs_of(membership: DataFrame, links: DataFrame, expand: int | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the links as pairs of ids, and the pairs within each class.

    Every pair is given, in cells of ``PART`` ids by ``PART``. Only if ``expand`` is set, more than so
    many copies of one text (``copy``, where membership has it, else the class) give a star of their
    smallest id, which also stands for them in pairs with others.
    """
    members = membership.select("id", "s", F.col("copy" if "copy" in membership.columns else "s").alias("copy"))
    star = None
    if expand is not None:
        copies = members.groupBy("s", "copy").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("head"))
        members = members.join(copies, ["s", "copy"])
        apart = (F.col("copies") > expand) & (F.col("id") != F.col("head"))
        star = members.where(apart).select(F.col("head").alias("i"), F.col("id").alias("j"))
        members = members.where(~apart)
    sizes = members.groupBy("s").agg(F.count(F.lit(1)).alias("size"))
    large = written(sizes.where(F.col("size") > PART).select("s", F.ceil(F.col("size") / PART).cast("int").alias("r")), "large")
    few = members.join(sizes.where(F.col("size") > 1), "s").select("s", "id")
    sides = links.select("a", "b")
    if large.head(1):
        parts = lambda df, c: df.join(large.withColumnRenamed("s", c), c, "left").withColumn("r", F.coalesce("r", F.lit(1)))
        part = F.pmod(F.xxhash64("id"), F.col("r")).cast("int")
        stand = parts(members.select("s", "id"), "s").select("s", "id", part.alias("k"))
        for c in ("a", "b"):
            sides = parts(sides, c).withColumn(f"{c}k", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).drop("r")
        across = sides.join(stand.select(F.col("s").alias("a"), F.col("k").alias("ak"), F.col("id").alias("i")), ["a", "ak"]).join(stand.select(F.col("s").alias("b"), F.col("k").alias("bk"), F.col("id").alias("j")), ["b", "bk"]).select("i", "j")
        cells = parts(few, "s").select("s", "id", "r", part.alias("k"))
        left = cells.select("s", F.col("k").alias("x"), F.explode(F.sequence("k", F.col("r") - 1)).alias("y"), F.col("id").alias("i"))
        right = cells.select("s", F.explode(F.sequence(F.lit(0), "k")).alias("x"), F.col("k").alias("y"), F.col("id").alias("j"))
        within = left.join(right, ["s", "x", "y"]).where((F.col("x") < F.col("y")) | (F.col("i") < F.col("j"))).select("i", "j")
    else:
        across = sides.join(members.select(F.col("s").alias("a"), F.col("id").alias("i")), "a").join(members.select(F.col("s").alias("b"), F.col("id").alias("j")), "b").select("i", "j")
        within = few.select("s", F.col("id").alias("i")).join(few.select("s", F.col("id").alias("j")), "s").where(F.col("i") < F.col("j")).select("i", "j")
    every = across.unionByName(within)
    if star is not None:
        every = every.unionByName(star)
    return every.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) is connected to, by alternating stars.

    Each round is a written table; the number of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = written(small.where("a != b").distinct(), "edges")
        after = now.agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(after):
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        state = tuple(after)


def groups_of(membership: DataFrame, links: DataFrame) -> DataFrame:
    """One row per id that takes part: id, class, group (of all texts connected by links), copies, links.

    ``class`` and ``group`` are the smallest ids in them; ``copies`` counts the ids with an equal
    set, ``links`` the similar classes.
    """
    links = written(links.select("a", "b"), "links")
    roots = components(links)
    degree = links.select(F.col("a").alias("s")).unionAll(links.select(F.col("b").alias("s"))).groupBy("s").agg(F.count(F.lit(1)).alias("links"))
    classes = membership.groupBy("s").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"))
    classes = classes.join(roots, classes["s"] == roots["node"], "left").withColumn("root", F.coalesce("root", "s")).drop("node").join(degree, "s", "left")
    tops = classes.groupBy("root").agg(F.min("class").alias("group"))
    classes = classes.join(tops, "root")
    return membership.select("id", "s").join(classes, "s").select("id", "class", "group", "copies", F.coalesce("links", F.lit(0)).alias("links"))
