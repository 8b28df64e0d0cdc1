"""Long spans shared verbatim: recurring phrases, sharded Aho-Corasick automata, exact extension.

Of every text a few phrases are picked by content (the least hash in each run of windows), so that
two texts with a common span of ``least`` characters pick a phrase in common. Phrases that recur in
different texts are confirmed. All texts, spread over shards, then stream through the automaton of
their shard, which locates every occurrence of every confirmed phrase. That automaton has all
confirmed phrases that can occur in the shard, wherever they were picked: each window of a text
names its least ``gram`` as an anchor, and a phrase goes to the shards that have its anchor.
Occurrences of one phrase are then extended exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.neardup import pairs_of
from siltstone.plans.cut import written

SHARD_TEXTS = 500
#: Texts whose numbers (8 bytes each) are broadcast to find the confirmed phrases' wording; more are joined by a shuffle.
HOLDERS = 1_000_000
#: Occurrences of one phrase that are compared directly; more are paired by their equal windows.
DIRECT = 256
#: Texts with an equal window that are paired in one task; more are cut into parts, two of which make a task.
PART = 1000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (greatest) of each ``width`` consecutive values, in a few passes whatever the width."""
    op, fill = (np.minimum, np.uint64(_MASK)) if least else (np.maximum, np.uint64(0))
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, fill, np.uint64)]).reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


def phrase_hashes(chars: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each window of ``width`` code points, by doubling, then mixed."""
    level = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    size, done, out, m = 1, 0, None, len(chars) - width + 1
    while True:
        if width & size:
            part = level[done : done + m]
            out = part.copy() if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + part
            done += size
        if done == width:
            break
        level = level[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + level[size:]
        size *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(29))


def picked(texts: list[str], width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the picked phrases of several texts at once."""
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(chars) < width + run - 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    h = phrase_hashes(chars, width)
    low = _sliding(h, run, True)
    # Runs that reach into the next text don't count.
    span = width + run - 1
    inside = np.zeros(len(low) + 1, np.int64)
    long = sizes >= span
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - span + 1)[long], -1)
    low[np.cumsum(inside)[:-1] <= 0] = 0
    edge = np.zeros(run - 1, np.uint64)
    best = _sliding(np.concatenate([edge, low, edge]), run, False)
    at = np.nonzero((best == h) & (best > 0))[0]
    text = np.searchsorted(ends, at, "right")
    return text, at - (ends - sizes)[text], h[at]


def phrases(docs: DataFrame, width: int, run: int, shards: int) -> DataFrame:
    """Of (t, text): (t, h, pos, anchor) for each picked phrase, and (shard, anchor) with a null ``h`` for the anchors of every text.

    The anchor of a window of ``width`` characters is its least hash of ``width`` // 3 characters, of which 32 bits are kept:
    phrases of equal anchor go the same way, which never loses any.
    """
    gram = max(1, width // 3)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= 150_000):
                    size += len(texts[b])
                    b += 1
                own = texts[a:b]
                text, at, h = picked(own, width, run)
                sizes = np.array([len(x) for x in own])
                ends = np.cumsum(sizes)
                chars = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
                if len(chars) >= width:
                    least = _sliding(phrase_hashes(chars, gram), width - gram + 1, True)
                    anchor = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    owner = np.searchsorted(ends, np.arange(len(anchor)), "right")
                    whole = np.arange(len(anchor)) + width <= ends[owner]
                    new = whole & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
                    pairs = np.unique((keys[a:b] % shards)[owner[new]].astype(np.int64) << 32 | anchor[new].view(np.uint32).astype(np.int64))
                    n = len(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array((pairs & 0xFFFFFFFF).astype(np.uint32).view(np.int32))], names=["t", "h", "pos", "anchor"])
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][text]), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(anchor[(ends - sizes)[text] + at])], names=["t", "h", "pos", "anchor"])
                a = b

    return docs.select("t", "text").mapInArrow(make, "t bigint, h bigint, pos int, anchor int")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (t, ..) without those whose t the task has had: copies of one text don't travel to one shard."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for i, t in enumerate(batch.column(0).to_pylist()):
            if t not in seen:
                seen.add(t)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def occurrences(texts: DataFrame, routed: DataFrame, width: int, reach: int) -> DataFrame:
    """(p, t, pos, before, after): every occurrence in (shard, t, text) of the phrases (shard, phrase) sent to its shard.

    before and after are up to ``reach`` characters around the occurrence, which is left out where the
    text has no span of width + ``reach`` characters around it.
    """

    def locate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in right["phrase"].to_pylist():
            h = xxhash.xxh3_64_intdigest(phrase.encode("utf-8", "surrogatepass"))
            machine.add_word(phrase, h - (1 << 64) if h >> 63 else h)
        rows: list[tuple] = []
        if len(machine) and left.num_rows:
            machine.make_automaton()
            done: set[int] = set()
            for t, text in zip(left["t"].to_pylist(), left["text"].to_pylist(), strict=True):
                if t in done:
                    continue
                done.add(t)
                for end, p in machine.iter(text):
                    a = end - width + 1
                    before, after = text[max(0, a - reach) : a], text[end + 1 : end + 1 + reach]
                    if len(before) + len(after) >= reach:
                        rows.append((p, t, a, before, after))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("p", "t", "pos", "before", "after"), cols, kinds, strict=True)})

    return texts.groupBy("shard").cogroup(routed.groupBy("shard")).applyInArrow(locate, "p bigint, t bigint, pos int, before string, after string")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def extended(occ: DataFrame, width: int, least: int) -> DataFrame:
    """(a, a_start, a_end, b, b_start, b_end): common spans of ``least`` or more characters around common phrases.

    A phrase with up to ``DIRECT`` occurrences has them compared with each other; of a more
    frequent phrase each occurrence names the windows of ``least`` characters around it. Every two
    texts with an equal window are paired (once for all windows that the same texts have), and each
    window is given once more beside the first text that has it, so that no shared character is missed.
    """
    reach = least - width
    often = occ.groupBy("p").agg((F.count(F.lit(1)) > DIRECT).alias("often"))
    marked = occ.join(often, "p")

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        rows: list[tuple] = []

        def flush() -> None:
            for i, (_, t, pos, before, after) in enumerate(group):
                for _, t2, pos2, before2, after2 in group[:i]:
                    if t2 != t:
                        r = _common(after, after2)
                        x = _common(before, before2) if r == reach or reach - r <= min(len(before), len(before2)) else 0
                        if x + width + r >= least:
                            own, other = (t, pos - x, pos + width + r), (t2, pos2 - x, pos2 + width + r)
                            rows.append(own + other if t < t2 else other + own)
            group.clear()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and group[0][0] != row[0]:
                    flush()
                group.append((row[0], row[1], row[2], row[3][::-1], row[4]))
            yield out(rows)
            rows.clear()
        flush()
        yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()) * 2, strict=True)], names=["a", "a_start", "a_end", "b", "b_start", "b_end"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at, texts = [], [], []
            for k, (before, after) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                start = batch.column(2)[k].as_py() - len(before)
                # The phrase itself is the same in the group: its number stands for it.
                for x in range(max(0, reach - len(after)), min(reach, len(before)) + 1):
                    h.append(xxhash.xxh3_64_intdigest(f"{x}\0{before[len(before) - x :]}\0{after[: reach - x]}".encode("utf-8", "surrogatepass")))
                    at.append(start + len(before) - x)
                    texts.append(k)
            index = pa.array(texts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(at, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))], names=["p", "t", "start", "w"])

    kind = "a bigint, a_start int, a_end int, b bigint, b_start int, b_end int"
    few = marked.where("not often").select("p", "t", "pos", "before", "after").repartition("p").sortWithinPartitions("p", "t", "pos").mapInArrow(direct, kind)
    many = marked.where("often").select("p", "t", "pos", "before", "after").mapInArrow(windows, "p bigint, t bigint, start int, w bigint")
    first = many.groupBy("p", "w").agg(F.min(F.struct("t", "start")).alias("f"))
    linked = many.join(first, ["p", "w"]).where(F.col("t") != F.col("f.t"))
    linked = linked.select(F.col("f.t").alias("a"), F.col("f.start").alias("a_start"), (F.col("f.start") + least).alias("a_end"), F.col("t").alias("b"), F.col("start").alias("b_start"), (F.col("start") + least).alias("b_end"))
    return few.unionByName(linked.distinct()).unionByName(_paired(many, least))


def _paired(many: DataFrame, least: int) -> DataFrame:
    """Every pair of different texts with an equal window, from (p, t, start, w), with one window for each pair.

    The windows that the same set of texts has are joined once, over cells of ``PART`` texts by ``PART``.
    """
    held = written(many.groupBy("p", "w", "t").agg(F.min("start").alias("start")), "held")
    sets = held.groupBy("p", "w").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("t").cast("decimal(38,0)")).alias("texts")).where("n > 1")
    one = sets.groupBy("n", "texts").agg(F.min(F.struct("p", "w")).alias("m")).select("m.p", "m.w", F.ceil(F.col("n") / PART).cast("int").alias("r"))
    side = held.join(one, ["p", "w"]).withColumn("i", F.pmod(F.xxhash64("t", F.lit("part")), F.col("r")).cast("int"))
    left = side.select("p", "w", "i", F.explode(F.sequence("i", F.col("r") - 1)).alias("j"), F.col("t").alias("a"), F.col("start").alias("a_start"))
    right = side.select("p", "w", F.explode(F.sequence(F.lit(0), "i")).alias("_i"), F.col("i").alias("j"), F.col("t").alias("b"), F.col("start").alias("b_start")).withColumnRenamed("_i", "i")
    met = left.join(right, ["p", "w", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    swap = F.col("a") > F.col("b")
    x, y = F.struct("a", "a_start"), F.struct(F.col("b").alias("a"), F.col("b_start").alias("a_start"))
    met = met.select(F.when(swap, y).otherwise(x).alias("x"), F.when(swap, x).otherwise(y).alias("y"))
    pairs = met.groupBy(F.col("x.a").alias("a"), F.col("y.a").alias("b")).agg(F.min(F.struct("x.a_start", F.col("y.a_start").alias("b_start"))).alias("at"))
    return pairs.select("a", "at.a_start", (F.col("at.a_start") + least).alias("a_end"), "b", "at.b_start", (F.col("at.b_start") + least).alias("b_end"))


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 300) -> tuple[DataFrame, DataFrame]:
    """(membership, spans): classes of equal texts and the spans that different texts have in common.

    membership: id, s (the class), chars, for texts of at least ``least`` characters (code points).
    spans: a, a_start, a_end, b, b_start, b_end with classes a and b: for every pair of different
    texts with a common span of ``least`` or more characters at least one such span, and for each
    text together all characters that it shares in such spans. Null, empty and
    shorter texts give no row. A text that is repeated within itself only is not shared.
    """
    if least < 3:
        raise ValueError("least must be 3 or more")
    width = least // 3
    shards = max(1, math.ceil(docs.count() / SHARD_TEXTS))
    base = docs.where(F.length(text) >= least).select(F.col(key).alias("id"), F.xxhash64(text).alias("t"), F.length(text).alias("chars"), F.col(text).alias("text"))
    found = written(phrases(base, width, least - width + 1, shards), "phrases")
    met = found.where("h is not null").groupBy("h").agg(F.min("t").alias("x"), F.max("t").alias("y"), F.min(F.struct("t", "pos")).alias("at"), F.first("anchor").alias("anchor"))
    confirmed = written(met.where("x != y").select("at.t", "at.pos", "anchor"), "confirmed")
    holders = confirmed.select("t").distinct()
    named = base.join(F.broadcast(holders) if holders.count() <= HOLDERS else holders, "t", "left_semi").select("t", "text").mapInArrow(_once, "t bigint, text string")
    strings = named.join(confirmed, "t").select("anchor", F.substring("text", F.col("pos") + 1, F.lit(width)).alias("phrase"))
    anchors = found.where("h is null").select(F.col("t").alias("shard"), "anchor")
    routed = anchors.join(strings, "anchor").select("shard", "phrase").distinct()
    texts = base.select("t", "text").mapInArrow(_once, "t bigint, text string").select(F.pmod("t", F.lit(shards)).alias("shard"), "t", "text")
    occ = written(occurrences(texts, routed, width, least - width), "occurrences")
    return base.select("id", F.col("t").alias("s"), "chars"), extended(occ, width, least)


def span_pairs(membership: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every two documents with a common span."""
    pairs = pairs_of(membership, spans.select("a", "b").distinct())
    return pairs.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


def shares(membership: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document that shares text: id, copies, texts, chars, shared_chars, share.

    shared_chars counts characters inside spans that another document has too; an exact copy shares all.
    ``texts`` is the number of other texts linked to the document's.
    """
    spans = written(spans, "spans")
    sides = spans.select(F.col("a").alias("s"), F.col("b").alias("o"), F.col("a_start").alias("x"), F.col("a_end").alias("y")).unionAll(spans.select(F.col("b").alias("s"), F.col("a").alias("o"), F.col("b_start").alias("x"), F.col("b_end").alias("y")))
    runs = sides.select("s", "x", "y").distinct().groupBy("s").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("r"))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "r", start,
        lambda acc, r: F.struct((acc["total"] + F.greatest(F.lit(0), r["y"] - F.greatest(r["x"], acc["end"]))).cast("int").alias("total"), F.greatest(acc["end"], r["y"]).alias("end")),
        lambda acc: acc["total"],
    )
    linked = sides.select("s", "o").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("texts"))
    classes = membership.groupBy("s").agg(F.count(F.lit(1)).alias("copies"))
    per = classes.join(runs.select("s", covered.alias("covered")), "s", "left").join(linked, "s", "left").where((F.col("copies") > 1) | F.col("covered").isNotNull())
    shared = F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.col("covered"))
    return membership.join(per, "s").select("id", "copies", F.coalesce("texts", F.lit(0)).alias("texts"), "chars", shared.alias("shared_chars"), F.round(shared / F.col("chars"), 6).alias("share"))
