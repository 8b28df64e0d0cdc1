"""Filling containers of fixed capacity: bounded-space best-fit per partition, leftovers merged."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.text import token_count
from siltstone.plans.cut import written

#: Split pattern of the public byte-level BPE vocabularies (fixed value).
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Windows:
    """At most ``limit`` open containers of ``capacity``; ``emit`` is called with each that closes."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[tuple[int, int]] = []  # (space left, container), sorted
        self.closed: set[int] = set()
        self.count = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, offset) for an item of ``size`` <= capacity: best fit, else a new container."""
        k = bisect.bisect_left(self.free, (size, -1))
        if k < len(self.free):
            left, own = self.free.pop(k)
        else:
            if len(self.free) >= self.limit:
                self.closed.add(self.free.pop(0)[1])  # the fullest
            left, own = self.capacity, self.count
            self.count += 1
        offset = self.capacity - left
        if left == size:
            self.closed.add(own)
        else:
            bisect.insort(self.free, (left - size, own))
        return own, offset


def bpe_sizes(docs: DataFrame, key: str, text: str, path: str, pattern: str = BPE_PATTERN) -> DataFrame:
    """(key, tokens) by a tiktoken rank file at ``path``, which every executor must be able to read.

    Null texts have 0 tokens. The vocabulary is loaded once per worker and is not trained.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=[key, "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, tokens int")


def sizes_of(docs: DataFrame, key: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(key, tokens): white-space tokens, or those of the tokenizer file named."""
    return bpe_sizes(docs, key, text, tokenizer) if tokenizer else docs.select(key, token_count(F.col(text)).cast("int").alias("tokens"))


def pack(sizes: DataFrame, key: str, capacity: int = 1024, open_windows: int = 64, merge_rows: int = 20_000) -> DataFrame:
    """Assign items (key, tokens) to containers of ``capacity`` tokens.

    Columns: key, part (from 0), parts, first_token, tokens, container (string), offset. An item is
    split only if it exceeds the capacity: into full containers of its own and a rest that is
    placed like any item. Per partition ``open_windows`` containers are open; the best fit takes the
    item; if none fits, the fullest is closed. Containers still open at the end of a partition are
    themselves packed, in rounds of at most ``merge_rows`` per task, until one task has them all.
    Items of 0 tokens (null or blank text) take no space and share any container; a negative or
    null size counts as 0. Repeated rows are separate items. An empty table gives no rows.
    """
    kind = sizes.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name, windows, rows, marks = f"p{TaskContext.get().partitionId()}", Windows(capacity, open_windows), [], []
        full = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[key, "part", "parts", "first_token", "tokens", "container", "offset", "open"])

        for batch in batches:
            for item, size in zip(batch[key].tolist(), batch["tokens"].fillna(0).astype("int64").tolist(), strict=True):
                size = max(size, 0)
                parts = max(1, -(-size // capacity))
                for part in range(parts - 1):
                    rows.append((item, part, parts, part * capacity, capacity, f"{name}f{full}", 0, -1))
                    full += 1
                rest = size - (parts - 1) * capacity
                own, offset = windows.place(rest)
                rows.append((item, parts - 1, parts, (parts - 1) * capacity, rest, f"{name}w{own}", offset, own))
            if len(rows) > 50_000:
                yield out().assign(open=True)  # whether they are open is known from marks
                rows.clear()
        yield out().assign(open=True)
        yield pd.DataFrame([(None, -1, 0, 0, capacity - left, f"{name}w{own}", 0, True) for left, own in windows.free], columns=[key, "part", "parts", "first_token", "tokens", "container", "offset", "open"])

    schema = f"{key} {kind}, part int, parts int, first_token int, tokens int, container string, offset int, open boolean"
    placed = written(sizes.select(key, "tokens").mapInPandas(run, schema), "packed")
    items = placed.where("part >= 0").drop("open")
    left = placed.where("part < 0").select("container", F.col("tokens").alias("fill"))
    merged = merge_open(left, capacity, merge_rows)
    joined = items.join(merged, items["container"] == merged["_from"], "left")
    return joined.select(key, "part", "parts", "first_token", "tokens", F.coalesce("_to", "container").alias("container"), (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset"))


def merge_open(left: DataFrame, capacity: int, merge_rows: int) -> DataFrame:
    """(_from, _to, _shift): open containers (container, fill) packed into each other, fullest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat([*batches, pd.DataFrame({"container": [], "fill": []})]).sort_values(["fill", "container"], ascending=[False, True])
        windows, first, rows = Windows(capacity, len(own) + 1), {}, []
        for name, fill in zip(own["container"].tolist(), own["fill"].astype("int64").tolist(), strict=True):
            k, offset = windows.place(fill)
            rows.append((name, first.setdefault(k, name), offset, fill))
        yield pd.DataFrame(rows, columns=["_from", "_to", "_shift", "fill"])

    total = left.count()
    mapping = None
    while True:
        tasks = max(1, -(-total // merge_rows))
        spread = left.repartition(tasks) if tasks > 1 else left.coalesce(1)
        step = written(spread.mapInPandas(run, "_from string, _to string, _shift int, fill int"), "merged")
        if mapping is None:
            mapping = step.select("_from", "_to", "_shift")
        else:
            after = step.select(F.col("_from").alias("_mid"), F.col("_to").alias("_last"), F.col("_shift").alias("_more"))
            mapping = mapping.join(after, mapping["_to"] == after["_mid"]).select("_from", F.col("_last").alias("_to"), (F.col("_shift") + F.col("_more")).alias("_shift"))
        if tasks == 1:
            return mapping
        left = step.groupBy(F.col("_to").alias("container")).agg(F.sum("fill").cast("int").alias("fill"))
        before, total = total, left.count()
        if total > 0.9 * before:  # full already: what is left can't be merged much further
            return mapping
