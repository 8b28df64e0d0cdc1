import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import packing as P


def check(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r["container"], []).append((r["offset"], r["tokens"]))
    for own in by.values():
        at = 0
        for offset, size in sorted(own):
            assert offset >= at or size == 0
            at = max(at, offset + size)
        assert at <= capacity
    return len(by)


def test_packs_whole_items_and_merges_leftovers(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([0, 1, 40, 300, 700, 1024, 1025, 5000]) for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens int").repartition(7)
    rows = P.pack(df, "doc_id", 1024, open_windows=8, merge_rows=10).collect()
    assert sum(r["tokens"] for r in rows) == sum(sizes) and len({r["doc_id"] for r in rows}) == 900
    assert {r["doc_id"] for r in rows if r["parts"] > 1} == {i for i, s in enumerate(sizes) if s > 1024}
    used = check(rows, 1024)
    assert used <= -(-sum(sizes) // 1024) * 1.15


def test_null_text_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id bigint, text string")
    rows = P.pack(P.sizes_of(df, "doc_id", "text"), "doc_id", 10).collect()
    assert sorted((r["doc_id"], r["tokens"]) for r in rows) == [(1, 0), (2, 0), (3, 2), (3, 2)] and check(rows, 10) == 1
    assert P.pack(P.sizes_of(df.where(F.lit(False)), "doc_id", "text"), "doc_id", 10).count() == 0


def test_sizes_by_a_tokenizer_file(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id bigint, text string")
    assert {r[0]: r[1] for r in P.sizes_of(df, "doc_id", "text", path).collect()} == {1: 2, 2: 0}
