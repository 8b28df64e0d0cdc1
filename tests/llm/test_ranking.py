import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import ranking as R

SCORES = {"s": True, "r": True, "o": False}
DDL = "run string, q bigint, item string, s double, r double, o int, points string"


def brute(rows):
    def v(x):
        return (x[3] if x[3] is not None and x[3] == x[3] else float("-inf"), x[4] if x[4] is not None else float("-inf"), -x[5])

    return {x[2] for x in rows if sum(sum(a > b for a, b in zip(v(y), v(x))) >= 2 for y in rows) < 3}


def lists(n, seed):
    rnd = random.Random(seed)
    rows = [("a", seed, f"i{k:05d}", rnd.random(), rnd.random() * 1000, k + 1, "clash") for k in range(n)]
    for k in range(3):  # three that lead in two of three fields each
        rows[k] = ("a", seed, rows[k][2], 2.0 + k if k else None, 5000.0 + k, -3 + k, None)
    return rows


def test_small_lists_and_repeats(spark):
    rows = [x for k in range(5) for x in lists(9 + k, k)]
    out = R.fused_ranking(spark.createDataFrame(rows + rows[:4], DDL), ["run", "q"], "item", SCORES).collect()
    assert len(out) == len(rows)
    for k in range(5):
        own = [x for x in rows if x[1] == k]
        assert {r["item"] for r in out if r["q"] == k and r["position"] <= 3} == brute(own)
        assert sorted(r["position"] for r in out if r["q"] == k) == list(range(1, len(own) + 1))


def test_hot_list_takes_the_same_result(spark, monkeypatch):
    df = spark.createDataFrame(lists(700, 1) + lists(10, 2), DDL)
    plain = {(r["q"], r["item"]): (r["position"], round(r["points"], 6), r["in_head"]) for r in R.fused_ranking(df, ["run", "q"], "item", SCORES).collect()}
    monkeypatch.setattr(R, "WINDOW", 100)
    hot = {(r["q"], r["item"]): (r["position"], round(r["points"], 6), r["in_head"]) for r in R.fused_ranking(df, ["run", "q"], "item", SCORES).collect()}
    assert plain == hot and sum(v[2] for k, v in hot.items() if k[0] == 1) == 3


def tied(n, q):
    """Three leaders in all fields; the others tie in two of three."""
    own = [("a", q, f"i{k:05d}", None, None, k + 1, "") for k in range(n - 3)]
    return own + [("a", q, f"z{k}", 1.0 + k, 5.0 + k, -5 - k, "") for k in range(3)]


def beaten(n, q):
    """Three leaders whom Borda count does not put first: last in one field, best in the others."""
    own = [("a", q, f"i{k:05d}", float(n - k), float(n - k), k + 1, "") for k in range(n - 3)]
    return own + [("a", q, f"z{k}", 2.0 * n + k, 2.0 * n + k, n * 2 + k, "") for k in range(3)]


def test_ties_leave_the_head_of_every_list(spark):
    rows = tied(6500, 1) + beaten(9, 2) + lists(12, 3)
    cands = R.candidates(spark.createDataFrame(rows, DDL), ["run", "q"], "item", SCORES)
    got = {(r["q"], r["item"]) for r in R.majority_head(cands, ["run", "q"], "item", SCORES, 6500).collect()}
    assert got == {(q, k) for q in (1, 2) for k in ("z0", "z1", "z2")} | {(3, k) for k in brute(lists(12, 3))}


def test_counting_every_two_items(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 40)
    left = R.candidates(spark.createDataFrame(lists(300, 1) + lists(9, 2), DDL), ["run", "q"], "item", SCORES)
    left = left.select("run", "q", F.struct(*R._fields(SCORES), "item").alias("c"))
    got = {(r["q"], r["item"]) for r in R._counted(left, ["run", "q"], 3).select("q", "c.item").collect()}
    assert got == {(q, k) for q, n in ((1, 300), (2, 9)) for k in brute(lists(n, q))}


def test_borda_first_and_repair_only_where_it_fails(spark, monkeypatch):
    asked = []
    plain = R.majority_head
    monkeypatch.setattr(R, "majority_head", lambda cands, *rest: asked.extend(r["q"] for r in cands.select("q").distinct().collect()) or plain(cands, *rest))
    own = beaten(9, 2)
    weights = {"s": 1.0, "r": 1.0, "o": 9.0}
    df = spark.createDataFrame(own + lists(12, 3), DDL)
    out = R.fused_ranking(df.where("q = 3"), ["run", "q"], "item", SCORES).collect()
    assert asked == [] and {r["item"] for r in out if r["position"] <= 3} == brute(lists(12, 3))
    out = R.fused_ranking(df.where("q = 2"), ["run", "q"], "item", SCORES, weights).collect()
    assert asked == [2] and {r["item"] for r in out if r["position"] <= 3} == brute(own)


def test_borda_by_hand_ties_nulls_and_empty(spark):
    rows = [("a", 1, "x", 1.0, None, 1, ""), ("a", 1, "y", 1.0, None, 2, ""), ("a", 1, "z", 0.0, 9.0, 3, ""), (None, 1, "n", 0.0, 9.0, 3, "")]
    df = spark.createDataFrame(rows, DDL)
    got = {r["item"]: r["points"] for r in R.fused_ranking(df, ["run", "q"], "item", SCORES).collect()}
    assert got == {"x": 1.5 + 1.0 + 2.0, "y": 1.5 + 1.0 + 1.0, "z": 0.0 + 2.0 + 0.0}
    assert R.fused_ranking(df.limit(0), ["run", "q"], "item", SCORES).count() == 0


@pytest.mark.parametrize("bucket", [3, 1000])
def test_average_ranks(spark, bucket):
    from siltstone.plans.ranks import average_ranks

    values = [5.0, 3.0, 3.0, 1.0, 9.0, 9.0, 9.0, 2.0, float("nan"), None]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {r["v"]: r["rank"] for r in average_ranks(df, ["g"], "v", True, "rank", bucket).collect()}
    assert got == {9.0: 2.0, 5.0: 4.0, 3.0: 5.5, 2.0: 7.0, 1.0: 8.0}
    assert average_ranks(df.where(F.lit(False)), ["g"], "v", True, "rank").count() == 0
