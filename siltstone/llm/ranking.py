"""One ranking from several differently-scaled scores: Borda count with a majority head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.cut import written
from siltstone.plans.ranks import average_ranks

BLOCK, HEAD = 64, 3
PART = 1000  # items of a list that one task compares with as many others
WINDOW = 100_000  # rows of a group that one task may sort


def candidates(df: DataFrame, group: list[str], item: str, scores: dict[str, bool]) -> DataFrame:
    """One row per (group, item): of repeated rows, the best value of each score; NaN becomes null."""
    best = []
    for name, high in scores.items():
        v = F.col(name).cast("double")
        v = F.when(F.isnan(v), None).otherwise(v)
        best.append((F.max(v) if high else F.min(v)).alias(name))
    return df.groupBy(*group, item).agg(*best)


def borda(cands: DataFrame, group: list[str], item: str, scores: dict[str, bool], weights: dict[str, float] | None, most: int) -> DataFrame:
    """group + item, points: per score, size of the group minus the competition rank with averaged ties.

    A missing score gets the middle rank (n + 1) / 2 of its group. All scores are ranked at once in
    long form, negated where smaller is better. Where the largest group has more than ``WINDOW``
    rows, ranks are made without putting a whole group into one task (``siltstone.plans.ranks``).
    """
    weight = {c: (weights or {}).get(c, 1.0) for c in scores}
    each = F.array(*[F.struct(F.lit(c).alias("k"), (F.col(c) if high else -F.col(c)).alias("v"), F.lit(weight[c]).alias("w")) for c, high in scores.items()])
    long = cands.select(*group, item, F.explode(each).alias("s")).select(*group, item, "s.k", "s.v", "s.w")
    if most <= WINDOW:
        place = F.rank().over(Window.partitionBy(*group, "k").orderBy(F.col("v").desc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*group, "k", "v"))
        n = F.count(F.lit(1)).over(Window.partitionBy(*group, "k"))
        ranked = long.select("*", place.alias("r"), n.alias("n"), ties.alias("t"))
        rank = F.col("r") + (F.col("t") - 1) / 2.0
    else:
        made = average_ranks(long, [*group, "k"], "v", True, "r").select(*[F.col(c).alias(f"_{c}") for c in group], F.col("k").alias("_k"), F.col("v").alias("_v"), "r")
        sizes = cands.groupBy(*[F.col(c).alias(f"_n_{c}") for c in group]).agg(F.count(F.lit(1)).alias("n"))
        ranked = long.join(sizes, [long[c].eqNullSafe(sizes[f"_n_{c}"]) for c in group])
        ranked = ranked.join(made, [long[c].eqNullSafe(made[f"_{c}"]) for c in group] + [long["k"] == made["_k"], long["v"] == made["_v"]], "left").select(*[long[c] for c in (*group, item, "k", "v", "w")], "n", "r")
        rank = F.col("r")
    points = F.col("w") * (F.col("n") - F.when(F.col("v").isNull(), (F.col("n") + 1) / 2.0).otherwise(rank))
    return ranked.groupBy(*group, item).agg(F.sum(points).alias("points"))


def _fields(scores: dict[str, bool]) -> list[Column]:
    """f0, f1, ..: the scores, greater is better, null below every value."""
    return [F.coalesce(F.col(c) if high else -F.col(c), F.lit(float("-inf"))).alias(f"f{k}") for k, (c, high) in enumerate(scores.items())]


def _beats(y: Column, x: Column, fields: int) -> Column:
    """Whether y is better than x in more than half of the fields."""
    won: Column = F.lit(0)
    for k in range(fields):
        won = won + (y[f"f{k}"] > x[f"f{k}"]).cast("int")
    return won >= fields // 2 + 1


def _against_leaders(left: DataFrame, group: list[str], fields: int) -> DataFrame:
    """``left`` without items that HEAD of their list's leaders (by each field, ties by the others) beat."""
    orders = F.array(*[F.struct(F.lit(k).alias("k"), F.struct(*[F.col(f"c.f{(k + i * step) % fields}").alias(f"v{i}") for i in range(fields)]).alias("v")) for k in range(fields) for step in (1, fields - 1)])
    keyed = left.select(*group, "c", F.explode(orders).alias("o"))
    place = F.row_number().over(Window.partitionBy(*group, "o.k").orderBy(F.col("o.v").desc(), "c.item"))
    leaders = keyed.withColumn("_place", place).where(F.col("_place") <= BLOCK // 4).groupBy(*group).agg(F.collect_set("c").alias("_leaders"))
    kept = F.size(F.filter("_leaders", lambda y: _beats(y, F.col("c"), fields))) < HEAD
    return left.join(leaders, group).where(kept).select(*group, "c")


def _counted(left: DataFrame, group: list[str], fields: int) -> DataFrame:
    """``left`` without items that HEAD others of their list beat, every two compared in cells of PART by PART."""
    sizes = left.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_r"))
    side = left.join(sizes, group).withColumn("_k", F.pmod(F.xxhash64("c.item"), F.col("_r")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_r") - 1))
    x = side.select(*group, F.col("_k").alias("_x"), every.alias("_y"), F.col("c").alias("_own"))
    y = side.select(*group, every.alias("_x"), F.col("_k").alias("_y"), F.col("c").alias("_other"))
    lost = x.join(y, [*group, "_x", "_y"]).where(_beats(F.col("_other"), F.col("_own"), fields))
    lost = lost.groupBy(*group, F.col("_own.item").alias("_item")).count().where(F.col("count") >= HEAD).select(*group, "_item")
    return left.withColumn("_item", F.col("c.item")).join(lost, [*group, "_item"], "left_anti").drop("_item")


def majority_head(cands: DataFrame, group: list[str], item: str, scores: dict[str, bool], most: int) -> DataFrame:
    """The items that fewer than ``HEAD`` others beat in most scores, found by elimination in blocks.

    x is beaten by y if y is better in more than half of the scores; a null is worse than any value.
    Where a set of HEAD items exists whose members each beat every other item, its members are
    beaten by fewer than HEAD items (each other) and all others by HEAD or more. Losses only grow
    when more items are seen, so an item with HEAD losses inside any block of at most about BLOCK
    items can go; the members stay in every round, and meet the rest in the last. A list of any
    length is thus reduced by rounds of small blocks, and no list is gathered in one task. Where
    ties keep a round from reducing the largest list, the rest is compared with the leaders of its
    list and, if that does not help, every two items are, in cells. A list that still keeps more
    than a head has no such set and no head; the other lists keep theirs.
    """
    left = cands.select(*group, F.struct(*_fields(scores), F.col(item).alias("item")).alias("c"))

    def survivors(every: str) -> Column:
        return F.filter(every, lambda x: F.size(F.filter(F.col(every), lambda y: _beats(y, x, len(scores)))) < HEAD)

    def largest() -> int:
        return left.groupBy(*group).count().agg(F.max("count")).first()[0] or 0

    while most > BLOCK:
        salted = left.withColumn("_salt", F.pmod(F.xxhash64("c.item", F.lit(most)), F.lit(-(-most // BLOCK) * 2)))
        left = written(salted.groupBy(*group, "_salt").agg(F.collect_list("c").alias("_all")).select(*group, F.explode(survivors("_all")).alias("c")), "head")
        before, most = most, largest()
        if most > max(BLOCK, 0.9 * before):
            left = written(_against_leaders(left, group, len(scores)), "head")
            before, most = most, largest()
            if most > max(BLOCK, 0.9 * before):
                left = written(_counted(left, group, len(scores)), "head")
                # All losses are counted: a list with more items left than a block has no head.
                short = left.groupBy(*group).count().where(F.col("count") <= BLOCK).select(*group)
                left = left.join(short, group, "left_semi")
                break
    last = left.groupBy(*group).agg(F.collect_list("c").alias("_all")).select(*group, survivors("_all").alias("_left"))
    return last.where(F.size("_left") <= HEAD).select(*group, F.explode("_left.item").alias(item))


def checked_heads(cands: DataFrame, scored: DataFrame, group: list[str], item: str, scores: dict[str, bool]) -> DataFrame:
    """One row per group: the first ``HEAD`` items by points, and whether each beats every other item in most scores."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.round("points", 6).desc(), item))
    first = scored.select(*group, item, place.alias("_place")).where(F.col("_place") <= HEAD).select(*group, item)
    rows = cands.select(*group, F.struct(*_fields(scores), F.col(item).alias("item")).alias("c"))
    heads = first.join(rows.withColumn(item, F.col("c.item")), [*group, item]).groupBy(*group).agg(F.collect_list("c").alias("_head"))
    met = rows.join(heads, group)
    right = F.exists("_head", lambda y: y["item"] == F.col("c.item")) | F.forall("_head", lambda y: _beats(y, F.col("c"), len(scores)))
    return met.groupBy(*group).agg(F.min(right).alias("right"), F.first("_head.item").alias("head"))


def fused_ranking(df: DataFrame, group: list[str], item: str, scores: dict[str, bool], weights: dict[str, float] | None = None) -> DataFrame:
    """One ranking per group: columns group + item, points, in_head, position (from 1).

    ``scores`` maps each score to whether greater is better. Order: Borda points, then the item's
    identifier. The first ``HEAD`` items are checked against all others; only in a list where one of
    them does not beat every other item in most scores the majority head is put first instead.
    Repeated rows count once; null and NaN scores take the middle rank for points and lose to every
    value in the head; a group with all scores null is ordered by identifier; rows without a group
    key or item are left out; an empty table gives an empty ranking. Other columns are ignored.
    """
    known = df.where(F.col(item).isNotNull())
    for c in group:
        known = known.where(F.col(c).isNotNull())
    cands = written(candidates(known, group, item, scores), "fusion")
    most = cands.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    counted = written(borda(cands, group, item, scores, weights, most), "points")
    checked = written(checked_heads(cands, counted, group, item, scores), "checked")
    head = checked.where("right").select(*group, F.explode("head").alias(item))
    failed = cands.join(checked.where("not right").select(*group), group, "left_semi")
    if (larger := failed.groupBy(*group).count().agg(F.max("count")).first()[0]) is not None:
        head = head.unionByName(majority_head(failed, group, item, scores, larger))
    scored = counted.join(head.withColumn("in_head", F.lit(True)), [*group, item], "left").withColumn("in_head", F.coalesce("in_head", F.lit(False)))
    if most <= WINDOW:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("in_head").desc(), F.round("points", 6).desc(), item))
        return scored.select(*group, item, "points", "in_head", place.alias("position"))
    reach = 2.0 * most * sum((weights or {}).get(c, 1.0) for c in scores)
    scored = written(scored.withColumn("_key", F.round(F.col("points") + F.when(F.col("in_head"), reach).otherwise(0.0), 6)), "scored")
    placed = average_ranks(scored, group, "_key", True, "_place").withColumn("_first", F.col("_place") - (F.col("_place_ties") - 1) / 2.0)
    tie = F.row_number().over(Window.partitionBy(*group, "_key").orderBy(item))
    return scored.join(placed, [*group, "_key"]).withColumn("position", (F.col("_first") + tie - 1).cast("int")).select(*group, item, "points", "in_head", "position")
