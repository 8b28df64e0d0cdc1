import itertools
import random

import pytest

from siltstone.llm import neardup as D
from siltstone.llm.text import words

WORDS = [f"w{i}" for i in range(3000)]


def corpus(seed, n=160):
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    texts = []
    for i in range(n):
        if i % 3 and texts:
            own = texts[rnd.randrange(len(texts))].split()
            for _ in range(rnd.randrange(25)):
                own[rnd.randrange(len(own))] = rnd.choice(WORDS)
            if rnd.random() < 0.3:
                rnd.shuffle(own)
            if rnd.random() < 0.3:
                own += rnd.sample(WORDS, rnd.randrange(20))
        else:
            own = rnd.sample(common, 15) + rnd.sample(WORDS, rnd.randrange(26, 90))
        texts.append(" ".join(own))
    return [(f"i{k:04d}", t, "x") for k, t in enumerate(texts)]


def brute(rows, t=0.7, least=40):
    sets = {k: set(words(x)) for k, x, _ in rows if x}
    sets = {k: v for k, v in sets.items() if len(v) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12}


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 7)])
def test_pairs_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(D, "HOT", hot)
    rows = corpus(seed)
    rows += [("dup1", rows[0][1], ""), ("dup1", rows[0][1], ""), ("dup2", rows[0][1].upper(), ""), ("null", None, ""), ("blank", " ", ""), ("short", "a b c", "")]
    df = spark.createDataFrame(rows, "id string, content string, s string")
    members, links = D.near_duplicates(df)
    got = {(r[0], r[1]) for r in D.pairs_of(members, links).collect()}
    assert got == brute(rows) and len(got) > 30
    groups = {r["id"]: r["group"] for r in D.groups_of(members, links).collect()}
    parent = {k: k for k in groups}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in got:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert groups == {k: root(k) for k in groups}


def test_large_class_becomes_a_star(spark):
    rows = corpus(3, 3)
    rows = [(f"k{i:03d}", rows[0][1], "") for i in range(12)] + [("near", rows[0][1] + " one more", "")]
    df = spark.createDataFrame(rows, "id string, content string, s string")
    members, links = D.near_duplicates(df)
    got = {tuple(r) for r in D.pairs_of(members, links, expand=5).collect()}
    assert got == {("k000", f"k{i:03d}") for i in range(1, 12)} | {("k000", "near")}
    assert D.pairs_of(*D.near_duplicates(df.limit(0))).count() == 0


@pytest.mark.parametrize("part", [1000, 50])
def test_large_class_of_different_texts_gives_every_pair(spark, monkeypatch, part):
    rnd, own = random.Random(4), WORDS[:60]
    rows = [(f"k{i:03d}", " ".join(rnd.sample(own, 60)), "") for i in range(220)] + [("near", " ".join(own) + " one more", ""), ("near2", "more one " + " ".join(own), "")]
    monkeypatch.setattr(D, "PART", part, raising=False)
    members, links = D.near_duplicates(spark.createDataFrame(rows, "id string, content string, s string"))
    true = brute(rows)
    assert len(true) == 222 * 221 // 2 and {tuple(r) for r in D.pairs_of(members, links).collect()} == true
    if part == 50:  # other texts with the same words are no copies
        assert {tuple(r) for r in D.pairs_of(members, links, expand=5).collect()} == true


def test_word_shingles(spark):
    base = " ".join(f"t{i}" for i in range(100))
    df = spark.createDataFrame([("a", base, ""), ("b", base.replace("t50", "zz"), ""), ("c", " ".join(reversed(base.split())), "")], "id string, content string, s string")
    members, links = D.near_duplicates(df, 0.8, 5, 1)
    assert {tuple(r) for r in D.pairs_of(members, links).collect()} == {("a", "b")}
