import random

import pytest

from siltstone.llm import spans as S


def corpus(seed):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice("abcde é\n") for _ in range(n))
    shared = [make(n) for n in (299, 300, 301, 450, 900)]
    docs = [make(rnd.randrange(50, 1500)) for _ in range(40)]
    for i in range(40):
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(docs[i]))
            docs[i] = docs[i][:at] + rnd.choice(shared) + docs[i][at:]
    return [(i, t, "x") for i, t in enumerate(docs)]


def brute(rows, least=300):
    where: dict = {}
    for i, t, _ in rows:
        for p in range(len(t or "") - least + 1):
            where.setdefault(t[p : p + least], set()).add(i)
    return {(a, b) for own in where.values() for a in own for b in own if a < b}, where


@pytest.mark.parametrize(("seed", "direct"), [(1, 64), (2, 3)])
def test_pairs_and_shares_equal_brute_force(spark, monkeypatch, seed, direct):
    monkeypatch.setattr(S, "DIRECT", direct)
    monkeypatch.setattr(S, "SHARD_TEXTS", 5)
    rows = corpus(seed)
    rows += [(90, rows[0][1] + "q" * 300, ""), (91, rows[0][1] + "q" * 300, ""), (92, None, ""), (93, "", ""), (94, "z" * 700, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, s string")
    members, spans = S.shared_spans(df)
    true, where = brute(rows)
    got = {tuple(r) for r in S.span_pairs(members, spans).collect()}
    assert got == true
    texts = {i: t for i, t, _ in rows}
    expect = {}
    for window, own in where.items():
        if len(own) > 1:
            for i in own:
                at = texts[i].find(window)
                while at >= 0:
                    expect.setdefault(i, set()).update(range(at, at + 300))
                    at = texts[i].find(window, at + 1)
    assert {r["id"]: r["shared_chars"] for r in S.shares(members, spans).collect()} == {i: len(v) for i, v in expect.items()}


def test_a_frequent_span_gives_every_pair(spark, monkeypatch):
    rnd = random.Random(5)
    make = lambda n: "".join(rnd.choice("abcde é\n") for _ in range(n))
    notice, other = make(450), make(320)
    docs = [make(60) + notice + make(60) + (other if i % 3 == 0 else "") + make(20) for i in range(S.DIRECT + 14)]
    docs += [make(40) + notice[:310] + make(80) for _ in range(9)]
    rows = [(i, t, "") for i, t in enumerate(docs)]
    true = brute(rows)[0]
    assert len(true) == len(docs) * (len(docs) - 1) // 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, s string")
    for part in (1000, 40):
        monkeypatch.setattr(S, "PART", part)
        members, spans = S.shared_spans(df)
        assert {tuple(r) for r in S.span_pairs(members, spans).collect()} == true
    texts = {i: t for i, t, _ in rows}
    names = {r["s"]: texts[r["id"]] for r in members.collect()}
    assert all(names[r["a"]][r["a_start"] : r["a_end"]] == names[r["b"]][r["b_start"] : r["b_end"]] for r in spans.limit(2000).collect())
    assert {r["texts"] for r in S.shares(members, spans).collect()} == {len(docs) - 1}


def test_every_occurrence_of_a_confirmed_phrase_is_located(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_TEXTS", 3)
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("abcde é\n") for _ in range(n))
    shared = make(400)
    docs = [make(300) + shared + make(300) for _ in range(4)]
    # These texts have only a part of the span: too little to pick its phrases, enough to hold some.
    docs += [make(290) + shared[i : i + 150] + make(290) for i in range(0, 250, 25)] + [make(700) for _ in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "t bigint, text string")
    located = []
    original = S.occurrences

    def spy(texts, routed, width, reach):
        located.append((original(texts, routed, width, reach), routed.select("phrase").distinct(), texts))
        return located[0][0]

    monkeypatch.setattr(S, "occurrences", spy)
    S.shared_spans(df, "t", "text")
    occ, strings, texts = located[0]
    text = {r["t"]: r["text"] for r in texts.collect()}
    phrases = [r[0] for r in strings.collect()]
    want = {(t, p) for t, x in text.items() for ph in phrases for p in range(len(x)) if x.startswith(ph, p)}
    assert len(text) == len(docs) and {(r["t"], r["pos"]) for r in occ.collect()} == want and len({t for t, _ in want}) > 6


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.span_pairs(*S.shared_spans(df)).count() == 0
