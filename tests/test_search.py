import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluation as E
from siltstone.operators import hybrid as H
from siltstone.operators import lexical as L
from siltstone.operators import vectors as V


def ranks(spark, rows, name="chunk"):
    return spark.createDataFrame(rows, f"query_id int, {name} string, rank int, score double")


def test_merge_order_and_provenance(spark):
    sem = ranks(spark, [(1, c, i + 1, 1.0) for i, c in enumerate(["c1", "c2", "c3"])] + [(1, "c1", 9, 0.1)])
    lex = ranks(spark, [(1, c, i + 1, 1.0) for i, c in enumerate(["c3", "c9", "c1"])])
    rows = H.merge(sem, lex, "query_id", "chunk").orderBy("candidate_rank").collect()
    assert [(r["chunk"], r["provenance"], r["semantic_rank"], r["lexical_rank"]) for r in rows] == [("c1", "both", 1, 3), ("c2", "semantic", 2, None), ("c3", "both", 3, 1), ("c9", "lexical", None, 2)]
    assert H.merge_summary(H.merge(sem, lex, "query_id", "chunk"), "query_id").first()[:] == (1, 4.0, 4, 4, 2.0)


@pytest.mark.parametrize(("exact", "found", "plain", "capped"), [("abcde", "abcde", (1.0, 1.0), (1.0, 1.0)), ("abcde", "edcba", (1.0, 0.722243), (1.0, 0.722243)), ("abcde", "abxyz", (0.4, 0.732455), (0.4, 0.732455)), ("abcde", "bacde", (1.0, 0.96407), (1.0, 0.96407)), ("abc", "cab", (None, 0.90369), (1.0, 0.817494))])
def test_recall_and_ndcg_by_hand(spark, exact, found, plain, capped):
    make = lambda x: ranks(spark, [(1, c, i + 1, 0.0) for i, c in enumerate(x)])
    for value, flag in ((plain, False), (capped, True)):
        r = E.ranking_metrics(make(exact), make(found), "query_id", "chunk", [5], flag).first()
        assert r["recall"] == value[0]
        assert flag or value[0] is None or r["ndcg"] == pytest.approx(value[1], abs=2e-6)


def test_neighbours(spark):
    chunks = spark.createDataFrame([("D", i, f"i{i}", "s" if i < 2 else "t", f"text {i}") for i in range(4)], "document_id string, chunk_index int, id string, section_path string, content string")
    seeds = spark.createDataFrame([(1, 1, "D", 0), (1, 2, "D", 2), (1, 3, "D", 3), (1, 4, "D", 0), (1, 5, "D", None)], "query_id int, rank int, document_id string, chunk_index int")
    got = {r["rank"]: r["neighbour_indexes"] for r in H.neighbours(seeds, chunks, "query_id").collect()}
    assert got == {1: "0,1", 2: "1,2,3", 3: "2,3"}
    same = {r["rank"]: r["neighbour_indexes"] for r in H.neighbours(seeds, chunks, "query_id", same_section=True).collect()}
    assert same == {1: "0,1", 2: "2,3", 3: "2,3"}


def test_router_rows(spark):
    rows = {"What does HTTP 404 mean": "acronym,number", "Events of 1998": "number,date", "the runner's pace": "quoted_phrase", "call json.loads twice": "code_like_token", "why are people afraid of heights": "rare_exact_term", "Y2K scare": "", "why do rivers bend": ""}
    out = H.route(spark.createDataFrame([(q,) for q in rows], "query string")).collect()
    assert {r["query"]: r["matched_signals"] for r in out} == rows and all((r["selected_route"] == "hybrid") == bool(rows[r["query"]]) for r in out)
    both = H.routed(H.route(spark.createDataFrame([("Y2K scare",), ("Events of 1998",)], "query string")), {"hybrid": lambda d: d.select("query"), "semantic": lambda d: d.select("query", F.lit(1).alias("n"))})
    assert both.count() == 2


def test_fallback_and_rerank(spark):
    hits = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "y"), (2, "d", None)], "q int, c string, s string")
    assert {r["c"] for r in H.strategy_or_all(hits, "q", F.col("s") == "x").collect()} == {"a", "c", "d"}
    c = spark.createDataFrame([(1, "a", 1, "x y"), (1, "b", 2, "river length"), (1, "c", 3, "length of a river"), (1, "z", 30, "river length")], "q int, c string, rank int, t string")
    rows = H.rerank(c, "q", "c", H.overlap_score(F.lit("river length"), F.col("t")), 20, 2).orderBy("rank").collect()
    assert [(r["c"], r["original_rank"]) for r in rows] == [("b", 2), ("c", 3)]


def test_failure_ladder(spark):
    case = lambda recall, ft, fs, text, at, hs, q: (recall, ft, fs, text, at, hs, q)
    rows = [
        (case(1.0, "W", 0.5, "rain", "W", 0.5, "docker basics"), "healthy"), (case(0.6, "Weather", 0.5, "rain", "Weather", 0.5, "docker basics"), "corpus_gap"), (case(0.6, "Fire", 0.5, "x", "Fire", 0.4, "river length"), "semantic_ambiguity"),
        (case(0.6, "River", 0.5, "x", "Fire", 0.4, "river length"), "ann_miss"), (case(0.6, "River", 0.5, "x", "River", 0.5, "river length"), "minor_ranking_difference"), (case(0.2, "River", 0.5, "x", "River", 0.5, "river length"), "uncertain"), (case(None, None, None, None, None, None, None), "uncertain"),
    ]
    df = spark.createDataFrame([(*a, b) for a, b in rows], "r double, ft string, fs double, tx string, at string, hs double, q string, want string")
    out = df.select("want", E.failure_class(F.col("q"), F.col("r"), (F.col("ft"), F.col("fs"), F.col("tx")), (F.col("at"), F.col("hs"))).alias("got")).collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


DOCS = [(1, "Red mill", "the red mill by the river"), (2, "Farm", "a mill and a red barn"), (3, None, None), (4, "x", "red"), (4, "x", "red"), (None, "red", "mill")]
FIELDS = {"title": "A", "content": "C"}


def found(spark, docs, queries, how="match", fields=FIELDS, **options):
    df = spark.createDataFrame(docs, "id bigint, title string, content string") if isinstance(docs, list) else docs
    q = spark.createDataFrame(queries, "q bigint, query string")
    return {(r["q"], r["id"]): r["score"] for r in L.search(df, "id", fields, q, "q", how, **options).collect()}


def test_lexical(spark):
    assert found(spark, DOCS, [(9, "red mills"), (8, "the of"), (7, None)]) == {(9, 1): 2.4, (9, 2): 0.4}
    assert {k for k in found(spark, DOCS, [(9, "red mill")], "bm25")} == {(9, 1), (9, 2), (9, 4)}
    cd = found(spark, DOCS, [(9, "red mill")], "cover")
    assert set(cd) == {(9, 1), (9, 2)} and cd[9, 1] > cd[9, 2]
    assert found(spark, DOCS[:0], [(9, "red")]) == {} and found(spark, DOCS, []) == {} and found(spark, DOCS, [(1, "of")], "bm25") == {}
    fields = spark.createDataFrame([("T", None, '{"article_title": "M", "section_title": "S"}', "c"), (None, None, None, "c")], "title string, section_path string, metadata string, content string")
    assert [r["search_text"] for r in L.search_fields(fields).collect()] == ["T\nS\nc", "c"] and L.search_fields(fields, False).first()["title"] == "M"


def test_stems_and_forms():
    assert [L.stem(w) for w in ("ponies", "mills", "glass", "bus", "trees", "is", "1990s", "ties")] == ["pony", "mill", "glass", "bus", "tree", "is", "1990", "ty"]
    assert L.forms("pony") == ["pony", "ponys", "ponies"] and all(L.stem(f) == "mill" for f in L.forms("mill"))


def test_lexical_equals_brute_force_in_small_blocks(spark, monkeypatch):
    import math
    import random

    monkeypatch.setattr(L, "BLOCK", 7)
    monkeypatch.setattr(L, "PAIRS", 50)
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["mills", "mill"]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(4))), " ".join(rnd.choices(vocabulary, k=rnd.randrange(40)))) for i in range(80)]
    queries = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(4)))) for i in range(20)]
    bags = {i: [(L.stem(w), x) for t, x in ((t, 1.0), (c, 0.2)) for w in t.split()] for i, t, c in docs}
    n, average = len(bags), sum(map(len, bags.values())) / len(bags)
    df = {w: sum(any(a == w for a, _ in b) for b in bags.values()) for w in {L.stem(v) for v in vocabulary}}
    match, bm25 = {}, {}
    for q, text in queries:
        need = {L.stem(w) for w in text.split()}
        for i, bag in bags.items():
            own = [w for w, _ in bag]
            if need and need <= set(own):
                match[q, i] = round(sum(x for w, x in bag if w in need), 6)
            if need & set(own):
                bm25[q, i] = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / average)) for w in need & set(own))
    assert found(spark, docs, queries, k=1000) == pytest.approx(match, abs=2e-6)
    assert found(spark, docs, queries, "bm25", k=1000) == pytest.approx(bm25, abs=2e-6)
    few = found(spark, docs, queries, "bm25", k=3)
    assert set(few) <= set(bm25) and len(few) == sum(min(3, sum(a == q for a, _ in bm25)) for q, _ in queries)


def test_strategy_is_optional(spark):
    docs = spark.createDataFrame([(1, "t", "mill", '{"chunk_strategy": "a"}'), (2, "t", "mill", '{"chunk_strategy": "b"}'), (3, "t", "mill", None)], "id bigint, title string, content string, metadata string")
    assert set(found(spark, docs, [(1, "mill")])) == {(1, 1), (1, 2), (1, 3)} and set(found(spark, docs, [(1, "mill")], strategy="a")) == {(1, 1)}


def test_queries_ask_for_years_numbers_and_short_words(spark):
    assert [c.need for c in L.plain_query("Events of 1441 in Shuwick")] == [["event", "1441", "shuwick"]] and [c.need for c in L.plain_query("What is RAID or HNSW?")] == [["raid", "hnsw"]]
    assert L.plain_query("of the and") == [] and L.plain_query(None) == []
    assert set(found(spark, [(1, None, "Events in Shuwick"), (2, None, "Events of 1441 in Shuwick")], [(1, "Events of 1441 in Shuwick")])) == {(1, 2)}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    base = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    asked = base.where("id % 50 = 0").withColumnRenamed("id", "q")
    got: dict = {}
    for r in V.topk(base, "id", asked, "q", 5, dims=8).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {q: np.argsort(-(u @ u[q]), kind="stable")[:5].tolist() for q in range(0, 300, 50)}
    every = {(r["q"], r["id"]) for r in V.topk_cells(base, "id", asked, "q", 5, count=6, probes=6, dims=8).collect()}
    assert every == {(q, i) for q, own in got.items() for i in own}
    assert V.within(base, "id", asked, "q", 0.999, 5, dims=8).count() == 6 and V.topk(base.limit(0), "id", asked.limit(0), "q", 5, dims=8).count() == 0


def test_web_queries(spark):
    assert [(c.need, c.phrases, c.no, c.no_phrases) for c in L.web_query('red "old mill" -barn or corn -"wet hay"')] == [(["red", "old", "mill"], [[(0, "old"), (1, "mill")]], ["barn"], []), (["corn"], [], [], [[(0, "wet"), (1, "hay")]])]
    assert [c.need for c in L.web_query("a or b or c d")] == [["b"], ["c", "d"]] and L.web_query("-red") == [] and L.web_query("") == []
    docs = [(1, None, "the old mill sells red salt"), (2, None, "mill old red corn"), (3, None, "old mill red salt barn"), (4, None, "old mill red"), (5, None, "corn and wet hay"), (6, None, "wet corn hay"), (7, None, "city of light"), (8, None, "city light")]
    asked = [(1, 'red "old mill" -barn'), (2, "salt or barn or corn"), (3, 'corn -"wet hay"'), (4, '"city of light"'), (5, ""), (6, None)]
    want = {(1, 1), (1, 4), (2, 1), (2, 2), (2, 3), (2, 5), (2, 6), (3, 2), (3, 6), (4, 7)}
    for how in ("match", "cover"):
        assert set(found(spark, docs, asked, how, web=True)) == want


def test_hybrid_fields_are_filled_from_the_lexical_row(spark):
    sem = spark.createDataFrame([(1, "a", 1, 0.5, None, "s"), (1, "b", 2, 0.4, "B", "s")], "q int, id string, rank int, score double, title string, section string")
    lex = spark.createDataFrame([(1, "a", 1, 2.0, "A", "x"), (1, "c", 2, 1.0, "C", None)], "q int, id string, rank int, score double, title string, section string")
    rows = [(r["id"], r["title"], r["section"], r["provenance"], r["candidate_rank"]) for r in H.merge(sem, lex, "q", "id", ["title", "section"]).orderBy("candidate_rank").collect()]
    assert rows == [("a", "A", "s", "both", 1), ("b", "B", "s", "semantic", 2), ("c", "C", None, "lexical", 3)]


def test_a_seed_without_neighbours_is_its_own_passage(spark):
    chunks = spark.createDataFrame([("D", 0, "i0", "s", "zero"), ("D", 1, "i1", None, "one")], "document_id string, chunk_index int, id string, section_path string, content string")
    seeds = spark.createDataFrame([(1, 1, "D", 0, "i0", "zero"), (1, 2, "gone", 7, "x", "text"), (1, 3, None, 1, "y", "text")], "q int, rank int, document_id string, chunk_index int, id string, content string")
    got = {r["rank"]: (r["neighbour_ids"], r["passage"]) for r in H.neighbours(seeds, chunks, "q").collect()}
    assert got == {1: ("i0,i1", "[chunk_index=0 section=s]\nzero\n\n[chunk_index=1 section=]\none"), 2: ("x", "[chunk_index=7 section=]\ntext")}


def test_lists_and_latency_parts(spark):
    df = spark.createDataFrame([([], ["b"], ["c"]), (None, None, []), (["a"], ["b"], None)], "a array<string>, b array<string>, c array<string>")
    assert [r[0] for r in df.select(H.first_list(F.col("a"), F.col("b"), F.col("c"))).collect()] == [["b"], [], ["a"]]
    times = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "a double, b double")
    assert E.latency_parts(times, {"a": "a", "b": "b"}).first().asDict() == {"queries": 2, "a_p50": 2.0, "a_p95": 2.9, "b_p50": 20.0, "b_p95": 29.0, "total_p50": 22.0, "total_p95": 31.9}
    assert E.short_latency(times.limit(0), "a").count() == 0


def test_approximate_search_reaches_its_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.7 * rng.standard_normal((3000, 16))
    base = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, embedding array<float>")
    asked = base.where("id % 50 = 0").withColumnRenamed("id", "q")
    pairs = lambda df: {(r["q"], r["id"]) for r in df.collect()}
    true, near = pairs(V.topk(base, "id", asked, "q", 10, dims=16)), pairs(V.topk_cells(base, "id", asked, "q", 10, dims=16))
    assert len(true & near) >= 0.9 * len(true)


def test_curves_and_summaries(spark):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, prob double")
    rows = [tuple(r) for r in E.roc_curve(scored, "label", "prob").orderBy(F.col("threshold").desc()).collect()]
    assert rows == [(0.9, 1, 1, 0.5, 0.5), (0.5, 2, 1, 1.0, 0.5), (0.1, 2, 2, 1.0, 1.0)]
    empty = scored.where(F.lit(False)).withColumn("ok", F.lit(True))
    assert E.run_summary(empty, "prob", "label", "ok", 1.0).first()["items_per_minute"] is None
    from siltstone.plans.benchmark import timed

    results, times = timed(spark, {"a": lambda: scored}, 2, 0)
    assert results["a"].count() == 4 and times.first()["count"] == 2
