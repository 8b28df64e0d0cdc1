from pyspark.sql import functions as F

from siltstone.functions import json as J
from siltstone.functions import numbers as N
from siltstone.functions import text as T
from siltstone.operators import chunking as C


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


def test_predicates(spark):
    assert one(spark, T.normalize, " a\r\n\r\n\r\n\tb  c \n") == "a\n\n b c"
    assert one(spark, T.folded, None) == "" and one(spark, T.folded, " A  b\n") == "a b"
    assert one(spark, T.alpha_ratio, "") == 0.0 and one(spark, T.alpha_ratio, "ab 1é") == 0.75
    assert one(spark, T.starts_lower, " éa") and not one(spark, T.starts_lower, "Aa") and not one(spark, T.starts_lower, None)
    assert one(spark, T.starts_punctuated, ", a") and not one(spark, T.starts_punctuated, "_a")
    assert one(spark, T.ends_mid_sentence, "no end") and not one(spark, T.ends_mid_sentence, 'end."') and not one(spark, T.ends_mid_sentence, " ")
    assert one(spark, T.starts_like_fragment, "However, it") and not one(spark, T.starts_like_fragment, "Mills are")
    assert one(spark, T.short_label, "a b") and not one(spark, T.short_label, "a b c d e f g h i.") and not one(spark, T.short_label, "")
    assert one(spark, lambda c: F.size(T.tokens(c)), " a  b\n") == 2 and one(spark, T.token_count, None) == 0
    assert one(spark, lambda c: F.array_join(T.keywords(c), " "), "What is the river/lake, length?") == "river lake length"
    assert one(spark, lambda c: T.preview(c, 3), "a\nbcd") == "a b..." and len(one(spark, lambda c: T.stable_id(c, F.lit(1)), "x")) == 16


def test_percentiles_by_hand(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 12)] + [(2, float(v)) for v in range(1, 5)], "g int, v double")
    rows = {r["g"]: r for r in df.groupBy("g").agg(N.interpolated(F.col("v"), 0.95).alias("i"), N.nearest_rank("v", 0.1).alias("n"), F.median("v").alias("m")).collect()}
    assert rows[1]["i"] == 10.5 and rows[1]["n"] == 2.0 and rows[2]["m"] == 2.5
    assert {r[0]: r[1] for r in N.upper_median(df, ["g"], "v").collect()} == {1: 6.0, 2: 3.0}
    assert spark.range(1).select(N.safe_ratio(F.lit(1), F.lit(0)), F.round(N.cost(F.lit(1_000_000), F.lit(500_000)), 9), N.cost(F.lit(None).cast("int"), F.lit(1))).first()[:] == (0.0, 1.2, None)


def test_structured_replies(spark):
    good = '{"summary": "s", "key_points": ["a","b","c"], "sentiment": "neutral", "entities": [], "why_it_matters": "w"}'
    cases = {
        f"text {good} more": "valid", "none": "output is not a JSON object", good[:-1] + ', "x": 1}': "keys mismatch", good.replace('"s"', '" "'): "summary must be a non-empty string",
        good.replace('["a","b","c"]', '"a"'): "key_points must be a list", good.replace('"a","b",', ""): "key_points must contain 3 to 5 items", good.replace('"a"', '" "'): "all key_points items must be non-empty strings",
        good.replace("neutral", "Neutral"): "sentiment is not allowed", good.replace("[]", "{}"): "entities must be a list", good.replace('"w"', "null"): "why_it_matters must be a non-empty string",
    }
    for text, fault in cases.items():
        assert one(spark, lambda c: J.summary_fault(J.embedded_object(c)), text) == fault
    assert one(spark, J.unfenced, '```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, J.string_list, "['a', 'b']") == ["a", "b"] and one(spark, J.string_list, None) == []


def test_fixed_windows_at_the_edges(spark):
    sizes = [0, 1, 255, 256, 257, 488, 489, 720, 721]
    df = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in sizes] + [(-1, None)], "n int, text string")
    got = {r[0]: r[1] for r in C.fixed_windows(df, "n", "text").groupBy("n").count().collect()}
    assert got == {1: 1, 255: 1, 256: 1, 257: 2, 488: 2, 489: 3, 720: 3, 721: 4}


PROSE = "The harbour was built in 1820 after a long dispute between two towns, and it is still used by small boats. " * 4


def test_sections_and_types():
    secs = C.sections_of("T", C.tidy(f"{PROSE}\nEarly Life\n{PROSE}\nReferences\nx\nTHE END\n- an item"))
    assert [s[0] for s in secs] == ["Introduction", "Early Life", "THE END"] and secs[1][1] == "T > Early Life"
    assert C.sections_of("T", "See also") == [("Full Article", "T", "See also")] and C.sections_of("T", "") == []
    assert C.kind_of("\n".join(["May 3 a thing"] * 2 + ["x y z"] * 5)) == "timeline" and C.kind_of("\n".join(["- item one"] * 12)) == "list" and C.kind_of("") == "article"
    assert not C.is_heading("a lower line") and C.is_heading("History of the Town") and not C.is_heading("The town was built.") and C.is_heading("see also")


def test_section_chunks(spark):
    long = "Every sentence here has exactly nine words in it. " * 80
    rows = [(1, "T", f"{long}\nEarly Life\nShort orphan"), (2, None, "orphan only"), (3, "T", None), (4, "T", " ")]
    out = C.section_chunks(spark.createDataFrame(rows, "k int, title string, text string"), "k", "title", "text").collect()
    own = sorted((r for r in out if r["k"] == 1), key=lambda r: r["chunk_index"])
    assert {r["k"] for r in out} == {1, 2} and all(r["token_count"] <= 256 for r in out) and own[-1]["is_orphan_repaired"]
    assert [r["prev_chunk_id"] for r in own] == [None] + [r["chunk_id"] for r in own[:-1]]
    assert own[0]["prev_context"] == "" and own[1]["prev_context"] == " ".join(own[0]["content"].split()[-18:]) and own[1]["embedding_text"].startswith("Title: T\n\nSection: T > Introduction\n\nPrevious context: Every")
    assert own[1]["embedding_token_count"] == len(own[1]["embedding_text"].split()) and own[1]["source_token_count"] == own[1]["token_count"]
    words = " ".join(r["content"] for r in own).split()
    assert words == (long + "Short orphan").split()


def test_text_builders(spark):
    assert one(spark, lambda c: C.overlap_text(c, 2), "a b  c\nd ") == "  c\nd" and one(spark, C.overlap_text, "") == "" and one(spark, C.overlap_text, None) is None
    build = lambda t, s, m, c: spark.createDataFrame([(t, s, m, c)], "t string, s string, m string, c string").select(T.hybrid_rerank_text(*map(F.col, "tsmc"))).first()[0]
    assert build("", None, '{"article_title": "A", "section_title": "S"}', "x") == "Title: A\n\nSection: S\n\nContent:\nx" and build(None, None, None, None) == "Content:\n"
    now = spark.range(1).select(T.iso_now()).first()[0]
    assert len(now) == 32 and now.endswith("+00:00") and now[10] == "T"


def test_links_and_distributed_ranks(spark):
    from siltstone.plans import ranks as K

    df = spark.createDataFrame([("d", i, f"c{i}") for i in (0, 1, 2, 5)], "document_id string, chunk_index int, chunk_id string")
    got = {r["chunk_id"]: (r["prev_chunk_id"], r["next_chunk_id"]) for r in C.linked(df, "document_id").collect()}
    assert got == {"c0": (None, "c1"), "c1": ("c0", "c2"), "c2": ("c1", "c5"), "c5": ("c2", None)}
    v = spark.createDataFrame([("k", i, float((i * 7) % 11)) for i in range(1, 41)], "k string, i int, v double")
    run = {r["i"]: (r["low"], r["high"], r["sum"]) for r in K.running(v, "k", "i", {"low": ("min", F.col("v"), False), "high": ("max", F.col("v"), True), "sum": ("sum", F.col("v"), True)}, 7).collect()}
    values = [float((i * 7) % 11) for i in range(1, 41)]
    assert all(run[i] == (min(values[: i - 1], default=None), max(values[:i]), sum(values[:i])) for i in range(1, 41))
    for rows in (5, 10_000):
        got = sorted((r["rn"], r["v"], r["i"]) for r in K.row_numbers(v, ["k"], "v", "i", "rn", bucket_rows=rows).collect())
        assert got == [(n + 1, *x) for n, x in enumerate(sorted(zip(values, range(1, 41))))]
