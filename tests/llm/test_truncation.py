import pytest

from siltstone.llm import truncation as T

SENTENCE = "The wide market of Norhaven was opened by a society in 1820, although most of the trade has moved to the coast. "


def found(spark, rows):
    df = spark.createDataFrame([(k, d, i, t, "x") for k, d, i, t in rows], "id string, document_id string, chunk_index int, content string, word string")
    return {r["id"]: r["evidence"] for r in T.truncated(df).collect()}


def test_sentences_marks_and_complete_texts(spark):
    rows = [
        ("full", "d", 0, SENTENCE * 2), ("cut", "d", 1, (SENTENCE * 2)[:150]), ("dots", "d", 2, SENTENCE + "The next day it wa..."), ("square", "d", 3, SENTENCE + "The ol [...]"), ("broken", "d", 4, SENTENCE + "Today th�"),
        ("label", "d", 5, "See also"), ("none", "d", 6, None), ("blank", "d", 7, "​ \n"), ("signed", "d", 8, SENTENCE.strip() + " (Marta Kell, 1820)"), ("note", "d", 9, SENTENCE.strip() + " [12]"), ("quote", "d", 10, '"It was the market," she said, "and so we let the boats go."'),
        ("numbers", "d", 11, "12% 85/ 910. 44, 7 - 23 610, 88% 34/ 5. 701 - 66, 213% 9/ 48 - 39"), ("full", "d", 0, SENTENCE * 2), (None, None, None, SENTENCE),
    ]
    out = found(spark, rows)
    assert {k for k, v in out.items() if v} == {"cut", "dots", "square", "broken"}
    assert out["cut"] in ("longer copy", "sentence") and out["dots"] == "mark"


def test_longer_copies_decide_for_lists(spark):
    items = "\n".join(f"- painted bridge of Lindby{c}" for c in "abcdef")
    rows = [("long", "a", 0, items), ("inside", "b", 0, items[: items.rfind("bridge") + 3]), ("between", "c", 0, items[: items.rfind("\n")]), ("row", "d", 0, "a,1,xx,yy\nb,2,xx,yy\nc,3,xx,yy\nd,4,x")]
    out = found(spark, rows)
    assert out["inside"] == "longer copy" and out["between"] is None and out["long"] is None and out["row"] == "item"


def test_unsorted_text_is_read_by_its_longer_copy_mark_and_word(spark):
    table = "| 2001 | Berlin | 3.5 | 10 |\n| 2002 | Pari"
    rows = [("cut", "a", 0, table), ("long", "b", 0, table + "s | 4 |"), ("whole", "c", 0, table + "s | 4 |\n"), ("marked", "d", 0, "| 2011 | Wien | 3.5 | 10 |\n| 2012 | Prag [...]"), ("odd", "e", 0, "12% 85/ 910. 44, 7 - 23 610, 88% 34/ 5. 701 - 66, 213% 9/ 48 - 39")]
    rows += [("sentence", "f", 0, "The trade of Kirkwallen was opened by a society in 1820."), ("word", "g", 0, "| 2021 | Rom | 3.5 | 10 |\n| 2022 | Kirkwal")]
    out = found(spark, rows)
    assert out == {"cut": "longer copy", "long": None, "whole": None, "marked": "mark", "odd": None, "sentence": None, "word": "word"}


def test_a_short_text_cut_inside_a_word(spark):
    rows = [("short", "a", 0, "Northgate Works fell sharpl"), ("long", "b", 0, "Northgate Works fell sharply at the end."), ("label", "c", 0, "Early life"), ("heading", "d", 0, "Early life and work")]
    assert {k: v for k, v in found(spark, rows).items() if v and k != "long"} == {"short": "longer copy"}


def test_windows_that_go_on_are_no_cases(spark):
    words = (SENTENCE * 6).split()
    rows = [("w0", "d", 0, " ".join(words[:50])), ("w1", "d", 1, " ".join(words[26:76])), ("last", "d", 2, " ".join(words[52:100]))]
    assert {k for k, v in found(spark, rows).items() if v} == {"last"}


@pytest.mark.parametrize("leads", [1_000_000, 3])
def test_longer_copies_equal_brute_force(spark, monkeypatch, leads):
    monkeypatch.setattr(T, "LEADS", leads)
    monkeypatch.setattr(T, "ORDERED", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        base = "".join(chr(97 + i % 26) for i in range(40))
        texts = [base + "x" * k for k in range(60)] + ["Northgate Works fell sharply", "Northgate Wor", "Northgate", "North", "Nor th", "Nor", "other words here", "Northgate Works"]
        df = spark.createDataFrame([(str(i), "d", i, t) for i, t in enumerate(texts)], "id string, document_id string, chunk_index int, content string")
        ends = T.readings(df).where("w is null").drop("w", "n")
        got = {r["core"] for r in T.continuations(df, ends).collect()}
        goes_on = lambda t, x: x.startswith(t) and x != t and (len(t) >= T.LEAST_PREFIX or (t[-1] + x[len(t)]).isalnum())
        assert got == {T._hash(t) for t in texts if any(goes_on(t, x) for x in texts)} and T._hash("North") in got and T._hash("Northgate Works") not in got
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rates_and_empty(spark):
    df = spark.createDataFrame([("a", "d", 0, SENTENCE), ("b", "d", 1, SENTENCE[:60])], "id string, document_id string, chunk_index int, content string")
    docs = spark.createDataFrame([("d", '{"source": " Wire "}'), ("d", '{"source": " Wire "}'), ("e", None)], "id string, metadata string")
    assert [tuple(r) for r in T.rates(T.truncated(df), docs).collect()] == [("wire", 2, 1, 0.5)]
    assert T.truncated(df.limit(0)).count() == 0
