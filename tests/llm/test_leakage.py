from siltstone.llm.leakage import find_leaks

PASSAGE = "The wide market of Norhaven was opened by Marta Kell in 1820 after a long dispute about the price of salt and corn"


def test_exact_part_case_slots_and_none(spark):
    part = "But then: THE WIDE market of norhaven was, opened by Marta-Kell in 1820 after Easter."
    slots = PASSAGE.replace("Norhaven", "Lindby").replace("Marta Kell", "Ole Brandt").replace("1820", "1911")
    twice = "Kell gave Lind nine coins because Kell owed Lind money for salt"
    same = "Voss gave Brandt nine coins because Voss owed Brandt money for salt"
    wrong = same.replace("because Voss", "because Holm")  # one slot, two fillings
    docs = [(1, "x " + PASSAGE + " y"), (2, part), (3, slots), (4, wrong), (9, same), (5, None), (6, ""), (7, "the wide market of Norhaven was opened by Marta Kell in 1821"), (8, PASSAGE[:60])]
    df = spark.createDataFrame([(a, b, "t") for a, b in docs], "doc_id bigint, text string, item_id string")
    rows = find_leaks(df, [(10, PASSAGE), (11, PASSAGE), (12, None), (13, "too short"), (14, twice)]).collect()
    exact = {(r["doc_id"], r["item_id"]) for r in rows if r["kind"] == "exact"}
    assert exact == {(1, 10), (1, 11), (2, 10), (2, 11), (8, 10), (8, 11)}
    assert {r["doc_id"] for r in rows if r["kind"] == "slots"} >= {3, 7, 9} and 4 not in {r["doc_id"] for r in rows}
    whole = next(r for r in rows if r["doc_id"] == 1)
    assert whole["longest"] == 23 and whole["first_word"] == 1


def test_windows_do_not_cross_documents_and_empty_tables(spark):
    words = PASSAGE.split()
    df = spark.createDataFrame([(1, " ".join(words[:8])), (2, " ".join(words[8:16]))], "doc_id bigint, text string").coalesce(1)
    assert find_leaks(df, [(1, PASSAGE)]).count() == 0
    assert find_leaks(df.limit(0), [(1, PASSAGE)]).count() == 0 and find_leaks(df, []).count() == 0
