from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import splitting as S
from siltstone.llm.text import TOKEN, words


def rejoined(text, limit, overlap):
    tokens, out = TOKEN.findall(text), []
    own = list(S.pieces(text, limit, overlap))
    for i, (a, b, x, y) in enumerate(own):
        assert b - a <= limit and TOKEN.findall(text[x:y]) == tokens[a:b]
        assert i == 0 or a == own[i - 1][1] - overlap
        out += tokens[a if i == 0 else a + overlap : b]
    assert out == tokens
    return own


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["aa", "b.", "c,", "d!\"", "e", "\n\n", "f.\n", " g", "h\r\n"]), max_size=400), st.integers(5, 60))
def test_pieces_keep_every_token_and_limit(parts, limit):
    rejoined(" ".join(parts), limit, limit // 5)


def test_cuts_fall_on_sentences():
    text = " ".join(f"w{i}." if i % 10 == 9 else f"w{i}" for i in range(600))
    for _, b, _, _ in rejoined(text, 256, 24)[:-1]:
        assert b % 10 == 0


def test_no_boundary_and_edges():
    assert len(rejoined("x " * 257, 256, 24)) == 2
    assert list(S.pieces("", 10, 2)) == [] and list(S.pieces(" \n", 10, 2)) == []
    assert len(rejoined("x " * 256, 256, 24)) == 1
    assert TOKEN.findall("a\u00a0b c\u200b") == ["a\u00a0b", "c\u200b"] and words("\u00c9a_B1 x") == ["\u00e9a", "b1", "x"]


def test_operator(spark):
    long = " ".join(["word."] * 300)
    rows = [("a", "d", 0, "short"), ("b", "d", 1, long), ("b", "d", 1, long), ("c", "d", None, None), ("e", None, 2, " "), ("f", "d", 2, "tail")]
    df = spark.createDataFrame(rows, "id string, document_id string, chunk_index int, content string")
    out = S.split_oversized(df).collect()
    assert {r["id"] for r in out} == {"b"} and len(out) == 2 and all(r["tokens"] <= 256 for r in out)
    new = {(r["id"], r["piece"]): r["chunk_index"] for r in S.renumbered(df).collect()}
    own = sorted(v for (k, _), v in new.items() if k in "abcf")
    assert own == [0, 1, 2, 3, 4] and new[("b", 1)] == new[("b", 0)] + 1 and new[("f", 0)] == 4
    assert S.split_oversized(df.limit(0)).count() == 0
