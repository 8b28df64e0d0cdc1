from siltstone.llm import quality as Q
from siltstone.llm.examples import EXAMPLES


def test_classes_of_held_out_texts(spark):
    own = {
        "p1": ("prose", "When the mill closed, the miller went back to the town, where he was known for his bread. It is not clear why the river was moved before the war began."),
        "p2": ("prose", '"We could not sell the wool," wrote Anna Brandt, "and so we let the sheep go."\nThe roads were\nclosed in 1733, but most of the carts had been moved by then.'),
        "p3": ("prose", "Il ne reste que deux maisons dans ce village, mais elles ne sont pas encore vendues. La rivière est étroite et la gare voisine est plus ancienne."),
        "l1": ("list", "1. iron bridge\n2. Otto Lind (1700-1755)\n3. Marsby, 1640\n4. hills and farms\n5. sold barn near Kolby\n6. slate roof\n7. Ada Holm\n8. wool market of Sund"),
        "t1": ("table", "| Kolby | 1640 | slate | 12 |\n| Marsby | 1701 | iron | 7 |\n| Sund | 1733 | wool | 31 |\n| Lindby | 1755 | salt | 90 |"),
        "j1": ("junk", "12% 85/ 910. 44, 7 - 23 610, 88% 34/ 5. 701 - 66, 213% 9/ 48 - 390. 17, 52% 804/ 6 - 75"),
    }
    rows = [(k, t, None, 1) for k, (_, t) in own.items()] + [("e", "", 0, 1), ("n", None, None, 1), ("b", " \n", 5, 1), ("p1", own["p1"][1], None, 1), ("h", "History", 1, 1)]
    rows += [(f"x{i}", t, None, 1) for i, (_, _, t) in enumerate(EXAMPLES * 3)]
    out = {r["id"]: r for r in Q.assessed(spark.createDataFrame(rows, "id string, content string, token_count int, kind int")).collect()}
    assert len(out) == len({r[0] for r in rows})
    assert {k: out[k]["kind"] for k in own} == {k: c for k, (c, _) in own.items()}
    assert out["e"]["tokens"] == out["n"]["tokens"] == out["b"]["tokens"] == 0 and out["e"]["token_count_trusted"] and not out["b"]["token_count_trusted"] and out["n"]["token_count_trusted"] is None


def test_likelihood_rises_until_it_converges(spark):
    rows = [(f"x{i}", t, None) for i, (_, _, t) in enumerate(EXAMPLES * 5)]
    stats = Q.text_statistics(spark.createDataFrame(rows, "id string, content string, token_count int"))
    model = Q.fit(stats, rounds=40)
    assert model.converged and len(model.likelihoods) < 40 and model.likelihoods[-1] > model.likelihoods[0]
    assert not Q.fit(stats, rounds=1).converged


def test_empty_table(spark):
    assert Q.assessed(spark.createDataFrame([], "id string, content string, token_count int")).count() == 0


def test_inspected_examples_agree_with_their_components(spark):
    rows = [(f"x{i}", t, None) for i, (_, _, t) in enumerate(EXAMPLES)]
    out = {r["id"]: r["kind"] for r in Q.assessed(spark.createDataFrame(rows, "id string, content string, token_count int")).collect()}
    assert sum(out[f"x{i}"] == c for i, (c, _, _) in enumerate(EXAMPLES)) >= 0.9 * len(EXAMPLES)
