import datetime as dt
import importlib
import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluation as E
from siltstone.operators import models as M
from siltstone.plans.cut import shared_dir, written
from siltstone.sources import reports as R
from siltstone.sources.tables import delivered_once
from siltstone.streaming import streams as S


def test_retry():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert M.with_retry(flaky, 5, sleep=waits.append) == 7 and waits == [2.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        M.with_retry(lambda: 1 / 0, 2, sleep=waits.append)


def test_providers(spark):
    df = spark.createDataFrame([(1, "the river is long", "the river"), (2, None, None)], "k int, t string, c string")
    rows = {r["k"]: r for r in M.judged(M.embedded(df, "t"), "t", "c").collect()}
    assert len(rows[1]["embedding"]) == 64 and rows[2]["embedding"] is None and rows[1]["judgment"]["answerability"] == "partial" and rows[2]["judgment"]["answerability"] == "no"
    texts = spark.createDataFrame([(1, "One. Two. Three. Four"), (2, "One. Two"), (3, "")], "k int, t string")
    out = {r["k"]: r for r in M.summarized(texts, "k", "t").collect()}
    assert (out[1]["success"], out[1]["repair_used"]) == (True, False) and (out[2]["success"], out[2]["repair_used"]) == (True, True) and not out[3]["success"] and out[3]["error"]


def test_failed_calls_are_rows(spark):
    class Broken:
        model = "broken"

        def judge(self, *texts):
            raise OSError("no service")

    df = spark.createDataFrame([(1, "a", "b", "c")], "k int, q string, a string, c string")
    row = M.judged(df, "q", "c", Broken(), tries=1).first()["judgment"]
    assert row["answerability"] == row["failure_type"] == "error" and "no service" in row["reason"] and row["noise_score"] is None
    row = M.answers_judged(df, "q", "a", "c", Broken(), tries=1).first()
    assert row["judgment"]["answerability"] == "error" and row["cost_usd"] is None and row["total_tokens"] is None and row["model"] == "broken"


def test_answers_and_canned_replies(spark):
    rows = [(1, "where is the mill", "The mill is old. It stands.", ["c"], True), (2, "x", "", [], True), (3, "x", "y", ["c"], False), (4, "x", None, None, None), (5, "x", "no such word", ["c"], True)]
    df = spark.createDataFrame(rows, "k int, q string, c string, s array<string>, f boolean")
    got = {r["k"]: r["answer"] for r in M.answered(df, "q", "c", "s", "f").collect()}
    assert got == {1: "The mill is old [Source 1]", 2: M.NO_CONTEXT, 3: M.NOT_ASKED, 4: M.NOT_ASKED, 5: M.NOT_IN_CONTEXT}
    vector, ms = M.embed_query("red mill")
    assert len(vector) == 64 and ms >= 0


def test_candidates_and_metrics(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 1.0, 1.0), (3, None, None), (4, None, 3.0)], "k int, a double, b double")
    got = {r["k"]: (r["judge_success"], r["winner"], r["margin"], r["judge_error"] is None) for r in M.candidates_judged(df, {"a": "a", "b": "b"}).collect()}
    assert got == {1: (True, "a", 1.0, True), 2: (True, "tie", 0.0, True), 3: (False, None, None, False), 4: (True, "b", 0.0, True)}
    metrics = lambda rows: spark.createDataFrame(rows, "k int, batch_time_sec double, input_tokens int, output_tokens int")
    merged = {r["k"]: (r["total_tokens"], r["tokens_per_sec"], r["repair_used"]) for r in M.merged_metrics(metrics([(1, 2.0, 3, 1), (2, 0.0, 1, 1), (3, None, None, 4)]), metrics([(1, 2.0, 4, None)]), "k").collect()}
    assert merged == {1: (8, 2.0, True), 2: (2, None, False), 3: (4, None, False)}


def test_compact_cases_and_lists(spark):
    context = spark.createDataFrame([(1, ("partial", "none", 3, 2, "r"))], "q int, judgment struct<answerability:string,failure_type:string,context_relevance_score:int,context_completeness_score:int,reason:string>")
    answers = spark.createDataFrame([(1, ("yes", "none", 5, 4, 3, ""), ["t"], ["c"], "x"), (2, ("no", None, None, None, None, None), None, None, None)], "q int, judgment struct<answerability:string,failure_type:string,answerability_score:int,groundedness_score:int,completeness_score:int,reason:string>, source_titles array<string>, source_chunk_ids array<string>, answer string")
    rows = {r["q"]: r for r in E.compact_cases(context, answers, "q").collect()}
    assert len(rows[1]) == 15 and rows[1]["context_reason"] == "r" and rows[1]["answer_groundedness_score"] == 4
    assert rows[2]["context_answerability"] == "missing" and rows[2]["source_titles"] == [] and rows[2]["answer"] == "" and rows[2]["context_relevance_score"] is None
    df = spark.createDataFrame([("partial", "yes"), ("yes", "no"), ("missing", "yes"), ("no", "no")], "a string, b string")
    assert sorted((r["a"], r["case"][0]) for r in E.case_lists(df, "a", "b").collect()) == [("missing", "q"), ("partial", "A"), ("partial", "q"), ("yes", "C")]


def test_resumed_and_staged_runs(spark, tmp_path):
    seen: list = []
    q = spark.createDataFrame([(i,) for i in range(6)], "q bigint")

    def run(left):
        seen.append(sorted(r[0] for r in left.collect()))
        return left.withColumn("answer", F.col("q") * 2)

    path = str(tmp_path / "run")
    R.resumed(spark, path, q.where("q < 2"), "q", {"k": 1}, run)
    assert sorted(r[0] for r in R.resumed(spark, path, q, "q", {"k": 1}, run).select("answer").collect()) == [0, 2, 4, 6, 8, 10] and seen == [[0, 1], [2, 3, 4, 5]]
    with pytest.raises(ValueError, match="k"):
        R.resumed(spark, path, q, "q", {"k": 2}, run)
    calls: list = []
    stages = [("one", lambda t: (calls.append(1), q)[1]), ("two", lambda t: (calls.append(2), t["one"].where("q > 3"))[1])]
    R.staged(spark, str(tmp_path / "s"), {"a": 1}, stages[:1])
    assert R.staged(spark, str(tmp_path / "s"), {"a": 1}, stages)["two"].count() == 2 and calls == [1, 2]
    with pytest.raises(ValueError, match="a"):
        R.staged(spark, str(tmp_path / "s"), {"a": 2}, stages)
    assert R.read_json(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError, match="rows"):
        R.write_report(spark.range(R.SINGLE_ROWS + 1), str(tmp_path / "big.json"), single=True)


def test_spreadsheets(spark, tmp_path):
    import zipfile

    cell = lambda at, v, kind="": f'<c r="{at}"{kind}>{v}</c>'
    rows = [[cell("A1", "<v>0</v>", ' t="s"')], [cell("A2", "<v>1</v>", ' t="s"'), cell("B2", "<is><t>LIMIT</t></is>", ' t="inlineStr"'), cell("C2", "<is><t>EXTRA</t></is>", ' t="inlineStr"')], [cell("A3", "<v>7</v>"), cell("C3", "<v>1</v>")], [cell("A4", "<v>x</v>"), cell("B4", "<v>2.5</v>")]]
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>banner</t></si><si><t>ID</t></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData>' + "".join(f"<row>{''.join(r)}</row>" for r in rows) + "</sheetData></worksheet>")
    df = R.read_sheet(spark, str(tmp_path / "s.xlsx"), "ID int, LIMIT double, EXTRA int", drop=["EXTRA"])
    assert sorted(map(tuple, df.collect()), key=str) == [(7, None), (None, 2.5)] and df.columns == ["ID", "LIMIT"]


def test_ids_membership_and_keys(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(R.normalized_id(F.col("x"), F.col("y"), "")).collect()] == ["a", "b", ""]
    with pytest.raises(Exception, match="neither"):
        df.select(R.normalized_id(F.col("x"), F.col("y"))).collect()
    assert R.membership(df, df.where("x = 'a'"), "x").first()[:] == (1, 2)
    assert R.by_keys(spark.range(9), spark.range(5), "id", ["id"], 2).count() == 2


def test_ingestion_writes_both_tables(spark, tmp_path):
    from siltstone.operators import ingest as I

    long = "The harbour was built in 1820 after a long dispute between two towns. " * 60
    docs = spark.createDataFrame([(1, " T ", long, "u"), (2, "", long, None), (3, "S", "short", None), (4, None, None, None)], "doc_id bigint, title string, text string, url string")
    for strategy in I.STRATEGIES:
        documents, chunks = I.ingest(docs, str(tmp_path / "store"), strategy=strategy)
        d = documents.first()
        meta = json.loads(d["metadata"])
        own = chunks.orderBy("chunk_index").collect()
        assert documents.count() == 1 and d["title"] == "T" and meta["chunk_count"] == len(own) and meta["chunking_strategy"] == strategy
        assert all(r["document_id"] == d["id"] and len(r["embedding"]) == 64 and r["token_count"] <= 256 for r in own) and [r["chunk_index"] for r in own] == list(range(len(own)))
    assert I.preview(docs, "doc_id", "title", "text", chunks=2).count() == 2
    with pytest.raises(ValueError, match="strategy"):
        I.chunked(docs, "doc_id", "title", "text", "x")


def test_stored_model_gives_the_same_scores(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(200)], "k int, x double, z double, y double")
    scores = lambda store: {r["k"]: r["prob"] for r in M.logistic_scores(df, "k", ["x", "z"], "y", store=store).collect()}
    assert scores(None) == scores(str(tmp_path / "model"))
    assert M.sweep(df, "k", ["x", "z"], "y", [[4]], [0.0, 10.0], F.col("k") % 5 != 0).count() == 3


def test_learning_helpers(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, i % 4 == 0) for i in range(8)], "k int, x double, c double, y boolean")
    z = M.standardized(df, ["x", "c"]).agg(F.avg("x"), F.stddev_pop("x"), F.max("c")).first()
    assert abs(z[0]) < 1e-12 and abs(z[1] - 1) < 1e-12 and z[2] == 0.0
    assert {r["y"]: r["weight"] for r in M.class_weights(df, "y").collect()} == {True: 2.0, False: 0.666667}
    losses = [5.0, 4.0, 4.5, 4.4, 4.3, 1.0]
    run = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(losses)], "run string, epoch int, loss double")
    assert M.early_stopping(run, "run", "epoch", "loss", 3).first()[:] == ("a", 2, 4.0, 5)
    labels = spark.range(1).select(M.masked_labels(F.array(F.lit(9), F.lit(9)), F.array(F.lit(1), F.lit(2)), 5)).first()[0]
    assert labels == [-100, -100, 1, 2, -100]
    scored = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, prob double")
    assert E.classification(scored, "label", F.col("prob") >= 0.5).first()["precision"] == 0.666667 and E.classification(scored, "label", F.col("prob") >= 2).first()["precision"] == 0.0
    assert E.auc(scored, "label", "prob").first()[0] == 0.875


def test_judgment_reports(spark):
    df = spark.createDataFrame([(" YES ", "yes"), ("maybe", "no"), (None, "no")], "a string, b string").select(E.answerability(F.col("a")).alias("a"), E.answerability(F.col("b")).alias("b"))
    assert {r["v"]: r["count"] for r in E.histogram(df, "a", E.ANSWERABILITY, "v").collect()} == {"yes": 1, "partial": 0, "no": 0, "error": 1, "missing": 1}
    m = {r["from_label"]: r for r in E.transitions(df, "a", "b", E.ANSWERABILITY).collect()}
    assert m["yes"]["to_yes"] == 1 and m["error"]["to_no"] == 1 and m["no"]["to_no"] == 0 and len(m) == 5
    last = E.last_per(spark.createDataFrame([("q", 1), ("q", 2), ("", 3), (None, 4)], "q string, n int"), "q", [F.col("n")])
    assert [tuple(r) for r in last.collect()] == [("q", 2)]


def test_reports(spark, tmp_path):
    (tmp_path / "effort_40.json").write_text(json.dumps({"metadata": {}, "queries": [{"query": "a", "results": [{"chunk_id": "c", "rank": 1}]}]}))
    assert R.read_report(spark, str(tmp_path / "effort_40.json")).first()["results"][0]["chunk_id"] == "c"
    assert R.read_keyed(spark, str(tmp_path), r"effort_(\d+)", "metadata string").first()["effort"] == 40
    for name, body in (("a.jsonl", '{"query": "x"}\n{"query": "y"}'), ("b.json", '["x", {"query": "y"}]'), ("c.json", '{"queries": ["x", "y"]}')):
        (tmp_path / name).write_text(body)
        assert [r[0] for r in R.read_queries(spark, str(tmp_path / name)).collect()] == ["x", "y"]
    (tmp_path / "Solar.txt").write_text("one\ntwo")
    assert R.read_texts(spark, str(tmp_path / "Solar.txt")).first()[:] == ("Solar", "one\ntwo")
    (tmp_path / "s.csv").write_text("X0,X1\nID,LIMIT\n1,20\n2,30\n")
    assert R.read_csv(spark, str(tmp_path / "s.csv"), "id string, v string", banner="X0").where("id <> 'ID'").count() == 2
    df = spark.createDataFrame([("a\nb", [1, 2])], "q string, l array<int>")
    R.write_csv(df, str(tmp_path / "out"))
    assert R.read_csv(spark, str(tmp_path / "out"), "q string, l string").first()[:] == ("a\nb", "[1,2]")
    R.write_report(df, str(tmp_path / "r.json"), {"k": 1}, single=True)
    assert json.loads((tmp_path / "r.json").read_text())["queries"] == [{"q": "a\nb", "l": [1, 2]}]
    assert "<svg" in R.line_chart([(1, 2, 3), (2, 3, 1)], "t", "a", "b") and R.line_chart([], "t", "a", "b") and R.render("hi $x $y", x=1) == "hi 1 $y"
    with pytest.raises(ValueError, match="k"):
        R.same_settings({"k": 1}, {"k": 2}, ["k"])


def test_deliveries_and_cuts(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", 1, t), ("a", 1, t + dt.timedelta(1)), ("b", None, None), ("b", None, t)], "id string, v int, created_at timestamp")
    assert sorted((r["id"], r["v"], r["created_at"]) for r in delivered_once(df).collect()) == [("a", 1, t), ("b", None, t)]
    assert written(df, "x").count() == 4 and shared_dir(spark)


def test_written_tables_can_be_cleared(spark):
    import os

    from siltstone.plans.cut import cleared, scratch

    df = written(spark.range(3), "gone")
    folder = os.path.dirname(scratch(spark, "x"))
    assert df.count() == 3 and any(n.startswith("gone-") for n in os.listdir(folder))
    cleared(spark)
    assert not os.path.exists(folder) and written(spark.range(2)).count() == 2


def test_a_cluster_needs_its_shared_folder(spark, monkeypatch):
    from siltstone.plans import cut

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("S", (), {"master": "local-cluster[2,1,1024]", "getConf": staticmethod(lambda: Session.conf)})()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        cut.shared_dir(Session())


def test_streams_equal_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=17 * i), "ab"[i % 2], i % 3, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, user_id bigint, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.tumbling(stream, "1 hour", ["event_type"], late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("tumbled")) == key(S.tumbling(df, "1 hour", ["event_type"])) and S.sessions(df, "30 minutes", ["user_id"]).count() == 40 - 0
    q = S.running_best(stream).writeStream.outputMode("update").format("memory").queryName("best").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["user_id"]: r["best"] for r in spark.table("best").collect()} == {0: 0.0, 1: 1.0, 2: 2.0}
    chunks = spark.createDataFrame([("a", None, None, '{"title": "T"}', "c", t)], "id string, title string, section_path string, metadata string, content string, created_at timestamp")
    chunks.write.parquet(str(tmp_path / "chunks"))
    S.keep_search_fields(spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "chunks")), str(tmp_path / "fields"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", "New", None, None, "d", t), ("b", None, None, None, "e", t)], chunks.schema).write.mode("append").parquet(str(tmp_path / "chunks"))
    S.keep_search_fields(spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "chunks")), str(tmp_path / "fields"), str(tmp_path / "cp")).awaitTermination()
    assert {r["id"]: r["search_text"] for r in S.current_fields(spark.read.parquet(str(tmp_path / "fields"))).collect()} == {"a": "New\nd", "b": "e"}


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    def missing(name):
        raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(importlib, "import_module", missing)
    names = entry.queries()
    assert "vector_topk_flat" in names and not any(n.startswith("p1_") for n in names) and set(entry.oracle_sql()) <= set(names)


def test_batches_are_bounded_in_bytes(spark, tmp_path):
    import pyarrow as pa

    from siltstone.sources.tables import BATCH_BYTES, bound_batches, table

    spark.range(64).selectExpr("id", "repeat('x', 2000000) as t").coalesce(1).write.parquet(str(tmp_path / "big.parquet"))
    df = table(spark, str(tmp_path), "big", "id", "t")
    most = df.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in it), "n bigint").agg(F.max("n")).first()[0]
    assert most <= 1.2 * BATCH_BYTES
    bound_batches(spark, 1 << 40)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES


def test_run_batches_cover_every_event_type(spark, tmp_path):
    from siltstone.plans.queries_reports import run_batches

    rows = [(i, "ab"[i % 2], 1.0) for i in range(300)]
    spark.createDataFrame(rows, "event_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["event_type"], r["batch"]): (r["start_index"], r["end_index"], r["rows"]) for r in run_batches(spark, str(tmp_path)).collect()}
    assert got == {(t, k): (100 * k, 100 + 50 * k, 100 - 50 * k) for t in "ab" for k in (0, 1)}
