"""Whole runs, readers and writers over small files."""

import json

import pytest

from graphloom import run
from graphloom.sources import readers, sinks

LOG = {
    "sets": [
        {
            "fact": "Aspirin can cause gastric bleeding.", "paraphrases": ["a", "b", "c"],
            "baseline_1": {"triples_per_paraphrase": [[], [], []]},
            "baseline_2": {"triples_per_paraphrase": [[["Aspirin", "LABEL_3", "ulcers"]], [["Aspirin", "LABEL_3", "gastric bleeding"]], []]},
            "baseline_3": {"triples_per_paraphrase": [[["Aspirin", "LABEL_3", "gastric bleeding"]], [["gastric bleeding", "caused by", "aspirin"]], [["Aspirin", "causes", "stomach bleeding"]]]},
        },
        {
            "fact": "Metformin is used to treat type 2 diabetes.", "paraphrases": ["a", "b"], "baseline_1": {"triples_per_paraphrase": [[], []]}, "baseline_2": {"triples_per_paraphrase": [[], [["metformin", "LABEL_1", "T2DM"]]]},
            "baseline_3": {"triples_per_paraphrase": [[["Metformin", "LABEL_1", "type 2 diabetes"]], [["Metformin", "LABEL_1", "type 2 diabetes"]]]},
        },
    ]
}
QA = {"examples": [{"question": "What does aspirin cause?", "subject": "aspirin", "relation": "causes", "object": "?", "answer": "gastric bleeding"}, {"question": "What treats type 2 diabetes?", "subject": "?", "relation": "treats", "object": "type 2 diabetes", "answer": "metformin"}, {"question": "?", "subject": "?", "relation": "x", "object": "?", "answer": "y"}], "relation_aliases": {}}


@pytest.fixture(scope="module")
def options(tmp_path_factory):
    at = tmp_path_factory.mktemp("run")
    (at / "log.json").write_text(json.dumps(LOG))
    (at / "qa.json").write_text(json.dumps(QA))
    (at / "sets.json").write_text(json.dumps({"paraphrase_sets": [{"fact": s["fact"], "paraphrases": s["paraphrases"]} for s in LOG["sets"]]}))
    return run.Options(log=str(at / "log.json"), qa=str(at / "qa.json")), at


def test_state_engine(spark, options):
    out = run.run_state_engine(spark, options[0])
    state = {(r.set_id, r.s, r.r, r.o): r.status for r in out["state"].collect()}
    assert state == {(0, "aspirin", "causes", "gastric bleeding"): "active", (1, "metformin", "treats", "type 2 diabetes"): "active"}
    assert {r.set_id: (r.mean_ged, r.mean_jaccard) for r in out["stability"].collect()} == {0: (0.0, 1.0), 1: (0.0, 1.0)}
    q = out["qa_summary"].first()
    assert (q.n, q.exact, q.hit, q.top1, q.mrr) == (2, 1.0, 1.0, 1.0, 1.0) and out["qa_misses"].count() == 0
    assert {r.q_id: r.error is None for r in out["qa"].collect()} == {0: True, 1: True, 2: False}
    assert out["log"].count() == 5 and out["conflicts"].count() == 0 and out["unsupported"].first().rate == 0


def test_relation_map(spark, options):
    out = run.build_relation_map(spark, options[0])
    assert {r.label: r.mapped for r in out["map"].collect()} == {"LABEL_3": "causes", "CAUSED_BY": "causes", "CAUSES": "causes", "LABEL_1": "treats"}
    assert out["ties"].count() == out["unmapped"].count() == 0 and out["trace"].count() == 4


def test_graph_and_question_evaluation(spark, options):
    stats = {(r.extractor, r.metric): r for r in run.run_graph_eval(spark, options[0])["statistics"].collect()}
    assert stats["baseline_3", "pairwise_ged"].n == 4 and stats["baseline_1", "pairwise_ged"].n == 0 and stats["baseline_1", "pairwise_ged"]["mean"] is None
    got = {r.extractor: r for r in run.run_qa_eval(spark, options[0])["summary"].collect()}
    assert got["baseline_1"].exact == 0 and got["baseline_3"].n == 2
    row = {r.extractor: r for r in run.compare_to_baselines(spark, options[0])["comparison"].collect()}
    assert row["baseline_1"].ged is None and row["engine"].jaccard == 1.0 and row["engine"].exact == 1.0


def test_generated_questions(spark, options):
    o = run.Options(log=str(options[1] / "sets.json"), qa_count=3)
    assert [r.question for r in run.generate_aligned_qa(spark, o)["questions"].orderBy("q_id").collect()] == ["What does Aspirin cause?", "What causes gastric bleeding?", "What does Metformin treat?"]


def test_full_pipeline_names_its_reports(spark, options):
    assert {"map_map", "engine_state", "graph_eval_statistics", "compare_comparison", "qa_eval_summary"} <= run.run_full_pipeline(spark, options[0]).keys()


def test_command_line_writes_reports(options, capsys):
    run.main(["build_relation_map", "--log", options[0].log, "--out", str(options[1] / "out")])
    assert len(list((options[1] / "out" / "map").glob("*.json"))) >= 1
    run.main(["generate_aligned_qa", "--log", str(options[1] / "sets.json"), "--qa-count", "2"])
    assert "What causes gastric bleeding?" in capsys.readouterr().out


def test_readers(spark, options):
    at = options[1]
    (at / "pairs.json").write_text(json.dumps({"pairs": [{"predicted": "a", "gold": "b"}, {"predicted": "c", "gold": None}]}))
    (at / "list.json").write_text(json.dumps([{"predicted": "a", "gold": "b"}]))
    (at / "graph.json").write_text(json.dumps([["a", "r", "b"], ["x"], ["c", "r", "d", "more"]]))
    (at / "bad.json").write_text("{}")
    assert [tuple(r) for r in readers.train_pairs(spark, str(at / "pairs.json")).collect()] == [("a", "b", 0), ("c", None, 1)] and readers.train_pairs(spark, str(at / "list.json")).count() == 1
    with pytest.raises(Exception, match="no train pairs"):
        readers.train_pairs(spark, str(at / "bad.json")).collect()
    assert [tuple(r) for r in readers.graph_file(spark, str(at / "graph.json")).collect()] == [("a", "r", "b"), ("c", "r", "d")]
    docs = spark.createDataFrame([([("Aspirin", "-1"), ("aspirin", "D1"), ("ASPIRIN", "D2")],), ([("x", "D3")],)], "entities array<struct<text string, identifier string>>")
    assert {r.key: r.cui for r in readers.corpus_mapper(docs.coalesce(1)).collect()} == {"aspirin": "D2", "x": "D3"}
    assert readers.first_mapper(None, docs.limit(0), docs) is docs and readers.first_mapper(None) is None
    sets = readers.evaluation_set(spark.createDataFrame([(0, "a causes b.")], "set_id int, fact string")).first()
    assert len(sets.paraphrases) == 10 and sets.paraphrases[1].endswith("a causes b.")
    with pytest.raises(Exception, match="placeholder"):
        readers.evaluation_set(spark.createDataFrame([(0, "Drug12 causes b.")], "set_id int, fact string")).collect()
    assert readers.texts_or_trial(spark).count() == 5
    assert readers.checkpoint_of(["checkpoint-9/model.safetensors", "checkpoint-30/pytorch_model.bin", "x/y"]) == "checkpoint-30" and readers.checkpoint_of(["pytorch_model.bin"]) == "." and readers.checkpoint_of([]) is None
    (at / "pub").mkdir()
    (at / "pub" / "a.txt").write_text("1|t|Title\n1|a|Abstract\n1\t0\t5\tTitle\t\tD1\n1\tCID\tD1\tD1\n")
    (at / "pub" / "README.txt").write_text("9|t|no\n")
    got = readers.pubtator(spark, str(at / "pub")).collect()
    assert len(got) == 1 and got[0].entities[0].type == "T047" and len(got[0].relations) == 1


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("ged", 2, 1.5, 0.5, float("nan"))], "metric string, n long, mean double, ci_lower double, ci_upper double")
    made = json.loads(sinks.document(summary_row=rows, sets=rows.select("metric")).first().value)
    assert made == {"summary": {"metric": "ged", "n": 2, "mean": 1.5, "ci_lower": 0.5}, "sets": [{"metric": "ged"}]}
    sinks.write_document(str(tmp_path / "doc"), sets=rows.select("metric"))
    assert spark.read.text(str(tmp_path / "doc")).count() == 1
    assert sinks.summary_lines(rows).first().value == "ged: 1.5000 [0.5000, NaN] (n=2)"
    page = sinks.html("a <b>", {"t & u": spark.createDataFrame([("<x>", None, 0.5)], "a string, b string, c double")})
    assert "<b>" not in page and "&lt;x&gt;" in page and "0.5000" in page and "t &amp; u" in page
    wide = sinks.by_extractor(spark.createDataFrame([(1, "a", 2), (1, "b", 3)], "k int, extractor string, v int"), "k", "v", ["a", "b", "c"]).first()
    assert (wide.a, wide.b, wide.c) == (2, 3, None)
    groups = spark.createDataFrame([(0, "causes", 2, [1.0])], "cluster_id long, relation string, n long, centroid array<double>")
    sinks.write_clusters(groups, str(tmp_path / "c"))
    assert readers.cluster_map(spark, str(tmp_path / "c")).collect() == groups.collect()


def test_state_engine_with_vectors(spark, options, tmp_path):
    """Equivalent objects become one edge, and answers are told by similarity."""
    log = {"sets": [{"fact": "Aspirin can cause gastric bleeding.", "paraphrases": ["a", "b", "c"], **{f"baseline_{i}": {"triples_per_paraphrase": [[["Aspirin", "causes", "tummy ache"]], [["Aspirin", "causes", "belly pain"]], [["Aspirin", "causes", "headache"]]]} for i in (1, 2, 3)}}]}
    qa = {"examples": [{"question": "What does aspirin cause?", "subject": "aspirin", "relation": "causes", "object": "?", "answer": a} for a in ("abdominal pain", "tummy ache", "fever")]}
    (tmp_path / "log.json").write_text(json.dumps(log))
    (tmp_path / "qa.json").write_text(json.dumps(qa))
    vectors = {"tummy ache": [1.0, 0.0, 0.0], "Belly Pain": [0.9, 0.43, 0.0], "headache": [0.0, 0.2, 1.0], "abdominal pain": [0.8, 0.6, 0.0], "fever": [0.0, 1.0, 0.0]}
    rows = [(k, v) for k, v in vectors.items()] + [(k.lower(), v) for k, v in vectors.items() if k != k.lower()]
    spark.createDataFrame(rows, "surface string, embedding array<double>").write.parquet(str(tmp_path / "vectors"))
    o = run.Options(log=str(tmp_path / "log.json"), qa=str(tmp_path / "qa.json"), mapper=None, label_map=None)
    plain = {r.o for r in run.run_state_engine(spark, o)["state"].collect()}
    o.vectors = str(tmp_path / "vectors")
    out = run.run_state_engine(spark, o)
    merged = {r.o: r.n_evidence for r in out["state"].collect() if r.first_seq is not None}
    assert {"tummy ache", "belly pain", "headache"} <= plain and merged == {"tummy ache": 2, "headache": 1}
    told = {r.q_id: (r.exact, r.hit) for r in out["qa"].collect()}
    assert told == {0: (False, True), 1: (True, True), 2: (False, False)}


def test_comparison_report(spark, tmp_path):
    rows = spark.createDataFrame([("engine", 0.5, float("nan"), 0.25, 1.0, None, 0.125, 3), ("b1", None, None, None, None, None, None, None)], "extractor string, ged double, jaccard double, drift double, exact double, hit double, unsupported double, conflicts long")
    sinks.write_comparison(rows, f"file://{tmp_path}/report")
    table = next((tmp_path / "report/csv").glob("*.csv")).read_text().splitlines()
    assert table == ["Method,GED mean,Jaccard mean,Drift@0.2,QA EM,QA R@1,Unsupported (note),Conflict rec.", "b1,,,,,,,", "engine,0.5,,0.25,1.0,,0.125,3"]
    text = next((tmp_path / "report/markdown").glob("*.txt")).read_text()
    assert "| engine | 0.5000 | — | 0.2500 | 1.0000 | — | 0.1250 | 3 |" in text and "| b1 | — |" in text


def test_numbers_that_json_cannot_hold(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")], {"a": float("inf")}, ("x", [(2.0, "y"), (float("-inf"), "z")])), (2, None, None, None)], "id long, a array<double>, m map<string,double>, s struct<n:string,l:array<struct<v:double,t:string>>>")
    got = [r.asDict(True) for r in sinks.nan_to_null(df).orderBy("id").collect()]
    assert got == [{"id": 1, "a": [1.0, None], "m": {"a": None}, "s": {"n": "x", "l": [{"v": 2.0, "t": "y"}, {"v": None, "t": "z"}]}}, {"id": 2, "a": None, "m": None, "s": None}]
