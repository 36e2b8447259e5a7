"""Functions, alignment, fold and readers against hand-derived rows and a sequential model."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import relation as R
from graphloom.functions import text as T
from graphloom.operators import align as A
from graphloom.operators import edges as E
from graphloom.operators import extract as X
from graphloom.operators import qa as Q
from graphloom.operators import resolve as C
from graphloom.operators import stability as S
from graphloom.sources import readers, sinks


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (lambda c: T.normalize_surface(T.nfkd(c)), "naïve café", "nai ve cafe"), (T.normalize_surface, "Bleeding in the stomach.", "gastric bleeding"), (T.normalize_surface, None, ""),
        (T.strip_agentive, "caused by due to aspirin", "aspirin"), (T.validity_surface, "2. aspirin", "aspirin"), (T.validity_surface, "10 aspirin", "aspirin"),
        (T.qa_entity, "1. Aspirin", "aspirin"), (T.qa_entity, "12", "12"), (T.is_ontology_id, "MESH:D001", True), (T.is_ontology_id, "C0004057", True), (T.is_ontology_id, "Cat", False),
        (T.headword, "upper gastric bleeding risk", "bleeding"), (T.headword, "the liver", "liver"), (T.headword, "", ""), (T.answer_line, 'Answer: "liver"', "liver"), (T.answer_line, "Unknown.", ""),
        (R.head_label, "NR", None), (R.head_label, "LABEL_0", None), (R.head_label, "LABEL_1", "causes"), (R.head_label, "LABEL_7", None), (R.head_label, "CID", "causes"), (R.head_label, "Used To", "used_to"),
        (T.drop_reason, "c0004057", "numeric_heavy"), (T.drop_reason, "", "empty"), (T.drop_reason, "liver", "ok"), (T.numeric_ratio, "", 0.0),
    ],
)
def test_text(spark, f, x, y):
    assert one(spark, f, x) == y


@pytest.mark.parametrize(
    ("r1", "p1", "r2", "p2", "kind"),
    [("causes", "+", "treats", "+", "semantic_polarity_clash"), ("increases", "+", "reduces", "+", "semantic_polarity_clash"), ("causes", "+", "treats", "-", "polarity_clash"), ("causes", "+", "increases", "+", "multi_relation_mismatch"), ("causes", "+", "causes", "-", "polarity_clash_same_relation"), ("causes", "+", "causes", "+", None)],
)
def test_conflict_type(spark, r1, p1, r2, p2, kind):
    df = spark.createDataFrame([(r1, p1, r2, p2)], "a string, b string, c string, d string")
    assert df.select(R.conflict_type(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0] == kind


LOG = {
    "sets": [
        {"fact": "Aspirin causes gastric bleeding.", "baseline_3": {"triples_per_paraphrase": [[["aspirin", "may cause", "gastric bleeding"]], [["Aspirin", "may cause", "stomach bleeding"]], [["acetylsalicylic acid", "associated with", "gastric hemorrhage"]], [["aspirin", "associated with", "gastric bleeding"], ["x"]]]}},
        {"fact": "Metformin is used to treat type 2 diabetes.", "baseline_3": {"triples_per_paraphrase": [[["metformin", "treats", "type 2 diabetes"]], [["Metformin", "treats", "T2DM"]], [["Type 2 diabetes", "treated with", "Metformin"]]]}},
    ]
}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "log.json"
    path.write_text(json.dumps(LOG))
    return readers.extractor_log(spark, str(path), "baseline_3")


def test_alignment_and_stability(spark, raw):
    got = A.distinct_in_note(A.align(raw))
    sets = {(r.set_id, r.note): (r.s, r.r, r.o) for r in got.collect()}
    assert sets[0, 0] == sets[0, 1] == sets[0, 3] == ("aspirin", "causes", "gastric bleeding")
    assert sets[0, 2] == ("acetylsalicylic acid", "causes", "gastric hemorrhage")
    assert sets[1, 0] == sets[1, 2] == ("metformin", "treats", "type 2 diabetes")
    assert sets[1, 1] == ("metformin", "treats", "t2dm")
    drift = {r.set_id: r for r in S.drift(S.note_pairs(got)).collect()}
    assert drift[0].mean_jaccard == 0.5 and drift[0].mean_ged == 1.0 and drift[0].drift == 0.5
    assert drift[1].mean_jaccard == pytest.approx(1 / 3) and drift[1].mean_ged == pytest.approx(4 / 3)
    pairs = S.note_pairs(got).where("set_id = 0")
    row = S.summarize(pairs, "jaccard").first()
    assert (row.sd, row.ci_lower, row.ci_upper) == pytest.approx((0.547723, 0.061731, 0.938269), abs=1e-5)
    log = {(r.set_id, r.source): r for r in E.update_log(got).collect()}
    assert log[1, "set1:p1"].conflicts == 1 and log[1, "set1:p2"].merged == 1 and log[1, "set1:p2"].num_edges == 2
    edges = A.pin_seed(E.with_status(got), raw.select("set_id", "fact").distinct())
    status = {(r.set_id, r.o): r.status for r in edges.collect()}
    assert status[1, "type 2 diabetes"] == "active" and status[1, "t2dm"] == "uncertain"


def test_mapper_drops_ids_and_falls_back(spark, raw):
    mapper = spark.createDataFrame([("aspirin", "C0004057"), ("gastric hemorrhage", "C0019080")], "key string, cui string")
    aligned = A.align(raw, mapper=mapper)
    assert {r.reason for r in aligned.where("set_id = 0").collect()} == {"low_value"}
    rescued = A.with_fallback(raw, mapper=mapper).where("set_id = 0")
    assert {r.source for r in rescued.collect()} == {"set0:surface_fallback"}
    assert {(r.s, r.o) for r in rescued.collect()} == {("aspirin", "gastric bleeding"), ("acetylsalicylic acid", "gastric hemorrhage")}


def sequential(rows):
    """A plain fold of evidence in order: edges, and conflicts as (kind, earlier key, later key)."""
    edges, found = {}, []
    for r in rows:
        key = (r["s"], r["r"], r["o"])
        if key in edges:
            if edges[key]["polarity"] != r["polarity"]:
                found.append("merge")
            edges[key]["confidence"] = max(edges[key]["confidence"], r["confidence"])
            continue
        for s, rel, o in edges:
            if s == r["s"] and o == r["o"] and rel != r["r"]:
                found.append("relation")
            if s == r["s"] and rel == r["r"] and o != r["o"]:
                found.append("object")
        edges[key] = dict(r)
    return edges, found


def test_fold_equals_sequential_model(spark):
    rng = random.Random(5)
    rows = [
        {"set_id": rng.randint(0, 5), "seq": i, "source": f"n{i % 7}", "s": rng.choice("ab"), "r": rng.choice(["causes", "treats", "related_to"]), "o": rng.choice("xyz"), "polarity": rng.choice(["positive", "negative"]), "confidence": rng.random()}
        for i in range(150)
    ]
    ev = spark.createDataFrame([{**r, "k": r["o"]} for r in rows])
    edges = E.fold_light(ev)
    n = {"merge": E.merge_clashes(ev, edges).count(), "relation": E.relation_conflicts(edges).count(), "object": E.object_conflicts(edges).count()}
    want, total = {}, []
    for s in range(6):
        e, f = sequential([r for r in rows if r["set_id"] == s])
        want |= {(s, *k): v for k, v in e.items()}
        total += f
    got = {(r.set_id, r.s, r.r, r.o): r for r in edges.collect()}
    assert got.keys() == want.keys()
    assert all(got[k].polarity == v["polarity"] and got[k].confidence == v["confidence"] and got[k].first_seq == v["seq"] for k, v in want.items())
    assert n == {k: total.count(k) for k in n}


def test_duplicate_aliases_count_twice(spark):
    g = spark.createDataFrame([("a", "causes", "b")], "s string, r string, o string")
    q = spark.createDataFrame([(1, "a", ["causes", "Causes"], "?", "b"), (2, "?", ["causes"], "?", "b")], "q_id long, s string, relations array<string>, o string, answer string")
    ranked = Q.ranked_lookup(g, q)
    assert [(r.q_id, r.answer, r.n) for r in ranked.collect()] == [(1, "b", 2)]
    m = Q.metrics(ranked, q).first()
    assert (m.n, m.exact, m.mrr) == (1, 1.0, 1.0)


def test_pubtator_mapper_and_split(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1|t|Drug title\n1|a|About disease.\n1\t0\t4\tDrug\tChemical\tD1\n1\t17\t24\tdisease\tDisease\tM2\n1\tx\t24\tbad\tDisease\tM3\n1\tCID\tD1\tM2\n\n2|t|Other\n2|a|Text\n")
    docs = readers.pubtator(spark, str(tmp_path / "a.txt"))
    got = {r.block: r for r in docs.collect()}
    assert got[1].text == "Drug title About disease." and len(got[1].entities) == 2 and got[1].relations[0].asDict() == {"head": 0, "tail": 1, "type": "CID"} and got[2].entities == []
    (tmp_path / "m.tsv").write_text("# c\nAspirin\tC1\naspirin \tC2\n")
    assert [tuple(r) for r in readers.mapper_file(spark, str(tmp_path / "m.tsv")).collect()] == [("aspirin", "C2")]
    n = {r["split"]: r["n"] for r in readers.split_rows(spark.range(105).withColumnRenamed("id", "i"), "i").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 84, "dev": 10, "test": 11}
    d = docs.withColumn("doc", F.col("block"))
    assert X.entity_pairs(d).count() == 1 and X.negatives(d).count() == 0


def test_bio_and_sentences(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 9), (1, 2, 10, 12)], "doc long, pos long, start long, stop long")
    ents = spark.createDataFrame([(1, 0, 9, "Drug")], "doc long, start long, stop long, type string")
    tags = X.bio_tags(tokens, ents)
    assert [r.tag for r in tags.orderBy("pos").collect()] == ["B-Drug", "I-Drug", "O"]
    spans = X.bio_spans(tokens.join(tags, ["doc", "pos"]).withColumn("confidence", F.lit(0.5)))
    assert [(r.start, r.stop, r.label) for r in spans.collect()] == [(0, 9, "Drug")]
    docs = spark.createDataFrame([(1, "One. Two here! Three"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.start, r.stop) for r in C.sentence_spans(docs).orderBy("doc_id", "pos").collect()]
    assert got[:3] == [(1, 0, 4), (1, 5, 14), (1, 15, 20)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "a int, b double")
    assert sinks.nan_to_null(df).where("b is null").count() == 1
    assert "| 1 | — |" in sinks.markdown(df)
    r = S.report(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), "x").first()
    assert r.ci_upper - r.mean == pytest.approx(4.302653 * 1.5275252 / 3**0.5, abs=1e-4)
    assert S.report(spark.createDataFrame([], "x double"), "x").first().mean is None


def test_few_texts_are_decomposed_at_a_time(spark):
    df = spark.createDataFrame([("naïve café",), ("plain",), (None,)], "t string")
    out = T.with_surface(df, "t", "s")
    assert sorted(r["s"] for r in out.collect()) == ["", "nai ve cafe", "plain"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
