"""Lookups and retrieval hold a bounded piece of the graph in a task, and do work once for questions that ask the same."""

from graphloom.operators import qa as Q


def test_a_lookup_is_dealt_in_pieces_that_grow_with_the_graph(spark, monkeypatch):
    rows = [("a", " Causes", f"o{i % 5}") for i in range(40)] + [("a", "treats", "o1")] * 3 + [("b", "causes", "o1"), (None, "causes", "o1"), ("b", None, "o1")]
    graph = spark.createDataFrame(rows, "s string, r string, o string")
    asked = [(1, "A", ["causes", "CAUSES ", "treats"], "?"), (2, "?", ["causes"], "o1"), (3, "?", ["causes"], "?"), (4, "none", ["causes"], "?")]
    questions = spark.createDataFrame(asked, "q_id long, s string, relations array<string>, o string")
    want = {(1, 1, "o1", 19), (1, 2, "o0", 16), (1, 3, "o2", 16), (1, 4, "o3", 16), (1, 5, "o4", 16), (2, 1, "a", 8), (2, 2, None, 1), (2, 3, "b", 1)}
    assert Q.pieces(graph) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(Q, "PIECE", 5)
    assert Q.pieces(graph) == 10
    ranked = Q.ranked_lookup(graph, questions)
    assert {tuple(r) for r in ranked.collect()} == want
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    counted = plan[plan.index("partial_count") :]
    assert "REPARTITION_BY_NUM" in counted and ", 10)" in counted  # counted where rows were dealt, not where they are read


def test_questions_with_the_same_terms_are_scored_as_one(spark, monkeypatch):
    staged = []

    def counting(df):
        out = stage(df)
        staged.append(out)
        return out

    stage = Q.stage
    monkeypatch.setattr(Q, "stage", counting)
    lines = spark.createDataFrame([(i, f"Alpha beta{i % 4} gamma") for i in range(40)], "line_id long, text string")
    questions = spark.createDataFrame([(q, [f"unseen{q} alpha", f"beta{q % 2}", "beta0" if q == 7 else None]) for q in range(30)], "q_id long, anchors array<string>")
    got = {}
    for r in sorted(Q.retrieve(questions, lines, 3).collect(), key=lambda r: (r.q_id, r.rank)):
        got.setdefault(r.q_id, []).append((r.line_id, r.score, r.rank))
    odd = [(1, 6, 1), (5, 6, 2), (9, 6, 3)]  # alpha, beta1 as a word and as an anchor
    even = [(0, 6, 1), (4, 6, 2), (8, 6, 3)]
    both = [(0, 6, 1), (1, 6, 2), (4, 6, 3)]
    assert got == {q: both if q == 7 else odd if q % 2 else even for q in range(30)}
    scored = [df.count() for df in staged if set(df.columns) == {"kind", "line_id", "score", "rank"} or set(df.columns) == {"q_id", "line_id", "score", "rank"}]
    assert sum(scored) <= 3 * 3  # three kinds of questions, not thirty questions
