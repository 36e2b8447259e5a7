"""Whole runs, from files to reports: `python -m graphloom.run NAME --help`."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import align as A
from .operators import edges as E
from .operators import labels as L
from .operators import learning as N
from .operators import qa as Q
from .operators import stability as S
from .sources import readers, sinks
from .sources.shared import stage

EXTRACTORS = ("baseline_1", "baseline_2", "baseline_3")
NO_VECTORS = "surface string, embedding array<double>"


@dataclass
class Options:
    """What runs read and how: paths may be null where a run can do without."""

    log: str | None = None
    qa: str | None = None
    mapper: str | None = None
    label_map: str | None = None
    graph: str | None = None
    texts: str | None = None
    vectors: str | None = None
    object_merge: float = 0.75
    baseline: str = "baseline_3"
    out: str | None = None
    drift_tau: float = 0.2
    min_top_ratio: float = 0.6
    qa_graph: str = "union"
    include_weak: bool = False
    runs: int = 10
    seed: int = 42
    qa_count: int = 100
    baselines: list[str] = field(default_factory=lambda: list(EXTRACTORS))


def _labels(spark: SparkSession, o: Options, raw: DataFrame) -> DataFrame:
    """key, relation: the given map, else one learned from the log's own facts."""
    if o.label_map:
        return readers.label_map(spark, o.label_map)
    return build_relation_map(spark, o, raw)["map"].where("mapped <> 'unknown'").select(F.col("label").alias("key"), F.col("mapped").alias("relation"))


def _vectors(spark: SparkSession, o: Options) -> DataFrame:
    """surface, embedding of a parquet table of texts and their vectors; none without a path."""
    return spark.read.parquet(o.vectors).select("surface", F.col("embedding").cast("array<double>").alias("embedding")) if o.vectors else spark.createDataFrame([], NO_VECTORS)


def _with_vectors(spark: SparkSession, o: Options, evidence: DataFrame) -> DataFrame:
    """The evidence with the vector v of its object, by the object's normalised surface; missing ones are null."""
    named = T.with_surface(_vectors(spark, o), "surface", "_k").groupBy("_k").agg(F.min_by("embedding", "surface").alias("v"))
    return T.with_surface(evidence, "o", "_k").join(named, "_k", "left").drop("_k")


def _golds(raw: DataFrame) -> DataFrame:
    from .functions import relation as R

    f = F.col("fact")
    return raw.groupBy("set_id").agg(F.first("fact").alias("fact")).select("set_id", F.coalesce(R.parse_fact(f)["r"], R.cue_relation(R.cue(f))).alias("gold"))


def build_relation_map(spark: SparkSession, o: Options, raw: DataFrame | None = None) -> dict[str, DataFrame]:
    """map, trace, ties, unmapped: extractor labels' relations, learned from what their sets' facts say."""
    raw = readers.extractor_log(spark, o.log, o.baseline) if raw is None else raw
    pairs = stage(N.train_pairs(raw, _golds(raw)))
    mapped = L.argmax_map(pairs, o.min_top_ratio)
    return {"map": mapped, **sinks.map_log(mapped, L.cooccurrence(pairs))}


def run_state_engine(spark: SparkSession, o: Options) -> dict[str, DataFrame]:
    """The evidence of a log, aligned and folded into a graph a set; stability, support, conflicts, and answers from the graph.

    With a table of vectors, objects whose cosine is object_merge or more are one, in order of arrival.
    """
    raw = stage(readers.extractor_log(spark, o.log, o.baseline))
    named = stage(_labels(spark, o, raw))
    mapper = readers.first_mapper(readers.mapper_file(spark, o.mapper)) if o.mapper else None
    evidence = stage(A.with_fallback(raw, named, mapper))
    facts = raw.select("set_id", "fact").distinct()
    at = o.object_merge if o.vectors else None
    told = evidence if at is None else stage(_with_vectors(spark, o, evidence))
    evidence = evidence if at is None else stage(E.coalesce(told, at))
    state = stage(A.pin_seed(E.with_status(evidence), facts))
    shots = E.one_shot(told, at).where("status <> 'uncertain'" if not o.include_weak else "true").select("set_id", "note", "s", "r", "o")
    pairs = stage(S.note_pairs(shots, o.include_weak))
    drift = S.drift(pairs, o.drift_tau)
    graph = state.select("set_id", "s", "r", "o")
    out = {
        "state": E.exported(state), "conflicts": E.conflict_records(evidence), "log": E.update_log(evidence), "drops": A.drop_counts(A.align(raw, named, mapper)), "stability": drift,
        "support": S.note_support(graph, evidence), "unsupported": S.unsupported_rate(graph, evidence),
        "summary": S.summarize(pairs, "jaccard").select(F.lit("jaccard").alias("metric"), "*").unionAll(S.summarize(pairs.withColumn("ged", F.col("ged").cast("double")), "ged").select(F.lit("ged").alias("metric"), "*")),
        "high_drift": drift.orderBy("mean_jaccard", "set_id").limit(10),
        "graph": Q.qa_graph(graph, evidence, o.qa_graph),
    }
    return out | (_answers(spark, o, out["graph"]) if o.qa else {})


def _answers(spark: SparkSession, o: Options, graph: DataFrame) -> dict[str, DataFrame]:
    questions = stage(readers.questions(spark, o.qa))
    ranked = stage(Q.ranked_lookup(graph, questions))
    rows = stage(Q.scored(ranked, questions, _vectors(spark, o)))
    return {"qa": sinks.per_question(rows, ranked), "qa_summary": Q.summary(rows), "qa_misses": Q.misses(rows, questions)}


def run_graph_eval(spark: SparkSession, o: Options) -> dict[str, DataFrame]:
    """Raw triples of each extractor: pairwise and incremental stability with Student's intervals, and each one's graph."""
    out: dict[str, DataFrame] = {}
    for name in o.baselines:
        t = stage(readers.extractor_log(spark, o.log, name))
        pairs = stage(S.note_pairs(t, weak=True).withColumn("ged", F.col("ged").cast("double")))
        steps = stage(S.simulate(t, o.runs, o.seed).withColumn("ged", F.col("ged").cast("double")))
        stats = [S.report(df, c).select(F.lit(name).alias("extractor"), F.lit(f"{kind}_{c}").alias("metric"), "n", "mean", "sd", "ci_lower", "ci_upper") for kind, df in (("pairwise", pairs), ("consecutive", steps)) for c in ("ged", "jaccard")]
        for s in stats:
            out["statistics"] = s if "statistics" not in out else out["statistics"].unionAll(s)
        out[f"matrix_{name}"] = S.matrix(t, weak=True)
        out[f"trajectories_{name}"] = steps
        out[f"drift_{name}"] = S.drift(pairs, o.drift_tau)
    return out


def run_qa_eval(spark: SparkSession, o: Options) -> dict[str, DataFrame]:
    """Questions over a graph file, or over each extractor's triples with repeats kept."""
    graphs = {"graph": readers.graph_file(spark, o.graph)} if o.graph else {b: readers.extractor_log(spark, o.log, b).select("s", "r", "o") for b in o.baselines}
    out: dict[str, DataFrame] = {}
    for name, graph in graphs.items():
        got = _answers(spark, o, graph)
        row = got["qa_summary"].select(F.lit(name).alias("extractor"), "*")
        out["summary"] = row if "summary" not in out else out["summary"].unionAll(row)
        out[f"questions_{name}"] = got["qa"]
    return out


def generate_aligned_qa(spark: SparkSession, o: Options) -> dict[str, DataFrame]:
    """Questions of the sets' facts, with the label map's keys as aliases."""
    sets = readers.paraphrase_sets(spark, o.log)
    named = readers.label_map(spark, o.label_map) if o.label_map else spark.createDataFrame([], "key string, relation string")
    return {"questions": Q.aligned_questions(sets.select("set_id", "fact"), named, o.qa_count)}


def compare_to_baselines(spark: SparkSession, o: Options) -> dict[str, DataFrame]:
    """A row for each extractor and one for the engine: mean GED, Jaccard and drift of sets, QA scores; none for extractors without triples.

    Unsupported shares a note and conflict records are the engine's alone. Also as the eight columns of the report.
    """
    out = None
    for name in [*o.baselines, "engine"]:
        if name == "engine":
            done = run_state_engine(spark, o)
            drift, graph, n = done["stability"], done["graph"], F.lit(1)
            more = done["support"].agg(F.avg("mean").alias("unsupported")).join(done["conflicts"].agg(F.count("*").alias("conflicts")))
        else:
            t = stage(readers.extractor_log(spark, o.log, name))
            drift, graph, n = S.drift(S.note_pairs(t, weak=True), o.drift_tau), t.select("s", "r", "o"), F.lit(int(not t.isEmpty()))
            more = spark.createDataFrame([(None, None)], "unsupported double, conflicts long")
        row = drift.agg(F.avg("mean_ged").alias("ged"), F.avg("mean_jaccard").alias("jaccard"), F.avg("drift").alias("drift"))
        qa = _answers(spark, o, graph)["qa_summary"].select("exact", "hit") if o.qa else spark.createDataFrame([(None, None)], "exact double, hit double")
        row = row.join(qa).join(more)  # a row each
        row = row.select(F.lit(name).alias("extractor"), *[F.when(n > 0, F.col(c)).alias(c) for c in row.columns])
        out = row if out is None else out.unionAll(row)
    return {"comparison": out, "comparison_table": sinks.comparison_table(out, o.drift_tau)}


def run_full_pipeline(spark: SparkSession, o: Options) -> dict[str, DataFrame]:
    """Label map, engine, graph and question evaluation, comparison: each run's reports under its name."""
    steps = {"map": build_relation_map, "engine": run_state_engine, "graph_eval": run_graph_eval, "compare": compare_to_baselines} | ({"qa_eval": run_qa_eval} if o.qa else {})
    return {f"{k}_{name}": df for k, f in steps.items() for name, df in f(spark, o).items()}


RUNS = {f.__name__: f for f in (run_state_engine, run_graph_eval, run_qa_eval, build_relation_map, generate_aligned_qa, compare_to_baselines, run_full_pipeline)}


def main(args: list[str] | None = None) -> None:
    """Run by name; each report is printed, or written as JSON lines under --out."""
    p = argparse.ArgumentParser(prog="graphloom.run")
    p.add_argument("run", choices=sorted(RUNS))
    for name, default in vars(Options()).items():
        flag = f"--{name.replace('_', '-')}"
        if isinstance(default, bool):
            p.add_argument(flag, action="store_true")
        elif isinstance(default, list):
            p.add_argument(flag, nargs="+", default=default)
        else:
            p.add_argument(flag, type=type(default) if default is not None else str, default=default)
    given = vars(p.parse_args(args))
    run = RUNS[given.pop("run")]
    o = Options(**given)
    spark = SparkSession.builder.getOrCreate()
    for name, df in run(spark, o).items():
        if o.out:
            sinks.write_json(df, f"{o.out.rstrip('/')}/{name}")
        else:
            print(f"## {name}\n{sinks.markdown(df)}")


if __name__ == "__main__":
    main()
