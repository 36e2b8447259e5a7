"""Questions over a graph: ranked lookup, scores, aliases, lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import relation as R
from ..functions import text as T
from ..sources.shared import stage
from ..functions import vector as V


#: Rows of a graph that a task of a lookup holds, on average.
PIECE = 1 << 18


def pieces(graph: DataFrame) -> int:
    """Partitions for a lookup in the graph: they grow with its rows, so that what a task sorts and counts does not."""
    return max(graph.sparkSession.sparkContext.defaultParallelism, -(-graph.count() // PIECE))


def ranked_lookup(graph: DataFrame, questions: DataFrame, n: int | None = None) -> DataFrame:
    """q_id, rank, answer, n: candidates of questions(q_id, s, relations, o), one of s and o being "?".

    relations: the relation and its aliases; repeats after lower-casing count again. Ranked by count, then name.
    n: partitions (see `pieces`). Triples are counted where they have been dealt, not where they are read, whose pieces
    may be of any size; a triple that is there very often is dealt to several tasks first.
    """
    n = n or pieces(graph)
    q = questions.where((F.col("s") == "?") != (F.col("o") == "?"))
    q = q.withColumn("_all", F.transform("relations", lambda r: F.lower(F.trim(r)))).withColumn("_r", F.explode(F.array_distinct("_all")))
    q = q.withColumn("times", F.size(F.filter("_all", lambda r: r == F.col("_r"))))
    q = q.select("q_id", "_r", "times", F.when(F.col("o") == "?", T.qa_entity(F.col("s"))).alias("_s"), F.when(F.col("s") == "?", T.qa_entity(F.col("o"))).alias("_o"))
    triple = ["s", "_r", "o", "_at"]
    g = graph.select("s", F.lower(F.trim("r")).alias("_r"), "o", (F.spark_partition_id() % 16).alias("_at"))
    g = g.repartition(n, *triple).groupBy(*triple).agg(F.count("*").alias("n"))

    def asked(known: str, end: str, answer: str) -> DataFrame:
        side = g.select(T.qa_entity(F.col(end)).alias(known), "_r", F.col(answer).alias("answer"), "n").where(F.col(known).isNotNull() & F.col("_r").isNotNull())
        ask = q.where(F.col(known).isNotNull()).select("q_id", "_r", known, "times").repartition(n, known, "_r")
        return ask.join(side.repartition(n, known, "_r"), [known, "_r"]).select("q_id", "answer", (F.col("n") * F.col("times")).alias("n"))

    found = asked("_s", "s", "o").unionAll(asked("_o", "o", "s")).repartition(n, "q_id").groupBy("q_id", "answer").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("q_id").orderBy(F.desc("n"), F.lower("answer"), "answer")
    return found.withColumn("rank", F.row_number().over(w)).select("q_id", F.col("rank").cast("long").alias("rank"), "answer", "n")


def metrics(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """n, exact (any candidate is the answer), top1, mrr over valid questions(q_id, answer)."""
    gold = questions.where((F.col("s") == "?") != (F.col("o") == "?")).select("q_id", T.qa_entity(F.col("answer")).alias("gold"))
    hit = gold.join(ranked.select("q_id", "rank", T.qa_entity(F.col("answer")).alias("said")), "q_id", "left")
    best = hit.groupBy("q_id").agg(F.min(F.when(F.col("said") == F.col("gold"), F.col("rank"))).alias("at"))
    return best.agg(
        F.count("*").alias("n"), F.avg(F.col("at").isNotNull().cast("double")).alias("exact"),
        F.avg(F.coalesce((F.col("at") == 1).cast("double"), F.lit(0.0))).alias("top1"), F.avg(F.coalesce(1 / F.col("at"), F.lit(0.0))).alias("mrr"),
    )


def preferred_surface(mentions: DataFrame) -> DataFrame:
    """canonical, surface, n: the most frequent surface of mentions(canonical, surface, seq), the latest on a tie."""
    n = mentions.groupBy("canonical", "surface").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    return n.groupBy("canonical").agg(F.max_by("surface", F.struct("n", "last")).alias("surface"), F.max("n").alias("n"))


def expand_aliases(graph: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct triples with every alias(canonical, surface) of both ends; ends without any stand for themselves."""
    a = aliases.select("canonical", "surface").distinct()
    out = graph.select("s", "r", "o").distinct()
    for end in ("s", "o"):
        named = a.select(F.col("canonical").alias(end), F.col("surface").alias(f"_{end}"))
        out = out.join(named, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}").select("s", "r", "o")
    return out.distinct()


#: Least similarity of a semantic hit and of an exact one; lines given to a model.
RECALL_AT, EXACT_AT, LINES = 0.75, 0.90, 100


def similar(candidates: DataFrame, vectors: DataFrame, n: int | None = None) -> DataFrame:
    """candidates(q_id, rank, answer, gold) with `similarity`: 1 for one entity, else the cosine of their vectors(surface, embedding).

    Missing vectors and empty texts are 0 apart. Each distinct pair of texts is compared once. n: partitions of the candidates.
    """
    if n:
        candidates = candidates.repartition(n, "answer", "gold")
    pairs = candidates.select("answer", "gold").distinct()
    v = vectors.select(F.col("surface").alias("_s"), F.col("embedding").alias("_e")).dropDuplicates(["_s"])
    told = pairs.join(v.withColumnRenamed("_e", "_a"), F.trim("answer") == F.col("_s"), "left").drop("_s")
    told = told.join(v.withColumnRenamed("_e", "_g"), F.trim("gold") == F.col("_s"), "left").drop("_s")
    empty = (F.trim(F.coalesce("answer", F.lit(""))) == "") | (F.trim(F.coalesce("gold", F.lit(""))) == "")
    same = T.qa_entity(F.col("answer")) == T.qa_entity(F.col("gold"))
    told = told.select("answer", "gold", F.when(empty, 0.0).when(same, 1.0).otherwise(V.cosine(F.col("_a"), F.col("_g"))).alias("similarity"))
    return candidates.join(told, (candidates["answer"].eqNullSafe(told["answer"])) & (candidates["gold"].eqNullSafe(told["gold"]))).select(candidates["*"], "similarity")


def valid(questions: DataFrame) -> DataFrame:
    """questions with `error` where not exactly one of s and o is asked for."""
    return questions.withColumn("error", F.when((F.col("s") == "?") == (F.col("o") == "?"), "exactly one of subject and object must be ?"))


def scored(ranked: DataFrame, questions: DataFrame, vectors: DataFrame, recall_at: float = RECALL_AT, exact_at: float = EXACT_AT, n: int | None = None) -> DataFrame:
    """A row for every question(q_id, s, o, answer): error, n_candidates, best, exact, hit, top1, rr; all null with an error. n: see `ranked_lookup`."""
    q = valid(questions).select("q_id", "error", F.col("answer").alias("gold"))
    told = similar(ranked.join(q.select("q_id", "gold"), "q_id").select("q_id", "rank", "answer", "gold"), vectors, n)
    sums = (told.repartition(n, "q_id") if n else told).groupBy("q_id").agg(
        F.count("*").alias("n"), F.max("similarity").alias("best"), F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("first"),
        F.min(F.when(F.col("similarity") >= exact_at, F.col("rank"))).alias("at"),
    )
    out = q.join(sums, "q_id", "left")
    ok = lambda c: F.when(F.col("error").isNull(), c)
    best = F.coalesce("best", F.lit(0.0))
    return out.select(
        "q_id", "error", ok(F.coalesce("n", F.lit(0))).alias("n_candidates"), ok(best).alias("best"), ok(best >= exact_at).alias("exact"), ok(best >= recall_at).alias("hit"),
        ok(F.coalesce("first", F.lit(0.0)) >= exact_at).alias("top1"), ok(F.coalesce(1 / F.col("at"), F.lit(0.0))).alias("rr"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """n, exact, hit, top1, mrr over the questions without an error; zeros for none."""
    share = lambda c, name: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(name)
    return rows.where("error is null").agg(F.count("*").alias("n"), share("exact", "exact"), share("hit", "hit"), share("top1", "top1"), share("rr", "mrr"))


def misses(rows: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """The first k questions without a hit, and the edge that the graph lacks: q_id, s, r, o."""
    q = questions.select("q_id", "s", F.col("relations")[0].alias("r"), "o", "answer")
    lost = rows.where("error is null and not hit").select("q_id").join(q, "q_id").orderBy("q_id").limit(k)
    fill = lambda c: F.when(F.col(c) == "?", F.col("answer")).otherwise(F.col(c)).alias(c)
    return lost.select("q_id", fill("s"), "r", fill("o"))


def qa_graph(engine: DataFrame, aligned: DataFrame, policy: str = "union") -> DataFrame:
    """Sorted distinct triples to ask: the engine's, the aligned ones, or both (any other policy is both)."""
    e, a = engine.select("s", "r", "o"), aligned.select("s", "r", "o")
    graph = {"engine": e, "aligned_union": a}.get(policy, e.unionByName(a))
    return graph.distinct().orderBy("s", "r", "o")


def retrieve(questions: DataFrame, lines: DataFrame, k: int = LINES, anchor_points: int = 4) -> DataFrame:
    """q_id, line_id, score, rank: the k best lines(line_id, text) for each of questions(q_id, anchors).

    A line scores a point for each distinct word that the anchors hold, and anchor_points for each anchor of more than
    two characters that it contains, letters' case aside; null, empty and "?" anchors are none. Ties go to the smaller id.
    Lines that score nothing are not returned.

    Terms (anchors and words) have posting lists of line ids. An anchor can only lie in a line that holds its rarest run of
    three characters: ids meet by that run, and the text of those lines alone is fetched to look. A question first
    scores the lines of its heaviest, then rarest term; its k-th best score so far is a bar. Terms that together weigh
    less than the bar bring no line that others don't, so their lists are left alone; a question whose other terms all
    weigh less is done. Questions with the same terms, as far as any line has them, are scored as one.
    """
    usable = F.filter(F.transform("anchors", lambda x: F.lower(F.trim(x))), lambda x: (x != "") & (x != "?") & x.isNotNull())
    q = questions.select("q_id", usable.alias("anchors")).select("q_id", F.filter("anchors", lambda x: F.length(x) > 2).alias("long"), T.overlap_words(F.array_join("anchors", " ")).alias("ws"))
    low = lines.select("line_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))

    runs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(...))"), F.lit(1)))  # noqa: E731  one pass, however long the text
    run = q.select(F.explode("long").alias("a")).distinct().select("a", F.explode(runs(F.col("a"))).alias("g"))
    held = low.where(F.length("text") > 2).select("line_id", F.explode(runs(F.col("text"))).alias("g")).join(run.select("g").distinct(), "g", "left_semi")
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    rare = run.join(often, "g", "left").groupBy("a").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("g"))
    maybe = rare.join(held, "g").groupBy("line_id").agg(F.collect_list("a").alias("la"))
    inside = maybe.join(low, "line_id").select("line_id", F.filter("la", lambda x: F.contains(F.col("text"), x)).alias("la"))
    held_by = stage(low.select("line_id", T.overlap_words(F.col("text")).alias("lw")).join(inside, "line_id", "left").withColumn("la", F.coalesce("la", F.array().cast("array<string>"))))

    told = lambda name, c: F.transform(c, lambda x: F.concat(F.lit(name), x))
    term = q.select("q_id", F.explode(F.concat(told("a", "long"), told("w", "ws"))).alias("t")).groupBy("q_id", "t").agg(F.count("*").alias("n"))
    term = term.select("q_id", "t", (F.col("n") * F.when(F.col("t").startswith("a"), anchor_points).otherwise(1)).alias("weight"))
    post = stage(held_by.select("line_id", F.explode(F.concat(told("a", "la"), told("w", "lw"))).alias("t")).join(term.select("t").distinct(), "t", "left_semi"))
    hit = term.join(post.groupBy("t").agg(F.count("*").alias("df")), "t")
    # terms without a line tell nothing: questions whose other terms and weights are the same are asked once
    same = stage(hit.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("t", "weight", "df"))).alias("ts")))
    kinds = stage(same.groupBy("ts").agg(F.min("q_id").alias("kind")))
    of_kind = same.join(kinds, "ts").select("q_id", "kind")
    term = stage(kinds.select("kind", F.explode("ts").alias("x")).select("kind", "x.*"))

    def scored(pairs: DataFrame) -> DataFrame:
        """Every pair's score: the weights of the kind's terms among those of the line."""
        asks = term.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("t", "weight"))).alias("ws"))
        has = held_by.select("line_id", F.concat(told("a", "la"), told("w", "lw")).alias("ts"))
        both = pairs.join(has, "line_id").join(asks, "kind")
        return both.select("kind", "line_id", F.aggregate(F.map_values(F.map_filter("ws", lambda t, _: F.array_contains("ts", t))), F.lit(0).cast("long"), lambda a, x: a + x).cast("int").alias("score"))

    def best(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("kind").orderBy(F.desc("score"), "line_id")
        return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    of = Window.partitionBy("kind")
    first = term.withColumn("rest", F.sum("weight").over(of) - F.col("weight")).withColumn("_n", F.row_number().over(of.orderBy(F.desc("weight"), "df", "t"))).where("_n = 1")
    one = stage(best(scored(first.select("kind", "t").join(post, "t").select("kind", "line_id"))))
    bars = one.where(F.col("rank") == k).select("kind", F.col("score").alias("bar"))
    bars = stage(first.select("kind", "rest").join(bars, "kind", "left"))
    upward = F.sum("weight").over(of.orderBy("weight", F.desc("df"), "t").rowsBetween(Window.unboundedPreceding, 0))
    needed = term.withColumn("_up", upward).join(bars.where("bar is null or rest >= bar"), "kind").where("bar is null or _up >= bar")
    more = best(scored(needed.select("kind", "t").join(post, "t").select("kind", "line_id").distinct()))
    found = one.join(bars.where("bar is not null and rest < bar"), "kind", "left_semi").unionByName(more)
    return of_kind.join(found, "kind").select("q_id", "line_id", "score", "rank")


def prompt(lines: DataFrame, retrieved: DataFrame, questions: DataFrame) -> DataFrame:
    """q_id, prompt: the question under its retrieved lines, in order of rank; for a model's hook (extract.with_model's kind)."""
    told = retrieved.join(lines.select("line_id", "text"), "line_id").groupBy("q_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("_l"))
    out = questions.join(told, "q_id", "left")
    return out.select("q_id", F.concat(F.lit("Facts:\n"), F.coalesce("_l", F.lit("")), F.lit("\nQuestion: "), F.col("question"), F.lit("\nAnswer with one name.")).alias("prompt"))


def aligned_questions(facts: DataFrame, label_map: DataFrame, limit: int | None = None) -> DataFrame:
    """q_id, question, s, relations, o, answer: two questions of each fact(set_id, fact) that parses, in order of sets.

    relations: the fact's, and the label map's keys for it as aliases, sorted. limit: how many questions at most.
    """
    d = facts.select("set_id", R.parse_fact(F.col("fact")).alias("p")).where("p is not null").select("set_id", "p.s", "p.r", "p.o")
    alias = label_map.groupBy(F.col("relation").alias("_r")).agg(F.array_sort(F.collect_set("key")).alias("_a"))
    d = d.join(alias, F.col("r") == F.col("_r"), "left")
    d = d.select("set_id", "s", "r", "o", F.concat(F.array("r"), F.coalesce("_a", F.array().cast("array<string>"))).alias("relations"), F.posexplode(R.questions(F.col("s"), F.col("r"), F.col("o"))).alias("pos", "question"))
    out = d.select(
        (F.col("set_id") * 2 + F.col("pos")).cast("long").alias("q_id"), "question", F.when(F.col("pos") == 0, F.col("s")).otherwise("?").alias("s"), "relations",
        F.when(F.col("pos") == 0, F.lit("?")).otherwise(F.col("o")).alias("o"), F.when(F.col("pos") == 0, F.col("o")).otherwise(F.col("s")).alias("answer"),
    )
    return out if limit is None else out.orderBy("q_id").limit(limit)
