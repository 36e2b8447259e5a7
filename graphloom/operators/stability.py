"""Stability of graphs over notes: edit distance, Jaccard, drift, support, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relation import WEAK


def edit_distance(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def note_graphs(triples: DataFrame, weak: bool = False) -> DataFrame:
    """set_id, note, g: the note's distinct triples. Notes left without any stay, with an empty graph."""
    t = F.concat_ws("|", "s", "r", "o")
    return triples.groupBy("set_id", "note").agg(F.collect_set(t if weak else F.when(F.col("r") != WEAK, t)).alias("g"))


#: notes of a triple up to which its pairs are made from one list
SHARED = 64


def shared_counts(held: DataFrame) -> DataFrame:
    """set_id, i, j, c: how many triples of held(set_id, note, t), which are distinct, the notes i < j share; only pairs that share one.

    An inverted list: each triple tells which notes hold it. A triple of more than SHARED notes is joined with itself
    instead, so that no row holds all its pairs. Counts are added up before the shuffle.
    """
    notes = held.groupBy("set_id", "t").agg(F.count("*").alias("n")).where("n > 1")
    few = held.join(notes.where(F.col("n") <= SHARED), ["set_id", "t"], "left_semi").groupBy("set_id", "t").agg(F.array_sort(F.collect_list("note")).alias("x"))
    later = F.transform("x", lambda i, at: F.transform(F.slice("x", at + 2, F.lit(SHARED)), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    cold = few.select("set_id", F.explode(F.flatten(later)).alias("p")).select("set_id", "p.i", "p.j")
    many = held.join(notes.where(F.col("n") > SHARED), ["set_id", "t"], "left_semi")
    hot = many.withColumnRenamed("note", "i").join(many.withColumnRenamed("note", "j"), ["set_id", "t"]).where("i < j").select("set_id", "i", "j")
    return cold.unionByName(hot).groupBy("set_id", "i", "j").agg(F.count("*").alias("c"))


def note_pairs(triples: DataFrame, weak: bool = False) -> DataFrame:
    """set_id, i, j, ged, jaccard of the notes i < j of each set: what two notes share comes from inverted lists, the rest from their sizes.

    No graphs are compared pair by pair; a note without triples is an empty graph.
    """
    t = F.struct("s", "r", "o")
    held = triples.select("set_id", "note", (t if weak else F.when(F.col("r") != WEAK, t)).alias("t")).distinct()
    sizes = held.groupBy("set_id", "note").agg(F.count("t").alias("n"))
    a, b = (sizes.select("set_id", F.col("note").alias(x), F.col("n").alias(n)) for x, n in (("i", "a"), ("j", "b")))
    every = a.join(b, "set_id").where("i < j").withColumn("c", F.lit(0).cast("long"))
    told = shared_counts(held.where("t is not null")).select("set_id", "i", "j", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "c")
    both = every.unionByName(told).groupBy("set_id", "i", "j").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.sum("c").alias("c"))
    share = F.when(F.expr("a + b = 0"), F.lit(1.0)).otherwise(F.col("c") / F.expr("a + b - c"))
    return both.select("set_id", "i", "j", F.expr("a + b - 2 * c").alias("ged"), share.alias("jaccard"))


def drift(pairs: DataFrame, tau: float = 0.2) -> DataFrame:
    """Per set: pairs, mean ged and jaccard, share of pairs whose distance is tau or more."""
    return pairs.groupBy("set_id").agg(
        F.count("*").alias("n_pairs"), F.avg("ged").alias("mean_ged"), F.avg("jaccard").alias("mean_jaccard"),
        F.avg((F.lit(1.0) - F.col("jaccard") >= F.lit(float(tau))).cast("double")).alias("drift"),
    )


def summarize(df: DataFrame, value: str, z: float = 1.96) -> DataFrame:
    """n, mean, sd (0 for one value) and the normal confidence interval of a column."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    row = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"))
    half = F.lit(z) * F.col("sd") / F.sqrt("n")
    return row.withColumn("ci_lower", F.col("mean") - half).withColumn("ci_upper", F.col("mean") + half)


def unsupported_rate(graph: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per set: share of the graph's triples that the evidence lacks. An anti join, then counts."""
    key = ["set_id", "s", "r", "o"]
    total = graph.select(*key).distinct().groupBy("set_id").agg(F.count("*").alias("n_edges"))
    lost = graph.select(*key).distinct().join(evidence.select(*key).distinct(), key, "left_anti").groupBy("set_id").agg(F.count("*").alias("n_unsupported"))
    out = total.join(lost, "set_id", "left").na.fill(0, ["n_unsupported"])
    return out.withColumn("rate", F.col("n_unsupported") / F.col("n_edges"))


def note_support(graph: DataFrame, notes: DataFrame) -> DataFrame:
    """Per set: mean, max and min over notes of the share of the graph that a note lacks.

    What a note holds of the graph is an equi-join; notes without any hit still count, as wholly unsupported.
    """
    key = ["set_id", "s", "r", "o"]
    g = graph.select(*key).distinct()
    n = g.groupBy("set_id").agg(F.count("*").alias("n_edges"))
    held = notes.select(*key, "note").distinct().join(g, key).groupBy("set_id", "note").agg(F.count("*").alias("hits"))
    every = notes.select("set_id", "note").distinct().join(n, "set_id").join(held, ["set_id", "note"], "left").na.fill(0, ["hits"])
    rate = 1 - F.col("hits") / F.col("n_edges")
    return every.groupBy("set_id").agg(F.avg(rate).alias("mean"), F.max(rate).alias("max"), F.min(rate).alias("min"))


def consecutive(triples: DataFrame) -> DataFrame:
    """ged and jaccard of each note with the one before it."""
    w = Window.partitionBy("set_id").orderBy("note")
    g = note_graphs(triples, weak=True).withColumn("before", F.lag("g").over(w)).where("before is not null")
    return g.select("set_id", "note", edit_distance(F.col("before"), F.col("g")).alias("ged"), jaccard(F.col("before"), F.col("g")).alias("jaccard"))


def student_t95(n: Column) -> Column:
    """Two-sided 95 % quantile of Student's t with n - 1 degrees of freedom, by the Cornish-Fisher series above 10."""
    # Quantiles for 1 to 10 degrees of freedom.
    table = (12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139)
    df, z = (n - 1).cast("double"), 1.959963985
    g1, g2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    series = F.lit(z) + g1 / df + g2 / (df * df) + g3 / (df * df * df)
    return F.when(n <= 11, F.get(F.array(*[F.lit(x) for x in table]), (n - 2).cast("int"))).otherwise(series)


def report(df: DataFrame, value: str) -> DataFrame:
    """n, mean, sd and Student's interval; all null for no value."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    row = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) > 0, sd).alias("sd"))
    half = F.when(F.col("n") > 1, student_t95(F.col("n")) * F.col("sd") / F.sqrt("n")).otherwise(F.when(F.col("n") == 1, F.lit(0.0)))
    return row.withColumn("ci_lower", F.col("mean") - half).withColumn("ci_upper", F.col("mean") + half)


def pairwise(triples: DataFrame, weak: bool = False) -> DataFrame:
    """set_id, ged, jaccard: arrays over the pairs of notes in order; [0.0] and [1.0] for a set of fewer than two notes."""
    pairs = note_pairs(triples, weak).groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", F.col("ged").cast("double").alias("ged"), "jaccard"))).alias("p"))
    out = triples.select("set_id").distinct().join(pairs, "set_id", "left")
    one = lambda c, empty: F.coalesce(F.transform("p", lambda x: x[c]), F.array(F.lit(empty))).alias(c)
    return out.select("set_id", one("ged", 0.0), one("jaccard", 1.0))


def matrix(triples: DataFrame, weak: bool = False) -> DataFrame:
    """set_id, i, j, ged, jaccard of all ordered pairs of notes, each with itself, too: a row a cell.

    Where all of a set's notes are empty there is nothing to compare: its cells off the diagonal are null.
    """
    g = note_graphs(triples, weak)
    some = g.groupBy("set_id").agg(F.max(F.size("g")).alias("most"))
    pairs = note_pairs(triples, weak).join(some, "set_id")
    told = F.col("most") > 0
    cells = pairs.select("set_id", "i", "j", F.when(told, F.col("ged").cast("double")).alias("ged"), F.when(told, F.col("jaccard")).alias("jaccard"))
    turned = cells.select("set_id", F.col("j").alias("i"), F.col("i").alias("j"), "ged", "jaccard")
    own = g.select("set_id", F.col("note").alias("i"), F.col("note").alias("j"), F.lit(0.0).alias("ged"), F.lit(1.0).alias("jaccard"))
    return cells.unionByName(turned).unionByName(own)


def against_others(cells: DataFrame) -> DataFrame:
    """set_id, note, mean_ged, mean_jaccard of each note with all others: the matrix's row means without the diagonal."""
    off = cells.where("i <> j")
    return off.groupBy("set_id", F.col("i").alias("note")).agg(F.avg("ged").alias("mean_ged"), F.avg("jaccard").alias("mean_jaccard"))


def conflict_precision(conflicts: DataFrame, genuine: Column | None = None) -> Column:
    """Share of conflicts that are genuine (all, unless told); 1 where there are none. An aggregate for conflicts' rows."""
    return F.coalesce(F.avg((F.lit(True) if genuine is None else genuine).cast("double")), F.lit(1.0))


def orders(notes: DataFrame, runs: int = 10, seed: int = 42) -> DataFrame:
    """set_id, run, step, note: `runs` keyed shuffles of each set's notes(set_id, note)."""
    keyed = notes.select("set_id", "note").distinct().withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    key = F.md5(F.concat_ws(":", F.lit(seed), "run", "set_id", "note"))
    step = F.row_number().over(Window.partitionBy("set_id", "run").orderBy(key, "note")) - 1
    return keyed.withColumn("step", step).select("set_id", "run", "step", "note")


def simulate(triples: DataFrame, runs: int = 10, seed: int = 42) -> DataFrame:
    """set_id, run, step, ged, jaccard, conflicts: each step shows the next note's graph, compared with the one before.

    ged and jaccard are null at step 0. conflicts: unordered pairs of relations that one subject and object has in the
    note. A note's graph and conflicts are made once, however many runs show it.
    """
    g = note_graphs(triples, weak=True)
    t = triples.select("set_id", "note", "s", "r", "o").distinct()
    per = t.groupBy("set_id", "note", "s", "o").agg(F.count("*").alias("n")).groupBy("set_id", "note").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("conflicts"))
    shown = orders(triples, runs, seed).join(g, ["set_id", "note"]).join(per, ["set_id", "note"])
    before = F.lag("g").over(Window.partitionBy("set_id", "run").orderBy("step"))
    shown = shown.withColumn("_b", before)
    return shown.select("set_id", "run", "step", edit_distance(F.col("_b"), F.col("g")).alias("ged"), F.when(F.col("_b").isNotNull(), jaccard(F.col("_b"), F.col("g"))).alias("jaccard"), "conflicts")


def t_probability(t: Column, df: Column, steps: int = 2000) -> Column:
    """Two-sided probability of Student's t: a Simpson sum of cos(x) ** (df - 1) up to atan(t / sqrt(df)) over that up to pi / 2."""

    def integral(top: Column) -> Column:
        h = top / steps
        weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, i: a + weight(i) * F.pow(F.greatest(F.cos(h * i), F.lit(0.0)), df - 1)) * h / 3

    return 1.0 - integral(F.atan(F.abs(t) / F.sqrt(df))) / integral(F.lit(1.5707963267948966))


def paired_t(pairs: DataFrame, by: str = "metric") -> DataFrame:
    """metric, n, t, p of pairs(metric, a, b): Student's test of the differences; t and p are null below two pairs or without spread."""
    d = F.col("a") - F.col("b")
    row = pairs.where("a is not null and b is not null").groupBy(by).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("m") / (F.col("sd") / F.sqrt("n")))
    return row.withColumn("t", t).select(by, "n", "t", F.when(F.col("t").isNotNull(), t_probability(F.col("t"), (F.col("n") - 1).cast("double"))).alias("p"))


def as_set(triples: DataFrame, s: Column, o: Column) -> DataFrame:
    """Distinct triples by normalised ends and trimmed relation; triples with an empty end go."""
    return triples.select("set_id", s.alias("s"), F.trim("r").alias("r"), o.alias("o")).where("s <> '' and o <> ''").distinct()
