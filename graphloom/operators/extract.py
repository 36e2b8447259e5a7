"""Extractors: a deterministic one for facts, hooks for models, and their training rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import relation as R
from ..functions import text as T


def from_facts(sets: DataFrame) -> DataFrame:
    """set_id, note, seq, fact, s, r, o: the fact's own triple for each paraphrase of sets(set_id, fact, paraphrases)."""
    d = sets.withColumn("_f", R.parse_fact(F.col("fact"))).where("_f is not null")
    d = d.select("set_id", "fact", "_f", F.posexplode("paraphrases").alias("note", "_t"))
    return d.select("set_id", "note", F.col("note").cast("long").alias("seq"), "fact", "_f.s", "_f.r", "_f.o")


def with_model(texts: DataFrame, process: Callable[[list[str]], list[list[tuple]]], batch: int = 64) -> DataFrame:
    """id, pos, s, r, o: process gets batches of texts and gives their triples; distinct by text, negative labels dropped."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                rows = [(i, n, *map(str, t[:3])) for i, ts in zip(part["id"], process(part["text"].fillna("").tolist()), strict=True) for n, t in enumerate(ts)]
                yield pd.DataFrame(rows, columns=["id", "pos", "s", "r", "o"])

    raw = texts.select(F.col("id").cast("long").alias("id"), "text").mapInPandas(run, "id long, pos long, s string, r string, o string")
    clean = raw.select("id", "pos", T.squeeze(F.col("s")).alias("s"), R.head_label(F.col("r")).alias("r"), T.squeeze(F.col("o")).alias("o")).where("r is not null")
    w = Window.partitionBy("id", "s", "r", "o").orderBy("pos")
    return clean.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def from_llm_lines(answers: DataFrame) -> DataFrame:
    """id, pos, s, r, o of a model's answer(id, text): one triple a line."""
    lines = answers.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("t", T.triple_line(F.col("line")))
    return lines.where("t is not null").select("id", "pos", "t.s", "t.r", "t.o")


def entity_pairs(docs: DataFrame) -> DataFrame:
    """doc, i, j with i < j for all entities of a document(doc, entities)."""
    n = F.size("entities")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return docs.where(n > 1).select("doc", F.explode(pairs).alias("p")).select("doc", "p.i", "p.j")


def negatives(docs: DataFrame, ratio: float = 1.0, first: str = "Chemical", second: str = "Disease") -> DataFrame:
    """doc, head, tail: pairs of both types that no relation of docs(doc, entities, relations) joins, at most max(1, int(positives * ratio)) each."""
    e = docs.select("doc", F.posexplode("entities").alias("i", "e")).select("doc", "i", F.col("e.type").alias("type"))
    a, b = e.where(F.col("type") == first).select("doc", F.col("i").alias("head")), e.where(F.col("type") == second).select("doc", F.col("i").alias("tail"))
    gold = docs.select("doc", F.explode("relations").alias("r")).select("doc", F.col("r.head").alias("head"), F.col("r.tail").alias("tail")).distinct()
    cap = docs.select("doc", F.greatest(F.lit(1), F.floor(F.size("relations") * ratio)).alias("cap"))
    left = a.join(b, "doc").join(gold, ["doc", "head", "tail"], "left_anti")
    w = Window.partitionBy("doc").orderBy("head", "tail")
    return left.withColumn("_n", F.row_number().over(w)).join(cap, "doc").where(F.col("_n") <= F.col("cap")).select("doc", "head", "tail")


def bio_tags(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """doc, pos, tag of tokens(doc, pos, start, stop): B- on an entity's first token, I- on its others, O elsewhere."""
    e = entities.select("doc", F.col("start").alias("s0"), F.col("stop").alias("s1"), "type")
    hit = tokens.join(e, "doc").where("start < s1 and stop > s0 and stop > start")
    w = Window.partitionBy("doc", "s0", "s1").orderBy("pos")
    tagged = hit.withColumn("tag", F.concat(F.when(F.row_number().over(w) == 1, "B-").otherwise("I-"), "type"))
    tagged = tagged.groupBy("doc", "pos").agg(F.min_by("tag", F.struct("s0", "s1")).alias("tag"))
    return tokens.select("doc", "pos").join(tagged, ["doc", "pos"], "left").select("doc", "pos", F.coalesce("tag", F.lit("O")).alias("tag"))


def bio_spans(tags: DataFrame) -> DataFrame:
    """doc, start, stop, label, confidence of tags(doc, pos, start, stop, tag, confidence): runs of one label; a new label or B- opens the next."""
    by = Window.partitionBy("doc").orderBy("pos")
    label = F.regexp_replace("tag", "^[BI]-", "")
    opens = F.col("tag").startswith("B-") | (label != F.coalesce(F.lag(label).over(by), F.lit("O")))
    d = tags.withColumn("label", label).withColumn("_run", F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("tag <> 'O'").groupBy("doc", "_run", "label").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("confidence").alias("confidence")).drop("_run")


def classification_report(pairs: DataFrame) -> DataFrame:
    """label, n, precision, recall, f1 of pairs(gold, predicted), by their counts."""
    n = pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    gold = n.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    said = n.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    d = gold.join(said, "label", "left").na.fill(0, ["said"])
    p, r = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0), F.col("tp") / F.col("support")
    return d.select("label", F.col("support").alias("n"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def span_report(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, n, precision, recall, f1 of spans(doc, start, stop, label): a span is right if the other side has the same."""
    key = ["doc", "start", "stop", "label"]
    g, p = gold.select(*key).distinct(), predicted.select(*key).distinct()
    tp = g.join(p, key).groupBy("label").agg(F.count("*").alias("tp"))
    d = g.groupBy("label").agg(F.count("*").alias("n")).join(p.groupBy("label").agg(F.count("*").alias("said")), "label", "full").join(tp, "label", "left").na.fill(0, ["n", "said", "tp"])
    precision, recall = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0), F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0)
    d = d.select("label", "n", precision.alias("precision"), recall.alias("recall"))
    return d.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def accuracy(pairs: DataFrame) -> DataFrame:
    """n, accuracy, weighted_f1 (by support) of pairs(gold, predicted)."""
    right = pairs.agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy"))
    f1 = classification_report(pairs).agg((F.sum(F.col("f1") * F.col("n")) / F.sum("n")).alias("weighted_f1"))
    return right.join(F.broadcast(f1))  # a row each


def oriented(rows: DataFrame) -> DataFrame:
    """id, pos, s, r, o of an extractor's rows(id, pos, s, r, o, head_type, tail_type) in the question schema; distinct by text."""
    d = rows.select("id", "pos", R.oriented_row(F.col("s"), F.col("r"), F.col("o"), F.col("head_type"), F.col("tail_type")).alias("t")).where("t is not null")
    return d.groupBy("id", "t").agg(F.min("pos").alias("pos")).select("id", "pos", "t.s", "t.r", "t.o")


def with_ids(triples: DataFrame, mapper: DataFrame) -> DataFrame:
    """triples with both ends as the mapper's(key, cui) identifiers; ends without one pass through."""
    out = triples
    for end in ("s", "o"):
        m = mapper.select(F.col("key").alias("_k"), F.col("cui").alias("_c"))
        out = out.join(m, T.mapper_key(F.col(end)) == F.col("_k"), "left").withColumn(end, F.coalesce("_c", end)).drop("_k", "_c")
    return out


def scored_pairs(scores: DataFrame, least: float = 0.5, negatives: bool = False) -> DataFrame:
    """Pairs of scores(doc, i, j, logit, label) whose sigmoid is `least` or more; negative labels only if asked for."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    kept = scores.withColumn("probability", p).where(F.col("probability") >= least)
    return kept if negatives else kept.where(R.head_label(F.col("label")).isNotNull())


def or_else(extracted: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples(id, s, r, o), and for ids without any a "causes" triple of the first chemical and the first disease, if both are there."""
    e = entities.select("id", "pos", "text", R.type_bucket(F.col("type")).alias("t"))
    first = e.groupBy("id").agg(F.min_by("text", F.when(F.col("t") == "chemical", F.col("pos"))).alias("s"), F.min_by("text", F.when(F.col("t") == "disease", F.col("pos"))).alias("o"))
    both = first.where("s is not null and o is not null").select("id", "s", F.lit("causes").alias("r"), "o")
    return extracted.select("id", "s", "r", "o").unionByName(both.join(extracted.select("id").distinct(), "id", "left_anti"))
