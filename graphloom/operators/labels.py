"""Learning label -> relation maps from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Keys that are never labels.
STOP_KEYS = ("AND", "ARE", "AT", "FOR", "IN", "IS", "OF", "ON", "OR", "THE", "TO")


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """label, gold, n of train pairs(label, gold, seq)."""
    return pairs.groupBy("label", "gold").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def argmax_map(pairs: DataFrame, ratio: float = 0.6, tie: str = "first_seq") -> DataFrame:
    """label, top, n, total, ratio, mapped: the most frequent gold, unknown below the ratio; ties by tie's order."""
    n = cooccurrence(pairs)
    label = Window.partitionBy("label")
    out = n.withColumn("total", F.sum("n").over(label)).withColumn("_k", F.row_number().over(label.orderBy(F.desc("n"), tie)))
    out = out.where("_k = 1").withColumn("ratio", F.col("n") / F.col("total"))
    mapped = F.when(F.col("ratio") >= ratio, F.col("gold")).otherwise("unknown")
    return out.select("label", F.col("gold").alias("top"), "n", "total", "ratio", mapped.alias("mapped"))


def argmax_lex(pairs: DataFrame) -> DataFrame:
    """label, top, n, total: the first by name of the most frequent golds that say something, of plausible labels.

    Where only unknown and the weak relation are most frequent, the first of these stands.
    """
    n = cooccurrence(pairs)
    label = Window.partitionBy("label")
    out = n.withColumn("total", F.sum("n").over(label)).withColumn("_m", F.max("n").over(label)).where("n = _m")
    best = out.groupBy("label").agg(F.min(F.struct(F.col("gold").isin("unknown", "related_to").alias("dull"), "gold")).alias("b"), F.max("n").alias("n"), F.max("total").alias("total"))
    best = best.where(plausible(F.col("label"), F.col("total")))
    return best.select("label", F.col("b.gold").alias("top"), "n", "total")


def plausible(key, n):
    """Whether a label is worth keeping, by its key and count."""
    bad = key.rlike("[<>\"'`]") | (F.length(key) > 56) | key.isin(*STOP_KEYS)
    return key.rlike("^LABEL_[0-9]+$") | ((n >= 2) & ~bad)
