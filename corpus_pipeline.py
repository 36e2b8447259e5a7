"""Documents to packed training sequences: toxic texts out, near copies out, personal data replaced, mixed, packed.

Every stage takes null in any column, empty and very long texts, repeated rows and empty tables: a null text is empty and
stays null, rows with null ids are rows of their own, an empty table gives an empty one. Columns that begin with an
underscore are the stages' own and may not be in `documents`.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, packing, pii, shingles, toxicity
from graphloom.llm.common import stage, text_or_empty


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from `labels`, doesn't call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "_toxic_score").where("_toxic_score < 0.5").drop("_toxic_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group that texts with a Jaccard similarity of 0.8 or more form.

    Rows are told by id and text, so texts that share an id are judged apart; null ids come last. Of rows that have both
    in common one stays.
    """
    none, key = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))
    keyed = docs.withColumn("_hash", F.md5(text_or_empty().cast("binary"))).withColumn("_none", none).withColumn("_key", key)
    roots = stage(shingles.near_copies(docs), "roots").withColumnRenamed("hash", "_h").withColumnRenamed("root", "_root")
    ids = keyed.groupBy("_hash").agg(F.min(F.struct("_none", "_key")).alias("first"))
    best = ids.join(roots, F.col("_hash") == F.col("_h")).groupBy("_root").agg(F.min(F.struct("first", "_hash")).alias("k"))
    best = best.select("k._hash", "k.first._none", "k.first._key")
    kept = keyed.join(best, ["_hash", "_none", "_key"], "left_semi")
    return kept.dropDuplicates(["_hash", "_none", "_key"]).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data; all rows stay."""
    return pii.anonymise(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each drawn copy of a row, none to two, in ranges by shard and shuffled within the shard."""
    rows = stage(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "rows")
    drawn = mixing.mix(rows, carry=("_mix_row",)).where("copies > 0").select("_mix_row", "position", F.posexplode("shards").alias("_copy", "_shard"))
    drawn = drawn.withColumn("_place", F.xxhash64("position", "_copy", "_mix_row")).drop("position", "_copy")
    placed = rows.join(drawn, "_mix_row").repartitionByRange("_shard", "_place").sortWithinPartitions("_shard", "_place")
    return placed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 4096 ids, and the ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: No stage can be written in SQL. Near copies and mixing are tested against brute force here, the others as operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = reduce(lambda d, s: stage(s[1](spark, d, sf_dir), s[0]), STAGES[:-1], docs)
    return STAGES[-1][1](spark, docs, sf_dir)
