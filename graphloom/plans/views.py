"""Triples and other inputs of the operators, as views over star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: str, to: dict[str, str], other: str | None = None):
    return F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in to.items()], F.lit(other))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set for each user, a note for each day."""
    relation = {"error": "causes", "click": "increases", "purchase": "treats", "signup": "prevents"}
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("set_id"), F.date_format("ts", "yyyy-MM-dd").alias("note"), F.concat(F.lit("u"), "user_id").alias("s"),
        _mapped("event_type", relation, "related_to").alias("r"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("o"),
        F.col("event_id").alias("seq"),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set for each part; evidence in order of order, line, supplier and date."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("set_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("l_orderkey").alias("source"),
        F.concat(F.lit("p"), "l_partkey").alias("s"), _mapped("l_returnflag", {"A": "causes", "N": "treats", "R": "prevents"}).alias("r"),
        F.concat(F.lit("s"), "l_suppkey").alias("o"), F.concat(F.lit("s"), "l_suppkey").alias("k"),
        F.when(F.col("l_linestatus") == "O", "positive").otherwise("negative").alias("polarity"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
    )


def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("set_id", "seq", F.col("note").alias("source"), "s", "r", "o", F.col("o").alias("k"), F.lit("positive").alias("polarity"), F.lit(1.0).alias("confidence"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train pairs: a document's source as label, its language as gold relation."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("label"), F.col("lang").alias("gold"), F.col("doc_id").alias("seq"))


# Sentences, relations and lines that are made of each part's name {a} and brand {b}, by its key.
FACTS = (
    "{a} is metabolized by the {b}.", "{a} is a diuretic.", "{a} treat {b}.", "{a} can cause {b} bleeding.", "{a} increases the risk of {b}.", "{a} is used to treat type 2 {b}.",
    "{a} suppresses the immune system.", "{a} interacts with {b}.", "{a} lower {b}.", "{a} regulates blood {b}.", "{a} relieves the {b}.", "{a} prevent an {b}.",
    "Nothing here but {a}", "{a} is treated with {b}", "{a} raises {b} pressure.", "",
)
RELATIONS = (
    ("{a}", "caused_by", "{b}"), ("{b}", "causes", "{a}"), ("{a}", "causes", "caused by {b}"), ("caused by {a}", "treats", "due to {b}"), ("{a}", "metabolizes", "{b}"),
    ("{a}", "root_cause_of", "{b}"), ("{a}", "Treated By", "treated with {b}"), ("caused by due to {a}", "related to", "{b}"),
)
LINES = (
    "{a} | b | {b}", "{a} | | {b}", "{a} | {b}", "none", "", "{a}|y|{b}|w", 'Answer: "{a}"', "Unknown {a}.", "result: '{b}'", "NR", "LABEL_1", "LABEL_7", "CID", "Used To {a}", "not related {b}",
)


def _formed(forms: tuple[str, ...]):
    """The form of each part's key, its name and brand in place."""
    form = F.get(F.array(*[F.lit(x) for x in forms]), (F.col("p_partkey") % len(forms)).cast("int"))
    return F.replace(F.replace(form, F.lit("{a}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, fact: a sentence a part, from which facts, relations and answers are parsed."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _formed(FACTS).alias("fact"))


def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, s, r, o: a triple a part, some of them passive."""
    ends = [_formed(tuple(x[i] for x in RELATIONS)).alias(c) for i, c in enumerate("sro")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *ends)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, line: what a model may answer, a line a part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _formed(LINES).alias("line"))
