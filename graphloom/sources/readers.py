"""Readers: annotated corpora, triples of extractors, questions, maps. All are lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .corpus import pubtator  # noqa: F401  the reader of annotated abstracts

TRIPLES = "array<array<array<string>>>"
EXTRACTOR_LOG = "sets array<struct<fact string, paraphrases array<string>, baseline_1 struct<triples_per_paraphrase {0}>, baseline_2 struct<triples_per_paraphrase {0}>, baseline_3 struct<triples_per_paraphrase {0}>>>".format(TRIPLES)


def extractor_log(spark: SparkSession, path: str, baseline: str) -> DataFrame:
    """set_id, fact, note, seq, s, r, o of one extractor; triples of the wrong shape are dropped."""
    d = spark.read.schema(EXTRACTOR_LOG).option("multiLine", True).json(path)
    d = d.select(F.posexplode("sets").alias("set_id", "x")).select("set_id", F.col("x.fact").alias("fact"), F.col(f"x.{baseline}.triples_per_paraphrase").alias("t"))
    d = d.select("set_id", "fact", F.posexplode("t").alias("note", "t")).select("set_id", "fact", "note", F.posexplode("t").alias("at", "t")).where(F.size("t") >= 3)
    seq = (F.col("note").cast("long") * 1_000_000 + F.col("at")).alias("seq")
    return d.select("set_id", "fact", "note", seq, F.col("t")[0].alias("s"), F.col("t")[1].alias("r"), F.col("t")[2].alias("o"))


def paraphrase_sets(spark: SparkSession, path: str) -> DataFrame:
    """set_id, fact, paraphrases; a file of one set, or of plain texts, is accepted."""
    schema = "paraphrase_sets array<struct<fact string, paraphrases array<string>>>, fact string, paraphrases array<string>, texts array<string>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    one = F.array(F.struct("fact", F.coalesce("paraphrases", "texts").alias("paraphrases")))
    d = d.select(F.posexplode(F.coalesce("paraphrase_sets", one)).alias("set_id", "x")).select("set_id", "x.fact", "x.paraphrases")
    return d.where(F.size("paraphrases") > 0)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """q_id, question, s, relations (with aliases, repeats kept), o, answer."""
    one = "array<struct<question string, subject string, relation string, object string, answer string>>"
    d = spark.read.schema(f"examples {one}, qa {one}, relation_aliases map<string, array<string>>").option("multiLine", True).json(path)
    d = d.select(F.posexplode(F.coalesce("examples", "qa")).alias("q_id", "x"), "relation_aliases")
    alias = F.coalesce(F.try_element_at("relation_aliases", F.col("x.relation")), F.array().cast("array<string>"))
    return d.select(F.col("q_id").cast("long").alias("q_id"), "x.question", F.col("x.subject").alias("s"), F.concat(F.array("x.relation"), alias).alias("relations"), F.col("x.object").alias("o"), "x.answer")


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """key, relation of a JSON object; keys with a leading underscore and values that say nothing are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "relation"))
    return raw.where(~F.col("key").startswith("_")).select(T.relation_key(F.col("key")).alias("key"), F.lower(F.trim("relation")).alias("relation"))


def mapper_file(spark: SparkSession, path: str) -> DataFrame:
    """key, cui of entity<TAB>cui lines; # starts a comment; the later of equal keys wins."""
    d = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    p = F.split("value", "\t", 2)
    d = d.where(~F.trim("value").startswith("#") & (F.size(p) == 2))
    return d.groupBy(T.mapper_key(p[0]).alias("key")).agg(F.max_by(F.trim(p[1]), "n").alias("cui"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def split_rows(df: DataFrame, key: str, train: float = 0.8, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """df with `split` by a keyed hash, sizes int(n * ratio); shares are cut by rank over hash ranges, not in one task."""
    n = df.count()
    h = F.xxhash64(F.lit(seed), key)
    ranges = 256
    d = df.withColumn("_h", h).withColumn("_b", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * ranges))
    per = d.groupBy("_b").agg(F.count("*").alias("_n"))
    per = per.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    d = d.join(per, "_b").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    cut1, cut2 = int(n * train), int(n * train) + int(n * dev)
    return d.withColumn("split", F.when(F.col("_rank") <= cut1, "train").when(F.col("_rank") <= cut2, "dev").otherwise("test")).drop("_h", "_b", "_n", "_before", "_rank")


def corpus_mapper(docs: DataFrame) -> DataFrame:
    """key, cui of annotated docs(entities with text, identifier): the last identifier of a mention's text; "-1" is none."""
    e = docs.select(F.monotonically_increasing_id().alias("_d"), F.posexplode("entities").alias("_n", "e")).select("_d", "_n", "e.text", "e.identifier")
    e = e.where("identifier is not null and identifier not in ('', '-1')").withColumn("key", T.mapper_key(F.col("text")))
    return e.where("key <> ''").groupBy("key").agg(F.max_by("identifier", F.struct("_d", "_n")).alias("cui"))


def first_mapper(*mappers: DataFrame | None) -> DataFrame | None:
    """The first of several mappers, in order of precedence, that is there and has a row; None if there is none."""
    return next((m for m in mappers if m is not None and not m.isEmpty()), None)


def train_pairs(spark: SparkSession, path: str, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """label, gold, seq of a JSON list of pairs, or of a document whose `pairs`, `examples` or `data` hold it."""
    one = f"array<struct<`{predicted}` string, `{gold}` string>>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", one)
    inside = F.from_json("value", f"pairs {one}, examples {one}, data {one}")
    d = raw.select(F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(inside["pairs"], inside["examples"], inside["data"])).alias("x"))
    d = d.select(F.when(F.col("x").isNull(), F.raise_error(F.lit("no train pairs in the file"))).otherwise(F.col("x")).alias("x")).select(F.posexplode("x").alias("seq", "x"))
    return d.select(F.col(f"x.`{predicted}`").alias("label"), F.col(f"x.`{gold}`").alias("gold"), F.col("seq").cast("long").alias("seq"))


def graph_file(spark: SparkSession, path: str) -> DataFrame:
    """s, r, o of a JSON list of triples; shorter entries are dropped."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("t")).where(F.size("t") >= 3)
    return t.select(F.col("t")[0].alias("s"), F.col("t")[1].alias("r"), F.col("t")[2].alias("o"))


def cluster_map(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, relation, n, centroid as `sinks.write_clusters` left them."""
    return spark.read.parquet(path)


# Texts for a trial run.
TRIAL_TEXTS = ("Aspirin can cause gastric bleeding.", "Metformin is used to treat type 2 diabetes.", "Warfarin interacts with aspirin.", "Smoking increases the risk of lung cancer.", "Insulin regulates blood sugar.")


def texts_or_trial(spark: SparkSession, path: str | None = None) -> DataFrame:
    """text: a file's non-blank lines, or a few built-in ones."""
    return text_lines(spark, path) if path else spark.createDataFrame([(t,) for t in TRIAL_TEXTS], "text string")


# How a fact is said again.
FRAMES = ("%s", "It is known that %s", "Studies show that %s", "Clinicians note: %s", "In practice, %s", "Evidence suggests that %s", "Reports say %s", "As a rule, %s", "Notably, %s", "To sum up, %s")


def evaluation_set(facts: DataFrame, paraphrases: int = 10) -> DataFrame:
    """set_id, fact, paraphrases of facts(set_id, fact): the fact in so many frames. A placeholder entity ends the query with an error."""
    frames = [F.format_string(f, T.guarded(F.col("fact"))) for f in FRAMES[:paraphrases]]
    return facts.select("set_id", T.guarded(F.col("fact")).alias("fact"), F.array(*frames).alias("paraphrases"))


def checkpoint_of(names: list[str], weights: tuple[str, ...] = ("model.safetensors", "pytorch_model.bin")) -> str | None:
    """Where a model's weights lie among a folder's paths: the folder itself ("."), else its newest checkpoint-*; None if nowhere."""
    tops = {n.split("/")[0] for n in names if "/" in n and n.split("/")[-1] in weights}
    if any(n in weights for n in names):
        return "."
    numbered = [t for t in tops if t.startswith("checkpoint-") and t[11:].isdigit()]
    return max(numbered, key=lambda t: int(t[11:]), default=None)
