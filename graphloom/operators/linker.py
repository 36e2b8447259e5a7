"""A linker of mentions to a table of aliases: an automaton finds aliases in texts, 3-gram TF-IDF finds the nearest alias of a mention."""

from __future__ import annotations

import math
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stage

#: bytes of aliases of one automaton; more are dealt to several, each of which reads the texts
SHARD_BYTES = 64 << 20
MIN_SCORE = 0.5


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def alias_hits(docs: DataFrame, aliases: DataFrame, whole_words: bool = False) -> DataFrame:
    """doc_id, start, end (characters, end exclusive), alias, cui: every place of docs(doc_id, text) where an alias stands, letters' case aside.

    aliases(alias, cui): null and empty ones are none; equal ones, case aside, count once, with the smallest cui. With whole_words, no letter or
    digit may touch a hit. Overlapping hits are all there. Aliases are measured first: each SHARD_BYTES make an automaton.
    """
    low = aliases.where("alias <> ''").select(F.lower("alias").alias("alias"), F.col("cui").cast("string").alias("cui"))
    names = stage(low.groupBy("alias").agg(F.min("cui").alias("cui")))
    size = names.agg(F.sum(F.octet_length("alias") + F.coalesce(F.octet_length("cui"), F.lit(0)))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start int, end int, alias string, cui string"

    def finder(known: list[tuple[str, str | None]]):
        def run(batches):
            auto = ahocorasick.Automaton()
            for name, cui in known:
                auto.add_word(folded(name), (name, cui))
            if known:
                auto.make_automaton()
            for b in batches:
                doc, out = b.column("doc_id"), ([], [], [], [], [])
                for i, text in enumerate(b.column("text").to_pylist() if known else ()):
                    text = folded(text)
                    for last, (name, cui) in auto.iter(text):
                        start, end = last + 1 - len(name), last + 1
                        if whole_words and (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()):
                            continue
                        for c, x in zip(out, (i, start, end, name, cui), strict=True):
                            c.append(x)
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(out[0], pa.int64())), *[pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True)]], names=["doc_id", "start", "end", "alias", "cui"])

        return run

    parts = []
    for s in range(shards):  # one bounded shard at a time
        part = names.where(F.pmod(F.xxhash64("alias"), F.lit(shards)) == s) if shards > 1 else names
        parts.append(rows.mapInArrow(finder([(r.alias, r.cui) for r in part.collect()]), schema))
    return reduce(DataFrame.unionByName, parts)


def _grams(term: Column) -> Column:
    """Overlapping runs of three characters of the term between two spaces."""
    return F.regexp_extract_all(F.concat(F.lit(" "), term, F.lit(" ")), F.lit("(?s)(?=(...))"), F.lit(1))


def _weighted(terms: DataFrame, idf: DataFrame, top: float) -> DataFrame:
    """term, g, w: 3-grams of each term with TF-IDF weights of length 1; grams that no alias has weigh as much as the rarest could."""
    tf = terms.select("term", F.explode(_grams(F.col("term"))).alias("g")).groupBy("term", "g").agg(F.count("*").alias("tf"))
    w = tf.join(idf, "g", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(top)))
    norm = w.groupBy("term").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "term").select("term", "g", (F.col("w") / F.col("norm")).alias("w"))


def link_mentions(mentions: DataFrame, aliases: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """mention, alias, cui, score: for each distinct mention the alias of highest cosine of 3-gram TF-IDF vectors, if min_score or more.

    Ties (to nine digits) go to the first alias; mentions below min_score are absent. Letters' case aside. An alias is listed under its
    rarest grams only, as many as leave a rest shorter than min_score: a pair that shares none of them cannot reach it,
    so frequent grams make no candidates and no pair is lost.
    """
    known = stage(aliases.where("alias <> ''").select(F.lower("alias").alias("term"), F.col("cui").cast("string").alias("cui")).groupBy("term").agg(F.min("cui").alias("cui")))
    asked = mentions.where("mention <> ''").select(F.lower("mention").alias("term")).distinct()
    n = known.count()
    df = known.select(F.explode(F.array_distinct(_grams(F.col("term")))).alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    idf = stage(df.select("g", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")))
    top = float(math.log(1.0 + n) + 1)
    told = lambda rows: rows.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("w", "g")), asc=False).alias("v"))
    a, m = stage(told(_weighted(known, idf, top))), stage(told(_weighted(asked, idf, top)))
    rest = F.aggregate("v", F.struct(F.lit(1.0).alias("left"), F.lit(0).alias("take")), lambda s, x: F.struct((s["left"] - x["w"] * x["w"]).alias("left"), (s["take"] + F.when(s["left"] >= min_score**2 - 1e-9, 1).otherwise(0)).alias("take")))
    listed = a.select(F.col("term").alias("alias"), F.explode(F.slice("v", F.lit(1), rest["take"])).alias("x")).select("alias", "x.g")
    pairs = m.select("term", F.explode("v").alias("x")).select("term", "x.g").join(listed, "g").select("term", "alias").distinct()
    both = pairs.join(m, "term").join(a.select(F.col("term").alias("alias"), F.map_from_entries(F.transform("v", lambda x: F.struct(x["g"], x["w"]))).alias("av")), "alias")
    score = F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at("av", x["g"]), F.lit(0.0)))
    hits = both.select("term", "alias", F.round(score, 9).alias("score")).where(F.col("score") >= min_score)
    best = hits.groupBy("term").agg(F.min_by(F.struct("alias", "score"), F.struct(-F.col("score"), "alias")).alias("x")).select("term", "x.*")
    return best.join(known.select(F.col("term").alias("alias"), "cui"), "alias").select(F.col("term").alias("mention"), "alias", "cui", "score")
