"""Secret scan with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, text_or_empty
from .spans import find_spans

# The base kinds' patterns.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
#: Candidates that the method adds: long runs of the letters keys are made of; those count that mix kinds of characters
#: and repeat few of them, as drawn at random. Where ownership says that they are live, they are reported.
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,200}+(?![A-Za-z0-9+/_-])"
MIXED, VARIED = 3, 12
KINDS = ("assign", "access", "hex", "keylike")
#: A value spreads by its owners and, at half weight, by their further repositories. From this spread, and this share of
#: all owners, it is a widely copied example.
SPREAD, SHARE = 3.0, 0.01


def keylike(value: Column) -> Column:
    """Whether a run has at least MIXED of digits, lower, upper case and signs, and VARIED different characters."""
    kinds = [value.rlike(p).cast("int") for p in ("[0-9]", "[a-z]", "[A-Z]", "[+/_-]")]
    return (sum(kinds[1:], kinds[0]) >= MIXED) & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= VARIED)


def candidates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, owner, repo and cands, an array of (s, e, k, kind, h); no text is carried on."""
    text = F.col("_text")
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("owner"),
        F.xxhash64("source", "lang").alias("repo"), text_or_empty().alias("_text"),
    )

    def kind(spans, k, keep=None, value="g0"):
        spans = F.filter(spans, keep) if keep else spans
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.sha2(x[value], 256).alias("h")))

    d = d.select(
        "doc_id", "owner", "repo",
        F.array_sort(F.concat(
            kind(find_spans(text, ASSIGN, (0, 2)), 0, lambda x: F.length(x["g1"]) >= 6, "g1"),
            kind(find_spans(text, ACCESS), 1, lambda x: x["e"] - x["s"] >= 20),
            kind(find_spans(text, HEX), 2),
            kind(find_spans(text, RUN), 3, lambda x: keylike(x["g0"])),
        )).alias("cands"),
    )
    return d


def scan(docs: DataFrame, spread: float = SPREAD, share: float = SHARE) -> DataFrame:
    """doc_id and `spans`: an array of (s, k, e, h, n_owners, n_repos, n_docs, live) in order of start, kind.

    Candidate values are hashed; hashes are counted over the whole corpus by distinct owners (source) and repositories
    (source and language). A value's spread is its owners and half its further repositories; below `spread`, or below
    `share` of all the corpus's owners, it is live-looking, else a copied example. Base kinds (assign, access, hex) are
    always reported; other key-like runs only where live.

    Null text is empty; a null source or language counts as one unnamed owner or repository; null doc_ids and repeated
    rows are kept as rows of their own; other columns are ignored; an empty table gives no row. Distinct owners are
    found by two partial aggregations, so that a value in a third of all rows stays small before it is shuffled.
    """
    rows = stage(candidates(docs).withColumn("_row", F.monotonically_increasing_id()), "candidates")
    flat = rows.where(F.size("cands") > 0).select("_row", "owner", "repo", F.explode("cands").alias("c")).select("_row", "owner", "repo", "c.*")
    per = flat.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    per = per.groupBy("h", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    freq = per.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n_found"))
    owners = rows.select(F.coalesce("owner", F.lit("\0")).alias("o")).distinct().agg((F.count("*") * share).alias("_bar"))  # a row
    freq = freq.crossJoin(F.broadcast(owners)).withColumn("live", F.col("n_owners") + (F.col("n_repos") - F.col("n_owners")) / 2 < F.greatest(F.lit(spread), "_bar"))
    told = flat.join(freq.drop("_bar"), "h")
    told = told.where((F.col("k") < 3) | F.col("live"))
    spans = told.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e", "h", "n_owners", "n_repos", "n_found", "live"))).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("_row", "doc_id").join(spans, "_row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the base spans' sha256, all spans as text, and how many are live or copied widely."""
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"], x["e"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda x: x["k"] < 3)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all whole documents, counted and digested."""
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
