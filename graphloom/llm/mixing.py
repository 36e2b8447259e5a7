"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

WEIGHTS, SHARE, CEILING = (3, 1, 2), 1.5, 2.0
SEED, SHARDS, BLOCKS = 20240, 8, 128
#: Sources of one row of the splitting tree.
GROUP = 512


def sizes(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size of every row, and the columns to carry. size: words between ASCII white space; null text: 0."""
    text = F.trim(F.regexp_replace(text_or_empty(), "[\\x20\\x09-\\x0D]+", " "))
    size = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        size.cast("long").alias("size"), *carry,
    )


def targets(per_source: DataFrame, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh 3, 1, 2 and again.

    Targets share `share` times all sizes by weight; none is above `ceiling` times its source's size: sources whose
    size over weight is lowest reach it first, so after sorting by that ratio one running sum tells which do, however
    many sources there are. If all do, the excess stays unspent.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # a row a source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    s = per_source.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(ceiling))
    by = Window.orderBy((F.col("_cap") / F.col("_w")), "source")
    below, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(1))
    s = s.withColumn("_total", F.sum("source_size").over(all_rows) * F.lit(share))
    s = s.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_left") / F.sum("_w").over(upto))
    s = s.withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
    # the water level: of the first source that does not reach its cap
    s = s.withColumn("_water", F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("_w")).alias("k"), F.col("_level").alias("v")))).over(all_rows)["v"])
    target = F.least("_cap", F.coalesce(F.col("_w") * F.col("_water"), F.col("_cap")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _draw(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """A hypergeometric draw: of `drawn` out of `total`, how many are among the `marked`. By inverse of the CDF.

    Probabilities are built by their ratios from the lowest outcome; all outcomes within 12 deviations of the mean are
    covered, so the work follows the square root of the counts.
    """
    mean = drawn * marked / F.greatest(total, F.lit(1))
    dev = F.ceil(12 * F.sqrt(mean + 1)) + 2
    bounds = F.struct(
        F.greatest(F.lit(0), drawn + marked - total, F.floor(mean) - dev).cast("int").alias("lo"),
        F.least(drawn, marked, F.ceil(mean) + dev).cast("int").alias("hi"),
        u.alias("u"),
    )

    def logs(b: Column) -> Column:
        ratio = lambda k: F.log(
            (marked - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (total - marked - drawn + k + 1))
        )
        steps = F.when(b["hi"] > b["lo"], F.sequence(b["lo"], b["hi"] - 1)).otherwise(F.array().cast("array<int>"))
        grow = lambda a, k: let(a["l"] + ratio(k), lambda v: F.struct(F.concat(a["p"], F.array(v)).alias("p"), v.alias("l")))
        return F.aggregate(steps, F.struct(F.array(F.lit(0.0)).alias("p"), F.lit(0.0).alias("l")), grow)["p"]

    def pick(b: Column, p: Column, bar: Column) -> Column:
        step = lambda a, x: let(a["c"] + x, lambda c: F.struct(c.alias("c"), (a["n"] + F.when(c < bar, 1).otherwise(0)).alias("n")))
        return F.least(b["lo"] + F.aggregate(p, F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("n")), step)["n"], b["hi"])

    return let(
        bounds,
        lambda b: let(
            logs(b),
            lambda ls: let(
                F.array_max(ls),
                lambda top: let(
                    F.transform(ls, lambda x: F.exp(x - top)),
                    lambda p: let(b["u"] * F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda bar: pick(b, p, bar)),
                ),
            ),
        ),
    )


def _drawn(items: Column, want: Column, *key: Column) -> Column:
    """How many of `want` draws without replacement fall on each of items(id, n), item after item."""
    total = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    u = lambda x: (F.pmod(F.xxhash64(*key, x["id"]), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return F.aggregate(
        items,
        F.struct(total.alias("rest"), want.cast("long").alias("want"), F.array().cast("array<long>").alias("out")),
        lambda a, x: let(
            _draw(a["rest"], x["n"], a["want"], u(x)).cast("long"),
            lambda d: F.struct((a["rest"] - x["n"]).alias("rest"), (a["want"] - d).alias("want"), F.concat(a["out"], F.array(d)).alias("out")),
        ),
    )["out"]


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, shard, n_blocks, first_block): how the exact block quotas(source, quota) fall on the shards.

    Each level halves every node: the left child's blocks are drawn without replacement from the node's, so a node's
    children always add up to it. A node's sources lie in groups of about GROUP, one row each: the draw first falls on
    the groups, then, group by group in parallel, on their sources; each draw is hypergeometric given those before
    (probabilities beyond 12 deviations and steps of 2**-30 aside). Draws are keyed by seed, node and source. Shard
    ranges of a source's permuted blocks are disjoint, in shard order.
    """
    item = F.struct(F.col("source").alias("id"), F.col("quota").cast("long").alias("n"))
    groups = -(-quotas.count() // GROUP) or 1
    rows = quotas.groupBy(F.pmod(F.xxhash64("source"), F.lit(groups)).alias("part")).agg(F.sort_array(F.collect_list(item)).alias("q"))
    rows = stage(rows.select(F.lit(1).cast("long").alias("node"), F.lit(shards).alias("leaves"), "part", "q"), "tree")
    half = F.floor(F.col("leaves") / 2).cast("int")
    for _ in range((shards - 1).bit_length()):
        size = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        top = rows.groupBy("node", "leaves").agg(F.sort_array(F.collect_list(F.struct(F.col("part").alias("id"), size.alias("n")))).alias("c"))
        want = F.floor(F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"]) * half / F.col("leaves"))
        top = top.select("node", F.explode(F.arrays_zip("c", _drawn(F.col("c"), want, F.lit(seed), F.col("node"), F.lit("group")).alias("d"))).alias("x"))
        top = top.select("node", F.col("x.c.id").alias("part"), F.col("x.d").alias("want"))
        split = rows.join(top, ["node", "part"]).withColumn("l", _drawn(F.col("q"), F.col("want"), F.lit(seed), F.col("node")))
        left = F.transform("q", lambda x, i: F.struct(x["id"].alias("id"), F.get(F.col("l"), i).alias("n")))
        right = F.transform("q", lambda x, i: F.struct(x["id"].alias("id"), (x["n"] - F.get(F.col("l"), i)).alias("n")))
        kids = F.when(
            F.col("leaves") > 1,
            F.array(
                F.struct((F.col("node") * 2).alias("node"), half.alias("leaves"), left.alias("q")),
                F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("leaves") - half).alias("leaves"), right.alias("q")),
            ),
        ).otherwise(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("leaves"), F.col("q"))))
        rows = stage(split.select("part", F.explode(kids).alias("k")).select("k.node", "k.leaves", "part", "k.q"), "tree")
    flat = rows.select("node", F.explode("q").alias("x")).select("node", F.col("x.id").alias("source"), F.col("x.n").alias("n_blocks"))
    key = Window.partitionBy("source").orderBy("node")  # a row a shard
    return flat.select(
        "source", (F.row_number().over(key) - 1).alias("shard"), "n_blocks",
        (F.sum("n_blocks").over(key) - F.col("n_blocks")).cast("long").alias("first_block"),
    )


def mix(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, copies, shards (one a copy), position of every document of the mix.

    Columns named in `carry`, which tell rows apart, come along at the end.

    A keyed hash permutes each source's documents and deals them to blocks of consecutive hash values. The source's
    quota of blocks, counting epochs, is exact: whole epochs, then whole blocks while they fit the target; the block in
    which the target falls is resolved by document, and the document that fits the rest best closes it. The splitting
    tree deals the drawn blocks to shards; in a shard, `position` shuffles locally. Whole documents are taken, each
    at most twice.

    Null sources form a source of their own (last); empty texts have size 0 and go with their block; repeated rows are
    separate documents; other columns are ignored; an empty table gives no row. Sizes by (source, block) are all that
    is summed across workers; running sums go over those sums, then over the rows of one block a source.
    """
    rows = stage(sizes(docs, carry), "sizes")
    salt = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    rows = rows.withColumn("_u", salt)
    count = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    goal = targets(stage(count, "sources")).withColumnRenamed("source", "_source")
    return _placed(rows, count, goal, shards, blocks, seed, carry)


def _placed(rows: DataFrame, count: DataFrame, goal: DataFrame, shards: int, blocks: int, seed: int, carry: tuple[str, ...]) -> DataFrame:
    n = F.greatest(F.lit(blocks), F.ceil(F.col("_n") / 4096)).cast("long")
    known = stage(
        count.join(goal.select("_source", "target"), F.col("source").eqNullSafe(F.col("_source")), "left")
        .drop("_source").withColumn("_blocks", n)
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0))
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")),
        "goals",
    )
    meta = known.withColumnRenamed("source", "_source")
    rows = rows.join(meta, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_block", F.floor((F.col("_u") / F.lit(2.0**64) + 0.5) * F.col("_blocks")))
    rows = rows.withColumn("_block", F.least("_block", F.col("_blocks") - 1).cast("long"))
    per = rows.groupBy("source", "_block").agg(F.sum("size").alias("b_size"), F.first("_rest").alias("_rest"), F.first("_epochs").alias("_epochs"))
    run = Window.partitionBy("source").orderBy("_block")  # a row a block
    per = per.withColumn("b_before", F.sum("b_size").over(run) - F.col("b_size"))
    per = per.withColumn("b_no", (F.row_number().over(run) - 1).cast("long"))
    per = stage(
        per.withColumn(
            "b_state",
            F.when((F.col("_rest") > 0) & (F.col("b_before") + F.col("b_size") <= F.col("_rest")), 2).when(F.col("b_before") < F.col("_rest"), 1).otherwise(0),
        ),
        "blocks",
    )
    quota = per.groupBy("source").agg(F.sum(F.col("_epochs") + F.when(F.col("b_state") > 0, 1).otherwise(0)).alias("quota"), F.count("*").alias("b_all"))
    tree = stage(splitting_tree(quota, shards, seed), "shards")
    right = per.select(F.col("source").alias("_source"), F.col("_block").alias("_b"), "b_before", "b_no", "b_state")
    rows = rows.join(right, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_b"))).drop("_source", "_b")

    # the one block of each source in which its target falls, by document
    edge = rows.where("b_state = 1")
    order = Window.partitionBy("source").orderBy("_u", "doc_id", "size", *carry)
    edge = edge.withColumn("_upto", F.col("b_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("_in", F.col("_upto") <= F.col("_rest"))
    got = Window.partitionBy("source")
    edge = edge.withColumn("_short", F.col("_rest") - F.coalesce(F.max(F.when(F.col("_in"), F.col("_upto"))).over(got), F.col("b_before")))
    gap = F.abs(F.col("_short") - F.col("size"))
    edge = edge.withColumn("_best", F.min(F.when(~F.col("_in") & (gap < F.abs(F.col("_short"))), F.struct(gap.alias("g"), F.col("_u").alias("u"), F.col("doc_id").alias("d"))).otherwise(None)).over(got))
    closes = ~F.col("_in") & (F.col("_best.u") == F.col("_u")) & F.col("_best.d").eqNullSafe(F.col("doc_id"))
    twin = F.row_number().over(Window.partitionBy("source", closes).orderBy("_u", "doc_id", "size", *carry))
    edge = edge.withColumn("_more", F.when(F.col("_in") | (closes & (twin == 1)), 1).otherwise(0))
    edge = edge.drop("_upto", "_in", "_short", "_best")
    rows = rows.where("b_state <> 1").withColumn("_more", F.when(F.col("b_state") == 2, 1).otherwise(0)).unionByName(edge)
    rows = rows.withColumn("copies", (F.col("_epochs") + F.col("_more")).cast("int"))

    # a drawn block's number over all epochs tells its shard
    shard = tree.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("first_block", "shard", "n_blocks"))).alias("_s"))
    shard = shard.join(quota.select(F.col("source").alias("_source"), "b_all"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    shard = shard.withColumnRenamed("source", "_source")
    rows = rows.join(shard, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    drawn = lambda e: e * F.col("b_all") + F.col("b_no")  # noqa: E731  a block's number over the epochs
    of = lambda e: F.filter("_s", lambda x: (x["first_block"] <= drawn(e)) & (drawn(e) < x["first_block"] + x["n_blocks"]))[0]["shard"]
    each = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), of)).otherwise(F.array().cast("array<int>"))
    return rows.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
        each.cast("array<int>").alias("shards"),
        F.when(F.col("copies") > 0, F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("_u"))).alias("position"), *carry,
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and where its copies go."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards", "position")
