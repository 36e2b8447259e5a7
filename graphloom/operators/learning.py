"""Relations learned from facts: phrases, cues, centroids, label maps, and the decision between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import relation as R
from ..functions import text as T
from ..functions import vector as V

#: Least cosine at which a phrase's nearest relation wins over the label map.
SEMANTIC_AT = 0.75
CLUSTERS, ROUNDS, MOST_CLUSTERS = 8, 5, 14


#: Centres that go to every task at once.
BLOCK = 4_096


def nearest(vectors: DataFrame, centres: DataFrame, group: str, key: str = "vec_id") -> DataFrame:
    """key, nearest, distance: every vector's closest centre, ties to the smaller group.

    centres: a row a group. They meet the vectors in blocks of BLOCK, the bound of what is broadcast; a vector keeps
    the least distance of each block by a partial aggregate. Rows that share a key are one vector.
    """
    e = F.transform("embedding", lambda x: x.cast("double"))
    all_ = centres.select(F.col(group).alias("_g"), F.col("centroid").alias("_c"))
    blocks = -(-all_.count() // BLOCK)
    if blocks > 1:
        all_ = all_.withColumn("_b", F.pmod(F.xxhash64("_g"), F.lit(blocks)))
    rows, found = vectors.select(key, e.alias("_e")), None
    for i in range(max(1, blocks)):
        few = all_.where(F.col("_b") == i) if blocks > 1 else all_
        pairs = rows.join(F.broadcast(few.select("_g", "_c"))).select(key, F.struct(F.sqrt(V.distance_squared(F.col("_e"), F.col("_c"))).alias("d"), F.col("_g").alias("g")).alias("x"))
        found = pairs if found is None else found.unionByName(pairs)
    best = found.groupBy(key).agg(F.min("x").alias("b"))
    return best.select(key, F.col("b.g").alias("nearest"), F.col("b.d").alias("distance"))


def majority_relation(pairs: DataFrame) -> DataFrame:
    """label, relation, n: the most frequent relation of pairs(label, relation, seq), the one seen first on a tie."""
    n = pairs.groupBy("label", "relation").agg(F.count("*").alias("n"), F.min("seq").alias("at"))
    return n.groupBy("label").agg(F.max_by("relation", F.struct("n", -F.col("at"))).alias("relation"), F.max("n").alias("n"))


def centroid_of(vectors: DataFrame, group: str) -> DataFrame:
    """group, n, centroid (mean vector), summed by position so that a hot group meets no single task."""
    parts = vectors.select(F.col(group).alias("_g"), F.posexplode("embedding").alias("pos", "x"))
    mean = parts.groupBy("_g", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    out = mean.groupBy("_g").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))
    return out.withColumnRenamed("_g", group)


def supervised(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of facts(id, fact, embedding): (id, relation) and (cluster_id, relation, n, centroid).

    Facts whose cue names a relation give a centroid a relation; the others go to the nearest; then all centroids are
    taken anew and numbered by name. Without any cue all facts stay with the weak relation.
    """
    told = facts.withColumn("cue_relation", R.cue_relation(R.cue(F.col("fact"))))
    anchored = told.where(F.col("cue_relation") != R.WEAK)
    loose = nearest(told.where(F.col("cue_relation") == R.WEAK), centroid_of(anchored, "cue_relation"), "cue_relation", "id")
    told = told.join(loose.select("id", "nearest"), "id", "left")
    final = told.select("id", "embedding", F.coalesce("nearest", "cue_relation").alias("relation"))
    groups = centroid_of(final, "relation")
    order = Window.orderBy(F.col("relation") == R.WEAK, "relation")  # a row a relation
    return final.select("id", "relation"), groups.select((F.row_number().over(order) - 1).cast("long").alias("cluster_id"), "relation", "n", "centroid")


def infer(facts: DataFrame, known: DataFrame, groups: DataFrame) -> DataFrame:
    """id, relation, via of facts(id, fact, embedding): the cue, else the same training fact, else the nearest centroid.

    known: (fact, relation) of training; groups: (relation, centroid). Empty facts and facts without a vector are weak.
    """
    fact = F.trim(F.coalesce("fact", F.lit("")))
    d = facts.select("id", fact.alias("fact"), "embedding", R.cue_relation(R.cue(fact)).alias("cue"))
    told = known.select(F.trim("fact").alias("fact"), F.col("relation").alias("same")).groupBy("fact").agg(F.min("same").alias("same"))
    near = nearest(d.where((F.col("cue") == R.WEAK) & F.col("embedding").isNotNull()), groups, "relation", "id").select("id", "nearest")
    d = d.join(told, "fact", "left").join(near, "id", "left")
    cued, empty = F.col("cue") != R.WEAK, F.col("fact") == ""
    relation = F.when(empty, R.WEAK).when(cued, F.col("cue")).otherwise(F.coalesce("same", "nearest", F.lit(R.WEAK)))
    via = F.when(empty, "empty").when(cued, "cue").when(F.col("same").isNotNull(), "fact").when(F.col("nearest").isNotNull(), "centroid").otherwise("none")
    return d.select("id", relation.alias("relation"), via.alias("via"))


def resolve(rows: DataFrame, relations: DataFrame, label_map: DataFrame, least: float = SEMANTIC_AT) -> DataFrame:
    """rows(id, label, embedding of the phrase) with `resolved`: the relation of the most similar vector if its cosine is
    `least` or more, else the label map's, else unknown. relations(relation, embedding): one row a canonical relation."""
    few = F.broadcast(relations.select(F.col("relation").alias("_r"), F.col("embedding").alias("_e")))
    scored = rows.where("embedding is not null").select("id", "embedding").join(few).withColumn("_s", V.cosine(F.col("embedding"), F.col("_e")))
    best = scored.groupBy("id").agg(F.max_by("_r", F.struct("_s", "_r")).alias("_r"), F.max("_s").alias("_s"))
    named = label_map.select(F.col("key").alias("_k"), F.col("relation").alias("_m"))
    out = rows.join(best, "id", "left").join(named, T.relation_key(F.col("label")) == F.col("_k"), "left")
    resolved = F.when(F.col("_s") >= least, F.col("_r")).otherwise(F.coalesce("_m", F.lit("unknown")))
    return out.withColumn("resolved", resolved).withColumn("mapped", F.col("_m")).drop("_r", "_s", "_k", "_m")


def normalize(label: Column, gold: Column, resolved: Column, mapped: Column, has_fact: Column) -> Column:
    """The relation of an extractor's label. A known gold relation of the fact overrides whatever else is found."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), "[ -]", "_")
    literal = F.when(plain.isin(*[r for r in R.CANONICAL if r != "unknown"]), plain)
    known = F.when(gold.isin(*R.SEMANTIC), gold)
    context = F.when(has_fact & (resolved != "unknown"), resolved)
    return F.coalesce(F.when(F.coalesce(literal, context, mapped, known).isNotNull(), F.coalesce(known, literal, context, mapped)), F.lit("unknown"))


def train_pairs(triples: DataFrame, golds: DataFrame) -> DataFrame:
    """label, gold, seq: a row for each extractor triple(set_id, r, seq) with its set's gold relation(set_id, gold)."""
    return triples.join(golds.select("set_id", "gold"), "set_id").select(T.relation_key(F.col("r")).alias("label"), "gold", "seq")


def impure(members: DataFrame) -> DataFrame:
    """cluster, n, relations, second, split of members(cluster, relation): split where two relations are both well held.

    That is from 4 members and 2 relations on, if the second most frequent has at least 2 and a fifth of them.
    """
    n = members.groupBy("cluster", "relation").agg(F.count("*").alias("k"))
    order = Window.partitionBy("cluster").orderBy(F.desc("k"), "relation")
    top = n.withColumn("at", F.row_number().over(order)).groupBy("cluster").agg(
        F.sum("k").alias("n"), F.count("*").alias("relations"), F.coalesce(F.max(F.when(F.col("at") == 2, F.col("k"))), F.lit(0)).alias("second")
    )
    least = F.greatest(F.lit(2), F.floor(F.col("n") * 0.2))
    return top.withColumn("split", (F.col("n") >= 4) & (F.col("relations") >= 2) & (F.col("second") >= least))


def renumber(members: DataFrame) -> DataFrame:
    """members with cluster_id: clusters numbered from 0 without gaps, in their order."""
    ids = members.select("cluster").distinct().withColumn("cluster_id", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("long"))  # a row a cluster
    return members.join(ids, "cluster")


def kmeans(vectors: DataFrame, k: int = CLUSTERS, seed: int = 42) -> DataFrame:
    """id, cluster of vectors(id, embedding): k means, or as many as there are rows; for facts without any cue."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.where("embedding is not null").limit(k).count()
    rows = vectors.where("embedding is not null").select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    if n < 2:
        return rows.select("id", F.lit(0).cast("long").alias("cluster"))
    model = KMeans(k=n, seed=seed, maxIter=50).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").cast("long").alias("cluster"))


def _halved(rows: DataFrame, todo: list[int], steps: int) -> DataFrame:
    """id, half (0 or 1) of the members of the clusters `todo`, each split by two means; all clusters in each step.

    The first means are the member of smallest id and the one farthest from it (ties: smallest id). What comes to the
    driver is two means a cluster, and there are at most `most` clusters: members are told their nearest mean and
    summed where they are read, and the sums are added up by key.
    """
    mine = rows.where(F.col("cluster").isin(todo)).select("id", "cluster", F.col("embedding").cast("array<double>").alias("v"))
    first = mine.groupBy("cluster").agg(F.min_by("v", "id").alias("a"))
    gap = F.aggregate(F.zip_with("v", "a", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda p, x: p + x)
    far = mine.join(first, "cluster").groupBy("cluster").agg(F.any_value("a").alias("a"), F.max_by("v", F.struct(gap, -F.col("id"))).alias("b"))
    means = {r.cluster: np.array([r.a, r.b]) for r in far.collect()}

    def halves(b, means):
        x = np.stack(b.column("v").to_numpy(zero_copy_only=False)) if b.num_rows else np.empty((0, 1))
        c = b.column("cluster").to_numpy()
        m = np.stack([means[k] for k in c.tolist()]) if len(c) else np.empty((0, 2, 1))
        return c, x, ((x[:, None] - m) ** 2).sum(axis=2).argmin(axis=1)

    def summed(means):
        def run(batches):
            for b in batches:
                c, x, half = halves(b, means)
                keys, at = np.unique(np.stack([c, half]), axis=1, return_inverse=True)
                total, n = np.zeros((keys.shape[1], x.shape[1])), np.bincount(at.ravel(), minlength=keys.shape[1])
                np.add.at(total, at.ravel(), x)
                k, d = total.shape
                cols = [np.repeat(keys[0], d), np.repeat(keys[1], d), np.tile(np.arange(d), k), total.ravel(), np.repeat(n, d)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["cluster", "half", "pos", "total", "n"])

        return run

    def told(means):
        def run(batches):
            for b in batches:
                half = halves(b, means)[2]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(half.astype(np.int64), pa.int64())], names=["id", "half"])

        return run

    for _ in range(steps):
        sums = mine.mapInArrow(summed(means), "cluster long, half long, pos long, total double, n long").groupBy("cluster", "half", "pos").agg((F.sum("total") / F.sum("n")).alias("mean"))
        new = {k: m.copy() for k, m in means.items()}
        for r in sums.collect():
            new[r.cluster][r.half, r.pos] = r["mean"]
        moved = max((np.abs(new[k] - means[k]).max() for k in means), default=0.0)
        means = new
        if moved < 1e-9:
            break
    return mine.mapInArrow(told(means), f"id {dict(mine.dtypes)['id']}, half long")


def refine(members: DataFrame, rounds: int = ROUNDS, most: int = MOST_CLUSTERS, steps: int = 20) -> DataFrame:
    """members(id, cluster, relation, embedding) with impure clusters halved by 2-means, round by round, all at once.

    Ends when nothing is impure or there are `most` clusters; of a round's clusters, in order, the second half gets the
    next free number. Null vectors stay in the first half. A step is one job for all clusters.
    """
    from ..sources.shared import stage

    cur = stage(members.select("id", F.col("cluster").cast("long").alias("cluster"), "relation", "embedding"))
    for _ in range(rounds):
        state = cur.agg(F.count_distinct("cluster"), F.max("cluster")).first()  # two numbers
        todo = [r["cluster"] for r in impure(cur).where("split").select("cluster").orderBy("cluster").collect()]  # at most `most` clusters
        if not todo or state[0] >= most:
            break
        half = _halved(cur.where("embedding is not null"), todo, steps)
        number = F.create_map(*[F.lit(x) for i, c in enumerate(todo) for x in (c, state[1] + 1 + i)])
        moved = F.when(F.col("half") == 1, F.element_at(number, F.col("cluster"))).otherwise(F.col("cluster"))
        cur = stage(cur.join(half, "id", "left").withColumn("cluster", moved).drop("half"))
    return cur


def trace(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """set_id, label, n, cluster, relation: extractor labels beside their set's cluster; sets without one stay."""
    n = labels.groupBy("set_id", "label").agg(F.count("*").alias("n"))
    return n.join(clusters.select("set_id", "cluster", "relation"), "set_id", "left")
