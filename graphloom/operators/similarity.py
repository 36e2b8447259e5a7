"""Exact joins by cosine over a metric index: balls around pivots, bands of angles, pairs of bounded blocks.

Rows have id, v (an array) and a group within which they are compared; null, zero and non-finite vectors link with nothing.
Every row lives in the ball of its nearest pivot. The angle is a metric, so a partner y of x, at most theta away, lives in a
ball p only if angle(x, p) <= angle(x, nearest) + 2 * theta and x is within theta of what the ball's members span. There, angles to
p differ by theta at most, so only neighbouring bands of width theta meet. Each pair meets once, where the smaller id lives.
Where rows would visit more balls than all pairs of blocks copy them, as at low thresholds on spread vectors, packed blocks of
all rows meet in a cross join instead, which shuffles and copies nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stage

#: pivots at most, rows of smallest hash among which they are chosen for each, rows of a block
PIVOTS, OFFERED, BLOCK = 512, 4, 1024
#: rows that are looked at at a time, visits a row from which on all blocks are crossed instead, rows of a packed block
ROWS, VISITS, PACK = 256, 8, 512
SLACK = 1e-9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def usable(vectors: DataFrame, id_: str, v: str, group: str | None) -> DataFrame:
    """id, v (doubles), g of the rows whose vector is finite and not zero."""
    x = vectors.select(F.col(id_).alias("id"), F.col(v).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(0)).alias("g"))
    squares = F.aggregate(F.transform("v", lambda e: e * e), F.lit(0.0), lambda a, e: a + e)
    return x.where(F.col("v").isNotNull()).withColumn("_n", squares).where("_n >= 1e-24 and _n < double('Infinity') and not isnan(_n)").drop("_n")


def spread_pivots(rows: DataFrame, theta: float) -> np.ndarray:
    """About sqrt(n) pivots, PIVOTS at most, chosen far from one another among the rows of smallest hash; a bounded collect."""
    n = rows.count()
    k = max(1, min(PIVOTS, int(np.sqrt(n))))
    some = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(k * OFFERED).collect()
    x = unit(np.array([r.v for r in some], np.float64)) if some else np.zeros((1, 1))
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(k, len(x)) and near.min() < np.cos(theta / 2):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _homes(pivots: np.ndarray):
    """ball and angle of each row."""

    def run(batches):
        for b in _small(batches):
            a = np.arccos(np.clip(unit(_matrix(b.column("v"))) @ pivots.T, -1, 1)) if b.num_rows else np.empty((0, 1))
            home = a.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(a[np.arange(len(a)), home])], names=[*b.schema.names, "ball", "angle"])

    return run


def _small(batches):
    """Batches in slices of ROWS rows, so that what is made for each row and pivot stays small."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _meet(b: pa.RecordBatch, pivots: np.ndarray, spans: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Angles of rows to pivots, and which balls each has to visit."""
    a = np.arccos(np.clip(unit(_matrix(b.column("v"))) @ pivots.T, -1, 1))
    return a, (a <= b.column("angle").to_numpy()[:, None] + 2 * theta + SLACK) & (a <= spans[:, 1] + theta + SLACK) & (a >= spans[:, 0] - theta - SLACK)


def _counted(pivots: np.ndarray, spans: np.ndarray, theta: float):
    """How many visits the rows make, bands included."""

    def run(batches):
        for b in _small(batches):
            a, meet = _meet(b, pivots, spans, theta)
            row, ball = np.nonzero(meet)
            band = np.floor(a[row, ball] / theta)
            low, high = np.floor(spans[ball] / theta).T
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(((band + s >= low) & (band + s <= high)).sum()) for s in (-1, 0, 1))])], names=["visits"])

    return run


def _visits(pivots: np.ndarray, spans: np.ndarray, theta: float):
    """Each row as a member of its band at home, and as a guest of the bands where a partner may live."""

    def run(batches):
        for b in _small(batches):
            home = b.column("ball").to_numpy().astype(np.int64)
            a, meet = _meet(b, pivots, spans, theta)
            row, ball = np.nonzero(meet)
            band = np.floor(a[row, ball] / theta).astype(np.int64)
            low, high = np.floor(spans[ball] / theta).astype(np.int64).T
            at = np.arange(len(home))
            row3 = np.concatenate([at, *[row[(band + s >= low) & (band + s <= high)] for s in (-1, 0, 1)]])
            ball3 = np.concatenate([home, *[ball[(band + s >= low) & (band + s <= high)] for s in (-1, 0, 1)]])
            band3 = np.concatenate([np.floor(a[at, home] / theta).astype(np.int64), *[(band + s)[(band + s >= low) & (band + s <= high)] for s in (-1, 0, 1)]])
            kept = [b.column(c).take(pa.array(row3)) for c in ("id", "v", "g")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ball3), pa.array(band3), pa.array(np.arange(len(row3)) < len(home))], names=["id", "v", "g", "ball", "band", "member"])

    return run


def _packed(batches):
    """Rows of one group that follow each other, sorted by (g, id), in blocks of PACK at most: g, low and high (ids), raw (an Arrow stream)."""
    for b in batches:
        g = b.column("g").to_pylist()
        cuts = [0, *[i for i in range(1, len(g)) if g[i] != g[i - 1]], len(g)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            for at in range(start, stop, PACK):
                part = b.slice(at, min(PACK, stop - at))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                ids = part.column("id")
                cols = [part.column("g").slice(0, 1), ids.slice(0, 1), ids.slice(len(ids) - 1, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["g", "low", "high", "raw"])


def _crossed(meet: Callable):
    def run(batches):
        for b in batches:
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (pa.ipc.open_stream(z.as_buffer()).read_all() for z in (x, y))
                yield from meet(x, y).combine_chunks().to_batches()

    return run


def crossed_blocks(rows: DataFrame, meet: Callable, schema: str) -> DataFrame:
    """meet(members, guests) over all pairs of blocks of rows(id, v, g) in one group: quadratic, but nothing is shuffled to meet.

    Blocks lie in order of (g, id), so the members' block holds the smaller ids; a block meets itself, too.
    """
    kind = dict(rows.dtypes)
    in_order = rows.where("g is not null").select("id", "v", "g").repartitionByRange("g", "id").sortWithinPartitions("g", "id")
    blocks = stage(in_order.mapInArrow(_packed, f"g {kind['g']}, low {kind['id']}, high {kind['id']}, raw binary"))
    a, b = (blocks.select(*[F.col(c).alias(f"{c}{side}") for c in ("g", "low", "high", "raw")]) for side in "ab")
    met = a.join(b.hint("shuffle_replicate_nl"), (F.col("ga") >= F.col("gb")) & (F.col("ga") <= F.col("gb")) & (F.col("lowa") <= F.col("highb")) & (F.col("lowa") <= F.col("lowb")))
    return met.select(F.col("rawa").alias("x"), F.col("rawb").alias("y")).mapInArrow(_crossed(meet), schema)


def met_blocks(rows: DataFrame, threshold: float, meet: Callable, schema: str) -> DataFrame:
    """meet(members, guests) over all blocks of rows(id, v, g) that can hold a pair with cosine >= threshold > 0.

    meet gets two Arrow tables (id, v, g), BLOCK rows each on average; a crowded band is dealt as pairs of blocks, so
    that no group of copies makes a large task. Links are for the caller to check and to take where member id < guest id.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    theta = max(float(np.arccos(threshold)), 1e-3)
    kind = dict(rows.dtypes)
    fields = f"id {kind['id']}, v array<double>, g {kind['g']}"
    pivots = spread_pivots(rows, theta)
    homes = stage(rows.mapInArrow(_homes(pivots), f"{fields}, ball int, angle double"))
    spans = np.tile([np.inf, -np.inf], (len(pivots), 1))
    for r in homes.groupBy("ball").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row a pivot
        spans[r.ball] = r.low, r.high
    spans[~np.isfinite(spans).all(axis=1)] = 4 * np.pi, 4 * np.pi  # empty balls are visited by nobody
    visits = homes.mapInArrow(_counted(pivots, spans, theta), "visits long").agg(F.sum("visits"), F.count("*")).first()
    if (visits[0] or 0) > VISITS * max(1, homes.count()):
        return crossed_blocks(homes.select("id", "v", "g"), meet, schema)
    seen = stage(homes.mapInArrow(_visits(pivots, spans, theta), f"{fields}, ball long, band long, member boolean"))
    key = ["g", "ball", "band"]
    sizes = seen.groupBy(*key).agg(F.ceil(F.count_if("member") / BLOCK).alias("_m"), F.ceil(F.count_if(~F.col("member")) / BLOCK).alias("_g")).where("_m > 0 and _g > 0")
    dealt = seen.join(sizes, key)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("member"), F.col("_m")).otherwise(F.col("_g")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("member"), F.col("_g")).otherwise(F.col("_m")) - 1))
    dealt = dealt.withColumn("_own", own).withColumn("_other", other)
    dealt = dealt.select("id", "v", *key, "member", F.when(F.col("member"), F.col("_own")).otherwise(F.col("_other")).alias("_i"), F.when(F.col("member"), F.col("_other")).otherwise(F.col("_own")).alias("_j"))

    def block(table: pa.Table) -> pa.Table:
        member = table.column("member")
        rest = table.select(["id", "v", "g"])
        return meet(rest.filter(member), rest.filter(pc.invert(member)))

    return dealt.groupBy(*key, "_i", "_j").applyInArrow(block, schema)


def _hits(members: pa.Table, guests: pa.Table, threshold: float, scale: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids of both sides, their similarities, and which are at the threshold with the member's id the smaller one."""
    a, b = members.column("id").to_numpy(), guests.column("id").to_numpy()
    x, y = _matrix(members.column("v")), _matrix(guests.column("v"))
    s = (unit(x) @ unit(y).T if scale else x @ y.T) if len(a) and len(b) else np.zeros((len(a), len(b)))
    return a, b, s, (s >= threshold - 1e-12) & (a[:, None] < b[None, :])


def cosine_pairs(vectors: DataFrame, threshold: float, id_: str = "vec_id", v: str = "embedding", group: str | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs of rows, a < b, of one group, with cosine >= threshold. As many rows as there are pairs."""

    def meet(members, guests):
        a, b, s, hit = _hits(members, guests, threshold)
        i, j = np.nonzero(hit)
        return pa.table({"a": pa.array(a[i]), "b": pa.array(b[j]), "cosine": pa.array(s[i, j])})

    rows = usable(vectors, id_, v, group)
    kind = dict(rows.dtypes)["id"]
    return met_blocks(rows, threshold, meet, f"a {kind}, b {kind}, cosine double")


def cosine_links(vectors: DataFrame, threshold: float, id_: str = "vec_id", v: str = "embedding", group: str | None = None) -> DataFrame:
    """(a, b) that connect the same rows as all pairs with cosine >= threshold do: stars, never all pairs of a group of copies.

    Equal vectors are linked to the smallest id among them, which alone is compared.
    """

    def meet(members, guests):
        a, b, _, hit = _hits(members, guests, threshold)
        left, right = np.arange(len(a)), np.full(len(b), len(a))
        while True:  # each side takes the smallest label it is linked with, until none changes
            low = np.minimum(right, np.where(hit, left[:, None], len(a)).min(axis=0, initial=len(a)))
            new = np.minimum(left, np.where(hit, low[None, :], len(a)).min(axis=1, initial=len(a)))
            if (low == right).all() and (new == left).all():
                break
            left, right = new, low
        i, j = np.flatnonzero(left != np.arange(len(a))), np.flatnonzero(right < len(a))
        return pa.table({"a": pa.array(np.concatenate([a[i], b[j]])), "b": pa.array(np.concatenate([a[left[i]], a[right[j]]]))})

    rows = usable(vectors, id_, v, group)
    kind = dict(rows.dtypes)["id"]
    classes = stage(rows.groupBy("g", "v").agg(F.min("id").alias("id")))
    equal = rows.alias("r").join(classes.alias("c"), (F.col("r.g") == F.col("c.g")) & (F.col("r.v") == F.col("c.v"))).where("r.id <> c.id")
    return met_blocks(classes.select("id", "v", "g"), threshold, meet, f"a {kind}, b {kind}").unionByName(equal.select(F.col("r.id").alias("a"), F.col("c.id").alias("b")))


def linked_components(vectors: DataFrame, threshold: float, id_: str = "vec_id", v: str = "embedding", group: str | None = None) -> DataFrame:
    """id, component (smallest id reached by cosines >= threshold within the group, itself included) of every usable row."""
    from .resolve import components

    rows = usable(vectors, id_, v, group).select("id")
    found = components(stage(cosine_links(vectors, threshold, id_, v, group)))
    return rows.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: clusters of a component that one task merges
LOCAL = 1024


def merge_locally(x: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Index of the cluster, its smallest member, that each of some clusters (mean vectors, sizes) ends in by average linkage.

    The mean cosine of two clusters of unit vectors is the product of their means. Clusters that are each other's
    nearest merge, all of them at once: average linkage never makes a merged cluster nearer to others, so the order of
    such merges doesn't matter. Ties go to smaller members.
    """
    x, size, home = x.copy(), size.astype(np.float64), np.arange(len(x))
    ids = np.arange(len(x))  # of the clusters that are left
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    while len(ids) > 1:
        to = s.argmax(axis=1)
        at = np.arange(len(to))
        i = np.flatnonzero((to[to] == at) & (at < to))
        i = i[s[i, to[i]] >= threshold - 1e-12]
        if not len(i):
            break
        j = to[i]
        x[i] = (x[i] * size[i, None] + x[j] * size[j, None]) / (size[i] + size[j])[:, None]
        size[i] += size[j]
        s[i] = x[i] @ x.T
        s[:, i] = s[i].T
        s[i, i] = -np.inf
        forward = np.arange(len(home))
        forward[ids[j]] = ids[i]
        home = forward[home]
        left = np.setdiff1d(at, j)
        ids, x, size, s = ids[left], x[left], size[left], s[np.ix_(left, left)]
    return home


def average_linkage(vectors: DataFrame, threshold: float, id_: str = "vec_id", v: str = "embedding", group: str | None = None) -> DataFrame:
    """id, cluster (its smallest id): average linkage by cosine within each group, while the mean similarity is at threshold.

    A mean at the threshold needs a pair at it, so nothing crosses the components of such pairs. A component of up to LOCAL
    clusters is merged by one task. In larger ones, each round finds the nearest cluster of each through the cosine
    join (product of means >= threshold implies cosine >= threshold) and merges all that are each other's nearest;
    clusters that have none are done and leave, and so do components that have become small enough. Equal vectors are one cluster from the start. Ties go to smaller ids.
    """

    def nearest(members, guests):
        a, b, s, hit = _hits(members, guests, threshold, scale=False)
        s = np.where(hit, s, -np.inf)
        i, j = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        to, of = s[i].argmax(axis=1) if len(i) else i, s[:, j].argmax(axis=0) if len(j) else j
        first = lambda ids, m, axis: np.where(m, ids, np.iinfo(np.int64).max).min(axis=axis)
        to_id = first(b[None, :], s[i] == s[i, to][:, None], 1) if len(i) else np.empty(0, np.int64)
        of_id = first(a[:, None], s[:, j] == s[of, j][None, :], 0) if len(j) else np.empty(0, np.int64)
        return pa.table({"id": pa.array(np.concatenate([a[i], b[j]]), pa.int64()), "to": pa.array(np.concatenate([to_id, of_id]), pa.int64()), "sim": pa.array(np.concatenate([s[i, to], s[of, j]]), pa.float64())})

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        return pa.table({"id": pa.array(ids), "cluster": pa.array(ids[merge_locally(_matrix(table.column("v")), table.column("size").to_numpy(), threshold)])})

    def scaled(batches):
        for b in batches:
            x = unit(_matrix(b.column("v"))) if b.num_rows else np.empty((0, 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), flat, b.column("g")], names=["id", "v", "g"])

    rows = usable(vectors, id_, v, group)
    kind = dict(rows.dtypes)["g"]
    rows = rows.withColumn("id", F.col("id").cast("long")).mapInArrow(scaled, f"id long, v array<double>, g {kind}")
    rows = stage(rows)
    live = stage(rows.groupBy("g", "v").agg(F.min("id").alias("id"), F.count("*").alias("size")))
    home = rows.join(live.select("g", "v", F.col("id").alias("cluster")), ["g", "v"]).select("id", "cluster")
    parts = linked_components(live, threshold, "id", "v", "g").select("id", F.struct("component").alias("part"))
    live = stage(live.join(parts, "id").select("id", "v", "size", "part"))
    moves = []
    while True:
        sizes = live.groupBy("part").agg(F.count("*").alias("_n"))
        told = stage(live.join(sizes, "part"))
        small = told.where(F.col("_n") <= LOCAL)
        moves.append(stage(small.where("_n > 1").groupBy("part").applyInArrow(local, "id long, cluster long").where("id <> cluster")))
        live = told.where(F.col("_n") > LOCAL).drop("_n")
        if live.isEmpty():
            break
        best = met_blocks(live.select("id", "v", F.col("part").alias("g")), threshold, nearest, "id long, to long, sim double")
        best = stage(best.groupBy("id").agg(F.max_by("to", F.struct("sim", -F.col("to"))).alias("to")))
        back = best.select(F.col("id").alias("to"), F.col("to").alias("_back"))
        merged = stage(best.join(back, "to").where("_back = id and id < to").select("id", "to"))
        moves.append(merged.select(F.col("to").alias("id"), F.col("id").alias("cluster")))
        if merged.isEmpty():
            break
        second = live.select(F.col("id").alias("to"), F.col("v").alias("_v"), F.col("size").alias("_s"))
        # a merged cluster is never nearer to others than its parts were: one without a neighbour at the threshold is done
        grown = live.join(best.select("id"), "id", "left_semi").join(merged, "id", "left").join(second, "to", "left")
        mean = F.zip_with("v", "_v", lambda p, q: (p * F.col("size") + q * F.col("_s")) / (F.col("size") + F.col("_s")))
        grown = grown.select("id", F.coalesce(mean, "v").alias("v"), (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size"), "part")
        live = stage(grown.join(merged.select(F.col("to").alias("id")), "id", "left_anti"))
    to = stage(reduce(DataFrame.unionByName, moves)).toDF("id", "to")  # a forest: each id moves once at most, to a smaller one
    while True:
        far = to.select(F.col("id").alias("to"), F.col("to").alias("_far"))
        jumped = stage(to.join(far, "to", "left").select("id", F.coalesce("_far", "to").alias("to"), F.col("_far").isNotNull().alias("_moved")))
        to = jumped.select("id", "to")
        if jumped.where("_moved").isEmpty():
            break
    return home.join(to.select(F.col("id").alias("cluster"), "to"), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))
