"""Raw triples to canonical, oriented evidence: one narrow projection, then one aggregation by set.

Exact mode: two texts are equal if their normalised surfaces are. All steps but the mapper join stay in one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import relation as R
from ..functions import text as T

WEAK_FACTOR = 0.5


def _ends(s: Column, o: Column, fs: Column, fo: Column) -> Column:
    """Both ends and the fact's, each with its canonical form."""
    named = {"s": s, "o": o, "fs": fs, "fo": fo}
    return F.struct(*[v.alias(k) for k, v in named.items()], *[T.canonical_entity(v).alias(f"c{k}") for k, v in named.items()])


def _same(e: Column, a: str, b: str) -> Column:
    return (e[f"c{a}"] != "") & (e[f"c{a}"] == e[f"c{b}"])


def _aligned(e: Column, a: str, b: str) -> Column:
    return T.surfaces_align(F.trim(e[a]), F.trim(e[b]))


def _known(e: Column) -> Column:
    return (F.trim(e["fs"]) != "") & (F.trim(e["fo"]) != "")


def flipped(e: Column) -> Column:
    """Whether a triple's ends are the other way round than the fact's: by canonical form, then by containment."""
    return (
        F.when(_same(e, "s", "fs") & _same(e, "o", "fo"), False).when(_same(e, "s", "fo") & _same(e, "o", "fs"), True)
        .when(_known(e) & _aligned(e, "s", "fs") & _aligned(e, "o", "fo"), False)
        .when(_known(e) & _aligned(e, "s", "fo") & _aligned(e, "o", "fs"), True).otherwise(False)
    )


def seed_flipped(e: Column) -> Column:
    """Whether more ends fit the fact's when turned: by canonical form, then with containment; ties keep."""
    n = lambda test, *pairs: sum((test(e, a, b).cast("int") for a, b in pairs), F.lit(0))
    near = lambda e, a, b: _same(e, a, b) | _aligned(e, a, b)
    straight, turned = (("s", "fs"), ("o", "fo")), (("s", "fo"), ("o", "fs"))
    exact = n(_same, *turned) - n(_same, *straight)
    return _known(e) & F.when(exact > 0, True).when(exact < 0, False).otherwise(n(near, *turned) > n(near, *straight))


def _turn(e: Column, test) -> Column:
    """The ends after a test: swapped where it says so."""
    return T.let(
        F.struct(e.alias("e"), F.coalesce(test(e), F.lit(False)).alias("t")),
        lambda x: F.struct(
            *[F.when(x["t"], x["e"][b]).otherwise(x["e"][a]).alias(a) for a, b in (("s", "o"), ("o", "s"), ("cs", "co"), ("co", "cs"))],
            *[x["e"][c].alias(c) for c in ("fs", "fo", "cfs", "cfo")],
        ),
    )


def normalize_relation(relation: Column, gold: Column, mapped: Column) -> Column:
    """The fact's own relation if it has a recognised one; else a literal canonical one, else the learned map's, else unknown."""
    slug = F.regexp_replace(F.lower(F.trim(F.coalesce(relation, F.lit("")))), "[ -]", "_")
    literal = T.let(slug, lambda x: F.when(x.isin(*[r for r in R.CANONICAL if r != "unknown"]), x))
    return F.coalesce(R.fact_gold(gold), literal, mapped, F.lit("unknown"))


def align(raw: DataFrame, label_map: DataFrame | None = None, mapper: DataFrame | None = None, id_exempt: bool = False, light: bool = False) -> DataFrame:
    """set_id, note, seq, source, s, r, o, k, polarity, confidence, reason of raw(set_id, note, seq, fact, s, r, o).

    reason is ok or why the triple is dropped (bad_shape, generic_object, low_value, same_node). label_map(key,
    relation) and mapper(key, cui) are small dimension tables; the planner broadcasts them by size. Ids that a mapper
    gives are numeric-heavy and so dropped, as the strict path has always done; id_exempt keeps them; light skips the
    mapper.
    """
    p = R.preprocess(F.col("s"), F.col("r"), F.col("o"))
    d = raw.withColumn("_bad", F.col("s").isNull() | F.col("r").isNull() | F.col("o").isNull())
    d = d.withColumn("_p", p).withColumn("_f", R.parse_fact(F.col("fact")))
    d = d.select(
        "set_id", "note", "seq", "fact", "_bad", F.col("r").alias("_raw"), F.col("_p.r").alias("_r"),
        T.validity_surface(F.col("_p.s")).alias("_s"), T.validity_surface(F.col("_p.o")).alias("_o"),
        F.coalesce("_f.s", F.lit("")).alias("_fs"), F.coalesce("_f.o", F.lit("")).alias("_fo"),
        R.cue_relation(R.cue(F.col("fact"))).alias("_gold"), T.relation_key(F.col("_p.r")).alias("_key"),
    )
    if label_map is not None:
        kept = label_map.where(F.col("relation").isin(*R.SEMANTIC)).groupBy("key").agg(F.min("relation").alias("_mapped"))
        d = d.join(kept, d["_key"] == kept["key"], "left").drop("key")
    else:
        d = d.withColumn("_mapped", F.lit(None).cast("string"))
    r = R.upgrade_prevents(normalize_relation(F.col("_r"), F.col("_gold"), F.col("_mapped")), F.col("_raw"), F.col("_r"))
    weak = lambda c: c.isin("unknown", R.WEAK)
    told = T.let(r, lambda c: F.struct(F.when(weak(c), R.WEAK).otherwise(c).alias("r"), F.when(weak(c), F.lit(WEAK_FACTOR)).otherwise(F.lit(1.0)).alias("confidence")))
    d = d.withColumn("_told", told).withColumn("r", F.col("_told.r")).withColumn("confidence", F.col("_told.confidence"))
    ends = T.let(_ends(F.col("_s"), F.col("_o"), F.col("_fs"), F.col("_fo")), lambda e: T.let(_turn(e, flipped), lambda x: _turn(x, seed_flipped)))
    d = d.withColumn("_e", ends)
    if mapper is not None and not light:
        named = mapper.groupBy("key").agg(F.max("cui").alias("cui"))
        d = d.withColumn("_s", F.col("_e.s")).withColumn("_o", F.col("_e.o"))
        for end in ("_s", "_o"):
            m = named.select(F.col("key").alias("_k"), F.col("cui").alias("_cui"))
            d = d.join(m, T.mapper_key(T.strip_agentive(F.col(end))) == F.col("_k"), "left").withColumn(end, F.coalesce("_cui", end)).drop("_k", "_cui")
        d = d.withColumn("_e", F.struct(F.col("_s").alias("s"), F.col("_o").alias("o")))

    def judged(e: Column) -> Column:
        drop = lambda x: (T.drop_reason(x) != "ok") & (~T.is_ontology_id(x) if id_exempt else F.lit(True))
        bad = T.low_value_node(e["s"]) | T.low_value_node(e["o"]) | drop(e["s"]) | drop(e["o"])
        reason = F.when(T.generic_object(e["o"]), "generic_object").when(bad, "low_value").when(e["s"] == e["o"], "same_node").otherwise("ok")
        return F.struct(e["s"].alias("s"), e["o"].alias("o"), reason.alias("reason"))

    final = T.let(
        F.col("_e"),
        lambda e: T.let(
            F.struct(T.validity_surface(T.canonical_entity(e["s"])).alias("s"), T.validity_surface(T.canonical_entity(e["o"])).alias("o")), judged
        ),
    )
    d = d.withColumn("_j", final)
    reason = F.when(F.col("_bad"), "bad_shape").otherwise(F.col("_j.reason"))
    source = F.concat(F.lit("set"), F.col("set_id").cast("string"), F.lit(":p"), F.col("note").cast("string"))
    return d.select(
        "set_id", "note", "seq", source.alias("source"), F.col("_j.s").alias("s"), "r", F.col("_j.o").alias("o"), F.col("_j.o").alias("k"),
        F.lit("positive").alias("polarity"), "confidence", reason.alias("reason"),
    )


def distinct_in_note(aligned: DataFrame) -> DataFrame:
    """The first of equal triples of a note, dropped ones gone: what the engine folds."""
    w = Window.partitionBy("set_id", "note", "s", "r", "o", "polarity").orderBy("seq")
    return aligned.where("reason = 'ok'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "reason")


def drop_counts(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("set_id", "reason").agg(F.count("*").alias("n"))


def with_fallback(raw: DataFrame, label_map: DataFrame | None = None, mapper: DataFrame | None = None) -> DataFrame:
    """Strict evidence; sets that it leaves empty get the light path's (no mapper) under one source; with none of that either, the fact's own triple."""
    strict = distinct_in_note(align(raw, label_map, mapper))
    have = strict.select("set_id").distinct()
    light = distinct_in_note(align(raw.join(have, "set_id", "left_anti"), label_map, None, light=True))
    light = light.withColumn("source", F.concat(F.lit("set"), F.col("set_id").cast("string"), F.lit(":surface_fallback")))
    rest = raw.join(have.unionByName(light.select("set_id").distinct()), "set_id", "left_anti").groupBy("set_id").agg(F.first("fact").alias("fact"))
    seeded = rest.withColumn("_f", R.parse_fact(F.col("fact"))).where("_f is not null and _f.r = 'metabolized_by'")
    seeded = seeded.select(
        "set_id", F.lit(0).cast(raw.schema["note"].dataType).alias("note"), F.lit(0).cast(raw.schema["seq"].dataType).alias("seq"),
        F.concat(F.lit("set"), F.col("set_id").cast("string"), F.lit(":fact_seeded")).alias("source"), T.canonical_entity(F.col("_f.s")).alias("s"),
        F.col("_f.r").alias("r"), T.canonical_entity(F.col("_f.o")).alias("o"), T.canonical_entity(F.col("_f.o")).alias("k"),
        F.lit("positive").alias("polarity"), F.lit(1.0).alias("confidence"),
    )
    return strict.unionByName(light).unionByName(seeded)


def pin_seed(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """edges with status active on the first edge whose ends are the fact's, by facts(set_id, fact)."""
    f = facts.select("set_id", R.parse_fact(F.col("fact")).alias("_f"))
    f = f.select("set_id", T.canonical_entity(F.col("_f.s")).alias("_fs"), T.canonical_entity(F.col("_f.o")).alias("_fo"))
    hit = (F.col("s") == F.col("_fs")) & (F.col("o") == F.col("_fo"))
    joined = edges.join(f, "set_id", "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    w = Window.partitionBy("set_id", "_hit").orderBy("first_seq")
    pinned = F.col("_hit") & (F.row_number().over(w) == 1)
    return joined.withColumn("_pin", pinned).withColumn("status", F.when(F.col("_pin"), "active").otherwise(F.col("status"))).drop("_fs", "_fo", "_hit", "_pin")


def seed_directed(direct: Column, turned: Column, lexical_direct: Column, lexical_turned: Column, margin: float = 0.02) -> Column:
    """Whether to turn a triple: by sums of cosines if they differ by the margin, else by the lexical score; ties keep.

    Sums that are null (no vectors) leave it to the lexical score.
    """
    gap = F.coalesce(turned - direct, F.lit(0.0))
    return F.when(gap > margin, True).when(gap < -margin, False).otherwise(lexical_turned > lexical_direct)


def accepted(term: Column, mapped: Column, fuzzy: Column) -> Column:
    """The mapper's answer if it is an identifier or another text, else the fuzzy match's, else the term."""
    plain = T.normalize_surface(F.coalesce(term, F.lit("")))
    good = mapped.isNotNull() & (T.is_ontology_id(mapped) | (T.normalize_surface(mapped) != plain))
    return F.when(good, mapped).otherwise(F.coalesce(fuzzy, term))


def peers(nodes: DataFrame, k: int = 48) -> DataFrame:
    """set_id, peers: the first k of each set's distinct nodes(set_id, node) in order."""
    by = Window.partitionBy("set_id").orderBy("node")
    first = nodes.select("set_id", "node").distinct().withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= k)
    return first.groupBy("set_id").agg(F.array_sort(F.collect_list("node")).alias("peers"))
