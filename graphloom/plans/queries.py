"""Queries by name: (spark, sf_dir) -> DataFrame. Doubles are rounded, so that engines' sums compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import relation as R
from ..functions import text as T
from ..functions import vector as V
from ..operators import edges as E
from ..operators import labels as L
from ..operators import learning as N
from ..operators import qa as Q
from ..operators import resolve as C
from ..operators import stability as S
from ..streaming import engine as X
from . import views as W

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query
def drift_top10(spark, d):
    return S.drift(S.note_pairs(W.events(spark, d))).orderBy("mean_jaccard", "set_id").limit(10).select("set_id", "n_pairs", *_r("mean_ged", "mean_jaccard", "drift"))


@query
def stability_pairwise(spark, d):
    return S.note_pairs(W.events(spark, d)).select("set_id", "i", "j", "ged", *_r("jaccard"))


@query
def drift_at_tau(spark, d):
    return S.drift(S.note_pairs(W.events(spark, d))).select("set_id", "n_pairs", *_r("mean_ged", "mean_jaccard", "drift"))


@query
def stability_summary_ci(spark, d):
    pairs = S.note_pairs(W.events(spark, d)).select(F.col("ged").cast("double").alias("ged"), "jaccard")
    one = lambda c: S.summarize(pairs, c).select(F.lit(c).alias("metric"), "n", *_r("mean", "sd", "ci_lower", "ci_upper"))
    return one("ged").unionAll(one("jaccard"))


@query
def consecutive_drift(spark, d):
    return S.consecutive(W.events(spark, d)).select("set_id", "note", "ged", *_r("jaccard"))


@query
def unsupported_rate(spark, d):
    t = W.events(spark, d)
    return S.unsupported_rate(t.where(F.col("r") != R.WEAK), t.where("note < '2024-01-16'")).select("set_id", "n_edges", "n_unsupported", *_r("rate"))


@query
def note_support(spark, d):
    t = W.events(spark, d)
    return S.note_support(t.where(F.col("r") != R.WEAK), t).select("set_id", *_r("mean", "max", "min"))


@query
def edge_state(spark, d):
    told = F.array_join(F.transform("provenance", lambda x: F.concat_ws(":", x["seq"], x["source"], x["polarity"])), ",")
    return E.fold(W.lineitem(spark, d)).select("set_id", "s", "r", "o", "polarity", *_r("confidence"), "first_seq", "n_sources", told.alias("provenance"))


@query
def relation_conflicts(spark, d):
    return E.relation_conflicts(E.fold_light(W.lineitem(spark, d))).drop("source")


@query
def object_conflicts(spark, d):
    return E.object_conflicts(E.fold_light(W.lineitem(spark, d))).drop("source")


@query
def polarity_merge_clashes(spark, d):
    ev = W.lineitem(spark, d)
    return E.merge_clashes(ev, E.fold_light(ev)).drop("k")


@query
def edge_status(spark, d):
    return E.with_status(W.lineitem(spark, d)).select("set_id", "s", "r", "o", "status")


@query
def edge_status_counts(spark, d):
    return E.with_status(W.event_evidence(spark, d)).groupBy("r", "status").agg(F.count("*").alias("n"))


@query
def update_log(spark, d):
    return E.update_log(W.event_evidence(spark, d))


@query
def heuristic_conflicts(spark, d):
    return E.heuristic_conflicts(W.lineitem(spark, d)).select("set_id", "s", "o", "r1", "r2")


@query
def collapse_max_conf(spark, d):
    return E.collapse_max_confidence(W.lineitem(spark, d)).select("set_id", "s", "r", "o", "polarity", "seq", *_r("confidence"))


@query
def collapse_best_object(spark, d):
    return E.collapse_best_object(W.lineitem(spark, d)).select("set_id", "s", "r", "o", "polarity", "seq", *_r("confidence"))


@query
def sr_object_dedupe(spark, d):
    return E.dedupe_objects(W.lineitem(spark, d))


@query
def qa_graph_union(spark, d):
    ev, key = W.lineitem(spark, d), ["s", "r", "o"]
    return ev.where("polarity = 'positive'").select(*key).union(ev.where("confidence >= 0.95").select(*key)).distinct()


@query
def qa_graph_diff(spark, d):
    ev, key = W.lineitem(spark, d), ["s", "r", "o"]
    a, b = ev.where("polarity = 'positive'").select(*key).distinct(), ev.where("confidence >= 0.95").select(*key).distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(a, "first").unionAll(count(b, "second")).unionAll(count(a.subtract(b), "only_first")).unionAll(count(b.subtract(a), "only_second")).unionAll(count(a.intersect(b), "both"))


@query
def cooccurrence(spark, d):
    return L.cooccurrence(W.labels(spark, d))


@query
def label_argmax_map(spark, d):
    return L.argmax_map(W.labels(spark, d)).select("label", "top", "n", "total", *_r("ratio"), "mapped")


@query
def label_argmax_lex(spark, d):
    return L.argmax_lex(W.labels(spark, d))


@query
def surface_normalize(spark, d):
    return T.with_surface(W.table(spark, d, "documents").select("doc_id", "text"), "text", "surface").select("doc_id", F.md5("surface").alias("surface"))


@query
def sentence_split(spark, d):
    docs = W.table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("last"), F.sum(F.length("sentence")).alias("chars"))


@query
def relation_cue(spark, d):
    c = R.cue(F.col("text"))
    docs = W.table(spark, d, "documents").select("doc_id", c.alias("cue")).withColumn("relation", R.cue_relation(F.col("cue")))
    facts = W.facts(spark, d).select((-1 - F.col("id")).alias("doc_id"), R.cue(F.col("fact")).alias("cue")).withColumn("relation", R.cue_relation(F.col("cue")))
    return docs.unionAll(facts)


@query
def fact_parse(spark, d):
    p = R.parse_fact(F.col("fact"))
    return W.facts(spark, d).select("id", p.alias("p")).select("id", F.col("p.s").alias("s"), F.col("p.r").alias("r"), F.col("p.o").alias("o"))


@query
def fact_questions(spark, d):
    p = W.facts(spark, d).select("id", R.parse_fact(F.col("fact")).alias("p")).where("p is not null")
    return p.select("id", F.posexplode(R.questions(F.col("p.s"), F.col("p.r"), F.col("p.o"))).alias("pos", "question")).withColumn("pos", F.col("pos").cast("long"))


@query
def passive_swap(spark, d):
    p = R.preprocess(F.col("s"), F.col("r"), F.col("o"))
    return W.relation_rows(spark, d).select("id", p.alias("p")).select("id", "p.s", "p.r", "p.o")


@query
def line_parse(spark, d):
    t = T.triple_line(F.col("line"))
    rows = W.lines(spark, d).select("id", t.alias("t"), T.answer_line(F.col("line")).alias("answer"), R.head_label(F.col("line")).alias("label"))
    return rows.select("id", F.col("t.s").alias("s"), F.col("t.r").alias("r"), F.col("t.o").alias("o"), "answer", "label")


@query
def entity_validity(spark, d):
    p = W.table(spark, d, "part").select(F.concat_ws(" ", F.col("p_size").cast("string"), "p_name").alias("t"), "p_partkey")
    b = W.table(spark, d, "nation").select(F.col("n_name").alias("t"), F.col("n_nationkey").cast("long").alias("p_partkey"))
    rows = p.unionAll(b).unionAll(p.select(F.concat(F.lit("due to "), F.substring("t", 1, 4)).alias("t"), "p_partkey"))
    return rows.groupBy(T.drop_reason(F.col("t")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.col("p_partkey")).alias("total"))


@query
def headword(spark, d):
    return W.table(spark, d, "part").groupBy(T.headword(T.normalize_surface(F.col("p_name"))).alias("head")).agg(F.count("*").alias("n"), F.min("p_name").alias("least"))


@query
def containment_merge(spark, d):
    """Pairs of distinct names of one head of which one holds the other; the head is the join's key."""
    n = W.table(spark, d, "part").select(F.lower("p_name").alias("a")).distinct()
    n = n.unionAll(n.select(T.headword(F.col("a")).alias("a"))).distinct().withColumn("head", T.headword(F.col("a")))
    m = n.select(F.col("a").alias("b"), "head")
    return n.join(m, "head").where("a < b").where(T.lexically_contains(F.col("a"), F.col("b"))).select("head", "a", "b")


@query
def preferred_surface(spark, d):
    p = W.table(spark, d, "part").select(T.headword(F.lower("p_name")).alias("canonical"), F.col("p_name").alias("surface"), F.col("p_partkey").alias("seq"))
    return Q.preferred_surface(p)


@query
def qa_alias_expand(spark, d):
    p = W.table(spark, d, "part")
    alias = p.select(T.headword(F.lower("p_name")).alias("canonical"), F.col("p_name").alias("surface"))
    g = p.select(T.headword(F.lower("p_name")).alias("s"), F.lit("treats").alias("r"), F.col("p_brand").alias("o"))
    return Q.expand_aliases(g, alias)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    rel = F.array(F.lit("causes"), F.lit("Causes"), F.lit("treats"))
    p = W.table(spark, d, "part").select(F.col("p_partkey").alias("q_id"), F.concat(F.lit("p"), "p_partkey").alias("s"), rel.alias("relations"), F.lit("?").alias("o"), F.concat(F.lit("s"), F.col("p_partkey") % 10 + 1).alias("answer"))
    s = W.table(spark, d, "supplier").select((-F.col("s_suppkey")).alias("q_id"), F.lit("?").alias("s"), rel.alias("relations"), F.concat(F.lit("s"), "s_suppkey").alias("o"), F.lit("p1").alias("answer"))
    return p.unionAll(s)


@query
def qa_ranked_lookup(spark, d):
    return Q.ranked_lookup(W.lineitem(spark, d), _questions(spark, d))


@query
def qa_metrics(spark, d):
    q = _questions(spark, d)
    return Q.metrics(Q.ranked_lookup(W.lineitem(spark, d), q), q).select("n", *_r("exact", "top1", "mrr"))


@query
def label_centroids(spark, d):
    c = N.centroid_of(W.table(spark, d, "embeddings"), "label")
    told = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)
    return c.select("label", "n", F.round(told, 6).alias("total"), F.round(F.element_at("centroid", 1), 6).alias("first"))


@query
def nearest_centroid(spark, d):
    e = W.table(spark, d, "embeddings")
    return N.nearest(e, N.centroid_of(e, "label"), "label").select("vec_id", "nearest", *_r("distance"))


@query
def cosine_to_first(spark, d):
    """Cosine of every vector with its label's first one."""
    e = W.table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    return e.join(first, "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("f")), 6).alias("cosine"))


@query
def baseline_compare(spark, d):
    """Mean of per-set means of each extractor (event type groups), sets without triples masked."""
    t = W.events(spark, d).withColumn("extractor", F.when(F.col("seq") % 3 == 0, "b1").when(F.col("seq") % 3 == 1, "b2").otherwise("b3"))
    out = []
    for b in ("b1", "b2", "b3"):
        m = S.drift(S.note_pairs(t.where(F.col("extractor") == b)))
        out.append(m.agg(F.count("*").alias("n_sets"), F.avg("mean_ged").alias("ged"), F.avg("mean_jaccard").alias("jaccard"), F.avg("drift").alias("drift")).select(F.lit(b).alias("extractor"), "n_sets", *_r("ged", "jaccard", "drift")))
    return out[0].unionAll(out[1]).unionAll(out[2])


@query
def type_counts(spark, d):
    t = W.events(spark, d)
    return t.groupBy("r").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


@query
def entity_in_sentence(spark, d):
    """Every mention of " the " and the sentence, by order, that holds it whole: interval containment by buckets of positions."""
    docs = W.table(spark, d, "documents").select("doc_id", "text")
    return C.mentions_in_sentences(docs, " the ")


@query
def label_weights(spark, d):
    n = W.labels(spark, d).groupBy("gold").agg(F.count("*").alias("n"))
    return C.label_weights(n).select("gold", "n", *_r("weight"))


@query
def sim_components(spark, d):
    """Components of parts' names that share a word, each named by its smallest name."""
    n = W.table(spark, d, "part").select("p_name").distinct()
    w = n.select("p_name", F.explode(F.split("p_name", " ")).alias("w"))
    hub = w.groupBy("w").agg(F.min("p_name").alias("b"))
    return C.components(w.join(hub, "w").select(F.col("p_name").alias("a"), "b"))


@query
def registry_merge(spark, d):
    return C.registry_merge(W.table(spark, d, "embeddings"), "label", 0.4)


@query
def agglomerative(spark, d):
    return C.agglomerative(W.table(spark, d, "embeddings"), "label", 0.3)


@query
def fuzzy_match(spark, d):
    n = W.table(spark, d, "part").select(F.lower("p_name").alias("term")).distinct()
    return C.fuzzy_match(n.select(F.concat("term", F.lit("s")).alias("term")), n)


@query
def stream_fold(spark, d):
    """Event evidence through the stateful stream, by batch, and the table that it leaves."""
    cols = ["set_id", "s", "r", "o", "polarity", "confidence", "first_seq", "n_evidence"]
    return X.current_edges(spark, X.replay(W.event_evidence(spark, d))).select(*cols)
