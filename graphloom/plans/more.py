"""Queries of learned relations, resolution, question answering, simulation and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import relation as R
from ..functions import text as T
from ..functions import vector as V
from ..operators import align as A
from ..operators import edges as E
from ..operators import extract as X
from ..operators import labels as L
from ..operators import linker as K
from ..operators import learning as N
from ..operators import qa as Q
from ..operators import resolve as C
from ..operators import similarity as M
from ..operators import stability as S
from ..sources import backfill as H
from ..sources import corpus as B
from ..sources.shared import forget, shared_path
from ..streaming import engine as Z
from . import oracle
from . import views as W
from .oracle import CLASH, EDGES, EV, LI, MEASURE, STATUS, TV

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- facts of parts: one verb for each last digit of the key

VERBS = ("is metabolized by", "is used to treat", "interacts with", "increases the risk of", "can cause", "leads to", "lowers", "prevents", "raises", "contains")
_BY_CUE = ("metabolized_by", "treats", "interacts_with", "increases", "causes", "related_to", "reduces", "prevents", "increases", "related_to")
_BY_PHRASE = ("metabolized_by", "treats", "interacts_with", "increases", None, "causes", "reduces", "prevents", "increases", None)
_BY_PARSE = ("metabolized_by", "treats", "interacts_with", "increases", "causes", None, "reduces", "prevents", None, None)


def _case(of: str, values) -> str:
    return f"CASE {of} % 10 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


PF = f"pf AS (SELECT p_partkey AS id, p_name, p_brand, p_size, p_name || ' ' || ({_case('p_partkey', VERBS)}) || ' ' || p_brand || '.' AS fact FROM part)"
PE = f"{PF}, pe AS (SELECT pf.*, e.embedding, {_case('id', _BY_CUE)} AS cue FROM pf JOIN embeddings e ON e.vec_id = pf.id)"


def _digit(c, values):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(c) % 10).cast("int"))


def facts(spark, d):
    p = W.table(spark, d, "part")
    verb = _digit("p_partkey", VERBS)
    return p.select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_size", F.concat("p_name", F.lit(" "), verb, F.lit(" "), "p_brand", F.lit(".")).alias("fact"))


def fact_vectors(spark, d):
    return facts(spark, d).join(W.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


@query(f"""WITH {PF}, t AS (SELECT id, coalesce({_case('id', _BY_PHRASE)}, lower(fact)) AS phrase FROM pf)
  SELECT id, phrase, trim(regexp_replace(regexp_replace(phrase, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS words FROM t""")
def relation_phrase(spark, d):
    return facts(spark, d).select("id", R.phrase(F.col("fact")).alias("phrase")).withColumn("words", R.phrase_words(F.col("phrase")))


def _centres(name: str, rows: str, group: str) -> str:
    return f"{name} AS (SELECT {group} AS g, pos, avg(x) AS m, count(*) AS n FROM (SELECT {group}, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM {rows}) GROUP BY ALL)"


def _near(name: str, rows: str, centres: str) -> str:
    return f"""{name} AS (SELECT id, arg_min(g, (dist, g)) AS g FROM (SELECT id, g, sqrt(sum((x - m) * (x - m))) AS dist
      FROM (SELECT id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM {rows}) JOIN {centres} USING (pos) GROUP BY ALL) GROUP BY id)"""


SUPERVISED = f"""{PE}, an AS (SELECT * FROM pe WHERE cue <> 'related_to'), lo AS (SELECT * FROM pe WHERE cue = 'related_to'),
  {_centres('c1', 'an', 'cue')}, {_near('nl', 'lo', 'c1')}, fin AS (SELECT pe.id, pe.embedding, coalesce(nl.g, cue) AS relation FROM pe LEFT JOIN nl USING (id)), {_centres('c2', 'fin', 'relation')}"""


@query(f"WITH {SUPERVISED} SELECT id, relation FROM fin")
def supervised_relations(spark, d):
    return N.supervised(fact_vectors(spark, d))[0]


@query(f"""WITH {SUPERVISED}, g AS (SELECT g, max(n) AS n, round(sum(m), 6) AS total FROM c2 GROUP BY g)
  SELECT row_number() OVER (ORDER BY g = 'related_to', g) - 1 AS cluster_id, g AS relation, n, total FROM g""")
def supervised_clusters(spark, d):
    groups = N.supervised(fact_vectors(spark, d))[1]
    return groups.select("cluster_id", "relation", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""WITH {SUPERVISED}, kn AS (SELECT fact, 'reduces' AS same FROM pf WHERE id % 20 = 9 GROUP BY fact),
  q AS (SELECT * FROM pe WHERE cue = 'related_to'), {_near('n2', 'q', 'c2')}
  SELECT pe.id, CASE WHEN cue <> 'related_to' THEN cue ELSE coalesce(same, g, 'related_to') END AS relation,
    CASE WHEN cue <> 'related_to' THEN 'cue' WHEN same IS NOT NULL THEN 'fact' WHEN g IS NOT NULL THEN 'centroid' ELSE 'none' END AS via
  FROM pe LEFT JOIN kn USING (fact) LEFT JOIN n2 ON n2.id = pe.id""")
def fact_relation(spark, d):
    rows = fact_vectors(spark, d)
    known = facts(spark, d).where("id % 20 = 9").select("fact", F.lit("reduces").alias("relation"))
    return N.infer(rows, known, N.supervised(rows)[1].select("relation", "centroid"))


_SEVEN = "CASE vec_id " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(R.SEMANTIC)) + " END"
_COSINE = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


@query(f"""WITH {PE}, r AS (SELECT {_SEVEN} AS relation, embedding AS e FROM embeddings WHERE vec_id < 7),
  s AS (SELECT id, arg_max(relation, (c, relation)) AS relation, max(c) AS c FROM (SELECT id, relation, {_COSINE.format(a='embedding', b='e')} AS c FROM pe CROSS JOIN r) GROUP BY id)
  SELECT id, CASE WHEN c >= CAST(0.2 AS DOUBLE) THEN relation WHEN p_size % 7 = 0 THEN 'treats' WHEN p_size % 7 = 3 THEN 'causes' ELSE 'unknown' END AS resolved,
    CASE WHEN p_size % 7 = 0 THEN 'treats' WHEN p_size % 7 = 3 THEN 'causes' END AS mapped FROM pe JOIN s USING (id)""")
def relation_resolve(spark, d):
    rows = fact_vectors(spark, d).select("id", F.concat(F.lit("label "), (F.col("p_size") % 7).cast("string")).alias("label"), "embedding")
    e = W.table(spark, d, "embeddings").where("vec_id < 7")
    relations = e.select(F.get(F.array(*[F.lit(r) for r in R.SEMANTIC]), F.col("vec_id").cast("int")).alias("relation"), "embedding")
    named = spark.createDataFrame([("LABEL_0", "treats"), ("LABEL_3", "causes")], "key string, relation string")
    return N.resolve(rows, relations, named, 0.2).select("id", "resolved", "mapped")


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'treats' WHEN 1 THEN 'LABEL_1' WHEN 2 THEN 'related_to' WHEN 3 THEN 'unknown' WHEN 4 THEN 'interacts_with' ELSE 'LABEL_3' END AS lit,
    CASE p_partkey % 5 WHEN 0 THEN 'causes' WHEN 1 THEN 'treats' END AS gold, CASE p_partkey % 3 WHEN 0 THEN 'causes' WHEN 1 THEN 'unknown' ELSE 'treats' END AS ctx,
    CASE WHEN p_partkey % 7 < 3 THEN 'prevents' END AS mapped, p_partkey % 2 = 0 AS has FROM part)
  SELECT id, CASE WHEN lit IN ('treats', 'interacts_with') THEN CASE WHEN gold IS NOT NULL AND gold <> lit THEN gold ELSE lit END
    WHEN lit = 'related_to' THEN coalesce(gold, 'related_to')
    WHEN has AND ctx <> 'unknown' THEN coalesce(gold, ctx) WHEN mapped IS NOT NULL THEN coalesce(gold, mapped) WHEN gold IS NOT NULL THEN gold ELSE 'unknown' END AS relation FROM t""")
def relation_normalize(spark, d):
    k = F.col("p_partkey")
    pick = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), (k % n).cast("int"))
    label = pick(6, " Treats ", "LABEL_1", "related to", "unknown", "Interacts-With", "LABEL_3")
    out = N.normalize(label, pick(5, "causes", "treats", None, "related_to", "unknown"), pick(3, "causes", "unknown", "treats"), F.when(k % 7 < 3, "prevents"), k % 2 == 0)
    return W.table(spark, d, "part").select(k.alias("id"), out.alias("relation"))


@query(f"WITH {PF} SELECT id, coalesce({_case('id', _BY_PARSE)}, {_case('id', _BY_CUE)}) AS gold FROM pf")
def gold_relation(spark, d):
    f = F.col("fact")
    return facts(spark, d).select("id", F.coalesce(R.parse_fact(f)["r"], R.cue_relation(R.cue(f))).alias("gold"))


@query(f"WITH {LI} SELECT upper(r) AS label, {_case('set_id', _BY_CUE)} AS gold, count(*) AS n, sum(seq)::BIGINT AS total FROM li GROUP BY ALL")
def train_pairs(spark, d):
    golds = W.table(spark, d, "part").select(F.col("p_partkey").alias("set_id"), _digit("p_partkey", _BY_CUE).alias("gold"))
    return N.train_pairs(W.lineitem(spark, d), golds).groupBy("label", "gold").agg(F.count("*").alias("n"), F.sum("seq").alias("total"))


@query("""WITH n AS (SELECT source AS label, lang AS relation, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL)
  SELECT label, relation, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, first_id) AS k FROM n) WHERE k = 1""")
def majority_relation(spark, d):
    return N.majority_relation(W.labels(spark, d).select("label", F.col("gold").alias("relation"), "seq"))


@query(f"""WITH n AS (SELECT label AS cluster, {_case('vec_id', _BY_CUE)} AS relation, count(*) AS k FROM embeddings WHERE vec_id % 10 IN (0, 1) OR vec_id % 7 = 0 GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY k DESC, relation) AS at_ FROM n),
  t AS (SELECT cluster, sum(k)::BIGINT AS n, count(*) AS relations, coalesce(max(k) FILTER (at_ = 2), 0) AS second FROM o GROUP BY cluster)
  SELECT cluster, n, relations, second, n >= 4 AND relations >= 2 AND second >= greatest(2, n // 5) AS split FROM t""")
def cluster_impurity(spark, d):
    e = W.table(spark, d, "embeddings").where("vec_id % 10 in (0, 1) or vec_id % 7 = 0")
    return N.impure(e.select(F.col("label").alias("cluster"), _digit("vec_id", _BY_CUE).alias("relation")))


@query("SELECT vec_id, label * 3 + 2 AS cluster, dense_rank() OVER (ORDER BY label) - 1 AS cluster_id FROM embeddings")
def cluster_renumber(spark, d):
    e = W.table(spark, d, "embeddings").select("vec_id", (F.col("label") * 3 + 2).alias("cluster"))
    return N.renumber(e).select("vec_id", "cluster", "cluster_id")


@query(f"""WITH {LI}, n AS (SELECT set_id, r AS label, count(*) AS n FROM li GROUP BY ALL)
  SELECT n.set_id, label, n, p_size AS cluster, {_case('p_partkey', _BY_CUE)} AS relation FROM n LEFT JOIN part ON p_partkey = n.set_id AND p_partkey % 3 = 0""")
def cluster_trace(spark, d):
    p = W.table(spark, d, "part").where("p_partkey % 3 = 0")
    clusters = p.select(F.col("p_partkey").alias("set_id"), F.col("p_size").alias("cluster"), _digit("p_partkey", _BY_CUE).alias("relation"))
    return N.trace(W.lineitem(spark, d).select("set_id", F.col("r").alias("label")), clusters)


@query()
def relation_kmeans(spark, d):
    return N.kmeans(W.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@query()
def relation_refine(spark, d):
    e = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster"), _digit("vec_id", _BY_CUE).alias("relation"), "embedding")
    return N.refine(e).select("id", "cluster")


_TYPES = ("Chemical", "Disease", "SpecificDisease", "drug", "", "Disorder", "chem", "dis", "Gene", "  disease ")
_BUCKETS = ("chemical", "disease", "disease", "chemical", "other", "disease", "chemical", "disease", "other", "disease")
_HEADS = ("CID", "NR", "LABEL_1", "LABEL_7", "Treats-It", "no relation", "true", "", "Used To", "NOT_X")
_HEADED = ("causes", None, "causes", None, "treats_it", None, "causes", None, "used_to", None)


@query(f"""WITH t AS (SELECT p_partkey AS id, trim(p_name) AS a, p_brand AS b, {_case('p_partkey', _HEADED)} AS r, {_case('p_size', _BUCKETS)} AS h, {_case('(p_size // 10)', _BUCKETS)} AS t FROM part)
  SELECT id, CASE WHEN r = 'causes' AND h = 'disease' AND t = 'chemical' THEN b ELSE a END AS s, r, CASE WHEN r = 'causes' AND h = 'disease' AND t = 'chemical' THEN a ELSE b END AS o FROM t WHERE r IS NOT NULL""")
def oriented_rows(spark, d):
    p = W.table(spark, d, "part").withColumn("tens", F.floor(F.col("p_size") / 10))
    rows = p.select(F.col("p_partkey").alias("id"), F.lit(0).alias("pos"), F.concat(F.lit("  "), "p_name").alias("s"), _digit("p_partkey", _HEADS).alias("r"), "p_brand", _digit("p_size", _TYPES).alias("head_type"), _digit("tens", _TYPES).alias("tail_type"))
    return X.oriented(rows.withColumnRenamed("p_brand", "o")).select("id", "s", "r", "o")


_MADE = ("metabolized_by", "treats", "interacts_with", "increases", "causes", "causes", "reduces", "prevents", "causes", "causes")
MADE = f"""{PF}, m AS (SELECT id, {_case('id', _MADE)} AS r, CASE WHEN id % 10 IN (0, 2, 3, 6, 7) THEN p_name ELSE split_part(fact, ' ', 1) END AS s,
  CASE WHEN id % 10 IN (0, 2, 6, 7) THEN p_brand WHEN id % 10 = 3 THEN 'the risk of ' || p_brand ELSE rtrim(fact[strpos(fact, ' ') + 1:], '.') END AS o FROM pf)"""


@query(f"WITH {MADE} SELECT id, s, r, o FROM m")
def made_facts(spark, d):
    f = facts(spark, d).select("id", R.made_ends(F.col("fact")).alias("e"), R.made_relation(F.col("fact")).alias("r"))
    return f.select("id", "e.s", "r", "e.o")


@query(f"""WITH {MADE} SELECT id, 0::BIGINT AS pos, 'What does ' || s || ' ' || replace(r, '_', ' ') || '?' AS question, s AS subject, r AS relation, '?' AS object, o AS answer FROM m UNION ALL
  SELECT id, 1, CASE WHEN r = 'treats' THEN 'What treats ' || o || '?' ELSE 'What is linked to ' || o || ' via ' || replace(r, '_', ' ') || '?' END, '?', r, o, s FROM m""")
def made_questions(spark, d):
    m = made_facts(spark, d)
    q = m.select("id", F.posexplode(R.made_questions(F.col("s"), F.col("r"), F.col("o"))).alias("pos", "q"))
    return q.select("id", F.col("pos").cast("long").alias("pos"), "q.*")


@query("""SELECT p_size % 4 AS kind, count(*) AS n, count(*) FILTER (p_size % 4 IN (0, 3)) AS bad FROM part GROUP BY ALL""")
def placeholder_guard(spark, d):
    text = F.get(F.array(*[F.concat(F.lit(a), "p_partkey", F.lit(b)) for a, b in (("Drug", " x"), ("drug", ""), ("SomeDrug", "."), ("on Condition", ","))]), F.col("p_size") % 4)
    return W.table(spark, d, "part").groupBy((F.col("p_size") % 4).alias("kind")).agg(F.count("*").alias("n"), F.count_if(T.has_placeholder(text)).alias("bad"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'Disease' WHEN 1 THEN 'OTHER' WHEN 2 THEN 'Chemical' ELSE 'ABCDEFGHIJABCDEFGHIJABCDEFGHIJ' END AS kind FROM part""")
def tag_types(spark, d):
    tag = F.get(F.array(F.lit("T047,T191"), F.lit("T999"), F.lit(" Chemical"), F.lit("ABCDEFGHIJABCDEFGHIJABCDEFGHIJKLM")), F.col("p_size") % 4)
    return W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.tag_type(tag, {"T047": "Disease", "T109": "Chemical"}).alias("kind"))


@query(f"""WITH {PE}, t AS (SELECT a.id, a.p_name = b.p_name AS same, {_COSINE.format(a='a.embedding', b='b.embedding')} AS c FROM pe a JOIN pe b ON b.id = a.id + 1)
  SELECT id, round(c, 6) AS cosine, same OR c >= CAST(0.2 AS DOUBLE) AS equal FROM t""")
def semantic_equal(spark, d):
    a = fact_vectors(spark, d).select("id", "p_name", "embedding")
    b = a.select((F.col("id") - 1).alias("id"), F.upper("p_name").alias("q_name"), F.col("embedding").alias("e"))
    c = V.cosine(F.col("embedding"), F.col("e"))
    return a.join(b, "id").select("id", F.round(c, 6).alias("cosine"), T.semantic_equal(F.col("p_name"), F.col("q_name"), c, 0.2).alias("equal"))


# ---- engine


@query(f"""WITH {LI}, ev AS (SELECT * FROM li), ed AS (SELECT set_id, s, r, o, min(seq) AS first_seq, arg_min(polarity, seq) AS polarity, arg_min(source, seq) AS first_source FROM li GROUP BY ALL),
  pr AS (SELECT a.set_id, a.s, a.r AS r1, a.o AS o1, b.r AS r2, b.o AS o2, b.first_seq AS seq, b.first_source AS new,
    CASE WHEN a.r = b.r THEN 'object_disagreement_same_subject_relation' WHEN a.polarity <> b.polarity THEN 'polarity_clash'
      WHEN (a.r = 'causes' AND b.r IN ('treats', 'prevents')) OR (b.r = 'causes' AND a.r IN ('treats', 'prevents')) THEN 'semantic_polarity_clash' ELSE 'multi_relation_mismatch' END AS conflict_type
    FROM ed a JOIN ed b ON a.set_id = b.set_id AND a.s = b.s AND a.first_seq < b.first_seq AND ((a.o = b.o AND a.r <> b.r) OR (a.r = b.r AND a.o <> b.o))),
  so AS (SELECT pr.*, list_sort(list_distinct(list_append(list(li.source), any_value(new)))) AS src FROM pr JOIN li ON li.set_id = pr.set_id AND li.s = pr.s AND li.r = pr.r1 AND li.o = pr.o1 AND li.seq < pr.seq GROUP BY ALL),
  cl AS (SELECT li.set_id, li.s, li.r, li.o, li.seq FROM li JOIN ed USING (set_id, s, r, o) WHERE li.seq > ed.first_seq AND li.polarity <> ed.polarity),
  cs AS (SELECT cl.*, list_sort(list_distinct(list(li.source))) AS src FROM cl JOIN li ON li.set_id = cl.set_id AND li.s = cl.s AND li.r = cl.r AND li.o = cl.o AND li.seq <= cl.seq GROUP BY ALL),
  al AS (SELECT set_id, s, r1 AS r, o1 AS o, conflict_type, r2 AS peer_relation, o2 AS peer_object, seq, src FROM so UNION ALL
    SELECT set_id, s, r2, o2, conflict_type, r1, o1, seq, src FROM so UNION ALL SELECT set_id, s, r, o, 'polarity_merge_clash', r, o, seq, src FROM cs)
  SELECT set_id, s, r, o, conflict_type, peer_relation, peer_object, seq, array_to_string(src, ',') AS sources FROM al""")
def conflict_records(spark, d):
    return E.conflict_records(W.lineitem(spark, d)).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {EDGES}, {CLASH.format(ev='li')}, st AS ({STATUS}) SELECT st.set_id, st.s, st.r, st.o, ed.first_seq, status FROM st JOIN ed USING (set_id, s, r, o) WHERE status <> 'uncertain'")
def export_state(spark, d):
    return E.exported(E.by_status(E.with_status(W.lineitem(spark, d)), False)).select("set_id", "s", "r", "o", "first_seq", "status")


@query(f"""WITH {TV}, ed AS (SELECT set_id, note, s, r, o, min(seq) AS first_seq FROM tv GROUP BY ALL)
  SELECT set_id, note, s, r, o, first_seq, CASE WHEN count(*) OVER (PARTITION BY set_id, note, s, o) > 1 OR count(*) OVER (PARTITION BY set_id, note, s, r) > 1 THEN 'uncertain' WHEN r = 'related_to' THEN 'weak' ELSE 'active' END AS status FROM ed""")
def one_shot(spark, d):
    return E.one_shot(W.event_evidence(spark, d)).drop("polarity")


@query(f"""WITH {EDGES}, {CLASH.format(ev='li')}, st AS ({STATUS})
  SELECT s, o, array_to_string(list_sort(list(DISTINCT r)), ',') AS relations, CASE WHEN bool_or(status = 'uncertain') THEN 'uncertain' WHEN bool_or(status = 'weak') THEN 'weak' ELSE 'active' END AS status, count(*) AS n FROM st GROUP BY s, o""")
def display_edges(spark, d):
    return E.display_edges(E.with_status(W.lineitem(spark, d)))


@query(f"""WITH {TV}, n AS (SELECT DISTINCT set_id, note FROM tv), o AS (SELECT set_id, run, note, row_number() OVER (PARTITION BY set_id, run ORDER BY md5('42:' || run || ':' || set_id || ':' || note), note) - 1 AS step FROM n CROSS JOIN range(10) t(run)),
  g AS (SELECT set_id, note, list(DISTINCT s || '|' || r || '|' || o) AS g FROM tv GROUP BY ALL),
  c AS (SELECT set_id, note, sum(k * (k - 1) / 2)::BIGINT AS conflicts FROM (SELECT set_id, note, s, o, count(DISTINCT r) AS k FROM tv GROUP BY ALL) GROUP BY ALL),
  a AS (SELECT o.set_id, o.run, o.step, g.g, lag(g.g) OVER (PARTITION BY o.set_id, o.run ORDER BY o.step) AS h, conflicts FROM o JOIN g USING (set_id, note) JOIN c USING (set_id, note))
  SELECT set_id, run::INTEGER AS run, step::INTEGER AS step, (len(g) + len(h) - 2 * len(list_intersect(g, h)))::BIGINT AS ged, round(CAST(len(list_intersect(g, h)) AS DOUBLE) / (len(g) + len(h) - len(list_intersect(g, h))), 6) AS jaccard, conflicts FROM a""")
def incremental_simulation(spark, d):
    return S.simulate(W.events(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


GRAPHS_ALL = "g AS (SELECT set_id, note, coalesce(list(DISTINCT s || '|' || r || '|' || o) FILTER (r <> 'related_to'), []) AS g FROM tv GROUP BY ALL)"
PAIRS_ALL = f"{TV}, {GRAPHS_ALL}, p AS (SELECT a.set_id, a.note AS i, b.note AS j, {MEASURE} FROM g a JOIN g b ON a.set_id = b.set_id AND a.note < b.note)"


@query(f"""WITH {PAIRS_ALL}, s AS (SELECT DISTINCT set_id FROM tv), t AS (SELECT set_id, count(*) AS n, sum(ged) AS ged, sum(jaccard) AS jaccard FROM p GROUP BY set_id)
  SELECT set_id, coalesce(n, 1) AS n, round(coalesce(ged, 0)::DOUBLE, 6) AS ged, round(coalesce(jaccard, 1), 6) AS jaccard FROM s LEFT JOIN t USING (set_id)""")
def stability_lists(spark, d):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias(c)
    return S.pairwise(W.events(spark, d)).select("set_id", F.size("ged").cast("long").alias("n"), total("ged"), total("jaccard"))


MATRIX = f"""{PAIRS_ALL}, m AS (SELECT set_id, max(len(g)) AS most FROM g GROUP BY set_id), c AS (SELECT p.set_id, i, j, CASE WHEN most > 0 THEN ged::DOUBLE END AS ged, CASE WHEN most > 0 THEN jaccard END AS jaccard FROM p JOIN m USING (set_id)),
  cells AS (SELECT * FROM c UNION ALL SELECT set_id, j, i, ged, jaccard FROM c UNION ALL SELECT set_id, note, note, 0, 1 FROM g)"""


@query(f"WITH {MATRIX} SELECT set_id, i, j, ged, round(jaccard, 6) AS jaccard FROM cells")
def note_matrix(spark, d):
    return S.matrix(W.events(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {MATRIX} SELECT set_id, i AS note, round(avg(ged), 6) AS mean_ged, round(avg(jaccard), 6) AS mean_jaccard FROM cells WHERE i <> j GROUP BY ALL")
def note_against_others(spark, d):
    return S.against_others(S.matrix(W.events(spark, d))).select("set_id", "note", *_r("mean_ged", "mean_jaccard"))


@query(f"""WITH {LI}, t AS (SELECT DISTINCT set_id, s, r, o FROM li), c AS (SELECT a.r AS r1 FROM t a JOIN t b ON a.set_id = b.set_id AND a.s = b.s AND a.o = b.o AND a.r < b.r)
  SELECT round(coalesce(avg(CASE WHEN r1 = 'causes' THEN 1.0 ELSE 0.0 END), 1), 6) AS genuine, CAST(1 AS DOUBLE) AS every, CAST(1 AS DOUBLE) AS none FROM c""")
def conflict_precision(spark, d):
    c = E.heuristic_conflicts(W.lineitem(spark, d))
    one = lambda df, name, test=None: df.agg(F.round(S.conflict_precision(df, test), 6).alias(name))
    return one(c, "genuine", F.col("r1") == "causes").join(one(c, "every")).join(one(c.where("r1 = 'nothing'"), "none"))


_T = "sqrt(n) * m / sd"
_SIMPSON = "list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos({top} / 2000 * i), 0), n - 2))) * ({top} / 2000 / 3)"


@query(f"""WITH t AS (SELECT p_brand AS metric, count(*) AS n, avg(p_retailprice - 40 * p_size) AS m, stddev_samp(p_retailprice - 40 * p_size) AS sd FROM part GROUP BY ALL), u AS (SELECT *, {_T} AS t FROM t WHERE sd > 0)
  SELECT metric, n, round(u.t, 6) AS t, round(1 - ({_SIMPSON.format(top='atan(abs(u.t) / sqrt(n - 1))')}) / ({_SIMPSON.format(top='1.5707963267948966::DOUBLE')}), 6) AS p FROM u
  UNION ALL SELECT metric, n, NULL, NULL FROM t WHERE sd IS NULL OR sd = 0""")
def paired_t(spark, d):
    p = W.table(spark, d, "part").select(F.col("p_brand").alias("metric"), F.col("p_retailprice").alias("a"), (40.0 * F.col("p_size")).alias("b"))
    return S.paired_t(p).select("metric", "n", *_r("t", "p"))


@query(f"WITH {TV} SELECT DISTINCT set_id, lower(s) AS s, trim(r) AS r, lower(o) AS o FROM tv")
def triple_set(spark, d):
    t = W.events(spark, d).select("set_id", F.concat(F.lit(" "), F.upper("s")).alias("s"), F.concat("r", F.lit(" ")).alias("r"), "o")
    return S.as_set(t, T.qa_entity(F.col("s")), T.qa_entity(F.col("o")))


# ---- questions

ASKED = """ql AS (SELECT p_partkey AS q_id, 'p' || p_partkey AS s, '?' AS o, 's' || (p_partkey % 10 + 1) AS answer FROM part
    UNION ALL SELECT -s_suppkey, '?', 's' || s_suppkey, 'p1' FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT -1000000 - s_suppkey, '?', '?', 'x' FROM supplier WHERE s_suppkey < 5),
  al(r) AS (VALUES ('causes'), ('causes'), ('treats')), gr AS (SELECT s, r, o, count(*) AS n FROM li GROUP BY ALL),
  ca AS (SELECT q_id, gr.o AS answer, n FROM ql CROSS JOIN al JOIN gr ON ql.o = '?' AND ql.s <> '?' AND gr.s = ql.s AND gr.r = al.r
    UNION ALL SELECT q_id, gr.s, n FROM ql CROSS JOIN al JOIN gr ON ql.s = '?' AND ql.o <> '?' AND gr.o = ql.o AND gr.r = al.r),
  su AS (SELECT q_id, answer, sum(n) AS n FROM ca GROUP BY ALL), rk AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, lower(answer), answer) AS rank, answer FROM su),
  ve AS (SELECT 's' || vec_id AS surface, embedding FROM embeddings WHERE vec_id % 3 > 0),
  si AS (SELECT rk.q_id, rank, CASE WHEN lower(rk.answer) = lower(ql.answer) THEN 1 WHEN a.surface IS NULL OR b.surface IS NULL THEN 0 ELSE """ + _COSINE.format(a="a.embedding", b="b.embedding") + """ END AS c
    FROM rk JOIN ql USING (q_id) LEFT JOIN ve a ON a.surface = rk.answer LEFT JOIN ve b ON b.surface = ql.answer),
  ag AS (SELECT q_id, count(*) AS n, max(c) AS best, max(c) FILTER (rank = 1) AS first_c, min(rank) FILTER (c >= CAST(0.4 AS DOUBLE)) AS at_ FROM si GROUP BY q_id),
  sc AS (SELECT q_id, (s = '?') <> (o = '?') AS ok, coalesce(n, 0) AS n, coalesce(best, 0)::DOUBLE AS best, coalesce(first_c, 0) AS first_c, at_, s, o, answer FROM ql LEFT JOIN ag USING (q_id))"""


def _asked(spark, d):
    rel = F.array(F.lit("causes"), F.lit("Causes"), F.lit("treats"))
    k, n = F.col("p_partkey"), F.col("s_suppkey")
    p = W.table(spark, d, "part").select(k.alias("q_id"), F.concat(F.lit("p"), k).alias("s"), rel.alias("relations"), F.lit("?").alias("o"), F.concat(F.lit("s"), k % 10 + 1).alias("answer"))
    sup = W.table(spark, d, "supplier")
    s = sup.where("s_suppkey > 0").select((-n).alias("q_id"), F.lit("?").alias("s"), rel.alias("relations"), F.concat(F.lit("s"), n).alias("o"), F.lit("p1").alias("answer"))
    bad = sup.where("s_suppkey < 5").select((-1000000 - n).alias("q_id"), F.lit("?").alias("s"), rel.alias("relations"), F.lit("?").alias("o"), F.lit("x").alias("answer"))
    return p.unionAll(s).unionAll(bad)


def _qa_rows(spark, d):
    q = _asked(spark, d)
    v = W.table(spark, d, "embeddings").where("vec_id % 3 > 0").select(F.concat(F.lit("s"), "vec_id").alias("surface"), "embedding")
    graph = W.lineitem(spark, d)
    n = Q.pieces(graph)
    return q, Q.scored(Q.ranked_lookup(graph, q, n), q, v, 0.2, 0.4, n)


@query(f"""WITH {LI}, {ASKED} SELECT q_id, CASE WHEN NOT ok THEN 'exactly one of subject and object must be ?' END AS error, CASE WHEN ok THEN n END AS n_candidates, CASE WHEN ok THEN round(best, 6) END AS best,
  CASE WHEN ok THEN best >= CAST(0.4 AS DOUBLE) END AS exact, CASE WHEN ok THEN best >= CAST(0.2 AS DOUBLE) END AS hit, CASE WHEN ok THEN first_c >= CAST(0.4 AS DOUBLE) END AS top1, CASE WHEN ok THEN round(coalesce(1.0::DOUBLE / at_, 0), 6) END AS rr FROM sc""")
def qa_scored(spark, d):
    return _qa_rows(spark, d)[1].withColumn("best", F.round("best", 6)).withColumn("rr", F.round("rr", 6))


@query(f"""WITH {LI}, {ASKED} SELECT count(*) AS n, round(avg((best >= CAST(0.4 AS DOUBLE))::INT), 6) AS exact, round(avg((best >= CAST(0.2 AS DOUBLE))::INT), 6) AS hit, round(avg((first_c >= CAST(0.4 AS DOUBLE))::INT), 6) AS top1, round(avg(coalesce(1.0::DOUBLE / at_, 0)), 6) AS mrr FROM sc WHERE ok""")
def qa_summary(spark, d):
    return Q.summary(_qa_rows(spark, d)[1]).select("n", *_r("exact", "hit", "top1", "mrr"))


@query(f"WITH {LI}, {ASKED} SELECT q_id, CASE WHEN s = '?' THEN answer ELSE s END AS s, 'causes' AS r, CASE WHEN o = '?' THEN answer ELSE o END AS o FROM sc WHERE ok AND best < CAST(0.2 AS DOUBLE) ORDER BY q_id LIMIT 10")
def qa_misses(spark, d):
    q, rows = _qa_rows(spark, d)
    return Q.misses(rows, q)


@query("""WITH ln AS (SELECT p_partkey AS line_id, lower(p_name || ' ' || p_brand || ' ' || p_type) AS t FROM part),
  q AS (SELECT s_suppkey AS q_id, list_filter(['which part is like ' || lower(s_name) || '?', 'rand#' || (s_suppkey % 25 + 1), '?', CASE WHEN s_suppkey % 2 = 0 THEN 'economy' ELSE 'wid' END, 'is'], lambda x: x <> '?') AS an FROM supplier),
  sc AS (SELECT q_id, line_id, len(list_intersect(list_distinct(regexp_extract_all(array_to_string(an, ' '), '[a-z0-9]+')), list_distinct(regexp_extract_all(t, '[a-z0-9]+'))))
    + 4 * len(list_filter(an, lambda x: len(x) > 2 AND contains(t, x))) AS score FROM q CROSS JOIN ln),
  r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, line_id) AS rank FROM sc WHERE score > 0)
  SELECT q_id, line_id, score, rank FROM r WHERE rank <= 100""")
def retrieval_topk(spark, d):
    p = W.table(spark, d, "part").select(F.col("p_partkey").alias("line_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    k = F.col("s_suppkey")
    anchors = F.array(F.concat(F.lit("Which part is like "), "s_name", F.lit("?")), F.concat(F.lit("rand#"), k % 25 + 1), F.lit("?"), F.when(k % 2 == 0, "ECONOMY").otherwise(" wid "), F.lit("is"))
    return Q.retrieve(W.table(spark, d, "supplier").select(k.alias("q_id"), anchors.alias("anchors")), p)


@query(f"""WITH {LI}, e AS (SELECT DISTINCT s, r, o FROM li WHERE polarity = 'positive'), a AS (SELECT DISTINCT s, r, o FROM li WHERE confidence >= CAST(0.95 AS DOUBLE)), u AS (FROM e UNION FROM a)
  SELECT 'engine' AS policy, count(*) AS n, min(s || r || o) AS least, max(s || r || o) AS most FROM e UNION ALL SELECT 'aligned_union', count(*), min(s || r || o), max(s || r || o) FROM a
  UNION ALL SELECT 'union', count(*), min(s || r || o), max(s || r || o) FROM u UNION ALL SELECT 'other', count(*), min(s || r || o), max(s || r || o) FROM u""")
def qa_graph_policies(spark, d):
    ev = W.lineitem(spark, d)
    e, a, key = ev.where("polarity = 'positive'"), ev.where("confidence >= 0.95"), F.concat("s", "r", "o")
    out = [Q.qa_graph(e, a, p).agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("most")).select(F.lit(p).alias("policy"), "n", "least", "most") for p in ("engine", "aligned_union", "union", "other")]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@query(f"""WITH {PF}, p AS (SELECT id, p_name AS s, {_case('id', _BY_PARSE)} AS r, p_brand AS o FROM pf WHERE id % 10 IN (0, 1, 2, 3, 4, 6, 7)),
  q AS (SELECT id * 2 AS q_id, CASE r WHEN 'metabolized_by' THEN 'Which organ metabolizes ' || s || '?' WHEN 'treats' THEN 'What does ' || s || ' treat?' WHEN 'interacts_with' THEN 'What does ' || s || ' interact with?'
      WHEN 'increases' THEN 'What does ' || s || ' increase?' WHEN 'causes' THEN 'What does ' || s || ' cause?' WHEN 'reduces' THEN 'What does ' || s || ' reduce?' ELSE 'What does ' || s || ' prevent?' END AS question, s, r, '?' AS o, o AS answer FROM p
    UNION ALL SELECT id * 2 + 1, CASE r WHEN 'metabolized_by' THEN 'What drug is metabolized by the ' || o || '?' WHEN 'treats' THEN 'What drug treats ' || o || '?' WHEN 'interacts_with' THEN 'What interacts with ' || o || '?'
      WHEN 'increases' THEN 'What increases ' || o || '?' WHEN 'causes' THEN 'What causes ' || o || '?' WHEN 'reduces' THEN 'What reduces ' || o || '?' ELSE 'What prevents ' || o || '?' END, '?', r, o, s FROM p)
  SELECT q_id, question, s, r || CASE r WHEN 'treats' THEN ',LABEL_0,LABEL_4' WHEN 'causes' THEN ',LABEL_3' ELSE '' END AS relations, o, answer FROM q ORDER BY q_id LIMIT 50""")
def qa_generation(spark, d):
    named = spark.createDataFrame([("LABEL_4", "treats"), ("LABEL_3", "causes"), ("LABEL_0", "treats")], "key string, relation string")
    q = Q.aligned_questions(facts(spark, d).select(F.col("id").alias("set_id"), "fact"), named, 50)
    return q.withColumn("relations", F.array_join("relations", ","))


# ---- resolution


@query()
def registry_full(spark, d):
    p = fact_vectors(spark, d).select((F.col("id") % 4).alias("set_id"), F.col("id").alias("seq"), F.col("p_name").alias("entity"), T.normalize_surface(F.col("p_name")).alias("surface"), "embedding")
    return C.registry(p.withColumn("head", T.headword(F.col("surface"))), 0.3, 0.1, True, (0.1, 0.3)).select("set_id", "seq", "representative", "reason")


_SURFACES = "[p_name, upper(p_brand), lower(p_name), p_brand, 'the ' || lower(p_name), p_type]"
SURFACES = """sf AS (SELECT p_partkey AS seq, unnest([{'c': 'the ' || lower(p_name), 's': p_name}, {'c': 'the ' || lower(p_name), 's': lower(p_name)}, {'c': 'the ' || lower(p_name), 's': 'the ' || lower(p_name)},
  {'c': p_type, 's': upper(p_brand)}, {'c': p_type, 's': p_brand}, {'c': p_type, 's': p_type}]) AS x FROM part)"""


def _aligned(spark, d):
    p = W.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("the "), F.lower("p_name")).alias("s"), F.col("p_type").alias("o"), F.concat(F.lit(" "), "p_name").alias("raw_s"), F.upper("p_brand").alias("raw_o"),
        F.lower("p_name").alias("pre_s"), F.col("p_brand").alias("pre_o"),
    )


@query(f"WITH {SURFACES} SELECT x.c AS canonical, x.s AS surface, count(*) AS n, max(seq) AS last FROM sf GROUP BY ALL")
def recorded_surfaces(spark, d):
    return C.record_surfaces(_aligned(spark, d)).groupBy("canonical", "surface").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query(f"WITH {SURFACES} SELECT DISTINCT x.c AS canonical, x.s AS surface FROM sf UNION SELECT x.c, lower(x.s) FROM sf")
def alias_table(spark, d):
    return C.alias_registry(_aligned(spark, d))


_NAMED = "SELECT p_size AS cluster, p_name AS name FROM part GROUP BY ALL"


@query(f"WITH m AS ({_NAMED}) SELECT cluster, name, first_value(name) OVER (PARTITION BY cluster ORDER BY length(name), lower(name), name) AS short, first_value(name) OVER (PARTITION BY cluster ORDER BY length(name) DESC, name DESC) AS long FROM m")
def cluster_names(spark, d):
    m = W.table(spark, d, "part").select(F.col("p_size").alias("cluster"), F.col("p_name").alias("name")).distinct()
    short = C.named_clusters(m).withColumnRenamed("representative", "short")
    return short.join(C.named_clusters(m, True).withColumnRenamed("representative", "long"), ["cluster", "name"])


@query(f"""WITH m AS (SELECT name, min(rep) AS rep FROM (SELECT name, first_value(name) OVER (PARTITION BY cluster ORDER BY length(name), lower(name), name) AS rep FROM ({_NAMED}) WHERE cluster % 2 = 0) GROUP BY name),
  t AS (SELECT p_size % 5 AS set_id, coalesce(m.rep, p_name) AS s, {_case('p_partkey', _BY_CUE)} AS r, p_brand AS o FROM part LEFT JOIN m ON m.name = p_name),
  n AS (SELECT set_id, s, r, o, count(*) AS n FROM t GROUP BY ALL)
  SELECT set_id, s, r, o, n, removed FROM (SELECT *, count(*) OVER (PARTITION BY set_id, s, r) - 1 AS removed, row_number() OVER (PARTITION BY set_id, s, r ORDER BY n DESC, length(o), lower(o), o) AS k FROM n) WHERE k = 1""")
def cluster_remap_dedupe(spark, d):
    p = W.table(spark, d, "part")
    m = C.named_clusters(p.where("p_size % 2 = 0").select(F.col("p_size").alias("cluster"), F.col("p_name").alias("name")).distinct())
    m = m.groupBy("name").agg(F.min("representative").alias("representative"))
    t = p.select((F.col("p_size") % 5).alias("set_id"), F.concat("p_name", F.lit(" ")).alias("s"), _digit("p_partkey", _BY_CUE).alias("r"), F.col("p_brand").alias("o"))
    return E.dedupe_objects(C.remap(t, m))


@query(f"WITH {TV} SELECT trim(o) AS x, min(seq) AS seq FROM tv WHERE o IS NOT NULL AND trim(o) <> '' GROUP BY 1")
def unique_strings(spark, d):
    return C.unique_strings(W.events(spark, d).select(F.concat(F.lit("  "), "o").alias("x"), "seq"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size / 50.0::DOUBLE - (p_partkey % 9) / 9.0::DOUBLE > CAST(0.02 AS DOUBLE) THEN true WHEN p_size / 50.0::DOUBLE - (p_partkey % 9) / 9.0::DOUBLE < CAST(-0.02 AS DOUBLE) THEN false
  ELSE p_size % 3 > p_partkey % 3 END AS turned FROM part""")
def seed_direction(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    return W.table(spark, d, "part").select(k.alias("id"), A.seed_directed((k % 9) / 9.0, n / 50.0, (k % 3).cast("int"), (n % 3).cast("int")).alias("turned"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'C0004057' WHEN 1 THEN coalesce(CASE WHEN p_size % 2 = 0 THEN 'fuzzy' END, p_name) WHEN 2 THEN 'other ' || p_name ELSE coalesce(CASE WHEN p_size % 2 = 0 THEN 'fuzzy' END, p_name) END AS term FROM part""")
def mapper_accept(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    mapped = F.get(F.array(F.lit("C0004057"), F.upper("p_name"), F.concat(F.lit("other "), "p_name"), F.lit(None)), (k % 4).cast("int"))
    return W.table(spark, d, "part").select(k.alias("id"), A.accepted(name, mapped, F.when(F.col("p_size") % 2 == 0, "fuzzy")).alias("term"))


@query(f"WITH {TV}, n AS (SELECT DISTINCT set_id, o FROM tv WHERE o IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY o) AS k FROM n) SELECT set_id, string_agg(o, ',' ORDER BY o) AS peers FROM k WHERE k <= 5 GROUP BY set_id")
def peer_sample(spark, d):
    t = W.events(spark, d).select("set_id", F.col("o").alias("node")).where("node is not null")
    return A.peers(t, 5).withColumn("peers", F.array_join("peers", ","))


@query("""WITH RECURSIVE c AS (SELECT doc_id, string_split_regex(text, '[.!?]\\s+|\\n+') AS p, text FROM documents WHERE text IS NOT NULL),
  k AS (SELECT doc_id, count(*) FILTER (trim(x, E' \\t\\n\\r') <> '') AS n FROM (SELECT doc_id, unnest(p) AS x FROM c) GROUP BY doc_id)
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_sentences FROM k WHERE n > 0""")
def sentence_count(spark, d):
    s = C.sentence_spans(W.table(spark, d, "documents").select("doc_id", "text"))
    return s.agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_sentences"))


@query(f"""WITH {oracle.SENTENCES.format(least=10)}, e AS (SELECT doc_id, pos, count(*) AS e FROM he GROUP BY doc_id, pos)
  SELECT count(*) AS n_sentences, count(e) AS n_with_entities, coalesce(sum(e), 0)::BIGINT AS n_entities, sum(s1 - s0)::BIGINT AS chars FROM se LEFT JOIN e ON e.doc_id = se.doc_id AND e.pos = se.pos""")
def sentence_statistics(spark, d):
    docs = W.table(spark, d, "documents").select("doc_id", "text")
    return C.sentence_statistics(C.sentence_spans(docs, 10), C.mentions_of(docs, " the "))


@query("""SELECT p_size % 5 AS kind, count(*) AS n, count(*) FILTER (p_size % 5 IN (0, 1, 3)) AS noise FROM part GROUP BY ALL""")
def display_noise(spark, d):
    name = F.get(F.array(F.lit("The Drug"), F.lit("Patients, old"), F.col("p_name"), F.lit(" x"), F.lit("impatient people")), F.col("p_size") % 5)
    return W.table(spark, d, "part").groupBy((F.col("p_size") % 5).alias("kind")).agg(F.count("*").alias("n"), F.count_if(T.display_noise(name)).alias("noise"))


@query("""WITH t AS (SELECT CASE p_size % 6 WHEN 0 THEN 'LABEL_' || p_size WHEN 1 THEN 'THE' WHEN 2 THEN p_name WHEN 3 THEN '<' || p_name WHEN 4 THEN repeat('x', 57) ELSE 'once ' || p_partkey END AS label FROM part)
  SELECT label, count(*) AS n FROM t GROUP BY label HAVING label SIMILAR TO 'LABEL_[0-9]+' OR (count(*) >= 2 AND NOT contains(label, '<') AND length(label) <= 56 AND label <> 'THE')""")
def plausible_labels(spark, d):
    label = F.get(F.array(F.concat(F.lit("LABEL_"), "p_size"), F.lit("THE"), F.col("p_name"), F.concat(F.lit("<"), "p_name"), F.lit("x" * 57), F.concat(F.lit("once "), "p_partkey")), F.col("p_size") % 6)
    n = W.table(spark, d, "part").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return n.where(L.plausible(F.col("label"), F.col("n")))


# ---- extractors


@query("""WITH g AS (SELECT DISTINCT p_size AS doc, p_partkey % 50 AS start, p_brand AS label FROM part), p AS (SELECT DISTINCT p_size AS doc, p_partkey % 50 AS start, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#1' ELSE p_brand END AS label FROM part WHERE p_partkey % 4 > 0),
  t AS (SELECT label, count(*) AS tp FROM g JOIN p USING (doc, start, label) GROUP BY label), n AS (SELECT label, count(*) AS n FROM g GROUP BY label), s AS (SELECT label, count(*) AS said FROM p GROUP BY label),
  j AS (SELECT label, coalesce(n, 0) AS n, CASE WHEN said > 0 THEN coalesce(tp, 0)::DOUBLE / said ELSE 0 END AS pr, CASE WHEN n > 0 THEN coalesce(tp, 0)::DOUBLE / n ELSE 0 END AS re FROM n FULL JOIN s USING (label) LEFT JOIN t USING (label))
  SELECT label, n, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM j""")
def span_report(spark, d):
    p = W.table(spark, d, "part").select(F.col("p_size").alias("doc"), (F.col("p_partkey") % 50).alias("start"), (F.col("p_partkey") % 50 + 5).alias("stop"), F.col("p_brand").alias("label"), "p_partkey")
    said = p.where("p_partkey % 4 > 0").withColumn("label", F.when(F.col("p_partkey") % 3 == 0, "Brand#1").otherwise(F.col("label")))
    return X.span_report(p, said).select("label", "n", *_r("precision", "recall", "f1"))


@query("""WITH t AS (SELECT p_brand AS g, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#1' ELSE p_brand END AS p FROM part), n AS (SELECT g AS label, count(*) AS n, count(*) FILTER (g = p) AS tp FROM t GROUP BY g), s AS (SELECT p AS label, count(*) AS said FROM t GROUP BY p),
  f AS (SELECT n, CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (n + coalesce(said, 0)) ELSE 0 END AS f1 FROM n LEFT JOIN s USING (label))
  SELECT (SELECT count(*) FROM t) AS n, (SELECT round(avg((g = p)::INT), 6) FROM t) AS accuracy, round(sum(f1 * n) / sum(n), 6) AS weighted_f1 FROM f""")
def relation_accuracy(spark, d):
    pairs = W.table(spark, d, "part").select(F.col("p_brand").alias("gold"), F.when(F.col("p_partkey") % 3 == 0, "Brand#1").otherwise(F.col("p_brand")).alias("predicted"))
    return X.accuracy(pairs).select("n", *_r("accuracy", "weighted_f1"))


@query("SELECT p_partkey AS doc, round(1 / (1 + exp(-(p_size - 25) / 10.0::DOUBLE)), 6) AS probability FROM part WHERE p_size >= 25 AND p_partkey % 10 IN (0, 2, 4, 6, 8)")
def scored_pairs(spark, d):
    rows = W.table(spark, d, "part").select(F.col("p_partkey").alias("doc"), ((F.col("p_size") - 25) / 10.0).alias("logit"), _digit("p_partkey", _HEADS).alias("label"))
    return X.scored_pairs(rows).select("doc", *_r("probability"))


@query("""SELECT p_partkey AS id, 'given' AS s, 'treats' AS r, p_brand AS o FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_name, 'causes', p_brand FROM part WHERE p_partkey % 3 = 1""")
def extractor_fallback(spark, d):
    p = W.table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    told = p.where("id % 3 = 0").select("id", F.lit("given").alias("s"), F.lit("treats").alias("r"), F.col("p_brand").alias("o"))
    end = lambda pos, c, kind, where: p.where(where).select("id", F.lit(pos).alias("pos"), F.col(c).alias("text"), F.lit(kind).alias("type"))
    e = end(0, "p_type", "Gene", "true").unionAll(end(1, "p_name", "Chemical", "true")).unionAll(end(3, "p_brand", "Disease", "id % 3 < 2")).unionAll(end(4, "p_type", "Disease", "id % 3 < 2"))
    return X.or_else(told, e)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'C' || length(p_name) ELSE p_name END AS s, 'treats' AS r, p_brand AS o FROM part LEFT JOIN (SELECT p_name AS n, max(p_size) AS z FROM part GROUP BY 1) ON false")
def mapped_ends(spark, d):
    p = W.table(spark, d, "part")
    even = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" e"))).otherwise(F.col("p_name"))
    mapper = p.where("p_size % 2 = 0").select(T.mapper_key(even).alias("key"), F.concat(F.lit("C"), F.length("p_name")).alias("cui")).distinct()
    return X.with_ids(p.select(F.col("p_partkey").alias("id"), even.alias("s"), F.lit("treats").alias("r"), F.col("p_brand").alias("o")), mapper)


# ---- cosine joins

ALL_PAIRS = f"cp AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COSINE.format(a='a.embedding', b='b.embedding')} AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


@query(f"WITH {ALL_PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM cp WHERE cosine >= CAST(0.3 AS DOUBLE)")
def cosine_join(spark, d):
    return M.cosine_pairs(W.table(spark, d, "embeddings"), 0.3).select("a", "b", *_r("cosine"))


@query(f"""WITH RECURSIVE {ALL_PAIRS}, e AS (SELECT a, b FROM cp WHERE cosine >= CAST(0.35 AS DOUBLE)), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT vec_id AS node, vec_id AS far FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.far)
  SELECT node AS vec_id, min(far) AS component FROM r GROUP BY node""")
def cosine_components(spark, d):
    return M.linked_components(W.table(spark, d, "embeddings"), 0.35).withColumnRenamed("id", "vec_id")


@query(f"""WITH RECURSIVE n AS (SELECT p_size AS set_id, p_name AS name, split_part(p_name, ' ', 1) AS surface, embedding, p_partkey AS id FROM part LEFT JOIN embeddings ON vec_id = p_partkey),
  lab AS (SELECT set_id, name, any_value(surface) AS surface, arg_min(embedding, id) AS embedding FROM n GROUP BY set_id, name),
  l AS (SELECT a.set_id, a.name AS a, b.name AS b FROM lab a JOIN lab b ON a.set_id = b.set_id AND (a.surface = b.surface OR {_COSINE.format(a='a.embedding', b='b.embedding')} >= CAST(0.25 AS DOUBLE))),
  r AS (SELECT set_id, name, name AS far FROM lab UNION SELECT r.set_id, r.name, l.b FROM r JOIN l ON l.set_id = r.set_id AND l.a = r.far),
  c AS (SELECT set_id, name, min(far) AS cluster FROM r GROUP BY set_id, name),
  f AS (SELECT set_id, min(name) AS s FROM lab GROUP BY set_id),
  g AS (SELECT c.set_id, c.cluster, bool_or(split_part(c.name, ' ', 1) = split_part(f.s, ' ', 1)) AS told, any_value(f.s) AS s, arg_max(c.name, (length(c.name), c.name)) AS longest FROM c JOIN f ON f.set_id = c.set_id GROUP BY c.set_id, c.cluster)
  SELECT c.set_id, c.name, c.cluster, CASE WHEN g.told THEN g.s ELSE g.longest END AS display FROM c JOIN g ON g.set_id = c.set_id AND g.cluster = c.cluster""")
def display_clusters(spark, d):
    """Names of parts in one size; a fact's subject is the size's first name, known by its first word alone."""
    n = W.table(spark, d, "part").join(W.table(spark, d, "embeddings"), F.col("vec_id") == F.col("p_partkey"), "left")
    first = F.split("p_name", " ")[0]
    lab = n.groupBy(F.col("p_size").alias("set_id"), F.col("p_name").alias("name")).agg(F.any_value(first).alias("surface"), F.min_by("embedding", "p_partkey").alias("embedding"))
    none = F.lit(None).cast("array<double>")
    f = lab.groupBy("set_id").agg(F.min("name").alias("s")).select("set_id", "s", F.split("s", " ")[0].alias("s_surface"), none.alias("s_embedding"), F.lit(None).cast("string").alias("o"), F.lit(None).cast("string").alias("o_surface"), none.alias("o_embedding"))
    return C.display_clusters(lab, f, 0.25)


# ---- the engine as a stream, and its similarity mode


@query(f"SELECT set_id, s, r, o, status FROM ({oracle.SQL['edge_status']})")
def stream_status(spark, d):
    """Status of every edge once the stream has read all of lineitem, batch after batch."""
    return Z.current_edges(spark, Z.replay(W.lineitem(spark, d))).select("set_id", "s", "r", "o", "status")


@query(f"SELECT set_id, source, added, merged, conflicts FROM ({oracle.SQL['update_log']})")
def stream_log(spark, d):
    """Counts of each source, summed over the batches in which it came."""
    table = Z.replay(W.event_evidence(spark, d))
    return Z.current_log(spark, table)


@query()
def similarity_fold(spark, d):
    """Lineitem's edges where suppliers with a cosine of 0.2 or more are one object: by order of arrival, so not in SQL."""
    v = W.table(spark, d, "embeddings").select(F.concat(F.lit("s"), "vec_id").alias("o"), F.col("embedding").alias("v"))
    return E.coalesced_edges(W.lineitem(spark, d).join(v, "o", "left"), 0.2)


# ---- documents as annotated blocks, written and read again by byte ranges


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\x00-\x20]+', ' ', 'g')) AS t FROM documents),
  w AS (SELECT doc_id, substr(t, 1, 40) || ' ' || substr(t, 41) AS text, regexp_extract_all(substr(t, 1, 400), '[A-Za-z]{4,}') AS w FROM t)
  SELECT doc_id, md5(text) AS digest, length(text)::INTEGER AS n_chars, len(w)::INTEGER AS n_entities, CASE WHEN len(w) > 1 THEN 1 ELSE 0 END AS n_relations, w[1] AS head, w[len(w)] AS tail FROM w""")
def corpus_blocks(spark, d):
    """Words of four letters or more at a text's start are its entities; the first is related to the last."""
    t = W.table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x20]+", " ")).alias("t"))
    w = t.withColumn("w", F.regexp_extract_all(F.substring("t", 1, 400), F.lit("[A-Za-z]{4,}"), F.lit(0)))
    entity = F.transform("w", lambda x, i: F.concat_ws("\t", "doc_id", i, i + F.length(x), x, F.lit(""), F.concat(F.lit("W"), i)))
    relation = F.when(F.size("w") > 1, F.array(F.concat_ws("\t", "doc_id", F.lit("CID"), F.lit("W0"), F.concat(F.lit("W"), F.size("w") - 1)))).otherwise(F.array().cast("array<string>"))
    path = shared_path(spark)
    B.written_as_pubtator(w.select(F.col("doc_id").alias("id"), F.substring("t", 1, 40).alias("title"), F.expr("substring(t, 41)").alias("abstract"), entity.alias("entities"), relation.alias("relations")), path)
    forget(spark, path)
    b = B.pubtator(spark, path, 1 << 20)
    at = lambda i: F.get("entities", F.get("relations", F.lit(0))[i])["text"]
    first = F.get("entities", F.lit(0))["text"]
    return b.select(
        F.col("id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), F.length("text").alias("n_chars"), F.size("entities").alias("n_entities"),
        F.size("relations").alias("n_relations"), F.coalesce(at("head"), first).alias("head"), F.coalesce(at("tail"), first).alias("tail"),
    )


# ---- a linker over aliases


@query("""WITH a AS (SELECT lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS alias, min(item_id::VARCHAR) AS cui FROM benchmark GROUP BY 1)
  SELECT doc_id, alias, cui, (strpos(lower(text), alias) - 1)::INTEGER AS first FROM documents, a WHERE alias <> ' ' AND strpos(lower(text), alias) > 0""")
def alias_first(spark, d):
    """Where the first two words of each benchmark passage first stand in each document."""
    w = F.split("text", " ")
    names = W.table(spark, d, "benchmark").select(F.concat(w[0], F.lit(" "), F.coalesce(F.get(w, F.lit(1)), F.lit(""))).alias("alias"), F.col("item_id").cast("string").alias("cui"))
    return K.alias_hits(W.table(spark, d, "documents"), names.where("alias <> ' '")).groupBy("doc_id", "alias", "cui").agg(F.min("start").alias("first"))


_GRAMS = "(SELECT term, substr(' ' || term || ' ', i::BIGINT, 3) AS g, count(*) AS tf FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM {0}) GROUP BY ALL)"


@query(f"""WITH known AS (SELECT p_name AS term, min(p_partkey::VARCHAR) AS cui FROM part GROUP BY p_name), asked AS (SELECT DISTINCT substr(p_name, 1, 2) || substr(p_name, 4) AS term FROM part),
  n AS (SELECT count(*) AS n FROM known), kt AS {_GRAMS.format('known')}, mt AS {_GRAMS.format('asked')}, df AS (SELECT g, count(*) AS df FROM kt GROUP BY g),
  kw AS (SELECT term, kt.g, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM kt JOIN df ON df.g = kt.g, n),
  mw AS (SELECT term, mt.g, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1) AS w FROM mt LEFT JOIN df ON df.g = mt.g, n),
  kn AS (SELECT term, sqrt(sum(w * w)) AS norm FROM kw GROUP BY term), mn AS (SELECT term, sqrt(sum(w * w)) AS norm FROM mw GROUP BY term),
  s AS (SELECT mw.term AS mention, kw.term AS alias, round(sum(mw.w * kw.w) / (any_value(mn.norm) * any_value(kn.norm)), 9) AS score
    FROM mw JOIN kw ON kw.g = mw.g JOIN mn ON mn.term = mw.term JOIN kn ON kn.term = kw.term GROUP BY mw.term, kw.term),
  b AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, alias) AS k FROM s WHERE score >= CAST(0.5 AS DOUBLE))
  SELECT mention, alias, cui, round(score, 6) AS score FROM b JOIN known ON known.term = b.alias WHERE k = 1""")
def linker_best(spark, d):
    """Names of parts without their third letter, linked to the names."""
    p = W.table(spark, d, "part")
    asked = p.select(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("mention"))
    return K.link_mentions(asked, p.select(F.col("p_name").alias("alias"), F.col("p_partkey").cast("string").alias("cui"))).select("mention", "alias", "cui", *_r("score"))


# ---- a log of extractors, filled again


@query("""WITH n AS (SELECT doc_id, string_split(trim(regexp_replace(substr(text, 1, 200), '[\\x00-\\x20]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL)
  SELECT x.extractor, x.n AS run, doc_id AS set_id, w[1] AS s, x.r AS r, w[len(w)] AS o FROM n, (VALUES ('b1', 2, 'raises'), ('b2', 1, 'treats')) x(extractor, n, r)""")
def backfilled_log(spark, d):
    """Two extractors over the documents' beginnings; the first is filled again by another model, the second stays."""
    text = F.trim(F.regexp_replace(F.substring("text", 1, 200), "[\\x00-\\x20]+", " "))
    notes = W.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("long").alias("set_id"), F.lit(0).cast("long").alias("note"), text.alias("text"))
    path, w = shared_path(spark), F.split("text", " ")
    says = lambda r: lambda n: n.select("set_id", "note", F.array(F.struct(w[0].alias("s"), F.lit(r).alias("r"), F.element_at(w, -1).alias("o"))).alias("triples"))
    H.backfill(spark, path, notes, {"b1": ("first", says("causes")), "b2": ("first", says("treats"))})
    forget(spark, path)
    H.backfill(spark, path, notes, {"b1": ("second", says("raises")), "b2": ("first", says("never"))})
    versions = [{name: x["version"] for name, x in m["extractors"].items()} for m in H.history(spark, path)]
    run = F.when(F.col("version") == versions[0]["b1"], 1).when(F.col("version") == versions[0]["b2"], 1).otherwise(2)
    return H.read_log(spark, path).select("extractor", run.alias("run"), "set_id", F.explode("triples").alias("t")).select("extractor", "run", "set_id", "t.s", "t.r", "t.o")


@query(f"""WITH {TV}, {LI}, b AS (SELECT s, r, o FROM tv UNION ALL SELECT s, r, o FROM li UNION ALL SELECT s, r, o FROM li WHERE polarity = 'negative')
  SELECT r, count(*) AS n, count(DISTINCT s || '|' || o) AS pairs FROM b GROUP BY r""")
def bag_merge(spark, d):
    """Triples of two tables, one of them in part twice, with repeats kept."""
    li = W.lineitem(spark, d)
    return E.bag(W.events(spark, d), li, li.where("polarity = 'negative'")).groupBy("r").agg(F.count("*").alias("n"), F.count_distinct(F.concat_ws("|", "s", "o")).alias("pairs"))
