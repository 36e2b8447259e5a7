"""The same queries in SQL for DuckDB, over views of the tables."""

from __future__ import annotations

from ..functions.relation import CUES, FACT_VERBS, PASSIVE
from ..functions.text import AGENTIVE, HEAD_STOPS
from .views import FACTS, LINES, RELATIONS

TV = """tv AS (
  SELECT user_id AS set_id, strftime(ts, '%Y-%m-%d') AS note, 'u' || user_id AS s,
    CASE event_type WHEN 'error' THEN 'causes' WHEN 'click' THEN 'increases' WHEN 'purchase' THEN 'treats' WHEN 'signup' THEN 'prevents' ELSE 'related_to' END AS r,
    'k' || regexp_extract(props, '"k": *([0-9]+)', 1) AS o, event_id AS seq FROM events)"""
LI = """li AS (
  SELECT l_partkey AS set_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS seq,
    l_orderkey AS source, 'p' || l_partkey AS s, CASE l_returnflag WHEN 'A' THEN 'causes' WHEN 'N' THEN 'treats' WHEN 'R' THEN 'prevents' END AS r,
    's' || l_suppkey AS o, CASE WHEN l_linestatus = 'O' THEN 'positive' ELSE 'negative' END AS polarity, CAST(1 AS DOUBLE) - l_discount AS confidence FROM lineitem)"""
GRAPHS = """g AS (SELECT set_id, note, coalesce(list(DISTINCT s || '|' || r || '|' || o) FILTER (r <> 'related_to'), []) AS g FROM tv GROUP BY ALL)"""
MEASURE = """len(list_filter(a.g, lambda x: NOT list_contains(b.g, x))) + len(list_filter(b.g, lambda x: NOT list_contains(a.g, x))) AS ged,
    CASE WHEN len(a.g) + len(b.g) = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / len(list_distinct(list_concat(a.g, b.g))) END AS jaccard"""
PAIRS = f"{TV}, {GRAPHS}, p AS (SELECT a.set_id, a.note AS i, b.note AS j, {MEASURE} FROM g a JOIN g b ON a.set_id = b.set_id AND a.note < b.note)"
DRIFT = f"""{PAIRS}, d AS (SELECT set_id, count(*) AS n_pairs, avg(ged) AS mean_ged, avg(jaccard) AS mean_jaccard,
  avg(CASE WHEN CAST(1 AS DOUBLE) - jaccard >= CAST(0.2 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS drift FROM p GROUP BY set_id)"""
DRIFT_ROW = "SELECT set_id, n_pairs, round(mean_ged, 6) AS mean_ged, round(mean_jaccard, 6) AS mean_jaccard, round(drift, 6) AS drift FROM d"
EDGES = f"""{LI}, ed AS (SELECT set_id, s, r, o, min(seq) AS first_seq, arg_min(polarity, seq) AS polarity, arg_min(source, seq) AS first_source,
  max(confidence) AS confidence, count(DISTINCT source) AS n_sources, string_agg(seq || ':' || source || ':' || polarity, ',' ORDER BY seq) AS provenance FROM li GROUP BY set_id, s, r, o)"""
EV = """ev AS (SELECT set_id, seq, note AS source, s, r, o, 'positive' AS polarity FROM tv), ed AS (
  SELECT set_id, s, r, o, min(seq) AS first_seq, arg_min(polarity, seq) AS polarity, arg_min(source, seq) AS first_source FROM ev GROUP BY set_id, s, r, o)"""
KIND = """CASE WHEN a.polarity <> b.polarity THEN 'polarity_clash'
  WHEN (a.r IN ('causes', 'increases') AND b.r IN ('treats', 'prevents', 'reduces')) OR (a.r IN ('treats', 'prevents', 'reduces') AND b.r IN ('causes', 'increases')) THEN 'semantic_polarity_clash'
  ELSE 'multi_relation_mismatch' END"""
CLASH = "ma AS (SELECT e.set_id, e.s, e.r, e.seq, e.source, e.o FROM {ev} e JOIN ed USING (set_id, s, r, o) WHERE e.seq > ed.first_seq AND e.polarity <> ed.polarity)"
STATUS = """SELECT ed.set_id, ed.s, ed.r, ed.o, CASE WHEN EXISTS (SELECT 1 FROM ed x WHERE x.set_id = ed.set_id AND x.s = ed.s AND x.o = ed.o AND x.r <> ed.r)
    OR EXISTS (SELECT 1 FROM ed x WHERE x.set_id = ed.set_id AND x.s = ed.s AND x.r = ed.r AND x.o <> ed.o)
    OR EXISTS (SELECT 1 FROM ma x WHERE x.set_id = ed.set_id AND x.s = ed.s AND x.r = ed.r AND x.o = ed.o)
  THEN 'uncertain' WHEN ed.r = 'related_to' THEN 'weak' ELSE 'active' END AS status FROM ed"""
LABELS = "lb AS (SELECT source AS label, lang AS gold, doc_id AS seq FROM documents), n AS (SELECT label, gold, count(*) AS n, min(seq) AS first_seq FROM lb GROUP BY ALL)"
ARGMAX = """, t AS (SELECT *, sum(n) OVER (PARTITION BY label) AS total, row_number() OVER (PARTITION BY label ORDER BY n DESC, {tie}) AS k FROM n)
  SELECT label, gold AS top, n, CAST(total AS BIGINT) AS total, round(CAST(n AS DOUBLE) / total, 6) AS ratio, CASE WHEN CAST(n AS DOUBLE) / total >= CAST({least} AS DOUBLE) THEN gold ELSE 'unknown' END AS mapped FROM t WHERE k = 1"""
HEAD = "(CASE WHEN list_contains(w, 'bleeding') THEN 'bleeding' ELSE coalesce(w[-1], '') END)"
STOPS = ", ".join(f"'{x}'" for x in HEAD_STOPS)


def words(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda x: x <> '' AND x NOT IN ({STOPS}))"


def head(text: str) -> str:
    return HEAD.replace("w[-1]", f"{words(text)}[-1]").replace("list_contains(w,", f"list_contains({words(text)},")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def formed(forms) -> str:
    """The form of each part's key, its name and brand in place."""
    case = f"CASE p_partkey % {len(forms)} " + " ".join(f"WHEN {i} THEN {quoted(x)}" for i, x in enumerate(forms)) + " END"
    return f"replace(replace({case}, '{{a}}', p_name), '{{b}}', p_brand)"


FACT_ROWS = f"f AS (SELECT p_partkey AS id, {formed(FACTS)} AS fact FROM part)"
CUE_OF = "CASE " + " ".join(f"WHEN regexp_matches(t, {quoted(p)}) THEN {quoted(n)}" for n, p, _ in CUES) + " ELSE 'general relation' END"
RELATION_OF = "CASE cue " + " ".join(f"WHEN {quoted(n)} THEN {quoted(r)}" for n, _, r in CUES) + " ELSE 'related_to' END"


def _parsed() -> str:
    """s, r, o of f.fact: the first verb phrase that fits."""
    at = {"s": [], "r": [], "o": []}
    tail = lambda p: f"regexp_replace(trim(regexp_extract(t, {quoted(p)}, 2)), '^(the|a|an) ', '', 'i')"
    rows = [("is a diuretic", "causes", "'diuretic'")] + [(v, "causes" if r == "immune" else r, "'the immune system'" if r == "immune" else None) for v, r in FACT_VERBS]
    for verb, relation, fixed in rows:
        p = "(?is)^(.+?)\\s+" + verb.replace(" ", "\\s+") + ("\\s*\\.\\s*$" if fixed else "\\s+(.+?)\\s*\\.\\s*$")
        test = f"WHEN regexp_matches(t, {quoted(p)}) THEN "
        at["s"].append(f"{test} trim(regexp_extract(t, {quoted(p)}, 1))")
        at["r"].append(f"{test} {quoted(relation)}")
        at["o"].append(f"{test} {fixed or tail(p)}")
    return ", ".join(f"CASE {' '.join(v)} END AS {c}" for c, v in at.items())


FACT = f"{FACT_ROWS}, fp AS (SELECT id, {_parsed()} FROM (SELECT id, trim(fact) AS t FROM f))"
PREFIX = "(?i)^(\\s*(" + "|".join(x.replace(" ", "\\s+") for x in AGENTIVE) + ")\\s+){1,4}"
RR = "rr AS (SELECT p_partkey AS id, " + ", ".join(f"{formed([x[i] for x in RELATIONS])} AS {c}" for i, c in enumerate("sro")) + " FROM part)"
STRIP = lambda x: f"trim(regexp_replace({x}, {quoted(PREFIX)}, ''))"
LN = f"ln AS (SELECT p_partkey AS id, {formed(LINES)} AS line FROM part)"
#: Letters of the texts that decompose, by what NFKD leaves of them: a letter and a mark, which becomes a space.
ACCENTS = {"à": "a", "á": "a", "â": "a", "ä": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ó": "o", "ô": "o", "ö": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u"}
_plain = "lower(coalesce(text, ''))"
for _k, _v in ACCENTS.items():
    _plain = f"replace({_plain}, '{_k}', '{_v} ')"
SURFACE = f"trim(regexp_replace(regexp_replace({_plain}, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
VALID = f"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(t), '^\\s*\\d+[.):]\\s*', '')), '^\\s*\\d+\\s+', '')), {quoted(PREFIX)}, ''))"
RANKED = """ql AS (SELECT p_partkey AS q_id, 'p' || p_partkey AS s, '?' AS o, 's' || (p_partkey % 10 + 1) AS answer FROM part
    UNION ALL SELECT -s_suppkey, '?', 's' || s_suppkey, 'p1' FROM supplier),
  al(r) AS (VALUES ('causes'), ('causes'), ('treats')),
  gr AS (SELECT s, r, o, count(*) AS n FROM li GROUP BY ALL),
  ca AS (SELECT q_id, gr.o AS answer, n FROM ql CROSS JOIN al JOIN gr ON ql.o = '?' AND gr.s = ql.s AND gr.r = al.r
    UNION ALL SELECT q_id, gr.s, n FROM ql CROSS JOIN al JOIN gr ON ql.s = '?' AND gr.o = ql.o AND gr.r = al.r),
  su AS (SELECT q_id, answer, CAST(sum(n) AS BIGINT) AS n FROM ca GROUP BY ALL),
  rk AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, lower(answer), answer) AS rank, answer, n FROM su)"""
TOKENS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))"
CENTRES = """ex AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
  ce AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM ex GROUP BY ALL)"""
SUMMARY = "SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(avg({c}) - CAST(1.96 AS DOUBLE) * stddev_samp({c}) / sqrt(count({c})), 6) AS ci_lower, round(avg({c}) + CAST(1.96 AS DOUBLE) * stddev_samp({c}) / sqrt(count({c})), 6) AS ci_upper FROM p"


def _compare() -> str:
    parts, ctes = [], [TV]
    for i, b in enumerate(("b1", "b2", "b3")):
        ctes.append(f"g{i} AS (SELECT set_id, note, coalesce(list(DISTINCT s || '|' || r || '|' || o) FILTER (r <> 'related_to'), []) AS g FROM tv WHERE seq % 3 = {i} GROUP BY ALL)")
        ctes.append(f"p{i} AS (SELECT a.set_id, {MEASURE} FROM g{i} a JOIN g{i} b ON a.set_id = b.set_id AND a.note < b.note)")
        ctes.append(f"d{i} AS (SELECT set_id, avg(ged) AS ged, avg(jaccard) AS jaccard, avg(CASE WHEN CAST(1 AS DOUBLE) - jaccard >= CAST(0.2 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS drift FROM p{i} GROUP BY set_id)")
        parts.append(f"SELECT '{b}' AS extractor, count(*) AS n_sets, round(avg(ged), 6) AS ged, round(avg(jaccard), 6) AS jaccard, round(avg(drift), 6) AS drift FROM d{i}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


#: sentences of documents with offsets, of at least {least} characters, and places of " the "; the mark before a gap is the sentence's
SENTENCES = r"""d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
  sc AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]\s+|\n+')) AS c, generate_subscripts(regexp_split_to_array(text, '[.!?]\s+|\n+'), 1) AS i FROM d),
  sg AS (SELECT doc_id, unnest(regexp_extract_all(text, '[.!?]\s+|\n+')) AS g, generate_subscripts(regexp_extract_all(text, '[.!?]\s+|\n+'), 1) AS i FROM d),
  sp AS (SELECT sc.doc_id, sc.i, c || CASE WHEN g[1] IN ('.', '!', '?') THEN g[1] ELSE '' END AS t,
    coalesce(sum(length(c) + coalesce(length(g), 0)) OVER (PARTITION BY sc.doc_id ORDER BY sc.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM sc LEFT JOIN sg ON sg.doc_id = sc.doc_id AND sg.i = sc.i),
  se AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, s0, s0 + length(t) AS s1 FROM sp WHERE trim(t) <> '' AND length(trim(t)) >= {least}),
  mp AS (SELECT doc_id, unnest(string_split(text, ' the ')) AS c, generate_subscripts(string_split(text, ' the '), 1) AS i FROM d),
  mn AS (SELECT doc_id, sum(length(c) + 5) OVER (PARTITION BY doc_id ORDER BY i) - 5 AS m0, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS back FROM mp),
  he AS (SELECT se.doc_id, pos, m0 - s0 AS start, m0 + 5 - s0 AS stop FROM mn JOIN se ON se.doc_id = mn.doc_id AND m0 >= s0 AND m0 + 5 <= s1 WHERE back > 1)"""

SQL = {
    "drift_top10": f"WITH {DRIFT} {DRIFT_ROW} ORDER BY d.mean_jaccard, set_id LIMIT 10",
    "stability_pairwise": f"WITH {PAIRS} SELECT set_id, i, j, ged, round(jaccard, 6) AS jaccard FROM p",
    "drift_at_tau": f"WITH {DRIFT} {DRIFT_ROW}",
    "stability_summary_ci": f"WITH {PAIRS} {SUMMARY.format(c='ged')} UNION ALL {SUMMARY.format(c='jaccard')}",
    "consecutive_drift": f"""WITH {TV}, g0 AS (SELECT set_id, note, list(DISTINCT s || '|' || r || '|' || o) AS g FROM tv GROUP BY ALL),
      o AS (SELECT set_id, note, g, lag(g) OVER (PARTITION BY set_id ORDER BY note) AS h FROM g0),
      a AS (SELECT set_id, note, h AS g FROM o WHERE h IS NOT NULL), b AS (SELECT set_id, note, g FROM o WHERE h IS NOT NULL)
      SELECT set_id, note, ged, round(jaccard, 6) AS jaccard FROM (SELECT a.set_id, a.note, {MEASURE} FROM a JOIN b ON a.set_id = b.set_id AND a.note = b.note)""",
    "unsupported_rate": f"""WITH {TV}, g AS (SELECT DISTINCT set_id, s, r, o FROM tv WHERE r <> 'related_to'), e AS (SELECT DISTINCT set_id, s, r, o FROM tv WHERE note < '2024-01-16')
      SELECT g.set_id, count(*) AS n_edges, count(*) FILTER (e.s IS NULL) AS n_unsupported, round(CAST(count(*) FILTER (e.s IS NULL) AS DOUBLE) / count(*), 6) AS rate
      FROM g LEFT JOIN e USING (set_id, s, r, o) GROUP BY g.set_id""",
    "note_support": f"""WITH {TV}, g AS (SELECT DISTINCT set_id, s, r, o FROM tv WHERE r <> 'related_to'), n AS (SELECT set_id, count(*) AS n FROM g GROUP BY set_id),
      t AS (SELECT DISTINCT set_id, note, s, r, o FROM tv), h AS (SELECT set_id, note, count(*) AS hits FROM t JOIN g USING (set_id, s, r, o) GROUP BY ALL),
      v AS (SELECT x.set_id, CAST(1 AS DOUBLE) - CAST(coalesce(hits, 0) AS DOUBLE) / n AS rate FROM (SELECT DISTINCT set_id, note FROM tv) x JOIN n USING (set_id) LEFT JOIN h USING (set_id, note))
      SELECT set_id, round(avg(rate), 6) AS mean, round(max(rate), 6) AS max, round(min(rate), 6) AS min FROM v GROUP BY set_id""",
    "edge_state": f"WITH {EDGES} SELECT set_id, s, r, o, polarity, round(confidence, 6) AS confidence, first_seq, n_sources, provenance FROM ed",
    "relation_conflicts": f"WITH {EDGES} SELECT a.set_id, a.s, a.o, a.r AS r1, b.r AS r2, a.first_seq AS first_seq1, b.first_seq AS first_seq2, {KIND} AS conflict_type FROM ed a JOIN ed b ON a.set_id = b.set_id AND a.s = b.s AND a.o = b.o AND a.r <> b.r AND a.first_seq < b.first_seq",
    "object_conflicts": f"WITH {EDGES} SELECT a.set_id, a.s, a.r, a.o AS o1, b.o AS o2, a.first_seq AS first_seq1, b.first_seq AS first_seq2, 'object_disagreement_same_subject_relation' AS conflict_type FROM ed a JOIN ed b ON a.set_id = b.set_id AND a.s = b.s AND a.r = b.r AND a.first_seq < b.first_seq",
    "polarity_merge_clashes": f"WITH {EDGES}, {CLASH.format(ev='li')} SELECT set_id, s, r, seq, source, 'polarity_merge_clash' AS conflict_type FROM ma",
    "edge_status": f"WITH {EDGES}, {CLASH.format(ev='li')} {STATUS}",
    "edge_status_counts": f"WITH {TV}, {EV}, {CLASH.format(ev='ev')} SELECT r, status, count(*) AS n FROM ({STATUS}) GROUP BY ALL",
    "update_log": f"""WITH {TV}, {EV}, n AS (SELECT set_id, source, count(*) AS n, min(seq) AS first_at FROM ev GROUP BY ALL), ad AS (SELECT set_id, first_source AS source, count(*) AS added FROM ed GROUP BY ALL),
      c AS (SELECT b.set_id, b.first_source AS source, count(*) AS conflicts FROM ed a JOIN ed b ON a.set_id = b.set_id AND a.s = b.s AND a.first_seq < b.first_seq AND ((a.o = b.o AND a.r <> b.r) OR (a.r = b.r AND a.o <> b.o)) GROUP BY ALL)
      SELECT set_id, source, coalesce(added, 0) AS added, n - coalesce(added, 0) AS merged, coalesce(conflicts, 0) AS conflicts, coalesce(conflicts, 0) AS uncertain,
        CAST(sum(coalesce(added, 0)) OVER (PARTITION BY set_id ORDER BY first_at) AS BIGINT) AS num_edges FROM n LEFT JOIN ad USING (set_id, source) LEFT JOIN c USING (set_id, source)""",
    "heuristic_conflicts": f"WITH {LI}, t AS (SELECT DISTINCT set_id, s, r, o FROM li) SELECT a.set_id, a.s, a.o, a.r AS r1, b.r AS r2 FROM t a JOIN t b ON a.set_id = b.set_id AND a.s = b.s AND a.o = b.o AND a.r < b.r",
    "collapse_max_conf": f"WITH {LI} SELECT set_id, s, r, o, polarity, seq, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY set_id, s, r, o, polarity ORDER BY confidence DESC, seq) AS k FROM li) WHERE k = 1",
    "collapse_best_object": f"WITH {LI} SELECT set_id, s, r, o, polarity, seq, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY set_id, s, r, polarity ORDER BY confidence DESC, length(o), seq) AS k FROM li) WHERE k = 1",
    "sr_object_dedupe": f"WITH {LI}, n AS (SELECT set_id, s, r, o, count(*) AS n FROM li GROUP BY ALL) SELECT set_id, s, r, o, n, removed FROM (SELECT *, count(*) OVER (PARTITION BY set_id, s, r) - 1 AS removed, row_number() OVER (PARTITION BY set_id, s, r ORDER BY n DESC, length(o), lower(o), o) AS k FROM n) WHERE k = 1",
    "qa_graph_union": f"WITH {LI} SELECT s, r, o FROM li WHERE polarity = 'positive' UNION SELECT s, r, o FROM li WHERE confidence >= CAST(0.95 AS DOUBLE)",
    "qa_graph_diff": f"""WITH {LI}, a AS (SELECT DISTINCT s, r, o FROM li WHERE polarity = 'positive'), b AS (SELECT DISTINCT s, r, o FROM li WHERE confidence >= CAST(0.95 AS DOUBLE))
      SELECT 'first' AS part, count(*) AS n FROM a UNION ALL SELECT 'second', count(*) FROM b UNION ALL SELECT 'only_first', count(*) FROM (FROM a EXCEPT FROM b)
      UNION ALL SELECT 'only_second', count(*) FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM b)""",
    "cooccurrence": f"WITH {LABELS} SELECT label, gold, n, first_seq FROM n",
    "label_argmax_map": f"WITH {LABELS}{ARGMAX.format(tie='first_seq', least=0.6)}",
    "label_argmax_lex": f"""WITH {LABELS}, t AS (SELECT *, sum(n) OVER (PARTITION BY label) AS total, row_number() OVER (PARTITION BY label ORDER BY n DESC, gold) AS k FROM n)
      SELECT label, gold AS top, n, CAST(total AS BIGINT) AS total FROM t WHERE k = 1 AND total >= 2""",
    "surface_normalize": f"WITH t AS (SELECT doc_id, {SURFACE} AS t FROM documents) SELECT doc_id, md5(CASE WHEN contains(t, 'bleeding') AND (contains(t, 'stomach') OR contains(t, 'gastric')) THEN 'gastric bleeding' ELSE t END) AS surface FROM t",
    "sentence_split": """WITH t AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]\\s+'), lambda x: trim(x)) AS p FROM documents),
      f AS (SELECT doc_id, list_filter(p, lambda x: x <> '') AS p FROM t)
      SELECT doc_id, len(p) AS n, len(p) - 1 AS last, CAST(list_sum(list_transform(p, lambda x: length(x))) AS BIGINT) AS chars FROM f WHERE len(p) > 0""",
    "relation_cue": f"""WITH {FACT_ROWS}, x AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS t FROM documents UNION ALL SELECT -1 - id, lower(trim(fact)) FROM f),
      c AS (SELECT doc_id, {CUE_OF} AS cue FROM x) SELECT doc_id, cue, {RELATION_OF} AS relation FROM c""",
    "fact_parse": f"WITH {FACT} SELECT id, s, r, o FROM fp",
    "fact_questions": f"""WITH {FACT}, q AS (SELECT id, r, trim(s) AS s, trim(o) AS o FROM fp WHERE s IS NOT NULL)
      SELECT id, CAST(0 AS BIGINT) AS pos, CASE r WHEN 'causes' THEN 'What does ' || s || ' cause?' WHEN 'treats' THEN 'What does ' || s || ' treat?' WHEN 'prevents' THEN 'What does ' || s || ' prevent?' WHEN 'reduces' THEN 'What does ' || s || ' reduce?'
        WHEN 'increases' THEN 'What does ' || s || ' increase?' WHEN 'interacts_with' THEN 'What does ' || s || ' interact with?' WHEN 'metabolized_by' THEN 'Which organ metabolizes ' || s || '?' ELSE 'What is linked to ' || s || ' via ' || r || '?' END AS question FROM q
      UNION ALL SELECT id, CAST(1 AS BIGINT), CASE r WHEN 'causes' THEN 'What causes ' || o || '?' WHEN 'treats' THEN 'What drug treats ' || o || '?' WHEN 'prevents' THEN 'What prevents ' || o || '?' WHEN 'reduces' THEN 'What reduces ' || o || '?'
        WHEN 'increases' THEN 'What increases ' || o || '?' WHEN 'interacts_with' THEN 'What interacts with ' || o || '?' WHEN 'metabolized_by' THEN 'What drug is metabolized by the ' || o || '?' ELSE 'What is linked to ' || o || ' via ' || r || '?' END FROM q""",
    "passive_swap": f"""WITH {RR}, a AS (SELECT id, r, regexp_replace(lower(r), '[ -]', '_', 'g') AS x, s, o FROM rr),
      b AS (SELECT *, ({' OR '.join(f"contains(x, '{p}')" for p in PASSIVE)} OR ends_with(x, '_cause_of') OR x = 'cause_of' OR x IN ('metabolizes', 'metabolize') OR starts_with(x, 'metabolizes_')) AS sw FROM a),
      c AS (SELECT id, r, x, CASE WHEN sw THEN o ELSE s END AS s, CASE WHEN sw THEN s ELSE o END AS o FROM b),
      d AS (SELECT *, (NOT regexp_matches(x, 'caused_by|treated_by|prevented_by|increased_by|reduced_by|metabolized_by') AND regexp_matches(x, 'cause|treat|prevent|increase|reduce|interact|metaboliz|associat')) AND {STRIP('o')} <> trim(o) AND {STRIP('s')} = trim(s) AS w FROM c)
      SELECT id, {STRIP('CASE WHEN w THEN o ELSE s END')} AS s, r, {STRIP('CASE WHEN w THEN s ELSE o END')} AS o FROM d""",
    "line_parse": f"""WITH {LN}, a AS (SELECT id, line, string_split(trim(line), '|') AS p FROM ln),
      b AS (SELECT id, line, p, lower(trim(line)) <> 'none' AND trim(p[1]) <> '' AND len(p) >= 2 AS ok, len(p) >= 3 AS three FROM a),
      c AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^(answer|the answer|result)\\s*:') THEN trim(regexp_replace(line, '(?i)^(answer|the answer|result)\\s*:', '')) ELSE trim(line) END AS an, upper(replace(trim(line), ' ', '_')) AS u FROM b)
      SELECT id, CASE WHEN ok THEN trim(p[1]) END AS s, CASE WHEN ok AND three AND trim(p[2]) <> '' THEN trim(p[2]) WHEN ok THEN 'related_to' END AS r, CASE WHEN ok AND three THEN trim(array_to_string(p[3:], '|')) WHEN ok THEN trim(p[2]) END AS o,
        CASE WHEN starts_with(lower(trim(line)), 'unknown') THEN '' ELSE trim(trim(an, '"'), '''') END AS answer,
        CASE WHEN u = '' OR u IN ('NR', 'NEGATIVE', 'NO_RELATION', 'NONE', 'O', 'FALSE', 'NEG', '0', 'LABEL_0') OR starts_with(u, 'NOT_') OR contains(lower(line), 'no relation') OR contains(lower(line), 'not related') THEN NULL
          WHEN contains(u, 'CID') OR u IN ('POSITIVE', 'TRUE', '1', 'YES', 'RELATION', 'POS', 'LABEL_1') THEN 'causes' WHEN starts_with(u, 'LABEL_') THEN NULL ELSE regexp_replace(lower(trim(line)), '[ -]', '_', 'g') END AS label FROM c""",
    "entity_validity": f"""WITH p AS (SELECT p_size || ' ' || p_name AS t, p_partkey FROM part), x AS (SELECT * FROM p UNION ALL SELECT n_name, n_nationkey FROM nation UNION ALL SELECT 'due to ' || substr(t, 1, 4), p_partkey FROM p),
      v AS (SELECT p_partkey, {VALID} AS t FROM x), k AS (SELECT p_partkey, t, regexp_extract_all(lower(t), '[a-z0-9]+') AS w, length(regexp_replace(t, '[^0-9]', '', 'g')) AS dg FROM v)
      SELECT CASE WHEN t = '' THEN 'empty' WHEN length(t) < 3 THEN 'too_short' WHEN len(w) = 0 THEN 'no_content_tokens' WHEN regexp_matches(w[1], '^[0-9]+$') THEN 'leading_numeric_token' WHEN CAST(dg AS DOUBLE) / length(t) >= CAST(0.45 AS DOUBLE) THEN 'numeric_heavy' ELSE 'ok' END AS reason,
        count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS total FROM k GROUP BY ALL""",
    "headword": f"SELECT {head('lower(p_name)')} AS head, count(*) AS n, min(p_name) AS least FROM part GROUP BY ALL",
    "containment_merge": f"""WITH n AS (SELECT DISTINCT lower(p_name) AS a FROM part), m AS (SELECT a FROM n UNION SELECT {head('a')} FROM n), h AS (SELECT a, {head('a')} AS head FROM m)
      SELECT x.head, x.a, y.a AS b FROM h x JOIN h y ON x.head = y.head AND x.a < y.a AND length(x.a) >= 4 AND length(y.a) >= 4 AND (contains(x.a, y.a) OR contains(y.a, x.a))""",
    "preferred_surface": f"""WITH n AS (SELECT {head('lower(p_name)')} AS canonical, p_name AS surface, count(*) AS n, max(p_partkey) AS last FROM part GROUP BY ALL)
      SELECT canonical, surface, n FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY n DESC, last DESC) AS k FROM n) WHERE k = 1""",
    "qa_alias_expand": f"""WITH a AS (SELECT DISTINCT {head('lower(p_name)')} AS c, p_name AS f FROM part), g AS (SELECT DISTINCT {head('lower(p_name)')} AS s, 'treats' AS r, p_brand AS o FROM part)
      SELECT DISTINCT coalesce(x.f, g.s) AS s, g.r, coalesce(y.f, g.o) AS o FROM g LEFT JOIN a x ON x.c = g.s LEFT JOIN a y ON y.c = g.o""",
    "qa_ranked_lookup": f"WITH {LI}, {RANKED} SELECT q_id, rank, answer, n FROM rk",
    "qa_metrics": f"""WITH {LI}, {RANKED}, b AS (SELECT ql.q_id, min(CASE WHEN rk.answer = ql.answer THEN rank END) AS hit FROM ql LEFT JOIN rk USING (q_id) GROUP BY ql.q_id)
      SELECT count(*) AS n, round(avg(CASE WHEN hit IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS exact, round(avg(CASE WHEN hit = 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS top1, round(avg(coalesce(CAST(1 AS DOUBLE) / hit, 0)), 6) AS mrr FROM b""",
    "label_centroids": f"WITH {CENTRES} SELECT label, max(n) AS n, round(sum(m), 6) AS total, round(max(CASE WHEN pos = 1 THEN m END), 6) AS first FROM ce GROUP BY label",
    "nearest_centroid": f"""WITH {CENTRES}, v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
      d AS (SELECT vec_id, label, sqrt(sum((CAST(x AS DOUBLE) - m) * (CAST(x AS DOUBLE) - m))) AS distance FROM v JOIN ce USING (pos) GROUP BY ALL)
      SELECT vec_id, label AS nearest, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) AS k FROM d) WHERE k = 1""",
    "cosine_to_first": """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS f FROM embeddings GROUP BY label),
      p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, CAST(f AS DOUBLE[]) AS b FROM embeddings JOIN f USING (label))
      SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine FROM p""",
    "baseline_compare": _compare(),
    "type_counts": f"WITH {TV} SELECT r, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM tv GROUP BY r",
    "label_weights": """WITH n AS (SELECT lang AS gold, count(*) AS n FROM documents GROUP BY lang), r AS (SELECT gold, n, least(greatest(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 0.1), 10.0) AS w FROM n)
      SELECT gold, n, round(w / avg(w) OVER (), 6) AS weight FROM r""",
    "sim_components": """WITH RECURSIVE n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM n), e AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM w a JOIN w b USING (w)),
      c(node, other) AS (SELECT a, b FROM e UNION SELECT c.node, e.b FROM c JOIN e ON c.other = e.a) SELECT node, min(other) AS component FROM c GROUP BY node""",
    "stream_fold": f"""WITH {TV} SELECT set_id, s, r, arg_min(o, seq) AS o, 'positive' AS polarity, CAST(1 AS DOUBLE) AS confidence, min(seq) AS first_seq, count(*) AS n_evidence FROM tv GROUP BY set_id, s, r, o""",
    "entity_in_sentence": f"WITH {SENTENCES.format(least=0)} SELECT doc_id, pos, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM he",
}
