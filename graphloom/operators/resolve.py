"""Entity resolution and span operators: registries, clusters, fuzzy vocabulary, intervals."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions import vector as V
from ..sources.shared import stage
from .similarity import average_linkage, cosine_links


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of edges(a, b), component being the smallest node reached: labels spread, then jump.

    One aggregation and one join a round, written to the shared folder; only a count comes to the driver.
    """
    links = stage(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    label = stage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(max_rounds):
        seen = links.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        new = label.join(seen, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = stage(new.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "was"))
        moved = new.where("component <> was").count()
        label = new.select("node", "component")
        if not moved:
            return label
    raise RuntimeError("components did not settle")


#: Similarities of the registry: one entity, one entity with the same headword, worth a note.
MERGE_AT, HEAD_AT, NOTED_AT = 0.88, 0.65, (0.65, 0.88)
MERGED = "seq long, entity string, representative string, similarity double, reason string, near string"


def registry(mentions: DataFrame, merge_at: float = MERGE_AT, head_at: float = HEAD_AT, containment: bool = False, noted: tuple[float, float] = NOTED_AT) -> DataFrame:
    """Representatives of mentions(set_id, seq, entity, surface, head, embedding) as they arrive: MERGED's columns and set_id.

    An entity joins the most similar representative (the first by name on a tie) if the similarity is merge_at or more,
    if one surface holds the other's words (with `containment`), or if their headwords agree and it is head_at or more;
    else it is new. One surface is similarity 1, a missing vector 0. `near` names a representative that was similar
    within `noted` but not joined. What each mention finds depends on those before it, so a set is folded alone, once
    for each distinct entity; memory is the set's representatives. Empty entities join nothing.
    """
    import pandas as pd

    def fold(pdf):
        pdf = pdf.sort_values("seq", kind="stable")
        names, heads, surfaces, vectors, told, out = [], [], [], [], {}, []
        width = max((len(e) for e in pdf["embedding"] if e is not None), default=1)
        for row in pdf.itertuples():
            name = (row.entity or "").strip()
            if not name:
                continue
            if name not in told:
                v = np.zeros(width) if row.embedding is None else np.asarray(row.embedding, np.float64)
                n = np.linalg.norm(v)
                v = v / n if n > 1e-12 else v * 0
                sims = np.array(vectors) @ v if vectors else np.zeros(0)
                for i, x in enumerate(surfaces):
                    if x and x == row.surface:
                        sims[i] = 1.0
                best = min(range(len(names)), key=lambda i: (-sims[i], names[i]), default=None)
                answer = (name, None, "new", None)
                if best is not None:
                    sim, words, own = float(sims[best]), set((surfaces[best] or "").split()), set((row.surface or "").split())
                    why = (
                        "similar" if sim >= merge_at else "contained" if containment and words and own and (words <= own or own <= words)
                        else "headword" if row.head and row.head == heads[best] and sim >= head_at else None
                    )
                    answer = (names[best], sim, why, None) if why else (name, sim, "new", names[best] if noted[0] <= sim < noted[1] else None)
                told[name] = answer
                if answer[2] == "new":
                    names.append(name)
                    heads.append(row.head)
                    surfaces.append(row.surface)
                    vectors.append(v)
            out.append((row.set_id, row.seq, name, *told[name]))
        return pd.DataFrame(out, columns=["set_id", "seq", "entity", "representative", "similarity", "reason", "near"])

    kind = dict(mentions.dtypes)["set_id"]
    return mentions.select("set_id", "seq", "entity", "surface", "head", "embedding").groupBy("set_id").applyInPandas(fold, f"set_id {kind}, {MERGED}")


def registry_merge(vectors: DataFrame, group: str, merge_at: float = MERGE_AT) -> DataFrame:
    """vec_id, representative: vectors arrive in id order and join the most similar representative at merge_at or more.

    The order matters, so each group is folded alone; memory is the group's representatives.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        reps, ids, out = [], [], []
        for vec_id, e in zip(pdf["vec_id"], pdf["embedding"], strict=True):
            v = np.asarray(e, np.float64)
            n = np.linalg.norm(v)
            v = v / n if n > 1e-12 else v * 0
            sims = np.array(reps) @ v if reps else np.zeros(0)
            if len(sims) and sims.max() >= merge_at:
                out.append(ids[int(sims.argmax())])
            else:
                reps.append(v)
                ids.append(vec_id)
                out.append(vec_id)
        return pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(), "representative": out})

    rows = vectors.where("embedding is not null").select("vec_id", "embedding", group)
    return rows.groupBy(group).applyInPandas(fold, "vec_id long, representative long")


def record_surfaces(aligned: DataFrame) -> DataFrame:
    """canonical, surface, seq: the six surfaces of each kept edge(seq, s, o, raw_s, raw_o, pre_s, pre_o), empty ones left out."""
    pair = lambda c, x: F.struct(F.col(c).alias("canonical"), F.trim(F.coalesce(F.col(x), F.lit(""))).alias("surface"))
    out = aligned.select("seq", F.explode(F.array(*[pair(e, x.format(e)) for e in ("s", "o") for x in ("raw_{}", "pre_{}", "{}")])).alias("x"))
    return out.select("x.canonical", "x.surface", "seq").where("surface <> ''")


def alias_registry(aligned: DataFrame) -> DataFrame:
    """canonical, surface: every recorded surface and its lower case."""
    r = record_surfaces(aligned)
    return r.select("canonical", F.explode(F.array("surface", F.lower("surface"))).alias("surface")).distinct()


def exported_mapping(merged: DataFrame) -> DataFrame:
    """set_id, representative, n_mentions, n_surfaces, preferred (most frequent, then last), n_near of a registry's rows."""
    n = merged.groupBy("set_id", "representative", "entity").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.count("near").alias("near"))
    return n.groupBy("set_id", "representative").agg(
        F.sum("n").alias("n_mentions"), F.count("*").alias("n_surfaces"), F.max_by("entity", F.struct("n", "last")).alias("preferred"), F.sum("near").alias("n_near")
    )


def agglomerative(vectors: DataFrame, group: str, threshold: float = 0.75) -> DataFrame:
    """vec_id, cluster (its smallest vec_id): average linkage by cosine within each group, see `similarity.average_linkage`.

    Null vectors are left out; zero ones are alone.
    """
    rows = vectors.where("embedding is not null")
    found = average_linkage(rows, threshold, group=group).withColumnRenamed("id", "vec_id")
    return rows.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.coalesce("cluster", "vec_id").alias("cluster"))


def display_clusters(labels: DataFrame, facts: DataFrame, threshold: float = 0.75) -> DataFrame:
    """set_id, name, cluster (its smallest name), display of labels(set_id, name, surface, embedding), one row a name and set.

    Names are one if a chain of equal surfaces or cosines >= threshold joins them. `display` is the subject, else the
    object, of the set's fact in facts(set_id, s, s_surface, s_embedding, o, o_surface, o_embedding) if a member means the same; else the longest
    member, the last of equal length. A surface joins its members to the first of them, so a hot one makes a star.
    """
    rows = stage(labels.where("name is not null").withColumn("id", F.monotonically_increasing_id()))
    first = rows.where("surface <> ''").groupBy("set_id", "surface").agg(F.min("id").alias("b"))
    stars = rows.join(first, ["set_id", "surface"]).where("id <> b").select(F.col("id").alias("a"), "b")
    found = components(stage(stars.unionByName(cosine_links(rows, threshold, "id", group="set_id"))))
    member = rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    told = member.join(facts, "set_id", "left")
    alike = lambda e: F.coalesce((F.col("surface") != "") & (F.col("surface") == F.col(f"{e}_surface")), F.lit(False)) | (V.cosine(F.col("embedding"), F.col(f"{e}_embedding")) >= threshold)
    best = told.groupBy("c").agg(
        F.max(F.when(alike("s") & (F.trim("s") != ""), F.col("s"))).alias("_s"), F.max(F.when(alike("o") & (F.trim("o") != ""), F.col("o"))).alias("_o"),
        F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("_longest"), F.min("name").alias("cluster"),
    )
    return member.select("set_id", "name", "c").join(best, "c").select("set_id", "name", "cluster", F.coalesce("_s", "_o", "_longest").alias("display"))


def named_clusters(members: DataFrame, longest: bool = False) -> DataFrame:
    """members(cluster, name) with `representative`: the shortest name, then the first by lower case; or the longest, then the last."""
    key = F.struct(F.length("name"), F.col("name")) if longest else F.struct(F.length("name"), F.lower("name"), F.col("name"))
    best = members.groupBy("cluster").agg((F.max_by if longest else F.min_by)("name", key).alias("representative"))
    return members.join(best, "cluster")


def remap(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """triples with both ends replaced by mapping(name, representative), trimmed; ends without an entry stay."""
    out = triples
    for end in ("s", "o"):
        m = mapping.select(F.col("name").alias("_n"), F.col("representative").alias("_r"))
        out = out.join(m, F.trim(end) == F.col("_n"), "left").withColumn(end, F.trim(F.coalesce("_r", end))).drop("_n", "_r")
    return out


def unique_strings(rows: DataFrame) -> DataFrame:
    """x, seq: distinct trimmed, non-empty texts of rows(x, seq), each where it first occurs."""
    return rows.select(F.trim("x").alias("x"), "seq").where("x <> ''").groupBy("x").agg(F.min("seq").alias("seq"))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def fuzzy_match(terms: DataFrame, vocabulary: DataFrame, least: float = 0.82) -> DataFrame:
    """term, match, score: the vocabulary's best term by word Jaccard or sequence ratio, from `least` on; first on a tie.

    No pair is missed. At that ratio at most d = (1 - least) * (both lengths) characters do not match, so of d + 1
    pieces of the vocabulary's term one lies whole in the other term, at most d places away. At that Jaccard similarity
    two terms share one of the first words in order. Only such pairs are compared.
    """
    slack = (1 - least) + 1e-9
    a, b = terms.select("term").distinct(), vocabulary.select(F.col("term").alias("match")).distinct()
    b = b.withColumn("lb", F.length("match")).withColumn("d", F.floor(F.col("lb") * slack * (1 + (2 - least) / least)).cast("int"))
    cut = lambda i: F.floor(i * F.col("lb") / (F.col("d") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.struct(cut(i).alias("at"), F.substr("match", cut(i) + 1, cut(i + 1) - cut(i)).alias("x")))
    b = b.where("lb > 0").select("match", "lb", F.explode(F.filter(pieces, lambda p: F.length(p["x"]) > 0)).alias("p")).select("match", "lb", F.col("p.at").alias("pb"), F.col("p.x").alias("x"))
    sizes = [r[0] for r in b.select(F.length("x")).distinct().collect()]  # lengths of pieces: a few
    grams = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.length("term") - n, F.lit(0))), lambda i: F.struct(i.alias("at"), F.substr("term", i + 1, F.lit(n)).alias("x")))
    a = a.withColumn("la", F.length("term")).where("la > 0")
    all_grams = F.concat(*[grams(n) for n in sizes]) if sizes else F.array().cast("array<struct<at:int,x:string>>")
    a = a.select("term", "la", F.explode(all_grams).alias("p")).select("term", "la", F.col("p.at").alias("pa"), F.col("p.x").alias("x"))
    far = (F.col("la") + F.col("lb")) * slack
    near = a.join(b, "x").where((F.abs(F.col("la") - F.col("lb")) <= far) & (F.abs(F.col("pa") - F.col("pb")) <= far)).select("term", "match")

    def first_words(df: DataFrame, c: str) -> DataFrame:
        w = F.array_sort(F.array_distinct(T.content_tokens(F.col(c))))
        n = F.size(w)
        return df.select(c).distinct().withColumn("w", F.explode(F.slice(w, 1, F.greatest(n - F.ceil(n * least - 1e-9) + 1, F.lit(0)).cast("int"))))

    shared = first_words(terms.select("term"), "term").join(first_words(vocabulary.select(F.col("term").alias("match")), "match"), "w").select("term", "match")
    pairs = near.unionAll(shared).distinct()
    x, y = T.content_tokens(F.col("term")), T.content_tokens(F.col("match"))
    words = F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))
    scored = pairs.withColumn("score", F.greatest(words, ratio("term", "match"))).where(F.col("score") >= least)
    w = Window.partitionBy("term").orderBy(F.desc("score"), "match")
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("term", "match", F.round("score", 6).alias("score"))


GAP = "(?<=[.!?])\\s+|\\n+"


def _placed(find, schema: str, texts: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, start, stop) that find(text) gives for each text, in one pass over it."""

    def run(batches):
        for b in batches:
            row, out = [], ([], [], [])
            for i, text in enumerate(b.column("text").to_pylist()):
                for pos, (start, stop) in enumerate(find(text)):
                    row.append(i)
                    for c, x in zip(out, (pos, start, stop), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(out[0], pa.int64()), *[pa.array(x, pa.int32()) for x in out[1:]]], names=["doc_id", "pos", "start", "stop"])

    return texts.mapInArrow(run, schema)


def sentence_spans(docs: DataFrame, least: int = 0) -> DataFrame:
    """doc_id, pos, start, stop of sentences cut after [.!?] and white space or at line feeds, exact offsets in the text.

    Blank pieces are no sentences, nor are those of fewer than `least` characters; pos counts those that are.
    """
    gap = re.compile(GAP, re.ASCII)

    def find(text):
        ends = [*((m.start(), m.end()) for m in gap.finditer(text)), (len(text), len(text))]
        at = 0
        for start, end in ends:
            inner = text[at:start].strip(" ")
            if inner and len(inner) >= least:
                yield at, start
            at = end

    rows = docs.where("text is not null").select("doc_id", "text")
    return _placed(find, f"doc_id {dict(rows.dtypes)['doc_id']}, pos long, start int, stop int", rows)


def sentence_statistics(spans: DataFrame, mentions: DataFrame) -> DataFrame:
    """n_sentences, n_with_entities, n_entities, chars over sentences(doc_id, pos, start, stop) and the mentions in them."""
    held = contained(mentions, spans).groupBy("doc_id", "pos").agg(F.count("*").alias("e"))
    d = spans.join(held, ["doc_id", "pos"], "left")
    return d.agg(F.count("*").alias("n_sentences"), F.count("e").alias("n_with_entities"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_entities"), F.sum(F.col("stop") - F.col("start")).cast("long").alias("chars"))


#: characters of a bucket of positions
BUCKET = 1024


def contained(mentions: DataFrame, spans: DataFrame) -> DataFrame:
    """Mentions(doc_id, start, stop) with the sentence that holds them whole; offsets are of the sentence.

    A sentence is posted to each bucket of positions that it reaches, a mention to the one where it starts: they meet
    there, so a long document costs no product of its mentions and sentences.
    """
    reach = F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.greatest(F.col("stop") - 1, F.col("start"))) / BUCKET))
    s = spans.select("doc_id", "pos", F.col("start").alias("s0"), F.col("stop").alias("s1"), F.explode(reach).alias("_b"))
    hit = mentions.withColumn("_b", F.floor(F.col("start") / BUCKET)).join(s, ["doc_id", "_b"]).where("start >= s0 and stop <= s1")
    return hit.select("doc_id", "pos", (F.col("start") - F.col("s0")).alias("start"), (F.col("stop") - F.col("s0")).alias("stop"))


def mentions_of(docs: DataFrame, needle: str) -> DataFrame:
    """doc_id, start, stop of all places of a plain text in the documents, none overlapping."""

    def find(text):
        at = text.find(needle)
        while at >= 0:
            yield at, at + len(needle)
            at = text.find(needle, at + len(needle))

    rows = docs.where("text is not null").select("doc_id", "text")
    return _placed(find, f"doc_id {dict(rows.dtypes)['doc_id']}, pos long, start int, stop int", rows).drop("pos")


def mentions_in_sentences(docs: DataFrame, needle: str) -> DataFrame:
    """doc_id, pos, start, stop: all mentions that a sentence holds whole, offsets in the sentence."""
    found = contained(mentions_of(docs, needle), sentence_spans(docs))
    return found.select("doc_id", "pos", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def label_weights(counts: DataFrame) -> DataFrame:
    """Inverse frequencies of counts(gold, n), clipped to 0.1 and 10, then scaled to a mean of 1."""
    all_rows = Window.partitionBy(F.lit(1))  # a row a label
    raw = F.sum("n").over(all_rows) / (F.count("*").over(all_rows) * F.col("n"))
    clipped = counts.withColumn("_w", F.least(F.greatest(raw, F.lit(0.1)), F.lit(10.0)))
    return clipped.withColumn("weight", F.col("_w") / F.avg("_w").over(all_rows)).drop("_w")
