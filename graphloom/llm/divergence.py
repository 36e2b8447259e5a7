"""Audit of how sources of a language differ: term counts as dense vectors over an integer dictionary of kept terms."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, stage, text_or_empty

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: most cells of a chunk's dense vectors, most terms of a chunk, entries that a task counts before it sends them on
CELLS, CHUNK, HELD = 1 << 22, 512, 300_000
#: letters of ASCII in lower case and all bytes of other characters; what else is in a text separates terms
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
OUT = "lang string, source string, part string, item string, value long"


def _counted(batches):
    """Partial counts (lang, source, term, n, docs); a row with a null term tells that the group occurs."""
    release()
    counts, seen, size = defaultdict(Counter), defaultdict(Counter), 0
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for i in range(b.num_rows):
            group = (b.column("lang")[i].as_py(), b.column("source")[i].as_py())
            total, words = counts[group], texts[i].as_py().translate(LETTERS).split()
            size -= len(total)
            total.update(words)
            size += len(total)
            seen[group].update(dict.fromkeys(words).keys())
            if size > HELD:
                yield from _partial(counts, seen)
                counts, seen, size = defaultdict(Counter), defaultdict(Counter), 0
    yield from _partial(counts, seen)


def _partial(counts, seen):
    for (lang, source), total in counts.items():
        terms = [None, *total]
        n, docs = [0, *total.values()], [0, *map(seen[lang, source].__getitem__, total)]
        for at in range(0, len(terms), 65536):
            cut = slice(at, at + 65536)
            k = len(terms[cut])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k), pa.array([source] * k), pa.array(terms[cut], pa.binary()).cast(pa.string()), pa.array(n[cut], pa.int64()), pa.array(docs[cut], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a row with a null term for each group.

    Terms are runs of ASCII letters, in lower case, and of characters beyond ASCII, which stay. Counts are added up in
    the task that reads the texts, so a frequent term or a large source sends a row a task.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text_or_empty().alias("text"))
    part = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _numbered(batches):
    """Adds `part` and `local`, the number of the row among its language's in this partition; rows come sorted."""
    part, lang, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        local = []
        for x in b.column("lang").to_pylist():
            lang, at = x, at + 1 if x == lang else 0
            local.append(at)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], names=[*b.schema.names, "part", "local"])


def dictionary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, id of the terms that at least min_docs documents of the language hold; ids from 0 in UTF-8 order.

    A range-sorted table numbers its rows within its partitions; what stands before is a count for each partition and language.
    """
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    rows = kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    rows = stage(rows.mapInArrow(_numbered, "lang string, term string, part int, local long"), "terms")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("lang", "part").agg(F.count("*").alias("k")).select("lang", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    return rows.join(base, ["lang", "part"]).select("lang", "term", (F.col("base") + F.col("local")).alias("id"))


def scaled(count: np.ndarray, total) -> np.ndarray:
    """floor(SCALE * count / total) of integers, by long division in steps of 1000, so that no product leaves 64 bits."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out


def _vector(cell: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of n by cell, exact: bincount adds in floating point, so the halves of the numbers are added apart."""
    low, high = (np.bincount(cell, weights=x, minlength=size).astype(np.int64) for x in (n & 0xFFFFFFFF, n >> 32))
    return low + (high << 32)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(top: int):
    def run(key, counts, groups):
        """One chunk of a language's dictionary: counts (id, term, source, n) and groups (source, total, terms, lang_total)."""
        lang = key[0].as_py()
        sources, where = np.unique(np.array(groups.column("source").to_pylist(), object), return_index=True)
        total, kept, whole = (groups.column(c).to_numpy()[where] for c in ("total", "terms", "lang_total"))
        ids, first = np.unique(counts.column("id").to_numpy(), return_index=True)
        terms = np.array(counts.column("term").to_pylist(), object)[first]
        t = len(ids)
        cell = np.searchsorted(sources, np.array(counts.column("source").to_pylist(), object)) * t + np.searchsorted(ids, counts.column("id").to_numpy())
        dense = _vector(cell.astype(np.int64), counts.column("n").to_numpy(), len(sources) * t).reshape(len(sources), t)
        p = 1 + scaled(dense + 2, (total + 2 * kept)[:, None]) if t else dense
        q = 1 + scaled(dense.sum(axis=0) + 2, (whole + 2 * kept)[0]) if t else dense.sum(axis=0)
        source, part, item, value = [], [], [], []
        for i, name in enumerate(sources):
            far = _gaps(p[i], p).sum(axis=1) if t else np.zeros(len(sources), np.int64)
            best = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            f = _gaps(p[i, best], q[best])
            order = np.lexsort((best, -f))[:top]
            others = np.delete(np.arange(len(sources)), i)
            source += [name] * (len(others) + len(order))
            part += ["pair"] * len(others) + ["term"] * len(order)
            item += [*sources[others], *terms[best[order]]]
            value += [*far[others].tolist(), *f[order].tolist()]
        return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of docs(text, lang, source): how far sources lie apart, and by which terms.

    `pair`: item is each other source of the language, value their divergence over all kept terms. `term`: the `top`
    kept terms that the source uses more than its language, by divergence. Ranks go by value, then by item in UTF-8
    order. Null text, lang and source are empty strings; groups without terms count nothing; a language that keeps no term gives
    pairs of value 0; repeated rows count each; other columns are ignored; an empty table gives no row.

    Chunks of the dictionary are compared apart, each with all sources of its language, and their sums added up. A chunk
    has fewer terms the more sources there are, so a task holds CELLS counts at most, or one term of all sources.
    """
    counts = stage(term_counts(docs), "counts")
    named = counts.where("term is null").select("lang", "source")
    most = named.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    size = max(1, min(CHUNK, CELLS // most))
    terms = stage(dictionary(counts, min_docs).withColumn("chunk", F.floor(F.col("id") / size).cast("long")), "dictionary")
    cells = stage(counts.where("n > 0").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "cells")
    total = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = total.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = named.join(total, ["lang", "source"], "left").join(whole, "lang", "left").join(kept, "lang", "left")
    groups = groups.na.fill(0, ["total", "lang_total", "terms"])
    chunks = terms.select("lang", "chunk").distinct()
    groups = groups.join(chunks, "lang", "left").na.fill(0, ["chunk"])
    parts = cells.groupBy("lang", "chunk").cogroup(groups.groupBy("lang", "chunk")).applyInArrow(_compare(top), OUT)
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank.cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all of `documents`; rows as in `audit`."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY t.lang, t.source, t.term
), total AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (coalesce(total.total, 0) + 2 * v.v) AS HUGEINT) AS p
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
), whole AS (
  SELECT lang, sum(total) AS total FROM total GROUP BY lang
), q AS (
  SELECT k.lang, k.term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (x.n + 2)) // (whole.total + 2 * v.v) AS HUGEINT) AS q
  FROM kept k JOIN (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) x ON x.lang = k.lang AND x.term = k.term
  JOIN whole ON whole.lang = k.lang JOIN v ON v.lang = k.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
), allpairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), tops AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS BIGINT) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM tops)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
