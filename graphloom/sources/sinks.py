"""Writers: nested JSON, CSV and Markdown of results, maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def _finite(c: Column, kind: DataType) -> Column:
    """c with NaN and infinite numbers, however deep they lie, as nulls; c itself where its type can hold none."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
    if not any(x in kind.simpleString() for x in ("double", "float")):
        return c
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, x: _finite(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null, also inside arrays, maps and structs."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    nan_to_null(df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    nan_to_null(df).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_map(df: DataFrame, path: str) -> None:
    """label, mapped as one JSON object; a map has a row a label."""
    one = df.groupBy().agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "mapped"))))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame, limit: int = 25, width: int = 56) -> str:
    """The first rows of a report as a table; long texts are cut, missing values are dashes."""

    def cell(x) -> str:
        if x is None or x != x:
            return "—"
        t = f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
        return t if len(t) <= width else t[: width - 1] + "…"

    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(cell(x) for x in row) + " |" for row in df.limit(limit).collect()]
    return "\n".join(lines) + "\n"


def document(**parts: DataFrame) -> DataFrame:
    """One row, `value`: a JSON object of named reports, each a list of its rows (a single row where the name ends in _row).

    For reports of a few rows; tables of any size are written by themselves.
    """
    out = None
    for name, df in parts.items():
        rows = nan_to_null(df).agg(F.collect_list(F.struct(*df.columns)).alias("x"))
        one = rows.select((F.col("x")[0] if name.endswith("_row") else F.col("x")).alias(name.removesuffix("_row")))
        out = one if out is None else out.join(one)  # a row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("value"))


def write_document(path: str, **parts: DataFrame) -> None:
    document(**parts).coalesce(1).write.mode("overwrite").text(path)


def summary_lines(rows: DataFrame, by: str = "metric") -> DataFrame:
    """value: a line for each metric of rows(metric, n, mean, ci_lower, ci_upper)."""
    return rows.orderBy(by).select(F.format_string("%s: %.4f [%.4f, %.4f] (n=%d)", by, "mean", "ci_lower", "ci_upper", "n").alias("value"))


def per_question(rows: DataFrame, answers: DataFrame, shown: int = 3) -> DataFrame:
    """rows(q_id, ...) with `predicted`: the first `shown` answers(q_id, rank, answer), joined by "; "."""
    first = answers.where(F.col("rank") <= shown).groupBy("q_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "answer"))), lambda x: x["answer"]), "; ").alias("predicted"))
    return rows.join(first, "q_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit("")))


def by_extractor(rows: DataFrame, key: str, value: str, extractors: list[str]) -> DataFrame:
    """A row for each key, a column for each extractor."""
    return rows.groupBy(key).pivot("extractor", extractors).agg(F.first(value))


def map_log(mapped: DataFrame, counts: DataFrame, head: int = 200) -> dict[str, DataFrame]:
    """How a label map came about: the first rows of its counts, labels whose best is tied, labels without a relation."""
    top = counts.groupBy("label").agg(F.max("n").alias("n"))
    tied = counts.join(top, ["label", "n"]).groupBy("label", "n").agg(F.array_join(F.array_sort(F.collect_list("gold")), ",").alias("golds"), F.count("*").alias("k")).where("k > 1")
    return {"trace": counts.orderBy("label", F.desc("n"), "gold").limit(head), "ties": tied.drop("k"), "unmapped": mapped.where("mapped = 'unknown'").select("label", "n", "total")}


def write_clusters(groups: DataFrame, path: str) -> None:
    groups.select("cluster_id", "relation", "n", "centroid").write.mode("overwrite").parquet(path)


def html(title: str, tables: dict[str, DataFrame], limit: int = 25) -> str:
    """A page of reports' first rows, with all text escaped."""
    from html import escape

    def cell(x) -> str:
        return "—" if x is None or x != x else escape(f"{x:.4f}" if isinstance(x, float) else str(x))

    out = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in df.limit(limit).collect())
        out.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(out)


def comparison_table(rows: DataFrame, tau: float = 0.2) -> DataFrame:
    """The eight columns of a comparison: rows(extractor, ged, jaccard, drift, exact, hit, unsupported, conflicts)."""
    # Headings of the report.
    names = ("Method", "GED mean", "Jaccard mean", f"Drift@{tau:g}", "QA EM", "QA R@1", "Unsupported (note)", "Conflict rec.")
    return rows.select(*[F.col(c).alias(n) for c, n in zip(("extractor", "ged", "jaccard", "drift", "exact", "hit", "unsupported", "conflicts"), names, strict=True)])


def write_comparison(rows: DataFrame, path: str, tau: float = 0.2) -> None:
    """The comparison as Markdown and as CSV, a row a method; what is missing is a dash there and nothing here."""
    table = comparison_table(rows, tau).orderBy("Method").coalesce(1)
    write_csv(table, f"{path.rstrip('/')}/csv")
    table.sparkSession.createDataFrame([("## Summary table\n\n" + markdown(table),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/markdown")
