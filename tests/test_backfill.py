"""Filling a log again: nothing changes on a rerun, a failed run leaves the old data, lineage stays."""

import pytest
from pyspark.sql import functions as F

from graphloom.sources import backfill as B


def extractor(relation):
    t = F.array(F.struct(F.split("text", " ")[0].alias("s"), F.lit(relation).alias("r"), F.element_at(F.split("text", " "), -1).alias("o")))
    return lambda notes: notes.where("text is not null").select("set_id", "note", t.alias("triples"))


def broken(notes):
    return notes.select("set_id", "note", F.when(F.raise_error(F.lit("model failed")).isNull(), F.array().cast("array<struct<s:string,r:string,o:string>>")).alias("triples"))


def rows(df):
    return sorted((r.extractor, r.set_id, r.note, tuple(map(tuple, r.triples))) for r in df.collect())


def test_backfill(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    notes = spark.createDataFrame([(0, 0, "aspirin helps pain"), (0, 1, "statins lower cholesterol"), (1, 0, None)], "set_id long, note long, text string")
    assert B.read_log(spark, path).count() == 0 and B.history(spark, path) == []
    one = B.backfill(spark, path, notes, {"b1": ("m1", extractor("causes")), "b2": ("m1", extractor("treats")), "b3": ("p", extractor("prevents"))})
    assert one["number"] == 1 and one["extractors"]["b1"]["rows"] == 2
    first = rows(B.read_log(spark, path))
    assert ("b1", 0, 0, (("aspirin", "causes", "pain"),)) in first and len(first) == 6

    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    again = B.backfill(spark, path, notes.repartition(3), {"b1": ("m1", broken), "b2": ("m1", broken)})
    assert again == one and files == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}

    with pytest.raises(Exception, match="model failed"):
        B.backfill(spark, path, notes, {"b1": ("m2", extractor("raises")), "b2": ("m2", broken)})
    assert rows(B.read_log(spark, path)) == first and len(B.history(spark, path)) == 1

    two = B.backfill(spark, path, notes, {"b1": ("m2", extractor("raises")), "b2": ("m2", extractor("lowers"))})
    assert two["number"] == 2 and two["extractors"]["b1"]["before"] == one["extractors"]["b1"]["version"]
    now = rows(B.read_log(spark, path))
    assert {x[3][0][1] for x in now} == {"raises", "lowers", "prevents"} and rows(B.read_log(spark, path, 1)) == first
    with pytest.raises(RuntimeError, match="another run"):
        B._commit(spark, path, two)
