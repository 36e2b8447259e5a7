"""A log of extractors' triples whose columns can be filled again: versions beside each other, one manifest that names the current ones.

Data of a version are written first, to a folder of their own. What readers see changes only when the next manifest is
renamed into place, for all extractors at once: a run that fails leaves the old data, and its leftovers are overwritten.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLES = "set_id long, note long, triples array<struct<s:string,r:string,o:string>>"


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def history(spark: SparkSession, path: str) -> list[dict]:
    """All manifests, oldest first: number, extractors (name to version, rows and the version before it)."""
    system, at = _system(spark, f"{path}/_manifests")
    if not system.exists(at):
        return []
    names = sorted(f.getPath().getName() for f in system.listStatus(at) if f.getPath().getName().endswith(".json"))
    rows = {r.file.rsplit("/", 1)[1]: json.loads(r.value) for r in spark.read.text([f"{path}/_manifests/{n}" for n in names], wholetext=True).withColumn("file", F.input_file_name()).collect()} if names else {}  # a row a run
    return [rows[n] for n in names]


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """The manifest, in place by one rename; another run's of the same number is an error."""
    name = f"{path}/_manifests/{manifest['number']:08d}.json"
    system, final = _system(spark, name)
    _, draft = _system(spark, f"{path}/_manifests/.{manifest['number']:08d}.draft")
    out = system.create(draft, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if system.exists(final) or not system.rename(draft, final):
        raise RuntimeError(f"another run has written {name}")


def digest(notes: DataFrame, label: str) -> str:
    """A name for what an extractor says of these notes: it changes with any text, id or the extractor's label."""
    one = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("set_id", "note", "text")])
    two = F.xxhash64(F.lit(7), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("text", "note", "set_id")])
    sums = notes.agg(F.count("*"), *[F.sum(x.cast("decimal(38,0)")) for x in (one, two)]).first()
    return hashlib.sha256(f"{label}|{tuple(map(str, sums))}".encode()).hexdigest()[:24]


def backfill(spark: SparkSession, path: str, notes: DataFrame, extractors: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]) -> dict:
    """Fill extractors' columns of the log at path from notes(set_id, note, text); the manifest that then holds.

    extractors: name to (label, function from notes to TRIPLES); the label names the model and its settings. One whose
    notes and label are as before isn't run again; others that the log has stay as they are. Notes for which the
    function gives no row get none.
    """
    past = history(spark, path)
    current = past[-1]["extractors"] if past else {}
    new = {}
    for name, (label, extract) in extractors.items():
        version = digest(notes, f"{name}|{label}")
        if current.get(name, {}).get("version") == version:
            continue
        at = f"{path}/extractor={name}/version={version}"
        extract(notes).select("set_id", "note", "triples").write.mode("overwrite").parquet(at)
        new[name] = {"version": version, "label": label, "rows": spark.read.parquet(at).count(), "before": current.get(name, {}).get("version")}
    if not new:
        return past[-1] if past else {"number": 0, "extractors": {}}
    manifest = {"number": len(past) + 1, "extractors": current | new}
    _commit(spark, path, manifest)
    return manifest


def read_log(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """extractor, version, set_id, note, triples as the last manifest has them, or an earlier one by its number."""
    past = history(spark, path)
    entries = (past[-1] if number is None else past[number - 1])["extractors"] if past else {}
    parts = [
        spark.read.schema(TRIPLES).parquet(f"{path}/extractor={name}/version={x['version']}").select(F.lit(name).alias("extractor"), F.lit(x["version"]).alias("version"), "set_id", "note", "triples")
        for name, x in sorted(entries.items())
    ]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"extractor string, version string, {TRIPLES}")
