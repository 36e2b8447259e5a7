"""Annotated abstracts in PubTator blocks as a Spark data source: files are cut at block borders, by byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = (
    "file string, part int, local long, start long, id string, text string, "
    "entities array<struct<n:int,start:int,end:int,text:string,type:string,identifier:string>>, relations array<struct<head:int,tail:int,type:string>>"
)
ENTITY = pa.struct([("n", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("type", pa.string()), ("identifier", pa.string())])
RELATION = pa.struct([("head", pa.int32()), ("tail", pa.int32()), ("type", pa.string())])
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: bytes of a partition, of a read, blocks of a batch
SPLIT, READ, BATCH = 32 << 20, 1 << 20, 256
_WHOLE = re.compile(r"\s*[+-]?\d{1,9}\s*")


def is_title(line: str) -> bool:
    part = line.split("|", 2)
    return len(part) == 3 and part[1] != "a"


def parse_block(lines: list[str]) -> dict:
    """id, text, entities, relations of a block's lines, its title first.

    Entity: at least six tab-separated fields with whole offsets. Relation: exactly four, the second CID or NR; ends
    are found by identifier, the last entity of an identifier counting.
    """
    text, entities, found = [], [], []
    for n, line in enumerate(lines):
        bar, tab = line.split("|", 2), line.split("\t")
        if len(bar) == 3 and bar[1] in ("t", "a"):
            text.append(bar[2])
        if len(tab) >= 6 and _WHOLE.fullmatch(tab[1]) and _WHOLE.fullmatch(tab[2]):
            entities.append({"n": n, "start": int(tab[1]), "end": int(tab[2]), "text": tab[3], "type": tab[4].strip(" ")[:50] or "T047", "identifier": tab[5]})
        if len(tab) == 4 and tab[1] in ("CID", "NR"):
            found.append((tab[2], tab[3], tab[1]))
    last = {e["identifier"]: i for i, e in enumerate(entities)}
    relations = [{"head": last[h], "tail": last[t], "type": kind} for h, t, kind in found if h in last and t in last]
    return {"id": lines[0].split("|", 1)[0], "text": " ".join(text), "entities": entities, "relations": relations}


def lines_from(stream, at: int) -> Iterator[tuple[int, str]]:
    """(offset, line without its end) of a binary stream that stands at offset `at`."""
    rest = b""
    while more := stream.read(READ):
        *whole, rest = (rest + more).split(b"\n")
        for line in whole:
            yield at, line.removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line) + 1
    if rest:
        yield at, rest.removesuffix(b"\r").decode("utf-8", "replace")


def blocks(stream, start: int, end: int) -> Iterator[tuple[int, list[str]]]:
    """(offset, lines) of the blocks whose title begins in [start, end), though they end later."""
    rows = lines_from(stream, max(start - 1, 0))
    if start:
        next(rows, None)  # the rest of the line in which the range begins; a range that begins a line has one byte before it
    at, held = -1, []
    for offset, line in rows:
        if line.startswith("#"):
            continue
        if is_title(line):
            if held:
                yield at, held
            at, held = offset, []
            if offset >= end:
                return
        elif at < 0 and offset >= end:
            return
        if at >= 0:
            held.append(line)
    if held:
        yield at, held


@dataclass
class Range(InputPartition):
    file: str
    part: int
    start: int
    end: int


def _located(path: str):
    """File system and path in it; a URI without a host is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":/" in path else f"file://{path}")


class BlockReader(DataSourceReader):
    """A partition a byte range of a file; compressed files are one each."""

    def __init__(self, options: dict):
        self.path, self.split, self.only = options["path"], int(options.get("splitBytes", SPLIT)), None
        self.parse = (lambda lines: {"id": None, "text": None, "entities": None, "relations": None}) if options.get("bare") == "true" else parse_block

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, root = _located(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = self.path.split(":/", 1)[0] if ":/" in self.path else "file"
        names = [(f"{scheme}://{f.path}", f.size) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[:1] not in "._" and not f.base_name.lower().startswith("readme")]
        return [x for x in names if self.only is None or x[0] in self.only]

    def partitions(self) -> list[Range]:
        out = []
        for name, size in self.files():
            step = max(size, 1) if name.endswith(".gz") else self.split
            out += [Range(name, i, at, 1 << 62 if at + step >= size else at + step) for i, at in enumerate(range(0, max(size, 1), step))]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, name = _located(partition.file)
        with system.open_input_stream(name, compression="gzip") if name.endswith(".gz") else system.open_input_file(name) as stream:
            if partition.start:
                stream.seek(partition.start - 1)
            held, local = [], 0
            for at, lines in blocks(stream, partition.start, partition.end):
                held.append({"start": at, "local": local} | self.parse(lines))
                local += 1
                if len(held) >= BATCH:
                    yield self.batch(partition, held)
                    held = []
            if held:
                yield self.batch(partition, held)

    @staticmethod
    def batch(partition: Range, rows: list[dict]) -> pa.RecordBatch:
        cols = [[partition.file] * len(rows), pa.array([partition.part] * len(rows), pa.int32()), *[[r[c] for r in rows] for c in ("local", "start", "id", "text")]]
        cols += [pa.array([r["entities"] for r in rows], pa.list_(ENTITY)), pa.array([r["relations"] for r in rows], pa.list_(RELATION))]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64() if i in (2, 3) else pa.string()) for i, c in enumerate(cols)], names=["file", "part", "local", "start", "id", "text", "entities", "relations"])


class PrunedReader(BlockReader):
    """Also takes filters on the file's name: other files are not opened."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                names = {f.value}
            elif isinstance(f, In) and f.attribute == ("file",):
                names = set(f.value)
            else:
                yield f
                continue
            self.only = names if self.only is None else self.only & names


class PubTatorSource(DataSource):
    """spark.read.format("pubtator").option("splitBytes", n).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "pubtator"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PrunedReader if self.options.get("pushdown") == "true" else BlockReader)(self.options)


def pubtator(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """file, block (from 1 in each file), start (byte of its title), id, text, entities, relations of all files below a path.

    A file is read in byte ranges; a range owns the blocks whose title begins in it. Files named readme are skipped, and
    filters on `file` reach the source where Spark's setting for them is on. Blocks are numbered by a count a range.
    """
    try:
        spark.dataSource.register(PubTatorSource)
    except AnalysisException as e:  # another session has registered it
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
    on = str(spark.conf.get(PUSHDOWN, "false")).lower()
    source = spark.read.format("pubtator").option("splitBytes", split_bytes).option("pushdown", on)
    rows, bare = source.load(path), source.option("bare", "true").load(path)  # blocks are counted without being parsed
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = bare.groupBy("file", "part").agg(F.count("*").alias("n")).select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, ["file", "part"]).select("file", (F.col("base") + F.col("local") + 1).alias("block"), "start", "id", "text", "entities", "relations")


def written_as_pubtator(docs: DataFrame, path: str) -> None:
    """docs(id, title, abstract, entities, relations as arrays of lines) as text files of blocks, a blank line after each."""
    bar = lambda kind, c: F.concat_ws("|", F.col("id"), F.lit(kind), F.col(c))
    lines = F.concat(F.array(bar("t", "title"), bar("a", "abstract")), "entities", "relations")
    docs.select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value")).write.text(path)
