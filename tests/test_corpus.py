"""The block source: any cut of a file gives the same rows, and a given table comes back from its blocks."""

import gzip
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.plans import more
from graphloom.sources import corpus, readers

D = "/root/testdata/sf0.001"


def corpus_text(seed, n=60):
    rng, out = random.Random(seed), ["# a comment\n", "stray line before any block\n"]
    for i in range(n):
        end = rng.choice(["\n", "\r\n"])
        out.append(f"{i}|t|Title {i} é | with a bar{end}")
        out.append(f"{i}|a|{'word ' * rng.randrange(0, 40)}{end}")
        for j in range(rng.randrange(0, 5)):
            out.append(f"{i}\t{j}\t{j + 3}\tname{j}\t{rng.choice(['Chemical', '', 'Disease'])}\tD{rng.randrange(3)}{end}")
        out.append(f"{i}\tCID\tD0\tD{rng.randrange(4)}{end}")
        out += [f"# note{end}"] * rng.randrange(0, 2) + [f"{i}\tx\t9\tbad\tChemical\tD1{end}"] + [end] * rng.randrange(0, 3)
    return "".join(out)


def whole(text):
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    out = []
    for line in lines:
        if line.startswith("#"):
            continue
        if corpus.is_title(line):
            out.append([])
        if out:
            out[-1].append(line)
    return [corpus.parse_block(b) for b in out]


def plain(r):
    return r.text, [tuple(e)[1:] for e in r.entities], [tuple(x) for x in r.relations]


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_any_cut_gives_the_same_blocks(spark, tmp_path, split):
    text = corpus_text(1, 12 if split < 64 else 60)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.txt").write_bytes(text.encode())
    (tmp_path / "in/README.txt").write_text("1|t|no\n")
    (tmp_path / "in/sub").mkdir()
    (tmp_path / "in/sub/two.txt.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "in/empty.txt").write_text("")
    want = [(b["text"], [(e["start"], e["end"], e["text"], e["type"], e["identifier"]) for e in b["entities"]], [(r["head"], r["tail"], r["type"]) for r in b["relations"]]) for b in whole(text)]
    if split < 64:  # every range in this process
        import io

        data, got = text.encode(), []
        for at in range(0, len(data), split):
            stream = io.BytesIO(data)
            stream.seek(max(at - 1, 0))
            got += [corpus.parse_block(lines) for _, lines in corpus.blocks(stream, at, at + split)]
        assert got == whole(text)
        return
    rows = readers.pubtator(spark, str(tmp_path / "in"), split)
    assert rows.rdd.getNumPartitions() >= 1
    for name in ("one.txt", "two.txt.gz"):
        mine = sorted((r for r in rows.collect() if r.file.endswith(name)), key=lambda r: r.block)
        assert [r.block for r in mine] == list(range(1, len(want) + 1))
        assert [plain(r) for r in mine] == want
        assert [r.start for r in mine] == sorted(r.start for r in mine)
    assert {r.file.rsplit("/", 1)[1] for r in rows.collect()} == {"one.txt", "two.txt.gz"}


def test_one_file_reads_in_many_tasks_and_filters_prune_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text(corpus_text(ord(name), 300))
    reader = corpus.BlockReader({"path": f"file://{tmp_path}", "splitBytes": "4096"})
    assert len(reader.partitions()) > 8 and len({r.file for r in reader.partitions()}) == 2
    spark.conf.set(corpus.PUSHDOWN, "true")
    try:
        rows = readers.pubtator(spark, str(tmp_path), 4096)
        one = rows.where(F.col("file") == f"file://{tmp_path}/a.txt")
        assert one.count() == 300 and rows.count() == 600
    finally:
        spark.conf.unset(corpus.PUSHDOWN)
    pruned = corpus.PrunedReader({"path": str(tmp_path)})
    rest = list(pruned.pushFilters([corpus.EqualTo(("file",), f"file://{tmp_path}/a.txt"), corpus.EqualTo(("block",), 3)]))
    assert [f.attribute for f in rest] == [("block",)] and {r.file for r in pruned.partitions()} == {f"file://{tmp_path}/a.txt"}


def test_documents_come_back(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{D}/documents.parquet'")
    got, want = more.corpus_blocks(spark, D).collect(), con.sql(more.SQL["corpus_blocks"]).fetchall()
    assert len(got) == len(want) > 0 and set(map(tuple, got)) == set(want)
    assert re.fullmatch("[0-9a-f]{32}", got[0].digest)
