"""Spans and splices against Python's matcher, and on a text with very many matches."""

import random
import re
import time

from pyspark.sql import functions as F

from graphloom.llm import pii, secrets
from graphloom.llm.spans import find_spans, splice


def test_spans_and_splice(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "b1", "12", *["".join(rng.choice("ab1 é𝄞\n2") for _ in range(rng.randrange(0, 120))) for _ in range(200)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    spans = find_spans(F.col("text"), "([ab])([0-9]+)|é", (0, 2))
    got = {r.id: r.x for r in df.select("id", spans.alias("x")).collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), m.end(), m[0], m[2] or "") for m in re.finditer("([ab])([0-9]+)|é", t or "")]
        assert [(x.s, x.e, x.g0, x.g1 or "") for x in got[i] or []] == want
    marked = df.withColumn("p", F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("<"), x["g0"], F.lit(">")).alias("new"))))
    for r in marked.select("text", F.coalesce(splice(F.col("text"), F.col("p")), F.col("text")).alias("out")).collect():
        assert r.out == (None if r.text is None else re.sub("([ab])([0-9]+)|é", lambda m: f"<{m[0]}>", r.text))


def test_a_text_with_200_000_matches(spark):
    """Ten megabytes: spans, secrets and surrogates end in time."""
    text = " ".join(f"mail{i % 9000}x@example.org and token = secret{i:06d} so it goes on" for i in range(100_000))
    df = spark.createDataFrame([(1, text, "s", "en"), (2, "clean", "s", "en")], "doc_id long, text string, source string, lang string").coalesce(1)
    began = time.time()
    n = {r.doc_id: r.n for r in df.select("doc_id", F.size(find_spans(F.col("text"), "[a-z0-9]+@[a-z.]+|secret[0-9]+")).alias("n")).collect()}
    assert n == {1: 200_000, 2: 0} and time.time() - began < 60
    found = {r.doc_id: r.n_assign for r in secrets.digest(secrets.scan(df)).collect()}
    assert found == {1: 100_000, 2: 0}
    out = {r.doc_id: r for r in pii.anonymise(df).collect()}
    assert out[1].n_entities == 100_000 and "mail1x@example.org" not in out[1].text and out[2].text == "clean"
    assert time.time() - began < 240
