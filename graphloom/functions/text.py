"""Text normalisation as Column -> Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Leading scaffolding of passive spans.
AGENTIVE = (
    "caused by", "prevented by", "triggered by", "induced by", "mediated by", "treat(?:ed|ing)? with", "managed with",
    "managed by", "due to", "metabolized by", "metabolised by", "increased by", "reduced by", "associated with",
)
# Words that are never a head, generic nodes and generic objects.
HEAD_STOPS = ("the", "a", "an", "of", "in", "on", "to", "for", "with", "and", "or", "by")
GENERIC_NODES = ("condition", "drug", "high", "low", "risk", "effect")
GENERIC_OBJECTS = (
    "patient", "patients", "person", "people", "a patient", "the patient", "a person", "the person", "drug", "a drug",
    "the drug", "medication", "a medication", "the medication", "medicine", "a medicine", "the medicine",
)

ASCII = "^[\\x00-\\x7F]*$"
AGENTIVE_PREFIX = "(?i)^(?:\\s*(?:" + "|".join(x.replace(" ", "\\s+") for x in AGENTIVE) + ")\\s+){1,4}"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it and wherever the optimiser moves it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


@F.udf(StringType(), useArrow=False)
def nfkd(text: str | None) -> str | None:
    """A hundred rows go to Python at a time, where Arrow would take ten thousand whole texts."""
    return text if text is None else unicodedata.normalize("NFKD", text)


def rewrite_domain(surface: Column) -> Column:
    hit = lambda x: x.contains("bleeding") & (x.contains("stomach") | x.contains("gastric"))
    return let(surface, lambda x: F.when(hit(x), "gastric bleeding").otherwise(x))


def normalize_surface(text: Column, decomposed: bool = False) -> Column:
    """Lower-case ASCII letters, digits and single spaces. Letters outside ASCII must be decomposed first (nfkd)."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]+", " ")
    return rewrite_domain(squeeze(t))


def with_surface(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the normalised surface of a column: only rows outside ASCII pass through Python."""
    plain = F.coalesce(F.col(column), F.lit("")).rlike(ASCII)
    ascii_rows = df.where(plain).withColumn(name, normalize_surface(F.col(column)))
    other = df.where(~plain).withColumn(name, normalize_surface(nfkd(F.col(column))))
    return ascii_rows.unionByName(other)


def strip_agentive(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), AGENTIVE_PREFIX, ""))


def had_agentive(text: Column) -> Column:
    return let(F.trim(F.coalesce(text, F.lit(""))), lambda x: strip_agentive(x) != x)


def canonical_entity(text: Column) -> Column:
    return normalize_surface(strip_agentive(text))


def surfaces_align(a: Column, b: Column) -> Column:
    long = (F.length(a) >= 3) & (F.length(b) >= 3)
    return (a == b) | (long & (a.contains(b) | b.contains(a)))


def strip_enumeration(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "^\\s*\\d+[.):]\\s*", "")
    return F.trim(F.regexp_replace(t, "^\\s*\\d+\\s+", ""))


def validity_surface(text: Column) -> Column:
    return strip_agentive(strip_enumeration(text))


def content_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def numeric_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit("[0-9]")) / n).otherwise(F.lit(0.0))


def stopword_ratio(tokens: Column, stops: tuple[str, ...] = ()) -> Column:
    if not stops:
        return F.when(F.size(tokens) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    hits = F.size(F.filter(tokens, lambda x: x.isin(*stops)))
    return F.when(F.size(tokens) == 0, F.lit(1.0)).otherwise(hits / F.size(tokens))


def drop_reason(text: Column, stops: tuple[str, ...] = ()) -> Column:
    """Why an entity is no entity, or ok. Without stop words (the default) their rules never fire."""

    def rules(v: Column) -> Column:
        t, tokens = v["t"], v["w"]
        ratio = stopword_ratio(tokens, stops)
        return (
            F.when(t == "", "empty").when(F.length(t) < 3, "too_short").when(F.size(tokens) == 0, "no_content_tokens")
            .when(tokens[0].rlike("^[0-9]+$"), "leading_numeric_token").when(numeric_ratio(t) >= 0.45, "numeric_heavy")
            .when((F.size(tokens) == 1) & (ratio >= 1.0), "single_stopword_token")
            .when((ratio >= 0.72) & (F.size(tokens) <= 4), "stopword_heavy").otherwise("ok")
        )

    return let(validity_surface(text), lambda t: let(F.struct(t.alias("t"), content_tokens(t).alias("w")), rules))


def generic_object(text: Column) -> Column:
    t = F.lower(validity_surface(text))
    return (t == "") | t.isin(*GENERIC_OBJECTS)


def low_value_node(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (t == "") | t.isin(*GENERIC_NODES) | (F.length(t) <= 2) | t.rlike("^[0-9]+$")


def qa_entity(text: Column, lower: bool = True) -> Column:
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "^\\d[\\d.:]*(?=[^\\d.:])[.: ]*", "")
    return F.lower(t) if lower else t


def relation_key(text: Column) -> Column:
    return F.upper(F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit("_")))


def mapper_key(text: Column) -> Column:
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


def is_ontology_id(text: Column) -> Column:
    return F.upper(F.trim(F.coalesce(text, F.lit("")))).rlike("^(MESH:.*|[CD][0-9]+)$")


def headword(surface: Column) -> Column:
    """The head of a normalised surface: bleeding if it is there, else the last word that is no stop word."""
    words = F.filter(F.split(surface, " "), lambda x: (x != "") & ~x.isin(*HEAD_STOPS))
    return F.when(F.array_contains(words, "bleeding"), "bleeding").otherwise(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))


def lexically_contains(a: Column, b: Column) -> Column:
    return (a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (a.contains(b) | b.contains(a)))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]\\s+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def triple_line(line: Column) -> Column:
    """struct<s, r, o> of "s | r | o" or "s | o"; null where the line holds none."""
    p = F.transform(F.split(F.trim(line), "\\|", 3), lambda x: F.trim(x))
    three = F.struct(p[0].alias("s"), F.when(p[1] == "", "related_to").otherwise(p[1]).alias("r"), F.get(p, F.lit(2)).alias("o"))
    two = F.struct(p[0].alias("s"), F.lit("related_to").alias("r"), F.get(p, F.lit(1)).alias("o"))
    found = F.when(F.size(p) == 3, three).when(F.size(p) == 2, two)
    return F.when((F.lower(F.trim(line)) != "none") & (p[0] != ""), found)


def answer_line(text: Column) -> Column:
    """The first line of a model's answer, without its label and quotes; unknown is empty."""
    first = F.trim(F.split(F.trim(F.coalesce(text, F.lit(""))), "\n")[0])
    label = "(?i)^(?:answer|the answer|result)\\s*:"
    bare = F.when((F.length(first) < 200) & first.rlike(label), F.trim(F.regexp_replace(first, label, ""))).otherwise(first)
    bare = F.regexp_replace(F.regexp_replace(F.trim(bare), '^"+|"+$', ""), "^'+|'+$", "")
    return F.when(F.lower(first).startswith("unknown"), "").otherwise(bare)


def first_span(text: Column, needle: Column) -> Column:
    at = F.instr(F.lower(text), F.lower(needle)) - 1
    return F.when((at >= 0) & (needle != ""), F.struct(at.alias("start"), (at + F.length(needle)).alias("end")))


def mark_entities(text: Column, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Both spans in [E1]/[E2] marks, by offset order."""
    cut = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
    one = F.concat(cut(F.lit(0), s1), F.lit("[E1] "), cut(s1, e1), F.lit(" [/E1]"), cut(e1, s2), F.lit("[E2] "), cut(s2, e2), F.lit(" [/E2]"), cut(e2, F.length(text)))
    two = F.concat(cut(F.lit(0), s2), F.lit("[E2] "), cut(s2, e2), F.lit(" [/E2]"), cut(e2, s1), F.lit("[E1] "), cut(s1, e1), F.lit(" [/E1]"), cut(e1, F.length(text)))
    return F.when(s1 <= s2, one).otherwise(two)


PLACEHOLDER = "\\b(?:Drug|Condition)\\d+\\b"


def has_placeholder(text: Column) -> Column:
    return F.coalesce(text.rlike(PLACEHOLDER), F.lit(False))


def guarded(text: Column) -> Column:
    """The text; a placeholder entity in it ends the query with an error."""
    return F.when(has_placeholder(text), F.raise_error(F.concat(F.lit("placeholder entity in: "), text))).otherwise(text)


# Names that a picture of the graph leaves out.
NOISE = ("a drug", "the drug", "drug", "drugs", "medication", "medications", "patients", "patient", "people", "some patients")


def display_noise(text: Column) -> Column:
    """Whether a picture of the graph leaves the entity out."""
    return let(normalize_surface(F.coalesce(text, F.lit(""))), lambda x: (F.length(x) < 2) | x.isin(*NOISE) | x.startswith("patients ") | x.startswith("patient "))


def semantic_equal(a: Column, b: Column, similarity: Column, least: float = 0.85) -> Column:
    """Non-empty, and of one surface or as similar as `least`; similarity: a cosine, null where there is none."""
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    same = normalize_surface(x) == normalize_surface(y)
    return (x != "") & (y != "") & (same | (F.coalesce(similarity, F.lit(0.0)) >= least))


def tag_type(tag: Column, groups: dict[str, str]) -> Column:
    """A mention's type: the first of several, 30 characters of it; type identifiers by their group, others OTHER."""
    first = F.substring(F.trim(F.split(F.coalesce(tag, F.lit("")), ",")[0]), 1, 30)
    named = F.coalesce(*[F.when(first == k, F.lit(v)) for k, v in groups.items()], F.lit("OTHER"))
    return F.when(first.rlike("^T\\d+$"), named).otherwise(first)


def overlap_words(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
