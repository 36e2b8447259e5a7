"""Relations: cues, fact parsing, orientation, conflict types. Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The vocabulary of canonical relations and their polarity.
CANONICAL = ("causes", "treats", "interacts_with", "prevents", "reduces", "increases", "metabolized_by", "related_to", "unknown")
SEMANTIC = CANONICAL[:7]
EXACERBATING, AMELIORATING = ("causes", "increases"), ("treats", "prevents", "reduces")
WEAK = "related_to"

# Cues in order of test, their pattern over lower-case text, and their relation.
CUES = (
    ("metabolized by", "\\bmetaboli[zs]ed\\s+by\\b", "metabolized_by"),
    ("treats disease", "is used to treat|\\bused\\s+to\\s+treat\\b", "treats"),
    ("treated with", "\\btreat(ed)?\\s+with\\b", "treats"),
    ("interacts with", "\\binteract\\w*\\s+with\\b", "interacts_with"),
    ("increases risk", "\\bincrease\\w*\\s+the\\s+risk\\b|risk(.|\\n)*increas|increas(.|\\n)*risk", "increases"),
    ("prevents", "\\bprevents?\\b", "prevents"),
    ("causes adverse", "\\bcauses\\b|\\bcan\\s+cause\\b", "causes"),
    ("suppresses immune", "suppress(.|\\n)*immune|immune(.|\\n)*suppress", "causes"),
    ("reduces symptom", "\\breduce\\w*\\b|\\blowers?\\b|\\brelieve\\w*", "reduces"),
    ("increases effect", "\\bincrease\\w*\\b|\\braises\\b", "increases"),
    ("treats", "\\btreats?\\b", "treats"),
    ("regulates level", "\\bregulates\\b", "causes"),
    ("diuretic drug", "diuretic", "causes"),
)
GENERAL_CUE = "general relation"

# Verb phrases of facts in order of test, and their relation.
FACT_VERBS = (
    ("is metabolized by", "metabolized_by"), ("is used to treat", "treats"), ("can cause", "causes"),
    ("increases the risk of", "increases"), ("can reduce", "reduces"), ("interacts with", "interacts_with"),
    ("regulates", "causes"), ("relieves", "reduces"), ("suppress(?:es)? the immune system", "immune"), ("causes", "causes"),
    ("increases", "increases"), ("prevents", "prevents"), ("prevent", "prevents"), ("lowers?", "reduces"),
    ("reduces?", "reduces"), ("treats", "treats"),
)

# Parts of a relation that mean that its endpoints are the other way round.
PASSIVE = ("caused_by", "treated_by", "treats_by", "prevented_by", "prevents_by", "increased_by", "increases_by", "reduced_by", "reduces_by")
BY_PASSIVE = ("caused_by", "treated_by", "prevented_by", "increased_by", "reduced_by", "metabolized_by")
FORWARD = ("cause", "treat", "prevent", "increase", "reduce", "interact", "metaboliz", "associat")
# Labels of relation heads.
NEGATIVE_LABELS = ("NR", "NEGATIVE", "NO_RELATION", "NONE", "O", "FALSE", "NEG", "0", "LABEL_0")
POSITIVE_LABELS = ("POSITIVE", "TRUE", "1", "YES", "RELATION", "POS", "LABEL_1")


def _any(conditions) -> Column:
    return reduce(Column.__or__, conditions)


def cue(fact: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(fact, F.lit(""))))
    return T.let(t, lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(name)) for name, p, _ in CUES], F.lit(GENERAL_CUE)))


def cue_relation(cue_name: Column) -> Column:
    return T.let(cue_name, lambda c: F.coalesce(*[F.when(c == name, F.lit(r)) for name, _, r in CUES], F.lit(WEAK)))


def strip_article(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "(?i)^(the|a|an) ", "")


def parse_fact(fact: Column) -> Column:
    """struct<s, r, o> of a fact sentence that ends in a full stop, or null."""
    shape = lambda s, r, o: F.struct(F.trim(s).alias("s"), F.lit(r).alias("r"), o.alias("o"))

    def tried(t: Column) -> Column:
        diuretic = "(?is)^(.+?)\\s+is\\s+a\\s+diuretic\\s*\\.\\s*$"
        out = [F.when(t.rlike(diuretic), shape(F.regexp_extract(t, diuretic, 1), "causes", F.lit("diuretic")))]
        for verb, relation in FACT_VERBS:
            head = f"(?is)^(.+?)\\s+{verb.replace(' ', chr(92) + 's+')}"
            if relation == "immune":
                p = head + "\\s*\\.\\s*$"
                out.append(F.when(t.rlike(p), shape(F.regexp_extract(t, p, 1), "causes", F.lit("the immune system"))))
            else:
                p = head + "\\s+(.+?)\\s*\\.\\s*$"
                out.append(F.when(t.rlike(p), shape(F.regexp_extract(t, p, 1), relation, strip_article(F.regexp_extract(t, p, 2)))))
        return F.coalesce(*out)

    return T.let(F.trim(F.coalesce(fact, F.lit(""))), tried)


def _slug(relation: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(relation, F.lit("")))), "[ -]", "_")


def is_passive(relation: Column) -> Column:
    return T.let(
        _slug(relation),
        lambda r: _any([r.contains(p) for p in PASSIVE]) | r.endswith("_cause_of") | (r == "cause_of") | r.isin("metabolizes", "metabolize") | r.startswith("metabolizes_"),
    )


def is_forward(relation: Column) -> Column:
    return T.let(_slug(relation), lambda r: ~_any([r.contains(p) for p in BY_PASSIVE]) & _any([r.contains(p) for p in FORWARD]))


def preprocess(s: Column, r: Column, o: Column) -> Column:
    """struct<s, r, o>: endpoints of passive relations swapped, then scaffolding in the wrong slot swapped and stripped."""
    plain = F.struct(*[F.trim(F.coalesce(x, F.lit(""))).alias(n) for n, x in (("s", s), ("r", r), ("o", o))])
    turned = lambda x, test, end: F.struct(
        end(F.when(test, x["o"]).otherwise(x["s"])).alias("s"), x["r"].alias("r"), end(F.when(test, x["s"]).otherwise(x["o"])).alias("o")
    )
    wrong = lambda x: is_forward(x["r"]) & T.had_agentive(x["o"]) & ~T.had_agentive(x["s"])
    tested = lambda x, test: F.struct(x.alias("x"), test(x).alias("t"))
    swapped = T.let(plain, lambda x: T.let(tested(x, lambda v: is_passive(v["r"])), lambda y: turned(y["x"], y["t"], lambda e: e)))
    return T.let(swapped, lambda x: T.let(tested(x, wrong), lambda y: turned(y["x"], y["t"], T.strip_agentive)))


def upgrade_prevents(canonical: Column, raw: Column, preprocessed: Column) -> Column:
    said = F.lower(F.concat_ws(" ", F.coalesce(raw, F.lit("")), F.coalesce(preprocessed, F.lit(""))))
    treat = lambda t: t.rlike("\\btreat(?:ed|s|ing|ment)?\\b") | F.replace(t, F.lit(" "), F.lit("_")).rlike("treated_with|is_treated")
    return T.let(canonical, lambda c: F.when((F.lower(F.trim(c)) == "prevents") & T.let(said, treat), "treats").otherwise(c))


def fact_gold(relation: Column) -> Column:
    return T.let(F.lower(F.trim(relation)), lambda r: F.when(r.isin(*SEMANTIC), r))


def head_label(label: Column) -> Column:
    """The schema relation of a classifier's label; null drops the row."""
    u = T.relation_key(label)
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    negative = (u == "") | u.isin(*NEGATIVE_LABELS) | u.startswith("NOT_") | low.contains("no relation") | low.contains("not related")
    return (
        F.when(negative, F.lit(None)).when(u.contains("CID") | u.isin(*POSITIVE_LABELS), "causes")
        .when(u.startswith("LABEL_"), F.lit(None)).otherwise(F.regexp_replace(low, "[ -]", "_"))
    )


def conflict_type(r1: Column, p1: Column, r2: Column, p2: Column) -> Column:
    """Null where two edges agree. The order of tests is part of the meaning."""
    bad, good = (lambda r: r.isin(*EXACERBATING)), (lambda r: r.isin(*AMELIORATING))
    return (
        F.when((r1 == r2) & (p1 != p2), "polarity_clash_same_relation").when(r1 == r2, F.lit(None)).when(p1 != p2, "polarity_clash")
        .when((bad(r1) & good(r2)) | (good(r1) & bad(r2)), "semantic_polarity_clash")
        .when((r1.isin("increases", "reduces")) & (r2.isin("increases", "reduces")), "magnitude_polarity_clash")
        .otherwise("multi_relation_mismatch")
    )


def questions(s: Column, r: Column, o: Column) -> Column:
    """array of (question about the object, question about the subject)."""
    # What is asked, by relation.
    asked = {
        "causes": ("What does %s cause?", "What causes %s?"), "treats": ("What does %s treat?", "What drug treats %s?"),
        "prevents": ("What does %s prevent?", "What prevents %s?"), "reduces": ("What does %s reduce?", "What reduces %s?"),
        "increases": ("What does %s increase?", "What increases %s?"), "interacts_with": ("What does %s interact with?", "What interacts with %s?"),
        "metabolized_by": ("Which organ metabolizes %s?", "What drug is metabolized by the %s?"),
    }
    s, o = F.trim(s), F.trim(o)
    known = [F.when(r == k, F.array(F.format_string(a, s), F.format_string(b, o))) for k, (a, b) in asked.items()]
    other = F.array(F.concat(F.lit("What is linked to "), s, F.lit(" via "), r, F.lit("?")), F.concat(F.lit("What is linked to "), o, F.lit(" via "), r, F.lit("?")))
    return F.coalesce(*known, other)


# Relation phrases of facts in order of test, and the pattern over lower-case text.
PHRASES = (
    ("treats", "\\bis\\s+used\\s+to\\s+treat\\b"), ("interacts_with", "\\binteracts\\s+with\\b"),
    ("metabolized_by", "\\bis\\s+metaboli[zs]ed\\s+by\\b"), ("increases", "\\bincreases\\s+the\\s+risk\\s+of\\b"),
    ("causes", "\\bleads\\s+to\\b"), ("causes", "\\bcauses\\b"), ("prevents", "\\bprevent(s|ing)?\\b"),
    ("reduces", "\\breliev(es|e|ing)?\\b|\\blower(s|ing)?\\b|\\breduce(s|d|ing)?\\b"),
    ("treats", "\\btreat(s|ed|ing)?\\b"), ("increases", "\\bincreases\\b|\\braises\\b"),
)


def phrase(fact: Column) -> Column:
    """The relation phrase of a fact, to be embedded: a relation's name, or the whole fact in lower case."""
    t = F.lower(F.trim(F.coalesce(fact, F.lit(""))))
    return T.let(t, lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(name)) for name, p in PHRASES], x))


def phrase_words(text: Column) -> Column:
    """Lower case, signs as spaces, white space squeezed."""
    return T.squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?U)[^\\w\\s]", " "))


def type_bucket(label: Column) -> Column:
    """chemical, disease or other."""
    t = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    chemical, disease = t.contains("chemical") | t.isin("chem", "drug"), t.contains("disease") | t.contains("disorder") | (t == "dis")
    return F.when(chemical, "chemical").when(disease, "disease").otherwise("other")


def swapped(relation: Column, head: Column, tail: Column) -> Column:
    """Whether a disease "causes" a chemical, so that the ends are to be turned."""
    return (relation == "causes") & (type_bucket(head) == "disease") & (type_bucket(tail) == "chemical")


def oriented_row(s: Column, r: Column, o: Column, head: Column, tail: Column) -> Column:
    """struct(s, r, o) of an extractor's row in the question schema; null for a negative label or an empty end."""
    canon, a, b = head_label(r), T.squeeze(s), T.squeeze(o)
    turn = swapped(canon, head, tail)
    row = F.struct(F.when(turn, b).otherwise(a).alias("s"), canon.alias("r"), F.when(turn, a).otherwise(b).alias("o"))
    return F.when(canon.isNotNull() & (a != "") & (b != ""), row)


# The generator's relations by what a fact contains, in order of test, and its cuts between the ends.
MADE_RELATIONS = (
    ("treat", "treats"), ("prevent", "prevents"), ("interact", "interacts_with"), ("metabol", "metabolized_by"),
    ("increase", "increases"), ("risk of", "increases"), ("reduce", "reduces"), ("lower", "reduces"),
)
MADE_CUTS = (" treats ", " causes ", " prevents ", " reduces ", " lowers ", " increases ", " interacts with ", " is metabolized by ")


def made_relation(fact: Column) -> Column:
    low = F.lower(fact)
    return F.coalesce(*[F.when(low.contains(k), F.lit(r)) for k, r in MADE_RELATIONS], F.lit("causes"))


def made_ends(fact: Column) -> Column:
    """struct(s, o): the text around the first cut that the fact holds, else its first word and the rest."""
    t = F.regexp_replace(F.trim(fact), "[.]+$", "")

    def at(x: Column, cut: Column) -> Column:
        where = F.locate(cut, x) if isinstance(cut, str) else F.instr(x, cut)
        return F.struct(F.trim(F.substr(x, F.lit(1), where - 1)).alias("s"), F.trim(F.substr(x, where + len(cut))).alias("o"))

    tests = lambda x: [F.when(x.contains(c), at(x, c)) for c in MADE_CUTS]
    alone = lambda x: F.when(~x.contains(" "), F.struct(x.alias("s"), F.lit("unknown").alias("o")))
    return T.let(t, lambda x: F.coalesce(*tests(x), alone(x), at(x, " ")))


def made_questions(s: Column, r: Column, o: Column) -> Column:
    """array of (question, subject, relation, object, answer): one for each end."""
    said = F.replace(r, F.lit("_"), F.lit(" "))
    one = lambda q, a, b, answer: F.struct(q.alias("question"), a.alias("subject"), r.alias("relation"), b.alias("object"), answer.alias("answer"))
    what = F.when(r == "treats", F.concat(F.lit("What treats "), o, F.lit("?"))).otherwise(F.concat(F.lit("What is linked to "), o, F.lit(" via "), said, F.lit("?")))
    return F.array(one(F.concat(F.lit("What does "), s, F.lit(" "), said, F.lit("?")), s, F.lit("?"), o), one(what, F.lit("?"), o, s))
