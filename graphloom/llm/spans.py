"""Positions of regular-expression matches with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(rows: Column, body) -> Column:
    """body(blocks) of an array's blocks of about sqrt(n) elements, so that what grows within a block stays short."""
    size = lambda r: F.greatest(F.ceil(F.sqrt(F.size(r))), F.lit(1)).cast("int")
    cut = lambda r, b: F.when(F.size(r) > 0, F.transform(F.sequence(F.lit(1), F.size(r), b), lambda i: F.slice(r, i, b))).otherwise(F.array(r))
    return let(rows, lambda r: let(cut(r, size(r)), body))


def find_spans(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """array<struct<s, e, g0, ...>> of leftmost non-overlapping non-empty matches, in code points, end exclusive.

    The text between matches (split) and the matches themselves (extract_all) alternate, so running lengths give the
    positions; both go through the same matcher. Lengths are summed a block of sqrt(n) matches first, so a text with very
    many matches costs n ** 1.5 short steps, not n ** 2.
    """
    gaps = F.split(text, pattern, -1)
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    whole = found[0] if groups[0] == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = let(whole, lambda w: F.arrays_zip(F.slice(gaps, 1, F.size(w)).alias("gap"), w.alias("m"), *[(w if x is whole else x).alias(f"g{i}") for i, x in enumerate(found)]))
    fields = [f"g{i}" for i in range(len(groups))]
    empty = F.array().cast("array<struct<s:int,e:int," + ",".join(f"{f}:string" for f in fields) + ">>")

    def step(a, x):
        s = a["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), *[x[f].alias(f) for f in fields]))).alias("out"))

    def placed(blocks):
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["m"])))
        starts = lambda t: F.transform(t, lambda _, j: F.aggregate(F.slice(t, F.lit(1), j), F.lit(0), lambda n, x: n + x))
        each = lambda o: F.zip_with(blocks, o, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), step)["out"])
        return let(sums, lambda t: let(starts(t), lambda o: F.flatten(each(o))))

    return F.when(text.rlike(pattern), in_blocks(rows, placed)).otherwise(empty)


def splice(text: Column, parts: Column) -> Column:
    """text with its spans parts(s, e, new), sorted and apart, replaced by `new`.

    A block of sqrt(n) spans is cut out of the text at once, so the text isn't walked from its start for each span.
    """

    def block(blocks, j):
        b = F.get(blocks, j)
        start = F.when(j > 0, F.element_at(F.get(blocks, j - 1), -1)["e"]).otherwise(F.lit(0))
        piece = lambda at: F.substr(text, (at + 1).cast("int"), (F.element_at(b, -1)["e"] - at).cast("int"))

        def step(sub, at):
            return lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["t"], F.array(F.substr(sub, (a["at"] - at + 1).cast("int"), (x["s"] - a["at"]).cast("int")), x["new"])).alias("t"))

        return let(start, lambda at: let(piece(at), lambda sub: F.array_join(F.aggregate(b, F.struct(at.alias("at"), F.array().cast("array<string>").alias("t")), step(sub, at))["t"], "")))

    done = in_blocks(parts, lambda blocks: F.array_join(F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda j: block(blocks, j)), ""))
    return F.when(F.size(parts) > 0, F.concat(done, F.substr(text, (F.element_at(parts, -1)["e"] + 1).cast("int"))))
