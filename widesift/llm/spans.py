"""Pattern matches with their places, as column expressions.

Java's matcher and its split agree on the matches, so the pieces between matches, and the matches themselves, give every
place by a running sum. Places are in code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: matches per stretch of the running sum; keeps the cost of very many matches in one text near-linear
STRETCH = 256
EMPTY = "array<struct<start:bigint,end:bigint,text:string,before:string>>"


def let(value: Column, body) -> Column:
    """Evaluates `value` once and hands it to `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, before=None) -> Column:
    """array<struct<start, end, text, before>> of the leftmost non-overlapping matches of a (Java) pattern that never matches nothing.

    `before` makes a string of all that stands between the match and the one before it, and of that one (null for the
    first match); without it the field is empty. A null text has no matches.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    none = F.array().cast(EMPTY)
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(_placed(F.split(text, pattern, -1), m, before)))


def _placed(gaps: Column, found: Column, before) -> Column:
    gaps = F.slice(gaps, 1, F.size(found))
    if before is None:
        gaps = F.transform(gaps, lambda g: F.struct(F.length(g).cast("bigint").alias("gap"), F.lit("").alias("before")))
    else:
        last = F.concat(F.array(F.lit(None).cast("string")), F.slice(found, F.lit(1), F.size(found) - 1))
        gaps = F.zip_with(gaps, last, lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), before(g, m).alias("before")))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(
        g["gap"].alias("gap"), F.length(m).cast("bigint").alias("long"), m.alias("text"), g["before"].alias("before")))

    def walk(steps: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / STRETCH).cast("int")),
                                lambda i: F.slice(steps, i * STRETCH + 1, F.lit(STRETCH)))
        # where each stretch begins: a running sum over a few numbers
        places = lambda sums: F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return let(stretches, lambda s: let(places(F.transform(s, total)), lambda at: F.flatten(F.transform(s, lambda part, i: scan(part, F.get(at, i))))))

    return let(steps, walk)


def total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x["gap"] + x["long"])


def scan(part: Column, base: Column) -> Column:
    first = F.struct(base.alias("at"), F.array().cast(EMPTY).alias("out"))
    return F.aggregate(part, first, lambda a, x: F.struct(
        (a["at"] + x["gap"] + x["long"]).alias("at"),
        F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["long"]).alias("end"),
                                          x["text"].alias("text"), x["before"].alias("before"))).alias("out")), lambda a: a["out"])


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs, comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def merged(spans: Column) -> Column:
    """The union of spans, sorted by start, as disjoint array<struct<start, end>>."""
    kind = "array<struct<start:bigint,end:bigint>>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"))))
    return F.aggregate(ordered, F.array().cast(kind), lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1),
                 F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.array_append(a, s)))


def replaced(text: Column, spans: Column, by: str) -> Column:
    """The text with every stretch that the spans cover replaced by one string."""
    def build(union: Column) -> Column:
        state = F.aggregate(union, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
                            lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(
                                text.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(by))).alias("out")))
        return let(state, lambda a: F.concat(F.array_join(a["out"], ""), text.substr((a["at"] + 1).cast("int"), F.length(text))))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(let(merged(spans), build))
