"""Places of regular expressions in texts, with Spark's functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
STEP = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: it is bound to a lambda's variable, where a column that a
    lambda refers to may be put in its place and evaluated for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def steps_of(items: Column) -> Column:
    """An array cut into arrays of STEP items; none for an empty one."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / STEP), F.lit(0)).cast("int")), lambda k: F.slice(items, k * STEP + 1, F.lit(STEP)))
    return F.filter(cut, lambda own: F.size(own) > 0)


def before_sums(numbers: Column) -> Column:
    """For each of an array of ints the sum of those before it. Steps are summed first, and a number's
    sum is that of the steps before and of the numbers before it in its own: a sum from the start for
    each would be quadratic."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def inside(steps: Column, sums: Column) -> Column:
        return F.flatten(F.transform(steps, lambda own, k: let(total(F.slice(sums, F.lit(1), k)), lambda first: F.transform(own, lambda _, i: first + total(F.slice(own, F.lit(1), i))))))

    return let(numbers, lambda all_: let(steps_of(all_), lambda steps: let(F.transform(steps, total), lambda sums: inside(steps, sums))))


def with_matches(df: DataFrame, text: str, name: str, pattern: str, near: int, guard: Column | None = None) -> DataFrame:
    """df with `name`: an array of SPAN structs, the leftmost matches without overlap, in order.

    The text is cut at its matches; lengths of the pieces give places in code points. before and
    after are up to `near` code points beside a match, without other matches. A match is never
    empty. guard: texts where it isn't true are known to have none. Quantifiers in patterns over
    unbounded input should be possessive, so that no match recurses."""

    def spans(found: Column, pieces: Column, before: Column) -> Column:
        def span(value: Column, i: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(pieces, i))
            return F.struct(F.lit(name).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.right(F.get(pieces, i), F.lit(near)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(near)).alias("after"))

        return F.transform(found, span)

    def placed(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda pieces: let(before_sums(F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))), lambda before: spans(found, pieces, before)))

    none = F.array().cast(SPAN)
    made = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))
    hit = F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True)
    return df.withColumn(name, F.when(hit, made).otherwise(none).cast(SPAN))


def overlaps(own: Column, start: Column, end: Column) -> Column:
    """Whether a range meets one of an array of spans that are in order and don't overlap. The last
    span that starts before the range's end decides; it is found by steps."""

    def last(steps: Column) -> Column:
        number = F.size(F.filter(steps, lambda x: F.get(x, F.lit(0))["start"] < end))
        return let(F.get(steps, number - 1), lambda mine: F.get(mine, F.size(F.filter(mine, lambda x: x["start"] < end)) - 1)["end"] > start)

    return F.coalesce(last(own), F.lit(False))
