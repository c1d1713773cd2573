"""Sequence surgery and statistics as expressions over (seq, qual, offset, strand)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabets import ALPHABETS, revcomp

DEFAULT_QUALITY = 40


def at(seq: Column, position: Column, offset: Column | int = 0) -> Column:
    """The letter at an absolute position."""
    return F.substring(seq, (position - offset + 1).cast("int"), F.lit(1))


def set_at(seq: Column, position: Column, letter: Column, offset: Column | int = 0) -> Column:
    return F.overlay(seq, letter, (position - offset + 1).cast("int"), F.lit(1))


def end_of(seq: Column, offset: Column | int = 0) -> Column:
    return F.length(seq) + offset


def set_error(qual: Column, position: Column, error: Column, offset: Column | int = 0) -> Column:
    """Scores with the one of an error probability at an absolute position."""
    from .quality import phred_of

    return F.transform(qual, lambda q, i: F.when(i == position - offset, phred_of(error)).otherwise(q))


def repeated(letter: Column, n: Column | int) -> Column:
    return F.repeat(letter, n if isinstance(n, Column) else F.lit(n))


def reverse_with(seq: Column, qual: Column | None = None) -> Column:
    """struct(seq, qual, strand) of the reversed letters and scores, which have no strand."""
    return F.struct(F.reverse(seq).alias("seq"), (F.reverse(qual) if qual is not None else F.lit(None).cast("array<smallint>")).alias("qual"), F.lit(0).cast("tinyint").alias("strand"))


def revcomp_with(seq: Column, qual: Column, strand: Column, alphabet: str = "DNA") -> Column:
    """struct(seq, qual, strand) of the other strand."""
    return F.struct(revcomp(seq, alphabet).alias("seq"), F.reverse(qual).alias("qual"), (-strand).cast("tinyint").alias("strand"))


def limited(text: Column, most: int) -> Column:
    """Up to `most` characters of a text."""
    return F.left(text, F.lit(most))


def append(seq: Column, more: Column) -> Column:
    return F.concat(seq, more)


def append_quality(qual: Column, more: Column) -> Column:
    """Scores with the default one for each letter of `more`."""
    return F.concat(qual, F.array_repeat(F.lit(DEFAULT_QUALITY).cast("smallint"), F.length(more)))


def truncate(seq: Column, start: Column, end: Column, offset: Column | int = 0, circular: Column | bool = False) -> Column:
    """[start, end) in absolute positions; on a circular sequence start may come after end. Null
    where the range isn't within the sequence."""
    a, b, n = start - offset, end - offset, F.length(seq)
    inside = (a >= 0) & (b >= 0) & (a <= n) & (b <= n)
    ring = circular if isinstance(circular, Column) else F.lit(circular)
    piece = lambda x, y: F.substring(seq, (x + 1).cast("int"), (y - x).cast("int"))
    return F.when(inside & (a <= b), piece(a, b)).when(inside & ring, F.concat(piece(a, n), piece(F.lit(0), b)))


def join(seq: Column, other: Column, where: str = "end") -> Column:
    """struct(seq, offset) of `other` put before (the offset is then minus its length) or after."""
    if where == "start":
        return F.struct(F.concat(other, seq).alias("seq"), (-F.length(other)).alias("offset"))
    return F.struct(F.concat(seq, other).alias("seq"), F.lit(0).alias("offset"))


def merged(features: Column) -> Column:
    """Sorted, overlapping or touching features of an array<struct<start, end>> as one each."""
    kind = "array<struct<start:int,end:int>>"
    ordered = F.array_sort(F.transform(features, lambda f: F.struct(f["start"].cast("int").alias("start"), f["end"].cast("int").alias("end"))))

    def add(out: Column, f: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], f["end"]).alias("end"))
        opens = (F.size(out) == 0) | (f["start"] > F.get(out, F.size(out) - 1)["end"])
        return F.when(opens, F.concat(out, F.array(f))).otherwise(F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown)))

    return F.when(F.size(ordered) > 0, F.aggregate(ordered, F.array().cast(kind), add)).otherwise(F.array().cast(kind))


def _clip(seq: Column, f: Column, offset) -> Column:
    a, b = F.greatest(f["start"] - offset, F.lit(0)), F.least(f["end"] - offset, F.length(seq))
    return F.when(b > a, F.substring(seq, (a + 1).cast("int"), (b - a).cast("int"))).otherwise("")


def stitch(seq: Column, features: Column, offset: Column | int = 0) -> Column:
    """Merged features, cut to the sequence, end to end."""
    return F.array_join(F.transform(merged(features), lambda f: _clip(seq, f, offset)), "")


def compose(seq: Column, features: Column, offset: Column | int = 0, alphabet: str = "DNA") -> Column:
    """Features (start, end, orient) in their order; those of orientation -1 reverse-complemented."""
    return F.array_join(F.transform(features, lambda f: F.when(f["orient"] == -1, revcomp(_clip(seq, f, offset), alphabet)).otherwise(_clip(seq, f, offset))), "")


def _counts(seq: Column, alphabet: str) -> list[Column]:
    low = F.lower(seq)
    return [(F.length(low) - F.length(F.replace(low, F.lit(c)))).cast("double") for c in ALPHABETS[alphabet].letters]


def _with_counts(seq: Column, alphabet: str, use) -> Column:
    """use(counts, their sum), with the sequence evaluated once and each letter counted once."""
    k = len(ALPHABETS[alphabet].letters)
    counted = F.transform(F.array(seq), lambda s: F.array(*_counts(s, alphabet)))
    return F.get(F.transform(counted, lambda c: use([F.get(c, F.lit(i)) for i in range(k)], F.aggregate(c, F.lit(0.0), lambda a, x: a + x))), F.lit(0))


def entropic_complexity(seq: Column, alphabet: str = "DNA") -> Column:
    """Minus the sum of n/N log_k n/N over letters; 0 for none."""
    import math

    def use(counts: list[Column], n: Column) -> Column:
        total = F.lit(0.0)
        for c in counts:
            total = total - F.when(c > 0, c / n * F.log(c / n) / math.log(len(counts))).otherwise(0.0)
        return F.when(n > 0, total).otherwise(0.0)

    return _with_counts(seq, alphabet, use)


def _ln_factorial(n: Column) -> Column:
    """Exact up to 10000, Stirling's series beyond."""
    steps = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(10000)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    far = n * F.log(n) - n + F.log(2 * 3.141592653589793 * n) / 2 + 1 / (12 * n)
    return F.when(n <= 10000, steps).otherwise(far)


def wf_complexity(seq: Column, alphabet: str = "DNA") -> Column:
    """1/N log_k of the number of sequences with the same composition."""
    import math

    def use(counts: list[Column], n: Column) -> Column:
        total = _ln_factorial(n)
        for c in counts:
            total = total - _ln_factorial(c)
        return F.when(n > 0, total / math.log(len(counts)) / n).otherwise(0.0)

    return _with_counts(seq, alphabet, use)


def z_complexity(seq: Column) -> Column:
    """Compressed bytes beyond an empty stream's, by letter. The compressor is zlib in an Arrow UDF."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def run(s):
        import zlib

        empty = len(zlib.compress(b"", 9))
        return s.map(lambda x: (len(zlib.compress(x.encode(), 9)) - empty) / len(x) if x else 0.0)

    return run(seq)


def wrap(seq: Column, width: int) -> Column:
    """Lines of `width` letters; 0 for one line."""
    return F.regexp_replace(seq, f"(?s)(.{{{width}}})(?=.)", "$1\n") if width else seq
