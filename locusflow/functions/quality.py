"""Quality scores: probabilities, scales, text encodings, masking and trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinels (p = 0 and no value) of the two scales, and offsets of text encodings.
PHRED_INF, PHRED_NAN = 254, 255
SOLEXA_INF, SOLEXA_NAN = 127, -128
OFFSETS = {"sanger": 33, "solexa": 64, "illumina1.3": 64, "illumina1.5": 64, "illumina1.8": 33, "illumina1.9": 33}
_SOLEXA_TEXT = ("solexa",)


def _half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def phred_error(q: Column) -> Column:
    """Probability of error of a Phred score."""
    return F.when(q == PHRED_INF, F.lit(0.0)).when(q == PHRED_NAN, F.lit(float("nan"))).otherwise(F.pow(F.lit(10.0), -q / 10.0))


def phred_of(p: Column) -> Column:
    score = F.floor(-10 * F.log10(p) + 0.5)
    return F.when(F.isnan(p), PHRED_NAN).when(p <= 0, PHRED_INF).otherwise(F.least(score, F.lit(PHRED_INF))).cast("smallint")


def solexa_error(q: Column) -> Column:
    odds = F.pow(F.lit(10.0), -q / 10.0)
    return F.when(q == SOLEXA_INF, F.lit(0.0)).when(q == SOLEXA_NAN, F.lit(float("nan"))).otherwise(odds / (1 + odds))


def solexa_of(p: Column) -> Column:
    score = _half_away(-10 * F.log10(p / (1 - p)))
    return F.when(F.isnan(p), SOLEXA_NAN).when(p <= 0, SOLEXA_INF).when(p >= 1, SOLEXA_NAN + 1).otherwise(F.greatest(F.lit(-127), F.least(F.lit(126), score))).cast("smallint")


def phred_to_solexa(q: Column) -> Column:
    return F.when(q == PHRED_INF, SOLEXA_INF).when(q == PHRED_NAN, SOLEXA_NAN).when(q == 0, -127).otherwise(F.least(F.lit(126), _half_away(10 * F.log10(F.pow(F.lit(10.0), q / 10.0) - 1)))).cast("smallint")


def solexa_to_phred(q: Column) -> Column:
    return F.when(q == SOLEXA_INF, PHRED_INF).when(q == SOLEXA_NAN, PHRED_NAN).otherwise(F.floor(10 * F.log10(F.pow(F.lit(10.0), q / 10.0) + 1) + 0.5)).cast("smallint")


def decode(text: Column, encoding: str = "sanger") -> Column:
    """Phred scores of a quality text. Solexa scores are converted."""
    offset = OFFSETS[encoding.lower()]
    one = lambda c: (F.ascii(c) - offset).cast("smallint")
    scores = F.transform(F.split(text, ""), (lambda c: solexa_to_phred(one(c))) if encoding.lower() in _SOLEXA_TEXT else one)
    return F.when(F.length(text) == 0, F.array().cast("array<smallint>")).otherwise(scores)


def encode(scores: Column, encoding: str = "sanger") -> Column:
    """Quality text of Phred scores: infinity is ~, no value is a space; Illumina 1.5 has no score
    below 2 (B)."""
    offset = OFFSETS[encoding.lower()]

    def one(q: Column) -> Column:
        value = phred_to_solexa(q) if encoding.lower() in _SOLEXA_TEXT else F.greatest(q, F.lit(2)) if encoding.lower() == "illumina1.5" else q
        return F.when(q == PHRED_INF, "~").when(q == PHRED_NAN, " ").otherwise(F.char(F.least(value.cast("int") + offset, F.lit(126))))

    return F.array_join(F.transform(scores, one), "")


def mask(seq: Column, scores: Column, threshold: int = 3, ambiguous: str | None = "n", gap: str = "-") -> Column:
    """Letters below the threshold become `ambiguous`, or change to lower case if that is None
    (others to upper case); gaps stay."""

    def one(letter: Column, q: Column) -> Column:
        low = q < threshold
        out = F.when(low, F.lit(ambiguous)).otherwise(letter) if ambiguous is not None else F.when(low, F.lower(letter)).otherwise(F.upper(letter))
        return F.when(letter == gap, letter).otherwise(out)

    return F.array_join(F.zip_with(F.split(seq, ""), scores, one), "")


def trim(scores: Column, limit: float = 0.05) -> Column:
    """struct(start, end) of the part that the modified Mott rule keeps: sums of limit minus the
    probability of error start again below 0, and the part ends where they are largest. Errors are
    in whole billionths, so sums don't depend on rounding."""
    scale = 1_000_000_000
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("best"), F.lit(0).alias("from"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("i"))

    def step(s: Column, q: Column) -> Column:
        total = s["sum"] + F.lit(round(limit * scale)).cast("long") - F.round(phred_error(q) * scale).cast("long")
        falls, tops = total < 0, total >= s["best"]
        return F.struct(
            F.when(falls, F.lit(0).cast("long")).otherwise(total).alias("sum"),
            F.when(~falls & tops, total).otherwise(s["best"]).alias("best"),
            F.when(falls, s["i"] + 1).otherwise(s["from"]).alias("from"),
            F.when(~falls & tops, s["from"]).otherwise(s["start"]).alias("start"),
            F.when(~falls & tops, s["i"] + 1).otherwise(s["end"]).alias("end"),
            (s["i"] + 1).alias("i"),
        )

    return F.aggregate(scores, state, step, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
