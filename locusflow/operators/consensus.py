"""Columns and consensus of multiple alignments in long form (aln_id, row, pos, letter[, q])."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabets import ALPHABETS, letter_index


def cells(rows: DataFrame) -> DataFrame:
    """Cells of rows (aln_id, row, offset, seq[, qual])."""
    out = rows.select("aln_id", "row", "offset", F.posexplode(F.split("seq", "")).alias("i", "letter"), *(["qual"] if "qual" in rows.columns else []))
    keep = [F.get("qual", F.col("i")).alias("q")] if "qual" in rows.columns else []
    return out.where("letter <> ''").select("aln_id", "row", (F.col("offset") + F.col("i")).alias("pos"), "letter", *keep)


def majority(cells: DataFrame, alphabet: str = "DNA") -> DataFrame:
    """(aln_id, pos, letter, share): the most frequent valid letter of each column, the lowest index
    of several; the share is of all entries, gaps too."""
    idx = letter_index(F.col("letter"), alphabet)
    counts = cells.groupBy("aln_id", "pos", idx.alias("idx")).agg(F.count("*").alias("n"))
    best = counts.groupBy("aln_id", "pos").agg(F.max_by("idx", F.when(F.col("idx") >= 0, F.struct("n", (-F.col("idx")).alias("i")))).alias("idx"), F.max(F.when(F.col("idx") >= 0, F.col("n"))).alias("n"), F.sum("n").alias("of"))
    letters = ALPHABETS[alphabet].letters
    return best.where("n is not null").select("aln_id", "pos", F.substring(F.lit(letters), F.col("idx") + 1, F.lit(1)).alias("letter"), (F.col("n") / F.col("of")).alias("share"))


def by_quality(cells: DataFrame, alphabet: str = "DNA") -> DataFrame:
    """(aln_id, pos, letter, p): for each letter the product over the column of 1 - e for its own
    entries and e / (k - 1) for others, normalised; ties within 1e-10 give the ambiguous letter."""
    a = ALPHABETS[alphabet]
    k = len(a.letters)
    e = F.least(F.greatest(F.pow(F.lit(10.0), -F.col("q") / 10.0), F.lit(1e-300)), F.lit(1 - 1e-16))
    valid = cells.withColumn("idx", letter_index(F.col("letter"), alphabet)).where("idx >= 0")
    sums = [F.sum(F.when(F.col("idx") == i, F.log(1 - e)).otherwise(F.log(e / (k - 1)))).alias(f"s{i}") for i in range(k)]
    logs = valid.groupBy("aln_id", "pos").agg(*sums)
    top = F.greatest(*[f"s{i}" for i in range(k)])
    total = sum((F.exp(F.col(f"s{i}") - top) for i in range(1, k)), F.exp(F.col("s0") - top))
    ps = F.array(*[F.exp(F.col(f"s{i}") - top) / total for i in range(k)])
    out = logs.select("aln_id", "pos", ps.alias("ps")).withColumn("p", F.array_max("ps"))
    tied = F.size(F.filter("ps", lambda x: F.abs(x - F.array_max("ps")) < 1e-10)) > 1
    return out.select("aln_id", "pos", F.when(tied, a.ambiguous).otherwise(F.substring(F.lit(a.letters), F.array_position("ps", F.col("p")).cast("int"), F.lit(1))).alias("letter"), "p")


def scored(columns: DataFrame) -> DataFrame:
    """majority()'s columns with q, the Phred score of the share of other entries."""
    from ..functions.quality import phred_of

    return columns.withColumn("q", phred_of(1 - F.col("share")))


def masked(columns: DataFrame, threshold: int = 3, ambiguous: str = "n") -> DataFrame:
    """Columns with the ambiguous letter where q is below the threshold."""
    return columns.withColumn("letter", F.when(F.col("q") < threshold, F.lit(ambiguous)).otherwise(F.col("letter")))


def with_udaf(cells: DataFrame, choose, result: str = "string") -> DataFrame:
    """(aln_id, pos, letter) by any function of a column's letters in row order (a list of str): a
    UDF on gathered columns, for rules that expressions can't state. A column is one row."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(result)
    def run(letters):
        return letters.map(lambda x: choose(list(x)))

    ordered = cells.groupBy("aln_id", "pos").agg(F.array_sort(F.collect_list(F.struct("row", "letter"))).alias("x"))
    return ordered.select("aln_id", "pos", run(F.transform("x", lambda x: x["letter"])).alias("letter"))


def sequence_of(columns: DataFrame) -> DataFrame:
    """(aln_id, seq) of a consensus by column."""
    return columns.groupBy("aln_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("seq"))


def flush(rows: DataFrame, fill: str = "-") -> DataFrame:
    """Rows (aln_id, row, offset, seq) padded to a common start and end."""
    from pyspark.sql import Window

    w = Window.partitionBy("aln_id")
    start, end = F.min("offset").over(w), F.max(F.col("offset") + F.length("seq")).over(w)
    padded = F.concat(F.repeat(F.lit(fill), (F.col("offset") - start).cast("int")), F.col("seq"), F.repeat(F.lit(fill), (end - F.col("offset") - F.length("seq")).cast("int")))
    return rows.withColumn("_seq", padded).withColumn("_start", start).select("aln_id", "row", F.col("_start").alias("offset"), F.col("_seq").alias("seq"))


def pwm_hits(seqs: DataFrame, matrix: list[list[float]], least: float, letters: str = "acgt", strict_compat: bool = False) -> DataFrame:
    """(id, pos, score) of windows that a position weight matrix (rows: positions, columns: letters)
    gives at least `least`; the matrix is divided by the sum of its positions' maxima. Windows with
    other letters have no score. strict_compat: the last window is never tested."""
    top = sum(max(0.0, *row) for row in matrix)
    n = len(matrix)
    low = F.lower("seq")
    if strict_compat:
        low = F.left(low, F.length(low) - 1)
    windows = seqs.select("id", F.posexplode(F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).alias("pos", "w"))

    def at(i: int, row: list[float]):
        out = F.when(F.substring("w", i + 1, 1) == letters[0], float(row[0]) / top)
        for c, x in zip(letters[1:], row[1:], strict=True):
            out = out.when(F.substring("w", i + 1, 1) == c, float(x) / top)
        return out  # null for other letters, and so is the sum

    score = at(0, matrix[0])
    for i, row in enumerate(matrix[1:], 1):
        score = score + at(i, row)
    return windows.select("id", "pos", score.alias("score")).where(F.col("score") >= least)


def motif_table(matrix: list[list[float]], least: float, most: int = 1_000_000) -> list[tuple[float, tuple[int, ...], int]]:
    """(score, letter counts, motifs) of all motifs of at least `least`, by dynamic programming. States
    that can't reach it any more are dropped; more than `most` of them are an error."""
    top = sum(max(0.0, *row) for row in matrix)
    rest = [0.0]
    for row in reversed(matrix):
        rest.append(rest[-1] + max(row) / top)
    state = {(0.0, (0,) * len(matrix[0])): 1}
    for k, row in enumerate(matrix, 1):
        after: dict = {}
        for (s, counts), n in state.items():
            for i, x in enumerate(row):
                total = round(s + x / top, 12)
                if total + rest[len(matrix) - k] >= least - 1e-9:
                    key = (total, tuple(c + (i == j) for j, c in enumerate(counts)))
                    after[key] = after.get(key, 0) + n
        if len(after) > most:
            raise ValueError("the matrix has too many motifs above the least score")
        state = after
    return sorted(((s, c, n) for (s, c), n in state.items() if s >= least), reverse=True)


def motif_probability(table, score: float, frequencies: list[float]) -> float:
    """Chance of a motif of at least `score` in a window whose letters have these frequencies."""
    return sum(n * math.prod(f**c for f, c in zip(frequencies, counts, strict=True)) for s, counts, n in table if s >= score - 1e-12)
