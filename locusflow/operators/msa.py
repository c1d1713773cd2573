"""Multiple alignments as rows (aln_id, row, offset, seq): surgery of whole sets of rows.

Rows may start and end anywhere; a set's extent is from its smallest offset to its largest end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.alphabets import revcomp as _revcomp
from .consensus import cells, flush


def _ends(rows: DataFrame) -> DataFrame:
    whole = Window.partitionBy("aln_id")
    return rows.withColumns({"_start": F.min("offset").over(whole), "_end": F.max(F.col("offset") + F.length("seq")).over(whole)})


def is_flush(rows: DataFrame) -> DataFrame:
    """(aln_id, starts, ends): whether all rows start, or end, together."""
    end = F.col("offset") + F.length("seq")
    return rows.groupBy("aln_id").agg((F.min("offset") == F.max("offset")).alias("starts"), (F.min(end) == F.max(end)).alias("ends"))


def subseq(rows: DataFrame, start: int, end: int) -> DataFrame:
    """The rows' parts in [start, end); rows without any are empty, at its start."""
    a, b = F.greatest(F.col("offset"), F.lit(start)), F.least(F.col("offset") + F.length("seq"), F.lit(end))
    piece = F.when(b > a, F.substring("seq", (a - F.col("offset") + 1).cast("int"), (b - a).cast("int"))).otherwise("")
    return rows.select("aln_id", "row", F.when(b > a, a).otherwise(F.lit(start)).alias("offset"), piece.alias("seq"))


def join(a: DataFrame, b: DataFrame, fill: str = "-") -> DataFrame:
    """Both sets made flush and put end to end, row by row. Rows that only one of them has have a null
    sequence."""
    x, y = flush(a, fill), flush(b, fill).select("aln_id", "row", F.col("seq").alias("_more"))
    return x.join(y, ["aln_id", "row"], "full_outer").select("aln_id", "row", "offset", F.concat("seq", "_more").alias("seq"))


def stitch(rows: DataFrame, features: Column, fill: str = "-") -> DataFrame:
    """Each row's parts in the merged features (array<struct<start, end>>), from a flush set."""
    return flush(rows, fill).select("aln_id", "row", F.lit(0).alias("offset"), S.stitch(F.col("seq"), features, F.col("offset")).alias("seq"))


def compose(rows: DataFrame, features: Column, alphabet: str = "DNA", fill: str = "-") -> DataFrame:
    """Each row's parts in the features (start, end, orient) in their order, from a flush set."""
    return flush(rows, fill).select("aln_id", "row", F.lit(0).alias("offset"), S.compose(F.col("seq"), features, F.col("offset"), alphabet).alias("seq"))


def append(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Letters (aln_id, row, more) put behind each row; rows without any stay."""
    return rows.join(more.select("aln_id", "row", F.col("more").alias("_more")), ["aln_id", "row"], "left").select("aln_id", "row", "offset", F.concat("seq", F.coalesce("_more", F.lit(""))).alias("seq"))


def add(rows: DataFrame, more: DataFrame, fill: str = "-") -> DataFrame:
    """rows with further ones, which are cut to the extent of the set and filled up to it."""
    extent = rows.groupBy("aln_id").agg(F.min("offset").alias("_a"), F.max(F.col("offset") + F.length("seq")).alias("_b"))
    met = more.join(extent, "aln_id")
    a, b = F.greatest("offset", "_a"), F.least(F.col("offset") + F.length("seq"), F.col("_b"))
    piece = F.when(b > a, F.substring("seq", (a - F.col("offset") + 1).cast("int"), (b - a).cast("int"))).otherwise("")
    left = F.when(b > a, a - F.col("_a")).otherwise(F.lit(0)).cast("int")
    filled = F.concat(F.repeat(F.lit(fill), left), piece)
    filled = F.rpad(filled, (F.col("_b") - F.col("_a")).cast("int"), F.lit(fill))
    return rows.select("aln_id", "row", "offset", "seq").unionByName(met.select("aln_id", "row", F.col("_a").alias("offset"), filled.alias("seq")))


def delete(rows: DataFrame, row: Column) -> DataFrame:
    """The set without rows for which a condition holds."""
    return rows.where(~F.coalesce(row, F.lit(False)))


def set_offset(rows: DataFrame, offset: int) -> DataFrame:
    """The set moved, so that its extent starts at offset."""
    return _ends(rows).select("aln_id", "row", (F.col("offset") - F.col("_start") + offset).alias("offset"), "seq")


def revcomp(rows: DataFrame, alphabet: str = "DNA") -> DataFrame:
    """Each row's other strand, mirrored within the extent of the set."""
    return _ends(rows).select("aln_id", "row", (F.col("_start") + F.col("_end") - F.col("offset") - F.length("seq")).alias("offset"), _revcomp(F.col("seq"), alphabet).alias("seq"))


def columns(rows: DataFrame, fill: str | None = None) -> DataFrame:
    """(aln_id, pos, letters): each column's letters by row; fill: a letter for rows that don't reach it."""
    table = cells(flush(rows, fill) if fill else rows)
    return table.groupBy("aln_id", "pos").agg(F.array_sort(F.collect_list(F.struct("row", "letter"))).alias("x")).select("aln_id", "pos", F.array_join(F.transform("x", lambda x: x["letter"]), "").alias("letters"))


def consensus(rows: DataFrame, choose: Callable[[DataFrame], DataFrame], fill: str | None = None) -> DataFrame:
    """What a function of cells (aln_id, row, pos, letter) makes of a set, such as consensus.majority."""
    return choose(cells(flush(rows, fill) if fill else rows))
