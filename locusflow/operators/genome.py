"""Chromosomes of assemblies, bands from karyotype files, and substitution matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lengths of chromosomes, in order.
HG19 = "Chr1 249250621,Chr2 243199373,Chr3 198022430,Chr4 191154276,Chr5 180915260,Chr6 171115067,Chr7 159138663,Chr8 146364022,Chr9 141213431,Chr10 135534747,Chr11 135006516,Chr12 133851895,Chr13 115169878,Chr14 107349540,Chr15 102531392,Chr16 90354753,Chr17 81195210,Chr18 78077248,Chr19 59128983,Chr20 63025520,Chr21 48129895,Chr22 51304566,ChrX 155270560,ChrY 59373566"
MM10 = "Chr1 195471971,Chr2 182113224,Chr3 160039680,Chr4 156508116,Chr5 151834684,Chr6 149736546,Chr7 145441459,Chr8 129401213,Chr9 124595110,Chr10 130694993,Chr11 122082543,Chr12 120129022,Chr13 120421639,Chr14 124902244,Chr15 104043685,Chr16 98207768,Chr17 94987271,Chr18 90702639,Chr19 61431566,ChrX 171031299,ChrY 91744698"
BT7 = "Chr1 161428367,Chr2 141965563,Chr3 126844711,Chr4 123809850,Chr5 125249322,Chr6 122519025,Chr7 113029157,Chr8 116846264,Chr9 108503706,Chr10 105982576,Chr11 109987751,Chr12 85119472,Chr13 84213851,Chr14 81216349,Chr15 84472747,Chr16 77710258,Chr17 76280064,Chr18 65811054,Chr19 64845320,Chr20 75686341,Chr21 69078422,Chr22 61598339,Chr23 52334015,Chr24 64508398,Chr25 44081797,Chr26 51826547,Chr27 48460478,Chr28 45964680,Chr29 51812796,ChrX 88654062,ChrY 43300181,ChrM 16338"
ASSEMBLIES = {"hg19": HG19, "mm10": MM10, "bt7": BT7}


def chromosomes(spark: SparkSession, assembly: str) -> DataFrame:
    """(id, ord, length) of an assembly."""
    rows = [x.split() for x in ASSEMBLIES[assembly].split(",")]
    return spark.createDataFrame([(name, i, int(n)) for i, (name, n) in enumerate(rows)], "id string, ord int, length long")


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, band, stain) of a cytogenetic band file: five columns, tab-separated. The
    hundreds of bands of an assembly are read from its published file, not kept here."""
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, band string, stain string")


def band_of(positions: DataFrame, bands: DataFrame, bin_size: int = 1 << 20) -> DataFrame:
    """positions (chrom, pos) with the band that holds them, or null."""
    bins = bands.select("chrom", "start", "end", "band", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))).alias("_bin"))
    own = positions.withColumn("_bin", F.floor(F.col("pos") / bin_size))
    met = (own["chrom"] == bins["chrom"]) & (own["_bin"] == bins["_bin"]) & (own["pos"] >= bins["start"]) & (own["pos"] < bins["end"])
    return own.join(bins, met, "left").select(*[own[c] for c in positions.columns], "band")


def parse_matrix(text: str, letters: str, gap: int = 0) -> list[list[int]]:
    """A substitution matrix in the index order of an alphabet, from the common text format: comments
    with #, a line of column letters, then a letter and its scores a line. Letters that the text
    lacks, and the gap, cost `gap`."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    head = [x.lower() for x in rows[0]]
    scores = {(r[0].lower(), c): int(float(x)) for r in rows[1:] for c, x in zip(head, r[1:], strict=True)}
    return [[scores.get((a, b), gap) if "-" not in (a, b) else gap for b in letters] for a in letters]


def identity_matrix(letters: str, match: int = 1, mismatch: int = -10000, gap: int = 0) -> list[list[int]]:
    """Matches and mismatches by rule; the gap, the first letter, costs `gap`."""
    return [[gap if "-" in (a, b) else match if a == b else mismatch for b in letters] for a in letters]
