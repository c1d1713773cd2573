"""Interval joins, islands, piles, gene structures and parent chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def overlap_join(a: DataFrame, b: DataFrame, bin_size: int, contained: bool = False) -> DataFrame:
    """Pairs (a_id, b_id) of overlapping rows of (id, loc, start, end), or of rows of a within rows
    of b. Rows are joined by bins; a pair counts in the bin of its overlap's start, so there is no
    distinct. bin_size should be about the usual length."""

    def binned(df: DataFrame, p: str) -> DataFrame:
        own = df.where("end > start").select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "loc", "start", "end")])
        first, last = F.floor(F.col(f"{p}_start") / bin_size), F.floor((F.col(f"{p}_end") - 1) / bin_size)
        return own.withColumn("bin", F.explode(F.sequence(first, last))).withColumnRenamed(f"{p}_loc", "loc")

    met = binned(a, "a").join(binned(b, "b"), ["loc", "bin"])
    met = met.where("a_start < b_end and b_start < a_end").where(F.floor(F.greatest("a_start", "b_start") / bin_size) == F.col("bin"))
    return (met.where("a_start >= b_start and a_end <= b_end") if contained else met).select("a_id", "b_id", "loc", "a_start", "a_end", "b_start", "b_end")


def _merged(rows: DataFrame, by: list[str], gap: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_o", (upto.isNull() | (F.col("start") > upto + gap)).cast("int"))
    marked = opened.withColumn("island", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


def islands(features: DataFrame, by: list[str], gap: int = 0, bin_size: int = 1024) -> DataFrame:
    """(by, island, start, end, n): overlapping or touching rows, or those up to `gap` apart.

    Rows are merged within bins of their start first, so a location with most of the rows is many
    tasks'; what is left, an island or more a bin, is merged by location."""
    rows = features.select(*by, "start", "end", F.floor(F.col("start") / bin_size).alias("_bin"), F.lit(1).cast("long").alias("n"))
    return _merged(_merged(rows, [*by, "_bin"], gap).select(*by, "start", "end", "n"), by, gap)


def coverage(features: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, covered): summed lengths, and places that at least one row covers."""
    rows = features.where("end > start")
    total = rows.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    return total.join(islands(rows, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("covered")), by)


def nearest_before(queries: DataFrame, features: DataFrame) -> DataFrame:
    """queries (id, loc, start) with the id and start of the last feature of the location that starts at
    or before them (of several the one with the largest id), or nulls: an as-of join."""
    q = queries.select("loc", "start", F.lit(1).alias("side"), F.col("id").alias("query"), F.lit(None).cast("struct<id:bigint,start:bigint>").alias("f"))
    f = features.select("loc", "start", F.lit(0).alias("side"), F.lit(None).cast("long").alias("query"), F.struct(F.col("id").cast("long").alias("id"), F.col("start").cast("long").alias("start")).alias("f"))
    w = Window.partitionBy("loc").orderBy("start", "side", "f.id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = q.unionByName(f).withColumn("last", F.last("f", ignorenulls=True).over(w)).where("side = 1")
    return found.select(F.col("query").alias("id"), "loc", "start", F.col("last.id").alias("near_id"), F.col("last.start").alias("near_start"))


def introns(exons: DataFrame, transcript: str = "transcript_id") -> DataFrame:
    """Gaps between a transcript's exons (start, end)."""
    w = Window.partitionBy(transcript).orderBy("start")
    return exons.withColumn("_p", F.lag("end").over(w)).where("_p < start").select(transcript, F.col("_p").alias("start"), F.col("start").alias("end"))


def transcript_summary(exons: DataFrame, transcript: str = "transcript_id") -> DataFrame:
    """Spliced length, extent, and whether exons start at 0 without overlap."""
    w = Window.partitionBy(transcript).orderBy("start")
    rows = exons.withColumn("_bad", (F.col("start") < F.lag("end").over(w)).cast("int"))
    return rows.groupBy(transcript).agg(F.sum(F.col("end") - F.col("start")).alias("spliced"), F.min("start").alias("start"), F.max("end").alias("end"), ((F.min("start") == 0) & (F.coalesce(F.sum("_bad"), F.lit(0)) == 0)).alias("valid"))


def untranslated(transcripts: DataFrame) -> DataFrame:
    """utr5 and utr3 ranges of (start, end, cds_start, cds_end, orient), by orientation."""
    first, last = F.struct(F.col("start").alias("start"), F.col("cds_start").alias("end")), F.struct(F.col("cds_end").alias("start"), F.col("end").alias("end"))
    forward = F.col("orient") == 1
    return transcripts.withColumn("utr5", F.when(forward, first).when(F.col("orient") == -1, last)).withColumn("utr3", F.when(forward, last).when(F.col("orient") == -1, first))


def _resolved(features: DataFrame, most: int) -> DataFrame:
    """(id, at, next, total, turn, error) of rows (id, start, orient, parent_id) followed to their roots:
    each round adds what lies between `at` and its own `at`, so a chain of n links takes log n joins."""
    rows = features.select("id", F.col("id").alias("at"), F.col("parent_id").alias("next"), F.col("start").cast("long").alias("total"), F.coalesce(F.col("orient").cast("int"), F.lit(0)).alias("turn"), F.lit(1).alias("links"), F.lit(None).cast("string").alias("error"))
    while True:
        if rows.where("next is not null and error is null").isEmpty():
            return rows
        up = rows.select(F.col("id").alias("_i"), *[F.col(c).alias(f"_{c}") for c in ("at", "next", "total", "turn", "links", "error")])
        met = rows.join(up, (F.col("next") == F.col("_i")) & F.col("error").isNull(), "left")
        links = F.col("links") + F.coalesce("_links", F.lit(0))
        bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("next").isNotNull() & F.col("_i").isNull(), "no such parent").when(links > most, "too many links").otherwise(F.col("_error"))
        # a parent without orientation ends the product, one without own orientation has none
        turn = F.when(F.col("_turn").isNull() | (F.col("turn") == 0) | (F.col("_turn") == 0), F.col("turn")).otherwise(F.col("turn") * F.col("_turn"))
        rows = cut(met.select("id", F.coalesce("_at", "at").alias("at"), F.when(bad.isNull(), F.col("_next")).alias("next"), (F.col("total") + F.coalesce("_total", F.lit(0))).alias("total"), turn.alias("turn"), links.alias("links"), bad.alias("error")))


def base_positions(features: DataFrame, most: int = 1000) -> DataFrame:
    """(id, base_id, base_start, base_orient, error) of rows (id, start, orient, parent_id): starts added
    and orientations multiplied up to the root, by pointer doubling. A parent without orientation
    ends the product. A missing parent and more than `most` links (as in a circle) are errors, with
    nulls for the rest."""
    found = _resolved(features, most)
    ok = F.col("error").isNull()
    return found.select("id", *[F.when(ok, F.col(c)).alias(n) for c, n in (("at", "base_id"), ("total", "base_start"), ("turn", "base_orient"))], "error")


def positions_within(features: DataFrame, reference, most: int = 1000) -> DataFrame:
    """(id, start_within, orient_within) of the rows below a feature `reference`, itself included: starts
    added and orientations multiplied up to it, but not its own; one without orientation on the way
    makes it 0. Rows that aren't below it don't come."""
    cut = features.withColumn("parent_id", F.when(F.col("id") == reference, None).otherwise(F.col("parent_id")))
    cut = cut.withColumns({"start": F.when(F.col("id") == reference, 0).otherwise(F.col("start")), "orient": F.when(F.col("id") == reference, 1).otherwise(F.col("orient"))})
    marked = cut.withColumn("orient", F.when(F.coalesce("orient", F.lit(0)) == 0, F.lit(2)).otherwise(F.col("orient")))  # 2: none; products of it are even
    found = _resolved(marked, most).where((F.col("at") == reference) & F.col("error").isNull())
    return found.select("id", F.col("total").alias("start_within"), F.when(F.col("turn") % 2 == 0, 0).otherwise(F.col("turn")).alias("orient_within"))


def coding(transcripts: DataFrame) -> DataFrame:
    """untranslated() with the coding range, and the lengths of the three parts."""
    parts = untranslated(transcripts).withColumn("cds", F.struct(F.col("cds_start").alias("start"), F.col("cds_end").alias("end")))
    return parts.withColumns({f"{c}_length": F.col(f"{c}.end") - F.col(f"{c}.start") for c in ("utr5", "cds", "utr3")})


def of_kind(features: DataFrame, kinds: tuple[str, ...] = ("coding", "noncoding"), kind: str = "kind") -> DataFrame:
    """The features of some kinds, such as the transcripts of a gene."""
    return features.where(F.col(kind).isin(*kinds))


def unordered_pairs(pairs: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """One row for each unordered pair."""
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
