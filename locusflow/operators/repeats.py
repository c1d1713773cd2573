"""Repeat finding beyond the seed filter: trapezoids of hits, packed coordinates, filter parameters
and piles of intervals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the method: bins and the least padding of a packed sequence, longest and shortest
# word, the most places a word may have on average, and how much wider than its errors a tube is
BIN, LEAST_PAD = 1024, 50
LONGEST_WORD, SHORTEST_WORD = 15, 4
MOST_PLACES = 15
TUBE_MARGIN = 32


def trapezoids_of(hits, k: int, tube_offset: int, max_error: int, self_align: bool = False) -> list[tuple[int, int, int, int]]:
    """(bottom, top, left, right), by bottom, of hits (from, to, diagonal).

    A sweep over rising `from` keeps open trapezoids sorted by their diagonals. A hit first closes
    those on its way that ended more than k + 2 before it, then widens the first one within reach,
    which may close the gap to a neighbour, or opens a new one in its place."""
    reach = tube_offset + max_error - 1
    active: list[list[int]] = []
    closed: list[list[int]] = []
    for bottom, top, diagonal in sorted(hits):
        left = -diagonal
        if self_align and left <= max_error:
            continue
        at = 0
        while at < len(active):
            if bottom - (k + 2) > active[at][1]:
                closed.append(active.pop(at))
            elif left - 2 > active[at][3]:
                at += 1
            else:
                break
        if at == len(active) or left + reach + 2 < active[at][2]:
            active.insert(at, [bottom, top, left, left + reach])
            continue
        mine = active[at]
        mine[1:] = max(mine[1], top), min(mine[2], left), max(mine[3], left + reach)
        for i in (at, at + 1):  # with the one before, or else with the one behind
            if 0 < i < len(active) and active[i - 1][3] + 2 >= active[i][2]:
                a, b = active[i - 1], active.pop(i)
                a[:] = min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])
                break
    return sorted(map(tuple, closed + active))


def trapezoids(hits: DataFrame, by: list[str], k: int, tube_offset: int, max_error: int, self_align: bool = False) -> DataFrame:
    """(by, bottom, top, left, right) of hits (by, from, to, diagonal). The sweep needs the hits of
    one target, query and strand in order, so `by` must tell these apart."""
    fields = [f for f in hits.schema.fields if f.name in by]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", bottom long, top long, left long, right long"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = trapezoids_of(part[["from", "to", "diagonal"]].itertuples(index=False, name=None), k, tube_offset, max_error, self_align)
        out = pd.DataFrame(found, columns=["bottom", "top", "left", "right"])
        for i, f in enumerate(fields):
            out.insert(i, f.name, part[f.name].iloc[0])
        return out

    return hits.groupBy(*by).applyInPandas(run, schema)


def packed(sequences: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (id, ord, length) with start, first_bin and last_bin in one coordinate space, in the order
    of ord. Each sequence is followed by padding up to a bin's border, of LEAST_PAD at least."""
    pad = F.lit(BIN) - F.col("length") % BIN
    room = F.col("length") + F.when(pad < LEAST_PAD, pad + BIN).otherwise(pad)
    w = Window.partitionBy(*(by or [])).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(room).over(w)
    return sequences.withColumn("_room", room).withColumn("_upto", upto).select(*sequences.columns, (F.col("_upto") - F.col("_room")).cast("long").alias("start"), ((F.col("_upto") - F.col("_room")) / BIN).cast("long").alias("first_bin"), (F.col("_upto") / BIN - 1).cast("long").alias("last_bin"))


def unpacked(ranges: DataFrame, places: DataFrame) -> DataFrame:
    """ranges (start, end) of packed coordinates with the id, id_start and id_end of the sequence in
    whose bins their midpoint lies, clipped to it."""
    own = places.select("id", F.col("start").alias("_at"), F.col("length").alias("_n"), F.explode(F.sequence("first_bin", "last_bin")).alias("_bin"))
    clip = lambda c: F.least(F.greatest(F.col(c) - F.col("_at"), F.lit(0)), F.col("_n")).cast("long")
    met = ranges.withColumn("_bin", F.floor((F.col("start") + F.col("end")) / 2 / BIN)).join(own, "_bin")
    return met.select(*ranges.columns, "id", clip("start").alias("id_start"), clip("end").alias("id_end"))


@dataclass(frozen=True)
class FilterParameters:
    word: int
    min_match: int
    max_error: int
    tube_offset: int


def filter_parameters(target_length: int, least_length: int, least_identity: float, tube_offset: int = 0) -> FilterParameters:
    """The longest word that the filter can use for hits of a length and identity. A word must leave
    the filter at least one shared word to ask for, and have few places in the target. If none does,
    seeds are halved, and below a quarter of the length, errors are given up one by one."""
    if not 0 <= least_identity <= 1:
        raise ValueError("identity must be in 0..1")
    if least_length <= SHORTEST_WORD:
        raise ValueError("hits are too short")
    shortest = int(math.log(target_length, 4) - math.log(MOST_PLACES, 4) + 0.5)

    def tries():
        seed, errors = least_length, int(least_length * (1 - least_identity))
        yield seed, errors
        while 4 * seed >= least_length - least_length % 4:
            seed //= 2
            yield seed, errors
        while errors:
            errors -= 1
            yield seed, errors

    for seed, errors in tries():
        for word in range(LONGEST_WORD, shortest - 1, -1):
            if seed + 1 - word * (errors + 1) > 0 and target_length / 4**word <= MOST_PLACES:
                return FilterParameters(word, seed, errors, tube_offset or errors + TUBE_MARGIN)
    raise ValueError("no parameters for this length and identity")


def best_hits(hits: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Hits (by, a_start, b_start, a_end, b_end, score) that are the best of their start point, and of
    those the best of their end point; of equal scores the first by `order` stays."""
    for ends in (("a_start", "b_start"), ("a_end", "b_end")):
        w = Window.partitionBy(*by, *ends).orderBy(F.desc("score"), *order)
        hits = hits.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return hits


def clipped(trapezoids: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoids (by, bottom, top, left, right) cut at runs of invalid letters of the query (by, start,
    end), as many parts as are left. Runs of one sequence don't overlap."""
    own = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    inner = F.filter("_runs", lambda r: (r["end"] > F.col("bottom")) & (r["start"] < F.col("top")))
    met = trapezoids.join(own, by, "left").withColumn("_in", F.coalesce(inner, F.array().cast("array<struct<start:bigint,end:bigint>>")))
    lows = F.concat(F.array(F.col("bottom")), F.transform("_in", lambda r: r["end"].cast("long")))
    highs = F.concat(F.transform("_in", lambda r: r["start"].cast("long")), F.array(F.col("top")))
    parts = F.filter(F.arrays_zip(lows.alias("a"), highs.alias("b")), lambda p: p["b"] > p["a"])
    return met.select(*by, "left", "right", F.explode(parts).alias("_p")).select(*by, F.col("_p.a").alias("bottom"), F.col("_p.b").alias("top"), "left", "right")


def mates(pairs: DataFrame) -> DataFrame:
    """Both images of each pair (pair, a_loc, a_start, a_end, b_loc, b_start, b_end, score, strand):
    (pair, side, loc, start, end, mate_loc, mate_start, mate_end, score, strand)."""
    sides = [("a", "b"), ("b", "a")]
    out = [pairs.select("pair", F.lit(x).alias("side"), *[F.col(f"{x}_{c}").alias(c) for c in ("loc", "start", "end")], *[F.col(f"{y}_{c}").alias(f"mate_{c}") for c in ("loc", "start", "end")], "score", "strand") for x, y in sides]
    return out[0].unionByName(out[1])


def inverted(pairs: DataFrame) -> DataFrame:
    """Pairs with their sides exchanged."""
    other = {"a": "b", "b": "a"}
    return pairs.select(*[F.col(f"{other[c[0]]}{c[1:]}" if c[:2] in ("a_", "b_") else c).alias(c) for c in pairs.columns])


def pair_lines() -> Column:
    """The GFF line of a pair: the image b, with the one-based image a as its Target and the error."""
    score = F.format_string("%.4f", F.col("score").cast("double"))
    target = F.concat_ws(" ", F.lit("Target"), "a_loc", (F.col("a_start") + 1).cast("string"), F.col("a_end").cast("string"))
    strand = F.when(F.col("strand") > 0, "+").when(F.col("strand") < 0, "-").otherwise(".")
    return F.concat_ws("\t", "b_loc", F.lit("pals"), F.lit("hit"), (F.col("b_start") + 1).cast("string"), F.col("b_end").cast("string"), score, strand, F.lit("."), F.concat(target, F.lit("; maxe "), F.regexp_replace(F.format_string("%.2f", F.col("error")), r"\.?0+$", "")))


def expanded(lines: DataFrame) -> DataFrame:
    """Pairs from read_gff() rows with a Target; those without have an error."""
    value = lambda tag: F.get(F.filter("attributes", lambda a: a["tag"] == tag), F.lit(0))["value"]
    parts = F.split(value("Target"), r"\s+")
    bad = F.when(value("Target").isNull() | (F.size(parts) != 3) | F.get(parts, F.lit(1)).try_cast("long").isNull() | F.get(parts, F.lit(2)).try_cast("long").isNull() | value("maxe").try_cast("double").isNull(), "not a feature pair")
    return lines.select(F.col("seqname").alias("b_loc"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.get(parts, F.lit(0)).alias("a_loc"), (F.get(parts, F.lit(1)).try_cast("long") - 1).alias("a_start"), F.get(parts, F.lit(2)).try_cast("long").alias("a_end"), F.col("score").cast("long").alias("score"), value("maxe").try_cast("double").alias("error"), "strand", bad.alias("error_text"))


def piles(images: DataFrame, by: list[str], overlap: int = 0) -> DataFrame:
    """(by, pile, start, end, n) of intervals that share at least `overlap` places with what is piled
    up before them, from left to right; at 0, touching ones share a pile."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (upto.isNull() | (F.col("start") > upto - overlap)).cast("int")
    marked = images.withColumn("_o", opens).withColumn("pile", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "pile").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def pile_members(images: DataFrame, by: list[str], overlap: int = 0, keep: Column | None = None) -> DataFrame:
    """images with pile_start and pile_end; keep: a condition on images, which is asked after piling, so
    piles don't shrink when it leaves some out."""
    piled = piles(images, by, overlap).select(*by, F.col("start").alias("pile_start"), F.col("end").alias("pile_end"))
    met = images.join(piled, by).where("start >= pile_start and end <= pile_end")
    return met.where(keep) if keep is not None else met
