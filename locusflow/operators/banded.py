"""Banded alignment of trapezoids: from the middle row of each, an extension with a drop to both ends.

A row of a band is computed at once: gaps along it are a running maximum. The extension towards the
beginning is the one towards the end of the reversed sequences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import best_hits

# Letters that a gap may span, costs of a difference and a match, and the drop that ends a band.
MAX_GAP, DIFFERENCE, MATCH, DROP = 5, 3, 4, 15
HITS = "array<struct<a_start:long,b_start:long,a_end:long,b_end:long,score:long,low_diagonal:long,high_diagonal:long,error:double>>"


def _extend(query: np.ndarray, target: np.ndarray, row: int, low: int, high: int, drop: int, until: int | None = None):
    """(score, query end, target end, least and largest diagonal) of the best path from the cells low to
    high of a row. Cells more than `drop` below the best leave the band; from row `until` on, DROP."""
    n = target.size
    low = min(max(low, 0), n)
    high = max(min(high, n), low)
    wide = min(high + MAX_GAP, n)
    band = np.concatenate([np.zeros(high - low + 1, np.int64), -DIFFERENCE * np.arange(1, wide - high + 1)])
    high = wide
    best, ends = 0, (row, low)
    right, left = row - low, row - high
    if until is not None and row >= until:
        drop = DROP
    for i in range(row, query.size):
        if low > high:
            break
        letter = query[i]
        same = (target[low : high + 1] == letter) & (letter >= 0)  # of the cell behind each place
        entry = band.copy()
        entry[1:] = np.maximum(band[1:], band[:-1] + MATCH * same[: high - low])
        slope = DIFFERENCE * np.arange(entry.size)
        cells = np.maximum.accumulate(entry - DIFFERENCE + slope) - slope
        if cells.size > 1 and cells[1:].max() >= best:
            best = int(cells[1:].max())
            ends = i + 1, low + 1 + int(np.flatnonzero(cells[1:] == best)[-1])
        if high < n:
            edge = max(int(band[-1]) + MATCH * int(same[high - low]), int(cells[-1])) - DIFFERENCE
            if edge > best:
                best, ends = edge, (i + 1, high + 1)
            more = min(max(0, (edge - (best - drop)) // DIFFERENCE), n - high - 1)
            cells = np.concatenate([cells, edge - DIFFERENCE * np.arange(more + 1)])
        alive = np.flatnonzero(cells >= best - drop)
        if alive.size:
            band = cells[alive[0] : alive[-1] + 1]
            low, high = low + int(alive[0]), low + int(alive[-1])
        else:
            low, high = low + cells.size, low + cells.size - 1
        if i == until:
            drop = DROP
        right, left = max(right, i + 1 - low), min(left, i + 1 - high)
    return best, ends[0], ends[1], left, right


def align_trapezoids_of(trapezoids, query: np.ndarray, target: np.ndarray, least_length: int, least_identity: float) -> list[tuple]:
    """Hits (a_start, b_start, a_end, b_end, score, low_diagonal, high_diagonal, error) of trapezoids
    (bottom, top, left, right): b is the query, a the target, as codes with -1 for invalid letters."""
    found: list[tuple] = []
    todo = sorted((tuple(t) for t in trapezoids), key=lambda t: (t[0], t[1], t[2], t[3]))
    covered = [False] * len(todo)
    back_query, back_target = query[::-1], target[::-1]
    shift = query.size - target.size

    def one(slot: int, bottom: int, top: int, left: int, right: int) -> list[tuple[int, int]]:
        """Align from the middle row; returns the heights that are left below and above."""
        mid = (bottom + top) // 2
        score, b_end, a_end, _, _ = _extend(query, target, mid, mid - right, mid - left, DROP)
        x = 1
        while True:
            place = target.size - a_end
            back, b, a, least, most = _extend(back_query, back_target, query.size - b_end, place, place, DROP + 2 * x * DIFFERENCE, query.size - 1 - (mid + MAX_GAP))
            b_start, a_start = query.size - b, target.size - a
            x += 1
            if not (b_start > mid + x * MAX_GAP and back < score):
                break
        low, high = shift - most, shift - least
        if b_end - b_start >= least_length and a_end - a_start >= least_length:
            indel = abs((a_start - b_start) - (a_end - b_end))
            error = 1 / MATCH - (back - indel) / (MATCH * (b_end - b_start))
            if error <= 1 - least_identity:
                for i in range(slot + 1, len(todo)):
                    other_bottom, other_top, other_left, other_right = todo[i]
                    if other_bottom >= b_end:
                        break
                    across = min(other_right, high) - max(other_left, low) + 1
                    along = min(other_top, b_end) - other_bottom + 1
                    if across > 0 and across / (other_right - other_left + 1) * along / (other_top - other_bottom + 1) > 0.99:
                        covered[i] = True
                found.append((a_start, b_start, a_end, b_end, back, -high, -low, error))
        rest = []
        if b_start - MAX_GAP - bottom > least_length and b_start - MAX_GAP < top - MAX_GAP:
            rest.append((bottom, b_start - MAX_GAP))
        if top - (b_end + MAX_GAP) > least_length:
            rest.append((b_end + MAX_GAP, top))
        return rest

    for slot, (bottom, top, left, right) in enumerate(todo):
        if covered[slot]:
            continue
        heights = [(bottom, top)]
        while heights:
            b, t = heights.pop(0)
            heights = one(slot, b, t, left, right) + heights
    return found


def align_trapezoids(pairs: DataFrame, by: list[str], least_length: int, least_identity: float, letters: str = "acgt") -> DataFrame:
    """(by, hits) of rows (by, query, target, trapezoids array<struct<bottom, top, left, right>>), then one
    hit for each start and end point: see repeats.best_hits(). A pair of sequences is one row of one
    task, as an alignment needs both whole."""
    from pyspark.sql.functions import pandas_udf

    code = np.full(256, -1, np.int8)
    for k, c in enumerate(letters):
        code[[ord(c), ord(c.upper())]] = k

    @pandas_udf(HITS)
    def run(query, target, trapezoids):
        import pandas as pd

        names = [x.split(":")[0] for x in HITS[len("array<struct<") : -2].split(",")]
        out = []
        for q, t, own in zip(query, target, trapezoids, strict=True):
            x, y = (code[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)] for s in (q, t))
            rows = align_trapezoids_of([(z["bottom"], z["top"], z["left"], z["right"]) for z in own], x, y, least_length, least_identity)
            out.append([dict(zip(names, r, strict=True)) for r in rows])
        return pd.Series(out)

    hits = pairs.where("query is not null and target is not null and trapezoids is not null").select(*by, F.explode(run("query", "target", "trapezoids")).alias("h")).select(*by, "h.*")
    return best_hits(hits, by, ["a_start", "b_start", "a_end", "b_end"])


def find_repeats(pairs: DataFrame, least_length: int, least_identity: float, word: int, min_match: int, max_error: int, tube_offset: int) -> DataFrame:
    """Hits between the sequences of rows (pair, target, query): shared words, filter, trapezoids and
    their alignments. repeats.filter_parameters() chooses the last four parameters."""
    from . import kmers as K
    from .repeats import trapezoids

    def words(side: str) -> DataFrame:
        return K.kmers(pairs.select("pair", side), word, "pair", side).select(F.col("id").alias("pair"), "pos", F.concat_ws(":", F.col("id").cast("string"), "kmer").alias("kmer"))

    lengths = pairs.select("pair", F.length("target").alias("target_length"))
    hits = K.seed_filter(words("target").join(lengths, "pair").drop("pair"), words("query"), None, word, min_match, max_error, tube_offset, by=("pair",))
    found = trapezoids(hits, ["pair"], word, tube_offset, max_error).groupBy("pair").agg(F.collect_list(F.struct("bottom", "top", "left", "right")).alias("trapezoids"))
    return align_trapezoids(pairs.join(found, "pair"), ["pair"], least_length, least_identity)
