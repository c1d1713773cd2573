"""Nearest neighbours by a block matrix join over int8 tiles, with exact results."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parallelism

TILE = 4096
QUERIES_EACH = 20  # tiles whose queries make one query tile


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and their scale by row: x is codes * scale within half a scale."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the order of the components, so equal
    vectors give equal numbers wherever they stand."""
    total = np.zeros(x.shape[0])
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def tile_top(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int):
    """For each query its k nearest of a tile, exactly: (query id, ids, scores).

    The int8 product and a bound on its error give each pair a range; only pairs whose upper end
    reaches the k-th lower end are computed from the vectors."""
    (qid, q), (rid, r) = queries, rows
    (qc, qs), (rc, rs) = quantised(q), quantised(r)
    kind = np.float32 if q.shape[1] <= 1000 else np.float64  # sums of int8 products are exact in it
    near = (qc.astype(kind) @ rc.astype(kind).T).astype(np.float64) * qs[:, None] * rs
    error = qs[:, None] / 2 * np.abs(r).sum(1) + rs / 2 * (np.abs(qc).astype(np.float64).sum(1) * qs)[:, None]
    error += 1e-9 * (np.abs(near) + error) + 1e-300
    own = qid[:, None] == rid
    low = np.where(own, -np.inf, near - error)
    at = min(k, low.shape[1]) - 1
    floor = -np.partition(-low, at, axis=1)[:, at]
    who, which = np.nonzero((near + error >= floor[:, None]) & ~own)
    exact = np.empty(who.size)
    for a in range(0, who.size, 1 << 16):
        exact[a : a + (1 << 16)] = products(q[who[a : a + (1 << 16)]], r[which[a : a + (1 << 16)]])
    cuts = np.searchsorted(who, np.arange(qid.size + 1))
    for i in range(qid.size):
        s = slice(cuts[i], cuts[i + 1])
        if s.stop > s.start:
            best = np.lexsort((rid[which[s]], -exact[s]))[:k]
            yield int(qid[i]), rid[which[s]][best], exact[s][best]


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): for each id divisible by `every`, its
    k nearest others by inner product, ties to the smaller id.

    Rows whose id is null, or whose vector is null, empty, zero or has a null or non-finite
    component, take no part. Vectors of different lengths are not compared. Rows that share an id
    are one item: it is answered once, with the best score of its vectors, and is no neighbour of
    itself. All query tiles meet all tiles; only tiles travel, and each task sends on k rows a
    query."""
    spark = vectors.sparkSession

    def tiles(batches):
        part, number, held = TaskContext.get().partitionId(), 0, {}

        def row(dim, ids, x):
            nonlocal number
            number += 1
            q = (ids % every) == 0
            return {"part": part, "k": number - 1, "dim": dim, "ids": ids.tobytes(), "x": x.tobytes(), "qids": ids[q].tobytes(), "q": x[q].tobytes()}

        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            by_size: dict[int, list] = {}
            for i, v in zip(ids, column, strict=True):
                v = v.values
                if i is None or v is None or not len(v) or v.null_count:
                    continue
                v = v.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(v).all() and v.any():
                    by_size.setdefault(v.size, []).append((i, v))
            for dim, rows in by_size.items():
                mine = held.setdefault(dim, [])
                mine += rows
                while len(mine) >= TILE:
                    own, mine[:] = mine[:TILE], mine[TILE:]
                    yield pa.RecordBatch.from_pylist([row(dim, np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own]))], schema)
        for dim, mine in held.items():
            if mine:
                yield pa.RecordBatch.from_pylist([row(dim, np.array([x[0] for x in mine], np.int64), np.array([x[1] for x in mine]))], schema)

    schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("dim", pa.int32())] + [(c, pa.binary()) for c in ("ids", "x", "qids", "q")])
    source = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    stored = materialise(source.mapInArrow(tiles, "part int, k int, dim int, ids binary, x binary, qids binary, q binary"), "tiles")
    per_part = stored.groupBy("dim", "part").agg(F.count("*").alias("n")).orderBy("dim", "part").collect()  # a row for each task
    first, total = [], {}
    for r in per_part:
        first.append((r["dim"], r["part"], total.get(r["dim"], 0)))
        total[r["dim"]] = total.get(r["dim"], 0) + r["n"]
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    starts = spark.createDataFrame(first, "dim int, part int, first long")
    sizes = spark.createDataFrame([(d, n, -(-n // QUERIES_EACH)) for d, n in total.items()], "dim int, tiles long, query_tiles long")
    # tiles of a task are numbered in the order of k, which may have gaps between sizes of vectors
    numbered = stored.join(starts, ["dim", "part"])
    order = F.row_number().over(Window.partitionBy("dim", "part").orderBy("k")) - 1
    numbered = materialise(numbered.withColumn("tile", F.col("first") + order).join(sizes, "dim"), "tiles")
    data = numbered.select("dim", "tile", "ids", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_tiles") - 1)).alias("qt"))
    asked = numbered.where(F.length("qids") > 0).groupBy("dim", "tiles", F.floor(F.col("tile") / QUERIES_EACH).cast("long").alias("qt")).agg(F.collect_list(F.struct("qids", "q")).alias("queries"))
    asked = asked.select("dim", "qt", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))

    def meet(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                qid = np.frombuffer(b"".join(x["qids"] for x in row["queries"]), np.int64)
                q = np.frombuffer(b"".join(x["q"] for x in row["queries"]), np.float64).reshape(-1, dim)
                data_rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], np.float64).reshape(-1, dim)
                for a in range(0, qid.size, 512):
                    found = list(tile_top((qid[a : a + 512], q[a : a + 512]), data_rows, k))
                    if found:
                        yield pa.RecordBatch.from_pydict({"query_id": pa.array([x[0] for x in found], pa.int64()), "ids": pa.array([x[1].tolist() for x in found], pa.list_(pa.int64())), "scores": pa.array([x[2].tolist() for x in found], pa.list_(pa.float64()))})

    met = data.join(asked, ["dim", "tile", "qt"]).mapInArrow(meet, "query_id long, ids array<long>, scores array<double>")

    def merge(batches):
        heaps: dict[int, dict[int, float]] = {}
        for batch in batches:
            for query, ids, scores in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                best = heaps.setdefault(query, {})
                for i, s in zip(ids, scores, strict=True):
                    if s > best.get(i, -np.inf):
                        best[i] = s
                if len(best) > 4 * k:
                    heaps[query] = dict(heapq.nsmallest(k, best.items(), key=lambda x: (-x[1], x[0])))
        for query, best in heaps.items():
            top = heapq.nsmallest(k, best.items(), key=lambda x: (-x[1], x[0]))
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([query] * len(top), pa.int64()), "rank": pa.array(range(1, len(top) + 1), pa.int32()), "vec_id": pa.array([x[0] for x in top], pa.int64()), "score": pa.array([x[1] for x in top], pa.float64())})

    return met.repartition(parallelism(spark), "query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
