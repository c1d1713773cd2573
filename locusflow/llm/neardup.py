"""MinHash near-dedup with an LSH forest, and an exact join for what stays crowded.

A document's set of word shingles gives 128 minima. A tree sorts all documents by the minima from one
place on (32 trees, each starting four minima further, so no two start alike). Documents that share
a tree's first four minima are a region. Candidates are its members:

1. In a first pass over a few trees, regions of more than BLOCK documents go deeper: they are split by
   the next minimum, and the next, until the parts are small, so each document meets those with the
   longest common prefix. That connects most near copies, and documents of one component need not
   be compared again.
2. In a pass over all trees, all pairs of each region of up to BLOCK documents are compared. Of larger
   ones that aren't one component yet, nothing is cut: their documents go on to the last pass.
3. The crowd's documents are joined exactly: of a set's n shingles, in a common order from rare to
   frequent, the first n - ceil(0.8 n) + 1 hold the first one that a linked partner has too, and of
   the smaller set of the two it is among the first n - ceil(2 * 0.8 / 1.8 n) + 1 (its heads). So
   documents that have only a frequent passage in common don't meet. Lists of a shingle longer than
   BLOCK are compared chunk by chunk (tiles), heads with all. If tiles are many, each list is first
   compared with a pivot (the document that is in most of these lists: a base of many edits is), and
   tiles are made of what that doesn't connect.

Sketches of all minima tell which candidates may reach the threshold; their full sets are brought
together and links are confirmed on them. Documents with equal sets are first merged into one, by a
digest of the set. A pair at similarity 0.8 shares no region with a chance below 1e-7, and the sketch
leaves out a linked pair with a chance below 1e-6 (five standard deviations); nothing else is left
out, whatever the size of a crowd and the number of partitions. The pairs of a list that share a rare
shingle, but are no component, are as many as the square of its size; no row is made for a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, hash_words, in_bitmap, in_slices, lean, lower_bytes, materialise, mix, parallelism, texts_of, words_of
from .components import connected_components, merged_components

MINIMA, TREES, DEPTH, BLOCK = 128, 32, 4, 64
TILE, TILE_SHINGLES = 512, 1 << 19  # most documents and shingles of a chunk; a document may be larger
DEEP_TREES = range(0, 32, 8)  # of the first pass
MANY_TILES = 1024  # with more, pivots come first
COUNTS_LOG2, SLICES = 20, 64  # of shingle counts, and slices in which they are added up
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 1 << 63, MINIMA, dtype=np.uint64)
_W = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int):
    """The sorted distinct shingle hashes (uint64) of each text: words in a row, or the whole text
    if it has fewer; empty without words."""
    data, offsets = texts_of(texts)
    data, where, counts = words_of(lower_bytes(data), offsets)
    hashes = hash_words(data, where)
    ends = np.cumsum(counts)
    n = max(0, hashes.size - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += hashes[k : k + n] * _W[k]
    rolled = mix(rolled)
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= words:
            yield np.unique(rolled[end - count : end - words + 1])
        elif count:
            yield mix((hashes[end - count : end] * _W[32 : 32 + count]).sum(keepdims=True) + np.uint64(count))
        else:
            yield np.zeros(0, np.uint64)


def minima_of(found: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, found.size, 1024):
        low = np.minimum(low, (found[a : a + 1024, None] * _A + _B).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, digest, high, low) of each row: the digest of the set and the halves of its minima,
    which are null for an empty set."""

    @lean
    def run(batches):
        for batch in (own for batch in batches for own in in_slices(batch, 1)):
            out = {"n": [], "digest": [], "high": [], "low": []}
            for found in shingle_sets(batch.column(1), words):
                out["n"].append(found.size)
                minima = minima_of(found) if found.size else None
                out["digest"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if found.size else None)
                out["high"].append((minima >> np.uint32(16)).astype(np.uint16).tobytes() if found.size else None)
                out["low"].append(minima.astype(np.uint16).tobytes() if found.size else None)
            kinds = {"n": pa.int64(), "digest": pa.binary(), "high": pa.binary(), "low": pa.binary()}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, digest binary, high binary, low binary")


# -- regions ------------------------------------------------------------------------------------
def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with `label`: the component of doc_id, or the document itself."""
    if labels is None:
        return rows.withColumn("label", F.col("doc_id"))
    return rows.join(labels, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component")


def tree_rows(singles: DataFrame, labels: DataFrame | None, trees: range) -> DataFrame:
    """(key, deep, label, doc_id, n): a row for each document and tree. key: the tree and its first
    DEPTH minima; deep: low halves of the next four, the first one in the highest bits."""

    @lean
    def run(batches):
        for batch in batches:
            high, low = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, MINIMA).astype(np.uint64) for k in (2, 3))
            minima = high << np.uint64(16) | low
            for t in trees:
                at = (t * DEPTH + np.arange(2 * DEPTH)) % MINIMA
                key = mix((minima[:, at[:DEPTH]] * _W[:DEPTH]).sum(1) + np.uint64(t)).view(np.int64)
                deep = (low[:, at[DEPTH:]] << np.array([48, 32, 16, 0], np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(deep), batch.column(4), batch.column(0), batch.column(1)], ["key", "deep", "label", "doc_id", "n"])

    return labelled(singles, labels).select("doc_id", "n", "high", "low", "label").mapInArrow(run, "key long, deep long, label long, doc_id long, n long")


def _by_key(batches):
    """Columns of a sorted stream in pieces that hold whole keys, with whether a piece is the first
    and the last one. Only the rows of one key are held."""
    held: list[list[np.ndarray]] = []
    first = True
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        key = columns[0]
        if not key.size:
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut or (held and held[0][0][-1] != key[-1]):
            whole = [*held, [c[:cut] for c in columns]]
            yield [np.concatenate(x) for x in zip(*whole, strict=True)], first, False
            first, held = False, [[c[cut:] for c in columns]]
        else:
            held.append(columns)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)], first, True


def _parts(deep: np.ndarray, a: int, b: int, level: int = 0):
    """Ranges of up to BLOCK of the places a to b: by the next minimum where there are more, small
    neighbours together; beyond the last minimum, neighbours that share one place."""
    if b - a <= BLOCK:
        yield a, b
        return
    if level == 4:
        yield from ((i, min(i + BLOCK + 1, b)) for i in range(a, b - 1, BLOCK))
        return
    own = deep[a:b].view(np.uint64) >> np.uint64(48 - 16 * level)
    cuts = [a, *(np.flatnonzero(own[1:] != own[:-1]) + 1 + a).tolist(), b]
    start = a
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        if y - x > BLOCK:
            if start < x:
                yield start, x
            yield from _parts(deep, x, y, level + 1)
            start = y
        elif y - start > BLOCK:
            yield start, x
            start = x
    if start < b:
        yield start, b


def _hash_of(ids: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)


def regions(rows: DataFrame, cut: bool = False, lists: bool = False) -> DataFrame:
    """(key, block, crowd, head, doc_id, label) of rows (key, deep, label, doc_id, n): the documents of each
    key of several components. Up to BLOCK are one block, known by its documents, so that equal ones
    of several keys are one. cut: larger ones are cut into blocks by `deep`. Else they are a crowd, and
    come in chunks, sorted by label; so do keys at a partition's ends, which may go on in another.
    lists: `deep` is 1 for heads, which come as `head`; keys without any need no comparison."""

    @lean
    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        out: list[list] = []
        size = 0

        def flush():
            ids = np.concatenate([x[3] for x in out])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([x[k] for x in out], [x[3].size for x in out]), kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.bool_()))] + [pa.array(np.concatenate([x[5] for x in out]), pa.bool_()), pa.array(ids, pa.int64()), pa.array(np.concatenate([x[4] for x in out]), pa.int64())],
                ["key", "block", "crowd", "head", "doc_id", "label"],
            )

        for (key, deep, label, ids, n), first, last in _by_key(batches):
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(starts[1:], key.size)
            wanted = (ends - starts > 1) & (np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts))
            head = deep == 1 if lists else np.zeros(key.size, bool)
            if lists:
                wanted &= np.logical_or.reduceat(head, starts)
            edge = np.zeros(starts.size, bool)
            if not cut:
                edge[0], edge[-1] = edge[0] or first, edge[-1] or last
            for a, b, e in zip(starts[wanted | edge].tolist(), ends[wanted | edge].tolist(), edge[wanted | edge].tolist(), strict=True):
                if cut or (not e and b - a <= BLOCK):
                    for x, y in _parts(deep, a, b) if cut else ((a, b),):
                        if y - x > 1 and label[x:y].min() != label[x:y].max():
                            order = np.argsort(ids[x:y], kind="stable")
                            out.append([int(key[a]), _hash_of(ids[x:y][order]), False, ids[x:y][order], label[x:y][order], head[x:y][order]])
                            size += y - x
                else:
                    upto = np.concatenate([[0], np.cumsum(n[a:b])])
                    while a < b:
                        done = b - upto.size + 1
                        full = int(np.searchsorted(upto, upto[a - done] + TILE_SHINGLES, "right")) - 1 + done
                        end = min(b, a + TILE, max(a + 1, full))
                        out.append([int(key[a]), base + made, True, ids[a:end], label[a:end], head[a:end]])
                        size, made, a = size + end - a, made + 1, end
                if size > 1 << 15:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    order = ["key", "deep", "doc_id"] if cut else ["key", "label", "doc_id"]
    parts = parallelism(rows.sparkSession)
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "key long, block long, crowd boolean, head boolean, doc_id long, label long")


def whole_blocks(found: DataFrame) -> DataFrame:
    """(block, side, doc_id, label) of regions(): all pairs of a block are compared."""
    return found.where("not crowd").dropDuplicates(["block", "doc_id"]).select("block", F.lit(0).alias("side"), "doc_id", "label")


def of_several_components(crowds: DataFrame, lists: bool = False) -> DataFrame:
    """The rows of keys that have several labels, and with lists a head; chunks of a key may come from
    several tasks."""
    keys = crowds.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("head").alias("head")).where(f"least <> most and (head or not {lists})").select("key")
    return crowds.join(keys, "key", "left_semi")


def pivot_tiles(crowds: DataFrame) -> DataFrame:
    """(block, side, doc_id, label): each chunk of a crowd against the key's pivot."""
    often = crowds.groupBy("doc_id").agg(F.count("*").alias("lists"))
    pivots = crowds.join(often, "doc_id").groupBy("key").agg(F.max_by(F.struct("doc_id", "label"), F.struct("lists", (-F.col("doc_id")).alias("d"))).alias("pivot"))
    chunks = crowds.select("key", F.xxhash64("key", "block").alias("block"), "doc_id", "label")
    one = chunks.groupBy("key", "block").agg(F.lit(1).alias("one")).join(pivots, "key").select("block", F.lit(1).alias("side"), "pivot.doc_id", "pivot.label")
    return one.unionByName(chunks.select("block", F.lit(2).alias("side"), "doc_id", "label"))


def tiles_of(crowds: DataFrame) -> DataFrame:
    """(tile, block_a, block_b): each chunk of a crowd that has heads with every chunk of the key, but
    for two chunks of one and the same component."""
    bounds = [F.min("label").alias("low"), F.max("label").alias("high")]
    a, b = (rows.groupBy("key", "block").agg(*bounds).select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high")]) for rows, x in ((crowds.where("head"), "a"), (crowds, "b")))
    tiles = a.join(b, "key").where("not (low_a = high_a and low_b = high_b and low_a = low_b)")
    return materialise(tiles.select(F.xxhash64("block_a", "block_b").alias("tile"), "block_a", "block_b"), "tiles")


def sides_of(tiles: DataFrame, crowds: DataFrame) -> DataFrame:
    """(block, side, doc_id, label) of tiles: heads of the first chunk, all of the second one."""
    sides = [tiles.select("tile", F.lit(side).alias("side"), F.col(c).alias("block")).join(rows, "block") for side, c, rows in ((1, "block_a", crowds.where("head")), (2, "block_b", crowds))]
    return sides[0].unionByName(sides[1]).select(F.col("tile").alias("block"), "side", "doc_id", "label")


# -- the exact join of a crowd ------------------------------------------------------------------
def prefix_rows(docs: DataFrame, crowd: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, deep, doc_id, n): for each document of crowd the first shingles of its set, rare ones
    first, as many as a linked partner must share one of; deep is 1 for heads, else 0. Any common order is exact; this one is by counts of
    the crowd's shingles in a table of fixed size, so what collides only counts as more frequent."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap_of(crowd.select("doc_id"), F.xxhash64("doc_id"), crowd.count()))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("long")).alias("h")).where("doc_id is not null")
    places = np.uint64(64 - COUNTS_LOG2)

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column(2).to_numpy())))
            for own in in_slices(batch, 1):
                yield own.column(0).to_numpy(), list(shingle_sets(own.column(1), words))

    @lean
    def count(batches):
        total = np.zeros(1 << COUNTS_LOG2, np.int64)
        some = False
        for _, found in sets(batches):
            if found:
                some = True
                total += np.bincount((np.concatenate(found) >> places).astype(np.int64), minlength=total.size)
        if some:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
        return pa.table({"slice": table["slice"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((SLICES, (1 << COUNTS_LOG2) // SLICES), np.int64)
    for row in known.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():  # 8 MB
        counts[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    shared = spark.sparkContext.broadcast(counts.ravel())

    @lean
    def run(batches):
        for ids, found in sets(batches):
            for doc, own in zip(ids.tolist(), found, strict=True):
                if own.size:
                    size = own.size + (-percent * own.size) // 100 + 1
                    first = own[np.lexsort((own, shared.value[(own >> places).astype(np.int64)]))[:size]]
                    head = own.size + (-2 * percent * own.size) // (100 + percent) + 1
                    yield pa.RecordBatch.from_pydict({"key": pa.array(first.view(np.int64)), "deep": pa.array((np.arange(first.size) < head).astype(np.int64)), "doc_id": pa.array([doc] * first.size, pa.int64()), "n": pa.array([own.size] * first.size, pa.int64())})

    return known.mapInArrow(run, "key long, deep long, doc_id long, n long").join(crowd.select("doc_id"), "doc_id", "left_semi").groupBy("key", "doc_id").agg(F.max("deep").alias("deep"), F.max("n").alias("n"))


def _in_groups(batches, key: int):
    """Rows of a sorted stream, one key's at a time, as tables."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column(key).to_numpy()
        if keys.size and keys[0] != keys[-1]:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            first = 0
            for c in cuts.tolist():
                yield held.slice(first, c - first)
                first = c
            held = held.slice(first)
    if held is not None and held.num_rows:
        yield held


def likely_groups(blocks: DataFrame, singles: DataFrame, threshold: float, deviations: float = 5) -> DataFrame:
    """(grp, doc_id, label): documents of a block that sketches connect across components. A sketch may
    be so many standard deviations below the threshold."""
    rows = blocks.join(singles.select("doc_id", "n", F.col("low").alias("sketch")), "doc_id").select("block", "side", "doc_id", "n", "sketch", "label")
    least = threshold - deviations * (threshold * (1 - threshold) / MINIMA) ** 0.5

    @lean
    def run(batches):
        for table in _in_groups(batches, 0):
            side, ids, n, label = (table.column(k).to_numpy() for k in (1, 2, 3, 5))
            sketch = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint16).reshape(-1, MINIMA)
            left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            near = np.zeros((ids.size, ids.size), bool)
            for at in (left[i : i + 64] for i in range(0, left.size, 64)):
                x = at[:, None]
                fits = (label[x] != label[right]) & (np.minimum(n[x], n[right]) >= threshold * np.maximum(n[x], n[right]) - 1e-9)
                row, col = np.nonzero(fits)
                for i in range(0, row.size, 1 << 15):
                    u, v = at[row[i : i + (1 << 15)]], right[col[i : i + (1 << 15)]]
                    hit = (sketch[u] == sketch[v]).sum(1) >= least * MINIMA
                    near[u[hit], v[hit]] = near[v[hit], u[hit]] = True
            rest = near.any(1)
            while rest.any():  # connected parts, so that far pairs don't travel together
                part = np.zeros(ids.size, bool)
                new = np.flatnonzero(rest)[:1]
                while new.size:
                    part[new] = True
                    rest[new] = False
                    new = np.flatnonzero(near[new].any(0) & rest)
                own, where = np.unique(ids[part], return_index=True)
                grp = _hash_of(own)
                yield pa.RecordBatch.from_pydict({"grp": pa.array([grp] * own.size, pa.int64()), "doc_id": pa.array(own, pa.int64()), "label": pa.array(label[part][where], pa.int64())})

    parts = parallelism(blocks.sparkSession)
    return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, "grp long, doc_id long, label long").distinct()


def shared_counts(sets_: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common."""
    size = len(sets_)
    owner = np.repeat(np.arange(size), [x.size for x in sets_])
    _, where, times = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    common = times > 1
    column = np.cumsum(common) - 1
    keep = common[where]
    owner, where = owner[keep], column[where[keep]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    both = np.zeros((size, size), np.float32)
    width = int(common.sum())
    for first in range(0, width, 4096):
        a, b = np.searchsorted(where, (first, first + 4096))
        has = np.zeros((size, min(4096, width - first)), np.float32)
        has[owner[a:b], where[a:b] - first] = 1
        both += has @ has.T
    return both.astype(np.int64)


def confirmed(groups: DataFrame, n: int, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) links within groups, on full sets; enough of them to connect what is connected."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap_of(groups.select("doc_id"), F.xxhash64("doc_id"), n))

    @lean
    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column(2).to_numpy())))
            for own in in_slices(batch, 1):
                yield pa.RecordBatch.from_pydict({"doc_id": own.column(0), "shingles": pa.array([x.tobytes() for x in shingle_sets(own.column(1), words)], pa.binary())})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("long")).alias("h")).where("doc_id is not null").mapInArrow(sets, "doc_id long, shingles binary")

    @lean
    def run(batches):
        for table in _in_groups(batches, 0):
            by_id = {}
            for d, label, raw in zip(table.column(1).to_pylist(), table.column(2).to_pylist(), table.column(3), strict=True):
                by_id.setdefault((d, raw.as_py()), label)  # a doc_id on several texts has each of them
            ids, sets_ = np.array([d for d, _ in by_id]), [np.frombuffer(x, np.uint64) for _, x in by_id]
            root = np.unique(list(by_id.values()), return_inverse=True)[1]
            size = np.array([x.size for x in sets_])
            both = shared_counts(sets_)
            linked = both * 100 >= percent * (size[:, None] + size - both)
            out = []
            for i in range(ids.size):
                other = np.flatnonzero(linked[i] & (root != root[i]))
                if other.size:
                    joined, first = np.unique(root[other], return_index=True)
                    out += [(int(ids[i]), int(ids[j])) for j in other[first]]
                    root[np.isin(root, joined)] = root[i]
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    parts = parallelism(spark)
    rows = groups.join(found, "doc_id").select("grp", "doc_id", "label", "shingles")
    return rows.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable
    over links of Jaccard similarity of at least percent / 100) and kept (the two are equal).

    Texts without words are linked with nothing. A null doc_id is linked with nothing, its
    component is null and it is kept. Rows that share a doc_id are one document with several
    texts: each has its own n_shingles, and all have the component that any of them reaches."""
    signed = materialise(signatures(docs, words), "signatures")
    real = signed.where("doc_id is not null and n > 0")
    # one row a digest: equal sets are linked to the smallest doc_id
    singles = materialise(real.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("high").alias("high"), F.first("low").alias("low")), "singles")
    twins = real.select("digest", F.col("doc_id").alias("b")).join(singles.select("digest", F.col("doc_id").alias("a")), "digest").where("a <> b").select("a", "b")
    links = labels = None

    def compare(blocks: DataFrame, deviations: float = 5) -> None:
        """Add the links between the documents of blocks."""
        nonlocal links, labels
        groups = materialise(likely_groups(materialise(blocks, "blocks"), singles, percent / 100, deviations), "groups")
        n = groups.count()
        if not n:
            return
        new = materialise(confirmed(groups, n, docs, words, percent), "links")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = merged_components(labels, new)

    # what this pass leaves out, the one over all trees has
    compare(whole_blocks(regions(tree_rows(singles, labels, DEEP_TREES), cut=True)), 1)
    found = materialise(regions(tree_rows(singles, labels, range(TREES))), "regions")
    compare(whole_blocks(found))
    crowd = labelled(found.where("crowd").drop("label"), labels)
    crowd = materialise(of_several_components(crowd).select("doc_id").distinct(), "crowd")
    if not crowd.isEmpty():
        rows = materialise(prefix_rows(docs, crowd, words, percent), "prefixes")
        ordered = ["key", "deep", "label", "doc_id", "n"]
        found = materialise(regions(labelled(rows, labels).select(*ordered), lists=True), "lists")
        crowds = materialise(of_several_components(found.where("crowd"), True), "crowds")
        tiles = tiles_of(crowds)
        if tiles.count() > MANY_TILES:
            compare(whole_blocks(found).unionByName(pivot_tiles(crowds)))
            rows = rows.join(crowds.select("key").distinct(), "key", "left_semi")
            found = materialise(regions(labelled(rows, labels).select(*ordered), lists=True), "lists")
            crowds = materialise(of_several_components(found.where("crowd"), True), "crowds")
            tiles = tiles_of(crowds)
        compare(whole_blocks(found).unionByName(sides_of(tiles, crowds)))
    # a copy has the component of the document that stands for it
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "node long, component long")
    stands = twins.groupBy("b").agg(F.min("a").alias("a"))
    ids_on_many = real.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    if not ids_on_many.isEmpty():  # rare: then copies are edges like all others
        labels = connected_components(twins.unionByName(links) if links is not None else twins, native=False)
        stands = docs.sparkSession.createDataFrame([], "b long, a long")
    final = materialise(labels, "labels")
    out = signed.select("doc_id", "n").join(materialise(stands, "stands"), F.col("doc_id") == F.col("b"), "left")
    out = out.withColumn("stand", F.coalesce("a", "doc_id")).join(final, F.col("stand") == F.col("node"), "left")
    component = F.coalesce("component", "stand")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
