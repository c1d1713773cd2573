"""Documents as dictionary-coded blocks, and a join of their distinct words with a global table.

A block is some megabytes of whole documents of one task: its distinct words once, and for every
word occurrence its number in that list. Words travel to the global table in chunks, one for each
pair of block and hash part, so a shuffle moves a distinct word once a block, not once an
occurrence; values come back the same way and meet the occurrences by position. Frequent words
have one row a block at most, so no key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, lean, lower_bytes, pack, pack_ints, parallelism, string_array, texts_of, unpack, unpack_ints, words_of

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 16 << 20
PART_BYTES, MOST_PARTS = 16 << 20, 8  # of input for a hash part; a task holds the words of a part
BLOCK_SCHEMA = "block long, doc_ids array<long>, n_words array<int>, codes binary, words binary, sizes binary"


def make_blocks(docs: DataFrame, lower: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """BLOCK_SCHEMA from (doc_id, text). lower: A-Z count as a-z. A block's id is a hash of what is
    in it. Blocks that two branches of a plan read must be dealt() or written first."""

    def block(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        data, where, counts = words_of(*texts_of(texts))
        if lower:
            data = lower_bytes(data)
        coded = string_array(data, where).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        often = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")  # small numbers for frequent words
        rank = np.empty(often.size, np.int32)
        rank[often] = np.arange(often.size)
        words, at = texts_of(coded.dictionary.take(pa.array(often)))
        columns = [[0], [ids], [counts.astype(np.int32)], [pack_ints(rank[codes])], [pack(words)], [pack_ints(np.diff(at))]]
        digest = hashlib.blake2b(repr(ids.to_pylist()).encode() + counts.tobytes(), digest_size=8)
        for part in columns[3:]:
            digest.update(part[0])
        columns[0] = [int.from_bytes(digest.digest(), "little", signed=True)]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
        arrays = []
        for column, kind in zip(columns, kinds, strict=True):
            if pa.types.is_list(kind):
                values = column[0] if isinstance(column[0], pa.Array) else pa.array(column[0])
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind.value_type)))
            else:
                arrays.append(pa.array(column, kind))
        return pa.RecordBatch.from_arrays(arrays, ["block", "doc_ids", "n_words", "codes", "words", "sizes"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            _, ends = texts_of(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + block_bytes - size, "right")) - 1)
                held.append(batch.slice(first, last - first))
                size += int(ends[last] - ends[first])
                first = last
                if size >= block_bytes or first < batch.num_rows:
                    yield block(pa.concat_arrays([x.column(0) for x in held]), pa.concat_arrays([x.column(1) for x in held]))
                    held, size = [], 0
        if held:
            yield block(pa.concat_arrays([x.column(0) for x in held]), pa.concat_arrays([x.column(1) for x in held]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK_SCHEMA)


def parts_for(docs: DataFrame) -> int:
    """Hash parts: a part for each PART_BYTES of input, but as many as shuffle partitions at least and
    MOST_PARTS times that at most (estimates of joined inputs may be far too large)."""
    least = parallelism(docs.sparkSession)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, min(-(-size // PART_BYTES), MOST_PARTS * least))


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows shuffled by block. Branches of a plan that read all columns share this one shuffle, so they
    see the same rows however often and wherever the tasks before it run."""
    return rows.repartition(parts, "block")


def words_in(words: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a block's distinct words."""
    return unpack(words, np.uint8), np.concatenate([[0], np.cumsum(unpack_ints(sizes), dtype=np.int64)])


def join_words(
    blocks: DataFrame,
    parts: int,
    measure: Callable[[np.ndarray, dict], np.ndarray] | None,
    value: Callable[[pa.Array, np.ndarray], list[np.ndarray]],
    summary: Callable[[pa.Array, list[np.ndarray]], bytes] | None = None,
) -> DataFrame:
    """A row (block, at, values) for each block and hash part; at numbers the block's words.

    measure(codes, row of the block): a number (int64) for each distinct word of a block, such as
    its count there; they are summed over all blocks. value(words, sums): arrays to hand back, one
    entry a word, or a pair of lengths and flat entries (then packed with pack_ints). summary: bytes about a task's words; they
    come as rows with a null block."""
    @lean
    def chunks(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, where = words_in(row["words"], row["sizes"])
                n = where.size - 1
                count = measure(n, row) if measure else np.zeros(n, np.int64)
                part = (hash_words(data, where) >> np.uint64(33)).astype(np.int64) % parts
                order = np.argsort(part, kind="stable").astype(np.int32)
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                words = string_array(data, where)
                out = []
                for at in np.split(order, cuts):
                    if at.size:
                        d, w = texts_of(words.take(pa.array(at)))
                        out.append({"part": int(part[at[0]]), "block": row["block"], "at": pack_ints(at, True), "words": pack(d), "sizes": pack_ints(np.diff(w)), "counts": pack_ints(count[at])})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("words", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary())]))

    kind = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("values", pa.list_(pa.binary()))])

    @lean
    def look_up(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        if not rows:
            return
        split = [words_in(row["words"], row["sizes"]) for row in rows]
        coded = pa.concat_arrays([string_array(*x) for x in split]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sums = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(sums, codes, np.concatenate([unpack_ints(row["counts"]).astype(np.int64) for row in rows]))
        found = value(coded.dictionary, sums)
        if summary:
            yield pa.RecordBatch.from_pylist([{"block": None, "at": None, "values": [summary(coded.dictionary, sums)]}], kind)
        ragged = isinstance(found, tuple)
        if ragged:
            sizes, flat = found
            begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        first = 0
        for row, (_, where) in zip(rows, split, strict=True):
            own = codes[first : first + where.size - 1]
            first += own.size
            if ragged:
                n = sizes[own].astype(np.int64)
                values = [pack_ints(n), pack_ints(flat[ragged_index(begins[own], n)])]
            else:
                values = [pack(x[own]) for x in found]
            yield pa.RecordBatch.from_pylist([{"block": row["block"], "at": row["at"], "values": values}], kind)

    return (
        blocks.mapInArrow(chunks, "part int, block long, at binary, words binary, sizes binary, counts binary")
        .repartitionById(parts, F.col("part"))
        .mapInArrow(look_up, "block long, at binary, values array<binary>")
    )


def ragged_index(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions begins[i] .. begins[i] + sizes[i] - 1 for each i, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if ends.size else 0)


def with_values(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """Each block and its chunks of values, for a mapInArrow that joins them by position."""
    gathered = values.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("at", "values")).alias("chunks"))
    return blocks.join(gathered, "block", "left")
