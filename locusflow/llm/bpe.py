"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt, join_words, make_blocks, parts_for, ragged_index, with_values
from .common import lean, quiet_threads, unpack_ints

BITS = 8 * 4096  # of one of Spark's bitmaps


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    quiet_threads()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_blocks(docs: DataFrame, tokenizer_path: str, pieces: bool = False) -> DataFrame:
    """Blocks of docs, each with the ids of its distinct words; see ids_of(). pieces: also the ids of all
    docs, rising, and their pieces, as array<struct<id, piece>>, from a join with piece_table().

    Texts are split at ASCII white space, which no token of a vocabulary with word ends crosses.
    Each distinct word is encoded once for the whole corpus, in the task of its hash part."""
    parts = parts_for(docs)
    blocks = dealt(make_blocks(docs), parts)

    def ids(words: pa.Array, _):
        tokenizer = _tokenizer(tokenizer_path)
        found = []
        for first in range(0, len(words), 20_000):
            found += [x.ids for x in tokenizer.encode_batch_fast(words.slice(first, 20_000).to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        return sizes, np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))

    # with_values() asks for the same rows: a filter of one branch alone would go below the shuffle, which then is not shared
    values = dealt(join_words(blocks, parts, None, ids).where("block is not null"), parts)
    found = with_values(blocks, values)
    return found.crossJoin(F.broadcast(_pieces_of(values, tokenizer_path))) if pieces else found


def _pieces_of(values: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row, pieces: the distinct ids of the corpus, joined with their pieces. Tasks mark their ids in
    bitmaps, so an id is one row of the join however many blocks and hash parts have it. The vocabulary
    has a fixed number of rows, so it and the result are broadcast."""
    pieces = piece_table(values.sparkSession, tokenizer_path)
    buckets = -(-_tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True) // BITS)

    @lean
    def mark(batches):
        seen = np.zeros((buckets, BITS), bool)
        for batch in batches:
            for _, flat in batch.column(2).to_pylist():
                seen.ravel()[unpack_ints(flat)] = True
        own = np.flatnonzero(seen.any(axis=1))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int32()), "bits": pa.array([np.packbits(seen[i], bitorder="little").tobytes() for i in own], pa.binary())})

    @lean
    def unmark(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little"))
                yield pa.RecordBatch.from_pydict({"id": pa.array(at + row["bucket"] * BITS, pa.int32())})

    marks = values.mapInArrow(mark, "bucket int, bits binary").groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    joined = marks.mapInArrow(unmark, "id int").join(F.broadcast(pieces), "id")
    return joined.agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("pieces"))


def ids_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block's documents, end to end (uint32), and the offsets of the documents."""
    codes, counts = unpack_ints(row["codes"]), np.asarray(row["n_words"], np.int64)
    n = int(codes.max(initial=-1)) + 1
    sizes, begins, flat, first = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
    seen = np.zeros(n, bool)
    for chunk in row["chunks"] or []:
        at, own, got = unpack_ints(chunk["at"], True), unpack_ints(chunk["values"][0]), unpack_ints(chunk["values"][1])
        sizes[at], seen[at] = own, True
        begins[at] = first + np.cumsum(own) - own
        first += got.size
        flat.append(got)
    if not seen.all():
        raise RuntimeError("a block's words came back incomplete: the rows of the input changed their order")
    ids = (np.concatenate(flat) if flat else np.zeros(0, np.int32)).astype(np.uint32)[ragged_index(begins[codes], sizes[codes])]
    upto = np.concatenate([[0], np.cumsum(sizes[codes])])
    return ids, upto[np.concatenate([[0], np.cumsum(counts)])]


def decoded(ids: np.ndarray, pieces: pa.StructArray) -> tuple[memoryview, np.ndarray]:
    """The pieces of all ids, each with a space after it, end to end, and their offsets. pieces: id,
    rising, and piece."""
    known = pc.binary_join_element_wise(pieces.field("piece").cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    found = known.take(pa.array(np.searchsorted(pieces.field("id").to_numpy(), ids.astype(np.int64))))
    at = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    return memoryview(found.buffers()[2] or b""), at


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id long, ids array<int>) for each row of docs: the ids of its whole text.

    A null text gives no ids; the specials of the vocabulary are recognised in texts."""

    @lean
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, at = ids_of(row)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return encode_blocks(docs, tokenizer_path).mapInArrow(run, "doc_id long, ids array<int>")


def piece_table(spark, tokenizer_path: str) -> DataFrame:
    """(id int, piece string) of a vocabulary."""
    tokenizer = _tokenizer(tokenizer_path)
    return spark.createDataFrame([(i, tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))], "id int, piece string")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): a join of ids with their pieces, put in order again.

    The vocabulary has a fixed number of rows, so Spark may broadcast it. Ids that it lacks are
    skipped; a row without ids gives an empty text. doc_id must be unique and not null."""
    pieces = piece_table(encoded.sparkSession, tokenizer_path)
    at = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id")
    texts = at.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return encoded.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def round_trip(docs: DataFrame, tokenizer_path: str, with_text: bool = False) -> DataFrame:
    """Encode and decode every row: doc_id, n_tokens, ids_sha256, decoded_sha256[, decoded].

    A null text is empty; rows that repeat are each answered, whatever their doc_id. The ids of the corpus
    meet their pieces in a join; digests are taken of whole documents."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * with_text

    @lean
    def run(batches):
        for batch in batches:
            for row, pieces in zip(batch.drop_columns("pieces").to_pylist(), batch.column("pieces"), strict=True):
                ids, at = ids_of(row)
                ids = np.ascontiguousarray(ids, "<u4")
                raw, (data, where) = memoryview(ids.tobytes()), decoded(ids, pieces.values)
                out = {"doc_id": row["doc_ids"], "n_tokens": np.diff(at), "ids_sha256": [], "decoded_sha256": [], "decoded": []}
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    text = bytes(data[where[a] : where[b] - 1]) if b > a else b""
                    out["ids_sha256"].append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        out["decoded"].append(text.decode())
                yield pa.RecordBatch.from_pydict({k: pa.array(v, {"doc_id": pa.int64(), "n_tokens": pa.int64()}.get(k, pa.string())) for k, v in out.items() if with_text or k != "decoded"})

    return encode_blocks(docs, tokenizer_path, pieces=True).mapInArrow(run, schema)
