"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

A word's hash gives its class (of 16) and its bucket in the class (of 16). The probability of a
word is p(class | history) * p(bucket | class, history) * p(word | bucket): two softmaxes over
hashed features of the history, and smoothed counts of the training documents within a bucket.
Features: a bias, the word before, the two words before as a pair, and two skips (the second and
the third word before). The rows of the weight tables grow with the training tokens (a row for
ROW_TOKENS of them) up to 2 ** MOST_ROWS_LOG2, as the tables are broadcast; the table of distinct
words and their counts grows without a bound and is joined, not broadcast.

Training: a first pass counts each feature row's classes, which gives the weights to start from. In
each round after it, all tasks compute with the common weights what the model expects, their sums
are added up, and each weight moves by iterative scaling, log((seen + s) / (expected + s)) by the
number of features. So every training token counts in every round, and weights don't depend on the
number of tasks, but for rounding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import join_words, make_blocks, parts_for, with_values, words_in
from .common import hash_words, lean, materialise, mix, texts_of, unpack, unpack_ints

CLASSES = 16  # classes, and buckets in each
ROW_TOKENS, LEAST_ROWS_LOG2, MOST_ROWS_LOG2 = 4096, 14, 20
BATCH = 1 << 15
FEATURES, SMOOTH, START = 5, 60.0, 0.4  # SMOOTH: rows count as if seen so often more; START: share of a row's log ratio
ROUNDS = 1
BLOCKS_EACH, SLICES = 8, 64  # blocks of a training task, and slices in which sums are added up
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_SALTS = np.array([0xA4093822299F31D1, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6D], np.uint64)


def held_out(doc_id) -> bool:
    """Documents whose crc32(doc_id as text) mod 5 is 1; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def slices_of(row: dict, keep: np.ndarray | None = None, most: int = 1 << 17):
    """A block's texts, about `most` tokens at a time: the number of the first text and of the one
    after the last; the tokens' numbers (the number of words is the end), their hashes, their place
    in their text, and the offsets of the texts. keep: which texts to take."""
    codes, n = unpack_ints(row["codes"]), np.asarray(row["n_words"], np.int64)
    hashes = np.append(hash_words(*words_in(row["words"], row["sizes"])), _END)
    if keep is not None:
        codes, n = codes[np.repeat(keep, n)], n[keep]
    words, first = np.concatenate([[0], np.cumsum(n)]), 0
    while first < n.size:
        last = max(first + 1, int(np.searchsorted(words, words[first] + most, "right")) - 1)
        own = n[first:last]
        at = np.concatenate([[0], np.cumsum(own + 1)])
        token = np.full(at[-1], hashes.size - 1, np.int64)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        token[inside] = codes[words[first] : words[last]]
        yield first, last, token, hashes[token], np.arange(at[-1]) - np.repeat(at[:-1], own + 1), at
        first = last


def features(hashes: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Full hashes of the features of each token's history, without the bias."""
    before = []
    for k in (1, 2, 3):
        x = np.full(hashes.size, _START)
        x[k:] = np.where(place[k:] >= k, hashes[: max(0, hashes.size - k)], _START)
        before.append(x)
    one, two, three = before
    return [mix(one + _SALTS[0]), mix(one * _SALTS[1] + two), mix(two + _SALTS[2]), mix(three + _SALTS[3])]


def probabilities(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    logits = weights[rows[0]]
    for r in rows[1:]:
        logits = logits + weights[r]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def rows_of(full: list[np.ndarray], klass: np.ndarray, log2: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the two weight tables of 2 ** log2 rows; the first rows are the biases."""
    wide = np.uint64(64 - log2)
    first = [np.zeros(klass.size, np.int64)] + [(x >> wide).astype(np.int64) for x in full]
    salt = mix(klass.astype(np.uint64) + np.uint64(77))
    return first, [klass.astype(np.int64)] + [((x * _SALTS[1] ^ salt) * _SALTS[2] >> wide).astype(np.int64) for x in full]


def class_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(60)).astype(np.int64), (hashes >> np.uint64(56)).astype(np.int64) & 15


def rows_log2(tokens: int) -> int:
    return min(MOST_ROWS_LOG2, max(LEAST_ROWS_LOG2, (max(1, tokens // ROW_TOKENS) - 1).bit_length()))


def _gathered(blocks: DataFrame, log2: int, weights: list[np.ndarray] | None) -> np.ndarray:
    """Sums over all training tokens, (2, rows, CLASSES): of what is seen without weights, else of
    what a model with these weights expects."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    cells = (1 << log2) * CLASSES

    @lean
    def run(batches):
        total = np.zeros((2, cells), np.float64)
        column, some = np.arange(CLASSES), False
        for batch in batches:
            for row in batch.to_pylist():
                keep = np.array([not held_out(x) for x in row["doc_ids"]], bool)
                for _, _, _, hashes, place, _ in slices_of(row, keep):
                    some = some or hashes.size > 0
                    full, truths = features(hashes, place), class_of(hashes)
                    for a in range(0, hashes.size, BATCH):
                        s = slice(a, a + BATCH)
                        for k, rows in enumerate(rows_of([x[s] for x in full], truths[0][s], log2)):
                            if shared.value is None:
                                for r in rows:
                                    own, times = np.unique(r * CLASSES + truths[k][s], return_counts=True)
                                    total[k][own] += times
                                continue
                            p = probabilities(shared.value[k], rows).ravel()
                            for r in rows:
                                own, at = np.unique(r, return_inverse=True)
                                sums = np.bincount((at[:, None] * CLASSES + column).ravel(), p, own.size * CLASSES)
                                total[k].reshape(-1, CLASSES)[own] += sums.reshape(-1, CLASSES)
        if some:
            parts = [x.astype(np.float32) for x in np.split(total.ravel(), SLICES)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "sums": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table["sums"])
        return pa.table({"slice": table["slice"].slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    tasks = max(1, -(-blocks.count() // BLOCKS_EACH))
    found = np.zeros((SLICES, 2 * cells // SLICES), np.float32)
    for row in blocks.coalesce(tasks).mapInArrow(run, "slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary").collect():
        found[row["slice"]] = np.frombuffer(row["sums"], np.float32)
    shared.unpersist()
    return found.reshape(2, 1 << log2, CLASSES)


def train(blocks: DataFrame, tokens: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The two weight tables, float32, of rows_log2(tokens) rows."""
    log2 = rows_log2(tokens)
    seen = _gathered(blocks, log2, None)
    # biases: row 0 for classes, a row for each class for buckets; other rows start from what they add to them
    prior = [(x[:k].sum(0) + 1) / (x[:k].sum() + CLASSES) for x, k in zip(seen, (1, CLASSES), strict=True)]
    weights = []
    for x, p, k in zip(seen, prior, (1, CLASSES), strict=True):
        w = START * np.log((x + SMOOTH * p) / ((x.sum(1, keepdims=True) + SMOOTH) * p))
        w[:k] = np.log((x[:k] + SMOOTH * p) / (x[:k].sum(1, keepdims=True) + SMOOTH))
        weights.append(w.astype(np.float32))
    for _ in range(rounds):
        expected = _gathered(blocks, log2, weights)
        weights = [(w + np.log((x + SMOOTH * p) / (e + SMOOTH * p)) / FEATURES).astype(np.float32) for w, x, e, p in zip(weights, seen, expected, prior, strict=True)]
    return weights


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-half unigrams) and score (the model's log10 probability of the text).

    Tokens are the lower-cased (A-Z) words and one end. All counts are over all training rows; a
    null text is the end alone. Without training rows the counts are 0 and weights stay 0."""
    spark = docs.sparkSession
    blocks = materialise(make_blocks(docs, lower=True), "lm-blocks")
    known = docs.select(F.col("doc_id").cast("string").alias("id"))
    ends = known.where(~F.coalesce(F.crc32("id") % 5 == 1, F.lit(False))).count()

    def trained(n: int, row: dict) -> np.ndarray:
        keep = np.array([not held_out(x) for x in row["doc_ids"]], bool)
        return np.bincount(unpack_ints(row["codes"])[np.repeat(keep, row["n_words"])], minlength=n).astype(np.int64)

    def by_bucket(words: pa.Array, counts: np.ndarray) -> bytes:
        klass, bucket = class_of(hash_words(*texts_of(words)))
        flat = klass * CLASSES + bucket
        return np.concatenate([np.bincount(flat, counts, CLASSES**2), np.bincount(flat, counts > 0, CLASSES**2)]).astype(np.int64).tobytes()

    values = materialise(join_words(blocks, parts_for(docs), trained, lambda _, counts: [counts], by_bucket), "lm-counts")
    sums = np.zeros((2, CLASSES**2), np.int64)
    for row in values.where("block is null").select(F.col("values")[0].alias("x")).toLocalIterator():
        sums += np.frombuffer(row["x"], np.int64).reshape(2, -1)
    klass, bucket = class_of(np.array([_END]))
    if ends:
        sums[:, int(klass[0] * CLASSES + bucket[0])] += [ends, 1]
    n_all, v_all = int(sums[0].sum()), int(sums[1].sum())
    weights = train(blocks, n_all, rounds)
    shared, log2 = spark.sparkContext.broadcast((weights, sums)), rows_log2(n_all)

    @lean
    def run(batches):
        weights, (in_bucket, kinds) = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                n = unpack_ints(row["sizes"]).size
                count = np.zeros(n + 1, np.int64)
                for chunk in row["chunks"] or []:
                    count[unpack_ints(chunk["at"], True)] = unpack(chunk["values"][0], np.int64)
                count[n] = ends
                base = np.log10((count + 0.5) / (n_all + 0.5 * (v_all + 1)))
                for i, j, token, hashes, place, at in slices_of(row):
                    klass, bucket = class_of(hashes)
                    flat = klass * CLASSES + bucket
                    logs = np.log10((count[token] + 0.5) / (in_bucket[flat] + 0.5 * (kinds[flat] + 1)))
                    full = features(hashes, place)
                    for a in range(0, hashes.size, BATCH):
                        s = slice(a, a + BATCH)
                        first, second = rows_of([x[s] for x in full], klass[s], log2)
                        r = np.arange(klass[s].size)
                        logs[s] += np.log10(probabilities(weights[0], first)[r, klass[s]].astype(np.float64)) + np.log10(probabilities(weights[1], second)[r, bucket[s]].astype(np.float64))
                    starts, ids = at[:-1], row["doc_ids"][i:j]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(ids, pa.int64()),
                            "held_out": pa.array([held_out(x) for x in ids], pa.bool_()),
                            "n_tokens": pa.array(np.diff(at), pa.int64()),
                            "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64)[token], starts), pa.int64()),
                            "train_tokens": pa.array([n_all] * len(ids), pa.int64()),
                            "base_score": pa.array(np.add.reduceat(base[token], starts), pa.float64()),
                            "score": pa.array(np.add.reduceat(logs, starts), pa.float64()),
                        }
                    )

    return with_values(blocks, values).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
