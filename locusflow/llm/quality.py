"""Quality classifier by co-training of a text view and a metadata view.

Both views are logistic regressions over hashed features. From a bounded sample of labelled rows
they start; in each round they score all unlabelled documents, and the most confident ones of one
view, where it is sure enough, become labelled rows of the other. A part of the labelled sample is
kept out to calibrate both (Platt scaling) and to weigh them against each other; a view that knows
nothing stays close to the prior, gives no pseudo-labels and gets no weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KINDS_OF_BYTES, hash_words, in_slices, lean, lower_bytes, materialise, texts_of, words_of

#: Expected number of labelled rows to fit on; rows are taken by a hash of their id.
LABELLED = 12_000
FITTED_BYTES = 256 << 20  # most bytes of features to fit on; with long texts fewer labelled rows are taken
#: Rounds, most pseudo-labels that a view gives for a class in a round, and how sure it must be.
ROUNDS, PSEUDO, SURE = 2, 200, 0.95
WORDS_LOG2, DENSE = 16, 10
META = 1 << 12
REJECT = 0.5  # documents whose probability of being good is lower go
ROWS = 512  # scored at once
LEAST_ROWS = 5  # word buckets in fewer labelled rows are left out


def text_features(texts: pa.Array):
    """For each text: word buckets (uint16, rising), their counts (uint32), and DENSE shares."""
    raw, offsets = texts_of(texts)
    data, where, counts = words_of(raw, offsets)
    hashes = hash_words(lower_bytes(data), where)
    bucket = (hashes >> np.uint64(64 - WORDS_LOG2)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    byte = where[first]  # the texts' first bytes among those of words
    sums = {}
    for name, mask in KINDS_OF_BYTES.items():
        upto = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        sums[name] = np.diff(upto[byte])
    again = np.zeros(hashes.size, bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < hashes.size]] = False
    twice = np.diff(np.concatenate([[0], np.cumsum(again)])[first])
    solid = np.maximum(np.diff(byte), 1)
    n = np.maximum(counts, 1)
    text = np.repeat(np.arange(counts.size), counts)
    key, times = np.unique(text << WORDS_LOG2 | bucket, return_counts=True)
    cuts = np.searchsorted(key >> WORDS_LOG2, np.arange(counts.size + 1))
    kinds = np.diff(cuts)
    dense = np.stack(
        [
            sums["upper"] / solid,
            sums["digit"] / solid,
            sums["mark"] / solid,
            sums["bar"] / n,
            sums["stop"] / n,
            twice / n,
            kinds / n,
            np.minimum(solid / n, 20) / 20,
            np.log1p(counts) / 10,
            (counts == 0).astype(float),
        ],
        axis=1,
    ).astype(np.float32)
    return (key & ((1 << WORDS_LOG2) - 1)).astype(np.uint16), times.astype(np.uint32), cuts, dense


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _crush(dense: np.ndarray) -> np.ndarray:
    """Each share in 16 steps, as one-hot places."""
    return np.minimum((dense.astype(np.float64) * 16).astype(np.int64), 15) + 16 * np.arange(DENSE)


class View:
    """A logistic regression over rows of (places, values)."""

    def __init__(self, size: int):
        self.w, self.bias, self.scale, self.shift = np.zeros(size), 0.0, 1.0, 0.0

    def logit(self, at: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.w[at] * value, n) + self.bias

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> None:
        self.w[:] = 0
        if not rows or y.min() == y.max():
            self.bias = 0.0 if not rows else (3.0 if y[0] else -3.0)
            return
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        often = np.bincount(np.concatenate([np.unique(at) for at, _ in rows]), minlength=self.w.size) >= min(LEAST_ROWS, len(rows) // 10)
        seen, seen_bias = np.full(self.w.size, 1e-2), 1e-2
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
                at, value = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
                row = np.repeat(np.arange(part.size), [rows[i][0].size for i in part])
                error = _sigmoid(self.logit(at, value, row, part.size)) - y[part]
                gradient = np.bincount(at, error[row] * value, self.w.size) / part.size
                gradient[~often] = 0
                gradient += decay * self.w
                seen += gradient * gradient
                self.w -= rate * gradient / np.sqrt(seen)
                seen_bias += error.mean() ** 2
                self.bias -= rate * error.mean() / np.sqrt(seen_bias)

    def platt(self, logits: np.ndarray, y: np.ndarray) -> None:
        self.scale, self.shift = _newton(logits[:, None], y)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logits + self.shift)


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a small logistic regression with a little ridge."""
    x = np.column_stack([np.clip(x, -30, 30), np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _text_row(buckets: np.ndarray, times: np.ndarray, dense: np.ndarray):
    return np.concatenate([buckets.astype(np.int64), (1 << WORDS_LOG2) + _crush(dense)]), np.concatenate([np.log1p(times.astype(np.float64)), np.full(DENSE, 1.0)])


def _meta_columns(docs: DataFrame) -> list:
    """Places of the metadata view: source, language, length in steps, and pairs of these. Columns
    that a table lacks, and nulls, count as a value of their own."""
    have = set(docs.columns)
    source = F.coalesce(F.col("source").cast("string"), F.lit("?")) if "source" in have else F.lit("?")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("?")) if "lang" in have else F.lit("?")
    chars = F.coalesce(F.floor(F.log2(F.col("n_chars").cast("double") + 1)).cast("int"), F.lit(-1)) if "n_chars" in have else F.lit(-1)
    made = [F.xxhash64(F.lit(k), *x) for k, x in enumerate(([source], [lang], [chars], [source, lang], [lang, chars]))]
    return [F.array(*[F.pmod(x, F.lit(META)).cast("int") for x in made]).alias("meta")]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, words, times, dense, meta): a compact row of features for each document."""

    @lean
    def run(batches):
        for batch in batches:
            for own in in_slices(batch, 1):
                buckets, times, cuts, dense = text_features(own.column(1))
                parts = [slice(i, j) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": own.column(0), "words": pa.array([buckets[s].tobytes() for s in parts], pa.binary()), "times": pa.array([times[s].tobytes() for s in parts], pa.binary()), "dense": pa.array([x.tobytes() for x in dense], pa.binary()), "meta": own.column(2)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_meta_columns(docs)).mapInArrow(run, "doc_id long, words binary, times binary, dense binary, meta array<int>")


def _rows(found) -> tuple[list, list]:
    text = [_text_row(np.frombuffer(r["words"], np.uint16), np.frombuffer(r["times"], np.uint32), np.frombuffer(r["dense"], np.float32)) for r in found]
    return text, [(np.array(r["meta"], np.int64), np.ones(len(r["meta"]))) for r in found]


def _logits(view: View, rows: list) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    return view.logit(np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), np.repeat(np.arange(len(rows)), [a.size for a, _ in rows]), len(rows))


def co_train(table: DataFrame, labels: DataFrame, rounds: int = ROUNDS, labelled: int = LABELLED, pseudo: int = PSEUDO, sure: float = SURE):
    """The two views, and the weights of their calibrated logits. labels: (doc_id, good)."""
    n = labels.count()
    share = min(1.0, labelled / max(1, n))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else labels
    known = table.join(F.broadcast(chosen), "doc_id")
    size = known.agg(F.sum(F.length("words") + F.length("times"))).first()[0] or 0
    if size > FITTED_BYTES:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(FITTED_BYTES / size * (1 << 20)))
    found = known.collect()  # about `labelled` rows and FITTED_BYTES, whatever the input
    found.sort(key=lambda r: r["doc_id"])
    text, meta = _rows(found)
    y = np.array([r["good"] for r in found], float)
    aside = np.arange(len(y)) % 4 == 3
    views, own = (View((1 << WORDS_LOG2) + 16 * DENSE), View(META)), (text, meta)
    extra: list[list[tuple]] = [[], []]  # for each view: rows and labels that the other one gave
    given: set[int] = set()

    def refit():
        for k, view in enumerate(views):
            rows = [x for x, a in zip(own[k], aside, strict=True) if not a] + [x for x, _ in extra[k]]
            view.fit(rows, np.concatenate([y[~aside], [v for _, v in extra[k]]]))
            if aside.any():
                view.platt(_logits(view, [x for x, a in zip(own[k], aside, strict=True) if a]), y[aside])

    refit()
    spark = table.sparkSession
    for _ in range(rounds):
        if not len(y):
            break
        shared = spark.sparkContext.broadcast(views)

        @lean
        def run(batches, shared=shared):
            for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
                t, m = _rows(batch.to_pylist())
                out = [view.probability(_logits(view, rows)) for view, rows in zip(shared.value, (t, m), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "p0": pa.array(out[0], pa.float64()), "p1": pa.array(out[1], pa.float64())})

        # labelled ones are scored too and then left out, so that two numbers a row are shuffled and no features
        everything = table.where("doc_id is not null").mapInArrow(run, "doc_id long, p0 double, p1 double")
        scored = materialise(everything.join(labels.select("doc_id"), "doc_id", "left_anti"), "co-training")
        picks = []
        for k in (0, 1):
            for good, order in ((1.0, F.desc(f"p{k}")), (0.0, F.asc(f"p{k}"))):
                certain = F.col(f"p{k}") >= sure if good else F.col(f"p{k}") <= 1 - sure
                picks += [(1 - k, r["doc_id"], good) for r in scored.where(certain).orderBy(order, "doc_id").limit(pseudo).collect() if r["doc_id"] not in given]
        if not picks:
            break
        rows = {r["doc_id"]: r for r in table.where(F.col("doc_id").isin([int(x[1]) for x in picks])).collect()}
        for k, doc, good in picks:
            given.add(doc)
            extra[k].append((_rows([rows[doc]])[k][0], good))
        refit()
        shared.unpersist()
    if aside.any() and y[aside].min() != y[aside].max():
        both = np.column_stack([v.scale * _logits(v, [x for x, a in zip(rows, aside, strict=True) if a]) + v.shift for v, rows in zip(views, own, strict=True)])
        weights = _newton(both, y[aside])
    else:
        weights = np.array([1.0, 0.0, 0.0])
    return views, weights


def classify(docs: DataFrame, labels: DataFrame, keep_columns: bool = False, reject: float = REJECT, **how) -> DataFrame:
    """doc_id (or all columns of docs) with p_text, p_meta, p_good and accepted for each row.

    labels: (doc_id, quality[, toxic]); good is quality 1 and, if there, toxic 0. Rows whose label
    is null or that label no document take no part, of several labels the lowest counts. Without
    usable labels all documents are accepted with probability 0.5. A null text has no words; a null
    doc_id is scored like any other; rows that repeat are each scored. Columns named like the results
    are replaced, others pass through, whatever their names. Views are fitted on about LABELLED labelled
    rows and FITTED_BYTES of features, and up to 4 * ROUNDS * PSEUDO pseudo-labels, whatever the input."""
    good = F.col("quality").cast("int") == 1
    if "toxic" in labels.columns:
        good = good & (F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 0)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("good"))
    table = materialise(features(docs), "quality-features")
    views, weights = co_train(table, materialise(known, "labels"), **how)
    shared = docs.sparkSession.sparkContext.broadcast((views, weights))
    names = ["p_text", "p_meta", "p_good", "accepted"]

    def judge(text: list, meta: list):
        views, weights = shared.value
        logits = [_logits(v, rows) for v, rows in zip(views, (text, meta), strict=True)]
        z = weights[0] * np.clip(views[0].scale * logits[0] + views[0].shift, -30, 30) + weights[1] * np.clip(views[1].scale * logits[1] + views[1].shift, -30, 30) + weights[2]
        p = _sigmoid(z)
        return [pa.array(views[0].probability(logits[0]), pa.float64()), pa.array(views[1].probability(logits[1]), pa.float64()), pa.array(p, pa.float64()), pa.array(p >= reject, pa.bool_())]

    result = "p_text double, p_meta double, p_good double, accepted boolean"
    if not keep_columns:

        @lean
        def compact(batches):
            for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
                yield pa.RecordBatch.from_arrays([batch.column(0), *judge(*_rows(batch.to_pylist()))], ["doc_id", *names])

        return table.mapInArrow(compact, f"doc_id long, {result}")
    mine = docs.drop(*names)
    columns = mine.columns
    n = len(columns)

    @lean
    def whole(batches):
        for batch in batches:
            for own in in_slices(batch, n):
                buckets, times, cuts, dense = text_features(own.column(n))
                text = [_text_row(buckets[i:j], times[i:j], d) for i, j, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), dense, strict=True)]
                meta = [(np.array(m, np.int64), np.ones(len(m))) for m in own.column(n + 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*own.columns[:n], *judge(text, meta)], [*columns, *names])

    from pyspark.sql.types import StructType

    schema = StructType(mine.schema.fields + StructType.fromDDL(result).fields)
    # positions, not names, tell the last two from columns of any name
    made = mine.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").cast("string").alias("text"), *_meta_columns(mine))
    return made.mapInArrow(whole, schema)
