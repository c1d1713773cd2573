"""Benchmark decontamination by template windows.

Texts become templates: numbers, names (capitalised words, those that open a sentence too, as their
place tells nothing) and units after numbers turn into typed placeholders, other words are
lower-cased without punctuation. Items of one template whose slots repeat alike are a class:
whatever a document's slots are, they fit all of its items or none. Windows of eight template tokens
are joined by hash between documents and classes; a pair is a leak if matching windows cover enough
of the item and the slots agree: within one alignment, a slot of the class must always meet the
same value of the document, and the other way round. So the same question with other numbers or
names is caught, and chance matches of placeholders are not. Windows of the plain words are joined
beside them, so that verbatim copies are found whatever the slots, the case and the length.

No window is too common to count. A document that covers a share of a class's windows has one of the
rarest of them, so candidates come from these alone (and from all windows of few classes); the other
windows are looked up at the places that such an alignment gives them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, hash_words, in_bitmap, in_slices, lean, lower_bytes, materialise, mix, texts_of, words_of

WINDOW, LEAST_LITERALS, COVERAGE = 8, 4, 0.5
#: Windows of up to this many classes are joined outright.
FEW = 8

# Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNIT_WORDS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degree degrees dollar dollars cent cents euro euros pound pounds usd eur kmh mph kwh w kw v hz".split()


def _hashes(words: list[str]) -> np.ndarray:
    data, where, _ = words_of(*texts_of(pa.array([" ".join(words)])))
    return np.sort(hash_words(data, where))


_NUMBERS, _UNITS = _hashes(NUMBER_WORDS), _hashes(UNIT_WORDS)
_NUM, _UNIT, _NAME, _NUM_UNIT = (np.uint64(x) for x in (11400714819323198485, 14029467366897019727, 1609587929392839161, 9650029242287828579))
_RNG = np.random.default_rng(7)
_W = _RNG.integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PUNCT = np.zeros(256, bool)
_PUNCT[[x for x in range(33, 127) if not chr(x).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _in(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, x), listed.size - 1)] == x


def templates(texts: pa.Array):
    """Template tokens of all texts: their hashes, hashes of the words behind them, which of them
    are slots, and the offsets of the texts. Words of punctuation alone are left out."""
    raw, offsets = texts_of(texts)
    data, where, counts = words_of(raw, offsets)
    n = where.size - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(texts) + 1, np.int64)
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), where[:-1])
    first = np.concatenate([[0], np.cumsum(counts)])
    keep = ~_PUNCT[data]
    size = count(keep)
    clean, at = data[keep], np.concatenate([[0], np.cumsum(size)])
    digits, letters = count(_DIGIT[data]), count(_LETTER[data])
    head = np.zeros(n, np.uint8)
    some = size > 0
    head[some] = clean[at[:-1][some]]
    second = np.zeros(n, np.uint8)
    more = size > 1
    second[more] = clean[at[:-1][more] + 1]
    latin = (head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    capital = ((head >= 65) & (head <= 90)) | latin
    small = count((data >= 97) & (data <= 122)) + count(data >= 0xC3) - latin
    # lower case: A-Z, and the capitals of Latin-1
    lowered = lower_bytes(clean)
    if clean.size > 1:
        up = np.flatnonzero((clean[:-1] == 0xC3) & (clean[1:] >= 0x80) & (clean[1:] <= 0x9E) & (clean[1:] != 0x97)) + 1
        lowered[up] += 0x20
    word = hash_words(lowered, at)
    token, slot = word.copy(), np.zeros(n, bool)
    number = (digits > 0) & (letters == 0) | _in(word, _NUMBERS)
    measured = (digits > 0) & (letters > 0) & (letters <= 3) & (head >= 48) & (head <= 57)
    unit = np.zeros(n, bool)
    unit[1:] = _in(word[1:], _UNITS) & number[:-1]
    name = capital & (small > 0) & ~number & ~measured & ~unit
    for mask, value in ((number, _NUM), (measured, _NUM_UNIT), (unit, _UNIT), (name, _NAME)):
        token[mask] = value
        slot |= mask
    starts = np.concatenate([[0], np.cumsum(some)])[first]
    return token[some], word[some], slot[some], starts


def windows(token: np.ndarray, slot: np.ndarray | None, starts: np.ndarray, size: int):
    """(text, place, hash) of all windows that lie within a text; with slot, of those with enough
    literal words, without, of plain words, whose hashes are others than those of templates."""
    n = token.size - size + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled += token[k : k + n] * _W[k]
    rolled = mix(rolled + np.uint64(size if slot is not None else size + (1 << 32))).view(np.int64)
    text = np.repeat(np.arange(starts.size - 1), np.diff(starts))[:n]
    fits = np.arange(n) + size <= starts[1:][text]
    if slot is not None:
        literals = np.concatenate([[0], np.cumsum(~slot)])
        fits &= literals[size:] - literals[:n] >= min(LEAST_LITERALS, (size + 1) // 2)
    at = np.flatnonzero(fits)
    return text[at], at - starts[text[at]], rolled[at]


def _pattern(word: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """For each slot of an item the number of the first one with the same word; -1 for literals."""
    out = np.full(word.size, -1, np.int64)
    at = np.flatnonzero(slot)
    if at.size:
        _, first, same = np.unique(word[at], return_index=True, return_inverse=True)
        out[at] = first[same]
    return out


def _windows_of(table: DataFrame, id_col: str, lengths: list[int], wanted=None) -> DataFrame:
    """(id, kind, h, plain, pos, size, words, slots) of template windows and windows of plain words (h,
    plain). words: the hash of the plain words; slots: places in the window with the word there. Without
    `wanted` texts are items: then slots have the item's pattern, and kind is a hash of class."""
    schema = "id long, kind long, h long, plain boolean, pos int, size int, words long, slots array<struct<k:int,v:long>>"
    kinds = pa.schema([("id", pa.int64()), ("kind", pa.int64()), ("h", pa.int64()), ("plain", pa.bool_()), ("pos", pa.int32()), ("size", pa.int32()), ("words", pa.int64()), ("slots", pa.list_(pa.struct([("k", pa.int32()), ("v", pa.int64())])))])

    @lean
    def run(batches):
        for batch in batches:
            for own in in_slices(batch, 1):
                ids = own.column(0).to_pylist()
                token, word, slot, starts = templates(own.column(1))
                value, kind = word.view(np.int64), [None] * len(ids)
                if wanted is None:
                    parts = [slice(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                    value = np.concatenate([_pattern(word[s], slot[s]) for s in parts]) if parts else value
                    kind = [int.from_bytes(hashlib.blake2b(token[s].tobytes() + value[s].tobytes(), digest_size=8).digest(), "little", signed=True) for s in parts]
                for size in lengths:
                    text, pos, plain = windows(word, None, starts, size)
                    at = starts[text] + pos if text.size else pos
                    words = np.zeros(token.size, np.int64)
                    words[at] = plain
                    for h_of in ("plain", "template"):
                        t, p, h = (text, pos, plain) if h_of == "plain" else windows(token, slot, starts, size)
                        hit = in_bitmap(wanted.value, h) if wanted is not None else np.minimum(np.diff(starts)[t], WINDOW) == size  # short items are one window
                        rows = []
                        for x, y, z in zip(t[hit].tolist(), p[hit].tolist(), h[hit].tolist(), strict=True):
                            a = int(starts[x]) + y
                            places = [] if h_of == "plain" else np.flatnonzero(slot[a : a + size]).tolist()
                            rows.append({"id": ids[x], "kind": kind[x], "h": z, "plain": h_of == "plain", "pos": y, "size": size, "words": int(words[a]), "slots": [{"k": k, "v": int(value[a + k])} for k in places]})
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, kinds)

    return table.select(F.col(id_col).cast("long"), F.col("text").cast("string")).where("text is not null").mapInArrow(run, schema)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, kind, h, plain, pos, size, words, slots): windows of the items with distinct texts,
    and the smallest item_id of their class as class_id."""
    items = benchmark.where("text is not null and item_id is not null").groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    rows = materialise(_windows_of(items, "item_id", [*range(1, WINDOW + 1)]), "benchmark-windows")
    return rows.join(rows.groupBy("kind").agg(F.min("id").alias("class_id")), "kind")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_slots, reparameterised): leaked pairs. item_id is the
    smallest item of its class (the same template with the same slots equal to each other);
    benchmark_classes() has the members.

    A pair counts if template windows of consistent alignments cover at least `coverage` of the
    class's, or else if windows of plain words do; then n_slots is 0 and reparameterised is false. An
    alignment is a fixed shift between item and document that has a window of few classes, or one of
    the rarest that a covered item must share. reparameterised is false where all words of an
    alignment are those of items. Null texts and ids take no part; rows that repeat give one result.
    An empty benchmark has no leaks.

    Windows of documents pass a bitmap of the benchmark's before they are shuffled, so little of the
    corpus is; then hash joins, which Spark may split or broadcast by size."""
    spark = docs.sparkSession
    theirs = materialise(_items(benchmark), "benchmark-classes")
    lengths = sorted(r["size"] for r in theirs.select("size").distinct().collect())  # up to WINDOW numbers
    wanted = spark.sparkContext.broadcast(bitmap_of(theirs, F.col("h"), theirs.count()))
    mine = materialise(_windows_of(docs.where("doc_id is not null"), "doc_id", lengths, wanted), "document-windows")
    known = theirs.groupBy("class_id", "plain", F.col("pos").alias("item_pos"), "h").agg(F.first("slots").alias("item_slots"))
    exact = theirs.where("not plain").select("class_id", F.col("pos").alias("item_pos"), "words").distinct().withColumn("said", F.lit(True))
    per_hash = known.select("class_id", "plain", "h").distinct().groupBy("plain", "h").agg(F.count("*").alias("classes"))
    places = known.join(per_hash, ["plain", "h"]).groupBy("class_id", "plain", "item_pos").agg(F.max("classes").alias("classes"))
    whole = Window.partitionBy("class_id", "plain")  # an item's places
    rank = F.row_number().over(whole.orderBy("classes", "item_pos"))
    places = places.withColumn("rank", rank).withColumn("of", F.count("*").over(whole))
    rare = places.where((F.col("classes") <= FEW) | (F.col("rank") <= F.col("of") - F.ceil(F.col("of") * coverage) + 1)).select("class_id", "plain", "item_pos")
    sizes = places.select("class_id", "plain", "of").distinct()
    keys = known.join(rare, ["class_id", "plain", "item_pos"]).select("plain", "h", "class_id", "item_pos")
    ours = mine.select(F.col("id").alias("doc_id"), "plain", "h", "pos", "words", "slots")
    shifts = materialise(ours.join(keys, ["plain", "h"]).select("doc_id", "class_id", "plain", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "alignments")
    met = shifts.join(known, ["class_id", "plain"]).withColumn("pos", F.col("shift") + F.col("item_pos")).join(ours, ["doc_id", "plain", "pos", "h"])
    met = met.join(exact, ["class_id", "item_pos", "words"], "left")
    pair = F.transform("slots", lambda s: F.struct(F.element_at(F.filter("item_slots", lambda t: t["k"] == s["k"]), 1)["v"].alias("theirs"), s["v"].alias("mine")))
    aligned = met.withColumn("pairs", pair).groupBy("doc_id", "class_id", "plain", "shift").agg(F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.min(F.coalesce("said", F.col("plain"))).alias("same"))
    n = F.size("pairs")
    agree = (F.size(F.array_distinct(F.transform("pairs", lambda p: p["theirs"]))) == n) & (F.size(F.array_distinct(F.transform("pairs", lambda p: p["mine"]))) == n)
    per_pair = aligned.where(agree).groupBy("doc_id", "class_id", "plain").agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("n_windows"), F.max(n).alias("n_slots"), (~F.max("same")).alias("reparameterised"))
    scored = per_pair.join(sizes, ["class_id", "plain"]).withColumn("coverage", F.col("n_windows") / F.col("of")).where(F.col("coverage") >= coverage)
    best = F.min_by(F.struct("n_windows", "coverage", "n_slots", "reparameterised"), "plain").alias("best")
    return scored.groupBy("doc_id", F.col("class_id").alias("item_id")).agg(best).select("doc_id", "item_id", "best.*").select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "coverage", F.col("n_slots").cast("long").alias("n_slots"), "reparameterised")


def benchmark_classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_id): items of the class that leaks() knows by its smallest item. Items without
    a word are a class of their text."""
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    smallest = rows.groupBy("text").agg(F.min("item_id").alias("same_text"))
    classes = _items(benchmark).select(F.col("id").alias("same_text"), "class_id").distinct()
    found = rows.join(smallest, "text").join(classes, "same_text", "left")
    return found.select("item_id", F.coalesce("class_id", "same_text").alias("class_id")).distinct()
