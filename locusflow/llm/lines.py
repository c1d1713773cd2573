"""Line dedup: lines that several documents hold stay only in the smallest doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, materialise


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text that stays).

    A text is split at \\n; a null or empty one is one empty line. A line's key is the line without
    white space at its ends, A-Z in lower case. Keys of at least min_chars code points that at
    least min_docs different doc_ids hold lose all lines but those of the smallest doc_id (with
    repeated rows of that id, in each of them). A null doc_id counts as no document and keeps its
    lines. Other columns pass through, whatever their names but those three.

    Lines are known by two 64-bit hashes with different seeds. Hashes and places of all long lines are
    written once. A shuffle of these, with partial aggregation, finds the keys to drop; they are
    written, so the second join is one that Spark can split where a key is hot; the last one joins
    places to texts.
    """
    mine = docs.drop("n_lines", "n_dropped", "kept")
    whole = mine.select(F.struct(*[F.col(f"`{c}`") for c in mine.columns]).alias("row"))  # so no name can clash
    text, doc = F.col("row.text").cast("string"), F.col("row.doc_id")
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    key = F.btrim(F.translate("line", UPPER, LOWER), F.lit(SPACE))
    long_lines = (
        whole.select(doc.alias("doc"), F.xxhash64(text).alias("digest"), F.posexplode(lines).alias("pos", "line"))
        .select("doc", "digest", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc", "digest", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    long_lines = materialise(long_lines, "lines")
    per_key = long_lines.groupBy("h1", "h2")
    if min_docs == 2:
        found = per_key.agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    else:
        found = long_lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("doc").alias("n")).where(F.col("n") >= min_docs)
    repeated = materialise(found.select("h1", "h2", "first"), "line-keys")
    drops = long_lines.join(repeated, ["h1", "h2"]).where(F.col("doc") > F.col("first")).groupBy("doc", "digest").agg(F.collect_set("pos").alias("gone"))
    joined = whole.select("row", doc.alias("doc"), F.xxhash64(text).alias("digest")).join(drops, ["doc", "digest"], "left")
    n = F.size(lines)
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: lines[i]), "\n"))
    made = F.struct(n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
    out = joined.select("row", made.alias("made"))  # apart from the next step, where a column may be named `row`
    return out.select(*[F.col(f"row.`{c}`") for c in mine.columns], "made.n_lines", "made.n_dropped", "made.kept")
