"""From raw documents to token ids: quality, lines, near-duplicates, benchmark leaks, tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run()
writes each stage's result to the shared folder as Parquet, and the next stage gets it reread. All
stages but the last return the columns of `documents`, in their order, and pass further columns through, whatever
their names. In every stage a null text is an empty one, an empty table stays empty, rows that repeat are
each decided alike, and a null doc_id is a document that nothing else is compared with. A stage first deletes those scratch tables
of earlier ones that no DataFrame refers to any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import materialise, sweep


def _apart(docs: DataFrame, results: list[str]) -> dict[str, str]:
    """Other names, while a stage works, for columns of docs that are named like the operator's results."""
    return {c: f"own {c}" for c in docs.columns if c.lower() in results}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the co-trained quality classifier accepts. Without usable labels all stays; nulls in the
    metadata count as values."""
    from locusflow.llm.quality import classify

    sweep(collect=True)
    own = _apart(docs, ["p_text", "p_meta", "p_good", "accepted"])
    scored = classify(docs.withColumnsRenamed(own), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_columns=True)
    return scored.where("accepted").select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that a smaller doc_id holds too; documents that this empties go, those that were empty
    stay. n_chars changes where lines go. A null doc_id keeps its lines."""
    from locusflow.llm.lines import dedup_lines

    sweep(collect=True)
    own = _apart(docs, ["n_lines", "n_dropped", "kept"])
    out = dedup_lines(docs.withColumnsRenamed(own))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    chars = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    out = out.where((F.col("n_dropped") == 0) | (F.trim("kept") != ""))
    made = {"text": text, "n_chars": chars}
    return out.select(*[made.get(c, F.col(f"`{own.get(c, c)}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, stays of each group of near copies (five-word shingles, a
    similarity of 0.8). Documents without words, and rows of one doc_id, stay."""
    from locusflow.llm.neardup import components

    sweep(collect=True)
    found = components(docs, words=5)
    return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item, re-parameterised or not, go. A null doc_id stays."""
    from locusflow.llm.decontaminate import leaks

    sweep(collect=True)
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document that stays: digests of its token ids and of the decoded text."""
    from locusflow.llm.bpe import round_trip
    from locusflow.llm.queries import tokenizer_path

    sweep(collect=True)
    return round_trip(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", tokens),
]

#: Co-training, signatures and BPE merges are beyond SQL; a plain version to test run() against is still to be written.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
