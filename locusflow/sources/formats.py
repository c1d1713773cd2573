"""FASTA, FASTQ, BED, GFF2 and FAI as DataFrames, parsed with Spark's functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabets import strand_code, strand_text
from ..functions.quality import decode, encode
from ..functions.sequences import wrap


def read_fasta(spark: SparkSession, path: str, id_prefix: str = ">") -> DataFrame:
    """(id, desc, seq, error). Records are split at a line's first prefix, so files split over tasks. What
    stands before a file's first header has a null id and an error."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")]
    raw = spark.read.text(path, lineSep="\n" + id_prefix).select("value", *place)
    # only a file's first record keeps its prefix; of files without one, the first row is headless
    first = raw.where("block = 0").groupBy("file").agg(F.min("n").alias("n"), F.max(F.startswith("value", F.lit(id_prefix))).alias("headed")).where("not headed")
    rows = raw.join(first.select("file", "n", F.lit(True).alias("headless")), ["file", "n"], "left").where(F.trim("value") != "")
    record = F.when(F.startswith("value", F.lit(id_prefix)), F.substr("value", F.lit(len(id_prefix) + 1))).otherwise(F.col("value"))
    head = F.when(F.col("headless").isNull(), F.regexp_extract(record, r"^([^\r\n]*)", 1))
    body = F.when(F.col("headless").isNull(), F.regexp_replace(record, r"^[^\r\n]*", "")).otherwise(record)
    error = F.when(F.col("headless"), "letters before the first header")
    return rows.select(F.regexp_extract(head, r"^([^ \t]*)", 1).alias("id"), F.regexp_extract(head, r"^[^ \t]*[ \t](.*)$", 1).alias("desc"), F.regexp_replace(body, r"\s", "").alias("seq"), error.alias("error"))


def read_alignment(spark: SparkSession, path: str, aln_id: str) -> DataFrame:
    """Rows (aln_id, row, offset, seq) of one FASTA file; `row` is the id."""
    return read_fasta(spark, path).where("error is null").select(F.lit(aln_id).alias("aln_id"), F.col("id").alias("row"), F.lit(0).alias("offset"), "seq")


def fasta_text(id_: Column, desc: Column, seq: Column, width: int = 60) -> Column:
    head = F.concat(F.lit(">"), id_, F.when(F.coalesce(desc, F.lit("")) != "", F.concat(F.lit(" "), desc)).otherwise(""))
    return F.concat(head, F.lit("\n"), wrap(seq, width))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    df.select(fasta_text(F.col("id"), F.col("desc"), F.col("seq"), width).alias("value")).write.text(path)


_RECORD = r"@([^\n]*)\n+(?:([^\n+][^\n]*)\n+\+([^\n]*)\n+([^\n]+)|\+([^\n]*))"


def fastq_records(texts: DataFrame, encoding: str = "sanger") -> DataFrame:
    """(id, desc, seq, qual, error) of whole FASTQ texts (value); see read_fastq()."""
    text = F.regexp_replace("value", r"\r", "")
    rest = F.regexp_replace(F.regexp_replace(text, r"(?:^|(?<=\n))" + _RECORD, ""), r"\s", "")
    found = F.regexp_extract_all(text, F.lit(r"(?:^|(?<=\n))" + _RECORD), F.lit(0))
    rows = texts.select(F.explode(F.concat(found, F.when(rest != "", F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))).alias("r"))
    part = lambda i: F.regexp_extract("r", "^" + _RECORD, i)
    head, seq, plus, qual = part(1), part(2), F.concat(part(3), part(5)), part(4)
    error = F.when(F.col("r").isNull(), "lines that are no record").when((plus != "") & (plus != head), "labels differ").when(F.length(seq) != F.length(qual), "lengths differ")
    return rows.select(F.regexp_extract(head, r"^([^ \t]*)", 1).alias("id"), F.regexp_extract(head, r"^[^ \t]*[ \t](.*)$", 1).alias("desc"), seq.alias("seq"), decode(qual, encoding).alias("qual"), error.alias("error"))


def read_fastq(spark: SparkSession, path: str, encoding: str = "sanger") -> DataFrame:
    """(id, desc, seq, qual, error) of records of header, letters, second header and scores; blank lines
    between these are skipped, and letters and scores may both be missing. error names what is wrong
    with a record; a row without id says that a file has other lines. A file is one row of one task,
    as scores may look like headers and records can't be told apart within: keep files below 1 GB."""
    return fastq_records(spark.read.text(path, wholetext=True), encoding)


def fastq_text(id_: Column, desc: Column, seq: Column, qual: Column, encoding: str = "sanger", repeat_id: bool = False) -> Column:
    head = F.concat(id_, F.when(F.coalesce(desc, F.lit("")) != "", F.concat(F.lit(" "), desc)).otherwise(""))
    return F.concat(F.lit("@"), head, F.lit("\n"), seq, F.lit("\n+"), head if repeat_id else F.lit(""), F.lit("\n"), encode(qual, encoding))


def write_fastq(df: DataFrame, path: str, encoding: str = "sanger", repeat_id: bool = False) -> None:
    df.select(fastq_text(F.col("id"), F.col("desc"), F.col("seq"), F.col("qual"), encoding, repeat_id).alias("value")).write.text(path)


def _ints(c: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(c, ",$", ""), ","), lambda x: x.try_cast("int"))


def read_bed(spark: SparkSession, path: str, columns: int = 12) -> DataFrame:
    """BED with the first 3, 4, 5, 6 or 12 columns; error names what is wrong with a row. Comments, track
    and browser lines and blank lines are skipped."""
    return bed_rows(spark.read.text(path), columns)


def bed_rows(lines: DataFrame, columns: int = 12) -> DataFrame:
    """Rows of read_bed() from lines (value)."""
    if columns not in (3, 4, 5, 6, 12):
        raise ValueError("BED has 3, 4, 5, 6 or 12 columns")
    t = F.split("value", "\t")
    get = lambda i: F.get(t, F.lit(i))
    rgb = F.when(get(8) != "0", F.struct(*[F.get(F.split(get(8), ","), F.lit(i)).try_cast("smallint").alias(c) for i, c in enumerate("rgb")]))
    made = [get(0).alias("chrom"), get(1).try_cast("int").alias("start"), get(2).try_cast("int").alias("end"), get(3).alias("name"), get(4).try_cast("int").alias("score"), strand_code(get(5)).alias("strand"), get(6).try_cast("int").alias("thick_start"), get(7).try_cast("int").alias("thick_end"), rgb.alias("rgb"), get(9).try_cast("int").alias("block_count"), _ints(get(10)).alias("block_sizes"), _ints(get(11)).alias("block_starts")]
    error = F.when(F.size(t) < columns, "too few columns").when(get(1).try_cast("int").isNull() | get(2).try_cast("int").isNull(), "bad position")
    if columns >= 6:
        error = error.when(~get(5).isin("+", "-", "."), "bad strand")
    if columns == 12:
        error = error.when((get(9).try_cast("int") != F.size(_ints(get(10)))) | (get(9).try_cast("int") != F.size(_ints(get(11)))), "block counts differ")
    return lines.where(~F.col("value").rlike(r"^(?:\s*$|#|track\b|browser\b)")).select(*made[:columns], error.alias("error"))


def bed_text(have: set[str], columns: int = 6) -> Column:
    """The line of a BED row whose table has the columns `have`."""
    col = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in have else F.lit(other)
    strand = F.coalesce(strand_text(F.col("strand")), F.lit(".")) if "strand" in have else F.lit(".")
    made = [F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), col("name", ""), col("score", "0"), strand]
    if columns == 12:
        rgb = F.when(F.col("rgb").isNull(), "0").otherwise(F.concat_ws(",", "rgb.r", "rgb.g", "rgb.b"))
        lists = [F.concat(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(",")) for c in ("block_sizes", "block_starts")]
        made += [F.col("thick_start").cast("string"), F.col("thick_end").cast("string"), rgb, F.col("block_count").cast("string"), *lists]
    return F.concat_ws("\t", *made[:columns])


def write_bed(df: DataFrame, path: str, columns: int = 6) -> None:
    """The first columns of BED rows; missing scores are 0, missing strands a dot."""
    df.select(bed_text(set(df.columns), columns).alias("value")).write.text(path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF2 features; start becomes zero-based, attributes are an array of (tag, value) in order. error:
    rows with fewer than eight columns, bad positions, or a start that isn't before the end."""
    return gff_rows(spark.read.text(path))


def gff_rows(lines: DataFrame) -> DataFrame:
    """Rows of read_gff() from lines (value)."""
    t = F.split("value", "\t")
    get = lambda i: F.get(t, F.lit(i))
    parts = F.filter(F.transform(F.split(get(8), ";"), lambda x: F.trim(x)), lambda x: x != "")
    attributes = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("tag"), F.regexp_extract(x, r"^\S+\s+(.*)$", 1).alias("value")))
    start, end = get(3).try_cast("int") - 1, get(4).try_cast("int")
    error = F.when(F.size(t) < 8, "too few columns").when(start.isNull() | end.isNull(), "bad position").when(start >= end, "start isn't before end").when(~get(6).isin("+", "-", "."), "bad strand")
    return lines.where("trim(value) <> '' and not startswith(value, '#')").select(get(0).alias("seqname"), get(1).alias("source"), get(2).alias("feature"), start.alias("start"), end.alias("end"), get(5).try_cast("double").alias("score"), strand_code(get(6)).alias("strand"), get(7).try_cast("tinyint").alias("frame"), attributes.alias("attributes"), get(9).alias("comments"), error.alias("error"))


def read_gff_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(moltype, id, seq) of the inline sequence blocks of GFF files; a file is one row of one task."""
    block = r"(?m)^##(DNA|RNA|Protein) (\S+)[^\n]*\n((?:##(?!end-)[^\n]*\n)*+)##end-\1"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(block), F.lit(0))).alias("b"))
    return rows.select(F.regexp_extract("b", block, 1).alias("moltype"), F.regexp_extract("b", block, 2).alias("id"), F.regexp_replace(F.regexp_extract("b", block, 3), r"##|\s", "").alias("seq"))


def gff_sequence_text(moltype: Column, id_: Column, seq: Column, width: int = 60) -> Column:
    """An inline sequence block."""
    body = F.regexp_replace(wrap(seq, width), "(?m)^", "##")
    return F.concat(F.lit("##"), moltype, F.lit(" "), id_, F.lit("\n"), body, F.lit("\n##end-"), moltype)


def gff_region_text(id_: Column, start: Column, end: Column) -> Column:
    """A sequence-region line, one-based."""
    return F.concat_ws(" ", F.lit("##sequence-region"), id_, (start + 1).cast("string"), end.cast("string"))


def gff_header(version: int = 2, **meta: str) -> list[str]:
    """The ## lines that open a file, such as date or source-version (named with _)."""
    return [f"##gff-version {version}", *(f"##{k.replace('_', '-')} {v}" for k, v in meta.items())]


def read_gff_meta(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the ## lines."""
    return spark.read.text(path).where("startswith(value, '##')").select(F.regexp_extract("value", r"^##\s*(\S+)", 1).alias("key"), F.regexp_extract("value", r"^##\s*\S+\s*(.*)$", 1).alias("value"))


def gff_text(digits: int = 4) -> Column:
    """The line of a feature row of read_gff()'s columns."""
    attributes = F.array_join(F.transform("attributes", lambda a: F.concat_ws(" ", a["tag"], a["value"])), "; ")
    return F.concat_ws("\t", "seqname", "source", "feature", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.coalesce(F.format_string(f"%.{digits}f", "score"), F.lit(".")), F.coalesce(strand_text(F.col("strand")), F.lit(".")), F.coalesce(F.col("frame").cast("string"), F.lit(".")), attributes)


def write_gff(df: DataFrame, path: str, digits: int = 4) -> None:
    df.select(gff_text(digits).alias("value")).write.text(path)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """FASTA index rows; names that repeat have an error."""
    from pyspark.sql import Window

    rows = spark.read.csv(path, sep="\t", schema="name string, length long, start long, bases_per_line int, bytes_per_line int")
    return rows.withColumn("error", F.when(F.count("*").over(Window.partitionBy("name")) > 1, "name repeats"))


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
