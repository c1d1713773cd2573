"""k-mer enumeration, index, frequencies and distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabets import complement


def _check(k: int) -> None:
    if not 4 <= k <= 16:
        raise ValueError("k must be in 4..16")


def kmers(seqs: DataFrame, k: int, id_col: str = "id", seq_col: str = "seq", letters: str = "acgt") -> DataFrame:
    """(id, pos, kmer) of all windows without invalid letters; k-mers in lower case, k in 4..16. A
    look-ahead gives the windows in one pass; a substring for each place would be quadratic."""
    _check(k)
    windows = F.regexp_extract_all(F.lower(F.col(seq_col)), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    out = seqs.select(F.col(id_col).alias("id"), F.posexplode(windows).alias("pos", "kmer"))
    return out.where(F.col("kmer").rlike(f"^[{letters}]{{{k}}}$"))


def kmer_words(seqs: DataFrame, k: int, seq_col: str = "seq", letters: str = "acgt") -> DataFrame:
    """(kmer) of all valid windows, without ids and places."""
    _check(k)
    return seqs.select(F.explode(F.regexp_extract_all(F.lower(F.col(seq_col)), F.lit(f"(?=([{letters}]{{{k}}}))"), F.lit(1))).alias("kmer"))


def each_kmer(seqs: DataFrame, k: int, value: Callable[[Column], Column], **kw) -> DataFrame:
    """(id, pos, kmer, value) with a function of the k-mer's column."""
    return kmers(seqs, k, **kw).withColumn("value", value(F.col("kmer")))


def positions(seqs: DataFrame, kmer: str, **kw) -> DataFrame:
    """(id, pos) of one k-mer."""
    return kmers(seqs, len(kmer), **kw).where(F.col("kmer") == kmer.lower()).select("id", "pos")


def encode(kmer: Column) -> Column:
    """Two bits a base, as a long."""
    return F.aggregate(F.split(F.lower(kmer), ""), F.lit(0).cast("long"), lambda a, c: a * 4 + F.instr(F.lit("acgt"), c) - 1)


def decode(code: Column, k: int) -> Column:
    return F.concat(*[F.substring(F.lit("acgt"), (F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)])


def gc(code: Column, k: int) -> Column:
    """Share of c and g: bits of a base differ for these."""
    return F.bit_count(code.bitwiseXOR(F.shiftright(code, 1)).bitwiseAND(F.lit(0x55555555 & ((1 << 2 * k) - 1)))) / k


def revcomp_code(code: Column, k: int) -> Column:
    return encode(F.reverse(complement(decode(code, k))))


def index(seqs: DataFrame, k: int, **kw) -> DataFrame:
    """(kmer, positions array<struct<id,pos>>)."""
    return kmers(seqs, k, **kw).groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("id", "pos"))).alias("positions"))


def frequencies(seqs: DataFrame, k: int, id_col: str = "id", seq_col: str = "seq", per_window: bool = False) -> DataFrame:
    """(id, kmer, n, share): the share is of the sequence's length, or with per_window of its windows."""
    of = F.length(seq_col) - (k - 1 if per_window else 0)
    sizes = seqs.select(F.col(id_col).alias("id"), of.alias("of"))
    return kmers(seqs, k, id_col, seq_col).groupBy("id", "kmer").agg(F.count("*").alias("n")).join(sizes, "id").select("id", "kmer", "n", (F.col("n") / F.col("of")).alias("share"))


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Euclidean distance of two tables (kmer, share), over all their k-mers."""
    both = a.select("kmer", F.col("share").alias("x")).join(b.select("kmer", F.col("share").alias("y")), "kmer", "full_outer")
    return both.agg(F.sqrt(F.sum(F.pow(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)), F.lit(2.0)))).alias("distance"))


def debruijn(letters: str, order: int) -> str:
    """The first de Bruijn sequence: Lyndon words whose length divides the order, in order."""
    n, word, out = len(letters), [0], [0] if order >= 1 else []
    while True:
        word = [word[i % len(word)] for i in range(order)]
        while word and word[-1] == n - 1:
            word.pop()
        if not word:
            return "".join(letters[i] for i in out)
        word[-1] += 1
        if order % len(word) == 0:
            out += word


def seed_filter(target: DataFrame, query: DataFrame, target_length: int | None, k: int, min_match: int, max_error: int, tube_offset: int, self_align: bool = False, complement_strand: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits (by, from, to, diagonal) of tubes with enough shared k-mers; inputs are (pos, kmer) and by.

    A join on k-mers gives seeds; each goes to its tube, and near a border to the one before; in a
    tube, seeds more than min_match - k apart are of different hits. by: columns of the query's
    (such as ids and a strand) that tell pairs apart; target_length None: a column of the target.
    self_align keeps the half above the diagonal: q > t, or on the complement strand
    q >= target_length - t."""
    from pyspark.sql import Window

    own = [c for c in by if c in query.columns]
    other = [c for c in by if c not in query.columns]
    length = F.col("target_length") if target_length is None else F.lit(target_length)
    t = target.select("kmer", F.col("pos").alias("t"), *other, *(["target_length"] if target_length is None else []))
    seeds = t.join(query.select("kmer", F.col("pos").alias("q"), *own), "kmer")
    if self_align:
        seeds = seeds.where(F.col("q") >= length - F.col("t") if complement_strand else F.col("q") > F.col("t"))
    d = length - F.col("t") + F.col("q")
    tube = F.floor(d / tube_offset).cast("long")
    tubes = F.when(d % tube_offset < max_error, F.array(tube, tube - 1)).otherwise(F.array(tube))
    rows = seeds.select(*by, length.alias("length"), "q", F.explode(tubes).alias("tube"))
    w = Window.partitionBy(*by, "tube").orderBy("q")
    opens = F.coalesce(F.col("q") - F.lag("q").over(w) > min_match - k, F.lit(True)).cast("int")
    runs = rows.withColumn("run", opens)
    runs = runs.withColumn("run", F.sum("run").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hits = runs.groupBy(*by, "tube", "run").agg(F.min("q").alias("from"), (F.max("q") + k).alias("to"), F.count("*").alias("n"), F.first("length").alias("length"))
    return hits.where(F.col("n") >= min_words(k, min_match, max_error)).select(*by, "from", "to", (F.col("length") - F.col("tube") * tube_offset).alias("diagonal"))


def min_words(k: int, min_match: int, max_error: int) -> int:
    """Words that a match of min_match letters with up to max_error errors must share."""
    return min_match + 1 - k * (max_error + 1)
