"""Each operator on the test tables, over whole tables and texts, beside SQL with the same result.

Documents stand for sequences: letters a-z map to acgt in turn, other characters go. Line items
stand for features: the supplier is the location, the ship day the start, the quantity the length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabets as A
from ..functions import quality as Q
from ..functions import sequences as S
from ..operators import align as AL
from ..operators import consensus as C
from ..operators import intervals as I
from ..operators import kmers as K
from ..operators import repeats as R
from ..streaming import session_counts

_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", ("acgt" * 7)[:26]
_SEQ = f"translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{_FROM}', '{_TO}')"
_SEQS = f"WITH s AS (SELECT doc_id AS id, {_SEQ} AS seq FROM documents) "
_FEATS = "WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS loc, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) AS e, l_returnflag AS flag FROM lineitem) "


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dna(text: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")), _FROM, _TO)


def _seqs(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _dna(F.col("text")).alias("seq"))


def _features(spark, sf_dir) -> DataFrame:
    start = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    return _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("loc"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.col("l_returnflag").alias("flag"))


def revcomp(spark, sf_dir):
    return _seqs(spark, sf_dir).select("id", F.md5(A.revcomp(F.col("seq"))).alias("digest"), F.length("seq").cast("long").alias("len"))


def validate(spark, sf_dir):
    raw = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), A.first_invalid(raw, "Protein").cast("long").alias("first_invalid"))


def fasta_wrap(spark, sf_dir):
    return _seqs(spark, sf_dir).select("id", F.md5(S.wrap(F.col("seq"), 60)).alias("digest"))


def stitch(spark, sf_dir):
    f = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((28, 37), (1, 8), (5, 12))], F.struct(F.lit(49).alias("start"), F.greatest(F.length("seq") - 1, F.lit(49)).alias("end")))
    return _seqs(spark, sf_dir).select("id", F.md5(S.stitch(F.col("seq"), f)).alias("digest"))


def compose(spark, sf_dir):
    f = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(o).alias("orient")) for a, b, o in ((0, 32, 1), (1, 8, -1))], F.struct(F.lit(28).alias("start"), F.greatest(F.length("seq") - 1, F.lit(28)).alias("end"), F.lit(1).alias("orient")))
    return _seqs(spark, sf_dir).select("id", F.md5(S.compose(F.col("seq"), f)).alias("digest"))


def truncate_circular(spark, sf_dir):
    return _seqs(spark, sf_dir).select("id", S.truncate(F.col("seq"), F.lit(12), F.lit(5), 0, True).alias("part")).select("id", F.md5("part").alias("digest"))


def complexity(spark, sf_dir):
    return _seqs(spark, sf_dir).select("id", F.round(S.entropic_complexity(F.col("seq")), 9).alias("entropic"))


def phred(spark, sf_dir):
    p = F.col("l_discount")
    return _read(spark, sf_dir, "lineitem").groupBy(Q.phred_of(p).cast("long").alias("q")).agg(F.count("*").alias("n"))


def trimmed_reads(spark, sf_dir):
    scores = Q.decode(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^!-~]", "!"), "sanger")
    t = Q.trim(scores, 0.05)
    return _read(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.col("t.start").cast("long").alias("start"), F.col("t.end").cast("long").alias("end"))


def kmer_histogram(spark, sf_dir):
    return K.kmer_words(_seqs(spark, sf_dir), 8).groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_codes(spark, sf_dir):
    counts = kmer_histogram(spark, sf_dir)
    code = K.encode(F.col("kmer"))
    return counts.select(code.alias("code"), F.round(K.gc(code, 8), 6).alias("gc"), K.decode(code, 8).alias("kmer"), K.revcomp_code(code, 8).alias("other"), "n")


def kmer_distance(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("lang", _dna(F.col("text")).alias("seq"), F.col("doc_id").alias("id"))

    def share(lang):
        own = K.kmer_words(docs.where(F.col("lang") == lang), 6).groupBy("kmer").agg(F.count("*").alias("n"))
        return own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("of")))).select("kmer", (F.col("n") / F.col("of")).alias("share"))

    return K.distance(share("en"), share("de")).select(F.round("distance", 9).alias("distance"))


def overlaps(spark, sf_dir):
    f = _features(spark, sf_dir)
    return I.overlap_join(f.where("flag = 'R'"), f.where("flag = 'A'"), 64).groupBy("loc").agg(F.count("*").alias("pairs"), F.sum(F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("shared"))


def contained(spark, sf_dir):
    f = _features(spark, sf_dir)
    return I.overlap_join(f.where("flag = 'R'"), f.where("flag = 'A'"), 64, contained=True).groupBy("loc").agg(F.count("*").alias("pairs"))


def islands(spark, sf_dir):
    return I.islands(_features(spark, sf_dir), ["loc"]).select("loc", "start", "end", "n")


def piles(spark, sf_dir):
    return R.piles(_features(spark, sf_dir), ["loc"], 3).select("loc", "start", "end", "n")


def introns(spark, sf_dir):
    return I.introns(I.islands(_features(spark, sf_dir), ["loc"]), "loc")


def transcripts(spark, sf_dir):
    out = I.transcript_summary(_features(spark, sf_dir), "loc")
    return out.select("loc", "spliced", "start", "end", "valid")


def parent_chain(spark, sf_dir):
    region, nation, supplier = (_read(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    rows = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(0).alias("start"), F.lit(1).alias("orient"), F.lit(None).cast("string").alias("parent_id"))
    rows = rows.union(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.col("n_nationkey").cast("int"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(-1), F.concat(F.lit("r"), "n_regionkey")))
    rows = rows.union(supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.lit(7), F.lit(-1), F.concat(F.lit("n"), "s_nationkey")))
    return I.base_positions(rows).select("id", "base_id", "base_start", "base_orient")


def majority_consensus(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("aln_id"), F.col("turn").alias("row"), F.lit(0).alias("offset"), _dna(F.col("text")).alias("seq"))
    return C.majority(C.cells(rows)).select("aln_id", F.col("pos").cast("long").alias("pos"), "letter", F.round("share", 9).alias("share"))


def edit_alignment(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark").select("item_id", _dna(F.col("text")).alias("seq"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("seq").alias("query")), "item_id").select("item_id", F.col("seq").alias("ref"), "query")
    return AL.align(pairs, matrix=AL.unit_matrix(5, 0, -1, -1)).select("item_id", AL.score(F.col("segments")).cast("long").alias("score"))


def local_alignment(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark").select("item_id", _dna(F.col("text")).alias("seq"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("seq").alias("query")), "item_id").select("item_id", F.col("seq").alias("ref"), "query")
    out = AL.align(pairs, matrix=AL.unit_matrix(5, 2, -1, -1), mode="local")
    shown = AL.formatted(F.col("segments"), F.col("ref"), F.col("query"))
    return out.select("item_id", AL.score(F.col("segments")).cast("long").alias("score"), shown["a"].alias("a"), shown["b"].alias("b"))


_PWM = [[5, 1, 0, 2], [0, 6, 1, 1], [1, 0, 7, 0], [2, 2, 2, 6]]


def motif_hits(spark, sf_dir):
    return C.pwm_hits(_seqs(spark, sf_dir), _PWM, 0.9).groupBy("id").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first"))


def sessions(spark, sf_dir):
    return session_counts(_read(spark, sf_dir, "events"), "ts", "user_id", "30 minutes").select("user_id", "start", "n")


QUERIES = {f.__name__: f for f in (overlaps, revcomp, validate, fasta_wrap, stitch, compose, truncate_circular, complexity, phred, trimmed_reads, kmer_histogram, kmer_codes, kmer_distance, contained, islands, piles, introns, transcripts, parent_chain, majority_consensus, edit_alignment, local_alignment, motif_hits, sessions)}

_COMP = "translate({}, 'acgt', 'tgca')"
_ISLANDS = _FEATS + ", o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY loc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM f), g AS (SELECT *, sum(o) OVER (PARTITION BY loc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o), i AS (SELECT loc, min(s) AS \"start\", max(e) AS \"end\", count(*) AS n FROM g GROUP BY loc, g) "
_KMERS = "SELECT substr(seq, i::BIGINT, {k}) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM s)"
_JOIN = "FROM f a JOIN f b ON a.loc = b.loc AND a.flag = 'R' AND b.flag = 'A' AND a.e > a.s AND b.e > b.s AND a.s < b.e AND b.s < a.e"
_PART = "CASE WHEN least({b}, length(seq)) > {a} THEN substr(seq, {a} + 1, least({b}, length(seq)) - {a}) ELSE '' END"
_p = lambda a, b: _PART.format(a=a, b=b)
_shares = lambda lang: f"(SELECT kmer, count(*) / sum(count(*)) OVER () AS share FROM (SELECT substr(seq, i::BIGINT, 6) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS i FROM (SELECT {_SEQ} AS seq FROM documents WHERE lang = '{lang}'))) GROUP BY kmer)"
_CODE = lambda x: " + ".join(f"(instr('acgt', substr({x}, {i + 1}, 1)) - 1) * {4 ** (7 - i)}" for i in range(8))
_pwm = " + ".join("CASE substr(seq, i::BIGINT + {k}, 1) WHEN 'a' THEN {0} WHEN 'c' THEN {1} WHEN 'g' THEN {2} ELSE {3} END".format(*row, k=k) for k, row in enumerate(_PWM))

SQL = {
    "overlaps": _FEATS + "SELECT a.loc, count(*) AS pairs, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS shared " + _JOIN + " GROUP BY a.loc",
    "contained": _FEATS + "SELECT a.loc, count(*) AS pairs " + _JOIN + " WHERE a.s >= b.s AND a.e <= b.e GROUP BY a.loc",
    "revcomp": _SEQS + f"SELECT id, md5(reverse({_COMP.format('seq')})) AS digest, length(seq)::BIGINT AS len FROM s",
    "validate": r"WITH t AS (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '\s', '', 'g') AS x FROM documents), v AS (SELECT id, x, length(regexp_extract(x, '^[-a-npqrstvwxyzA-NPQRSTVWXYZ*]*')) AS n FROM t) SELECT id, CASE WHEN n = length(x) THEN -1 ELSE n END::BIGINT AS first_invalid FROM v",
    "fasta_wrap": _SEQS + r"SELECT id, md5(rtrim(regexp_replace(seq, '(.{60})', '\1' || chr(10), 'g'), chr(10))) AS digest FROM s",
    "stitch": _SEQS + f"SELECT id, md5({_p(1, 12)} || {_p(28, 37)} || {_p(49, 'length(seq) - 1')}) AS digest FROM s",
    "compose": _SEQS + f"SELECT id, md5({_p(0, 32)} || reverse({_COMP.format(_p(1, 8))}) || {_p(28, 'length(seq) - 1')}) AS digest FROM s",
    "truncate_circular": _SEQS + "SELECT id, md5(CASE WHEN length(seq) >= 12 THEN substr(seq, 13) || substr(seq, 1, 5) END) AS digest FROM s",
    "complexity": _SEQS + ", c AS (SELECT id, length(seq) AS n, unnest(['a', 'c', 'g', 't']) AS l, seq FROM s), d AS (SELECT id, n, length(seq) - length(replace(seq, l, '')) AS k FROM c) SELECT id, round(coalesce(sum(CASE WHEN k > 0 THEN -(k / n) * ln(k / n) / ln(4) ELSE 0 END), 0), 9) AS entropic FROM d GROUP BY id",
    "phred": "SELECT CASE WHEN l_discount <= 0 THEN 254 ELSE least(254, floor(-10 * log10(l_discount) + 0.5)) END::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1",
    "kmer_histogram": _SEQS + f"SELECT kmer, count(*) AS n FROM ({_KMERS.format(k=8)}) GROUP BY kmer",
    "kmer_codes": _SEQS + f", h AS (SELECT kmer, count(*) AS n FROM ({_KMERS.format(k=8)}) GROUP BY kmer), r AS (SELECT kmer, n, reverse({_COMP.format('kmer')}) AS rc FROM h) SELECT ({_CODE('kmer')})::BIGINT AS code, round(length(regexp_replace(kmer, '[at]', '', 'g')) / 8, 6) AS gc, kmer, ({_CODE('rc')})::BIGINT AS other, n FROM r",
    "kmer_distance": f"SELECT round(sqrt(sum(power(coalesce(a.share, 0) - coalesce(b.share, 0), 2))), 9) AS distance FROM {_shares('en')} a FULL OUTER JOIN {_shares('de')} b USING (kmer)",
    "islands": _ISLANDS + 'SELECT loc, "start", "end", n FROM i',
    "piles": _FEATS + ", o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY loc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3 THEN 0 ELSE 1 END AS o FROM f), g AS (SELECT *, sum(o) OVER (PARTITION BY loc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT loc, min(s) AS \"start\", max(e) AS \"end\", count(*) AS n FROM g GROUP BY loc, g",
    "introns": _ISLANDS + ', p AS (SELECT loc, lag("end") OVER (PARTITION BY loc ORDER BY "start") AS a, "start" AS b FROM i) SELECT loc, a AS "start", b AS "end" FROM p WHERE a < b',
    "transcripts": _FEATS + ', p AS (SELECT *, CASE WHEN s < lag(e) OVER (PARTITION BY loc ORDER BY s) THEN 1 ELSE 0 END AS bad FROM f) SELECT loc, sum(e - s)::BIGINT AS spliced, min(s) AS "start", max(e) AS "end", min(s) = 0 AND sum(bad) = 0 AS valid FROM p GROUP BY loc',
    "parent_chain": "SELECT 'r' || r_regionkey AS id, 'r' || r_regionkey AS base_id, 0::BIGINT AS base_start, 1 AS base_orient FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END FROM nation UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 7 + n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE 1 END FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "majority_consensus": f"WITH s AS (SELECT conv_id AS id, {_SEQ} AS seq FROM conversations), c AS (SELECT id, i - 1 AS pos, substr(seq, i::BIGINT, 1) AS letter FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s)), n AS (SELECT id, pos, letter, count(*) AS n, sum(count(*)) OVER (PARTITION BY id, pos) AS total, row_number() OVER (PARTITION BY id, pos ORDER BY count(*) DESC, letter) AS r FROM c GROUP BY id, pos, letter) SELECT id AS aln_id, pos, letter, round(n / total, 9) AS share FROM n WHERE r = 1",
    "edit_alignment": f"WITH s AS (SELECT item_id, {_SEQ} AS seq FROM benchmark) SELECT a.item_id, -levenshtein(a.seq, b.seq)::BIGINT AS score FROM s a JOIN s b ON b.item_id = a.item_id + 1",
    "motif_hits": _SEQS + f", w AS (SELECT id, i - 1 AS pos, ({_pwm}) / 24.0 AS score FROM (SELECT id, seq, unnest(range(1, length(seq) - 2)) AS i FROM s)) SELECT id, count(*) AS n, min(pos)::BIGINT AS first FROM w WHERE score >= 0.9 GROUP BY id",
    "sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, o DESC ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS \"start\", count(*) AS n FROM g GROUP BY user_id, g",
}
