"""More operators on the test tables, each beside SQL with the same result; with those of catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import sequences as S
from ..operators import align as AL
from ..operators import consensus as C
from ..operators import genome as G
from ..operators import intervals as I
from ..operators import kmers as K
from ..operators import msa as M
from ..operators import repeats as R
from ..operators.banded import find_repeats
from ..sources import formats
from ..streaming import first_events, window_counts
from . import catalog
from .catalog import _FEATS, _SEQ, _SEQS, _dna, _features, _read, _seqs


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as alignments whose rows start at different places."""
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("aln_id"), F.col("turn").cast("long").alias("row"), (F.col("turn") % 5).cast("long").alias("offset"), _dna(F.col("text")).alias("seq"))


def _digests(rows: DataFrame) -> DataFrame:
    return rows.select("aln_id", "row", F.col("offset").cast("long").alias("offset"), F.md5("seq").alias("digest"))


def nearest_feature(spark, sf_dir):
    f = _features(spark, sf_dir)
    return I.nearest_before(f.where("flag = 'R'"), f.where("flag = 'A'")).where("near_id is not null").groupBy("loc", "near_id", "near_start").agg(F.count("*").alias("n"))


def coverage(spark, sf_dir):
    return I.coverage(_features(spark, sf_dir), ["loc"]).select("loc", "total", "covered")


def feature_sets(spark, sf_dir):
    """Starts of each location that both kinds have, and that only the first one has."""
    f = _features(spark, sf_dir)
    a, b = (f.where(F.col("flag") == x).select("loc", "start") for x in "RA")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.exceptAll(b).distinct().withColumn("kind", F.lit("more"))).groupBy("loc", "kind").agg(F.count("*").alias("n"))


def feature_cube(spark, sf_dir):
    f = _features(spark, sf_dir).withColumn("third", (F.col("loc") % 3).cast("string"))
    return f.cube("third", "flag").agg(F.count("*").alias("n"), F.countDistinct("start").alias("starts"))


def feature_rollup(spark, sf_dir):
    f = _features(spark, sf_dir).withColumn("third", (F.col("loc") % 3).cast("string"))
    return f.rollup("third", "flag").agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def lowest_features(spark, sf_dir):
    """The ten lowest features: sorting and taking the first."""
    return _features(spark, sf_dir).orderBy("start", "end", "id").limit(10).select("id", "start")


def feature_ranks(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("loc").orderBy("start", "end", "id")
    rows = _features(spark, sf_dir).select("id", F.ntile(4).over(w).alias("quarter"), F.rank().over(Window.partitionBy("loc").orderBy("start")).alias("rank"))
    return rows.select("id", F.col("quarter").cast("long").alias("quarter"), F.col("rank").cast("long").alias("rank"))


def free_features(spark, sf_dir):
    """R features that no A feature of the location overlaps: an anti-join."""
    f = _features(spark, sf_dir)
    met = I.overlap_join(f.where("flag = 'R'"), f.where("flag = 'A' and id % 50 = 0"), 64)
    return f.where("flag = 'R'").join(met.select(F.col("a_id").alias("id")), "id", "left_anti").groupBy("loc").agg(F.count("*").alias("n"))


def limited_text(spark, sf_dir):
    return _seqs(spark, sf_dir).select("id", F.md5(S.limited(F.col("seq"), 200)).alias("digest"))


def joined_sequences(spark, sf_dir):
    """join at the start, letters set and repeated, and the reverse."""
    made = S.join(F.col("seq"), S.repeated(F.lit("n"), 3), "start")
    seq = S.set_at(made["seq"], F.lit(-2), F.lit("a"), made["offset"])
    return _seqs(spark, sf_dir).where("seq <> ''").select("id", F.md5(S.reverse_with(S.append(seq, F.lit("acgt")))["seq"]).alias("digest"), S.at(seq, F.lit(0), made["offset"]).alias("first"), S.end_of(seq, made["offset"]).cast("long").alias("end"))


def masked_reads(spark, sf_dir):
    """Letters of low quality become n, or change case; the scores are made of the letters' places."""
    scores = F.transform(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1))), lambda i: (i * 7 % 11).cast("smallint"))
    rows = _read(spark, sf_dir, "benchmark").select("item_id", _dna(F.col("text")).alias("seq")).where("seq <> ''").withColumn("q", scores)
    return rows.select("item_id", Q.mask(F.col("seq"), F.col("q"), 3).alias("masked"), Q.mask(F.col("seq"), F.col("q"), 3, None).alias("cased"))


def solexa_scores(spark, sf_dir):
    """Scores of both scales from prices, there and back."""
    p = (F.col("l_quantity") / 100).cast("double")
    rows = _read(spark, sf_dir, "lineitem").select(Q.solexa_of(p).cast("long").alias("solexa"), Q.phred_of(p).cast("long").alias("phred"), F.round(Q.solexa_error(Q.solexa_of(p)), 9).alias("error"))
    return rows.groupBy("solexa", "phred", "error").agg(F.count("*").alias("n"))


def wf_complexity(spark, sf_dir):
    return _seqs(spark, sf_dir).where("length(seq) between 1 and 10000").select("id", F.round(S.wf_complexity(F.col("seq")), 6).alias("wf"))


def kmer_frequencies(spark, sf_dir):
    own = K.frequencies(_seqs(spark, sf_dir).where("id % 2 = 0"), 6)
    return own.groupBy("kmer").agg(F.sum("n").alias("n"), F.round(F.max("share"), 9).alias("most"))


def kmer_positions(spark, sf_dir):
    return K.positions(_seqs(spark, sf_dir), "acgtac").select("id", F.col("pos").cast("long").alias("pos"))


def kmer_index(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), _dna(F.col("text")).alias("seq"))
    return K.index(b, 8).select("kmer", F.size("positions").cast("long").alias("n"), F.col("positions")[0]["id"].alias("first_id"), F.col("positions")[0]["pos"].cast("long").alias("first_pos"))


def seed_hits(spark, sf_dir):
    """The q-gram filter between each item and the next one."""
    b = _read(spark, sf_dir, "benchmark").select("item_id", _dna(F.col("text")).alias("seq"))
    target = K.kmers(b.select(F.col("item_id").alias("id"), "seq"), 6).join(b.select(F.col("item_id").alias("id"), F.length("seq").alias("target_length")), "id").select("pos", "kmer", "target_length", F.col("id").alias("pair"))
    query = K.kmers(b.select((F.col("item_id") - 1).alias("id"), "seq"), 6).select("pos", F.concat(F.col("id"), F.lit(":"), "kmer").alias("kmer"))
    target = target.withColumn("kmer", F.concat("pair", F.lit(":"), "kmer"))
    hits = K.seed_filter(target, query, None, 6, 12, 0, 32, by=("pair",))
    return hits.select("pair", F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"), F.col("diagonal").cast("long").alias("diagonal"))


def _hits(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair"), F.concat(F.lit("c"), F.col("l_suppkey") % 5).alias("a_loc"), (F.col("l_partkey") % 50).cast("long").alias("a_start"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("long")).alias("a_end"), F.concat(F.lit("d"), F.col("l_suppkey") % 3).alias("b_loc"), (F.col("l_suppkey") % 20).cast("long").alias("b_start"), (F.col("l_suppkey") % 20 + F.col("l_quantity").cast("long") + 1).alias("b_end"), F.col("l_extendedprice").cast("long").alias("score"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand"), F.lit(0.25).alias("error"))


def best_hits(spark, sf_dir):
    return R.best_hits(_hits(spark, sf_dir), ["a_loc", "b_loc"], ["pair"]).select("pair", "score")


def pair_mates(spark, sf_dir):
    return R.mates(R.inverted(_hits(spark, sf_dir))).groupBy("side", "loc", "mate_loc").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("mate_end").alias("mate_ends"))


def pair_lines(spark, sf_dir):
    """Pairs written as GFF lines, read and expanded again."""
    lines = _hits(spark, sf_dir).select(R.pair_lines().alias("value"))
    return R.expanded(formats.gff_rows(lines)).where("error_text is null").groupBy("a_loc", "b_loc", F.col("strand").cast("long").alias("strand")).agg(F.count("*").alias("n"), F.sum(F.col("a_start")).alias("a_starts"), F.sum(F.col("b_end")).cast("long").alias("b_ends"), F.sum("score").alias("scores"), F.round(F.max("error"), 6).alias("error"))


def clipped_hits(spark, sf_dir):
    """Trapezoids cut at runs of invalid letters: two of each location."""
    t = _hits(spark, sf_dir).select("a_loc", F.col("a_start").alias("bottom"), F.col("a_end").alias("top"), F.lit(0).alias("left"), F.lit(9).alias("right"))
    runs = t.select("a_loc").distinct().select("a_loc", F.explode(F.array(F.struct(F.lit(10).alias("s"), F.lit(15).alias("e")), F.struct(F.lit(40).alias("s"), F.lit(46).alias("e")))).alias("r")).select("a_loc", F.col("r.s").cast("long").alias("start"), F.col("r.e").cast("long").alias("end"))
    return R.clipped(t, runs, ["a_loc"]).groupBy("a_loc").agg(F.count("*").alias("n"), F.sum("bottom").alias("bottoms"), F.sum("top").alias("tops"))


def pile_members(spark, sf_dir):
    f = _features(spark, sf_dir)
    return R.pile_members(f, ["loc"], 0, F.col("flag") == "R").groupBy("loc", F.col("pile_start").alias("start")).agg(F.count("*").alias("n"))


def _chain(spark, sf_dir) -> DataFrame:
    region, nation, supplier = (_read(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    rows = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(3).alias("start"), F.lit(1).alias("orient"), F.lit(None).cast("string").alias("parent_id"))
    rows = rows.union(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.col("n_nationkey").cast("int"), (F.col("n_nationkey") % 3 - 1).cast("int"), F.concat(F.lit("r"), "n_regionkey")))
    return rows.union(supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.lit(7), F.lit(-1), F.concat(F.lit("n"), "s_nationkey")))


def within_region(spark, sf_dir):
    found = I.positions_within(_chain(spark, sf_dir), "r1")
    return found.select("id", F.col("start_within").cast("long").alias("start_within"), F.col("orient_within").cast("long").alias("orient_within"))


def coding_parts(spark, sf_dir):
    """Orders as transcripts: the coding part from the first line's quantity to the last one's end."""
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("end"), F.min(F.col("l_quantity").cast("long")).alias("cds_start"), F.max(F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("orient"), F.max(F.when(F.col("l_linestatus") == "O", "coding").otherwise("other")).alias("kind"))
    out = I.coding(I.of_kind(rows.withColumns({"start": F.lit(0).cast("long"), "cds_end": F.col("end") - F.floor((F.col("end") - F.col("cds_start")) / 4)}), ("other",)))
    return out.select("id", "utr5_length", "cds_length", "utr3_length")


def msa_flush(spark, sf_dir):
    from ..operators.consensus import flush

    return _digests(flush(_aligned(spark, sf_dir)))


def msa_is_flush(spark, sf_dir):
    return M.is_flush(_aligned(spark, sf_dir))


def msa_subseq(spark, sf_dir):
    return _digests(M.subseq(_aligned(spark, sf_dir), 3, 60))


def msa_revcomp(spark, sf_dir):
    return _digests(M.revcomp(_aligned(spark, sf_dir)))


def msa_join(spark, sf_dir):
    rows = _aligned(spark, sf_dir)
    return _digests(M.join(rows, M.set_offset(rows, 100)))


def msa_columns(spark, sf_dir):
    return M.columns(M.subseq(_aligned(spark, sf_dir), 0, 40), "-").select("aln_id", F.col("pos").cast("long").alias("pos"), "letters")


def msa_add(spark, sf_dir):
    """The even rows, with the odd ones cut and filled to their extent, and without row 0."""
    rows = _aligned(spark, sf_dir)
    return _digests(M.delete(M.add(rows.where("row % 2 = 0"), rows.where("row % 2 = 1")), F.col("row") == 0))


def scored_consensus(spark, sf_dir):
    found = M.consensus(_aligned(spark, sf_dir), lambda cells: C.masked(C.scored(C.majority(cells))))
    return found.select("aln_id", F.col("pos").cast("long").alias("pos"), "letter", F.col("q").cast("long").alias("q"))


def quality_consensus(spark, sf_dir):
    cells = C.cells(_aligned(spark, sf_dir)).withColumn("q", 5 + (F.col("pos") * 7 + F.col("row") * 3) % 30)
    return C.by_quality(cells).select("aln_id", F.col("pos").cast("long").alias("pos"), "letter", F.round("p", 6).alias("p"))


def _neighbours(spark, sf_dir) -> DataFrame:
    """Each item's sequence and the next one's."""
    b = _read(spark, sf_dir, "benchmark").select("item_id", _dna(F.col("text")).alias("seq"))
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("seq").alias("query")), "item_id").select("item_id", F.col("seq").alias("ref"), "query")


def affine_alignment(spark, sf_dir):
    """With free openings and unit costs the score is the edit distance."""
    out = AL.align(_neighbours(spark, sf_dir), matrix=AL.unit_matrix(5, 0, -1, -1), opening=0)
    return out.select("item_id", AL.score(F.col("segments")).cast("long").alias("score"))


def fitted_alignment(spark, sf_dir):
    out = AL.align(_neighbours(spark, sf_dir), matrix=AL.unit_matrix(5, 2, -1, -1), mode="fitted", opening=-3)
    return out.select("item_id", AL.score(F.col("segments")).cast("long").alias("score"), F.size("segments").cast("long").alias("n"))


def repeat_hits(spark, sf_dir):
    pairs = _neighbours(spark, sf_dir).select(F.col("item_id").alias("pair"), F.col("ref").alias("target"), "query")
    return find_repeats(pairs, 12, 0.6, 6, 12, 0, 32).select("pair", "a_start", "b_start", "a_end", "b_end", "score", F.round("error", 9).alias("error"))


def z_complexity(spark, sf_dir):
    return _seqs(spark, sf_dir).select("id", F.round(S.z_complexity(F.col("seq")), 9).alias("z"))


def chromosome_shares(spark, sf_dir):
    """Places on chromosomes, one for each supplier: a join with an assembly's lengths."""
    c = G.chromosomes(spark, "hg19")
    s = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 24).alias("ord"), F.col("s_suppkey").alias("k"))
    return s.join(c, "ord").groupBy(F.col("id").alias("chrom")).agg(F.count("*").alias("n"), F.sum((F.col("k") * 1000003) % F.col("length")).alias("places"))


def event_windows(spark, sf_dir):
    return window_counts(first_events(_read(spark, sf_dir, "events"), "ts", ["user_id", "ts"]), "ts", "user_id", "1 day")


QUERIES = {**catalog.QUERIES} | {f.__name__: f for f in (nearest_feature, coverage, feature_sets, feature_cube, feature_rollup, lowest_features, feature_ranks, free_features, limited_text, joined_sequences, masked_reads, solexa_scores, wf_complexity, kmer_frequencies, kmer_positions, kmer_index, seed_hits, best_hits, pair_mates, pair_lines, clipped_hits, pile_members, within_region, coding_parts, msa_flush, msa_is_flush, msa_subseq, msa_revcomp, msa_join, msa_columns, msa_add, scored_consensus, quality_consensus, chromosome_shares, event_windows, affine_alignment, fitted_alignment, repeat_hits, z_complexity)}

_ALN = f"WITH s AS (SELECT conv_id AS aln_id, turn::BIGINT AS row, (turn % 5)::BIGINT AS \"offset\", {_SEQ} AS seq FROM conversations), x AS (SELECT *, min(\"offset\") OVER w AS a, max(\"offset\" + length(seq)) OVER w AS b FROM s WINDOW w AS (PARTITION BY aln_id)), f AS (SELECT aln_id, row, a AS \"offset\", repeat('-', (\"offset\" - a)::BIGINT) || seq || repeat('-', (b - \"offset\" - length(seq))::BIGINT) AS seq FROM x) "
_COMP = "translate({}, 'acgt', 'tgca')"
_CELLS = "c AS (SELECT aln_id, row, \"offset\" + i - 1 AS pos, substr(seq, i::BIGINT, 1) AS letter FROM (SELECT aln_id, row, \"offset\", seq, unnest(range(1, length(seq) + 1)) AS i FROM {}))"
_HITS = "WITH h AS (SELECT l_orderkey * 10 + l_linenumber AS pair, 'c' || l_suppkey % 5 AS a_loc, (l_partkey % 50)::BIGINT AS a_start, (l_partkey % 50 + l_quantity::BIGINT)::BIGINT AS a_end, 'd' || l_suppkey % 3 AS b_loc, (l_suppkey % 20)::BIGINT AS b_start, (l_suppkey % 20 + l_quantity::BIGINT + 1)::BIGINT AS b_end, trunc(l_extendedprice)::BIGINT AS score, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand FROM lineitem) "
_BENCH = f"WITH s AS (SELECT item_id AS id, {_SEQ} AS seq FROM benchmark) "
_WINDOWS = "SELECT id, i - 1 AS pos, substr(seq, i::BIGINT, {k}) AS kmer FROM (SELECT id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM s)"
_ln = lambda letter: f"sum(CASE WHEN letter = '{letter}' THEN ln(1 - e) ELSE ln(e / 3) END)"

SQL = {**catalog.SQL} | {
    "nearest_feature": _FEATS + ", a AS (SELECT loc, s, max(id) AS id FROM f WHERE flag = 'A' GROUP BY loc, s), q AS (SELECT DISTINCT loc, s FROM f WHERE flag = 'R'), near AS (SELECT q.loc, q.s, max_by(a.id, a.s) AS near_id, max(a.s) AS near_start FROM q JOIN a ON a.loc = q.loc AND a.s <= q.s GROUP BY q.loc, q.s) SELECT f.loc, near_id, near_start, count(*) AS n FROM f JOIN near ON near.loc = f.loc AND near.s = f.s WHERE f.flag = 'R' GROUP BY f.loc, near_id, near_start",
    "coverage": _FEATS + ", o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY loc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM f WHERE e > s), g AS (SELECT *, sum(o) OVER (PARTITION BY loc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o), i AS (SELECT loc, min(s) AS s, max(e) AS e, sum(e - s)::BIGINT AS t FROM g GROUP BY loc, g) SELECT loc, sum(t)::BIGINT AS total, sum(e - s)::BIGINT AS covered FROM i GROUP BY loc",
    "feature_sets": _FEATS + "SELECT loc, kind, count(*) AS n FROM (SELECT *, 'both' AS kind FROM (SELECT loc, s FROM f WHERE flag = 'R' INTERSECT SELECT loc, s FROM f WHERE flag = 'A') UNION ALL SELECT DISTINCT loc, s, 'more' FROM (SELECT loc, s FROM f WHERE flag = 'R' EXCEPT ALL SELECT loc, s FROM f WHERE flag = 'A')) GROUP BY loc, kind",
    "feature_cube": _FEATS + "SELECT third, flag, count(*) AS n, count(DISTINCT s) AS starts FROM (SELECT *, (loc % 3)::VARCHAR AS third FROM f) GROUP BY CUBE (third, flag)",
    "feature_rollup": _FEATS + "SELECT third, flag, sum(e - s)::BIGINT AS length FROM (SELECT *, (loc % 3)::VARCHAR AS third FROM f) GROUP BY ROLLUP (third, flag)",
    "lowest_features": _FEATS + 'SELECT id, s AS "start" FROM f ORDER BY s, e, id LIMIT 10',
    "feature_ranks": _FEATS + "SELECT id, ntile(4) OVER (PARTITION BY loc ORDER BY s, e, id) AS quarter, rank() OVER (PARTITION BY loc ORDER BY s) AS rank FROM f",
    "free_features": _FEATS + "SELECT loc, count(*) AS n FROM f r WHERE flag = 'R' AND NOT EXISTS (SELECT 1 FROM f a WHERE a.flag = 'A' AND a.id % 50 = 0 AND a.loc = r.loc AND a.e > a.s AND r.e > r.s AND a.s < r.e AND r.s < a.e) GROUP BY loc",
    "limited_text": _SEQS + "SELECT id, md5(substr(seq, 1, 200)) AS digest FROM s",
    "joined_sequences": _SEQS + "SELECT id, md5(reverse('nan' || seq || 'acgt')) AS digest, substr(seq, 1, 1) AS first, length(seq)::BIGINT AS \"end\" FROM s WHERE seq <> ''",
    "masked_reads": f"WITH s AS (SELECT item_id, {_SEQ} AS seq FROM benchmark), c AS (SELECT item_id, i, substr(seq, i::BIGINT, 1) AS l FROM (SELECT item_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s)) SELECT item_id, string_agg(CASE WHEN i * 7 % 11 < 3 THEN 'n' ELSE l END, '' ORDER BY i) AS masked, string_agg(CASE WHEN i * 7 % 11 < 3 THEN l ELSE upper(l) END, '' ORDER BY i) AS cased FROM c GROUP BY item_id",
    "solexa_scores": "WITH p AS (SELECT (l_quantity / 100)::DOUBLE AS p FROM lineitem), q AS (SELECT p, -10 * log10(p / (1 - p)) AS x FROM p), r AS (SELECT CASE WHEN p >= 1 THEN -127 ELSE sign(x) * floor(abs(x) + 0.5) END::BIGINT AS solexa, floor(-10 * log10(p) + 0.5)::BIGINT AS phred FROM q) SELECT solexa, phred, round(pow(10, -solexa / 10.0) / (1 + pow(10, -solexa / 10.0)), 9) AS error, count(*) AS n FROM r GROUP BY 1, 2, 3",
    "wf_complexity": _SEQS + ", d AS (SELECT id, length(seq) AS n, length(replace(seq, 'a', '')) AS na, length(replace(seq, 'c', '')) AS nc, length(replace(seq, 'g', '')) AS ng, length(replace(seq, 't', '')) AS nt FROM s WHERE length(seq) BETWEEN 1 AND 10000) SELECT id, round((lgamma(n + 1) - lgamma(n - na + 1) - lgamma(n - nc + 1) - lgamma(n - ng + 1) - lgamma(n - nt + 1)) / ln(4) / n, 6) AS wf FROM d",
    "kmer_frequencies": _SEQS + ", k AS (" + _WINDOWS.format(k=6) + " WHERE id % 2 = 0), n AS (SELECT id, kmer, count(*) AS n FROM k GROUP BY id, kmer) SELECT kmer, sum(n)::BIGINT AS n, round(max(n / length(seq)), 9) AS most FROM n JOIN s USING (id) GROUP BY kmer",
    "kmer_positions": _SEQS + "SELECT id, pos FROM (" + _WINDOWS.format(k=6) + ") WHERE kmer = 'acgtac'",
    "kmer_index": _BENCH + "SELECT kmer, count(*) AS n, min(id) AS first_id, min_by(pos, (id, pos)) AS first_pos FROM (" + _WINDOWS.format(k=8) + ") GROUP BY kmer",
    "seed_hits": _BENCH + ", k AS (" + _WINDOWS.format(k=6) + "), seed AS (SELECT t.id AS pair, length(s.seq) AS n, q.pos AS q, length(s.seq) - t.pos + q.pos AS d FROM k t JOIN k q ON q.id = t.id + 1 AND q.kmer = t.kmer JOIN s ON s.id = t.id), tube AS (SELECT pair, n, q, d // 32 AS tube FROM seed), o AS (SELECT *, CASE WHEN q - lag(q) OVER (PARTITION BY pair, tube ORDER BY q) <= 6 THEN 0 ELSE 1 END AS o FROM tube), r AS (SELECT *, sum(o) OVER (PARTITION BY pair, tube ORDER BY q, o DESC ROWS UNBOUNDED PRECEDING) AS r FROM o) SELECT pair, min(q) AS \"from\", max(q) + 6 AS \"to\", any_value(n) - tube * 32 AS diagonal FROM r GROUP BY pair, tube, r HAVING count(*) >= 7",
    "best_hits": _HITS + ", a AS (SELECT *, row_number() OVER (PARTITION BY a_loc, b_loc, a_start, b_start ORDER BY score DESC, pair) AS r FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY a_loc, b_loc, a_end, b_end ORDER BY score DESC, pair) AS r2 FROM a WHERE r = 1) SELECT pair, score FROM b WHERE r2 = 1",
    "pair_mates": _HITS + "SELECT side, loc, mate_loc, count(*) AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS mate_ends FROM (SELECT 'a' AS side, b_loc AS loc, a_loc AS mate_loc, b_start AS s, a_end AS e FROM h UNION ALL SELECT 'b', a_loc, b_loc, a_start, b_end FROM h) GROUP BY ALL",
    "pair_lines": _HITS + "SELECT a_loc, b_loc, strand::BIGINT AS strand, count(*) AS n, sum(a_start)::BIGINT AS a_starts, sum(b_end)::BIGINT AS b_ends, sum(score)::BIGINT AS scores, 0.25::DOUBLE AS error FROM h GROUP BY a_loc, b_loc, strand",
    "clipped_hits": _HITS + ", p AS (SELECT a_loc, greatest(a_start, lo) AS bottom, least(a_end, hi) AS top FROM h CROSS JOIN (VALUES (0, 10), (15, 40), (46, 1000)) v(lo, hi)) SELECT a_loc, count(*) AS n, sum(bottom)::BIGINT AS bottoms, sum(top)::BIGINT AS tops FROM p WHERE top > bottom GROUP BY a_loc",
    "pile_members": catalog._ISLANDS + "SELECT f.loc, i.\"start\", count(*) AS n FROM f JOIN i ON i.loc = f.loc AND f.s >= i.\"start\" AND f.e <= i.\"end\" WHERE f.flag = 'R' GROUP BY f.loc, i.\"start\"",
    "within_region": "SELECT 'r1' AS id, 0::BIGINT AS start_within, 1::BIGINT AS orient_within UNION ALL SELECT 'n' || n_nationkey, n_nationkey, n_nationkey % 3 - 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 's' || s_suppkey, 7 + n_nationkey, -(n_nationkey % 3 - 1) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1",
    "coding_parts": "WITH t AS (SELECT l_orderkey AS id, sum(l_quantity::BIGINT)::BIGINT AS e, min(l_quantity::BIGINT) AS cs, max(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS o, max(CASE WHEN l_linestatus = 'O' THEN 'coding' ELSE 'other' END) AS kind FROM lineitem GROUP BY l_orderkey), c AS (SELECT *, e - (e - cs) // 4 AS ce FROM t WHERE kind = 'other') SELECT id, CASE WHEN o = 1 THEN cs ELSE e - ce END AS utr5_length, ce - cs AS cds_length, CASE WHEN o = 1 THEN e - ce ELSE cs END AS utr3_length FROM c",
    "msa_flush": _ALN + 'SELECT aln_id, row, "offset", md5(seq) AS digest FROM f',
    "msa_is_flush": _ALN + 'SELECT aln_id, min("offset") = max("offset") AS starts, min("offset" + length(seq)) = max("offset" + length(seq)) AS ends FROM s GROUP BY aln_id',
    "msa_subseq": _ALN + ', p AS (SELECT aln_id, row, greatest("offset", 3) AS a, least("offset" + length(seq), 60) AS b, "offset" AS o, seq FROM s) SELECT aln_id, row, CASE WHEN b > a THEN a ELSE 3 END AS "offset", md5(CASE WHEN b > a THEN substr(seq, a - o + 1, b - a) ELSE \'\' END) AS digest FROM p',
    "msa_revcomp": _ALN + 'SELECT aln_id, row, a + b - "offset" - length(seq) AS "offset", md5(reverse(' + _COMP.format("seq") + ")) AS digest FROM x",
    "msa_join": _ALN + 'SELECT aln_id, row, "offset", md5(seq || seq) AS digest FROM f',
    "scored_consensus": _ALN + ", " + _CELLS.format("s") + ", n AS (SELECT aln_id, pos, letter, count(*) AS n, sum(count(*)) OVER (PARTITION BY aln_id, pos) AS total, row_number() OVER (PARTITION BY aln_id, pos ORDER BY count(*) DESC, letter) AS r FROM c GROUP BY aln_id, pos, letter), q AS (SELECT aln_id, pos, letter, CASE WHEN n = total THEN 254 ELSE floor(-10 * log10(1 - n / total) + 0.5) END::BIGINT AS q FROM n WHERE r = 1) SELECT aln_id, pos, CASE WHEN q < 3 THEN 'n' ELSE letter END AS letter, q FROM q",
    "quality_consensus": _ALN + ", " + _CELLS.format("s") + ", e AS (SELECT *, pow(10, -(5 + (pos * 7 + row * 3) % 30) / 10.0) AS e FROM c), l AS (SELECT aln_id, pos, " + ", ".join(f"{_ln(x)} AS s{x}" for x in "acgt") + " FROM e GROUP BY aln_id, pos), p AS (SELECT aln_id, pos, [" + ", ".join(f"exp(s{x} - greatest(sa, sc, sg, st))" for x in "acgt") + "] AS w FROM l), z AS (SELECT aln_id, pos, list_transform(w, lambda x: x / list_sum(w)) AS w FROM p) SELECT aln_id, pos, CASE WHEN len(list_filter(w, lambda x: abs(x - list_max(w)) < 1e-10)) > 1 THEN 'n' ELSE substr('acgt', list_position(w, list_max(w)), 1) END AS letter, round(list_max(w), 6) AS p FROM z",
    "chromosome_shares": "WITH c AS (SELECT i - 1 AS ord, split_part(x, ' ', 1) AS id, split_part(x, ' ', 2)::BIGINT AS n FROM (SELECT unnest(string_split('" + G.HG19 + "', ',')) AS x, generate_subscripts(string_split('" + G.HG19 + "', ','), 1) AS i)) SELECT id AS chrom, count(*) AS n, sum((s_suppkey * 1000003) % n)::BIGINT AS places FROM supplier JOIN c ON c.ord = s_suppkey % 24 GROUP BY id",
    "affine_alignment": catalog.SQL["edit_alignment"],
    "event_windows": "SELECT user_id, date_trunc('day', ts) AS \"start\", count(*) AS n FROM (SELECT DISTINCT user_id, ts FROM events) GROUP BY 1, 2",
    "trimmed_reads": r"""WITH c AS (SELECT doc_id, i, round(1e9 * pow(10, -(ord(substr(x, i::BIGINT, 1)) - 33) / 10.0))::BIGINT AS p FROM (SELECT doc_id, x, unnest(range(1, length(x) + 1)) AS i FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^!-~]', '!', 'g') AS x FROM documents))), s AS (SELECT *, sum(50000000 - p) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM c), m AS (SELECT *, least(0, min(c) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS low FROM s), v AS (SELECT doc_id, i, c - low AS t, low < coalesce(lag(low) OVER (PARTITION BY doc_id ORDER BY i), 0) AS fell FROM m), w AS (SELECT *, max(CASE WHEN fell THEN i ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS from_ FROM v), b AS (SELECT doc_id, max_by((from_, i), (t, i)) AS x FROM w WHERE NOT fell GROUP BY doc_id) SELECT d.doc_id, coalesce(x[1], 0)::BIGINT AS start, coalesce(x[2], 0)::BIGINT AS "end" FROM documents d LEFT JOIN b USING (doc_id)""",
}
