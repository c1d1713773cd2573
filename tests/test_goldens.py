import random
import zlib

from pyspark.sql import functions as F

from locusflow.functions import quality as Q
from locusflow.functions import sequences as S
from locusflow.operators import consensus as C
from locusflow.operators import genome as G
from locusflow.operators import intervals as I
from locusflow.operators import kmers as K
from locusflow.operators.align import align_pair, unit_matrix
from locusflow.sources import formats
from locusflow.streaming import session_counts, stream_bed

W = [[0, -5, -5, -5, -5], [-5, 10, -3, -1, -4], [-5, -3, 9, -5, 0], [-5, -1, -5, 7, -3], [-5, -4, 0, -3, 8]]


def short(found):
    return [(x["a_start"], x["a_end"], x["b_start"], x["b_end"], x["score"]) for x in found]


def test_alignments():
    assert short(align_pair("AGACTAGTTA", "GACAGACG", "-acgt", W)) == [(0, 1, 0, 0, -5), (1, 4, 0, 3, 26), (4, 5, 3, 3, -5), (5, 10, 3, 8, 12)]
    assert short(align_pair("ATAGGAAG", "ATTGGCAATG", "-acgt", unit_matrix(), opening=-5)) == [(0, 7, 0, 7, 3), (7, 7, 7, 9, -7), (7, 8, 9, 10, 1)]
    long = "GCTCACTAAAAACACAATCTACAACAGACGTTGCACTAACACTGTAATTGCCTTTAGTCC"
    assert short(align_pair(long, "ACTGCGTA", "-acgt", unit_matrix(), opening=-1)) == [(0, 4, 0, 0, -5), (4, 7, 0, 3, 3), (7, 32, 3, 3, -26), (32, 34, 3, 5, 2), (34, 43, 5, 5, -10), (43, 46, 5, 8, 3), (46, 60, 8, 8, -15)]
    assert short(align_pair("ACACACTA", "AGCACACA", "-acgt", unit_matrix(5, 2, -1, -1), "local")) == [(0, 1, 0, 1, 2), (1, 1, 1, 2, -1), (1, 6, 2, 7, 10), (6, 7, 7, 7, -1), (7, 8, 7, 8, 2)]
    assert short(align_pair("ATAGGAAG", "ATTGGCAATG", "-acgt", unit_matrix(), "local", -5)) == [(0, 7, 0, 7, 3)]
    assert short(align_pair("GTTGACAGACTAGATTCACG", "GACAGACGA", "-acgt", W, "fitted")) == [(3, 10, 0, 7, 62), (10, 12, 7, 7, -10), (12, 14, 7, 9, 17)]
    assert short(align_pair("ATTGGCAATGA", "ATAGGAA", "-acgt", unit_matrix(), "fitted", -5)) == [(0, 7, 0, 7, 3)]


def test_seed_filter(spark):
    assert K.debruijn("01", 3) == "00010111"
    t, q = K.debruijn("acgt", 6), K.debruijn("acgt", 5)
    seqs = spark.createDataFrame([(0, t), (1, q)], "id int, seq string")
    km = K.kmers(seqs, 6)
    hits = K.seed_filter(km.where("id = 0"), km.where("id = 1"), len(t), 6, 50, 4, 32)
    want = "(0,163,32) (141,247,64) (237,433,1120) (241,347,96) (341,452,128) (447,565,1952) (542,628,1984) (627,814,2592) (786,898,2624) (868,939,2880) (938,997,3040) (938,1024,3072)"
    assert sorted(f"({r['from']},{r['to']},{r['diagonal']})" for r in hits.collect()) == sorted(want.split())


def test_expressions(spark):
    df = spark.createDataFrame([("acgt" * 5,), ("ac" * 10,), ("a" * 20,), ("",)], "seq string")
    got = df.select(F.round(S.entropic_complexity(F.col("seq")), 12), F.round(S.wf_complexity(F.col("seq")), 12), S.z_complexity(F.col("seq"))).collect()
    assert [tuple(r)[:2] for r in got] == [(1.0, 0.836245538462), (0.5, 0.437381542287), (0.0, 0.0), (0.0, 0.0)]
    assert [r[2] for r in got] == [(len(zlib.compress(x, 9)) - len(zlib.compress(b"", 9))) / len(x) if x else 0.0 for x in (b"acgt" * 5, b"ac" * 10, b"a" * 20, b"")]
    one = spark.range(1).select(S.truncate(F.lit("ACGCTGACTTGGTGCACGT"), F.lit(12), F.lit(5), 0, True).alias("a"), S.truncate(F.lit("ACGT"), F.lit(3), F.lit(1)).alias("b"), Q.encode(Q.decode(F.lit("!I~5")), "sanger").alias("c"), Q.trim(Q.decode(F.lit("!!IIII!!"))).alias("d")).first()
    assert (one.a, one.b, one.c, one.d.start, one.d.end) == ("TGCACGTACGCT", None, "!I~5", 2, 6)


def test_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 one two\nACGT\nAC GT\n\n>s2\nTT\n")
    assert sorted(map(tuple, formats.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("s1", "one two", "ACGTACGT", None), ("s2", "", "TT", None)]
    (tmp_path / "a.fq").write_text("@r1 d\nACG\n+\nIII\n@r2\nAC\n+r2\n@+\n")
    got = formats.read_fastq(spark, str(tmp_path / "a.fq")).collect()
    assert [(r.id, r.seq, r.qual, r.error) for r in got] == [("r1", "ACG", [40] * 3, None), ("r2", "AC", [31, 10], None)]
    (tmp_path / "a.bed").write_text("chr1\t11873\t14409\tuc001aaa.3\t3\t+\t11873\t11873\t0\t3\t354,109,1189,\t0,739,1347,\n")
    row = formats.read_bed(spark, str(tmp_path / "a.bed")).first()
    assert (row.start, row.strand, row.block_sizes, row.rgb, row.error) == (11873, 1, [354, 109, 1189], None, None)
    (tmp_path / "a.gff").write_text("##gff-version 2\nSEQ1\tEMBL\tatg\t103\t105\t.\t+\t0\tTarget x 1; maxe 0\n")
    row = formats.read_gff(spark, str(tmp_path / "a.gff")).first()
    assert (row.start, row.end, row.score, [tuple(x) for x in row.attributes]) == (102, 105, None, [("Target", "x 1"), ("maxe", "0")])


def test_formats_with_odd_lines(spark, tmp_path):
    (tmp_path / "h.fa").write_text("ACGT\n>s1\nTT\n")
    assert sorted(map(tuple, formats.read_fasta(spark, str(tmp_path / "h.fa")).collect()), key=str) == [("s1", "", "TT", None), (None, None, "ACGT", "letters before the first header")]
    (tmp_path / "b.fq").write_text("\n@a\nAC\n\n+\nII\n\n@b x\n\nG\n+b x\n@\n@e\n\n+\n\n@bad\nAC\n+\nI\nlost\n")
    got = {r.id: (r.seq, r.qual, r.error) for r in formats.read_fastq(spark, str(tmp_path / "b.fq")).collect()}
    assert got == {"a": ("AC", [40, 40], None), "b": ("G", [31], None), "e": ("", [], None), "bad": ("AC", [40], "lengths differ"), None: (None, None, "lines that are no record")}
    (tmp_path / "t.bed").write_text("# c\ntrack name=x\nbrowser y\n\nchr1\t5\t9\nchr1\tx\t9\n")
    assert [(r.start, r.error) for r in formats.read_bed(spark, str(tmp_path / "t.bed"), 3).collect()] == [(5, None), (None, "bad position")]
    text = "\n".join(formats.gff_header(2, date="2020-01-01")) + "\n##DNA s1\n##acgt\n##ac\n##end-DNA\nS\tE\tf\t9\t5\t.\t+\t0\na\tb\n"
    (tmp_path / "t.gff").write_text(text)
    assert [r.error for r in formats.read_gff(spark, str(tmp_path / "t.gff")).collect()] == ["start isn't before end", "too few columns"]
    assert [tuple(r) for r in formats.read_gff_sequences(spark, str(tmp_path / "t.gff")).collect()] == [("DNA", "s1", "acgtac")]
    block = spark.range(1).select(formats.gff_sequence_text(F.lit("DNA"), F.lit("s1"), F.lit("acgtac"), 4).alias("b"), formats.gff_region_text(F.lit("s1"), F.lit(0), F.lit(6)).alias("r")).first()
    assert block.b == "##DNA s1\n##acgt\n##ac\n##end-DNA" and block.r == "##sequence-region s1 1 6"


def test_round_trips(spark, tmp_path):
    reads = spark.createDataFrame([("r1", "d", "ACGT", [40, 2, 0, 30]), ("r2", "", "", [])], "id string, desc string, seq string, qual array<smallint>")
    formats.write_fastq(reads, str(tmp_path / "q"), repeat_id=True)
    got = formats.read_fastq(spark, str(tmp_path / "q"))
    assert sorted((r.id, r.desc, r.seq, r.qual, r.error) for r in got.collect()) == [("r1", "d", "ACGT", [40, 2, 0, 30], None), ("r2", "", "", [], None)]
    formats.write_fasta(reads, str(tmp_path / "f"), 3)
    assert sorted((r.id, r.seq) for r in formats.read_fasta(spark, str(tmp_path / "f")).collect()) == [("r1", "ACGT"), ("r2", "")]
    formats.write_bed(spark.createDataFrame([("c", 1, 5, "n", -1)], "chrom string, start int, end int, name string, strand int"), str(tmp_path / "b"))
    assert [(r.start, r.end, r.name, r.strand, r.error) for r in formats.read_bed(spark, str(tmp_path / "b"), 6).collect()] == [(1, 5, "n", -1, None)]


def test_kmers_against_windows(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("acgtn" if i % 50 == 0 else "acgt") for i in range(1000))
    df = spark.createDataFrame([(1, seq)], "id int, seq string")
    for k in (4, 9, 14):
        want = sorted((i, seq[i : i + k]) for i in range(len(seq) - k + 1) if "n" not in seq[i : i + k])
        assert sorted((r.pos, r.kmer) for r in K.kmers(df, k).collect()) == want
        assert sorted(r.kmer for r in K.kmer_words(df, k).collect()) == sorted(x for _, x in want)


def test_parent_chains(spark):
    rows = [(i, 1, -1, i - 1 if i else None) for i in range(150)] + [(500, 4, 1, 999), (600, 1, 1, 601), (601, 1, 1, 600)]
    got = {r.id: tuple(r)[1:] for r in I.base_positions(spark.createDataFrame(rows, "id int, start int, orient int, parent_id int")).collect()}
    assert got[149] == (0, 150, 1, None) and got[148] == (0, 149, -1, None) and got[500] == (None, None, None, "no such parent")
    assert got[600][3] == got[601][3] == "too many links"


def test_genome_and_matrices(spark, tmp_path):
    assert [G.chromosomes(spark, x).count() for x in ("hg19", "mm10", "bt7")] == [24, 21, 32]
    (tmp_path / "bands").write_text("chr1\t0\t100\tp1\tgneg\nchr1\t100\t250\tq1\tgpos50\n")
    at = spark.createDataFrame([("chr1", 99), ("chr1", 100), ("chr1", 250)], "chrom string, pos long")
    assert sorted((r.pos, r.band or "") for r in G.band_of(at, G.read_bands(spark, str(tmp_path / "bands"))).collect()) == [(99, "p1"), (100, "q1"), (250, "")]
    assert G.parse_matrix("# c\n   A  C\nA  5 -4\nC -4  5\n", "-acgt") == [[0] * 5, [0, 5, -4, 0, 0], [0, -4, 5, 0, 0], [0] * 5, [0] * 5]
    assert G.identity_matrix("-ac", 1, -1) == [[0, 0, 0], [0, 1, -1], [0, -1, 1]]


def test_streams_equal_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bed").write_text("chr1\t5\t9\nchr2\t1\t2\n")
    name = "beds"
    stream_bed(spark, str(tmp_path / "in"), 3).writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.chrom, r.start) for r in spark.table(name).collect()) == [("chr1", 5), ("chr2", 1)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    session_counts(stream, "ts", "user_id").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    table = {tuple(r) for r in session_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id").collect()}
    some = {tuple(r) for r in spark.table("sessions").collect()}
    assert some and some <= table  # those that the watermark has passed


def test_functions_as_parameters(spark):
    df = spark.createDataFrame([(1, "acgtacgt")], "id int, seq string")
    assert [r.value for r in K.each_kmer(df, 4, lambda k: F.reverse(k)).orderBy("pos").collect()][:2] == ["tgca", "atgc"]
    cells = C.cells(spark.createDataFrame([("x", 0, 0, "ac"), ("x", 1, 0, "ag"), ("x", 2, 0, "ag")], "aln_id string, row int, offset int, seq string"))
    assert [r.letter for r in C.with_udaf(cells, lambda letters: max(letters)).orderBy("pos").collect()] == ["a", "g"]
    table = C.motif_table([[5, 1, 0, 2], [0, 6, 1, 1]], 0.5)
    assert abs(C.motif_probability(table, 1.0, [0.25] * 4) - 1 / 16) < 1e-12


def test_modules_load_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 50"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, timeout=120).returncode == 0
