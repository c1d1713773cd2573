import pytest

from locusflow.operators import repeats as R

HITS = [(0, 163, 32), (141, 247, 64), (237, 433, 1120), (241, 347, 96), (341, 452, 128), (447, 565, 1952), (542, 628, 1984), (627, 814, 2592), (786, 898, 2624), (868, 939, 2880), (938, 997, 3040), (938, 1024, 3072)]
TRAPEZOIDS = [(0, 452, -128, 3), (237, 433, -1120, -1085), (447, 628, -1984, -1917), (627, 898, -2624, -2557), (868, 939, -2880, -2845), (938, 1024, -3072, -3005)]


def test_trapezoids(spark):
    assert R.trapezoids_of(HITS, 6, 32, 4) == TRAPEZOIDS
    df = spark.createDataFrame([("a", *h) for h in HITS] + [("b", *HITS[0])], "pair string, `from` long, `to` long, diagonal long")
    assert sorted(map(tuple, R.trapezoids(df, ["pair"], 6, 32, 4).collect())) == [("a", *t) for t in TRAPEZOIDS] + [("b", 0, 163, -32, 3)]


def test_packed(spark):
    seqs = spark.createDataFrame([(f"s{n}", n, 4**n) for n in range(1, 9)], "id string, ord int, length long")
    places = R.packed(seqs)
    rows = places.orderBy("ord").collect()
    assert [(r.first_bin, r.last_bin) for r in rows] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 5), (6, 10), (11, 27), (28, 92)]
    assert rows[-1].start + rows[-1].length == 94208
    asked = [(1020, 1030), (1025, 1030), (1010, 1060), (4096, 5000), (29 * 1024, 32 * 1024 - 1)]
    got = R.unpacked(spark.createDataFrame(asked, "start long, end long"), places).collect()
    assert {(r.start, r.end): (r.id, r.id_start, r.id_end) for r in got} == dict(zip(asked, [("s2", 0, 6), ("s2", 1, 6), ("s2", 0, 16), ("s5", 0, 904), ("s8", 1024, 4095)], strict=True))


@pytest.mark.parametrize(("length", "identity", "want"), [(50, 0.1, (6, 6, 0, 32)), (60, 0.1, (7, 7, 0, 32)), (80, 0.1, (10, 10, 0, 32)), (90, 0.1, (11, 11, 0, 32)), (100, 0.1, (6, 12, 1, 33)), (200, 0.5, (6, 25, 3, 35)), (200, 0.9, (10, 200, 19, 51)), (400, 0.8, (6, 50, 7, 39)), (400, 0.9, (10, 400, 39, 71)), (400, 0.99, (15, 400, 4, 36))])
def test_parameters(length, identity, want):
    p = R.filter_parameters(29940, length, identity)
    assert (p.word, p.min_match, p.max_error, p.tube_offset) == want


def test_piles(spark):
    df = spark.createDataFrame([("c", 2, 4), ("c", 7, 9), ("c", 3, 4), ("c", 7, 8), ("c", 1, 3), ("c", 8, 9), ("c", 9, 11)], "loc string, start long, end long")
    assert sorted((r.start, r.end, r.n) for r in R.piles(df, ["loc"]).collect()) == [(1, 4, 3), (7, 11, 4)]
    assert sorted((r.start, r.end, r.n) for r in R.piles(df, ["loc"], 1).collect()) == [(1, 4, 3), (7, 9, 3), (9, 11, 1)]


def test_repeats_from_words_to_alignments(spark):
    from locusflow.operators.banded import find_repeats
    from locusflow.operators.kmers import debruijn

    pairs = spark.createDataFrame([("x", debruijn("acgt", 6), debruijn("acgt", 5)), ("y", "acgt" * 5, "a" * 20), ("z", None, "a")], "pair string, target string, query string")
    got = sorted((r.pair, r.a_start, r.b_start, r.a_end, r.b_end, r.score) for r in find_repeats(pairs, 50, 0.8, 6, 50, 4, 32).collect())
    assert got == [("x", *h) for h in [(1, 0, 290, 242, 101), (365, 286, 435, 345, 26), (437, 341, 507, 400, 26), (3201, 642, 3477, 873, 96), (3980, 948, 4066, 1021, 30)]]


def test_pairs_and_clipping(spark):
    pairs = spark.createDataFrame([(1, "c1", 2, 9, "c2", 30, 38, 12, -1, 0.05)], "pair int, a_loc string, a_start long, a_end long, b_loc string, b_start long, b_end long, score long, strand int, error double")
    line = pairs.select(R.pair_lines().alias("value"))
    assert line.first()[0] == "c2\tpals\thit\t31\t38\t12.0000\t-\t.\tTarget c1 3 9; maxe 0.05"
    from locusflow.sources.formats import gff_rows

    assert tuple(R.expanded(gff_rows(line)).first())[:8] == ("c2", 30, 38, "c1", 2, 9, 12, 0.05)
    assert sorted((r.side, r.loc, r.mate_loc) for r in R.mates(pairs).collect()) == [("a", "c1", "c2"), ("b", "c2", "c1")]
    traps = spark.createDataFrame([("c", 0, 100, 1, 5), ("d", 0, 9, 1, 5)], "loc string, bottom long, top long, left long, right long")
    runs = spark.createDataFrame([("c", 20, 30), ("c", 90, 120)], "loc string, start long, end long")
    assert sorted((r.loc, r.bottom, r.top) for r in R.clipped(traps, runs, ["loc"]).collect()) == [("c", 0, 20), ("c", 30, 90), ("d", 0, 9)]
