"""Candidates of the pipeline's near-duplicate stage."""

from lumenbib.llm import simhash


def test_tiles_find_pairs_within_the_radius_that_share_no_band(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 0b1111, base, base ^ (0b11111 << 20), base ^ (0b111111111 << 30), 1 << 62, 0]
    rows = [(i, 9 if i < 6 else 0, fp, [100 * i + k for k in range(3)] if i < 6 else []) for i, fp in enumerate(prints)]
    rows += [(7, 9, 5 << 40, [1, 2, 500]), (8, 9, 0x7F << 50, [501, 500, 803])]  # a band of 0 and of 5 each, or of 5 and 7
    points = spark.createDataFrame(rows, "at long, n long, fp long, bands array<long>").repartition(3)
    got = {r["node"]: r["root"] for r in simhash.candidates(points).collect()}
    assert got == {1: 0, 2: 0, 7: 0, 8: 0, 5: 0}


def test_sketch_has_the_fingerprint_of_the_operator(spark):
    texts = ["one two three four five six seven", "A b", "", None, "x " * 70_000]
    rows = simhash.sketches(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), 5).collect()
    assert [r["sketch"]["fp"] % (1 << 64) for r in rows] == [simhash.fingerprint(t or "", 5) for t in texts]
