import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equitally.llm.bitsliced import BitSlicedIndex, build_blocks, meetings, quantised, top_k


@pytest.mark.parametrize("drop", [0, 3, 6])
def test_candidates_hold_the_best_and_all_ties(drop):
    r = np.random.default_rng(drop)
    values = r.integers(-90, 90, (500, 12))
    values[100:140] = values[7]
    index = BitSlicedIndex(values)
    for _ in range(20):
        q = r.integers(-60, 60, 12)
        scores = values @ q
        cut = np.sort(scores)[-5]
        assert set(np.flatnonzero(scores >= cut)) <= set(index.candidates(q, 5, drop))


def test_sum_of_slices_is_the_weighted_sum():
    r = np.random.default_rng(1)
    values, q = r.integers(-20, 20, (130, 5)), r.integers(-9, 9, 5)
    index = BitSlicedIndex(values)
    total, error = index.sum_slices(q, 0)
    assert error == 0
    sums = sum(np.unpackbits(t.view(np.uint8), bitorder="little")[:130].astype(int) << i for i, t in enumerate(total))
    scores = values @ q
    assert len(set(scores - sums)) == 1


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in vectors],
                                 "vec_id long, embedding array<float>, block string, rank int, score double")


def brute(vectors, asked, k=5):
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in asked:
        qs = [v for j, v in sound if j == i]
        if not qs:
            continue
        q = min(qs)
        score = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i)[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(score, 1)]
    return out


def test_equals_brute_force_with_awkward_vectors(spark):
    r = np.random.default_rng(4)
    vectors = [(i, r.normal(0, .3, 16).tolist()) for i in range(230)]
    vectors += [(i, vectors[3][1]) for i in range(300, 330)]  # ties
    vectors += [(400, None), (401, [None] * 16), (402, [float("nan")] * 16), (403, [float("inf")] + [0.0] * 15),
                (404, [1.0, 2.0]), (405, []), (None, [0.5] * 16), (406, [0.0] * 16), (50, vectors[9][1])]
    rows = rows_of(spark, vectors)
    got = top_k(rows, rows.where("vec_id % 50 = 0"), per_block=60, queries_per_block=3).collect()
    assert sorted(map(tuple, got)) == sorted(brute(vectors, [0, 50, 100, 150, 200, 300, 400]))


def test_fewer_rows_than_k_and_empty(spark):
    vectors = [(0, [0.5, -0.5]), (1, [0.25, 0.1]), (2, [-1.0, 3.0])]
    rows = rows_of(spark, vectors)
    assert sorted(map(tuple, top_k(rows, rows.where("vec_id = 0")).collect())) == brute(vectors, [0])
    assert top_k(rows.limit(0), rows.limit(0)).count() == 0
    assert top_k(rows, rows.where("vec_id = 99")).count() == 0


def test_large_components_take_part(spark):
    """Rows and queries beyond what slices hold, also where products overflow a
    long on the way to a sum that fits."""
    r = np.random.default_rng(5)
    vectors = [(i, r.normal(0, .3, 4).tolist()) for i in range(130)]
    vectors += [(200, [1e6, -1e6, 0.0, 0.0]), (201, [-3e5, 2.0, 0.0, 1.0]), (203, [262144.0, 0.0, 0.0, 0.5]), (203, [0.1, 1e6, 0.0, 0.0]),
                (250, [3e7, -3e7, 0.0, 0.0]), (251, [2.0 ** 40, 2.0 ** 40, 1.0, 0.0]), (50, [1e6, 1.0, 0.0, 0.0])]
    rows = rows_of(spark, vectors)
    got = top_k(rows, rows.where("vec_id % 50 = 0"), per_block=40, queries_per_block=2).collect()
    want = brute(vectors, [0, 50, 100, 200, 250])
    assert sorted(map(tuple, got)) == sorted(want)
    assert {q for q, _, v, _ in want if v >= 200} == {0, 50, 100, 200, 250}


def test_score_beyond_a_long_is_an_error(spark):
    rows = rows_of(spark, [(0, [1e12, 0.0]), (1, [1e12, 0.0])])
    with pytest.raises(Exception, match="does not fit in a long"):
        top_k(rows, rows.where("vec_id = 0")).collect()


def test_blocks_of_rows_are_shipped_once_a_group_and_not_once_a_query_block(spark):
    r = np.random.default_rng(6)
    vectors = [(i, r.normal(0, .3, 8).tolist()) for i in range(400)]
    df = rows_of(spark, vectors).select("vec_id", quantised(F.col("embedding")).alias("v"))
    index, n_blocks = build_blocks(df, 100, "test-rows")
    queries, n_queries = build_blocks(df, 4, "test-queries")
    met = meetings(index, n_blocks, queries, n_queries, 20)
    groups = max(5, -(-4 * spark.sparkContext.defaultParallelism // n_blocks))
    assert (n_blocks, n_queries) == (4, 100) and met.where("q_block < 0").count() == index.count() * groups
    pairs = met.where("q_block >= 0")
    assert pairs.count() == pairs.select("block", "q_block").distinct().count() == queries.count() * n_blocks
    assert pairs.join(met.where("q_block < 0"), ["block", "q_group"], "left_anti").join(index, "block", "left_semi").count() == 0
    rows = rows_of(spark, vectors)
    got = top_k(rows, rows.where("vec_id % 3 = 0"), per_block=100, queries_per_block=4).collect()
    assert sorted(map(tuple, got)) == sorted(brute(vectors, range(0, 400, 3)))


def test_an_index_of_a_block_is_made_in_little_memory():
    """A bit at a time: all bits of all rows at once are 16 times the block."""
    import tracemalloc

    values = np.random.default_rng(7).integers(-500, 500, (8_192, 64))
    tracemalloc.start()
    index = BitSlicedIndex(values)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert index.bits == 10 and most < 6 * values.nbytes
