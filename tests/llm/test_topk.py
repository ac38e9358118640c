"""Top-k against SQL, brute force and odd vectors."""

import random

import pytest
from pyspark.sql import functions as F

from glimset.llm import topk
from tests.conftest import same_rows

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, every, k, scale=256):
    ok = [(i, [int(scale * x // 1) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = []
    for q, a in {i: v for i, v in reversed(ok)}.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_matches_sql(spark, duck, sf_dir):
    same_rows(topk.op8_topk(spark, sf_dir), duck.sql(topk.ORACLE))


@pytest.mark.parametrize("block,queries", [(1000, 1000), (16, 8)])
def test_brute_force(spark, block, queries):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1), 0.25]) for _ in range(rng.choice([6, 6, 6, 3, 9]))]) for i in range(150)]
    rows += [(150, [0.25] * 6)] + [(151 + i, [0.25] * 6) for i in range(20)]
    df = spark.createDataFrame([(*r, 0) for r in rows], KIND)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0, 5, 256, block, queries).collect())) == brute(rows, 5, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [1.0, 0.0]), (6, []), (None, [1.0, 1.0]), (7, [-1e12, 1.0]), (5, [1.0, 0.0]), (10, [2.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], KIND)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect()))
    assert [g for g in got if g[0] == 0] == [(0, 1, 10, 131072), (0, 2, 5, 65536), (0, 3, 5, 65536), (0, 4, 6, 0), (0, 5, 7, -65536000000000000)]
    assert len(got) == 10 and topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_weights(spark):
    rows = [(0, [1e16, 1.0]), (1, [1e16, 1.0]), (2, [1e300, 1.0]), (3, [-1e16, 0.0]), (4, [1.0, 2.0]), (5, [1e16, 2.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame([(*r, 0) for r in rows], KIND), F.col("vec_id") == 0).orderBy("rank").collect()]
    # 1 and 5 are both beyond a long, and tie; so is 4's, as 256 * 256e16; 2 takes no part
    most = 2**63 - 1
    assert got == [(0, 1, 1, most), (0, 2, 4, most), (0, 3, 5, most), (0, 4, 3, -most - 1)]


def test_long_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(20_000)]) for i in range(12)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame([(*r, 0) for r in rows], KIND), F.col("vec_id") % 5 == 0).collect()))
    assert got == brute(rows, 5, 5)
