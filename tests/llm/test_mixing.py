"""Mixing against SQL, the water level by hand, and odd rows."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glimset.llm import mixing
from tests.conftest import same_rows


def by_hand(sizes, weights, most=3):
    """Targets by the rounds of the description."""
    total, capped = Fraction(sum(sizes)), set()
    while True:
        rest = total - sum(most * sizes[k] for k in capped)
        free = sum(w for k, w in enumerate(weights) if k not in capped)
        targets = [Fraction(most * s) if k in capped else rest * weights[k] / free for k, s in enumerate(sizes)]
        over = {k for k, t in enumerate(targets) if k not in capped and t > most * sizes[k]}
        if not over:
            return [float(t) for t in targets]
        capped |= over


def test_matches_sql(spark, duck, sf_dir):
    same_rows(mixing.op7_mixing(spark, sf_dir), duck.sql(mixing.ORACLE))


@settings(max_examples=8, deadline=None)
@given(sizes=st.lists(st.integers(0, 10_000), min_size=1, max_size=9))
def test_water_level(spark, sizes):
    weights = [k % 3 + 1 for k in range(len(sizes))]
    df = spark.createDataFrame([(f"s{k}", s, w) for k, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight long")
    got = [r.target for r in mixing.water_fill(df).orderBy("source").collect()]
    assert got == pytest.approx(by_hand(sizes, weights))


def test_taken_is_near_target(documents):
    rows = [(k, "w " * (1 + k * 7919 % 50), "en", "ab"[k % 10 == 0]) for k in range(5000)]
    found = mixing.mix(documents(*rows), stratum_rows=500).collect()
    for source in "ab":
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50 * (1 + len(own) / 500)
        assert all(r.taken <= 3 * r.size for r in own)
    assert found and sorted(map(str, found)) == sorted(map(str, mixing.mix(documents(*reversed(rows)), stratum_rows=500).collect()))


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b", "en", None), (4, "a b", "en", None), (None, "c", "en", "z"), (5, "x " * 200_000)]
    found = mixing.mix(documents(*rows), carry=["doc_id", "score"]).collect()
    assert sorted((r.row.doc_id or 0, r.size) for r in found) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 2), (4, 2), (5, 200_000)]
    assert all(r.source_size == 4 for r in found if r.source is None)
    assert mixing.mix(documents((1, "a")).limit(0)).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(documents((1, None))).collect()] == [(0.0, 0)]
