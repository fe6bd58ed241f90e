"""Selected percentiles against sorted lists: nulls, ties, weights of nothing, one group with most rows, many small ones."""

import math
import random

from parasol.operators import stats

SCHEMA = "grp string, v double, w double"


def sample():
    rng = random.Random(5)
    rows = [("hot", rng.choice([1.0, 2.0, rng.uniform(0, 9)]), float(rng.randint(0, 5))) for _ in range(3000)]
    rows += [(f"g{k}", float(rng.randint(0, 4)), 1.0) for k in range(40) for _ in range(rng.randint(1, 6))]
    return rows + [("one", 7.0, 2.0), ("nil", None, 1.0), ("nil", 3.0, None), (None, 4.0, 1.0), (None, 5.0, 1.0), ("zero", 6.0, 0.0), ("zero", 8.0, 0.0)]


def grouped(rows):
    out = {}
    for g, v, w in rows:
        out.setdefault(g, []).append((v, w))
    return {g: sorted(vs, key=lambda r: (r[0] is not None, r[0] or 0.0)) for g, vs in out.items()}


def test_by_place(spark):
    rows = sample()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.grp: (r.p90, r.q1, r.top) for r in stats.index_percentiles(frame, ["grp"], "v", p90=stats.share_of(0.9), q1=stats.quarter(1), top=lambda n: n - 1).collect()}
    assert got == {g: (vs[min(len(vs) - 1, math.floor(len(vs) * 0.9))][0], vs[len(vs) // 4][0], vs[-1][0]) for g, vs in grouped(rows).items()}


def test_by_weight(spark):
    rows = sample()
    got = {r.grp: (r.p10, r.p50, r.all) for r in stats.weighted_percentiles(spark.createDataFrame(rows, SCHEMA), ["grp"], "v", "w", p10=0.1, p50=0.5, all=1.0).collect()}

    def reach(vs, share):
        whole, run = sum(w or 0 for _, w in vs), 0.0
        for v, w in vs:
            run += w or 0
            if run >= share * whole:
                return v

    assert got == {g: (reach(vs, 0.1), reach(vs, 0.5), reach(vs, 1.0)) for g, vs in grouped(rows).items()}


def test_interpolated(spark):
    rows = [r for r in sample() if r[1] is not None]
    got = {r.grp: (r.p25, r.p50) for r in stats.interpolated_percentiles(spark.createDataFrame(sample(), SCHEMA), ["grp"], "v", p25=0.25, p50=0.5).collect()}
    want = grouped(rows)
    assert got.keys() == want.keys()
    for g, vs in want.items():
        for x, p in zip(got[g], (0.25, 0.5), strict=True):
            at = p * (len(vs) - 1)
            low, high = vs[math.floor(at)][0], vs[math.ceil(at)][0]
            assert abs(x - (low + (high - low) * (at - math.floor(at)))) < 1e-12


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert stats.weighted_percentiles(empty, ["grp"], "v", "w", p50=0.5).isEmpty()
    assert stats.index_percentiles(empty, ["grp"], "v", p50=stats.nearest_rank(0.5)).isEmpty()
