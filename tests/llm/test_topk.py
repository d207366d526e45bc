import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.topk import exact_topk


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = min(ok.get(i, v), v)
    vec = {i: [math.floor(1024 * x) for x in v] for i, v in ok.items()}
    out = set()
    for q, a in vec.items():
        if q % 10 == 0:
            held = lambda x: max(-(2**63), min(2**63 - 1, x))
            s = sorted((-held(sum(x * y for x, y in zip(a, b))), c) for c, b in vec.items() if c != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, c, -x) for n, (x, c) in enumerate(s)}
    return out


@pytest.mark.parametrize("case", ["random", "peaked", "ties", "huge"])
def test_equals_brute_force(spark, case):
    r = random.Random(3)
    make = {
        "random": lambda: [r.gauss(0, 0.2) for _ in range(8)],
        "peaked": lambda: [r.random() ** 8 for _ in range(8)],
        "ties": lambda: [r.choice([0.0, 0.001, -0.25]) for _ in range(3)],
        "huge": lambda: [r.choice([1e-3, 1e12, -1e30]) for _ in range(3)],
    }[case]
    rows = [(i, make()) for i in range(400)]
    rows += [(1000, None), (1010, []), (1020, [float("nan")] * 3), (1030, [1.0, None, 2.0]), (1040, [1.0, float("inf")]), (None, make()), (1050, [1.0] * 5), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    got = exact_topk(spark, df, F.col("vec_id") % 10 == 0, k=5, block=90, query_block=17).collect()
    assert {tuple(x) for x in got} == brute(rows, 5)
    assert len(got) == len(set(got))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk(spark, df, F.col("vec_id") % 10 == 0).count() == 0


def test_the_bound_stops_and_is_never_too_low():
    import numpy as np

    from sparkloom.llm.topk import Lists, bound

    rng = np.random.default_rng(1)
    rows = (1024 * rng.random((3000, 6)) ** 9).astype(np.int64)
    lists = Lists(np.arange(3000), rows)
    stopped = 0
    for q in range(0, 3000, 100):
        ids, scores = lists.best(q, rows[q], 10, 16)
        every = rows @ rows[q]
        order = sorted((-every[i], i) for i in range(3000) if i != q)[:10]
        assert [(int(i), int(s)) for i, s in zip(ids, scores)] == [(i, -s) for s, i in order]
        stopped += lists.stopped
    assert stopped > 20
    for _ in range(300):
        w, e = np.abs(rng.normal(size=5)) * (rng.random(5) < 0.8), rng.normal(size=5)
        x = np.minimum(rng.normal(size=(4000, 5)) * 0.7, e)
        inside = x[(x * x).sum(axis=1) <= 1.5]
        assert (inside @ w <= bound(w, e, 1.5)).all()
        if len(inside) and (e > 0).all() and (w > 0).all():  # and it is reached but for the margin
            t = np.linspace(0, 60, 30001)[:, None]
            fill = np.minimum(t * w, e)
            assert abs((fill[(fill * fill).sum(axis=1) <= 1.5] @ w).max() + 1 - bound(w, e, 1.5)) < 1e-2
