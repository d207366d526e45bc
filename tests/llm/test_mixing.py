import math
import random
import re

from sparkloom.llm.mixing import mix


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By the rule itself: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_sources_come_near_their_targets(spark):
    r = random.Random(2)
    sources = ["a", "B", "é", None, "hot", ""]
    rows = []
    for i in range(1500):
        s = "hot" if r.random() < 0.5 else r.choice(sources)
        n = int(r.lognormvariate(3, 1.3))
        rows.append((i, " \n".join(["w"] * n) if n else None, s, "x"))
    rows += [(3, rows[3][1], rows[3][2], "again"), (None, "one two", "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix(spark, df).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets(sizes)
    for x in got:
        s = x.row.source
        assert x.size == words(x.row.text) and x.source_size == sizes[s] and x.taken == x.copies * x.size <= 2 * x.size
        assert math.isclose(x.target, want[s], rel_tol=1e-9)
        taken[s] = taken.get(s, 0) + x.taken
    for s, n in taken.items():
        assert want[s] - 30 <= n <= want[s] + 1e-6, s
    assert sorted(map(str, got)) == sorted(map(str, mix(spark, df.repartition(7)).collect()))


def test_importance_is_followed(spark):
    rows = [(i, "a b c", "s" if i % 3 else "t", 10.0 if i % 2 else 0.1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    got = mix(spark, df, weights=(1,), share=0.3, importance="score").collect()
    high, low = (sum(x.copies for x in got if (x.row.score > 1) == up) for up in (True, False))
    assert high > 20 * low and high + low == 270


def test_empty_tables_and_empty_texts(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark, spark.createDataFrame([], schema)).count() == 0
    got = mix(spark, spark.createDataFrame([(1, None, None), (2, "", "a"), (3, " ", "a")], schema)).collect()
    assert [(x.size, x.target, x.taken) for x in got] == [(0, 0.0, 0)] * 3


def test_equal_rows_and_null_ids_are_drawn_one_by_one(spark):
    rows = [(None, f"a b {i}", "n") for i in range(1000)] + [(5, "a b c", "r")] * 1000 + [(i, "a b c", "u") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mix(spark, df, weights=(1,), share=0.5).collect()
    taken = {s: sum(x.taken for x in got if x.row.source == s) for s in "nru"}
    assert taken == {"n": 1500, "r": 1500, "u": 1500}
    key = lambda g: sorted((str(x.row), x.taken) for x in g)
    assert key(got) == key(mix(spark, df.coalesce(1), weights=(1,), share=0.5).collect())


def test_long_texts_and_clashing_names(spark):
    rows = [(i, "w " * (200_000 if i == 3 else 5), "s", i, i, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, part int, row string")
    got = mix(spark, df).collect()
    assert {x.row.doc_id: x.size for x in got} == {i: 200_000 if i == 3 else 5 for i in range(40)}
    assert all(x.row["size"] == x.row["part"] == x.row.doc_id and x.row["row"] == "x" for x in got)
