import random
import re
from collections import defaultdict
from dataclasses import replace

import pytest

from sparkloom.llm.neardup import NearDup, near_duplicates

SMALL = NearDup()
#: The same operator with limits so low that every branch of it runs on a few rows.
TIGHT = replace(SMALL, node_limit=8, family_limit=16)


def brute(rows):
    sets = []
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    by = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(n)
    pairs = {(a, b) for v in by.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= 85 * len(x | y):
            u, v = find(sets[a][0]), find(sets[b][0])
            label[max(u, v)] = min(u, v)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def corpus(seed, families, copies, edits):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(r.choice([3, 8, 60, 140]))]
        for _ in range(r.randint(1, copies)):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                own[r.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [None, "", " \t", "one", "ONE", "one two", "Same text here now ok fine", "same TEXT here  now ok fine"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("params,shape", [(SMALL, (60, 6, 4)), (TIGHT, (5, 120, 6)), (SMALL, (2, 200, 8))])
def test_components_equal_brute_force(spark, params, shape):
    rows = corpus(1, *shape)
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), params).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_empty_table_null_ids_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, sketch int")
    assert near_duplicates(spark, none).count() == 0
    rows = [(None, "a b c d e f g", 1), (4, "a b c d e f g", 2), (4, "a b c d e f g", 2), (2, "A b c d e f g", 3)]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, rep int")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 3, 0), (2, 3, 2), (4, 3, 2), (4, 3, 2)]


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * 3_000_000)]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.n_shingles) for r in got} == {(1, 1, 299_996), (2, 1, 299_997), (3, 3, 1)}


def test_no_link_inside_a_family_hangs_on_the_sketch():
    import numpy as np

    from sparkloom.llm.neardup import link_sets

    a = np.arange(100, dtype=np.uint64)
    apart = np.stack([np.zeros(128, np.uint8), np.ones(128, np.uint8)])  # sketches that agree nowhere
    assert link_sets([a, a[:86]], apart, SMALL) == [(0, 1)] and link_sets([a, a[:84]], apart, SMALL) == []


def test_heavy_families_are_cut_by_shingles(spark):
    from dataclasses import replace

    rows = corpus(3, 2, 60, 6)
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), replace(SMALL, family_weight=900)).collect()
    assert {tuple(r) for r in got} == brute(rows)
