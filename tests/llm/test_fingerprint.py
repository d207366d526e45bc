import hashlib
import random
import re
from collections import Counter
from statistics import mean

import numpy as np
import pytest

from sparkloom.llm.fingerprint import IMatch, fingerprints, lexicon_of, likeness
from sparkloom.llm.words import hash_word


def words(t):
    return re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def corpus(n, seed=0):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijé") for _ in range(5)) for _ in range(3000)]
    weights = [1 / (k + 3) for k in range(3000)]
    return [" ".join(r.choices(vocabulary, weights, k=r.choice([1, 4, 30, 200, 600]))) for _ in range(n)]


def test_lexicon_is_the_band_of_all_documents(spark):
    texts = corpus(400) + [None, "", "A a  a"]
    p = IMatch(rare=0.01, common=0.1)
    got = lexicon_of(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), p)
    df = Counter(w for t in texts for w in set(words(t)))
    want = {hash_word(w) for w, n in df.items() if 0.01 * len(texts) <= n <= 0.1 * len(texts)}
    assert set(got.terms.tolist()) == want and len(want) > 100


@pytest.mark.parametrize("n", [1, 2, 90, 500])
def test_successors_edits_and_likeness(spark, n):
    texts = corpus(n, n) if n > 2 else ["one two three four", None][:n]
    rows = [(i * 7 % 1009 - 300, t, "x") for i, t in enumerate(texts)]
    if n > 2:
        rows += [(100_000, None, ""), (100_001, "", ""), (100_002, texts[5], ""), (100_003, texts[5], "")]
    got = {x.doc_id: x for x in fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(6)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda x: -x[0])
    prints = {}
    for k, (i, t, _) in enumerate(order):
        successor = order[(k + 1) % len(order)]
        t, s = t or "", successor[1] or ""
        half = len(t) // 2
        x = got[i]
        assert x.n_chars == len(t)
        assert x.edited_sha256 == hashlib.sha256((t[: len(t) - half] + s[:half]).encode()).hexdigest()
        assert abs(x.near_edited - likeness(x.fingerprint, x.edited_fingerprint)) < 1e-12
        assert abs(x.near_next - likeness(x.fingerprint, got[successor[0]].fingerprint)) < 1e-12
        assert prints.setdefault(t, x.fingerprint) == x.fingerprint
    if n > 2:
        long = [x for x in got.values() if x.n_chars > 500]
        assert mean(x.near_edited for x in long) > mean(x.near_next for x in long) + 0.05
        assert got[100_003].near_next == 1.0


def test_small_edits_stay_near(spark):
    texts = corpus(300, 9)
    long = [t for t in texts if len(t) > 1000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    lexicon = lexicon_of(docs, IMatch())
    import pyarrow as pa

    from sparkloom.llm.fingerprint import _strings

    changed = [t.rsplit(" ", 1)[0] + " zzzzz" for t in long]
    a, b = (_strings(*lexicon.hashes(pa.array(v))) for v in (long, changed))
    assert np.mean([likeness(x, y) for x, y in zip(a, b)]) > 0.9


def test_ties_nulls_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(None, "b"), (7, "a"), (7, "c"), (7, "c"), (None, None), (9, "d")]
    got = fingerprints(spark, spark.createDataFrame(rows, schema)).collect()
    assert sorted((x.doc_id or 0, x.n_chars) for x in got) == [(0, 0), (0, 1), (7, 1), (7, 1), (7, 1), (9, 1)]
    assert fingerprints(spark, spark.createDataFrame([], schema)).count() == 0


def test_fingerprint_by_brute_force(spark):
    import pyarrow as pa

    from sparkloom.llm.words import mix, power

    p = IMatch(rare=0.01, common=0.1, lexicons=96)
    texts = corpus(200, 3)
    lexicon = lexicon_of(spark.createDataFrame([(t,) for t in texts], "text string"), p)
    one = lambda x: int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
    base = [int(x) for x in power(2000)[:2000]]
    got, other = lexicon.hashes(pa.array([*texts, "", None]))
    for t, line, o in zip([*texts, "", None], got, other):
        terms = sorted({hash_word(w) for w in words(t)} & set(lexicon.terms.tolist()))
        want = []
        for k in range(96):
            rate = p.scales[k % 8]
            inside = [h for h in terms if one(h ^ ((p.seed << 32) + 7919 * (k + 1))) >> (64 - rate) == 0]
            want.append(one(sum(one(h + k) * base[i] for i, h in enumerate(inside))) % 0xFFFF + 1 if inside else 0)
        assert want == line.tolist() and o.startswith("=") == (not any(want))


def test_many_ranges_can_be_planned_and_long_texts(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame([(i, f"w{i % 7} v{i % 3}") for i in range(4000)] + [(9000, "w1 w2 w3 " * 200_000)], "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "1500")
    try:
        out = fingerprints(spark, df)
        assert len(out._jdf.queryExecution().executedPlan().toString()) > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    got = {x.doc_id: x for x in fingerprints(spark, df).select("doc_id", "n_chars").collect()}
    assert len(got) == 4001 and got[9000].n_chars == 1_800_000
