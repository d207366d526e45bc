import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm.brown import Brown, _sequence, exchange, score, shape_of
from sparkloom.llm.words import buffers, words_of

WORDS = {"x": ["aa", "ab", "the", "of."], "y": ["éa", "un", "de", "7"]}


def tokens(t):
    return re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def corpus(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = r.choice("xy")
        rows.append((i, " ".join(r.choice(WORDS[k]) if r.random() < 0.7 else "".join(r.choice("abcdeé") for _ in range(3)) for _ in range(r.randint(0, 60)))))
    return rows + [(n, None), (n + 1, ""), (n + 2, "unseen-1 UNSEEN-1 Aa"), (None, "aa éa")]


@pytest.mark.parametrize("params", [Brown(), Brown(head=0.004, core=0.02, classes=4)])
def test_counts_base_and_better_than_base(spark, params):
    rows = corpus(400)
    again = [rows[7], rows[7], rows[2]]
    df = spark.createDataFrame([(*x, 0) for x in rows + again], "doc_id long, text string, word int").repartition(4)
    got = score(spark, df, params).collect()
    assert len(got) == len(rows + again)
    c, docs = Counter(), Counter(rows + again)
    for i, t in rows + again:
        if not held(i):
            c.update(tokens(t) + [None])
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in docs:
        w = tokens(t) + [None]
        want[i] = (held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    for x in got:
        a = want[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == a[:4] and math.isclose(x.base_score, a[4], rel_tol=1e-9)
        assert x.score < 0
    out = [x for x in got if x.held_out and x.n_tokens > 5]
    assert len(out) > 20 and sum(x.score for x in out) > sum(x.base_score for x in out)


def test_probabilities_of_all_words_sum_to_one(spark):
    """After a fixed text, over every known word, the end and one unseen word of each class."""
    rows = corpus(150)
    p = Brown(head=0.004, core=0.02, classes=4)
    from sparkloom.llm.brown import train
    from sparkloom.llm.workspace import Workspace

    train_rows = [(i, t) for i, t in rows if not held(i)]
    model, table = train(spark, spark.createDataFrame([(t,) for _, t in train_rows], "text string"), p, Workspace(spark, "t"))
    vocabulary = sorted({w for _, t in train_rows for w in tokens(t)})
    data, offsets = buffers(pa.array([" ".join(vocabulary)]))
    w = words_of(data, offsets)
    c = Counter(x for _, t in train_rows for x in tokens(t))
    core = {int(h): i for i, h in enumerate(model.core)}
    shapes = shape_of(w, p)
    of = [model.of[core[int(h)]] if int(h) in core else model.of[len(core) + s] for h, s in zip(w.hash, shapes)]
    size = (model.n + model.v + 1).astype(float)
    emitted = np.zeros(len(size))
    for word, k in zip(vocabulary, of):
        emitted[k] += (c[word] + 1) / size[k]
    emitted[model.of[-1]] += (model.ends + 1) / size[model.of[-1]]
    emitted += 1 / size  # the unseen
    assert np.allclose(emitted, 1)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    assert table.agg({"n": "sum"}).first()[0] == model.total == sum(c.values()) + len(train_rows)


def test_exchange_never_lowers_the_likelihood_and_finds_classes():
    r = np.random.default_rng(0)
    counts = np.zeros((12, 12), int)  # even words follow odd ones and the reverse
    for a in range(10):
        counts[a, [b for b in range(10) if b % 2 != a % 2]] = r.integers(5, 50, 5)
    counts[10:, 10:] = 3

    def likelihood(of):
        k = max(of) + 1
        t = np.zeros((k, k))
        np.add.at(t, (np.array(of)[:, None], np.array(of)[None, :]), counts)
        f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    last = likelihood(exchange(counts, 10, 2, 0))
    for rounds in range(1, 6):
        now = likelihood(exchange(counts, 10, 2, rounds))
        assert now >= last - 1e-9
        last = now
    of = exchange(counts, 10, 2, 20)
    assert len({of[i] for i in range(0, 10, 2)}) == 1 and len({of[i] for i in range(1, 10, 2)}) == 1 and of[0] != of[1]


def test_sequence_and_empty_tables(spark):
    data, offsets = buffers(pa.array(["a b", "", None, "c"]))
    at, row = _sequence(words_of(data, offsets))
    assert at.tolist() == [0, 1, -1, -1, -1, 2, -1] and row.tolist() == [0, 0, 0, 1, 2, 3, 3]
    schema = "doc_id long, text string"
    assert score(spark, spark.createDataFrame([], schema)).count() == 0
    only = next(i for i in range(99) if held(i))
    x = score(spark, spark.createDataFrame([(only, "a b")], schema)).first()
    assert (x.n_tokens, x.n_known, x.train_tokens, x.base_score) == (3, 0, 0, 0.0)


def test_every_training_word_has_the_cluster_of_its_contexts(spark):
    """Rare words of one shape that differ in their neighbours; scores by hand from the classes."""
    from sparkloom.llm.brown import assign, train
    from sparkloom.llm.words import hash_word
    from sparkloom.llm.workspace import Workspace

    p = Brown(head=0.004, core=0.05, classes=6)
    rows = [(i, " ".join(x for j in range(10) for x in (["le", f"f{i}n{j}x" if j % 2 else "un", "la"] if i % 2 else ["to", f"e{i}n{j}x" if j % 2 else "an", "of"]))) for i in range(60)] + [(99, "new-x le la")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = spark.createDataFrame([(t,) for i, t in rows if not held(i)], "text string")
    ws = Workspace(spark, "t")
    model, vocabulary = train(spark, texts, p, ws)
    m, table = assign(spark, texts, model, vocabulary, p, ws)
    seen = {t for i, text in rows if not held(i) for t in tokens(text)}
    of = {r.word: r["class"] for r in table.collect()} | {int(h.view(np.int64)): int(c) for h, c in zip(m.core, m.of)}
    of = {w: of[int(np.uint64(hash_word(w)).view(np.int64))] for w in seen}
    assert len(of) == len(seen) == m.v[:-1].sum()
    assert len({of[w] for w in seen if w[0] == "f"} & {of[w] for w in seen if w[0] == "e"}) == 0

    count = Counter(t for i, text in rows if not held(i) for t in [*tokens(text), None])
    of[None] = end = m.clusters
    unseen = lambda w: int(m.unseen[shape_of(words_of(*buffers(pa.array([w]))), p)[0]])
    path = {i: [end] + [of[w] if w in of else unseen(w) for w in [*tokens(t), None]] for i, t in rows}
    pairs = Counter(x for i, c in path.items() if not held(i) for x in zip(c, c[1:]))
    k, total = end + 1, sum(pairs.values())
    n, kinds, prior = Counter(), Counter(), Counter()
    for (a, b), x in pairs.items():
        n[a], kinds[a], prior[b] = n[a] + x, kinds[a] + 1, prior[b] + x
    size = Counter()
    for w, x in count.items():
        size[of[w]] += x + 1

    def step(a, b):
        return (pairs[a, b] + max(kinds[a], 1) * (prior[b] + 1) / (total + k)) / (n[a] + max(kinds[a], 1))

    want = {i: sum(math.log10(step(a, b)) for a, b in zip(path[i], path[i][1:])) + sum(math.log10((count[w] + 1) / (size[of[w] if w in of else unseen(w)] + 1)) for w in [*tokens(t), None]) for i, t in rows}
    got = {r.doc_id: r.score for r in score(spark, df, p).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_a_very_long_text_ties_and_repeats(spark):
    rows = [(0, "the cat sat " * 150_000)] + [(i, "a b c") for i in (5, 5, 6)] + [(7, None), (None, "a b c")]
    got = score(spark, spark.createDataFrame(rows, "doc_id long, text string"), Brown(classes=4)).collect()
    assert sorted(x.n_tokens for x in got) == [1, 4, 4, 4, 4, 450_001]
    assert len({round(x.score, 9) for x in got if x.n_tokens == 4}) == 1 and all(math.isfinite(x.score) and x.score < 0 for x in got)
