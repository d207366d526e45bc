import random
import zlib

import numpy as np
import pyarrow as pa

from sparkloom.llm.langid import LangId, accepted, fit, identify, train

SYLLABLES = {"en": ["the", "ing", "tion", "and", "er", "wh"], "fr": ["eau", "elle", "que", "ré", "è", "oi"], "ru": ["при", "вет", "ость", "на", "ко", "ть"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(n, seed=0):
    r = random.Random(seed)
    langs = ["en"] * 6 + ["fr", "ru"]
    return [(i, text(r, lang := r.choice(langs), r.randint(3, 80)), lang) for i in range(n)]


def test_held_out_accuracy_and_the_contract(spark):
    rows = corpus(600) + [(9001, None, "en"), (9002, "", "fr"), (9003, " 12 !!", "ru"), (9004, "THE ING", None), (None, "eau elle que", "fr"), (5, "the tion", "en")]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = identify(df, train(df)).collect()
    assert len(got) == len(rows)
    known = {(i, t): lang for i, t, lang in rows}
    for x in got:
        assert x.held_out == (zlib.crc32(str("" if x.doc_id is None else x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
        if x.doc_id in (9001, 9002, 9003):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0.0, True)
        else:
            assert x.lang_pred in SYLLABLES
    right = [x.lang_pred == dict((i, lang) for i, _, lang in rows)[x.doc_id] for x in got if x.held_out and x.doc_id is not None and x.doc_id < 9000]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert known


def test_cosine_equals_brute_force():
    rows = corpus(80)
    model = fit([t for _, t, _ in rows], [lang for _, _, lang in rows], LangId(dims=300))
    probe = ["the andtion  wh", "È RÉ que, 12 eau", "привет на", "", "zzz"]
    _, score, _ = model.predict(pa.array(probe))
    for t, s in zip(probe, score):
        raw = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        raw = " ".join(raw.split())
        raw = f" {raw} ".encode() if raw else b""
        x = np.zeros(len(model.grams))
        for k in range(len(raw) - 2):
            hit = np.flatnonzero(model.grams == (raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]))
            x[hit] += 1
        x = np.sqrt(x) * model.idf
        want = max(0.0, float((model.centroids @ (x / (np.linalg.norm(x) or 1))).max()))
        assert abs(s - want) < 1e-5


def test_nothing_to_learn_from_and_rejection(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {x.lang_pred for x in identify(df, train(df)).collect()} == {"und"}
    assert identify(df.limit(0), train(df)).count() == 0
    rows = corpus(300, 2)
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, "漢字 " * 100, "x"), (2, rows[0][1], "x"), (3, None, "x"), (4, "the", "x")], "doc_id long, text string, note string")
    assert sorted(accepted(odd, model).collect()) == [(2, rows[0][1], "x"), (4, "the", "x")]


def test_tables_and_memory_learn_the_same(spark):
    rows = corpus(200, 4)
    learned = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    a, b = train(df), fit([t for _, t, _ in learned], [lang for _, _, lang in learned], LangId())
    assert a.languages == b.languages and (a.grams == b.grams).all() and np.allclose(a.idf, b.idf)
    probe = pa.array([t for _, t, _ in rows])
    assert np.mean(a.predict(probe)[0] == b.predict(probe)[0]) > 0.99


def test_every_language_is_learned_and_repeats_count_once(spark):
    rare = [(None, "eau elle que ré " * 3, "fr"), (7000, "при вет ость на " * 3, "ru")]
    hot = [(1, "the tion and wh " * 3, "en")] * 3000
    many = [(8000 + i, chr(0x4E00 + 7 * i) * 9, f"x{i}") for i in range(230) if zlib.crc32(str(8000 + i).encode()) % 4 != 2]
    df = spark.createDataFrame(rare + hot + many, "doc_id long, text string, lang string")
    model = train(df, LangId(per_language=20))
    assert set(model.languages) == {"en", "fr", "ru", *(x[2] for x in many)}
    seen = {(x.doc_id, x.lang_pred) for x in identify(df, model).collect()}
    assert seen == {(i, lang) for i, _, lang in rare + hot + many}


def test_too_many_labels_are_refused(spark):
    import pytest

    df = spark.createDataFrame([(i, "a b c", f"l{i}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        train(df, LangId(most_labels=5))


def test_ties_and_very_long_texts(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in ([("the and", "b"), ("the and", "a")])] + [(500, "eau que " * 100_000, "fr"), *[(i, "elle ré que eau " * 5, "fr") for i in range(501, 520)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(x.doc_id, x.lang_pred) for x in identify(df, train(df)).collect()}
    assert {x for x in got if x[0] < 40} == {(i, "a") for i in range(40)} and (500, "fr") in got
