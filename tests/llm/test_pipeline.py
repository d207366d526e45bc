import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_langid import corpus
from .test_mixing import targets
from .test_neardup import brute

words = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture(scope="module")
def rows():
    plain = [(i, t, lang, f"s{i % 5}") for i, t, lang in corpus(240, 6)]
    junk = [(1000, None, "en", "s1"), (1001, "", "en", "s1"), (1002, "漢字 假名 " * 60, "en", "s2"), (1003, "1 2 3 !!", "fr", None)]
    copies = [(2000 + i, plain[i][1], plain[i][2], "s0") for i in range(0, 60, 2)] + [(3000 + i, plain[i][1] + " the", plain[i][2], "s3") for i in range(40) if words(plain[i][1]) > 40]
    return [(*x, len(x[1] or "")) for x in plain + junk + copies] + [(*plain[9], 5), (None, plain[3][1], "en", "s4", 3)]


def test_every_stage_on_what_the_last_one_kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "near_duplicates", "mixing", "packing"]

    kept = stage["language_id"](spark, docs, "").collect()
    assert Counter(map(tuple, kept)) == Counter(r for r in rows if r[0] not in (1000, 1001, 1002, 1003))

    left = spark.createDataFrame(kept, docs.schema)
    unique = stage["near_duplicates"](spark, left, "").collect()
    first = {i for i, _, _, k in brute([(r.doc_id, r.text) for r in kept if r.doc_id is not None]) if k}
    assert Counter(r.doc_id for r in unique) == Counter([*first, None])
    assert set(unique) <= set(kept)

    mixed = stage["mixing"](spark, spark.createDataFrame(unique, docs.schema), "").collect()
    sizes = Counter()
    for r in unique:
        sizes[r.source] += words(r.text)
    want, taken = targets(sizes), Counter()
    for r in mixed:
        taken[r.source] += words(r.text)
    assert max(Counter(mixed).values()) <= 2 and set(mixed) <= set(unique)
    assert all(want[s] - 40 <= taken[s] <= want[s] + 1e-6 for s in want)

    packed = stage["packing"](spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(p.length for p in packed) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)


def test_run_applies_the_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 200


def test_near_copies_from_four_fifths_are_dropped(spark):
    w = [f"w{i}" for i in range(104)]  # 100 runs of five words
    edited = [*w[:30], "x", *w[31:70], "y", *w[71:]]  # 90 of 110
    other = [f"v{i}" for i in range(104)]
    texts = {1: w, 2: edited, 3: other, 4: other[:84], 5: other[:83]}  # 4: 80 of 100, 5: 79 of 100 with 3, 79 of 80 with 4
    apart = {6: [f"u{i}" for i in range(104)], 7: [f"u{i}" for i in range(83)]}  # 79 of 100
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in {**texts, **apart}.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()} == {1, 3, 6, 7}


def test_different_texts_under_one_doc_id_are_told_apart(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(50))
    rows = [(1, text("a")), (7, text("a")), (7, text("b")), (8, text("c")), (8, text("d")), (8, text("d")), (None, text("a")), (None, text("a"))]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, text("a")), (7, text("b")), (8, text("c")), (8, text("d")), (None, text("a")), (None, text("a"))])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_very_long_texts_clashing_names_and_repeats(spark):
    plain = [(i, t, lang, f"s{i % 2}", 1, "a", i, 2.0) for i, t, lang in corpus(120, 8)]
    long = (900, "the and tion " * 120_000, "en", "s1", 1, "b", 7, 1.0)
    rows = [*plain, long, (901, *long[1:]), *[(902, "wh er ing the " * 30, "en", "s0", 1, "c", 8, 1.0)] * 50]
    docs = spark.createDataFrame(rows, SCHEMA + ", row string, __key long, size double").repartition(5)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        ids = Counter(r.doc_id for r in docs.collect())
        if name == "near_duplicates":
            assert ids[900] == 1 and ids[901] == 0 and ids[902] == 1
        else:
            assert ids[900] >= (name == "language_id")
    packed = corpus_pipeline.STAGES[3][1](spark, docs, "").collect()
    assert sum(p.length for p in packed if p.start == 0) > 0 and {p.doc_id for p in packed} == set(ids)
