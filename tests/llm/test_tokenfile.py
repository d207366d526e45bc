import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import simple8b
from sparkloom.llm.tokenfile import read_digests, read_shard, write_token_files
from sparkloom.llm.workspace import Workspace

from .test_tokens import ODD, fuzz

WORD = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), max_size=6))
def test_round_trip(lists):
    values, sizes = np.array([x for v in lists for x in v], np.uint64), np.array([len(v) for v in lists], np.int64)
    words, blocks = simple8b.encode(values, sizes)
    assert len(words) == blocks.sum()
    assert np.array_equal(simple8b.decode(words, blocks, sizes), values)


def test_density():
    values = np.arange(40_000) % 1000
    assert 8 * len(simple8b.encode(values, np.array([40_000]))[0]) < 1.4 * len(values)


@pytest.mark.parametrize("limit", [300, 1 << 22])
def test_files_hold_all_ids_in_order(spark, limit):
    library = Tokenizer.from_file(WORD)
    texts = [*ODD, *fuzz(300), "long words here " * 4000, None]
    rows = [((i * 37) % 401 - 50, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)
    shards = write_token_files(spark, df, WORD, 1, Workspace(spark, "t"), limit)
    got = sorted(read_digests(shards).collect())
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    first = shards.orderBy("part", "seq").first()
    docs, sizes, ids = read_shard(bytes(first.shard))
    assert docs[0] == want[0][0] and len(ids) == sizes.sum() == first.n_ids


def test_ties_nulls_and_empty(spark):
    rows = [(None, "b"), (7, "a"), (7, "a"), (7, "zz a"), (None, None)]
    got = read_digests(write_token_files(spark, spark.createDataFrame(rows, "doc_id long, text string"), WORD, 1, Workspace(spark, "t"))).collect()
    assert sorted(r.start for r in got) == [0, 1, 3, 5, 7] and sum(r.doc_id is None for r in got) == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert read_digests(write_token_files(spark, none, WORD, 1, Workspace(spark, "t"))).count() == 0
