import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm.packing import pack, plan, solve

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def padding(lengths, window):
    return 0 if lengths & (lengths - 1) == 0 else window - lengths


@pytest.mark.parametrize("n,most", [(0, 0), (1, 1), (60, 0.12), (1000, 0.02), (50_000, 0.002)])
def test_plan_uses_every_piece_with_little_padding(n, most):
    r = np.random.default_rng(n)
    counts = np.bincount(np.minimum(2048, (r.lognormal(6, 1, n)).astype(int) % 2048 + 1), minlength=2049)
    counts[2048] = n // 3
    used, total, waste = np.zeros_like(counts), 0, 0
    for lengths, m in plan(counts, 2048):
        assert sum(lengths) <= 2048 and m > 0
        np.add.at(used, list(lengths), m)
        total += 2048 * m
        waste += m * padding(sum(lengths), 2048)
    assert np.array_equal(used, counts)
    assert waste <= most * max(total, 1)


def test_solver_finds_an_exact_answer():
    patterns = np.array([[5, 3, 0], [4, 4, 0], [6, 2, 0], [4, 2, 2]])
    want = np.array([7.0, 2, 0, 9])
    counts = np.bincount(patterns.ravel(), np.repeat(want, 3), 9)
    assert np.allclose(solve(patterns, counts, 3000), want, atol=0.05)


def test_pieces_tile_documents_and_sequences(spark):
    library, r = Tokenizer.from_file(JSON), random.Random(5)
    texts = [None, "", "a", "<|endoftext|> b", *(" ".join(r.choice(["word", "piece", "xyzzy"]) for _ in range(r.choice([3, 200, 900, 5000]))) for _ in range(150))]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int").repartition(4)
    got = pack(spark, df, JSON, RANKS).collect()
    want = defaultdict(int)
    for i, t, _ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            want[i, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    have, sequences = defaultdict(int), defaultdict(list)
    for p in got:
        have[p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens] += 1
        sequences[p.sequence_id].append((p.offset, p.length))
    assert have == want
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert pack(spark, df.limit(0), JSON, RANKS).count() == 0
