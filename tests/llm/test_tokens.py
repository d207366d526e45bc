import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm.tokencount import token_counts
from sparkloom.llm.tokens import ByteBpe, Memo, WordBpe

WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \n", "'s", "''s", "'ll'll", "I'll've'd 'sup don't DON'T 're're", "<|endoftext|>abc<|startoftext|> x", "<|endoftext|", "a" * 900, "ab" * 400 + "!" * 300,
    "ΑΣ ΑΣΑ Σ", "é é̂", "İi̇", "12 345 ²½ⅷ", "漢字 かな 한국", "\U0001f600‍؀", "\x1c\x1d a\x85b c　d", "x'" * 60, "\x00\x7f",
]


def fuzz(n, seed=0):
    r = random.Random(seed)
    signs = "abcdefghijklmnopqrstuvwxyzABCYZÉéßüñΣσςØ0123456789'''''\"\".,!?-_ \t\n\x0b\x1c\x85 　漢字かカ한ⅷ²ʼ’€∑∈İıǅﬁ́̈​\U0001f600ا"
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def cases():
    return ODD + fuzz(3000) + ["the quick brown fox jumps over the lazy dog, " * 50]


def test_word_ids_are_the_librarys(cases):
    bpe = WordBpe(WORD)
    library = Tokenizer.from_file(WORD)
    want = [library.encode(t, add_special_tokens=False).ids + [1] for t in cases]
    for texts, expected in ((cases, want), *(([t], [w]) for t, w in zip(ODD, want))):
        ids, n = bpe.encode(texts, 1)
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == expected


def test_memo_that_overflows_gives_the_same(cases):
    bpe = WordBpe(WORD)
    bpe.encode([""], 1)
    whole = bpe.encode(cases, 1)[0]
    bpe._ids = Memo(64)
    assert np.array_equal(np.concatenate([bpe.encode([t], 1)[0] for t in cases]), whole)


def test_byte_ids_are_the_librarys(cases):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe, library = ByteBpe(*paths), Tokenizer.from_file(paths[0])
    for t in [*cases, " " * 2_000_000, "a b" + "\n" * 100_000]:
        assert bpe.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_counts_over_rows(spark, cases):
    library = Tokenizer.from_file(WORD)
    rows = [(i, t, "x") for i, t in enumerate(cases)] + [(-1, None, None), (None, "a", "y"), (3, cases[3], "again"), (-2, "word " * 3000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted((tuple(r) for r in token_counts(df, WORD).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=repr)
    assert token_counts(df.limit(0), WORD).count() == 0
