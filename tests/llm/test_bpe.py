"""Encoding and decoding against the tokenizers library."""

import random
import unicodedata

import pytest
from tokenizers import Tokenizer

from palisade.llm import bpe
from palisade.llm.registered import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def check(texts, library):
    import numpy as np

    v = bpe.Vocabulary(tokenizer_path())
    got = [np.frombuffer(x, dtype=np.int32).tolist() for x in bpe.Encoder(v).encode(texts)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for t, a, b in zip(texts, got, want, strict=True):
        assert a == b, repr(t)


def test_plain_and_odd_texts(library):
    check(["", " ", "Hello, it's 2024!", "don't WE'LL I'd", "école École İstanbul ΣΣ ΟΣ", "<|endoftext|>a<|startoftext|> <|endoftext", "aaaaaaaaaaaaa bbbb", "\U0001f600\U0001f600!? 中文", "x" * 5000, "a\x1cb\x1fc\x85d e f", "\x00a\x7f"], library)


def test_every_character_alone(library):
    """Of those that this Python knows; case and NFC of newer ones are not in its tables."""
    check([f"a{chr(c)}b {chr(c)}" for c in range(0, 0x110000, 7) if unicodedata.category(chr(c)) not in ("Cn", "Cs")], library)


def test_random_texts(library):
    rng = random.Random(5)
    check(["".join(rng.choice("abcdeth in ing'ssx.,-1éü\n ") for _ in range(rng.randrange(200))) for _ in range(500)], library)


def test_operator(spark, library):
    rows = [(1, "The cat", "k"), (2, None, None), (3, "", "k"), (3, "", "k"), (None, "Lé chat's 42", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = bpe.encode(df, tokenizer_path(), decoded="decoded")
    got = {(r.doc_id, r.text): (r.token_ids, r.decoded) for r in out.collect()}
    assert out.count() == 5
    for (_, t), (ids, decoded) in got.items():
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids == want and decoded == library.decode(want, skip_special_tokens=False)
    again = bpe.decode(out.drop("decoded"), tokenizer_path()).collect()
    assert sorted(r.decoded for r in again) == sorted(d for _, d in [(r.doc_id, r.decoded) for r in out.collect()])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, tokenizer_path(), decoded="decoded").collect() == []
