import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from lorekit.llm import bpe

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = {t: i for i, t in enumerate(vocabulary.tokens) if t}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_library_on_random_texts(vocabulary, library):
    coder, r = bpe.Coder(vocabulary), random.Random(7)
    pools = ["abcdefghijklmnopqrstuvwxyz ", "etaoin  \n", "éèêçñß äöü\t", "漢字かな한글 😀🎉", "0123456789-+=/_.", "aA", "#*$%&|<> \n\n  x"]
    for _ in range(3000):
        pool = "".join(r.sample(pools, r.randint(1, 3)))
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 60)))
        assert coder.encode(text) == library.encode_ordinary(text), text


def test_equals_library_on_joined_tokens(vocabulary, library):
    coder, r = bpe.Coder(vocabulary), random.Random(8)
    for _ in range(2000):
        piece = b"".join(r.choice(vocabulary.tokens) for _ in range(r.randint(1, 6)))
        text = piece.decode("utf-8", "replace")
        assert coder.encode(text) == library.encode_ordinary(text), text


def test_long_piece_is_linear(vocabulary, library):
    coder = bpe.Coder(vocabulary)
    for text in ("a" * 200_000, "ab" * 50_000, "é" * 50_000):
        assert coder.decode(coder.encode(text)) == text.encode()
    text = "thetion" * 300
    assert coder.encode(text) == library.encode_ordinary(text)


def test_frame_round_trip_and_odd_rows(spark, vocabulary, library):
    rows = [(1, "Hello world", "x"), (2, None, None), (3, "", "y"), (1, "Hello world", "x"), (None, " \n\t ü", "z"), (5, "<|endoftext|>", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    for x in back.collect():
        assert bytes(x.bytes) == (x.text or "").encode() and list(x.ids) == library.encode_ordinary(x.text or "")
    for x in bpe.digests(back).collect():
        text = next(t for d, t, _ in rows if d == x.doc_id)
        ids = library.encode_ordinary(text or "")
        assert x.n_tokens == len(ids) and x.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert x.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert bpe.encode(df.limit(0), vocabulary).count() == 0


def test_documents(spark, vocabulary, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for x in bpe.encode(df, vocabulary).select("text", "ids").collect():
        assert list(x.ids) == library.encode_ordinary(x.text or "")
