import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from atlas.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def test_digests_equal_the_library(odd, odd_rows, library):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd).collect())
    want = []
    for i, text, *_ in odd_rows:
        ids = library.encode_ordinary(text or "")
        want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_round_trip(odd, odd_rows, library):
    coded = bpe.decode(bpe.encode(odd)).collect()
    by = {i: t or "" for i, t, *_ in odd_rows if i is not None}
    for r in coded:
        if r.doc_id is not None:
            assert r.ids == library.encode_ordinary(by[r.doc_id])
            assert bytes(r.decoded).decode() == by[r.doc_id]


def test_newer_characters_and_long_words(spark, library):
    texts = ["\U0001e030\U0001e031 x", "<|endoftext|>", "é" * 700 + " " + "0" * 500, " 　  a  ", "'s 'S it's"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in bpe.encode(df).collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("word", [b"a" * 1000, b"hello" * 200, bytes(range(256)), b"x"])
def test_long_merges(word, library):
    assert bpe.merge_long(word, bpe.ranks(PATH)) == library._encode_single_piece(word)


def test_empty_and_unknown(spark, empty):
    assert bpe.digests(empty).count() == 0 and bpe.encode(empty).count() == 0
    odd = spark.createDataFrame([(None,), ([None, 99999, -1, 64],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(odd).collect()] == [b"", bpe.pieces(PATH)[64]]


def test_words_ahead_are_kept_as_one_array():
    """A worker that waits keeps what it has rendered: bytes and their ends, no object a word."""
    ids = pa.array([[k, k + 1] for k in range(25_000)] + [[]], pa.list_(pa.int32()))
    ahead = bpe.Ahead(pa.array([b""] * len(ids), pa.binary()), ids)
    got = ahead.rendered(bpe.numbers)
    assert got is ahead.rendered(bpe.numbers) and got.to_pylist() == [bpe.numbers(x) for x in ids.to_pylist()]
    assert got.nbytes < 22 * len(ids)  # an object takes 33 bytes besides its text, and eight in the array
