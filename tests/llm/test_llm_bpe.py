import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from immolens.llm import byte_bpe
from immolens.llm.common import table


@pytest.fixture(scope="session")
def own():
    return byte_bpe.Encoder(public_tokenizers.path(byte_bpe.RANKS))


@pytest.fixture(scope="session")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=own.ranks, special_tokens={})


def coded(own, texts):
    parts = [t.encode() for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    ids, n = own.encode(b"".join(parts), np.cumsum(size) - size)
    upto = [0, *np.cumsum(n).tolist()]
    return [ids[i:j].tolist() for i, j in zip(upto, upto[1:])]


HARD = ["", " ", "  ", "\n", " \n a", "a  b", "a \n\n b ", "it's", "it 's", "'s's", "''s", "'re'st",
        "I'll we've 'LL '", "don't'", "x'", "x'r", "x'l", "x'v\n", "\"'s", "1'm2", "é'té", "　x", "a\x1cb",
        "٣٤ ½ Ⅷ", "日本語 テキスト", "😀😀 ok", "'", " '", " 's", "...  !!", "\r\n\r\nx", "a  b c",
        "tab\t\tx", "end  ", "A" * 300, "ab" * 200, "xyzzy" * 40, "  'll", "'s 't", "Ᲊᲊ1"]


def test_classes_of_all_code_points(own, library):
    """Every code point joins the same kind of neighbours as in the library."""
    single = {bytes([i]): i for i in range(256)}
    for kind, lead in ((byte_bpe.LETTER, b"a"), (byte_bpe.NUMBER, b"1"), (byte_bpe.OTHER, b"!")):
        ranks = {**single, **{lead + bytes([i]): 256 + i for i in range(256)}}
        enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
        for c in [*range(0xD800), *range(0xE000, 0x110000, 1 if kind == byte_bpe.LETTER else 7)]:
            joined = len(enc.encode_ordinary(lead.decode() + chr(c))) == len(chr(c).encode())
            assert joined == (own.classes[c] == kind), hex(c)


def test_hard_texts_as_the_library(own, library):
    assert coded(own, HARD) == [library.encode_ordinary(t) for t in HARD]
    for t in HARD:                  # and each by itself, so that every end is an end
        assert coded(own, [t])[0] == library.encode_ordinary(t)


ALPHABET = st.sampled_from(list(" \n\t'strvelmdaZ19!.é日  😀"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), max_size=6))
def test_any_texts_as_the_library(own, library, texts):
    assert coded(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_scan_over_many_blocks(own, library):
    r = random.Random(3)
    long = "".join(r.choice(" \n'strvelabc1!é") for _ in range(9 * byte_bpe.WIDTH + 7))
    assert coded(own, [long, "", long[::-1]]) == [library.encode_ordinary(t)
                                                  for t in (long, "", long[::-1])]
    # composition is associative, and the functions are closed under it
    c = own.scan.composed
    f, g, h = (np.random.default_rng(1).integers(0, len(c), 500) for _ in range(3))
    assert (c[c[f, g], h] == c[f, c[g, h]]).all()


def test_long_matches_and_cut_texts(own, library, monkeypatch):
    r = random.Random(5)
    word = "".join(r.choice("abcdefghij") for _ in range(3_000))
    assert own.merged([word.encode()])[0].tolist() == library.encode_ordinary(word)
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 100)
    text = "".join(r.choice(["word", " ", "  ", "'s", "!", "é ", "\n", "12 "]) for _ in range(3_000))
    assert own.encode_long(text.encode()).tolist() == library.encode_ordinary(text)
    assert own.encode_long(word.encode()).tolist() == library.encode_ordinary(word)


def test_decoding_from_any_token(own, library):
    text = "It's naïve — 日本語, 12 times 😀!".encode()
    ids, _ = own.encode(text, np.zeros(1, np.int64))
    ends = np.cumsum(own.sizes[ids])
    assert own.decode(ids, ends) == text
    for i in range(len(ids)):
        for j in range(i, len(ids) + 1):
            begin = ends[i] - own.sizes[ids[i]]
            assert own.decode(ids[i:j], ends[i:j]) == (text[begin:ends[j - 1]] if j > i else b"")


def test_query_against_the_library(spark, sf001, library):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf001, "documents").collect()}
    got = byte_bpe.query(spark, sf001).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark, make_docs, odd_texts, library):
    docs = make_docs(odd_texts)
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert len(got) == len(odd_texts)
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd_texts)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"]))
                  for r in got) == want
    assert byte_bpe.decode(byte_bpe.encode(make_docs([]))).collect() == []
    bad = spark.sql("SELECT 1L AS doc_id, cast(X'61ff62' AS string) AS text")
    row = byte_bpe.decode(byte_bpe.encode(bad)).collect()[0]
    assert bytes(row["decoded"]) == "a�b".encode()
