import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from immolens.llm import packing, token_files, tokens

PATH = tokens.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def expected(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


ODD = ["", None, "  ", " a\x1cb c\x85d  e", "don't I'll we've 'S it's",
       "x<|endoftext|>y <|startoftext|>", "İstanbul ΣΑΣ éclair K", "12 3.5%%% abc***def !!",
       "日本語 テキスト", "THE,!! ,the ''' foo_bar", "naïve café ŁÓDŹ ǅ ß ẞ", "é \U0001F600ok!'s"]


def test_ids_are_the_librarys(library):
    own = tokens.WordEncoder(PATH)
    ids, at = own.encode(pa.array(ODD), 1)
    for i, text in enumerate(ODD):
        assert ids[at[i]:at[i + 1]].tolist() == expected(library, text, 1), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_ids_are_the_librarys_for_any_text(texts):
    own = tokens.encoder(PATH)
    ids, at = own.encode(pa.array(texts), 7)
    for i, text in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == expected(own.library, text, 7)


def test_word_table_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    own = tokens.WordEncoder(PATH)
    for text in ("one two three", "four five two", "one six"):
        ids, _ = own.encode(pa.array([text]), 1)
        assert ids.tolist() == expected(library, text, 1)


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_rans_round_trip_and_sections(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 3000).astype(np.uint32)
    table = token_files.Table(np.bincount(ids, minlength=3001))
    payload = token_files.encode_block(ids, table, lanes=16, section=8)
    symbols = table.symbols()
    assert token_files.decode_block(payload, table, symbols).tolist() == ids.tolist()
    parts = [token_files.decode_block(payload, table, symbols, s)
             for s in range(token_files.sections(payload))]
    assert np.concatenate(parts).tolist() == ids.tolist()


def test_rans_finds_damage():
    ids = np.arange(2000, dtype=np.uint32) % 50
    table = token_files.Table(np.bincount(ids))
    payload = bytearray(token_files.encode_block(ids, table))
    payload[100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.decode_block(bytes(payload), table, table.symbols())
    other = token_files.Table(np.bincount(ids % 7))
    with pytest.raises(ValueError, match="another table"):
        token_files.decode_block(token_files.encode_block(ids, table), other, other.symbols())


def test_rans_table_covers_rare_symbols():
    counts = np.zeros(50_000, np.int64)
    counts[:] = 1
    counts[7] = 10 ** 12
    table = token_files.Table(counts)
    assert int(table.freq.sum()) == 1 << table.bits and table.freq.min() == 1


def test_token_files(spark, make_docs, odd_texts, library, tmpdir_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 50)
    docs = make_docs(odd_texts)
    token_files.write_tokens(docs, f"{tmpdir_path}/t")
    got = token_files.read_tokens(spark, f"{tmpdir_path}/t", with_ids=True).collect()
    assert len(got) == len(odd_texts)
    order = sorted(odd_texts, key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    for (key, text), row in zip(order, sorted(got, key=lambda r: r["start"]), strict=True):
        ids = np.array(expected(library, text, 1), "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (key, at, len(ids))
        assert bytes(row["ids"]) == ids.tobytes() and row["ids_crc32"] == zlib.crc32(ids)
        at += len(ids)


def test_token_files_of_no_documents(spark, make_docs, tmpdir_path):
    token_files.write_tokens(make_docs([]), f"{tmpdir_path}/none")
    assert token_files.read_tokens(spark, f"{tmpdir_path}/none").collect() == []


def test_nnls_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((6, 4)), rng.random(6) * rng.choice([-1, 1], 6)
        x = packing.nnls(a, b)
        best = np.inf
        for free in range(16):              # the best of all sets of free columns
            at = [j for j in range(4) if free >> j & 1]
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0] if at else np.zeros(0)
            if (y >= -1e-12).all():
                best = min(best, np.linalg.norm(a[:, at] @ y - b))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= best + 1e-8


def test_combinations_use_no_more_than_there_is():
    rng = np.random.default_rng(5)
    for _ in range(10):
        counts = rng.integers(0, 40, 16)
        counts[0] = 0
        used = np.zeros(16, int)
        for shape, times in packing.combine(counts, 16):
            assert sum(shape) == 16 and times > 0
            for u in shape:
                used[u] += times
        assert (used <= counts).all()


def check_packing(rows, texts, library, window):
    ids_of: dict = {}
    for key, text in texts:
        ids_of.setdefault(key, []).append(expected(library, text, 2))
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for key, lists in ids_of.items():
        pieces = [x for ids in lists for x in ids]
        assert sum(r["length"] for r in by_doc[key]) == len(pieces)
        if len(lists) == 1:
            at = 0
            for r in sorted(by_doc[key], key=lambda r: r["start"]):
                own = np.array(pieces[at:at + r["length"]], "<u4").tobytes()
                assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(own))
                assert bytes(r["ids"]) == own and r["doc_tokens"] == len(pieces)
                at += r["length"]
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("window,unit", [(4096, 64), (64, 8)])
def test_packing(make_docs, words, odd_texts, library, window, unit):
    texts = odd_texts + [(100 + i, words(i * 7 % 300, i)) for i in range(60)]
    rows = packing.pack(make_docs(texts), window=window, unit=unit, with_ids=True).collect()
    assert check_packing(rows, texts, library, window) == 0


def test_packing_of_no_documents(make_docs):
    assert packing.pack(make_docs([])).collect() == []
