"""Tokenizers, packing and token files against the libraries they must agree with."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from polyview.llm import bpe, chunks, encoders, packing, token_files
from polyview.llm.common import byte_column
from tests.llm import cases

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = [*" \n\t  ab'sé1²Ⅷ_!", "\xa0", "\x1c", "ß", "中", "İ", "Σ", "ς.", "À", "ÿ×÷Ÿ", "ŉĲſ", "Ⱥ", *map(chr, range(0xC0, 0x180, 5)), "<|endoftext|>", "don't ", "́", "é", "  ", "\r\n", "🙂", " the", " of", "\0"]


def odd_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("make, path", [(encoders.byte_level, BYTES), (encoders.word_level, WORDS)])
@pytest.mark.parametrize("known, block, rows", [(50, 1 << 20, 37), (1 << 18, 1 << 20, 100), (1 << 18, 4, 1)])
def test_encoders_agree_with_the_library(make, path, known, block, rows, monkeypatch):
    monkeypatch.setattr(chunks, "BLOCK", block)
    encode, library = make(path, known), Tokenizer.from_file(path)
    texts = odd_texts(2000)
    for at in range(0, len(texts), rows):
        part = texts[at:at + rows]
        ids, counts = encode(*byte_column(pa.array(part)))
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert counts.tolist() == [len(w) for w in want], part
        assert ids.tolist() == [i for w in want for i in w], part


def test_rows_end_with_the_end():
    ids, counts = encoders.with_end(np.array([5, 6, 7], np.uint32), np.array([0, 2, 0, 1]), 9)
    assert ids.tolist() == [9, 5, 6, 9, 9, 7, 9] and counts.tolist() == [1, 3, 1, 2]


def test_pattern_is_that_of_the_rank_files():
    assert chunks.BYTE_PATTERN == public_tokenizers.PATTERN


def library_codec():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_codec_agrees_with_the_library():
    codec, library = bpe.Codec(bpe.read_ranks(RANKS)), library_codec()
    for text in [*odd_texts(2000), "a" * 5000, "ab" * 3000, "x" * 20_000]:
        ids = codec.encode(text.encode())
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


@pytest.mark.parametrize("known, block, rows", [(50, 1 << 20, 37), (1 << 18, 1 << 20, 100), (1 << 18, 4, 1)])
def test_batches_agree_with_the_library(known, block, rows, monkeypatch):
    monkeypatch.setattr(chunks, "BLOCK", block)
    encode, library = bpe.BatchCodec(bpe.Codec(bpe.read_ranks(RANKS)), known), library_codec()
    texts = [*odd_texts(2000), "a" * 5000, "ab" * 3000, "x" * 20_000, "", "<|endoftext|> it's"]
    for at in range(0, len(texts), rows):
        part = texts[at:at + rows]
        ids, counts = encode(*byte_column(pa.array(part)))
        want = [library.encode_ordinary(t) for t in part]
        assert counts.tolist() == [len(w) for w in want], part
        assert ids.tolist() == [i for w in want for i in w], part


def test_a_chunk_is_merged_once():
    """Also if more words lie between its places than a worker used to remember in a half."""
    encode = bpe.BatchCodec(bpe.Codec(bpe.read_ranks(RANKS)))
    seen, merge = Counter(), encode.codec.merge
    encode.codec.merge = lambda p: seen.update([p]) or merge(p)
    words = [f"qz{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(300_000)]
    texts = [" ".join(words[at:at + 1000]) + ", qzzqqzqx." for at in range(0, len(words), 1000)]
    for part in (texts, texts[:20]):
        encode(*byte_column(pa.array(part)))
    assert len(seen) > 200_000 and max(seen.values()) == 1


@settings(max_examples=50, deadline=None)
@given(st.sets(st.binary(max_size=8), max_size=300))
def test_perfect_hash_is_minimal(keys):
    table = bpe.PerfectHash(sorted(keys))
    assert sorted(table.index(k) for k in keys) == list(range(len(keys)))


def test_merges_follow_rank_then_place():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"aa": 258, b"abc": 259}
    codec = bpe.Codec(ranks)
    assert codec.merge(b"abc") == [259] and codec.merge(b"aaa") == [258, 97] and codec.merge(b"bcab") == [257, 256]
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0})


def test_encode_and_decode(spark):
    rows = cases.edge_rows()
    got = bpe.decode(bpe.encode(cases.documents(spark, rows), RANKS), RANKS).collect()
    library = library_codec()
    want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.encode(cases.documents(spark, []), RANKS).count() == 0


# ---------------------------------------------------------------- packing


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_place_every_length(histogram):
    found = packing.patterns(histogram, 64)
    placed = Counter()
    for lengths, count in found:
        assert count > 0 and sum(lengths) <= 64
        for n in lengths:
            placed[n] += count
    assert placed == Counter(histogram)


def test_packing_leaves_little_padding():
    rng = random.Random(3)
    found = packing.patterns(Counter(rng.randrange(1, 1025) for _ in range(50_000)))
    used, sequences = sum(sum(p) * n for p, n in found), sum(n for _, n in found)
    assert 1 - used / (sequences * 1024) < 0.01


def test_pack(spark):
    rng = random.Random(7)
    rows = cases.edge_rows() + [(100 + i, " ".join(rng.choice(["the", "cat", "Zürich", "x1"]) for _ in range(rng.randrange(900)))) for i in range(60)]
    got = packing.pack(cases.documents(spark, rows, 3), BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            part = ids[at:at + 1024]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(cases.documents(spark, []), BYTES).count() == 0


def test_sequences_hold_the_ids(spark):
    rows = [*cases.edge_rows(), (2, "a third text with id two")]
    got = packing.sequences(cases.documents(spark, rows, 3), BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    texts = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert len(r.ids) == 4 * r.length
        texts[r.doc_id, r.text_key].append((r.start, bytes(r.ids)))
    want = Counter((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in set(rows))
    joined = Counter((i, b"".join(p for _, p in sorted(set(parts)))) for (i, _), parts in texts.items())
    assert joined == want


# ---------------------------------------------------------------- token files


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.data())
def test_bits_round_trip(width, values, data):
    ids = np.array([v % 2**width for v in values], "<u4")
    words = token_files.pack_bits(ids, width)
    assert len(words) == -(-len(ids) // 64) * width * 8
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert token_files.unpack_bits(words, width, start, stop).tolist() == ids[start:stop].tolist()


def test_an_id_beyond_the_width_is_an_error():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 49_408, 65_537)] == [1, 1, 2, 16, 17]
    with pytest.raises(ValueError):
        token_files.pack_bits(np.array([8], np.uint32), 3)


def test_token_files(spark, tmp_path):
    rows = cases.edge_rows() + [(i, f"Some words of text {i}") for i in range(50, 90)]
    target = str(tmp_path / "tokens")
    token_files.write_tokens(cases.documents(spark, rows, 3), target, WORDS, 49_408, 2, block=100)
    got = token_files.read_tokens(spark, target).collect()
    library = Tokenizer.from_file(WORDS)
    encoded = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, encoded(t)) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert [bytes(r.ids) for r in token_files.read_range(spark, target, 60).collect()] == [encoded("Some words of text 60")]
    assert token_files.read_range(spark, target, None).count() == 2
    empty = str(tmp_path / "empty")
    token_files.write_tokens(cases.documents(spark, []), empty, WORDS, 49_408, 2)
    assert token_files.read_tokens(spark, empty).count() == 0
