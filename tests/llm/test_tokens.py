"""Byte-level BPE and wavelet shards against the libraries they follow."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from dosewise.llm import bpe, wavelet
from dosewise.session import workspace
from tokenizers import Tokenizer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN
ODD = ["", " ", "a", "don't stop\r\n\r\n now", "  two  spaces ", "tab\tand\x1cseparator \x85 x", "é́ ß 中文 🙂🙂", "a" * 3000, "!" * 500, "<|endoftext|> x", "a<|endoftext|>b. <|ENDOFTEXT|> <|startoftext|>, x", "ÉCOLE, İ. A.B,c x,", "9 99.9, x y"]


@pytest.fixture(scope="module")
def known():
    ranks = bpe.load_ranks(RANKS)
    return ranks, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_library(known, monkeypatch):
    ranks, library = known
    chance = random.Random(3)
    texts = ODD + ["".join(chance.choice("aab éß'\n\t  s!?7中文 🙂sstre ll,.") for _ in range(chance.randint(0, 60))) for _ in range(1500)]
    for states in (bpe.MAX_STATES, 40):  # also with a table that fills up at once
        monkeypatch.setattr(bpe, "MAX_STATES", states)
        coder = bpe.TextEncoder(ranks, PATTERN)
        for text in texts:
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text), text


def test_transducer_emits_early(known):
    machine = bpe.MergeTransducer(known[0])
    data = ("the cat sat on the mat and " * 200).encode()
    state, waiting, most = 0, 0, 0
    for byte in data:
        state, emitted = machine._moves.get(state << 8 | byte) or machine._move(state, byte)
        waiting = 0 if emitted else waiting + 1
        most = max(most, waiting)
    assert most < 128


def test_stream_decoder_waits_for_characters():
    data = "aé中🙂퟿".encode() + b"\xff\xe0\x80ok"
    for size in range(1, 8):
        decoder = bpe.StreamDecoder({i: data[i : i + 1] for i in range(len(data))})
        out = "".join(decoder.push(range(at, min(at + size, len(data)))) for at in range(0, len(data), size)) + decoder.finish()
        assert out == data.decode("utf-8", "replace")


def test_round_trip_query(corpus, known):
    rows = [(n, t) for n, t in enumerate(ODD)] + [(None, "null id"), (5, None), (0, ""), (0, "")]
    got = bpe.round_trip(corpus(rows), RANKS, PATTERN).collect()
    want = sorted((str(i), len(e := known[1].encode_ordinary(t or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == want
    texts = bpe.decode(bpe.encode(corpus(rows), RANKS, PATTERN), RANKS).collect()
    assert sorted((str(r[0]), r[1]) for r in texts) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.round_trip(corpus([]), RANKS, PATTERN).count() == 0


def test_wavelet_against_arrays():
    chance = np.random.default_rng(1)
    for ids in (np.zeros(0, "<u4"), np.array([7], "<u4"), np.full(1500, 3, "<u4"), (chance.zipf(1.4, 5000) % 49408).astype("<u4")):
        shard, docs, offsets = wavelet.Wavelet.unpack(wavelet.Wavelet.build(ids).pack([4, None], np.array([0, 1, len(ids)])))
        assert docs == [4, None] and offsets.tolist() == [0, 1, len(ids)]
        assert shard.all().tolist() == ids.tolist()
        for at in range(0, len(ids), 97):
            assert shard.access(at) == ids[at]
        for token in set(ids[:20].tolist()) | {12345}:
            places = np.flatnonzero(ids == token).tolist()
            assert shard.count(token) == len(places)
            assert [shard.select(token, n) for n in range(len(places))][:50] == places[:50]
            assert shard.occurrences(token) == places
            assert shard.select(token, len(places)) == -1
            assert shard.rank(token, len(ids) // 2) == sum(p < len(ids) // 2 for p in places)


def test_wavelet_query(spark, corpus, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 50)
    rows = [(n * 3 % 17, t) for n, t in enumerate(ODD)] + [(None, "null id"), (50, None), (51, "same"), (51, "same")]
    folder = workspace(spark)
    wavelet.write(corpus(rows), folder, WORDS, 2, 3)
    got = sorted(map(tuple, wavelet.digests(spark, folder).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(WORDS)
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = workspace(spark)
    wavelet.write(corpus([]), empty, WORDS, 2, 3)
    assert wavelet.digests(spark, empty).count() == 0
