"""Ids of segments that are kept or encoded together, against one text at a time."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from leadloom.llm import bpe_sql, segments, token_files
from leadloom.llm.arrays import utf8
from leadloom.llm.segments import Known, joined, tokenize

FILE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = [
        " ", "  ", "\n", "\t\r\n", "\u00a0", "\u3000", "\x1c", "a", "Word", "it's", "'S", "über", "字", "𝔘", "12345",
        "!!", "<|endoftext|>", " <|endoftext|> ", "e\u0301", "x" * 70,
    ]
    made = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(300)]
    return ["", " ", "\n\n", *made, " " + "y" * 3000]


def lists(ids, begin):
    return [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]


@pytest.mark.parametrize("group", [1, 7, 1000])
@pytest.mark.parametrize("entries", [0, 50, 800_000])
def test_token_files_ids(group, entries, monkeypatch):
    monkeypatch.setattr(segments, "_JOINED", group)
    model = Tokenizer.from_file(FILE)
    with open(FILE, encoding="utf-8") as f:
        known = token_files._encoder.__wrapped__(f.read())
    known.entries = entries
    for seed in range(3):
        some = texts(seed)
        got = lists(*tokenize(*utf8(pa.array(some)), known))
        assert got == [model.encode(t, add_special_tokens=False).ids for t in some]
        assert len(known.place) == len(known.lists[0][1])


@pytest.mark.parametrize("entries", [0, 50, 800_000])
def test_bpe_ids(entries):
    ranks = bpe_sql.read_ranks(RANKS)
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    database = bpe_sql.BpeDatabase(ranks, public_tokenizers.PATTERN)
    database.known.entries = entries
    for seed in range(2):
        some = texts(seed)
        tokens, token_at, raw, raw_at = database.texts(*utf8(pa.array(some)))
        assert lists(tokens, token_at) == [model.encode_ordinary(t) for t in some]
        assert [raw[a:b].tobytes() for a, b in zip(raw_at[:-1], raw_at[1:])] == [t.encode() for t in some]


def test_ids_that_do_not_end_with_segments():
    """An encoder that takes two segments for one id is asked again for each segment."""
    asked = []

    def encode(names):
        asked.append(list(names))
        return [[1] if name == " a b" else [2 + len(name)] for name in names]

    size = np.array([0, 4, 0, 1, 2])
    (flat, counts), = joined(encode, size)([" a", " b"])
    assert asked == [[" a b"], [" a", " b"]]
    assert flat.tolist() == [4, 4] and counts.tolist() == [1, 1]


def test_known_forgets_and_makes_again():
    made = []

    def make(names):
        made.append(list(names))
        return [(np.arange(len(names), dtype=np.int32), np.ones(len(names), np.int64))]

    known = Known(make, entries=2)
    assert known(["a", "b"]).tolist() == [0, 1]
    assert known(["b", "c"]).tolist() == [1, 2]
    assert known(["a"]).tolist() == [0]
    assert made == [["a", "b"], ["c"], ["a"]]


@pytest.mark.parametrize("high", [0, 5, 1 << 26])
def test_pack_of_dense_and_sparse_ids(high):
    ids = (np.random.default_rng(high).integers(0, 9, 500) * (high + 1)).astype(np.int32)
    assert (token_files.unpack(len(ids), *token_files.pack(ids)) == ids).all()


def test_lists_are_gathered_in_slices():
    """What puts lists together holds their numbers, not eight bytes of place for each of them."""
    lengths = np.array([40, 0, 7, 700_000], np.int64)
    flat = np.arange(int(lengths.sum()), dtype=np.int64).astype(np.uint8)
    which = np.array([*[0, 1, 2] * 50_000, 3, 1, 0])
    tracemalloc.start()
    out, edge = segments.gather(flat, lengths, which)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    begin = np.cumsum(lengths) - lengths
    assert out.tobytes() == b"".join(flat[begin[i] : begin[i] + lengths[i]].tobytes() for i in which.tolist())
    assert edge.tolist() == [0, *np.cumsum(lengths[which]).tolist()]
    assert peak < 8 * len(out)


def test_known_segments_are_not_decoded():
    """Segments are looked up by their bytes; what is new is made of bytes too."""
    made = []

    def make(names):
        made.extend(names)
        return [(np.arange(len(names), dtype=np.int32), np.ones(len(names), np.int64))]

    known = Known(make)
    for text in ("ab cd ab", "cd ab é", "cd"):
        tokenize(*utf8(pa.array([text])), known)
    assert made == [b"ab", b" cd", b" ab", b"cd", " é".encode()]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 63, 64, 65, 500])
def test_bytes_of_segments_are_compared(n):
    """Segments that differ in any one byte are told apart."""
    one = np.arange(n, dtype=np.uint8)
    for place in {0, n // 2, n - 1}:
        other = one.copy()
        other[place] ^= 0x80
        for second in (one, other):
            data = np.concatenate([one, second])
            start = np.array([0, n])
            assert segments._equal(data, start, start + n, np.array([0, 0])) == (second is one)
