"""Word arrays against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from leadloom.llm import arrays, segments
from leadloom.llm.arrays import (
    PRIME, byte_hashes, group_starts, mix, ngrams, pieces, ranges, sequence_hashes, sliding, utf8, words,
)
from leadloom.llm.segments import cut

TEXT = st.text(st.sampled_from("ab AB\n\t\x0b\x1cé\u00a0𝔘"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8), st.booleans(), st.integers(1, 4))
def test_words_and_ngrams(texts, lower, k):
    data, offsets = utf8(pa.array(texts, pa.string()))
    first, hashes, start, end = words(data, offsets, lower=lower, spans=True)
    want = [(t or "").encode().split() for t in texts]
    got = [
        [data[a:b].tobytes() for a, b in zip(start[x:y], end[x:y])] for x, y in zip(first[:-1], first[1:])
    ]
    assert got == want
    fold = (lambda w: w.translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256)))) if lower else (lambda w: w)
    flat = [fold(w) for ws in want for w in ws]
    # Equal words have equal hashes, others do not.
    assert len({(w, int(h)) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(hashes.tolist()))
    grams, whole = ngrams(first, hashes, k)
    lists = [tuple(map(fold, ws[i : i + k])) for ws in want for i in range(len(ws))]
    assert [len(x) == k for x in lists] == whole.tolist()
    named = {(x, int(g)) for x, g, w in zip(lists, grams, whole) if w}
    assert len(named) == len({x for x, _ in named}) == len({g for _, g in named})


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_segments_make_up_the_texts(texts):
    data, offsets = utf8(pa.array(texts))
    first, which, names = cut(data, offsets)
    assert ["".join(names[i] for i in which[a:b]) for a, b in zip(first[:-1], first[1:])] == texts


@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 30))
def test_sliding(values, width):
    values = np.array(values)
    if len(values) >= width:
        want = [values[i : i + width].min() for i in range(len(values) - width + 1)]
        assert sliding(values, width).tolist() == want


def test_ranges_and_groups():
    assert ranges(np.array([5, 1, 7]), np.array([2, 0, 3])).tolist() == [5, 6, 7, 8, 9]
    assert group_starts(np.array([1, 1, 2, 3, 3])).tolist() == [0, 2, 3]
    assert group_starts(np.array([])).tolist() == []


def test_pieces_hold_whole_rows():
    column = pa.array(["aaaa", None, "bb", "c" * 50, ""])
    parts = [(rows.start, rows.stop, data.tobytes()) for rows, data, _ in pieces(column, 6)]
    assert b"".join(d for _, _, d in parts) == b"aaaabb" + b"c" * 50
    assert [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]] and parts[-1][1] == 5


def unmixed(hashes):
    """Polynomials below the prime, from their mixed form."""
    back = hashes.copy()
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, None)):
        x = back
        for _ in range(64 // shift + 1):
            x = back ^ (x >> np.uint64(shift))
        back = x if factor is None else x * np.uint64(pow(factor, -1, 2**64))
    return back


def test_hashes_are_the_polynomials(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 5000, np.uint8)
    start = np.array([0, 0, 3, 10, 700, 900, 4000])
    end = np.array([0, 3, 10, 700, 900, 4000, 5000])
    def symbols(span):
        raw = span.tobytes()
        return [int.from_bytes(raw[i : i + 7] + b"\x01", "little") for i in range(0, len(raw), 7)]

    want = [
        sum(v * pow(arrays._POINTS[1], k, PRIME) for k, v in enumerate(symbols(data[a:z]))) % PRIME
        for a, z in zip(start, end)
    ]
    assert unmixed(mix(np.array(want, np.uint64))).tolist() == want
    for size in (1 << 18, 30, 1):
        monkeypatch.setattr(arrays, "_SLICE", size)
        assert unmixed(byte_hashes(data, start, end, 1)).tolist() == want
    x = rng.integers(0, 2**64, 200, np.uint64)
    point = arrays._POINTS[2]
    for k in (1, 2, 3, 5, 10, 26, 50, 200):
        grams, whole = ngrams(np.array([0, 200]), x, k)
        poly = [sum(int(v) * pow(point, j, PRIME) for j, v in enumerate(x[i : i + k])) % PRIME for i in range(201 - k)]
        assert unmixed(grams[whole]).tolist() == poly
        assert sequence_hashes(x, np.array([0, 7]), np.array([min(k, 4), 9])).tolist()[0] == (
            ngrams(np.array([0, 200]), x, min(k, 4))[0][0])
    assert (ngrams(np.array([0, 200]), x, 201)[1] == 0).all()


def test_words_that_break_hashes_modulo_powers_of_two():
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate({97: "b", 98: "a"})
    data, offsets = utf8(pa.array([one, other]))
    _, hashes = words(data, offsets)
    assert hashes[0] != hashes[1]


def test_segments_of_one_hash_are_told_apart(monkeypatch):
    """Whatever the hash, equal segments are found by their bytes."""
    monkeypatch.setattr(arrays, "byte_hashes", lambda data, start, end, point=0: (end - start).astype(np.uint64))
    texts = ["ab cd ab", "xy ab", "é é zz"]
    data, offsets = utf8(pa.array(texts))
    first, which, names = segments.cut(data, offsets)
    assert ["".join(names[i] for i in which[a:b]) for a, b in zip(first[:-1], first[1:])] == texts
    assert len(names) == len(set(names))
