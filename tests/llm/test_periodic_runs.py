"""Runs of repeated words against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from leadloom.llm import periodic_runs
from leadloom.llm.queries import queries, read


def brute_runs(words, least=6, exponent=4):
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                piece = words[i : i + length]
                if not any(piece[d:] == piece[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_of_random_sequences(exponent):
    rng = random.Random(exponent)
    for _ in range(400):
        n, letters = rng.randint(1, 60), rng.choice([1, 2, 2, 3, 5])
        seq = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.5:
            root = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
            seq = seq[: n // 3] + root * rng.randint(2, 6) + root[: len(root) // 2] + seq[n // 3 :]
        got = [(int(s), int(length), int(p)) for s, p, length in periodic_runs.runs_of(seq, 3, exponent)]
        assert sorted(got) == sorted(brute_runs(seq, 3, exponent))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts():
    rng = random.Random(5)
    some = [f"w{rng.randrange(400)}" for _ in range(3000)]
    found = [
        None, "", " \t\n", "a", "a a a a a", "a a a a a a", "b a a a a a a b", " ".join("ab" * 6), " ".join("ab" * 4) + " a",
        "x " * 50_000, " ".join(fibonacci(2000)), " ".join(some), " ".join(some[:700] * 5 + some),
        "a b " * 6 + "a b", "A a " * 8, "p q r\n" * 9 + "p q\x0bs " + "p q r\t" * 9,
        " ".join(some[:40] + some[40:49] * 4 + some[49:57] * 4 + some[57:66] * 5 + ["z"] * 7 + some[66:]),
        " ".join((some[:17] * 4 + ["k"]) * 5), " ".join(some[:5]) + " " + "line of words that repeats\n" * 300,
    ]
    for k in range(120):
        n = rng.randint(1, 90)
        words = [rng.choice("abc") for _ in range(n)]
        found.append(" ".join(words[: n // 2] + words[n // 3 : n // 2] * rng.randint(1, 7) + words[n // 2 :]))
    return found


def test_find_runs_against_brute_force(spark):
    rows = texts()
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType()),
         T.StructField("n_words", T.StringType()), T.StructField("a`b", T.StringType()), T.StructField("meta.url", T.StringType())]
    )
    table = [(i, t, "r", "n", "b", "u") for i, t in enumerate(rows)] + [(None, rows[6], "r", "n", "b", "u"), (3, rows[5], "", "", "", "")]
    df = spark.createDataFrame(table, schema).repartition(3)
    got = periodic_runs.find_runs(df, keep=("doc_id", "meta.url", "a`b")).collect()
    assert len(got) == len(table) and all(r["a`b"] in ("b", "") for r in got)
    seen = {(r.doc_id, r["meta.url"]): r for r in got}
    for i, t, _, _, _, url in table:
        r = seen[i, url]
        words = (t or "").encode().split()
        words = [w.decode() for w in words]
        # The slow search is quadratic in the words: long ones have known runs.
        runs = [(0, 50_000, 1)] if i == 9 else brute_runs(words)
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), runs), (i, t and t[:80])
        assert r.collapsed == brute_collapsed(words, runs)
    assert periodic_runs.find_runs(df.limit(0)).collect() == []


def test_small_slices_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, periodic_runs.find_runs(df).collect()))
    split = [(t or "").encode().split() for t in texts()]
    for size in (1, 7):
        rows = []
        for at in range(0, len(split), size):
            runs, _ = periodic_runs._runs_of_texts(split[at : at + size], 6, 4)
            rows += [(at + t, s, length, p) for t, s, p, length in runs.tolist()]
        assert rows == [(i, *r) for i, _, runs, _ in whole for r in runs]


def test_least_exponent(spark):
    with pytest.raises(ValueError):
        periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string"), least_exponent=1)


def test_query(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op11_periodic_runs"](spark, sf_dir).collect()}
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    slow = 0
    for i, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        if n > 1500:
            slow += 1
            continue
        runs = brute_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = None if top[0] is None else 1000 * top[1] // top[2]
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want = (len(runs), *top, milli, hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest())
        assert got[i] == want, i
    assert slow < len(docs) / 4
