"""Operators over odd rows, against brute force."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadloom.llm import (
    bpe_sql,
    decontaminate,
    fingerprint,
    jaccard_join,
    katz,
    language,
    sharding,
    substring_dedup,
    token_files,
    url_filter,
)
from leadloom.llm.oracle import oracle_sql
from leadloom.llm.queries import URL_RULES, queries
from leadloom.sources.scratch import new_path

LOW = {c: c + 32 for c in range(65, 91)}
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(df, *columns):
    rows = [tuple(r) for r in df.select(*columns).collect()] if columns else [tuple(r) for r in df.collect()]
    return collections.Counter(rows)


# 1. Decontamination ------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, size=10):
    windows = []
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        windows += [(item, tuple(w[j : j + size])) for j in range(max(1, len(w) - size + 1))] if w else []
    out = collections.Counter()
    for i, text, _ in rows:
        w, hit, found = WORD.findall((text or "").translate(LOW)), set(), set()
        for item, win in windows:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit.update(range(j, j + len(win)))
                    found.add(item)
        found = sorted(str(x) for x in found if x is not None)
        out[(i, len(w), len(hit), tuple(found))] += 1
    return out


ITEMS = [
    (1, "quick brown fox jumps over the lazy dog near the river bank"),
    (2, "ONE two, three!"),
    (3, "kleiner Hund3 läuft über die grüne Wiese und sucht nach einem Ball"),
    (4, None),
    (5, " ... "),
    (6, "one two three"),
    (None, "null id"),
    (10, "le petit chat dort sur la chaise rouge près de la fenêtre"),
    (12, "über die GRÜNE"),
    (13, "über die grüne"),
    (11, "word5 über5 word6 über6 word7 über7 word8 über8 word9 über9 word10"),
]


@pytest.mark.parametrize("literals, broadcast", [(100_000, 32 << 20), (0, 0)])
def test_contamination(spark, docs, rows, no_docs, monkeypatch, literals, broadcast):
    monkeypatch.setattr(decontaminate, "MAX_LITERALS", literals)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", broadcast)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, items)
    want = contamination(rows, ITEMS)
    assert collections.Counter(
        (r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()
    ) == want
    assert sum(n for (*_, found), n in want.items() if found) > 5
    assert decontaminate.contamination(no_docs, items).count() == 0
    clean = decontaminate.contamination(docs, items.limit(0))
    assert clean.where("n_hit > 0 or n_items > 0").count() == 0 and clean.count() == len(rows)


# 2. Sharding -------------------------------------------------------------------------------------


def test_differencing_places_every_row():
    rng = np.random.default_rng(1)
    sums = np.zeros((300, 7), np.int64)
    sums[:, 0] = rng.integers(1, 1000, 300)
    total, place = sharding.difference(sums)
    again = np.zeros(7, np.int64)
    np.add.at(again, place, sums)
    assert sorted(again) == sorted(total) and again.max() - again.min() <= 3
    assert all(sorted(p) == list(range(7)) for p in place)
    assert sharding.difference(np.zeros((0, 3), np.int64))[1].shape == (0, 3)


def test_differencing_beats_greedy_on_the_textbook_case():
    sums = np.zeros((5, 2), np.int64)
    sums[:, 0] = [8, 7, 6, 5, 4]
    assert sorted(sharding.difference(sums)[0]) == [14, 16]


@pytest.mark.parametrize("block", [20_000, 4])
def test_shards(docs, rows, no_docs, block, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    got = sharding.shard_documents(docs, 4, block_groups=block).collect()
    sized = lambda t: len((t or "").encode()) + 16
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        (i, sized(t), zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    homes = collections.defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard_documents(no_docs, 4).count() == 0


# 3. Language -------------------------------------------------------------------------------------


def test_language(spark, docs, rows, no_docs):
    model = language.fit(docs, per_language=20)
    got = language.identify(docs, model, keep=("doc_id", "text", "lang", "score"), names=("p", "s")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            assert (r.p, r.s) == ("und", 0.0)
        else:
            assert r.p in ("en", "de", "fr", "es") and 0 <= r.s <= 1
    sure = [r for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id >= 0]
    assert sum(r.p == r.lang for r in sure) == len(sure)
    assert language.identify(no_docs, model).count() == 0
    assert language.fit(no_docs) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_language_held_out(spark, sf_dir):
    got = queries()["op3_language"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    seen = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert seen >= 0.97


# 4. Token files ----------------------------------------------------------------------------------


def test_pack_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        ids = rng.zipf(1.3, n).clip(0, 70000).astype(np.int32)
        assert token_files.unpack(n, *token_files.pack(ids)).tolist() == ids.tolist()
    many = np.arange(70_000, dtype=np.int32)  # ranks of one, two and three bytes
    assert (token_files.unpack(len(many), *token_files.pack(many)) == many).all()


def test_token_files(spark, docs, rows, no_docs):
    file = public_tokenizers.path("byte_bpe_50k.json")
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs, path, file)
    got = [(r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in token_files.read_tokens(spark, path).collect()]
    model, start, want = Tokenizer.from_file(file), 0, []
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(got, key=lambda r: r[0]) == want
    empty = new_path(spark, "tokens")
    token_files.write_tokens(no_docs, empty, file)
    assert token_files.read_tokens(spark, empty).count() == 0


# 5. BPE ------------------------------------------------------------------------------------------


def test_bpe(docs, rows, no_docs):
    got = bpe_sql.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    ranks = bpe_sql.read_ranks(RANKS)
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, text, _ in rows:
        ids = model.encode_ordinary(text or "")
        raw = (text or "").encode()
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), tuple(ids), raw)] += 1
    assert collections.Counter(
        (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), bytes(r.decoded)) for r in got
    ) == want
    assert bpe_sql.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("held", [10, 3_000_000])
def test_bpe_of_long_pieces(held, monkeypatch):
    """Queries that stop after a few rounds and go on give what one query gives."""
    monkeypatch.setattr(bpe_sql, "HELD_ROWS", held)
    ranks = bpe_sql.read_ranks(RANKS)
    database = bpe_sql.BpeDatabase(ranks, public_tokenizers.PATTERN)
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    names = [b"x" * 700, b"ab" * 90, "über".encode() * 40, bytes(range(97, 122)) * 9, b"zq", "字".encode() * 70, b" " * 130]
    assert database.encode(names) == [model._encode_single_piece(name) for name in names]


# 6. Fingerprints ---------------------------------------------------------------------------------


def print_of(*paragraphs):
    return fingerprint._print(*fingerprint.vectors(["\n".join(paragraphs).encode()]))[0]


def test_fingerprints_add_up():
    a, b, c = "some words here", "other words there, too", ""
    assert print_of(a, b, c) == print_of(c, b, a) != print_of(a, b)
    assert print_of(a, a, b) != print_of(a, b, b)
    assert fingerprint.add(print_of(a), print_of(b)) == print_of(a, b)
    assert fingerprint.add(print_of(a, b, c), print_of(b), -1) == print_of(a, c)
    assert fingerprint.likeness(print_of(a, b), print_of(b, a)) == 1
    assert 0 <= fingerprint.likeness(print_of(a), print_of(c)) < 1


def test_likeness_of_texts_that_repeat_a_token():
    few, some, many = (print_of("0 " * n) for n in (20_000, 40_000, 100_000))
    assert all(0.999 < fingerprint.likeness(a, b) < 1 for a, b in ((few, some), (few, many), (some, many)))
    lines = print_of(*["one line of words"] * 100_000)
    assert fingerprint.likeness(lines, print_of(*["one line of words"] * 20_000)) > 0.999
    assert fingerprint.add(few, few) == print_of("0 " * 20_000, "0 " * 20_000)
    assert fingerprint.add(fingerprint.add(many, few), few, -1) == many


@pytest.mark.parametrize("part", [24 << 20, 20_000])
def test_compare_with_next(docs, rows, no_docs, part, monkeypatch):
    monkeypatch.setattr(fingerprint, "PART_BYTES", part)
    got = fingerprint.compare_with_next(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    texts = [t or "" for _, t, _ in order]
    want = collections.Counter(
        (order[j][0], len(t), hashlib.sha256(fingerprint.edited(t, texts[(j + 1) % len(texts)]).encode()).hexdigest())
        for j, t in enumerate(texts)
    )
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprint.compare_with_next(no_docs).count() == 0
    plain = table(fingerprint.fingerprints(docs))
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == plain


# 7. URL rules ------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://example.com", "http://example.com/", "http://EXAMPLE.com/en/x",
    "http://www.example.com/en/", "http://a.www.example.com/en/y?q=://z", "http://notexample.com/en/",
    "https://x.net/es/", "https://net/fr/1", "https://x.net/esp", "http://x.org/a.com/b", "http://x.org?.com/",
    "http://user@host.com:80/p", "http://a.com#/en/", "x://y.com/\n/z", "ä://Ä.COM/ö", "http://" + "a." * 3000 + "com/" + "p" * 9000,
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = re.match(r"[^?#]*", url.split("://", 1)[1]).group()
        host, slash, tail = rest.partition("/")
        host, path = host.translate(LOW), slash + tail
    best = max(
        (r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)),
        key=lambda r: len(r.name), default=None,
    )
    return host, path, best and best.name, best.verdict if best else "allow"


def test_urls(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BATCH_BYTES", 4000)
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, k0 string")
    got = url_filter.judge_urls(pages, URL_RULES)
    assert table(got) == collections.Counter((i, *judged(u)) for i, u in enumerate(URLS * 2))
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


# 8. Substring dedup ------------------------------------------------------------------------------


def repeats(rows, window):
    words = [(i if i is not None else math.inf, (t or "").encode().split()) for i, t, _ in rows]
    least = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            least[k] = min(i, least.get(k, math.inf))
    out = collections.Counter()
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[(None if i == math.inf else i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window, block", [(50, 26), (8, 5), (3, 1)])
def test_repeats(docs, rows, no_docs, window, block):
    got = substring_dedup.remove_repeats(docs, window, block, texts=False)
    want = repeats(rows, window)
    assert table(got) == want and sum(n for (_, _, gone, _), n in want.items() if gone) > 2
    if window == 8:
        for r in substring_dedup.remove_repeats(docs, window, block, keep=("text",)).collect():
            words = (r.text or "").split()
            assert r.kept == (r.text or "") if not r.n_removed else len(r.kept.split()) == r.n_words - r.n_removed
            assert all(f["words"] >= window and f["start"] + f["words"] <= r.n_words for f in r.factors)
            assert bool(r.factors) == (r.n_removed > 0)
    assert substring_dedup.remove_repeats(no_docs).count() == 0


# 9. Katz -----------------------------------------------------------------------------------------


def katz_scores(rows, held):
    tokens = [(i, held(i), (t or "").translate(LOW).encode().split() + [0]) for i, t, _ in rows]
    c, b, h = collections.Counter(), collections.Counter(), collections.Counter()
    follow = collections.defaultdict(set)
    for _, out, w in tokens:
        if not out:
            past = [1, *w[:-1]]
            c.update(w), h.update(past), b.update(zip(past, w))
    for v, w in b:
        follow[v].add(w)
    of = lambda k: [sum(n == r for n in k.values()) for r in range(1, katz.KEEP + 2)]
    one, two = katz.discounts(of(c)), katz.discounts(of(b))
    total = sum(c.values())
    cut = lambda n, d: n * (d[n] if n <= katz.KEEP else 1)
    left = sum(n - cut(n, one) for n in c.values()) or 0.5
    n_all = total - sum(n - cut(n, one) for n in c.values()) + left
    single = lambda w: (cut(c[w], one) if c[w] else left) / n_all
    memo = {}

    def p(v, w):
        if not h[v]:
            return single(w)
        if v not in memo:
            taken = sum(b[v, x] - cut(b[v, x], two) for x in follow[v])
            rest = taken or 0.5
            whole = h[v] - taken + rest
            memo[v] = whole, rest / whole / (1 - sum(single(x) for x in follow[v]))
        whole, back = memo[v]
        return cut(b[v, w], two) / whole if b[v, w] else back * single(w)

    scores = []
    for i, out, w in tokens:
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in w)
        score = sum(math.log10(p(v, x)) for v, x in zip([1, *w[:-1]], w))
        scores.append((i, out, len(w), sum(c[x] > 0 for x in w), total, base, score))
    sums = [sum(p(v, w) for w in c) + (memo[v][1] if v in memo else 1) * left / n_all for v in [1, *list(c)[:40]]]
    return scores, sums


@pytest.mark.parametrize("share", [4, 4000])
def test_katz(docs, rows, no_docs, share, monkeypatch):
    monkeypatch.setattr(katz, "HOT_SHARE", share)  # the larger one splits nearly all histories
    held = lambda i: i is not None and i % 5 == 1
    got = katz.score_documents(docs, F.col("doc_id") % 5 == 1).collect()
    want, sums = katz_scores(rows, held)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    near = lambda r: (r[0] is not None, *[x if x is not None else 0 for x in r[:5]], round(r[5], 6), round(r[6], 6))
    assert sorted(map(near, map(tuple, got))) == sorted(map(near, want))
    assert katz.score_documents(no_docs, F.lit(False)).count() == 0


def test_discounts_are_factors():
    assert (katz.discounts([0] * 6)[1:] < 1).all()
    # By Zipf's law r occurs 1 / r / (r + 1) as often, and r* / r is (r + 1) / (r + 2).
    d = katz.discounts([42_000, 14_000, 7_000, 4_200, 2_800, 2_000])
    q = 6 * 2_000 / 42_000
    assert d[1:] == pytest.approx([((r + 1) / (r + 2) - q) / (1 - q) for r in range(1, 6)])
    assert ((0 < d[1:]) & (d[1:] < 1)).all() and (np.diff(d[1:]) > 0).all()


# 10. Jaccard join --------------------------------------------------------------------------------


def shingles(text, k):
    w = (text or "").translate(LOW).encode().split()
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def linked(rows, k, percent):
    sets = [shingles(t, k) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            groups[find(a)].append(i)
    return collections.Counter(
        (i, len(sets[a]), min(groups[find(a)], default=None)) for a, (i, _, _) in enumerate(rows)
    )


def near_copies(n=260):
    """Groups of near copies of many sizes, some chained, and a passage that many share."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(n):
        size = int(rng.integers(4, 120))
        base = [f"w{int(rng.integers(0, 40))}x{j}" for j in range(size)]
        text = base + passage if i % 3 == 0 else base
        rows.append((len(rows), " ".join(text), "en"))
        for _ in range(int(rng.integers(0, 3)) if i % 10 else 30):
            changed = list(text)
            for _ in range(int(rng.integers(0, 1 + len(changed) // 40 + 1))):
                changed[int(rng.integers(0, len(changed)))] = f"new{int(rng.integers(0, 10**6))}"
            rows.append((len(rows), " ".join(changed), "en"))
    return rows


@pytest.mark.parametrize("k, percent", [(5, 80), (1, 60), (2, 90)])
def test_near_duplicates_of_odd_rows(docs, rows, no_docs, k, percent):
    assert table(jaccard_join.near_duplicates(docs, k, percent)) == linked(rows, k, percent)
    if k == 5:
        assert jaccard_join.near_duplicates(no_docs).count() == 0
        kept = jaccard_join.survivors(docs)
        assert kept.columns == docs.columns
        want = linked(rows, k, percent)
        # One row of each component with words, all rows without.
        parts = {c for (_, n, c), _ in want.items() if n and c is not None}
        wordless = sum(m for (_, n, _), m in want.items() if not n)
        alone = 1  # the repeated text whose ids are null
        assert kept.count() == len(parts) + wordless + alone


@pytest.mark.parametrize("small, rounds", [(8, 3), (2, 0), (2, 1)])
def test_near_duplicates_in_large_groups(spark, small, rounds, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", small)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", rounds)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert table(jaccard_join.near_duplicates(df)) == linked(rows, 5, 80)


def test_near_duplicates_in_blocks_of_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", 2)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "MAP_SETS", 4)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert table(jaccard_join.near_duplicates(df)) == linked(rows, 5, 80)


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(11)
    compared = ruled_out = 0
    for size in (1, 5, 31, 32, 33, 200, 1000, 5000):
        for share in (0.3, 0.7, 0.85, 0.95, 1.0):
            x = rng.integers(0, 2**63, size).astype(np.uint64)
            y = np.append(x[: max(1, int(size * share))], rng.integers(0, 2**63, size // 4).astype(np.uint64))
            sizes = np.array([len(x), len(y)])
            maps = jaccard_join.parity_maps(np.repeat([0, 1], sizes), np.concatenate([x, y]), sizes)
            a, b = (np.frombuffer(m, np.uint64)[None] for m in maps)
            w = min(a.shape[1], b.shape[1])
            apart = jaccard_join._differences(jaccard_join._folded(a, w), jaccard_join._folded(b, w))
            both = len(set(x.tolist()) & set(y.tolist()))
            assert apart[0] <= len(x) + len(y) - 2 * both
            near = jaccard_join._near(apart, sizes[:1], sizes[1:], 80)[0]
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert near
            compared += 1
            ruled_out += not near
    assert ruled_out > compared // 4


@pytest.mark.parametrize("small, block", [(8, 128), (2, 5)])
def test_all_links_of_large_groups(spark, small, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", small)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rows = near_copies(60)
    sets = {i: shingles(t, 5) for i, t, _ in rows}
    want = {
        frozenset((sets[a], sets[b])) for a in sets for b in range(a)
        if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    pairs, members = jaccard_join.links(df)
    of = {r.set: sets[r.doc_id] for r in members.collect()}
    got = [frozenset((of[r.a], of[r.b])) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert collections.Counter(r.doc_id for r in members.collect()) == collections.Counter(i for i, _, _ in rows)


def test_links_of_odd_rows(docs, rows, no_docs):
    pairs, members = jaccard_join.links(docs, 1, 60)
    sets = [shingles(t, 1) for _, t, _ in rows]
    distinct = {s for s in sets if s}
    want = sum(
        100 * len(x & y) >= 60 * len(x | y) for x in distinct for y in distinct if x is not y
    )
    assert 2 * pairs.count() == want and members.count() == len(rows)
    assert jaccard_join.links(no_docs)[0].count() == 0


# Registered queries ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", oracle_sql())
def test_sql(spark, duck, sf_dir, name):
    from checks.compare import differences

    assert differences(queries()[name](spark, sf_dir), duck, oracle_sql()[name]) is None
