"""Ranked search against brute force and SQL."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import types as T

from checks.compare import differences
from leadloom.llm import ranked_search
from leadloom.llm.oracle import oracle_sql
from leadloom.llm.queries import queries
from leadloom.sources.scratch import materialize

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOW) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    total = sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in items:
        asked, scored = collections.Counter(terms(text)), []
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
        for i, c in counted:
            m = 100 - 25 + 25 * c.total() * n_docs // max(total, 1)
            score = sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return collections.Counter(rows)


def corpus():
    rng = random.Random(3)
    vocabulary = [f"W{i}" for i in range(300)] + ["É", "ÉA", "𝔘𝔫", "naïve"]
    docs = []
    for i in range(700):
        words = rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.choice([1, 5, 40, 200]))
        docs.append((i * 3 - 60, " ".join(words)))
    docs += [(5000 + i, "rare tie term") for i in range(60)]  # many equal scores
    docs += [(1, None), (2, ""), (3, " .,\n"), (None, "rare w1"), (None, "rare w1"), (4, "rare w1"), (4, "rare w1"), (4, "other w2")]
    docs += [(6000, "w7 " * 60_000 + " ".join(f"long{i}" for i in range(30_000))), (6001, "w7 w7 w7 W7 w8"), (6002, "x_y-z'q 12ab")]
    return docs


ITEMS = [("a", "w1 w2 W3 w3"), ("b", "rare tie term"), ("c", None), ("d", "unheard of"), (None, "w7 long5"), ("b", "rare tie term"),
         ("e", "É 𝔘𝔫 naïve É"), ("f", "X Y Z q 12AB"), ("g", " ".join(f"w{i}" for i in range(120))), ("h", "...")]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()),
                       T.StructField("a`b", T.StringType()), T.StructField("query", T.StringType())])


@pytest.mark.parametrize("block_docs, chunk_terms, k", [(1024, 100_000, 20), (7, 20, 20), (50, 60, 3)])
def test_search_against_brute_force(spark, block_docs, chunk_terms, k):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in corpus()], SCHEMA).repartition(3)
    items = spark.createDataFrame([(*r, "q") for r in ITEMS], "item_id string, text string, query string")
    index = materialize(ranked_search.build_index(docs, block_docs=block_docs), "index")
    got = collections.Counter(tuple(r) for r in ranked_search.search(index, items, k, chunk_terms=chunk_terms).collect())
    assert got == brute(corpus(), ITEMS, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in corpus()], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    empty = materialize(ranked_search.build_index(docs.limit(0)), "index")
    index = materialize(ranked_search.build_index(docs), "index")
    assert ranked_search.search(empty, items).collect() == []
    assert ranked_search.search(index, items.limit(0)).collect() == []
    blank = materialize(ranked_search.build_index(docs.where("doc_id in (1, 2)")), "index")
    assert ranked_search.search(blank, items).collect() == []


def test_bounds_exclude_most_documents(spark):
    """Bounds are bounds, and few documents need their counts."""
    docs = corpus()
    counts = [collections.Counter(t.encode() for t in terms(text)) for _, text in docs]
    block = ranked_search._Block(1 << 15)
    for (i, _), c in zip(docs, counts):
        block.add(i, list(c.elements()), c)
    row = block.row()
    scored = []

    class Watched(ranked_search._Searcher):
        def _exact(self, query, found, *rest):
            scored.append(len(found))
            return super()._exact(query, found, *rest)

    n_docs, total = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    Watched({0: [(b"rare", 5000), (b"w1", 100)]}, 3, n_docs, total).block(row)
    assert 0 < sum(scored) < len(docs) / 5


def test_query(spark, duck, sf_dir):
    assert differences(queries()["op12_ranked_search"](spark, sf_dir), duck, oracle_sql()["op12_ranked_search"]) is None
