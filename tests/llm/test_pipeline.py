"""The pipeline over the smallest table, against brute force stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import bpe_sql
from test_operators import ITEMS, contamination, linked, repeats  # noqa: F401


def test_stages_keep_columns_and_survive_odd_rows(spark, docs, rows, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        if name != "tokens":
            assert now.columns == docs.columns
    assert 0 < now.count() < docs.count()


def test_columns_of_any_name_pass_unchanged(spark, docs, tmp_path):
    """Names that stages use inside, with dots or with backticks: every value stays with its row."""
    folder = str(tmp_path)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    odd = ["__row", "__id", "__twin", "__lang", "meta.url", "a`b", "found", "other_0", "kept", "bad"]
    now = docs.select(
        "doc_id", "text", "lang", "n_chars",
        *[F.concat(F.lit(f"{i} "), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(odd)],
    )
    names = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        assert now.columns == names
    rows = now.collect()
    assert len(rows) > 10
    for row in rows:
        assert list(row)[4:] == [None if row.doc_id is None else f"{i} {row.doc_id}" for i in range(len(odd))]


def test_empty_input(spark, no_docs, sf_dir, tmp_path):
    now = no_docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert now.count() == 0


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def test_pipeline_against_brute_force(spark, sf_dir, whole):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    keep = {i for i, _, c in linked(rows, 5, 80) if i == c}
    rows = [r for r in rows if r[0] in keep]
    least = {}
    for i, t, _ in sorted(rows):
        w = t.encode().split()
        for j in range(len(w) - 49):
            least.setdefault(tuple(w[j : j + 50]), i)
    cut = []
    for i, t, lang in rows:
        w = t.encode().split()
        gone = {x for j in range(len(w) - 49) if least[tuple(w[j : j + 50])] < i for x in range(j, j + 50)}
        if len(gone) < len(w):
            cut.append((i, b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else t, lang))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in contamination(cut, items) if not hit}
    import public_tokenizers
    import tiktoken

    ranks = bpe_sql.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: model.encode_ordinary(t) for i, t, _ in cut if i in clean}
    got = {r.doc_id: r.ids for r in whole.select("doc_id", "ids").collect()}
    assert got == want


def test_clean_documents_stay(spark, sf_dir, whole):
    """Texts in one of the learned languages are not rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike(r"\p{L}"))
    kept = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert kept.count() == docs.count()


UNLEARNED = [
    "Minä olen suomalainen ja asun Helsingissä, jossa talvi on kylmä ja pimeä",
    "Litwo, ojczyzno moja, ty jesteś jak zdrowie, ile cię trzeba cenić, ten tylko się dowie",
    "Съешь же ещё этих мягких французских булок, да выпей чаю",
    "Το πιστεύω του λαού είναι γνωστό σε όλους",
    "我能吞下玻璃而不伤身体。天地玄黄,宇宙洪荒",
    "Benim adım kırmızı ve ben küçük bir köpeğim, bugün hava çok güzel",
    "xkq zzvj wqpf jjkx qqzv bvxz kkwq pzzf",
    "asdkjh qwlekj zmxnb poiqwe lkasjd vbnmz qpwoek",
    "x" * 500,
]


def test_unlearned_languages_and_noise_go_and_short_texts_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in docs.where(F.col("text").rlike(r"\p{L}")).orderBy("doc_id").collect()]
    short = [" ".join(t.split()[:n]) for t in texts for n in (2, 4, 8)]
    short = [t for t in short if any(c.isalpha() for c in t)]
    planted = [(10**6 + i, t) for i, t in enumerate(UNLEARNED + short)]
    made = spark.createDataFrame(planted, "doc_id long, text string")
    both = docs.unionByName(made, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, both, sf_dir).collect()}
    lost = [t for i, t in planted[len(UNLEARNED) :] if i not in kept]
    assert [t for i, t in planted[: len(UNLEARNED)] if i in kept] == []
    assert len(lost) <= len(short) // 200, lost
    assert {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()} <= kept
