"""What one task or the driver holds stays bounded, and results do not depend on the bounds."""

import numpy as np
import pyarrow as pa

from leadloom.llm import bpe_sql, jaccard_join, language, substring_dedup
from leadloom.sources.scratch import materialize




def _bucket(documents):
    """What documents send to a bucket, one row each and each in a batch of its own."""
    made = []
    for i, text in enumerate(documents):
        column = {"id": pa.array([i]), "twin": pa.array([i], pa.int32()), "text": pa.array([text])}
        for row in substring_dedup._pack_batch(pa.RecordBatch.from_pydict(column), 1, 6, 3):
            made.append({"bucket": pa.array([row["bucket"]], pa.int32())} | {
                k: pa.array([row[k].astype(t).tobytes()], pa.binary()) for k, t in substring_dedup._TYPES.items()
            })
    return [pa.RecordBatch.from_pydict(x) for x in made]


def test_a_bucket_is_matched_in_parts():
    """However many batches a bucket comes in and windows are sorted at once, the runs are the same."""
    passage = " ".join(f"w{i}" for i in range(40))
    batches = _bucket([f"a b {passage}", passage, f"{passage} {passage} c", "d e f g h i j", f"x {passage} y {passage}"])
    assert len(batches) == 5
    whole = pa.Table.from_batches(substring_dedup._matched(iter(batches))).to_pylist()
    assert {(r["id"], r["ref"]) for r in whole} == {(1, 0), (2, 0), (4, 0)}
    one = pa.Table.from_batches(batches).combine_chunks().to_batches()
    for some in (batches, one, [batches[0], *pa.Table.from_batches(batches[1:]).combine_chunks().to_batches()]):
        assert pa.Table.from_batches(substring_dedup._matched(iter(some), most=7)).to_pylist() == whole


def test_rows_resolved_early_pass_a_bucket():
    """Runs that were found where they were packed go out with their own reference, next to others."""
    text = " ".join(f"w{i}" for i in range(12))
    column = {"id": pa.array([5, 7]), "twin": pa.array([1, 2], pa.int32()), "text": pa.array([text, text])}
    rows = list(substring_dedup._pack_batch(pa.RecordBatch.from_pydict(column), 1, 6, 3))
    batch = pa.RecordBatch.from_pydict(
        {k: pa.array([r[k].astype(t).tobytes() for r in rows], pa.binary()) for k, t in substring_dedup._TYPES.items()}
    )
    found = pa.Table.from_batches(substring_dedup._matched(iter([batch]))).to_pylist()
    assert found == [{"id": 7, "twin": 2, "start": 0, "size": 7, "ref": 5}]


def test_language_samples_hold_no_empty_slots(monkeypatch):
    """The driver holds the slots that texts have, and both ways to the margins give the same."""
    texts = ["the cat sat on the mat", "le chat est sur le tapis", "", "der hund ist im haus " * 5]
    x = language._features(pa.array(texts))
    assert x.n == 4 and len(x.value) < 4 * language.DIMENSIONS / 50
    full = np.zeros((4, language.DIMENSIONS))
    full[x.row, x.slot] = x.value
    assert np.allclose(full.sum(axis=1), [1, 1, 0, 1])
    factor = np.array([1.0, -2.0, 3.0, 0.5])
    want = full @ (full.T @ factor)
    assert np.allclose(x.margins(factor), want)
    some = x.where(np.array([True, False, True, True]))
    assert np.allclose(some.margins(factor[[0, 2, 3]]), (full[[0, 2, 3]] @ full[[0, 2, 3]].T) @ factor[[0, 2, 3]])
    monkeypatch.setattr(language, "_MATRIX", 0)
    assert np.allclose(x.margins(factor), want)


def test_few_texts_are_looked_up_without_a_shuffle_of_all(spark):
    """The join takes texts by ids that are known to be few, and what it finds lands in few files."""
    rows = [(i, i % 7, f"a b c d e f {i} " * 8) for i in range(4000)]
    docs = spark.createDataFrame(rows, "id bigint, twin int, text string").repartition(16)
    sets = materialize(jaccard_join._set_table(docs, 5, 80).drop("lacking"), "sets")
    keys = sets.where("id % 1000 = 3").select("key").distinct()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        texts = jaccard_join._texts(keys, docs, sets)
        plan = texts._jdf.queryExecution().executedPlan().toString()
        grams = jaccard_join._grams(keys, docs, sets, 5)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r["text"] for r in texts.collect()) == sorted(rows[i][2] for i in (3, 1003, 2003, 3003))
        assert grams.count() == 4 and len(grams.inputFiles()) <= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_bytes_of_a_text_batch_stay_small():
    """Two workers beside a full heap: a batch and the kept segments leave room."""
    assert bpe_sql.BATCH_BYTES <= 4 << 20
    assert bpe_sql.BpeDatabase({bytes([i]): i for i in range(256)}, r"\w+|\W").known.entries == bpe_sql.KEPT <= 400_000
