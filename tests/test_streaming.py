"""Streams fed in several drops give what one batch gives."""

import csv
import datetime as dt

import pytest

from checks import queries as Q
from checks.leads import as_job_events, raw_leads, table
from leadloom.operators import jobs
from leadloom.operators.mapping import HeaderMapping
from leadloom.plans.pipeline import CleanOptions, clean, clean_leads
from leadloom.plans.run import run
from leadloom.streaming import streams
from leadloom.streaming.levels import Levels, folders_read, latest_by, live_folders, sum_of

COLUMNS = ["row_index", "company", "email", "name"]
MAPPING = HeaderMapping({"company": "company_name", "email": "email", "name": "last_name"})


def drop(folder, name, rows):
    with open(folder / f".{name}", "w", newline="") as f:
        csv.writer(f).writerows([COLUMNS, *rows])
    (folder / f".{name}").rename(folder / f"{name}.csv")


DROPS = [
    # Row 5 ties with row 2, which arrives later and wins.
    [(5, "Acme", "", "B"), (6, "Beta", "x@y.zz", "C"), (7, "", "", "D"), (8, "", "", "")],
    [(2, " ACME ", "", "A"), (1, "Beta", "", "E"), (9, "", "q@y.zz", "")],
    [(0, "beta", "x@y.zz", "F"), (11, "Acme", "", "Z"), (12, "", "", "two\nlines")],
]


def batch(spark, options):
    rows = [r for d in DROPS for r in d]
    df = spark.createDataFrame(rows, "row_index bigint, company string, email string, name string")
    return sorted(map(tuple, clean_leads(df, MAPPING, options).collect()))


def test_clean_and_best_contact(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, rows in enumerate(DROPS):
        drop(folder, f"d{n}", rows)
        source = streams.read_drop_folder(spark, str(folder), COLUMNS)
        streams.stream_clean(
            source, MAPPING, str(tmp_path / "clean"), str(tmp_path / "cs"), CleanOptions(source_label="S")
        ).awaitTermination()
        for query in streams.stream_best_contact(
            source, MAPPING, str(tmp_path / "best"), str(tmp_path / "bs")
        ):
            query.awaitTermination()
        if n == 0:
            first = {r["row_index"] for r in streams.current_best(spark, str(tmp_path / "best")).collect()}
            assert first == {5, 6, 7}
    cleaned = sorted(map(tuple, spark.read.parquet(str(tmp_path / "clean")).collect()))
    assert cleaned == batch(spark, CleanOptions(source_label="S"))
    best = streams.current_best(spark, str(tmp_path / "best"), "S")
    options = CleanOptions(one_contact_per_company=True, source_label="S")
    assert sorted(map(tuple, best.collect())) == batch(spark, options)
    assert {r["row_index"] for r in best.collect()} == {0, 2, 7, 9, 12}


def test_job_state_in_drops(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events")
    folder = str(tmp_path / "events")
    for part in (2, 0, 1):
        events.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(folder)
        source = as_job_events(spark.readStream.schema(events.schema).parquet(folder))
        streams.stream_job_state(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = streams.current_state(spark, str(tmp_path / "out"))
    want = jobs.job_state(as_job_events(events))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_drops_in_drops(spark, tmp_path):
    """The ledger as a changelog: a displaced winner goes out, a better contact comes in."""
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    for n, rows in enumerate(DROPS):
        drop(folder, f"d{n}", rows)
        seen += rows
        source = streams.read_drop_folder(spark, str(folder), COLUMNS)
        for query in streams.stream_drops(source, MAPPING, str(tmp_path / "out"), str(tmp_path / "cp")):
            query.awaitTermination()
        df = spark.createDataFrame(seen, "row_index bigint, company string, email string, name string")
        want = clean(df, MAPPING, CleanOptions(one_contact_per_company=True)).drops
        got = streams.current_drops(spark, str(tmp_path / "out"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_best_contact_keeps_no_whole_rows(spark, tmp_path, monkeypatch):
    """No state, and ids that come again, in a batch or over three of them, leave one row per company."""
    monkeypatch.setattr(streams, "_best", lambda output: Levels(f"{output}/best", streams._best_rows, fan=2))
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    first = [(1, "A", "", "x"), (1, "B", "x@y.zz", ""), (1, "", "", "n"), (2, "A", "", "y"), (2, "", "", "n"), (3, "C", "", ""), (3, "C", "", "")]
    for n, rows in enumerate([first, *([(1 - k, "A", "", f"k{k}")] for k in (1, 2))]):
        drop(folder, f"d{n}", rows)
        source = streams.read_drop_folder(spark, str(folder), COLUMNS)
        for query in streams.stream_best_contact(source, MAPPING, out, str(tmp_path / "cp")):
            query.awaitTermination()
            assert not query.lastProgress["stateOperators"]
        if n in (0, 2):
            kept = [(r["company_name"], r["row_index"]) for r in streams.current_best(spark, out).collect()]
            assert sorted(kept) == [("", 1), ("", 2), ("A", 1 if n == 0 else -1), ("B", 1), ("C", 3)]
    assert len(streams._best(out).folders(spark)) == 2


def test_drops_keep_no_state(spark, tmp_path):
    """Rows are read once, no company is worked on alone, and a batch that is half written is not read."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    rows = [(1, "A", "", ""), (1, "a ", "", ""), (2, "A", "x@y.zz", ""), (3, "A", "x@y.zz", ""), (4, "", "", ""), (4, " ", "", ""), (5, "", "", "n")]
    drop(folder, "d0", rows)
    queries = streams.stream_drops(streams.read_drop_folder(spark, str(folder), COLUMNS), MAPPING, out, str(tmp_path / "cp"))
    for query in queries:
        query.awaitTermination()
        assert not query.lastProgress["stateOperators"]
    assert len(queries) == 1

    def ledger():
        return sorted((r["row_index"], r["reason"]) for r in streams.current_drops(spark, out).collect())

    # An id that comes again is in the ledger once for its company, an empty row each time.
    assert [i for i, _ in ledger()] == [1, 3, 4, 4] and {r for i, r in ledger() if i < 4} == {"duplicate_contact"}
    contacts, winners, _ = streams._ledger(out)
    new = spark.createDataFrame([("a", 0, 500)], "company_key string, row_index bigint, priority_score bigint")
    contacts.write(new.selectExpr("company_key", "row_index", "1L AS change"), 1)
    winners.write(new, 1)
    assert [i for i, _ in ledger()] == [1, 3, 4, 4]


def test_finished_jobs_leave_the_state(spark, tmp_path):
    def at(hours):
        return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)

    parts = [
        [(1, at(0), 1, "queued", None), (1, at(1), 2, "completed", None), (2, at(1), 3, "failed", "bad"), (3, at(2), 4, "queued", None)],
        # Job 2 is touched in time, job 1 is not.
        [(2, at(20), 5, "processing", None), (4, at(25.5), 6, "failed", "x")],
        [(5, at(60), 7, "queued", None)],
        # What comes back is a new job; too old an event is ignored.
        [(1, at(61), 8, "queued", None), (6, at(2), 9, "queued", None), (4, at(61), 10, "processing", None)],
    ]
    folder, kept = str(tmp_path / "events"), []
    schema = "job_id bigint, ts timestamp, event_id bigint, status string, error string"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        events = spark.readStream.schema(schema).parquet(folder)
        streams.stream_job_retention(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        state = streams.kept_jobs(spark, str(tmp_path / "out")).collect()
        kept.append({r["job_id"]: (r["status"], r["created_at"], r["error"]) for r in state})
    assert set(kept[0]) == {1, 2, 3} and kept[0][2] == ("failed", at(1), "bad")
    assert set(kept[1]) == {2, 3, 4} and kept[1][2] == ("processing", at(1), None)
    assert set(kept[2]) == {2, 3, 5}
    assert set(kept[3]) == {1, 2, 3, 4, 5} and kept[3][1] == ("queued", at(61), None)
    assert kept[3][4] == ("processing", at(61), None)


def test_readers_open_few_folders(spark, tmp_path):
    changes = Levels(str(tmp_path / "c"), latest_by("k"), fan=3)
    sums = Levels(str(tmp_path / "s"), sum_of("change", "k"), fan=3)
    want, totals = {}, {}
    with pytest.raises(ValueError, match="no finished batch"):
        changes.read(spark)
    for n in range(31):
        rows = [(n % 7, f"v{n}"), (n % 5 + 10, f"w{n}")]
        want.update(rows)
        changes.write(spark.createDataFrame(rows, "k int, v string").coalesce(1), n)
        added = [(n % 4, 1), (n % 3, -1)]
        for k, x in added:
            totals[k] = totals.get(k, 0) + x
        sums.write(spark.createDataFrame(added, "k int, change bigint").coalesce(1), n)
        if n in (0, 2, 8, 17, 25, 30):
            if n == 17:  # a batch that runs again changes nothing
                changes.write(spark.createDataFrame(rows, "k int, v string").coalesce(1), n)
            got = changes.read(spark)
            assert {r["k"]: r["v"] for r in got.collect()} == want
            assert len(folders_read(got)) <= len(live_folders(n + 1, 3)) <= 2 * 4
            assert {r["k"]: r["change"] for r in sums.read(spark).collect()} == {k: x for k, x in totals.items() if x}
    assert len(live_folders(10**6)) <= 7 * 7
    live = {f.split("/c/")[1] for f in changes.folders(spark)}
    assert live.isdisjoint(f.split("/c/")[1] for f in changes.merged_folders(spark))


def test_files_of_any_headers_as_they_arrive(spark, tmp_path):
    """Other header order, Latin-1, CR line ends, a long row, an unclosed quote: as in one batch run."""
    folder = tmp_path / "in"
    folder.mkdir()
    files = {
        "a": b"Email,Company\nann@x.co,Acme\n,\nb@x.co,B,extra\n",
        "b": "Company,Title,Email\rGr\xfcn,Chef,g@x.co\r".encode("latin-1"),
        "c": b'Email,Company\n"open,Acme\n',
        "d": b"x,y\n1,2\n",
        "e": b'E-mail,e-mail\r\n"q@x.co",z@x.co\r\n',
    }
    arrivals = None
    for k, (name, content) in enumerate(files.items()):
        (folder / f"{name}.csv").write_bytes(content)
        if k in (1, 4):  # two drops, of two and three files, two files a batch
            arrivals = streams.read_arrivals(spark, str(folder), max_files=2)
            streams.stream_feeds(arrivals, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    paths = run(spark, str(folder), str(tmp_path / "batch"))
    for name in ("rows", "drops", "rejects", "unread"):
        got = streams.arrived(spark, str(tmp_path / "out"), name).drop("batch_id")
        want = spark.read.parquet(getattr(paths, name))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), name
    listed = streams.arrived(spark, str(tmp_path / "out"), "manifest").collect()
    assert sorted(r["path"][-5:] for r in listed) == [f"{f}.csv" for f in files]
    assert {r["batch_id"] for r in listed} == {0, 1, 2}
    with pytest.raises(ValueError):
        streams.arrived(spark, str(tmp_path / "out"), "else")


def test_raw_leads_stream_equals_batch(spark, sf_dir):
    got = Q.stream_best_contact(spark, sf_dir).select("row_index").collect()
    want = clean_leads(raw_leads(spark, sf_dir), Q.MAPPING, Q.DEDUP).select("row_index").collect()
    assert sorted(got) == sorted(want)
