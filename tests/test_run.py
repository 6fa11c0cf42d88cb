"""Runs from files to files."""

import json

from pyspark.sql import functions as F

from leadloom.operators import jobs
from leadloom.operators.mapping import HeaderMapping
from leadloom.plans.pipeline import CleanOptions
from leadloom.plans.run import run, run_feeds

DEDUP = CleanOptions(one_contact_per_company=True, source_label="Fair")


def test_run_with_proposed_mapping(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(
        "Full Name,E-mail,Company,Notes\n"
        '"Lee, Ann",ANN@x.co,Acme,"a\nb"\nBob Ray,,acme ,n/a\n,,,\nSue Day,sue@x.co,,\n'
    )
    paths = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), options=DEDUP, correlation_id="c1")
    clean = spark.read.options(header=True).csv(paths.clean)
    got = [(r["first_name"], r["last_name"], r["email"], r["company_name"], r["sources"]) for r in clean.collect()]
    assert got == [("Ann", "Lee", "ann@x.co", "Acme", "Fair"), ("Sue", "Day", "sue@x.co", None, "Fair")]
    drops = {(r["row_index"], r["reason"]) for r in spark.read.parquet(paths.drops).collect()}
    assert drops == {(1, "duplicate_contact"), (2, "empty_row")}
    report = json.loads("".join(p.read_text() for p in (tmp_path / "out" / "report").glob("part-*")))
    assert report["stats"]["total_rows"] == 4 and report["stats"]["output_rows"] == 2
    assert report["drop_counts"] == {"duplicate_contact": 1, "empty_row": 1}
    assert report["mapping"]["Full Name__SPLIT__"] == "split_names"
    assert report["unmapped_input_headers"] == ["Full Name", "Notes"]
    assert report["correlation_id"] == "c1" and report["input"]["rows"] == 4
    metrics = {r["phase"]: r["rows"] for r in spark.read.parquet(paths.metrics).collect()}
    assert metrics["normalize"] == 4 and metrics["write"] == 2 and "total" in metrics


def test_run_of_files_with_different_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Mail,Org\nann@x.co,Acme\n,acme\n")
    (tmp_path / "in" / "b.csv").write_text("Who,Tel,Mail\nMr. Bo,4155552671,bo@x.co\n")
    (tmp_path / "in" / "c.csv").write_text("x,y\n1,2\n")
    names = {n: f"file:{tmp_path}/in/{n}.csv" for n in "abc"}
    replies = spark.createDataFrame(
        [
            (names["a"], '{"mapping": {"Mail": "email", "Org": "company_name"}}'),
            (names["b"], '{"mapping": {"Tel": "phone_number"}, "split_fields": {"Who": {}}}'),
            (names["c"], "not a mapping"),
        ],
        "source_file string, reply string",
    )
    paths, feeds = run_feeds(spark, str(tmp_path / "in"), replies, str(tmp_path / "out"), DEDUP)
    clean = spark.read.options(header=True).csv(paths.clean)
    got = {(r["email"], r["last_name"], r["phone_number"]) for r in clean.collect()}
    assert got == {("ann@x.co", None, None), (None, "Bo", "+14155552671")}
    unmapped = {r["input_header"] for r in spark.read.parquet(f"{tmp_path}/out/unmapped").collect()}
    assert unmapped == {"Who", "Mail"}
    reports = [json.loads(x) for p in (tmp_path / "out" / "report").glob("part-*") for x in p.read_text().splitlines()]
    seen = {r["input"]["source_file"][-5:]: r for r in reports}
    assert seen["b.csv"]["mapping"] == {"Tel": "phone_number", "Who__SPLIT__": "split_names"}
    assert seen["b.csv"]["unmapped_input_headers"] == ["Mail", "Who"]
    why = {r["details"] for r in spark.read.parquet(paths.drops).where("reason = 'no_mapping'").collect()}
    assert why == {"No usable header mapping for the file: invalid_json"}
    assert seen["c.csv"]["drop_counts"] == {"no_mapping": 1} and seen["c.csv"]["stats"]["output_rows"] == 0


def test_run_proposes_a_mapping_for_each_layout(spark, tmp_path):
    """Files of two layouts, with headers that differ in case only or are named like columns of ours."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Email,email,row_index,a`b\nann@x.co,,7,q\n,,8,\n")
    (tmp_path / "in" / "b.csv").write_text("source_file,Org,Tel,Full Name\nz,Acme,4155552671,Bo Ray\n")
    paths = run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    clean = spark.read.options(header=True).csv(paths.clean)
    got = {(r["email"], r["company_name"], r["phone_number"], r["last_name"]) for r in clean.collect()}
    # "Org" is no name that the rule knows.
    assert got == {("ann@x.co", None, None, None), (None, None, "+14155552671", "Ray")}
    table = {(r["source_file"][-5:], r["input_header"], r["target"]) for r in spark.read.parquet(f"{tmp_path}/out/mapping").collect()}
    assert table == {("a.csv", "Email", "email"), ("b.csv", "Tel", "phone_number"), ("b.csv", "Full Name", "split_names")}
    left = {(r["source_file"][-5:], r["input_header"]) for r in spark.read.parquet(f"{tmp_path}/out/unmapped").collect()}
    assert left == {("a.csv", "email"), ("a.csv", "row_index"), ("a.csv", "a`b"), ("b.csv", "source_file"), ("b.csv", "Org"), ("b.csv", "Full Name")}
    drops = {(r["source_file"][-5:], r["row_index"], r["reason"]) for r in spark.read.parquet(paths.drops).collect()}
    assert drops == {("a.csv", 1, "empty_row")}


def test_run_with_one_mapping_for_two_layouts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Mail,`Org.x\nann@x.co,Acme\n")
    (tmp_path / "in" / "b.csv").write_text("n,`Org.x,Who\n1,Beta,Bo Ray\n")
    (tmp_path / "in" / "c.csv").write_text("n,m\n1,2\n")
    mapping = HeaderMapping({"Mail": "email", "`Org.x": "company_name"}, ["Who"])
    paths = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), mapping)
    clean = spark.read.options(header=True).csv(paths.clean)
    assert {(r["email"], r["company_name"], r["last_name"]) for r in clean.collect()} == {("ann@x.co", "Acme", None), (None, "Beta", "Ray")}
    drops = {(r["source_file"][-5:], r["reason"]) for r in spark.read.parquet(paths.drops).collect()}
    assert drops == {("c.csv", "no_mapping")}


def test_run_loses_no_row(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Mail,Org\nann@x.co,Acme\nbo@x.co,B,extra\n,\n")
    (tmp_path / "in" / "open.csv").write_text('Mail,Org\nann@x.co,"Acme\n')
    (tmp_path / "in" / "none.csv").write_text("Mail,Org\n")
    paths = run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rejects = {(r["reason"], r["record"]) for r in spark.read.parquet(paths.rejects).collect()}
    assert rejects == {("bad_row", "bo@x.co,B,extra"), ("unterminated_quote", None)}
    reports = [json.loads(x) for p in (tmp_path / "out" / "report").glob("part-*") for x in p.read_text().splitlines()]
    got = {}
    for r in reports:
        name = r["input"]["source_file"].rsplit("/", 1)[-1]
        got[name] = (r["stats"]["total_rows"], r["stats"]["output_rows"], r["drop_counts"])
        assert r["stats"]["dropped_rows"] == sum(r["drop_counts"].values()) == len(r["drops"])
    assert got == {
        "a.csv": (3, 1, {"bad_row": 1, "empty_row": 1}),
        "open.csv": (1, 0, {"unterminated_quote": 1}),
        "none.csv": (0, 0, {}),
    }


def test_run_of_an_unclosed_file_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "open.csv").write_text('Mail,Org\nann@x.co,"Acme\n')
    paths = run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [r["reason"] for r in spark.read.parquet(paths.drops).collect()] == ["unterminated_quote"]
    unread = spark.read.parquet(paths.unread).orderBy("block_start", "line").collect()
    assert [r["text"] for r in unread] == ["Mail,Org", 'ann@x.co,"Acme']


def test_jobs(spark):
    rows = [
        (1, "2024-01-01 00:00:00", 1, "queued", None), (1, "2024-01-01 00:01:00", 2, "processing", None),
        (1, "2024-01-01 00:01:00", 3, "completed", None), (2, "2024-01-02 12:00:00", 4, "failed", "bad"),
        (3, "2024-01-01 00:00:00", 5, "queued", None), (4, "2024-01-01 00:00:00", 6, "failed", "x"),
        (4, "2024-01-03 00:00:00", 7, "queued", None),
    ]
    events = spark.createDataFrame(rows, "job_id bigint, ts string, event_id bigint, status string, error string")
    events = events.withColumn("ts", F.to_timestamp("ts"))
    state = {r["job_id"]: (r["status"], r["progress"], r["has_result"], r["error"]) for r in jobs.job_state(events).collect()}
    assert state == {
        1: ("completed", 1.0, True, None), 2: ("failed", 0.1, False, "bad"),
        3: ("queued", 0.0, False, None), 4: ("queued", 0.0, False, None),
    }
    kept = jobs.job_retention(events, F.lit("2024-01-03 00:00:00").cast("timestamp"))
    assert {r["job_id"] for r in kept.collect()} == {2, 3, 4}
    assert jobs.job_lookup(events, 9).count() == 0
    notes = {r["job_id"]: json.loads(r["notice"]) for r in jobs.job_notices(events).collect()}
    assert notes[1] == {"job_id": "1", "status": "completed", "correlation_id": "1", "result": {"status": "ok"}, "error": None}
    assert notes[2]["error"] == "bad" and notes[2]["result"] is None and set(notes) == {1, 2}
    assert HeaderMapping().pairs == {}
