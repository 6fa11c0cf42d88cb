"""Choice per company, ledger, statistics, running totals, and their plans."""

import json

import pytest
from pyspark.sql import functions as F

from checks import queries as Q
from checks.leads import raw_leads
from leadloom.operators import cleaning, dedup, report
from leadloom.operators.running import running_total_before
from leadloom.plans.pipeline import CleanOptions, clean, clean_leads
from leadloom.schema import TARGET
from leadloom.sources import sinks
from leadloom.sources.scratch import materialize

SCHEMA = "row_index bigint, " + ", ".join(f"{c} string" for c in TARGET)


def contact(i, company="", email="", title="", linkedin="", first="A"):
    return (i, first, "", company, email, "", title, linkedin, "", "", "")


@pytest.fixture(scope="module")
def contacts(spark):
    """A third of all rows belongs to one company, a third has none."""
    rows = [contact(i, "Hot", "a@b.co" if i % 7 == 3 else "", "CEO" if i % 11 == 10 else "") for i in range(0, 3000)]
    rows += [contact(i) for i in range(3000, 6000)]
    rows += [contact(i, f"C{i % 800}", "x@y.zz" if i % 3 else "") for i in range(6000, 9000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def expected_kept(rows):
    best = {}
    for r in rows:
        key = r["company_name"].strip().lower() or r["row_index"]
        score = 100 * ("@" in r["email"] and "." in r["email"]) + 50 * bool(r["linkedin_url"])
        score += 30 * ("ceo" in r["job_title"].lower()) + sum(bool(r[c]) for c in TARGET)
        if key not in best or (-score, r["row_index"]) < best[key]:
            best[key] = (-score, r["row_index"])
    return {i for _, i in best.values()}


def test_kept_and_dropped_split_the_rows(spark, contacts):
    want = expected_kept(contacts.collect())
    kept = [r["row_index"] for r in dedup.best_contact_per_company(contacts).select("row_index").collect()]
    dropped = [r["row_index"] for r in dedup.drops_duplicate(contacts).collect()]
    assert len(kept) == len(want) and set(kept) == want
    assert sorted(kept + dropped) == list(range(9000))
    details = dedup.drops_duplicate(contacts).where("row_index = 0").first()
    assert details["details"] == "Duplicate contact for company: hot"
    groups = dedup.company_groups(contacts)
    assert groups.agg(F.sum("contacts")).first()[0] == 6000
    chosen = {r["kept_row_index"] for r in groups.collect()}
    assert chosen == {i for i in want if not 3000 <= i < 6000}


def test_result_does_not_depend_on_partitions(spark, contacts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        df = dedup.best_contact_per_company(contacts.repartition(n))
        results.append(sorted(r["row_index"] for r in df.select("row_index").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_choice_inside_each_file(spark):
    rows = [(f, *contact(i, "Acme", "a@b.co" if i == 1 else "")) for f in ("x", "y") for i in range(3)]
    df = spark.createDataFrame(rows, "source_file string, " + SCHEMA)
    kept = dedup.best_contact_per_company(df).select("source_file", "row_index").collect()
    assert sorted(map(tuple, kept)) == [("x", 1), ("y", 1)]
    assert dedup.drops_duplicate(df).count() == 4


def test_row_positions_out_of_range_are_refused(spark):
    df = spark.createDataFrame([contact(1 << 54, "A")], SCHEMA)
    with pytest.raises(Exception, match="row_index must lie"):
        dedup.company_groups(df).collect()


def test_output_order(spark):
    rows = [contact(0), contact(1, "b"), contact(2, "A"), contact(3), contact(4, "Ä")]
    df = dedup.output_order(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert [r["row_index"] for r in df.collect()] == [2, 1, 4, 0, 3]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    best = Q.queries()["clean_leads_dedup"](spark, sf_dir)
    text = plan(best)
    assert text.count("WindowGroupLimit") == 2
    for name in ("clean_leads_dedup", "drops", "stats", "clean_feeds", "column_profile"):
        text = plan(Q.queries()[name](spark, sf_dir))
        for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in text, (name, node)
    # Only the columns asked for are scanned.
    text = plan(Q.queries()["normalize_email"](spark, sf_dir))
    assert "o_custkey" not in text and "documents" not in text


def test_ledger_invariants(spark, sf_dir):
    rows = raw_leads(spark, sf_dir)
    result = clean(rows, Q.MAPPING, CleanOptions(one_contact_per_company=True, source_label="S"))
    kept = {r["row_index"] for r in result.clean.select("row_index").collect()}
    dropped = [r["row_index"] for r in result.drops.collect()]
    stats = result.stats.first()
    assert kept.isdisjoint(dropped) and len(kept) + len(dropped) == rows.count()
    assert (stats["total_rows"], stats["output_rows"], stats["dropped_rows"]) == (
        rows.count(), len(kept), len(dropped),
    )
    again = cleaning.normalize_fields(result.clean)
    once = result.clean.select(again.columns)
    fields = [c for c in again.columns if c != "company_summary"]
    assert again.select(fields).exceptAll(once.select(fields)).isEmpty()


def test_label_does_not_rescue_empty_rows(spark):
    df = spark.createDataFrame([(0, " ", "x"), (1, "a", None)], "row_index bigint, h string, other string")
    from leadloom.operators.mapping import HeaderMapping

    out = clean_leads(df, HeaderMapping({"h": "last_name"}), CleanOptions(source_label="L")).collect()
    assert [(r["row_index"], r["last_name"], r["sources"]) for r in out] == [(1, "A", "L")]


def test_stats_of_no_output(spark, contacts):
    none = contacts.where("false")
    row = report.stats(none, contacts).first().asDict()
    assert row == {
        "valid_email_ratio": 0.0, "linkedin_ratio": 0.0, "phone_ratio": 0.0, "company_ratio": 0.0,
        "total_rows": 9000, "output_rows": 0, "dropped_rows": 9000,
    }


@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_total(spark, by):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 13).alias("v"))
    got = running_total_before(df.repartition(7), "v", "i", "t", by, block_rows=64).collect()
    totals = {}
    for r in sorted(got, key=lambda r: r["i"]):
        key = r["g"] if by else 0
        assert r["t"] == totals.get(key, 0)
        totals[key] = totals.get(key, 0) + r["v"]
    assert len(got) == 1000


def test_envelopes_hold_every_row_once(spark, sf_dir):
    clean_rows = Q._full(spark, sf_dir, True)
    envelopes = sinks.lead_envelopes(clean_rows, Q._report(spark, sf_dir), "id-1", limit_bytes=200_000)
    docs = [json.loads(r["envelope"]) for r in envelopes.collect()]
    assert len(docs) > 8
    assert sum(len(d["leads"]) for d in docs) == clean_rows.count()
    for d in docs:
        assert d["status"] == "success" and d["correlation_id"] == "id-1"
        assert d["row_count"] == len(d["leads"]) and list(d["leads"][0]) == list(TARGET)
        assert len(d["csv_data"].encode()) < 200_000 + 20_000
        assert d["header_mapping"]["mapped"]["fname"] == "first_name"
        assert d["report"]["drops"] and d["report"]["stats"]["total_rows"] > 0


def test_materialized_tables_go_to_the_shared_folder(spark):
    df = materialize(spark.range(3), "t")
    assert spark.conf.get("spark.checkpoint.dir").removeprefix("file:") in df.inputFiles()[0]
