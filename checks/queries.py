"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import leads as fixture
from checks.leads import DIRECT, RAW_COLUMNS, raw_leads, table
from leadloom import functions as L
from leadloom.operators import cleaning, dedup, extract, jobs, mapping as maps, report as reports
from leadloom.operators.mapping import HeaderMapping
from leadloom.plans.pipeline import CleanOptions, chosen_rows, clean, clean_leads, filled_rows, finish, row_scores
from leadloom.plans.run import RunPaths, run
from leadloom.schema import SOURCE_FILE, TARGET
from leadloom.sources import feeds, sinks
from leadloom.sources.scratch import materialize, new_path
from leadloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

MAPPING = HeaderMapping(DIRECT, unmapped=["full_name"])
SPLIT_MAPPING = HeaderMapping(
    {h: t for h, t in DIRECT.items() if t not in ("first_name", "last_name")},
    splits=["full_name"],
    unmapped=["fname", "lname", "full_name"],
)
DEDUP = CleanOptions(one_contact_per_company=True)
LABELLED = CleanOptions(one_contact_per_company=True, source_label="Trade Fair")
_DATA_COLUMNS = tuple(DIRECT)


def _mapped(spark, sf_dir) -> DataFrame:
    return maps.apply_mapping(raw_leads(spark, sf_dir, _DATA_COLUMNS), MAPPING)


def _full(spark, sf_dir, source_file=False) -> DataFrame:
    rows = raw_leads(spark, sf_dir, _DATA_COLUMNS, source_file)
    return filled_rows(rows, MAPPING, CleanOptions())


def _chosen(spark, sf_dir, of: str = "true") -> tuple[DataFrame, dedup.Choice]:
    """Rows that may be the best contacts, chosen by their scores, and the choice."""
    rows = raw_leads(spark, sf_dir, _DATA_COLUMNS)
    choice = dedup.choose(row_scores(rows, MAPPING, CleanOptions()).where(of))
    some = raw_leads(spark, sf_dir, _DATA_COLUMNS, choice=choice)
    return chosen_rows(some, MAPPING, CleanOptions(), choice), choice


def best_contact_per_company(spark, sf_dir):
    rows, choice = _chosen(spark, sf_dir)
    return dedup.best_contact_per_company(rows, choice=choice)


def _clean(options: CleanOptions, mapping=MAPPING) -> Query:
    return lambda spark, sf_dir: clean_leads(
        raw_leads(spark, sf_dir), mapping, options, lambda choice: raw_leads(spark, sf_dir, choice=choice)
    )


def _field(column: str, function, out: str) -> Query:
    def query(spark, sf_dir):
        rows = raw_leads(spark, sf_dir, (column,))
        return rows.select("row_index", function(F.col(column)).alias(out))

    return query


# -- sources and sinks -----------------------------------------------------


def csv_roundtrip(spark, sf_dir):
    """Clean table written as CSV files and read back from them."""
    path = new_path(spark, "clean_csv")
    kept = _clean(DEDUP)(spark, sf_dir)
    kept.select(F.col("row_index").alias("lead_no"), *TARGET).write.options(**sinks.LANDED_CSV).csv(path)
    back = feeds.read_table(spark, path)
    # The scan rule makes empty cells null; the clean table has empty texts.
    return back.select(
        F.col("lead_no").cast("bigint").alias("row_index"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in TARGET),
    )


def csv_feeds(spark, sf_dir):
    """Raw contacts with line breaks in cells, landed as CSV and scanned."""
    path = new_path(spark, "raw_csv")
    rows = raw_leads(spark, sf_dir).withColumnRenamed("row_index", "lead_no")
    rows.write.options(**sinks.LANDED_CSV).csv(path)
    back = feeds.read_table(spark, path)
    return back.select(F.col("lead_no").cast("bigint").alias("row_index"), *RAW_COLUMNS)


def _noted(spark, sf_dir, *columns) -> DataFrame:
    rows = raw_leads(spark, sf_dir, columns, True)
    return rows.withColumn("note", F.expr(fixture.NOTE_SQL))


def _file_name() -> Column:
    return F.regexp_extract(SOURCE_FILE, "folder=([^/]+)/", 1)


def csv_line_ends(spark, sf_dir):
    """Files that end their lines with LF, CR, CRLF or all of them, and break lines in cells."""
    path = new_path(spark, "line_ends")
    columns = ("lead_no", "note", "email", "company")
    rows = _noted(spark, sf_dir, "email", "company").withColumn("lead_no", F.col("row_index").cast("string"))
    fixture.write_lines(rows, {f: ",".join(columns) for f in fixture.LINE_ENDS}, columns, path, fixture.LINE_ENDS)
    back = feeds.read_table(spark, path)
    return back.select(
        _file_name().alias("file"), F.col("lead_no").cast("bigint").alias("lead_no"), "note", "email", "company"
    )


def _odd_files(spark, sf_dir) -> feeds.Feeds:
    path = new_path(spark, "odd_headers")
    rows = _noted(spark, sf_dir, *fixture.ODD_CELLS)
    fixture.write_lines(rows, fixture.ODD_HEADERS, fixture.ODD_CELLS, path)
    return feeds.read_feeds(spark, path)


def odd_headers(spark, sf_dir):
    """Headers with any characters, equal but for case, or named like columns of ours."""
    headers = _odd_files(spark, sf_dir).headers
    return headers.select(_file_name().alias("file"), "pos", "input_header")


def odd_headers_mapped(spark, sf_dir):
    """Cells under odd headers, mapped by exact header text."""
    read = _odd_files(spark, sf_dir)
    pairs = [(f, i, h, t) for f, names in fixture.ODD_NAMES.items() for i, (h, t) in enumerate(zip(names, fixture.ODD_TARGETS))]
    given = spark.createDataFrame(pairs, "file string, pos int, input_header string, target string")
    table = read.headers.select(SOURCE_FILE, _file_name().alias("file")).distinct().join(given, "file")
    positions = maps.cell_positions(read.headers, table.withColumn("kind", F.lit("direct")))
    rows = maps.apply_mapping_table(read.rows, materialize(positions, "positions"))
    return rows.select(_file_name().alias("file"), "row_index", *fixture.ODD_TARGETS)


def _language_files(spark, sf_dir) -> str:
    """Documents as CSV files per language, French ones in Latin-1."""
    path = new_path(spark, "languages")
    documents = fixture.documents(spark, sf_dir, "doc_id", "lang", "text")
    for part, encoding in ((F.col("lang") == "fr", "ISO-8859-1"), (F.col("lang") != "fr", "UTF-8")):
        documents.where(part).withColumn("folder", F.col("lang")).write.mode("append").partitionBy(
            "folder"
        ).options(**sinks.CSV_OPTIONS, encoding=encoding).csv(path)
    return path


def encoding_class(spark, sf_dir):
    lines = feeds.scan_lines(spark, _language_files(spark, sf_dir))
    return (
        feeds.encoding_class(lines)
        .select(F.regexp_extract(SOURCE_FILE, "folder=([^/]+)/", 1).alias("lang"), "encoding")
        .distinct()
    )


def encoding_fallback(spark, sf_dir):
    back = feeds.read_table(spark, _language_files(spark, sf_dir))
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")


def null_tokens(spark, sf_dir):
    rows = raw_leads(spark, sf_dir, ("phone", "title", "company"))
    return rows.select(
        "row_index",
        *(L.drop_null_tokens(F.col(c)).alias(c) for c in ("phone", "title", "company")),
    )


def row_index(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "_metadata")
    return feeds.with_row_index(spark, documents).select("doc_id", "row_index")


def lead_json(spark, sf_dir):
    leads = sinks.lead_json(_full(spark, sf_dir))
    schema = ", ".join(f"{c} string" for c in TARGET)
    return leads.select("row_index", F.from_json("lead", schema).alias("lead")).select(
        "row_index", "lead.*"
    )


def payload_batches(spark, sf_dir):
    return sinks.batch_plan(_full(spark, sf_dir, True))


def _report(spark, sf_dir) -> DataFrame:
    source = raw_leads(spark, sf_dir, _DATA_COLUMNS, True)
    result = clean(source, MAPPING, DEDUP, lambda choice: raw_leads(spark, sf_dir, _DATA_COLUMNS, True, choice))
    return reports.report(
        reports.input_info(raw_leads(spark, sf_dir, (), True)),
        reports.stats(result.clean, raw_leads(spark, sf_dir, (), True), [SOURCE_FILE]),
        result.drops,
        MAPPING,
    )


def _pairs(column: str) -> Column:
    """A map as text, by key."""
    entries = F.array_sort(F.map_entries(column))
    return F.concat_ws(",", F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))


def _flat(reports: DataFrame, file: Column) -> DataFrame:
    """All fields of reports but the times."""
    drops = F.transform("drops", lambda d: F.concat_ws(":", d["row_index"], d["reason"], d["details"]))
    return reports.select(
        file.alias(SOURCE_FILE), "input.rows", "input.file_type",
        _pairs("mapping").alias("mapping"),
        F.concat_ws(",", "unmapped_input_headers").alias("unmapped"),
        F.md5(F.concat_ws(",", drops).cast("binary")).alias("first_drops"),
        "drop_pages", _pairs("drop_counts").alias("drop_counts"), "stats.*", "version", "correlation_id", "error",
    )


def report(spark, sf_dir):
    """The nested report, every field of it."""
    return _flat(_report(spark, sf_dir), F.col(SOURCE_FILE))


def lead_envelope(spark, sf_dir):
    """Envelopes read back: all that each one holds but the time."""
    envelopes = sinks.lead_envelopes(_full(spark, sf_dir, True), _report(spark, sf_dir), "run-7")
    header = len(sinks.HEADER_LINE) + 1
    lead = ",".join(f"{c}:string" for c in TARGET)
    schema = (
        f"status string, source_file string, batch_id bigint, row_count bigint, leads array<struct<{lead}>>, csv_data string, "
        "header_mapping struct<mapped:map<string,string>,unmapped:array<string>>, "
        "report struct<stats:struct<output_rows:bigint>,drop_counts:map<string,bigint>>, correlation_id string"
    )
    read = envelopes.withColumn("e", F.from_json("envelope", schema))
    leads = F.transform("e.leads", lambda x: F.concat_ws("|", *(x[c] for c in TARGET)))
    return read.select(
        SOURCE_FILE,
        "batch_id",
        "row_count",
        (F.octet_length("e.csv_data") - header).cast("bigint").alias("csv_bytes"),
        F.md5(F.col("e.csv_data").cast("binary")).alias("csv_md5"),
        F.md5(F.array_join(leads, "\n").cast("binary")).alias("leads_md5"),
        F.col("e.status").alias("status"),
        (F.col("e.row_count") == F.col("row_count")).alias("same_count"),
        _pairs("e.header_mapping.mapped").alias("mapped"),
        F.concat_ws(",", "e.header_mapping.unmapped").alias("unmapped"),
        F.col("e.report.stats.output_rows").alias("output_rows"),
        _pairs("e.report.drop_counts").alias("drop_counts"),
        F.col("e.correlation_id").alias("correlation_id"),
    )


# -- whole runs ------------------------------------------------------------


def _run(spark, sf_dir) -> RunPaths:
    """Files of raw contacts, some rows too long, cleaned from files to files."""
    path = new_path(spark, "run_files")
    rows = raw_leads(spark, sf_dir, fixture.RUN_CELLS, True)
    headers = {f: ",".join(fixture.RUN_CELLS) for f in fixture.LINE_ENDS}
    fixture.write_lines(
        rows, headers, fixture.RUN_CELLS, path, tail=f"CASE WHEN {fixture.BAD_ROW_SQL} THEN ',more' ELSE '' END"
    )
    mapping = HeaderMapping({c: DIRECT[c] for c in fixture.RUN_CELLS if c != "src"})
    return run(spark, path, new_path(spark, "run"), mapping, DEDUP, "run-7", ordered=False)


def run_ledger(spark, sf_dir):
    ledger = spark.read.parquet(_run(spark, sf_dir).drops)
    return ledger.select(_file_name().alias("file"), "row_index", "reason", "details")


def run_report(spark, sf_dir):
    """Reports as they are in the JSON files."""
    written = spark.read.schema(reports.REPORT_DDL).json(_run(spark, sf_dir).report)
    return _flat(written, _file_name())


def run_metrics(spark, sf_dir):
    """Rows counted while they were written."""
    return spark.read.parquet(_run(spark, sf_dir).metrics).where("rows IS NOT NULL").select("phase", "rows")


# -- header mapping --------------------------------------------------------


def _parsed(spark, sf_dir) -> DataFrame:
    return maps.parse_replies(fixture.feeds(spark, sf_dir))


def mapping_validate(spark, sf_dir):
    proposed = maps.proposals(_parsed(spark, sf_dir))
    return maps.validate_mapping(proposed, fixture.feed_headers(spark, sf_dir))


def mapping_unmapped(spark, sf_dir):
    return maps.unmapped_headers(
        _parsed(spark, sf_dir),
        fixture.feed_headers(spark, sf_dir),
        mapping_validate(spark, sf_dir),
    )


def _positions(spark, sf_dir) -> DataFrame:
    headers = fixture.feed_headers(spark, sf_dir)
    return materialize(
        maps.cell_positions(headers, maps.mapping_table(_parsed(spark, sf_dir), headers)),
        "positions",
    )


def _mapped_feeds(spark, sf_dir, positions: DataFrame, choice: dedup.Choice | None = None) -> DataFrame:
    """Rows get the positions of their file before the texts are joined to them."""
    return maps.apply_mapping_table(fixture.feed_cells(spark, sf_dir, positions, choice))


def apply_feed_mapping(spark, sf_dir):
    return _mapped_feeds(spark, sf_dir, _positions(spark, sf_dir))


def clean_feeds(spark, sf_dir):
    """Feeds with different headers, each mapped by its own reply, cleaned in one job."""
    positions = _positions(spark, sf_dir)
    choice = dedup.choose(dedup.contact_scores(_mapped_feeds(spark, sf_dir, positions)))
    candidates = _mapped_feeds(spark, sf_dir, positions, choice)
    filled = candidates if choice.exact else cleaning.filled_rows(candidates)
    return finish(cleaning.normalize_fields(filled), DEDUP, choice)


def column_profile(spark, sf_dir):
    return maps.column_profile(raw_leads(spark, sf_dir), RAW_COLUMNS, distinct=False)


def _feed_profile(spark, sf_dir) -> DataFrame:
    return maps.feed_profile(fixture.feed_cells(spark, sf_dir), fixture.feed_headers(spark, sf_dir))


def feed_profile(spark, sf_dir):
    """What each column of each feed looks like; the estimate of distinct cells is tested apart."""
    return _feed_profile(spark, sf_dir).drop("sketch", "distinct")


def propose_feed_mapping(spark, sf_dir):
    """A mapping for each feed, from its own headers and cells."""
    return maps.propose_mapping(materialize(_feed_profile(spark, sf_dir), "profile"))


# -- scalar functions that need two columns --------------------------------


def split_names(spark, sf_dir):
    rows = raw_leads(spark, sf_dir, ("full_name",))
    name = L.split_names(F.col("full_name"))
    return rows.select(
        "row_index", name["first"].alias("first_name"), name["last"].alias("last_name")
    )


def split_full_names(spark, sf_dir):
    rows = raw_leads(spark, sf_dir, ("fname", "lname"))
    name = L.split_full_names(
        L.normalize_name(F.col("fname")), L.normalize_name(F.col("lname"))
    )
    return rows.select(
        "row_index", name["first"].alias("first_name"), name["last"].alias("last_name")
    )


def source_label(spark, sf_dir):
    return cleaning.add_source_label(_full(spark, sf_dir), "Trade Fair")


def company_from_email(spark, sf_dir):
    rows = raw_leads(spark, sf_dir, ("company", "email"))
    company, address = L.normalize_company(F.col("company")), L.normalize_email(F.col("email"))
    return rows.select("row_index", L.company_from_email(company, address).alias("company_name"))


# -- one contact per company -----------------------------------------------


def company_groups(spark, sf_dir):
    return dedup.company_groups(_full(spark, sf_dir)).select(
        "company_key", "contacts", "first_row_index", "last_row_index"
    )


def best_contact_agg(spark, sf_dir):
    return dedup.company_groups(_full(spark, sf_dir)).select(
        "company_key", "kept_row_index", "priority_score"
    )


def concat_leads(spark, sf_dir):
    """Kept contacts and contacts without a company, put together."""
    rows = _full(spark, sf_dir)
    some, choice = _chosen(spark, sf_dir, "company_key != ''")
    kept = dedup.best_contact_per_company(dedup.with_company(some), choice=choice)
    return kept.select("row_index", *TARGET).unionByName(
        dedup.without_company(rows).select("row_index", *TARGET)
    )


# -- statistics ------------------------------------------------------------


def stats(spark, sf_dir):
    return reports.stats(_clean(DEDUP)(spark, sf_dir), raw_leads(spark, sf_dir, ()))


def drops(spark, sf_dir):
    return clean(raw_leads(spark, sf_dir, _DATA_COLUMNS), MAPPING, DEDUP).drops


# -- run ledger ------------------------------------------------------------


def job_retention(spark, sf_dir):
    events = fixture.job_events(spark, sf_dir)
    # One timestamp: the time the clean-up runs at.
    as_of = events.agg(F.max("ts").alias("as_of")).first()["as_of"]
    return jobs.job_retention(events, F.lit(as_of).cast(events.schema["ts"].dataType))


def job_notices(spark, sf_dir):
    schema = (
        "job_id string, status string, correlation_id string, "
        "result struct<status string>, error string"
    )
    notices = jobs.job_notices(fixture.job_events(spark, sf_dir))
    return notices.select("job_id", F.from_json("notice", schema).alias("n")).select(
        "job_id",
        F.col("n.job_id").alias("notice_job_id"),
        "n.status",
        "n.correlation_id",
        F.col("n.result.status").alias("result_status"),
        "n.error",
    )


# -- streams ---------------------------------------------------------------


def _drop_folder(spark, sf_dir) -> DataFrame:
    """Raw contacts landed as CSV files, read as a stream."""
    path = new_path(spark, "drop_folder")
    raw_leads(spark, sf_dir).write.options(**sinks.LANDED_CSV).csv(path)
    return streams.read_drop_folder(spark, path, ["row_index", *RAW_COLUMNS])


def stream_clean(spark, sf_dir):
    output = new_path(spark, "stream_clean")
    streams.stream_clean(
        _drop_folder(spark, sf_dir), MAPPING, output, output + "_state"
    ).awaitTermination()
    return spark.read.parquet(output)


def stream_best_contact(spark, sf_dir):
    output = new_path(spark, "stream_best")
    for query in streams.stream_best_contact(
        _drop_folder(spark, sf_dir), MAPPING, output, output + "_state"
    ):
        query.awaitTermination()
    return streams.current_best(spark, output)


def stream_job_state(spark, sf_dir):
    output = new_path(spark, "stream_jobs")
    events = (
        spark.readStream.schema(table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    streams.stream_job_state(
        fixture.as_job_events(events), output, output + "_state"
    ).awaitTermination()
    return streams.current_state(spark, output)


def stream_feeds(spark, sf_dir):
    """Files of odd headers as they arrive, two in a micro-batch, cleaned by the batch rules."""
    path, output = new_path(spark, "arrivals"), new_path(spark, "stream_feeds")
    fixture.write_lines(_noted(spark, sf_dir, *fixture.ODD_CELLS), fixture.ODD_HEADERS, fixture.ODD_CELLS, path)
    pairs = {h: t for names in fixture.ODD_NAMES.values() for h, t in zip(names, fixture.ODD_TARGETS)}
    arrivals = streams.read_arrivals(spark, path, max_files=2)
    streams.stream_feeds(arrivals, output, output + "_state", HeaderMapping(pairs)).awaitTermination()
    rows = streams.arrived(spark, output)
    return rows.select(_file_name().alias("file"), "row_index", *TARGET)


def stream_drops(spark, sf_dir):
    output = new_path(spark, "stream_drops")
    for query in streams.stream_drops(_drop_folder(spark, sf_dir), MAPPING, output, output + "_state"):
        query.awaitTermination()
    return streams.current_drops(spark, output)


def stream_drops_duplicate(spark, sf_dir):
    return stream_drops(spark, sf_dir).where("reason = 'duplicate_contact'")


def stream_job_retention(spark, sf_dir):
    output = new_path(spark, "stream_retention")
    events = (
        spark.readStream.schema(table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    streams.stream_job_retention(fixture.as_job_events(events), output, output + "_state").awaitTermination()
    return streams.kept_jobs(spark, output)


def queries() -> dict[str, Query]:
    return {
        # sources and sinks
        "csv_roundtrip": csv_roundtrip,
        "csv_feeds": csv_feeds,
        "csv_line_ends": csv_line_ends,
        "odd_headers": odd_headers,
        "odd_headers_mapped": odd_headers_mapped,
        "encoding_class": encoding_class,
        "encoding_fallback": encoding_fallback,
        "null_tokens": null_tokens,
        "row_index": row_index,
        "feed_headers": fixture.feed_headers,
        "lead_json": lead_json,
        "payload_size": lambda s, d: sinks.payload_size(_full(s, d, True), [SOURCE_FILE]),
        "payload_batches": payload_batches,
        "lead_envelope": lead_envelope,
        "csv_preview": lambda s, d: sinks.csv_preview(_full(s, d)),
        "sample_rows": lambda s, d: sinks.sample_rows(raw_leads(s, d, source_file=True)),
        "input_info": lambda s, d: reports.input_info(raw_leads(s, d, (), True)),
        # header mapping
        "mapping_parse": lambda s, d: maps.proposals(_parsed(s, d)),
        "mapping_rejects": lambda s, d: _parsed(s, d)
        .where("reason IS NOT NULL")
        .select(SOURCE_FILE, "reason"),
        "mapping_validate": mapping_validate,
        "mapping_split": lambda s, d: maps.split_marks(
            _parsed(s, d), fixture.feed_headers(s, d)
        ),
        "mapping_unmapped": mapping_unmapped,
        "apply_mapping": lambda s, d: maps.apply_mapping(raw_leads(s, d), MAPPING),
        "apply_split_mapping": lambda s, d: maps.apply_mapping(raw_leads(s, d), SPLIT_MAPPING),
        "apply_feed_mapping": apply_feed_mapping,
        "clean_feeds": clean_feeds,
        "column_profile": column_profile,
        "propose_mapping": lambda s, d: maps.propose_mapping(column_profile(s, d)),
        "feed_profile": feed_profile,
        "propose_feed_mapping": propose_feed_mapping,
        # scalar functions
        "strip_blank": _field("title", L.strip, "title"),
        "normalize_name": _field("fname", L.normalize_name, "first_name"),
        "split_full_names": split_full_names,
        "normalize_company": _field("company", L.normalize_company, "company_name"),
        "normalize_email": _field("email", L.normalize_email, "email"),
        "normalize_phone": _field("phone", L.normalize_phone, "phone_number"),
        "normalize_job_title": _field("title", L.normalize_job_title, "job_title"),
        "normalize_linkedin": _field("linkedin", L.normalize_linkedin_url, "linkedin_url"),
        "normalize_website": _field("site", L.normalize_website, "website"),
        "website_pages": lambda s, d: table(s, d, "pages").select(
            "page_id", L.normalize_website(F.col("url")).alias("website")
        ),
        "normalize_summary": _field("about", L.normalize_summary, "company_summary"),
        "summary_documents": lambda s, d: fixture.documents(s, d, "doc_id", "text").select(
            "doc_id", L.normalize_summary(F.col("text")).alias("company_summary")
        ),
        "normalize_sources": _field("src", L.normalize_sources, "sources"),
        "split_names": split_names,
        "clean_name_part": _field("full_name", L.clean_name_part, "name_part"),
        "source_label": source_label,
        "company_from_email": company_from_email,
        "extract_contacts": lambda s, d: extract.extract_contacts(
            fixture.documents(s, d, "doc_id", "text"), "doc_id", "text"
        ),
        # filters
        "non_empty_rows": _full,
        "drops_empty": lambda s, d: cleaning.drops_unfilled(_mapped(s, d)),
        "no_company_rows": lambda s, d: dedup.without_company(_full(s, d)),
        # one contact per company
        "company_key": lambda s, d: dedup.with_company_key(_full(s, d)).select(
            "row_index", "company_key"
        ),
        "priority_score": lambda s, d: dedup.with_priority(_full(s, d)).select(
            "row_index", "priority_score"
        ),
        "best_contact_per_company": best_contact_per_company,
        "best_contact_agg": best_contact_agg,
        "company_groups": company_groups,
        "company_members": lambda s, d: dedup.company_members(_full(s, d)),
        "drops_duplicate": lambda s, d: dedup.drops_duplicate(_full(s, d)),
        # order and set operations
        "clean_leads_ordered": lambda s, d: dedup.output_order(_clean(DEDUP)(s, d)),
        "concat_leads": concat_leads,
        "drops": drops,
        # statistics and whole runs
        "stats": stats,
        "drop_counts": lambda s, d: reports.drop_counts(drops(s, d)),
        "parse_summary": lambda s, d: reports.parse_summary(stats(s, d)),
        "report": report,
        "clean_leads": _clean(CleanOptions()),
        "clean_leads_split": _clean(CleanOptions(), SPLIT_MAPPING),
        "clean_leads_dedup": _clean(DEDUP),
        "clean_leads_labelled": _clean(LABELLED),
        "run_ledger": run_ledger,
        "run_report": run_report,
        "run_metrics": run_metrics,
        # run ledger
        "job_state": lambda s, d: jobs.job_state(fixture.job_events(s, d)),
        "job_lookup": lambda s, d: jobs.job_lookup(fixture.job_events(s, d), 7),
        "job_list": lambda s, d: jobs.job_list(fixture.job_events(s, d)),
        "job_totals": lambda s, d: jobs.job_totals(fixture.job_events(s, d)),
        "job_retention": job_retention,
        "job_notices": job_notices,
        # streams
        "stream_clean": stream_clean,
        "stream_best_contact": stream_best_contact,
        "stream_job_state": stream_job_state,
        "stream_feeds": stream_feeds,
        "stream_drops": stream_drops,
        "stream_drops_duplicate": stream_drops_duplicate,
        "stream_job_retention": stream_job_retention,
    }
