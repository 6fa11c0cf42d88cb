"""A run from contact files to clean files, ledger and reports."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from leadloom.operators.cleaning import non_empty_rows, normalize_fields
from leadloom.operators.mapping import (
    HeaderMapping,
    apply_mapping_table,
    cell_positions,
    feed_profile,
    mapping_for,
    mapping_of_files,
    mapping_table,
    parse_replies,
    propose_mapping,
    unmapped_by,
    unmapped_headers,
    validate_mapping,
    proposals,
)
from leadloom.operators.report import drops, input_info, report, report_drops, stats
from leadloom.plans.pipeline import CleanOptions, finish
from leadloom.schema import DETAILS_UNMAPPED, REASON_UNMAPPED, ROW_INDEX, SOURCE_FILE
from leadloom.sources.feeds import Feeds, read_feeds
from leadloom.sources.scratch import materialize
from leadloom.sources.sinks import write_clean_csv, write_report


@dataclass(frozen=True)
class RunPaths:
    """Where a run left its output."""

    clean: str
    rows: str
    drops: str
    report: str
    metrics: str
    rejects: str
    report_drops: str
    unread: str


class _Phases:
    """Milliseconds and row counts per phase."""

    def __init__(self) -> None:
        self.started = self.mark = time.monotonic()
        self.ms: dict[str, int] = {}

    def end(self, phase: str) -> None:
        now = time.monotonic()
        self.ms[phase] = int((now - self.mark) * 1000)
        self.mark = now

    def all(self) -> dict[str, int]:
        return {**self.ms, "total": int((time.monotonic() - self.started) * 1000)}


def _why_unmapped(unmapped: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Ledger rows of files without a mapping; a reply that could not be read says why."""
    if replies is None:
        details = F.lit(DETAILS_UNMAPPED)
    else:
        bad = replies.where("reason IS NOT NULL").select(SOURCE_FILE, F.col("reason").alias("why"))
        unmapped = unmapped.join(bad, SOURCE_FILE, "left")
        details = F.concat_ws(": ", F.lit(DETAILS_UNMAPPED), "why")
    return unmapped.select(SOURCE_FILE, ROW_INDEX, F.lit(REASON_UNMAPPED).alias("reason"), details.alias("details"))


def _written(df: DataFrame, path: str, mode: str) -> DataFrame:
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _outputs(
    spark: SparkSession,
    normalized: DataFrame,
    feeds: Feeds,
    mapped: DataFrame,
    replies: DataFrame | None,
    mapping: HeaderMapping | DataFrame,
    options: CleanOptions,
    output: str,
    phases: _Phases,
    correlation_id: str,
    ordered: bool,
    mode: str,
) -> RunPaths:
    paths = RunPaths(*(f"{output}/{p}" for p in ("clean", "rows", "drops", "report", "metrics", "rejects", "report_drops", "unread")))
    # Regular expressions run once; every output below starts from this table.
    # Rows are counted while they are written.
    seen = {phase: Observation(phase) for phase in ("normalize", "write")}
    landed = materialize(normalized.observe(seen["normalize"], F.count(F.lit(1)).alias("rows")), "normalized")
    phases.end("normalize")
    clean = _written(
        finish(non_empty_rows(landed), options).observe(seen["write"], F.count(F.lit(1)).alias("rows")), paths.rows, mode
    )
    write_clean_csv(clean, paths.clean, ordered, mode)
    rejects = _written(feeds.rejects, paths.rejects, mode)
    feeds.unread.write.mode(mode).parquet(paths.unread)
    # Every row of every file is in the output, dropped, without a mapping or a reject.
    unmapped = materialize(
        feeds.rows.select(SOURCE_FILE, ROW_INDEX).join(
            mapped.select(SOURCE_FILE).distinct(), SOURCE_FILE, "left_anti"
        ), "unmapped_rows",
    )
    ledger = (
        drops(landed, options.one_contact_per_company, options.word_match)
        .unionByName(rejects.drop("record"))
        .unionByName(
            _why_unmapped(unmapped, replies)
        )
    )
    ledger = _written(ledger, paths.drops, mode)
    phases.end("write")
    report_drops(ledger).write.mode(mode).parquet(paths.report_drops)
    source = landed.select(SOURCE_FILE).union(unmapped.select(SOURCE_FILE)).union(rejects.select(SOURCE_FILE))
    files = feeds.headers.select(SOURCE_FILE).union(rejects.select(SOURCE_FILE)).distinct()
    reports = report(
        input_info(source, files),
        stats(clean, source, [SOURCE_FILE], files),
        ledger,
        mapping,
        phases.all(),
        correlation_id=correlation_id,
    )
    write_report(reports, paths.report, mode)
    counts = {phase: observed.get["rows"] for phase, observed in seen.items()}
    metrics = [
        (correlation_id, phase, ms, counts.get(phase)) for phase, ms in phases.all().items()
    ]
    spark.createDataFrame(
        metrics, "correlation_id string, phase string, ms bigint, rows bigint"
    ).coalesce(1).write.mode(mode).parquet(paths.metrics)
    return paths


def run(
    spark: SparkSession,
    inputs: str | Sequence[str],
    output: str,
    mapping: HeaderMapping | None = None,
    options: CleanOptions = CleanOptions(),
    correlation_id: str = "",
    ordered: bool = True,
    overwrite: bool = False,
) -> RunPaths:
    """Clean files of any headers.

    Rows that cannot be read are in the rejects, with their raw text, and in the ledger; a
    file that cannot be read counts as one row, its lines are in ``unread``.
    ``mapping`` holds for every file; without one, each file gets its own, proposed from its
    headers and cells.
    ``ordered=False`` spares very large outputs the sort of the whole table; ``overwrite``
    replaces what an earlier run left in ``output``.
    """
    phases = _Phases()
    feeds = read_feeds(spark, inputs, land=True)
    headers = materialize(feeds.headers, "feed_headers")
    phases.end("download")
    if mapping is None:
        table = propose_mapping(feed_profile(feeds.rows, headers))
    else:
        table = mapping_for(mapping, headers)
    table = materialize(table, "mapping")
    left = unmapped_by(table, headers)
    return _mapped_run(
        spark, feeds, headers, table, left, mapping, None, options, output, phases, correlation_id, ordered,
        "overwrite" if overwrite else "error",
    )


def _mapped_run(
    spark: SparkSession,
    feeds: Feeds,
    headers: DataFrame,
    table: DataFrame,
    left: DataFrame,
    mapping: HeaderMapping | None,
    replies: DataFrame | None,
    options: CleanOptions,
    output: str,
    phases: _Phases,
    correlation_id: str,
    ordered: bool,
    mode: str,
) -> RunPaths:
    """The run from a ``mapping_table`` on; cells are taken by position, whatever headers are called."""
    table = _written(table, f"{output}/mapping", mode)
    left = _written(left, f"{output}/unmapped", mode)
    phases.end("llm")
    positions = materialize(cell_positions(headers, table), "positions")
    rows = apply_mapping_table(feeds.rows, positions, options.strict_titles)
    return _outputs(
        spark, normalize_fields(rows, options.allow_schemeless), feeds, positions, replies,
        mapping if mapping is not None else mapping_of_files(table, left), options, output, phases,
        correlation_id, ordered, mode,
    )


def run_feeds(
    spark: SparkSession,
    inputs: str | Sequence[str],
    replies: DataFrame,
    output: str,
    options: CleanOptions = CleanOptions(),
    correlation_id: str = "",
    ordered: bool = True,
) -> tuple[RunPaths, Feeds]:
    """Clean files with different headers, each mapped by its reply."""
    phases = _Phases()
    feeds = read_feeds(spark, inputs, land=True)
    headers = materialize(feeds.headers, "feed_headers")
    phases.end("download")
    parsed = materialize(parse_replies(replies), "parsed_replies")
    table = materialize(mapping_table(parsed, headers), "mapping")
    left = unmapped_headers(parsed, headers, validate_mapping(proposals(parsed), headers))
    paths = _mapped_run(
        spark, feeds, headers, table, left, None, parsed, options, output, phases, correlation_id, ordered, "error"
    )
    return paths, feeds
