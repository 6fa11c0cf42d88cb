"""Clean tables, reports, samples and message payloads."""

from __future__ import annotations

from collections.abc import Sequence


from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.operators.dedup import output_order
from leadloom.operators.running import BLOCK_ROWS, running_total_before
from leadloom.schema import (
    PAYLOAD_LIMIT_BYTES,
    PREVIEW_LENGTH,
    ROW_INDEX,
    SAMPLE_ROWS,
    SOURCE_FILE,
    TARGET,
)
from leadloom.sources.scratch import materialize, rows_with

#: Options that write cells the way common CSV readers expect them back.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

#: The same for large tables that Spark reads again: compressed files, each small enough for one task.
LANDED_CSV = CSV_OPTIONS | {"compression": "gzip", "maxRecordsPerFile": "50000"}

HEADER_LINE = ",".join(TARGET)


def write_clean_csv(clean: DataFrame, path: str, ordered: bool = True, mode: str = "error") -> None:
    """The ten columns as CSV files; ``ordered`` sorts the whole table first."""
    table = output_order(clean) if ordered else clean
    table.select(*TARGET).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    report.write.mode(mode).json(path)


def csv_line(columns: Sequence[str] = TARGET, of: Column | None = None) -> Column:
    """A row (or the struct ``of``) as CSV text, cells quoted only where they have to be."""

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(name) if of is None else of[name], F.lit(""))
        return F.when(
            text.rlike('[,"\r\n]'),
            F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')),
        ).otherwise(text)

    return F.concat_ws(",", *(cell(c) for c in columns))


def payload_size(clean: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Size of the CSV text, and whether it is beyond what receivers take."""
    size = F.sum(F.octet_length(csv_line()) + 1) + len(HEADER_LINE) + 1
    return (
        clean.groupBy(*by)
        .agg(F.count("*").alias("rows"), F.coalesce(size, F.lit(len(HEADER_LINE) + 1)).alias("csv_bytes"))
        .select(
            *by,
            "rows",
            F.col("csv_bytes").cast("bigint").alias("csv_bytes"),
            (F.col("csv_bytes") / (1024 * 1024)).alias("csv_mb"),
            (F.col("csv_bytes") > PAYLOAD_LIMIT_BYTES).alias("over_limit"),
        )
    )


def batch_plan(
    clean: DataFrame, limit_bytes: int = PAYLOAD_LIMIT_BYTES, by: Sequence[str] = (SOURCE_FILE,)
) -> DataFrame:
    """Which batch each row goes to: its identity, ``csv_bytes``, ``byte_offset``, ``batch_id``.

    A row belongs to the batch in which its first byte falls.  Sizes are taken in one pass and
    landed; the running totals read that narrow table only.
    """
    sizes = clean.select(*by, ROW_INDEX, (F.octet_length(csv_line()) + 1).cast("bigint").alias("csv_bytes"))
    placed = running_total_before(materialize(sizes, "row_sizes"), "csv_bytes", ROW_INDEX, "byte_offset", by)
    return placed.withColumn("batch_id", F.floor(F.col("byte_offset") / limit_bytes).cast("bigint"))


def payload_batches(
    clean: DataFrame, limit_bytes: int = PAYLOAD_LIMIT_BYTES, by: Sequence[str] = (SOURCE_FILE,)
) -> DataFrame:
    """``clean`` with its ``batch_plan``; ``clean`` is read twice, so land it if it is costly."""
    return clean.join(batch_plan(clean, limit_bytes, by), [*by, ROW_INDEX])


def with_batch_id(
    clean: DataFrame, limit_bytes: int = PAYLOAD_LIMIT_BYTES, by: Sequence[str] = (SOURCE_FILE,)
) -> DataFrame:
    """``payload_batches`` without sizes and offsets, and without a shuffle of whole rows.

    A batch is a range of row numbers: rows look theirs up in a small table of the batches
    that begin in each block of numbers.  Numbers that come again are joined to the plan.
    """
    plan = materialize(batch_plan(clean, limit_bytes, by).select(*by, ROW_INDEX, "batch_id"), "batch_plan")
    block = F.floor(F.col(ROW_INDEX) / BLOCK_ROWS).cast("bigint")
    starts = (
        plan.groupBy(*by, block.alias("block"), "batch_id").agg(F.min(ROW_INDEX).alias("first_row"))
        .groupBy(*by, "block")
        .agg(F.sort_array(F.collect_list(F.struct("first_row", "batch_id"))).alias("starts"))
    )
    keys = materialize(
        plan.groupBy(*by, ROW_INDEX).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated_rows"
    )
    again = plan.join(keys, [*by, ROW_INDEX], "left_semi").withColumnRenamed("batch_id", "planned")
    begun = F.filter("starts", lambda x: x["first_row"] <= F.col(ROW_INDEX))
    return (
        clean.withColumn("block", block)
        .join(materialize(starts, "batch_starts"), [*by, "block"])
        .join(materialize(again, "repeated_plan"), [*by, ROW_INDEX], "left")
        .select(*clean.columns, F.coalesce("planned", F.element_at(begun, -1)["batch_id"]).alias("batch_id"))
    )


def lead_json(clean: DataFrame) -> DataFrame:
    """Every row as a JSON object with the ten fields."""
    ids = [c for c in (SOURCE_FILE, ROW_INDEX) if c in clean.columns]
    return clean.select(*ids, F.to_json(F.struct(*TARGET)).alias("lead"))


def lead_envelopes(
    clean: DataFrame,
    reports: DataFrame,
    correlation_id: str = "",
    limit_bytes: int = PAYLOAD_LIMIT_BYTES,
) -> DataFrame:
    """One message per file and batch: ``(source_file, batch_id, row_count, envelope)``.

    A batch holds about ``limit_bytes`` of CSV text, so it fits one cell however
    large the file is.
    """
    landed = materialize(clean.select(SOURCE_FILE, ROW_INDEX, *TARGET), "payload_rows")
    # Rows travel once, without their CSV line, to where a batch is put together.
    batches = with_batch_id(landed, limit_bytes)
    rows = F.collect_list(F.struct(ROW_INDEX, F.struct(*TARGET).alias("lead")))
    leads = F.sort_array(
        F.transform(rows, lambda x: F.struct(x[ROW_INDEX], csv_line(of=x["lead"]).alias("line"), x["lead"].alias("lead")))
    )
    grouped = batches.repartition(SOURCE_FILE, "batch_id").groupBy(SOURCE_FILE, "batch_id").agg(
        F.count("*").alias("row_count"), leads.alias("leads")
    )
    header = F.struct(
        F.col("mapping").alias("mapped"), F.col("unmapped_input_headers").alias("unmapped")
    )
    report = F.struct(*(c for c in reports.columns if c != SOURCE_FILE))
    envelope = F.struct(
        F.lit("success").alias("status"),
        SOURCE_FILE,
        "batch_id",
        "row_count",
        F.transform("leads", lambda x: x["lead"]).alias("leads"),
        F.concat(
            F.lit(HEADER_LINE + "\n"),
            F.array_join(F.transform("leads", lambda x: x["line"]), "\n"),
            F.lit("\n"),
        ).alias("csv_data"),
        "header_mapping",
        "report",
        F.lit(correlation_id).alias("correlation_id"),
        F.current_timestamp().alias("timestamp"),
    )
    per_file = reports.select(SOURCE_FILE, header.alias("header_mapping"), report.alias("report"))
    # Landed, so that Spark knows its size: joined unlanded, all batches would be shuffled by file.
    return grouped.join(materialize(per_file, "payload_reports"), SOURCE_FILE, "left").select(
        SOURCE_FILE, "batch_id", "row_count", F.to_json(envelope).alias("envelope")
    )


def csv_preview(clean: DataFrame, length: int = PREVIEW_LENGTH) -> DataFrame:
    """The first characters of the CSV text, with ``...`` where it goes on.

    Every line has at least nine commas and a line end, so ``length / 10`` rows
    always cover the preview.
    """
    enough = -(-length // (len(TARGET)))
    lines = clean.orderBy(ROW_INDEX).limit(enough).select(ROW_INDEX, csv_line().alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct(ROW_INDEX, "line")))
    text = F.concat(
        F.lit(HEADER_LINE + "\n"),
        F.array_join(F.transform(ordered, lambda x: F.concat(x["line"], F.lit("\n"))), ""),
    )
    return lines.agg(text.alias("text")).select(
        F.when(
            F.length("text") > length, F.concat(F.substring("text", 1, length), F.lit("..."))
        )
        .otherwise(F.col("text"))
        .alias("csv_preview")
    )


def sample_rows(rows: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows of every file (of the table, where it has no files)."""
    if SOURCE_FILE not in rows.columns:
        return rows.orderBy(ROW_INDEX).limit(n)
    first = Window.partitionBy(SOURCE_FILE).orderBy(ROW_INDEX)

    def top(df: DataFrame) -> DataFrame:
        return df.withColumn("n", F.row_number().over(first)).where(F.col("n") <= n).drop("n")

    # Numbers are sorted first, whole rows only where a number may be in the sample.
    ids = [SOURCE_FILE, ROW_INDEX]
    return top(rows_with(rows, materialize(top(rows.select(*ids)), "sampled_ids"), ids))
