"""Drop-folder ingest, best contact and job state as streams.

Normalising, dropping empty rows and labelling look at one row at a time, so
batch functions apply unchanged.  The best contact and the job state are
aggregates that Spark keeps in its state store: per micro-batch only groups
that changed are written (``levels``).  A batch that is run again after a failure
overwrites its own folders, so results stay exact.

Files of any headers come in as a stream of paths: every micro-batch reads its
files with the batch reader, so encodings, line ends, rejects and mappings follow
the batch rules and a huge file is still split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from leadloom.operators.cleaning import add_source_label, empty_ledger
from leadloom.operators.dedup import with_company, with_priority, without_company
from leadloom.operators.jobs import FINISHED, state_aggregates, with_progress
from leadloom.operators.mapping import HeaderMapping
from leadloom.plans.pipeline import CleanOptions, clean_leads, filled_rows, row_scores
from leadloom.plans.run import RunPaths, run
from leadloom.schema import DETAILS_DUPLICATE, REASON_DUPLICATE, RETENTION_HOURS, ROW_INDEX, TARGET
from leadloom.sources.scratch import landed_at, likely_with, materialize, rows_with
from leadloom.streaming.levels import Levels, latest_by, sum_of


def read_drop_folder(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV files as they arrive in ``path``; ``row_index`` has to be a column."""
    schema = ", ".join(
        f"`{c}` {'bigint' if c == ROW_INDEX else 'string'}" for c in columns
    )
    return (
        spark.readStream.schema(schema)
        .options(header="true", multiLine="true", quote='"', escape='"')
        .csv(path)
    )


def stream_clean(
    rows: DataFrame,
    mapping: HeaderMapping,
    output: str,
    checkpoint: str,
    options: CleanOptions = CleanOptions(),
) -> StreamingQuery:
    """Clean rows appended to parquet files in ``output``."""
    if options.one_contact_per_company:
        raise ValueError("use stream_best_contact to keep one contact per company")
    return (
        clean_leads(rows, mapping, options)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )


# -- files of any headers ------------------------------------------------------


def read_arrivals(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """``(path, length)`` of files as they arrive; their content is not read here."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select("path", "length")
    )


def stream_feeds(
    arrivals: DataFrame,
    output: str,
    checkpoint: str,
    mapping: HeaderMapping | None = None,
    options: CleanOptions = CleanOptions(),
) -> StreamingQuery:
    """Runs over files as they arrive: ``<output>/batch_id=<n>`` holds what ``run`` gives for batch n.

    Headers, encodings, line ends, rejects and the ledger follow the batch rules, with one
    mapping for all files or one proposed for each.  ``manifest`` lists the files of every
    batch.  A batch holds at most ``max_files`` paths, the only thing that reaches the driver.
    Read the clean rows with ``arrived``.
    """
    if options.one_contact_per_company:
        raise ValueError("use stream_best_contact to keep one contact per company")

    def take_in(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r["path"] for r in batch.select("path").collect())
        if paths:
            spark = batch.sparkSession
            run(spark, paths, f"{output}/batch_id={batch_id}", mapping, options, ordered=False, overwrite=True)
            listed = spark.createDataFrame([(p,) for p in paths], "path string")
            listed.coalesce(1).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}/manifest")

    return (
        arrivals.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(take_in)
        .start()
    )


def arrived(spark: SparkSession, output: str, table: str = "rows") -> DataFrame:
    """What all batches of ``stream_feeds`` gave: ``rows``, ``drops``, ``rejects``, ``unread`` or ``manifest``."""
    if table not in ("manifest", *RunPaths.__dataclass_fields__):
        raise ValueError(f"no table {table!r}")
    return spark.read.option("basePath", output).parquet(f"{output}/batch_id=*/{table}")


# -- best contact --------------------------------------------------------------


def _best(output: str) -> Levels:
    return Levels(f"{output}/best", _best_rows)


def _best_rows(candidates: DataFrame) -> DataFrame:
    """Whole rows of the best contacts, of those that batches had for the best.

    The others are found by narrow columns and landed, and taken out by their ids: few of a
    batch's candidates lose, so whole rows are shuffled only where many batches meet.
    """
    ids = ["batch_id", "candidate"]
    order = Window.partitionBy("company_key").orderBy(F.col("priority_score").desc(), (-F.col(ROW_INDEX)).desc(), *ids)
    ranked = candidates.select(*ids, "company_key", "priority_score", ROW_INDEX).withColumn("place", F.row_number().over(order))
    return rows_with(candidates, materialize(ranked.where("place > 1").select(*ids), "beaten_rows"), ids, "left_anti")


def stream_best_contact(
    rows: DataFrame,
    mapping: HeaderMapping,
    output: str,
    checkpoint: str,
    options: CleanOptions = CleanOptions(),
) -> list[StreamingQuery]:
    """The best contact of each company over everything seen so far.

    Two queries: one that adds the best contacts of every batch, and a plain append for rows
    without a company.  A batch lands narrow scores, told from raw cells, and whose are the best
    (the next one overwrites both); its files are read again for the whole rows of these alone.
    The best of the best ones of batches is the best of all, so no state is kept.  Read the
    result with ``current_best``.
    """
    columns = [ROW_INDEX, *TARGET]

    def take_in(batch: DataFrame, batch_id: int) -> None:
        scores = row_scores(batch, mapping, options).where("filled AND company_key != ''")
        scores = landed_at(scores.select("company_key", ROW_INDEX, "priority_score"), f"{output}/scores")
        best = _winners(scores.withColumn("batch_id", F.lit(batch_id)))
        chosen = landed_at(best.select(ROW_INDEX), f"{output}/chosen")
        some = likely_with(batch, chosen, [ROW_INDEX])
        scored = with_priority(with_company(filled_rows(some, mapping, options)), options.word_match)
        candidates = scored.select("company_key", "priority_score", *columns)
        _best(output).write(candidates.withColumn("candidate", F.monotonically_increasing_id()), batch_id)

    best = (
        rows.writeStream.option("checkpointLocation", f"{checkpoint}/best")
        .trigger(availableNow=True)
        .foreachBatch(take_in)
        .start()
    )
    others = (
        without_company(filled_rows(rows, mapping, options))
        .select(*columns)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{checkpoint}/others")
        .option("compression", "zstd")
        .trigger(availableNow=True)
        .start(f"{output}/others")
    )
    return [best, others]


def current_best(spark: SparkSession, output: str, source_label: str | None = None) -> DataFrame:
    """Clean rows chosen so far: one per company and all without a company."""
    chosen = _best(output).read(spark).select(ROW_INDEX, *TARGET)
    others = spark.read.schema(chosen.schema).parquet(f"{output}/others")
    return add_source_label(chosen.unionByName(others), source_label)


# -- ledger of drops -----------------------------------------------------------


def _ledger(output: str) -> tuple[Levels, Levels, Levels]:
    """Contacts by company, the best one of each company, and empty rows."""
    return (
        Levels(f"{output}/contacts", sum_of("change", "company_key", ROW_INDEX)),
        Levels(f"{output}/winners", _winners),
        Levels(f"{output}/unfilled", lambda changes: changes),
    )


def _winners(scores: DataFrame) -> DataFrame:
    """The best contact of each company.  The best of the best ones of batches is the best of all, so no state is kept."""
    better = F.struct("priority_score", -F.col(ROW_INDEX))
    best = scores.groupBy("company_key").agg(
        F.max_by(F.struct(ROW_INDEX, "priority_score"), better).alias("best"), F.max("batch_id").alias("batch_id")
    )
    return best.select("company_key", "best.*", "batch_id")


def stream_drops(
    rows: DataFrame,
    mapping: HeaderMapping,
    output: str,
    checkpoint: str,
    options: CleanOptions = CleanOptions(one_contact_per_company=True),
) -> list[StreamingQuery]:
    """The ledger of dropped rows over everything seen so far; read it with ``current_drops``.

    Every row is read once and scored from its raw cells.  A batch lands its narrow scores (the
    next one overwrites them) and adds its contacts, the best one of each of its companies and
    its empty rows to three changelogs.  A contact is in the ledger as long as another one of its
    company is better, so one that is beaten later comes in by then; nothing is kept per company.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        landed = landed_at(batch, f"{output}/scores")
        scores = landed.where("filled").select("company_key", ROW_INDEX, "priority_score")
        contacts, winners, unfilled = _ledger(output)
        contacts.write(scores.select("company_key", ROW_INDEX, F.lit(1).cast("bigint").alias("change")), batch_id)
        winners.write(_winners(scores.withColumn("batch_id", F.lit(batch_id).cast("bigint"))), batch_id)
        unfilled.write(landed.where("NOT filled").select(ROW_INDEX), batch_id)

    # Rows that can be dropped: empty ones, and those with a company.
    scores = row_scores(rows, mapping, options).where("NOT filled OR company_key != ''")
    return [
        scores.select(ROW_INDEX, "company_key", "priority_score", "filled")
        .writeStream.option("checkpointLocation", f"{checkpoint}/scores")
        .trigger(availableNow=True)
        .foreachBatch(take_in)
        .start()
    ]


def current_drops(spark: SparkSession, output: str) -> DataFrame:
    """The ledger so far: empty rows, and contacts that lost against another of their company."""
    ledger = _ledger(output)
    # What all three have; a batch may be half written.
    done = min(log.finished(spark) for log in ledger)
    contacts, winners, unfilled = (log.read(spark, done) for log in ledger)
    columns = ["company_key", ROW_INDEX, "change"]
    kept = winners.withColumn("change", F.lit(-1).cast("bigint")).select(columns)
    changes = contacts.select(columns).unionByName(kept)
    lost = changes.groupBy("company_key", ROW_INDEX).agg(F.sum("change").alias("change")).where("change != 0").select(
        ROW_INDEX,
        F.lit(REASON_DUPLICATE).alias("reason"),
        F.concat(F.lit(DETAILS_DUPLICATE), "company_key").alias("details"),
    )
    return empty_ledger(unfilled.select(ROW_INDEX)).unionByName(lost)


# -- jobs ----------------------------------------------------------------------


def _jobs(output: str) -> Levels:
    return Levels(output, latest_by("job_id"))


def stream_job_state(events: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Changed job states, batch by batch; read them with ``current_state``.

    The state is one row per job.  There is no watermark: an event that comes
    late still counts for ``created_at``, whatever its age.
    """
    return (
        with_progress(events.groupBy("job_id").agg(*state_aggregates()))
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_jobs(output).write)
        .start()
    )


def current_state(spark: SparkSession, output: str) -> DataFrame:
    return _jobs(output).read(spark).drop("batch_id")




class _Jobs(StatefulProcessor):
    """State of a job from its events; a finished one is forgotten when it stays untouched."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState(
            "job", "created_at bigint, updated_at bigint, event_id bigint, status string, error string"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            created, updated, event, status, error = self.job.get()
        else:
            created = updated = event = status = error = None
        for chunk in rows:
            for ts, i, state, said in zip(chunk["us"].tolist(), chunk["event_id"].tolist(), chunk["status"], chunk["error"]):
                created = ts if created is None else min(created, ts)
                if updated is None or (ts, i) > (updated, event):
                    updated, event, status = ts, i, state
                    error = said if state == "failed" else None
        self.job.update((created, updated, event, status, error))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status in FINISHED:
            # The first millisecond at which the job is older than it may be.
            self.handle.registerTimer(updated // 1000 + self.keep_ms + 1)
        yield self._row(key, status, created, updated, error, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        yield self._row(key, None, None, None, None, True)

    @staticmethod
    def _row(key, status, created, updated, error, gone: bool) -> pd.DataFrame:
        times = {n: pd.to_datetime(pd.Series([v], dtype="Int64"), unit="us") for n, v in (("created_at", created), ("updated_at", updated))}
        return pd.DataFrame({"job_id": key[0], "status": [status], **times, "error": [error], "gone": [gone]})

    def close(self) -> None:
        pass


def stream_job_retention(
    events: DataFrame, output: str, checkpoint: str, hours: int = RETENTION_HOURS, late: str = "0 seconds"
) -> StreamingQuery:
    """Changed job states, with finished jobs that leave the state ``hours`` after their last event.

    Event time decides: jobs go when the latest event seen, less ``late``, is so much newer.
    Events older than that are ignored, and a job that comes back later is a new one.  Without
    the timers the state would hold every job there ever was.  Needs the RocksDB store.
    """
    job_type, time_type = (events.schema[c].dataType.simpleString() for c in ("job_id", "ts"))
    row = f"job_id {job_type}, status string, created_at {time_type}, updated_at {time_type}, error string, gone boolean"
    changes = (
        events.withColumn("event_time", F.col("ts").cast("timestamp"))
        .withWatermark("event_time", late)
        .select("job_id", "event_time", F.unix_micros("event_time").alias("us"), "event_id", "status", "error")
        .groupBy("job_id")
        .transformWithStateInPandas(
            _Jobs(hours * 3_600_000), row, "Append", "EventTime"
        )
    )
    return (
        changes.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_jobs(output).write)
        .start()
    )


def kept_jobs(spark: SparkSession, output: str) -> DataFrame:
    """Jobs that ``stream_job_retention`` still keeps."""
    return with_progress(_jobs(output).read(spark).where("NOT gone"))
