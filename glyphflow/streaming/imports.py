"""Checkpointed import of dictionary files, its progress, and events grouped by quiet gaps."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from glyphflow.sources.cedict import numbered, parse


def import_lines(spark: SparkSession, folder: str, out: str, checkpoint: str, problems: str | None = None, seconds: float | None = None):
    """Starts a query that parses new files of a folder and appends their entries exactly once.

    Entries go to out with their file and line number, lines that cannot be read to
    problems. Each batch overwrites the partition of its own number, so a batch that runs
    again after a failure leaves the same rows, and the checkpoint folder is the cursor.
    Without seconds it takes what is there and ends; else it looks that often.
    """
    files = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def save(rows: DataFrame, where: str, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(where)

    def write(batch: DataFrame, number: int) -> None:
        lines = parse(numbered(batch))
        save(lines.where("kind = 'entry'"), out, number)
        if problems is not None:
            save(lines.where("kind = 'error'").select("file", "line_no", "error"), problems, number)

    start = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (start.trigger(availableNow=True) if seconds is None else start.trigger(processingTime=f"{seconds} seconds")).start()


def lexemes_of(entries: DataFrame, most: int = 6) -> DataFrame:
    """The lexicon of all that is imported so far: a word's largest weight, whatever batch it came in."""
    n = F.least(F.size("senses"), F.lit(8)) / 8
    w = entries.select(F.explode(F.array_distinct(F.array("simplified", F.coalesce("traditional", "simplified")))).alias("word"), n.alias("n")).where(F.length("word").between(1, most))
    return w.groupBy("word").agg(F.max(1 / F.length("word") + F.col("n")).alias("weight"))


class Throttle:
    """Passes a report on if the last one is long enough ago; the final one always."""

    def __init__(self, report: Callable[[object], None], seconds: float = 0.1, clock: Callable[[], float] = time.monotonic):
        self.report, self.seconds, self.clock, self.last = report, seconds, clock, None

    def __call__(self, value, final: bool = False) -> bool:
        now = self.clock()
        if not final and self.last is not None and now - self.last < self.seconds:
            return False
        self.last = now
        self.report(value)
        return True


class Progress(StreamingQueryListener):
    """Reports (batch, rows) of running queries, throttled, and None when one ends."""

    def __init__(self, report: Callable[[object], None], seconds: float = 0.1):
        self.throttle = Throttle(report, seconds)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.throttle((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.throttle(None, final=True)


def may_resume(job: dict | None, fingerprint: str, parser_version: int) -> bool:
    """An import goes on only over the same source and by the same parser."""
    return job is not None and job.get("fingerprint") == fingerprint and job.get("parser_version") == parser_version


def rolled_back(entries: DataFrame, job: dict | None, fingerprint: str, parser_version: int) -> DataFrame:
    """What stays of entries (source_file, source_offset): rows before the cursor, or none if it may not go on."""
    if not may_resume(job, fingerprint, parser_version):
        return entries.limit(0)
    return entries.where((F.col("source_file") < job["file"]) | ((F.col("source_file") == job["file"]) & (F.col("source_offset") < job["offset"])))


def quiet_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user's events with their last value; works on streams as well."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
