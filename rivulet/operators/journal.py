"""Event log, ingest log and confusions: appended rows and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(log: DataFrame, events: DataFrame) -> DataFrame:
    """``log`` with further (id, event_type, grade_level, message) rows; nothing is deduplicated."""
    return log.unionByName(events.select(*log.columns))


def recent(log: DataFrame, limit: int = 50) -> DataFrame:
    """The last ``limit`` rows by id."""
    return log.orderBy(F.desc("id")).limit(limit)


def ingest_summary(log: DataFrame) -> DataFrame:
    """(source_type, runs, facts_added, errors) of an ingest log; nulls count as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return log.groupBy("source_type").agg(F.count(F.lit(1)).alias("runs"), total("facts_added"), total("errors"))


def add_confusions(confusions: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (id, subject, confused_with, reason, grade) whose pair is neither stored nor earlier in ``new``."""
    first = new.filter("subject is not null and confused_with is not null").groupBy("subject", "confused_with").agg(
        F.min("id").alias("id"), F.min_by("reason", "id").alias("reason"), F.min_by("grade", "id").alias("grade")
    )
    return first.join(confusions.select("subject", "confused_with"), ["subject", "confused_with"], "left_anti").select("id", "subject", "confused_with", "reason", "grade")
