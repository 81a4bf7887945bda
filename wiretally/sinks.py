"""Writers for result tables and report documents, and staged intermediates."""

from __future__ import annotations

import tempfile
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from wiretally.plans.report import Report


ATTEMPT = "attempt"
COMMITS = "commits"
_RECORD = f"run_id string, {ATTEMPT} string, committed_at timestamp"


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named in ``spark.checkpoint.dir``, if any, on a cluster and locally alike."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own where driver and executors can write.

    Without a shared folder a local session gets a temporary one; a cluster
    without one is an error, since its machines share no local path.
    """
    folder = shared_folder(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wiretally-")
    return f"{folder}/wiretally-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Write ``df`` once under ``folder`` and read it back.

    The copy outlives executors, and later uses start from it instead of the
    packets. Without a folder ``df`` is persisted, and what a lost executor held
    is computed again. Either way it is made now, so that later plans know its size.
    """
    if folder is None:
        df.persist().count()
        return df
    path = f"{folder}/wiretally-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a result table."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_document(report: DataFrame, path: str, fmt: str = "json", **options: str) -> None:
    """Append rows of a run's report; ``fmt`` may name a document-store connector."""
    report.write.mode("append").format(fmt).options(**options).save(path)


def write_report(report: Report, path: str, fmt: str = "json") -> str:
    """Append a report to folders of its tables' names; returns the name of this attempt.

    Every row carries the attempt. The rows of all tables are written first and the
    commit record, one row in ``commits``, last: ``read_report`` takes only
    what a record names, so a job that was lost half-way leaves nothing to be
    seen, and a repeated ``run_id`` replaces the run it repeats.
    """
    attempt = uuid.uuid4().hex
    for name, rows in report._asdict().items():
        write_document(rows.withColumn(ATTEMPT, F.lit(attempt)), f"{path}/{name}", fmt)
    # The header has one row; nothing but its run_id is worked out again.
    record = report.header.select(
        "run_id", F.lit(attempt).alias(ATTEMPT), F.current_timestamp().alias("committed_at")
    )
    write_document(record.coalesce(1), f"{path}/{COMMITS}", fmt)
    return attempt


def committed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """``run_id, attempt`` of the runs that are whole: the latest attempt of each."""
    records = spark.read.schema(_RECORD).format(fmt).load(f"{path}/{COMMITS}")
    latest = F.max(F.struct("committed_at", ATTEMPT))[ATTEMPT]
    return records.groupBy("run_id").agg(latest.alias(ATTEMPT))


def read_report(spark: SparkSession, path: str, name: str, fmt: str = "json") -> DataFrame:
    """The rows of the table ``name`` of all whole runs."""
    rows = spark.read.format(fmt).load(f"{path}/{name}")
    whole = committed(spark, path, fmt)
    return rows.join(whole, ["run_id", ATTEMPT], "left_semi").drop(ATTEMPT)
