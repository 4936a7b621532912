"""Request bodies as a stream: parsed once, and dealt to accepted, rejected and malformed rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scoreloom.operators import capture
from scoreloom.sources.inputs import parse_requests

#: Reasons that aren't the sender's choice of values: such rows are kept apart with their bodies, for somebody to look at.
MALFORMED = ("bad_json", "malformed")
OUTPUTS = ("accepted", "rejected", "malformed")


def submission_rows(valid: DataFrame) -> DataFrame:
    """(k, value) of accepted submissions: their records."""
    return capture.submission_records(valid)


def event_rows(valid: DataFrame) -> DataFrame:
    return capture.event_records(valid, "k")


def deal(requests: DataFrame, batch_id: int, path: str, validate: Callable[[DataFrame], DataFrame], records: Callable[[DataFrame], DataFrame]) -> None:
    """One batch of requests (k, value, headers) to path/accepted, rejected and malformed, each in a folder of the batch's own.

    A batch that runs again overwrites what it wrote, so its rows are there once. The bodies are parsed once for the three.
    """
    raw = F.col("value").alias("body")
    valid = validate(parse_requests(requests.select("k", raw, "headers"), "body")).persist()
    try:
        odd = F.col("reject_reason").isin(*MALFORMED)
        out = {
            "accepted": records(valid.where("reject_reason is null")).withColumn("status_code", F.lit(202)),
            "rejected": valid.where(F.col("reject_reason").isNotNull() & ~odd).select("k", "reject_reason", "status_code"),
            "malformed": valid.where(odd).select("k", "reject_reason", "status_code", "body"),
        }
        for name, rows in out.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
    finally:
        valid.unpersist()


def ingest(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    validate: Callable[[DataFrame], DataFrame] = capture.validate_submissions,
    records: Callable[[DataFrame], DataFrame] = submission_rows,
    once: bool = False,
) -> StreamingQuery:
    """Start the stream of requests (k, value: the body, headers: a map) into the folder path; for events give validate_events and event_rows."""
    writer = requests.writeStream.foreachBatch(lambda df, k: deal(df, k, path, validate, records)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def outputs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What the stream has written so far, with batch_id."""
    return {name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}") for name in OUTPUTS}
