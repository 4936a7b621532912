"""Sinks: rows as JSON to files, posts to a webhook with an answer for each row, and batches that go to several sinks in shapes of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators.capture import outcome
from scoreloom.sources.commits import Versions


def route(config: Mapping[str, str | None], kind: str) -> str | None:
    """The url for a kind of rows. Results fall back to the common url if theirs is not set at all; an empty one counts as set."""
    if kind == "events":
        return config.get("events_url")
    own = config.get("results_url")
    return config.get("common_url") if own is None else own


def to_files(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def _posts(url: str, timeout: float):
    def post(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import urllib.error
        import urllib.request

        def send(body: str) -> tuple[int | None, str | None]:
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"}), timeout=timeout) as answer:
                    return answer.status, None
            except urllib.error.HTTPError as e:
                return e.code, str(e)
            except OSError as e:
                return None, str(e)

        for chunk in chunks:
            answers = [send(x) for x in chunk["value"]]
            status = pd.array([s for s, _ in answers], dtype="Int32")
            ok = [s is not None and 200 <= s < 300 for s, _ in answers]
            yield pd.DataFrame({"key": chunk["key"], "http_status": status, "delivered": ok, "error": [e for _, e in answers]})

    return post


class Webhook:
    """Posts records, one a request, from the tasks that hold them, and keeps the answer of each row in a table by batch.

    A batch that runs again posts only rows that have no answer yet, and with retry_failed also those that failed. Answers are committed when
    all of a batch's posts are made, so a row whose task was lost in between may be posted again: at least once. No url, or an empty one:
    nothing is posted and nothing kept.
    """

    def __init__(self, spark: SparkSession, url: str | None, path: str, timeout: float = 10.0, retry_failed: bool = False):
        self.spark, self.url, self.path, self.timeout, self.retry_failed = spark, url, path.rstrip("/"), timeout, retry_failed

    def answers(self, batch_id: int) -> DataFrame:
        """(key, http_status, delivered, error) of a batch's rows so far; the latest of each."""
        schema = "key string, http_status int, delivered boolean, error string, attempt int"
        attempts = self._attempts(batch_id)
        if not attempts:
            return self.spark.createDataFrame([], schema).drop("attempt")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/batch={batch_id}/attempt={k}" for k in attempts])
        return rows.groupBy("key").agg(F.max_by(F.struct("http_status", "delivered", "error"), "attempt").alias("x")).select("key", "x.*")

    def _attempts(self, batch_id: int) -> list[int]:
        return Versions(self.spark, f"{self.path}/done/{batch_id}").versions()

    def deliver(self, records: DataFrame, batch_id: int) -> DataFrame:
        """records (key, value: JSON text; a key stands once in a batch) with the key as text, configured, delivered, http_status, error and status_code: 202, also
        where no url is set, or 502 where the post failed."""
        records = records.withColumn("key", F.col("key").cast("string"))
        if not self.url:
            return outcome(records.withColumns({"http_status": F.lit(None).cast("int"), "error": F.lit(None).cast("string")}), False)
        before, attempts = self.answers(batch_id), self._attempts(batch_id)
        settled = before.where("delivered") if self.retry_failed else before
        attempt = max([0, *attempts]) + 1
        answers = records.join(settled, "key", "left_anti").select("key", "value").mapInPandas(_posts(self.url, self.timeout), "key string, http_status int, delivered boolean, error string")
        answers.withColumn("attempt", F.lit(attempt)).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}/attempt={attempt}")
        Versions(self.spark, f"{self.path}/done/{batch_id}").commit(attempt, {})
        return outcome(records.join(self.answers(batch_id), "key", "left"), True, F.coalesce("delivered", F.lit(False)))


# Shapes of events: from (key, event_name, payload, context), the last three VARIANT, to (key, value: JSON text).


def _shaped(events: DataFrame, body: Column) -> DataFrame:
    return events.select("key", F.to_json(body).alias("value"))


def tag_call(events: DataFrame) -> DataFrame:
    """The arguments of a tag manager's call: the word event, the name, the payload; without the context."""
    parts = F.array(F.lit("event").cast("variant"), F.col("event_name"), F.col("payload"))
    return _shaped(events, parts)


def capture_call(events: DataFrame) -> DataFrame:
    """The name, and the payload with the context as one of its properties."""
    fields = F.map_filter(F.try_variant_get("payload", "$", "map<string,variant>"), lambda k, _: k != "trackingContext")
    own = F.map_concat(F.coalesce(fields, F.create_map().cast("map<string,variant>")), F.create_map(F.lit("trackingContext"), F.coalesce("context", F.parse_json(F.lit("null")))))
    return _shaped(events, F.struct("event_name", own.alias("properties")))


def props_call(events: DataFrame) -> DataFrame:
    """The name, and the payload as props; without the context."""
    return _shaped(events, F.struct("event_name", F.struct(F.col("payload").alias("props")).alias("options")))


def event_request(events: DataFrame) -> DataFrame:
    """The body of a request to the event endpoint: name, payload and context."""
    context = F.coalesce("context", F.parse_json(F.lit("null")))
    return _shaped(events, F.struct(F.col("event_name").alias("eventName"), "payload", context.alias("trackingContext")))


@dataclass(frozen=True)
class Sink:
    """send gets a batch in the sink's own shape and the batch's id; None: the sink isn't there, and is skipped."""

    name: str
    shape: Callable[[DataFrame], DataFrame]
    send: Callable[[DataFrame, int], object] | None


class FanOut:
    """For foreachBatch: each batch to every sink in its shape. What a sink has is noted for it alone by batch id, in the folder path.

    A sink that fails keeps no other from its batch. Then the batch fails as a whole with a RuntimeError that names the sinks, and when
    Spark runs it again, only those that don't have it get it. With ignore_failures a failure is noted and forgotten: at most once.
    """

    def __init__(self, spark: SparkSession, path: str, sinks: list[Sink], ignore_failures: bool = False):
        self.sinks, self.ignore_failures = [s for s in sinks if s.send is not None], ignore_failures
        self._marks = {s.name: Versions(spark, f"{path.rstrip('/')}/{s.name}") for s in self.sinks}

    def has(self, name: str, batch_id: int) -> bool:
        return batch_id + 1 in self._marks[name].versions()

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        missing = [s for s in self.sinks if not self.has(s.name, batch_id)]
        failed = {}
        df.persist()
        try:
            for sink in missing:
                try:
                    sink.send(sink.shape(df), batch_id)
                except Exception as e:  # whatever a sink raises is its own
                    failed[sink.name] = e
                if sink.name not in failed or self.ignore_failures:
                    note = str(failed[sink.name])[:200] if sink.name in failed else None
                    self._marks[sink.name].commit(batch_id + 1, {"failed": note})
        finally:
            df.unpersist()
        if failed and not self.ignore_failures:
            raise RuntimeError(f"batch {batch_id} failed for {', '.join(sorted(failed))}") from next(iter(failed.values()))
