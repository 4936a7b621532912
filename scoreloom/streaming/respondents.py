"""Live state per respondent as streams: answers since a restart, unlocking, once-only views and the current view."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scoreloom import rubric
from scoreloom.functions.rules import NEVER, micros
from scoreloom.operators.flow import with_email_flag
from scoreloom.operators.replay import FINAL, NAMES, Flow

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WIDE = ", ".join(f"q{q} int" for q in rubric.QUESTIONS)


def _at():
    """When a row was, as a number: null is before all others."""
    return F.coalesce(micros(F.col("ts")), F.lit(NEVER)).alias("at")


def _keyed(log: DataFrame):
    """log by respondent; the session's state store becomes RocksDB, which keeps state of any size out of the JVM's heap, as these need it."""
    log.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return log.groupBy("respondent_id")


class _Answers(StatefulProcessor):
    """The latest answer of each question (a map), and the latest restart and submission, by (at, event_id)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answers = handle.getMapState("answers", "question_id int", "at long, event_id long, value int, given boolean")
        self.marks = handle.getMapState("marks", "kind string", "at long, event_id long, email string, discord string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            chunk = chunk.sort_values(["at", "event_id"])
            for kind in ("restart", "submit"):
                own = chunk[chunk["kind"] == kind]
                if len(own):
                    r = own.iloc[-1]
                    self._later(self.marks, (kind,), (int(r["at"]), int(r["event_id"]), r["email"], r["discord"]))
            for r in chunk[chunk["kind"] == "answer"].drop_duplicates("question_id", keep="last").itertuples():
                self._later(self.answers, (int(r.question_id),), (int(r.at), int(r.event_id), int(r.value), bool(r.given)))
        marks = {k[0]: tuple(v) for k, v in self.marks.iterator()}
        restart = marks.get("restart", (None, None))[:2]
        after = lambda v: restart[0] is None or tuple(v[:2]) > restart
        found, gone = {}, []
        for k, v in self.answers.iterator():
            if not after(v):
                gone.append(k)
            elif v[3]:
                found[f"q{k[0]}"] = v[2]
        for k in gone:
            self.answers.removeKey(tuple(k))
        submit = marks.get("submit")
        on = submit is not None and after(submit)
        wide = {n: pd.array([found.get(n)], dtype="Int32") for n in (f"q{q}" for q in rubric.QUESTIONS)}
        yield pd.DataFrame({"respondent_id": [key[0]], **wide, "email": [submit[2] if on else None], "discord": [submit[3] if on else None], "unlocked": [on]})

    @staticmethod
    def _later(state, key: tuple, new: tuple) -> None:
        if not state.containsKey(key) or tuple(state.getValue(key)[:2]) < new[:2]:
            state.updateValue(key, new)

    def close(self) -> None:
        pass


def live_states(log: DataFrame) -> DataFrame:
    """A stream of (respondent_id, q1 ... q15, email, discord, unlocked, has_email): the new state of each respondent with rows in a batch.

    log: a stream of respondent_id, question_id, value, ts, event_id, is_restart, is_submit, email, discord; a row that is neither restart
    nor submission is an answer. Rows count by (ts, event_id), so the state after all batches is the same however the log is cut and
    in whatever order it comes: that of scoring.answers_since_restart and flow.states. Start it in update mode.

    State is 15 answers and two marks per respondent, without an end, as a respondent may come back at any time. Answers to questions
    that there aren't are left out before.
    """
    kind = F.when(F.col("is_restart"), "restart").when(F.col("is_submit"), "submit").when(F.col("question_id").isin(*rubric.QUESTIONS), "answer").otherwise("other")
    rows = log.select(
        "respondent_id", kind.alias("kind"), _at(), "event_id", F.coalesce("question_id", F.lit(0)).alias("question_id"),
        F.coalesce("value", F.lit(0)).alias("value"), F.col("value").isNotNull().alias("given"), "email", "discord",
    )
    schema = f"respondent_id {dict(log.dtypes)['respondent_id']}, {WIDE}, email string, discord string, unlocked boolean"
    return with_email_flag(_keyed(rows).transformWithStateInPandas(_Answers(), schema, "Update", "None"))


class _Views(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "run long, seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, seen = self.run.get() if self.run.exists() else (0, False)
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
        batch["run"] = int(run) + batch["is_restart"].cumsum()
        first = batch[~batch["is_restart"]].drop_duplicates("run")
        fresh = first[(first["run"] != run) | (not seen)]
        last = int(batch["run"].iloc[-1])
        self.run.update((last, bool((first["run"] == last).any()) or (last == run and bool(seen))))
        if len(fresh):
            yield pd.DataFrame({"respondent_id": [key[0]] * len(fresh), "run": fresh["run"].astype("int64"), "event_id": fresh["event_id"]})

    def close(self) -> None:
        pass


def live_views(log: DataFrame) -> DataFrame:
    """A stream of (respondent_id, run, event_id): the first view of each respondent's run, passed on in the batch that brings it.

    log: a stream of respondent_id, ts, event_id, is_restart, is_view. run counts the restarts so far. Within a batch rows are taken by (ts,
    event_id); what has been passed on can't be taken back, so a row that comes in a later batch counts as later. A log cut into batches in
    its order gives flow.once_per_run, wherever it is cut. A batch's views and restarts of one respondent are held by one task: the
    source's rate limit bounds them. Start it in append mode.
    """
    rows = log.where("is_restart or is_view").select("respondent_id", _at(), "event_id", "is_restart")
    return _keyed(rows).transformWithStateInPandas(_Views(), f"respondent_id {dict(log.dtypes)['respondent_id']}, run long, event_id long", "Append", "None")


class _Replay(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flow = handle.getValueState("flow", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flow = Flow(**json.loads(self.flow.get()[0])) if self.flow.exists() else Flow()
        batch = pd.concat(list(rows)).sort_values(["at", "event_id", "seq"])
        for action, value in zip(batch["action"], batch["value"]):
            flow.take(action, None if pd.isna(value) else float(value))
        self.flow.update((json.dumps(asdict(flow)),))
        yield pd.DataFrame([(key[0], *flow.final())], columns=["respondent_id", *NAMES])

    def close(self) -> None:
        pass


def live_flow(log: DataFrame) -> DataFrame:
    """A stream of where each respondent with actions in a batch is now: replay.final_states kept as state, with the limits of live_views."""
    rows = log.select("respondent_id", _at(), "event_id", "seq", "action", F.col("value").cast("double").alias("value"))
    return _keyed(rows).transformWithStateInPandas(_Replay(), f"respondent_id {dict(log.dtypes)['respondent_id']}, {FINAL}", "Update", "None")
