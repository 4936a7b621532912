"""The questionnaire's views as a fold over each respondent's actions, in batch; streaming.respondents folds the same way."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from scoreloom import rubric

ACTIONS = ("start", "answer", "next", "back", "submit", "restart", "home")
FINAL = "view string, step int, answered int, unlocked boolean, completed long, results_viewed long"
NAMES = [f.split()[0] for f in FINAL.split(", ")]


@dataclass
class Flow:
    """Where one respondent is. An action that the current view has no button for changes nothing.

    completed counts completions, results_viewed the runs (between restarts) in which the results were seen.
    """

    view: str = "landing"
    step: int = 0
    answers: list = field(default_factory=lambda: [None] * len(rubric.QUESTIONS))
    unlocked: bool = False
    completed: int = 0
    results_viewed: int = 0
    seen: bool = False

    def _show(self, view: str) -> None:
        self.view = view
        if view == "results" and not self.seen:
            self.seen, self.results_viewed = True, self.results_viewed + 1

    def _done(self) -> bool:
        return None not in self.answers

    def take(self, action: str | None, value: float | None) -> None:
        if action == "home":
            self.view = "landing"
        elif self.view == "landing":
            if action == "start":
                self._show(("results" if self.unlocked else "email") if self._done() else "questions")
        elif self.view == "questions":
            last = len(self.answers) - 1
            if action == "answer":
                self.answers[self.step] = value
            elif action == "back":
                self.step = max(0, self.step - 1)
            elif action == "next" and self.answers[self.step] is not None:
                if self.step < last:
                    self.step += 1
                elif self._done():
                    self.completed += 1
                    self._show("results" if self.unlocked else "email")
        elif self.view == "email":
            if action == "submit":
                self.unlocked = True
                self._show("results")
        elif action == "restart":
            self.answers, self.step, self.unlocked, self.seen, self.view = [None] * len(self.answers), 0, False, False, "landing"

    def final(self) -> tuple:
        return (self.view, self.step, sum(a is not None for a in self.answers), self.unlocked, self.completed, self.results_viewed)


def final_states(log: DataFrame) -> DataFrame:
    """(respondent_id, view, step, answered, unlocked, completed, results_viewed) after each respondent's actions.

    log: respondent_id, ts, event_id, seq (the order within an event), action (of ACTIONS; others change nothing) and value (for
    answers; null: no answer). Rows are dealt by respondent once and sorted; a task holds one respondent's state at a time, so a history
    of any length takes no more memory than a short one. Rows without a respondent are one respondent; an empty log gives no row.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, began = None, Flow(), False
        out: list[tuple] = []
        for batch in batches:
            for who, action, value in zip(*(batch.column(n).to_pylist() for n in ("respondent_id", "action", "value"))):
                if not began or who != key:
                    if began:
                        out.append((key, *state.final()))
                    key, state, began = who, Flow(), True
                state.take(action, value)
            if out:
                yield _rows(out, batch.schema)
                out = []
        if began:
            yield _rows([(key, *state.final())], batch.schema)

    dealt = log.select("respondent_id", "ts", "event_id", "seq", "action", "value").repartition("respondent_id").sortWithinPartitions("respondent_id", "ts", "event_id", "seq")
    kind = log.select("respondent_id").schema.fields[0].dataType.simpleString()
    return dealt.select("respondent_id", "action", "value").mapInArrow(fold, f"respondent_id {kind}, {FINAL}")


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [schema.field("respondent_id").type, pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["respondent_id", *NAMES])
