"""Scores of many respondents: latest answer per question, totals, categories, weakest two, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom import rubric
from scoreloom.functions.rules import NUMBERS, band, moment, percent, percent_label, status, total_label


def latest_answers(answers: DataFrame) -> DataFrame:
    """(respondent_id, question_id, value): the last click of each question, by (ts, event_id). Tasks combine their rows before these are dealt."""
    at = moment(F.col("ts"), F.col("event_id"))
    return answers.select("respondent_id", "question_id", "value", at.alias("at")).groupBy("respondent_id", "question_id").agg(F.max_by("value", "at").alias("value"))


def wide_answers(answers: DataFrame) -> DataFrame:
    """(respondent_id, q1 ... q15): latest answers side by side. Other question ids are left out.

    Batch: the latest of each question is found first, so what is dealt by respondent is 15 rows of each at most, and a respondent with
    very many clicks is no task's. Stream: one aggregation, as a stream has one state.
    """
    own = lambda q: F.col("question_id") == q
    if answers.isStreaming:
        at = answers.withColumn("at", moment(F.col("ts"), F.col("event_id")))
        return at.groupBy("respondent_id").agg(*[F.max_by(F.when(own(q), F.col("value")), F.when(own(q), F.col("at"))).alias(f"q{q}") for q in rubric.QUESTIONS])
    return latest_answers(answers).groupBy("respondent_id").agg(*[F.max(F.when(own(q), F.col("value"))).alias(f"q{q}") for q in rubric.QUESTIONS])


def answers_since_restart(log: DataFrame) -> DataFrame:
    """(respondent_id, q1 ... q15) from the answers after each respondent's last restart; log has is_restart beside the answers' columns.

    The latest answer of a question counts if it is later than the latest restart, so no history is ordered: restarts are kept as one
    more question. Respondents who only restarted have no answer. Tasks combine their rows before these are dealt.
    """
    question = F.when(F.col("is_restart"), -1).otherwise(F.col("question_id"))
    rows = log.select("respondent_id", question.alias("question_id"), "value", moment(F.col("ts"), F.col("event_id")).alias("at"))
    latest = rows.groupBy("respondent_id", "question_id").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    of = lambda q, c: F.max(F.when(F.col("question_id") == q, F.col(c)))
    wide = latest.groupBy("respondent_id").agg(of(-1, "at").alias("restart"), *[of(q, c).alias(f"{c}{q}") for q in rubric.QUESTIONS for c in ("value", "at")])
    later = lambda q: F.col("restart").isNull() | (F.col(f"at{q}") > F.col("restart"))
    return wide.select("respondent_id", *[F.when(later(q), F.col(f"value{q}")).alias(f"q{q}") for q in rubric.QUESTIONS])


def answers_side_by_side(answers: Column) -> dict[str, Column]:
    """q1 ... q15 from one request's answers (a VARIANT object by question id): its numbers as doubles; anything else is no answer.

    Only expressions over the row, so a request is scored where it is, without an exchange.
    """
    at = lambda q: F.try_variant_get(answers, f"$['{q}']", "variant")
    return {f"q{q}": F.when(F.schema_of_variant(at(q)).rlike(NUMBERS), F.try_variant_get(answers, f"$['{q}']", "double")) for q in rubric.QUESTIONS}


def _sum(of: list[Column], kind: str = "int") -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in of]).cast(kind)


def _answered(questions: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"q{q}").isNotNull().cast("int") for q in questions])


def summaries(answers: DataFrame) -> DataFrame:
    """One row per respondent: raw_score, percentage, band, answered, is_complete, categories and weakest.

    categories is an array of (ordinal, category_id, short_name, raw_score, percentage, status, answered) in rubric order, of every
    category, answered or not; weakest is its two lowest by (percentage, raw_score, ordinal). One shuffle; the rest are projections.
    """
    return summaries_of(wide_answers(answers))


def summaries_of(wide: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Summaries of answers that stand side by side (respondent_id, q1 ... q15), with wide's other columns after them if keep names them.

    Raw scores are whole numbers, or doubles where the answers are.
    """
    each, kind = [], "double" if dict(wide.dtypes)["q1"] == "double" else "int"
    for k, (name, short) in enumerate(rubric.CATEGORIES, 1):
        raw = _sum([F.col(f"q{q}") for q in rubric.questions_of(k)], kind)
        pct = percent(raw, rubric.MAX_CATEGORY)
        fields = {"ordinal": F.lit(k), "category_id": F.lit(name), "short_name": F.lit(short), "raw_score": raw, "percentage": pct, "status": status(pct), "answered": _answered(rubric.questions_of(k))}
        each.append(F.struct(*[v.alias(n) for n, v in fields.items()]))
    wide = wide.withColumn("categories", F.array(*each)).withColumn("raw_score", _sum([F.col(f"q{q}") for q in rubric.QUESTIONS], kind))
    by_score = F.array_sort(F.transform("categories", lambda c: F.struct(c["percentage"].alias("p"), c["raw_score"].alias("r"), c["ordinal"].alias("o"), c.alias("c"))))
    pct = percent(F.col("raw_score"), rubric.MAX_TOTAL)
    return wide.select(
        "respondent_id", "raw_score", pct.alias("percentage"), band(pct).alias("band"), _answered(rubric.QUESTIONS).alias("answered"),
        (_answered(rubric.QUESTIONS) == len(rubric.QUESTIONS)).alias("is_complete"), "categories", F.transform(F.slice(by_score, 1, 2), lambda x: x["c"]).alias("weakest"), *keep,
    )


def category_rows(summary: DataFrame) -> DataFrame:
    """One row per respondent and category, with its place among the weakest (1, 2 or null)."""
    rows = summary.select("respondent_id", "weakest", F.explode("categories").alias("c"))
    place = F.nullif(F.array_position(F.transform("weakest", lambda w: w["category_id"]), F.col("c.category_id")), F.lit(0)).cast("int")
    return rows.select("respondent_id", "c.*", place.alias("weakest_rank"))


def event_payload(summary: DataFrame) -> DataFrame:
    """The seven scalars that score events carry."""
    at = lambda k, f: F.get("weakest", F.lit(k))[f]
    return summary.select(
        "respondent_id", "raw_score", "percentage", "band", at(0, "short_name").alias("weakest_1"), at(0, "percentage").alias("weakest_1_percentage"),
        at(1, "short_name").alias("weakest_2"), at(1, "percentage").alias("weakest_2_percentage"),
    )


def quarantine(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers within the scale, and the others: known questions and values of 0 to the highest answer, or null."""
    good = F.col("question_id").isin(*rubric.QUESTIONS) & F.coalesce(F.col("value").between(0, rubric.MAX_ANSWER), F.lit(True))
    return answers.where(good), answers.where(~good)


def audit(claimed: DataFrame, summary: DataFrame) -> DataFrame:
    """Claimed percentages (respondent_id, percentage) beside those computed from answers; null where there are no answers."""
    own = summary.select("respondent_id", F.col("percentage").alias("computed"))
    return claimed.join(own, "respondent_id", "left").withColumn("agrees", F.col("percentage") == F.col("computed"))


def recomputed(accepted: DataFrame) -> DataFrame:
    """Each parsed submission (k, answers, percentage) scored by its own answers, beside what it claims: (k, raw_score, percentage, band, answered,
    is_complete, claimed, agrees). No answers at all score 0. Nothing is joined or dealt."""
    wide = accepted.select(F.col("k").alias("respondent_id"), F.col("percentage").alias("claimed"), F.inline(F.array(F.struct(*[x.alias(n) for n, x in answers_side_by_side(F.col("answers")).items()]))))
    found = summaries_of(wide, ("claimed",))
    return found.select(F.col("respondent_id").alias("k"), "raw_score", "percentage", "band", "answered", "is_complete", "claimed", (F.col("claimed") == F.col("percentage")).alias("agrees"))


def weakest_ids(summary: DataFrame) -> DataFrame:
    """The ids of each respondent's weakest categories, weakest first."""
    return summary.select("respondent_id", F.transform("weakest", lambda w: w["category_id"]).alias("weakest_ids"))


def score_labels(summary: DataFrame) -> DataFrame:
    return summary.select("respondent_id", total_label(F.col("raw_score")).alias("total_label"), percent_label(F.col("percentage")).alias("percent_label"))
