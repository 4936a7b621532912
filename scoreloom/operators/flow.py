"""Progress, presentation, views and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom import rubric
from scoreloom.functions.rules import icon, is_filled, moment, percent, severity


def progress(summary: DataFrame) -> DataFrame:
    return summary.select("respondent_id", "answered", percent(F.col("answered"), len(rubric.QUESTIONS)).alias("progress_pct"), "is_complete")


def category_progress(categories: DataFrame) -> DataFrame:
    total = F.lit(rubric.PER_CATEGORY)
    return categories.select("respondent_id", "category_id", "answered", total.alias("total"), (F.col("answered") == total).alias("is_done"))


def flags(categories: DataFrame) -> DataFrame:
    return categories.select(
        "respondent_id", "category_id", F.col("weakest_rank").isNotNull().alias("is_weakest"), severity(F.col("status")).alias("severity"), icon(F.col("status")).alias("icon"),
        F.concat("raw_score", F.lit(f"/{rubric.MAX_CATEGORY}")).alias("label"),
    )


def recommendation(summary: DataFrame) -> DataFrame:
    """A line that names the two weakest categories in lower case."""
    name = lambda k: F.lower(F.get("weakest", F.lit(k))["short_name"])
    return summary.select("respondent_id", F.concat(F.lit("Focus first on "), name(0), F.lit(" and then on "), name(1), F.lit(".")).alias("text"))


def next_view(state: DataFrame) -> DataFrame:
    """state (is_complete, unlocked) with next_view: results for who is done and unlocked, email for who is done, else questions."""
    return state.withColumn("next_view", F.when(F.col("is_complete") & F.col("unlocked"), "results").when(F.col("is_complete"), "email").otherwise("questions"))


def step(state: DataFrame) -> DataFrame:
    """state (step from 0, answered_current, is_complete, unlocked) with where Back and Next lead, and which buttons are off."""
    last = F.col("step") >= len(rubric.QUESTIONS) - 1
    done = F.when(F.col("unlocked"), "results").otherwise("email")
    return state.withColumns(
        {
            "back_step": F.greatest(F.lit(0), F.col("step") - 1), "next_step": F.when(F.col("answered_current") & ~last, F.col("step") + 1).otherwise(F.col("step")),
            "view_after_next": F.when(F.col("answered_current") & last & F.col("is_complete"), done).otherwise("questions"),
            "back_off": F.col("step") == 0, "next_off": ~F.col("answered_current"), "label": F.concat_ws(" of ", F.col("step") + 1, F.lit(len(rubric.QUESTIONS))),
        }
    )


def with_email_flag(state: DataFrame) -> DataFrame:
    return state.withColumn("has_email", is_filled(F.col("email")))


def runs(log: DataFrame, is_restart) -> DataFrame:
    """log (respondent_id, ts, event_id) with run: how many restarts its respondent made up to and with the row.

    Each row needs its respondent's restarts before it, so a respondent's rows are sorted in one task: its largest one is as long as the most
    active respondent is. streaming.respondents.live_views keeps the count as state instead.
    """
    order = Window.partitionBy("respondent_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("run", F.coalesce(F.sum(is_restart.cast("long")).over(order), F.lit(0)))


def once_per_run(log: DataFrame, is_view) -> DataFrame:
    """The first view of each respondent and run."""
    return log.where(is_view).groupBy("respondent_id", "run").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def rows_since_restart(log: DataFrame, is_restart) -> DataFrame:
    """(respondent_id, run, n): each respondent's restarts, and rows from the last of these on, with it; all rows if there was none.

    The last restart is found by an aggregation that tasks begin before rows are dealt, and so are the counts of later rows: no history is
    ordered, and a respondent with very many rows is no task's.
    """
    rows = log.select("respondent_id", moment(F.col("ts"), F.col("event_id")).alias("at"), is_restart.alias("is_restart"))
    last = rows.groupBy("respondent_id").agg(F.max(F.when(F.col("is_restart"), F.col("at"))).alias("restart"), F.count_if("is_restart").alias("run"))
    both = rows.groupBy("respondent_id", "at").agg(F.count("*").alias("n")).join(last, "respondent_id")
    return both.where("restart is null or at >= restart").groupBy("respondent_id", "run").agg(F.sum("n").alias("n"))


def _category_of(question: Column) -> Column:
    """The id of a question's category; null for questions that there aren't."""
    return F.get(F.array(*[F.lit(c[0]) for c in rubric.CATEGORIES]), F.when(question.isin(*rubric.QUESTIONS), F.floor((question - 1) / rubric.PER_CATEGORY).cast("int")).otherwise(-1))


def current_question(state: DataFrame) -> DataFrame:
    """state (step from 0) with question_id, its category_id, and the label of the step."""
    question = (F.col("step") + 1).cast("int")
    return state.withColumns({"question_id": question, "category_id": _category_of(question), "label": F.concat_ws(" of ", question, F.lit(len(rubric.QUESTIONS)))})


def active_categories(state: DataFrame) -> DataFrame:
    """A row per state (respondent_id, step) and category: is_active for that of the current question."""
    each = F.explode(F.array(*[F.lit(c[0]) for c in rubric.CATEGORIES])).alias("category")
    return current_question(state).select("respondent_id", "category_id", each).select("respondent_id", "category", F.coalesce(F.col("category") == F.col("category_id"), F.lit(False)).alias("is_active"))


def options(latest: DataFrame) -> DataFrame:
    """A row per latest answer and option of the scale: is_selected for the one that was chosen."""
    each = F.explode(F.sequence(F.lit(0), F.lit(rubric.MAX_ANSWER))).alias("option")
    return latest.select("respondent_id", "question_id", "value", each).select("respondent_id", "question_id", "option", F.coalesce(F.col("option") == F.col("value"), F.lit(False)).alias("is_selected"))


def states(log: DataFrame) -> DataFrame:
    """(respondent_id, email, discord, unlocked, has_email) as each respondent left it; log has is_submit and is_restart, email and discord.

    A submission sets them and unlocks, whether it was delivered or not; a restart clears them; the later of the two counts.
    """
    at = F.struct("ts", "event_id")
    last = log.groupBy("respondent_id").agg(F.max(F.when(F.col("is_submit"), F.struct("ts", "event_id", "email", "discord"))).alias("s"), F.max(F.when(F.col("is_restart"), at)).alias("r"))
    on = F.coalesce(F.col("s").isNotNull() & (F.col("r").isNull() | (F.struct("s.ts", "s.event_id") > F.col("r"))), F.lit(False))
    held = last.select("respondent_id", F.when(on, F.col("s.email")).alias("email"), F.when(on, F.col("s.discord")).alias("discord"), on.alias("unlocked"))
    return with_email_flag(held)


def saved(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """stored (respondent_id, answers, email, discord, unlocked) after changes, of which there is one row per respondent at most.

    answers and unlocked are overwritten on each change; a blank email or discord isn't written, so the stored one stays.
    """
    names = ("answers", "email", "discord", "unlocked")
    new = changes.select("respondent_id", F.lit(True).alias("_changed"), *[F.col(n).alias(f"_{n}") for n in names])
    both = stored.join(new, "respondent_id", "full")
    write = lambda n: F.when(F.col("_changed") & (is_filled(F.col(f"_{n}")) if n in ("email", "discord") else F.lit(True)), F.col(f"_{n}")).otherwise(F.col(n)).alias(n)
    return both.select("respondent_id", *map(write, names))


def submit_guard(form: DataFrame) -> DataFrame:
    """form (is_submitting) with submit_off: the button is off while a submission is on its way."""
    return form.withColumn("submit_off", F.coalesce("is_submitting", F.lit(False)))
