"""The questionnaire's fixed values: categories, questions, bands, statuses, as plain data and as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Ids, order, short labels, ranges and titles that results are made of.
CATEGORIES = (
    ("acquisition", "Acquisition"),
    ("activation", "Activation"),
    ("monetisation", "Monetisation"),
    ("measurement", "Measurement"),
    ("compounding", "Compounding"),
)
BANDS = (
    (0, 39, "Critical Revenue Leakage"),
    (40, 59, "Growth Is Leaking in Multiple Places"),
    (60, 74, "Promising but Not Yet Scale-Ready"),
    (75, 89, "Strong Foundation, Optimisation Opportunity"),
    (90, 100, "Revenue System Is Mature"),
)
STATUSES = ((39, "Severe leak"), (59, "Active leak"), (74, "Moderate leak"), (89, "Minor leak"))
BEST_STATUS = "Strong"
PER_CATEGORY = 3
MAX_ANSWER = 4
EVENTS = (
    "scorecard_started", "question_answered", "scorecard_completed", "email_submitted", "results_viewed",
    "scorecard_restarted", "summary_print_clicked", "audit_cta_clicked", "roadmap_cta_clicked",
)

QUESTIONS = tuple(range(1, PER_CATEGORY * len(CATEGORIES) + 1))
MAX_TOTAL = MAX_ANSWER * len(QUESTIONS)
MAX_CATEGORY = MAX_ANSWER * PER_CATEGORY


def questions_of(ordinal: int) -> tuple[int, ...]:
    return QUESTIONS[(ordinal - 1) * PER_CATEGORY : ordinal * PER_CATEGORY]


def categories(spark: SparkSession) -> DataFrame:
    rows = [(k, *c, PER_CATEGORY) for k, c in enumerate(CATEGORIES, 1)]
    return spark.createDataFrame(rows, "ordinal int, category_id string, short_name string, questions int")


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BANDS), "min int, max int, title string")
