"""Scores by rubrics that are tables: several versions of questions, categories and bands in one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom import rubric
from scoreloom.functions.rules import percent_of

QUESTIONS = "rubric_version int, question_id int, category_id string, ordinal int, max_value int"
BANDS = "rubric_version int, min int, max int, title string"


def standard(spark: SparkSession, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """The questions and bands of the fixed rubric as tables."""
    rows = [(version, q, c[0], k, rubric.MAX_ANSWER) for k, c in enumerate(rubric.CATEGORIES, 1) for q in rubric.questions_of(k)]
    return spark.createDataFrame(rows, QUESTIONS), spark.createDataFrame([(version, *b) for b in rubric.BANDS], BANDS)


def faults(bands: DataFrame) -> DataFrame:
    """(rubric_version, min, fault) of bands that end before they begin, overlap the one below, leave a gap to it, or don't span 0 to 100."""
    order = Window.partitionBy("rubric_version").orderBy("min", "max")
    below, is_last = F.lag("max").over(order), F.lead("min").over(order).isNull()
    fault = (
        F.when(F.col("max") < F.col("min"), "empty").when(F.coalesce(below, F.lit(-1)) >= F.col("min"), "overlap").when(F.coalesce(below, F.lit(-1)) + 1 < F.col("min"), "gap")
        .when(is_last & (F.col("max") != 100), "end")
    )
    return bands.withColumn("fault", fault).where("fault is not null").select("rubric_version", "min", "fault")


def by_percent(bands: DataFrame) -> DataFrame:
    """(rubric_version, percentage, band): the band of each whole percentage from 0 to 100, so that looking one up is an equality join; the
    first that holds it, and the version's first band for those that none holds."""
    low = F.struct("min", "max")
    grid = bands.groupBy("rubric_version").agg(F.min_by("title", low).alias("first")).withColumn("percentage", F.explode(F.sequence(F.lit(0), F.lit(100))))
    held = bands.select("rubric_version", "title", low.alias("low"), F.explode(F.sequence(F.greatest("min", F.lit(0)), F.least("max", F.lit(100)))).alias("percentage"))
    found = held.groupBy("rubric_version", "percentage").agg(F.min_by("title", "low").alias("title"))
    return grid.join(found, ["rubric_version", "percentage"], "left").select("rubric_version", "percentage", F.coalesce("title", "first").alias("band"))


def scores(latest: DataFrame, questions: DataFrame, bands: DataFrame) -> DataFrame:
    """(respondent_id, rubric_version, raw_score, max_score, percentage, band, answered, is_complete, category_percentages) of each respondent.

    latest: respondent_id, rubric_version, question_id, value, the latest answer of each question. Each is scored by the questions and bands of
    its own version: questions of other versions don't count, a category has the sum of its questions, answered or not, and
    category_percentages lists (ordinal, category_id, percentage) in order. Respondents of a version without questions are left out.

    Bands must be sound: a ValueError names versions with a gap or an overlap. Rubrics have some hundred rows a version and are joined by
    equality; answers are dealt once, by respondent and version.
    """
    odd = faults(bands).limit(20).collect()
    if odd:
        raise ValueError(f"bands with faults: {', '.join(f'{r.fault} at {r.min} of version {r.rubric_version}' for r in odd)}")
    each = questions.groupBy("rubric_version", "ordinal", "category_id").agg(F.sum("max_value").alias("most"), F.count("*").alias("n"))
    whole = each.groupBy("rubric_version").agg(F.array_sort(F.collect_list(F.struct("ordinal", "category_id", "most"))).alias("categories"), F.sum("most").cast("int").alias("max_score"), F.sum("n").alias("questions"))
    known = latest.join(questions.select("rubric_version", "question_id", "ordinal"), ["rubric_version", "question_id"], "left")
    counts = F.col("ordinal").isNotNull() & F.col("value").isNotNull()
    one = known.groupBy("respondent_id", "rubric_version").agg(
        F.collect_list(F.when(counts, F.struct("ordinal", "value"))).alias("given"), F.coalesce(F.sum(F.when(counts, F.col("value"))), F.lit(0)).cast("int").alias("raw_score"), F.count_if(counts).cast("int").alias("answered")
    )
    own = lambda c: F.aggregate(F.filter("given", lambda g: g["ordinal"] == c["ordinal"]), F.lit(0), lambda a, g: a + g["value"].cast("int"))
    listed = F.transform("categories", lambda c: F.struct(c["ordinal"].alias("ordinal"), c["category_id"].alias("category_id"), percent_of(own(c), c["most"]).alias("percentage")))
    found = one.join(whole, "rubric_version").withColumn("percentage", percent_of(F.col("raw_score"), F.col("max_score")))
    found = found.withColumns({"category_percentages": listed, "is_complete": F.col("answered") == F.col("questions")})
    return found.join(by_percent(bands), ["rubric_version", "percentage"], "left").select(
        "respondent_id", "rubric_version", "raw_score", "max_score", "percentage", "band", "answered", "is_complete", "category_percentages"
    )
