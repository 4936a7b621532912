"""The registered queries and, where it can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom import rubric
from scoreloom.operators import capture, flow, replay, rubrics, scoring
from scoreloom.sources import inputs


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.answers_from_events(inputs.table(spark, sf_dir, "events"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summaries(_answers(spark, sf_dir))


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.category_rows(_summaries(spark, sf_dir))


def latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.latest_answers(_answers(spark, sf_dir))


def total_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir).select("respondent_id", "raw_score", "percentage", "band")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.progress(_summaries(spark, sf_dir))


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(spark, sf_dir).select("respondent_id", "category_id", "raw_score", "percentage", "status")


def category_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.category_progress(_categories(spark, sf_dir))


def weakest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(spark, sf_dir).where("weakest_rank is not null").select("respondent_id", F.col("weakest_rank").alias("rnk"), "category_id", "percentage")


def weakest_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flags(_categories(spark, sf_dir))


def score_event_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.event_payload(_summaries(spark, sf_dir))


def recommendation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.recommendation(_summaries(spark, sf_dir))


def next_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondents with an even id have unlocked their results."""
    state = _summaries(spark, sf_dir).select("respondent_id", "is_complete", (F.col("respondent_id") % 2 == 0).alias("unlocked"))
    return flow.next_view(state)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors stand for restarts, views for results views."""
    events = inputs.table(spark, sf_dir, "events").select(F.col("user_id").alias("respondent_id"), "ts", "event_id", "event_type")
    return flow.runs(events, F.col("event_type") == "error")


def results_viewed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.once_per_run(_log(spark, sf_dir), F.col("event_type") == "view")


def events_since_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events").select(F.col("user_id").alias("respondent_id"), "ts", "event_id", "event_type")
    return flow.rows_since_restart(events, F.col("event_type") == "error")


def utm_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.parameter_rows(inputs.table(spark, sf_dir, "pages"))


def first_last_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.touches(inputs.table(spark, sf_dir, "events"))


def _submissions(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """spread: whether the customers' keys, of each of which a body is made and parsed, are dealt over tasks first; else no exchange is made."""
    keys = inputs.table(spark, sf_dir, "customer").select("c_custkey")
    return capture.validate_submissions(inputs.parse_requests(inputs.submissions_from_customers(inputs.spread(keys) if spread else keys)))


def submission_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _submissions(spark, sf_dir).select("k", "reject_reason", "status_code")


def _at() -> Column:
    """The records' timestamp here, so that reruns agree."""
    return F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")


def submission_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.flat_submissions(_submissions(spark, sf_dir, spread=False).where("reject_reason is null"), _at())


def submission_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.submission_records(_submissions(spark, sf_dir).where("reject_reason is null"), _at())


def submission_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = _submissions(spark, sf_dir).where("reject_reason is null").select(F.col("k").alias("respondent_id"), "percentage")
    return scoring.audit(claimed, _summaries(spark, sf_dir))


def _answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each customer with answers of its own: question q has (k * q + q) % 5 unless (k + q) % 7 = 0; question 3 half a point more for
    k % 6 = 0, question 5 as text for k % 10 = 1; no answers at all for k % 9 = 4. The claim is k % 101, a quarter more for k % 4 = 0."""
    k = F.col("c_custkey")
    value = lambda q: F.when((q == 5) & (k % 10 == 1), F.lit('"4"')).otherwise(F.concat(((k * q + q) % 5).cast("string"), F.when((q == 3) & (k % 6 == 0), F.lit(".5")).otherwise(F.lit(""))))
    fields = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda q: F.when((k + q) % 7 != 0, F.concat(F.lit('"'), q.cast("string"), F.lit('":'), value(q))))
    answers = F.when(k % 9 == 4, F.lit("")).otherwise(F.concat(F.lit(',"answers":{'), F.concat_ws(",", fields), F.lit("}")))
    claim = F.concat((k % 101).cast("string"), F.when(k % 4 == 0, F.lit(".25")).otherwise(F.lit("")))
    body = F.concat(F.lit('{"email":"a@b.c","discordUsername":"d","summary":{"percentage":'), claim, F.lit(',"band":{"title":"t"},"weakestCategories":[],"categoryScores":[]}'), answers, F.lit("}"))
    return capture.validate_submissions(inputs.parse_requests(inputs.table(spark, sf_dir, "customer").select(k.alias("k"), body.alias("value"))))


def submission_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.recomputed(_answered_requests(spark, sf_dir).where("reject_reason is null"))


def _event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a request: errors have an empty name, event_id % 7 = 0 a number, views no payload, % 3 = 0 a context."""
    e = F.col("event_id")
    name = F.when(F.col("event_type") == "error", F.lit('""')).when(e % 7 == 0, e.cast("string")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    payload = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.concat(F.lit(',"payload":'), "props"))
    context = F.when(e % 3 == 0, F.lit(',"trackingContext":{"sessionId":"s"}')).otherwise(F.lit(""))
    headers = F.create_map(F.lit("user-agent"), F.lit("agent"))
    rows = inputs.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"eventName":'), name, payload, context, F.lit("}")).alias("value"), headers.alias("headers"))
    return inputs.parse_requests(rows)


def event_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_requests(spark, sf_dir).select("event_id", F.col("has_event_name").alias("accepted"))


def event_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.event_records(_event_requests(spark, sf_dir).where("has_event_name"), "event_id", _at())


def visitor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is visited by the user of the event with its number."""
    pages = inputs.table(spark, sf_dir, "pages").select(F.col("page_id").alias("event_id"), "url")
    visits = inputs.table(spark, sf_dir, "events").select("event_id", "user_id", "ts").join(pages, "event_id").withColumn("referrer", F.lit(None).cast("string"))
    return capture.contexts(visits).withColumn("utm_source", F.coalesce(F.try_element_at("utm", F.lit("utm_source")), F.lit(""))).drop("utm")


def visitor_context_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As visitor_context, but users with an even id have a context from before, those divisible by 10 an unreadable one; so do users 100000 and 100002, who have no visit."""
    pages = inputs.table(spark, sf_dir, "pages").select(F.col("page_id").alias("event_id"), "url")
    events = inputs.table(spark, sf_dir, "events")
    visits = events.select("event_id", "user_id", "ts").join(pages, "event_id").withColumn("referrer", F.concat(F.lit("http://from/"), F.col("event_id").cast("string")))
    u = F.col("user_id").cast("string")
    body = F.concat(F.lit('{"sessionId":"old'), u, F.lit('","firstSeenAt":"2020-01-01T00:00:00.000Z","landingPage":"/old","currentPage":"/was","referrer":"","utm":{"utm_source":"s'), u, F.lit('"}}'))
    users = events.select("user_id").distinct().union(spark.range(100000, 100004, 2).toDF("user_id")).where("user_id % 2 = 0")
    stored = users.select("user_id", F.when(F.col("user_id") % 10 == 0, F.when(F.col("user_id") == 100000, body).otherwise(F.lit("{"))).otherwise(body).alias("stored"))
    return capture.contexts_with_stored(visits, stored).withColumn("utm_source", F.coalesce(F.try_element_at("utm", F.lit("utm_source")), F.lit(""))).drop("utm")


def scores_by_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondents with an odd id are scored by version 2: categories of the first ten questions only, two in each, and three bands."""
    questions, bands = rubrics.standard(spark)
    second = spark.createDataFrame([(2, q, f"c{(q + 1) // 2}", (q + 1) // 2, rubric.MAX_ANSWER) for q in range(1, 11)], rubrics.QUESTIONS)
    low = spark.createDataFrame([(2, 0, 33, "low"), (2, 34, 66, "middle"), (2, 67, 100, "high")], rubrics.BANDS)
    latest = latest_answers(spark, sf_dir).withColumn("rubric_version", (F.col("respondent_id") % 2 + 1).cast("int"))
    found = rubrics.scores(latest, questions.union(second), bands.union(low))
    listed = F.concat_ws(",", F.transform("category_percentages", lambda c: F.concat(c["category_id"], F.lit(":"), c["percentage"].cast("string"))))
    return found.withColumn("category_percentages", listed)


def _restart_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors stand for restarts, purchases for submissions; other events are answers."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return inputs.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("respondent_id"), (F.col("event_id") % 15 + 1).cast("int").alias("question_id"), (k % 5).cast("int").alias("value"), "ts", "event_id",
        (F.col("event_type") == "error").alias("is_restart"), (F.col("event_type") == "purchase").alias("is_submit"),
    )


def total_scores_since_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _restart_log(spark, sf_dir).where("not is_submit")
    return scoring.summaries_of(scoring.answers_since_restart(log)).select("respondent_id", "raw_score", "percentage", "band", "answered")


def respondent_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _restart_log(spark, sf_dir).withColumn("email", F.concat(F.lit("e"), F.col("event_id").cast("string"))).withColumn("discord", F.lit("d"))
    return flow.states(log)


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a respondent did, by event_id % 20: 0 restart, 1 home, 2 and 3 submit, 4 back, 5 and 6 start, else an answer and Next, or at % 20 = 7 Next alone."""
    kind, k = F.col("event_id") % 20, F.get_json_object("props", "$.k").try_cast("bigint")
    one = lambda name: F.array(F.lit(name))
    actions = F.when(kind == 0, one("restart")).when(kind == 1, one("home")).when(kind < 4, one("submit")).when(kind == 4, one("back")).when(kind < 7, one("start")).when(kind == 7, one("next"))
    both = F.coalesce(actions, F.array(F.lit("answer"), F.lit("next")))
    rows = inputs.table(spark, sf_dir, "events").select(F.col("user_id").alias("respondent_id"), "ts", "event_id", (k % 5).cast("int").alias("value"), F.posexplode(both).alias("seq", "action"))
    return rows.select("respondent_id", "ts", "event_id", "seq", "action", "value")


def final_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.final_states(action_log(spark, sf_dir))


def active_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current step is the number of questions answered, the last one if all are."""
    state = _summaries(spark, sf_dir).select("respondent_id", F.least("answered", F.lit(len(rubric.QUESTIONS) - 1)).alias("step"))
    return flow.active_categories(state)


def current_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _summaries(spark, sf_dir).select("respondent_id", F.least("answered", F.lit(len(rubric.QUESTIONS) - 1)).alias("step"))
    return flow.current_question(state)


def question_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.options(latest_answers(spark, sf_dir))


def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_labels(_summaries(spark, sf_dir))


def weakest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.weakest_ids(_summaries(spark, sf_dir)).withColumn("weakest_ids", F.concat_ws(",", "weakest_ids"))


def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event per click as JSON."""
    rows = flow.current_question(_answers(spark, sf_dir).select("event_id", "value", (F.col("question_id") - 1).alias("step")))
    rows = rows.select("event_id", "question_id", F.col("category_id").alias("category"), (F.col("step") + 1).alias("step"), F.col("value"))
    return capture.envelopes(rows.withColumnRenamed("value", "answer"), F.lit(rubric.EVENTS[1]), capture.event_payload_of(rubric.EVENTS[1]) | {"value": F.col("answer")}).select("event_id", "value")


def cta_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click on the results' call to action for each respondent; those with an odd id gave an email."""
    rows = scoring.event_payload(_summaries(spark, sf_dir)).withColumns({"has_email": F.col("respondent_id") % 2 == 1, "location": F.lit("results"), "destination": F.lit("/audit")})
    return capture.envelopes(rows, F.lit("audit_cta_clicked"), capture.event_payload_of("audit_cta_clicked")).select("respondent_id", "value")


def band_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir).groupBy("band").agg(F.count("*").alias("respondents"), F.min("percentage").alias("min_pct"), F.max("percentage").alias("max_pct"))


def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def weakest_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(spark, sf_dir).where("weakest_rank = 1").groupBy("category_id").agg(F.count("*").alias("n"))


def attribution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by campaign source and medium."""
    return capture.attribution(inputs.table(spark, sf_dir, "pages")).groupBy("utm_source", "utm_medium").agg(F.count("*").alias("n"))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested summaries as JSON."""
    return _summaries(spark, sf_dir).select("respondent_id", F.to_json(F.struct("raw_score", "percentage", "band", "answered", "is_complete", "categories", "weakest")).alias("summary"))


def event_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each respondent's score event as JSON."""
    rows = scoring.event_payload(_summaries(spark, sf_dir))
    context = F.to_variant_object(F.struct(F.concat(F.lit("session_"), F.col("respondent_id").cast("string")).alias("sessionId")))
    return capture.envelopes(rows, F.lit(rubric.EVENTS[2]), capture.score_payload(), context).select("respondent_id", "value")


QUERIES = {
    f.__name__: f
    for f in (
        latest_answers, total_scores, completeness, category_scores, category_progress, weakest_two, weakest_flags, score_event_payload, recommendation_text,
        next_view, results_viewed_once, events_since_restart, utm_params, first_last_touch, submission_outcome, submission_flat, submission_audit, event_accept,
        band_distribution, status_distribution, weakest_ranking, attribution_report, score_summary, event_envelopes, submission_record, event_record, visitor_context, total_scores_since_restart, respondent_state,
        final_view, submission_recomputed, visitor_context_stored, scores_by_rubric, active_category, current_question, question_options, score_labels, weakest_ids, answer_events, cta_events,
    )
}


def _case(column: str) -> tuple[str, str]:
    bands = " ".join(f"WHEN {column} BETWEEN {a} AND {b} THEN '{t}'" for a, b, t in rubric.BANDS)
    statuses = " ".join(f"WHEN {column} <= {a} THEN '{t}'" for a, t in rubric.STATUSES)
    return f"CASE {bands} ELSE '{rubric.BANDS[0][2]}' END", f"CASE {statuses} ELSE '{rubric.BEST_STATUS}' END"


_CATEGORIES = ", ".join(f"({k}, '{i}', '{s}')" for k, (i, s) in enumerate(rubric.CATEGORIES, 1))
_BASE = f"""
WITH RECURSIVE log AS (
  SELECT user_id AS respondent_id, CAST(event_id % 15 + 1 AS INT) AS question_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS INT) AS value,
         row_number() OVER (PARTITION BY user_id, event_id % 15 ORDER BY ts DESC, event_id DESC) AS nth FROM events
), latest AS (SELECT respondent_id, question_id, value FROM log WHERE nth = 1),
cats(ordinal, category_id, short_name) AS (VALUES {_CATEGORIES}),
totals AS (
  SELECT respondent_id, CAST(coalesce(sum(value), 0) AS INT) AS raw_score, CAST(floor(coalesce(sum(value), 0) / 60.0 * 100 + 0.5) AS INT) AS percentage,
         CAST(count(value) AS INT) AS answered FROM latest GROUP BY respondent_id
), tot AS (SELECT *, {_case("percentage")[0]} AS band FROM totals),
sums AS (
  SELECT t.respondent_id, c.ordinal, c.category_id, c.short_name, CAST(coalesce(sum(l.value), 0) AS INT) AS raw_score, CAST(count(l.value) AS INT) AS answered
  FROM totals t CROSS JOIN cats c LEFT JOIN latest l ON l.respondent_id = t.respondent_id AND (l.question_id - 1) // 3 + 1 = c.ordinal
  GROUP BY ALL
), pct AS (SELECT *, CAST(floor(raw_score / 12.0 * 100 + 0.5) AS INT) AS percentage FROM sums),
cat AS (
  SELECT *, {_case("percentage")[1]} AS status, CAST(row_number() OVER (PARTITION BY respondent_id ORDER BY percentage, raw_score, ordinal) AS INT) AS rnk FROM pct
), pay AS (
  SELECT t.respondent_id, t.raw_score, t.percentage, t.band, a.short_name AS weakest_1, a.percentage AS weakest_1_percentage, b.short_name AS weakest_2, b.percentage AS weakest_2_percentage
  FROM tot t JOIN cat a ON a.respondent_id = t.respondent_id AND a.rnk = 1 JOIN cat b ON b.respondent_id = t.respondent_id AND b.rnk = 2
), sub AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'c' || c_custkey || '.example.com' WHEN c_custkey % 17 = 0 THEN '' ELSE 'c' || c_custkey || '@mail.example.com' END AS email,
         CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'user' || c_custkey END AS discord, CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 101 AS INT) END AS percentage FROM customer
), val AS (
  SELECT *, CASE WHEN NOT regexp_full_match(email, '[^@ ]+@[^@ ]+\\.[^@ ]+') THEN 'bad_email' WHEN discord = '' THEN 'bad_discord' WHEN percentage IS NULL THEN 'bad_summary'
                 WHEN k % 19 = 0 THEN 'malformed' END AS reject_reason FROM sub
), claim AS (
  SELECT k, ordinal, category_id, short_name, CAST((k + ordinal) % 13 AS INT) AS raw, CAST((k + ordinal) % 101 AS INT) AS pct FROM sub CROSS JOIN cats
), claims AS (SELECT *, {_case("pct")[1]} AS status FROM claim),
flat AS (
  SELECT v.k, 'scorecard_submission' AS type, email, discord AS "discordUsername", '2024-01-01T10:00:00.000Z' AS "submittedAt", CAST(v.k % 61 AS INT) AS "rawScore",
         v.percentage AS "scorePercentage", {_case("v.percentage")[0]} AS "resultBand", a.short_name AS "weakestCategoryOne", a.pct AS "weakestCategoryOneScore",
         CASE WHEN v.k % 5 = 0 THEN '' ELSE b.short_name END AS "weakestCategoryTwo", CASE WHEN v.k % 5 <> 0 THEN b.pct END AS "weakestCategoryTwoScore",
         CASE WHEN v.k % 3 <> 0 AND v.k % 2 = 0 THEN 's' || (v.k % 4) ELSE '' END AS "utmSource", '' AS "utmMedium", '' AS "utmCampaign", '' AS "utmContent", '' AS "utmTerm", '' AS referrer,
         CASE WHEN v.k % 3 <> 0 THEN '/start' ELSE '' END AS "landingPage", CASE WHEN v.k % 3 <> 0 THEN '/now' ELSE '' END AS "currentPage",
         CASE WHEN v.k % 3 <> 0 THEN 'session' || v.k ELSE '' END AS "sessionId"
  FROM val v JOIN claims a ON a.k = v.k AND a.ordinal = 1 JOIN claims b ON b.k = v.k AND b.ordinal = 2 WHERE reject_reason IS NULL
), runs AS (
  SELECT user_id AS respondent_id, ts, event_id, event_type,
         CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM events
), params AS (
  SELECT page_id, unnest(string_split(regexp_extract(url, '^[^#?]*\\?([^#]*)', 1), '&')) AS p FROM pages
), utm AS (
  SELECT page_id, split_part(p, '=', 1) AS utm_key, regexp_replace(p, '^[^=]*=?', '') AS utm_value FROM params WHERE p LIKE 'utm\\_%' ESCAPE '\\' OR split_part(p, '=', 1) IN ('gclid', 'fbclid')
)
"""
_STATUS_LEVEL = " ".join(f"WHEN status = '{t}' THEN {len(rubric.STATUSES) - k}" for k, (_, t) in enumerate(rubric.STATUSES))

_FLAT = """'"email":"' || email || '","discordUsername":"' || "discordUsername" || '","submittedAt":"' || "submittedAt" || '","rawScore":' || "rawScore" || ',"scorePercentage":' || "scorePercentage" ||
    ',"resultBand":"' || "resultBand" || '","weakestCategoryOne":"' || "weakestCategoryOne" || '","weakestCategoryOneScore":' || "weakestCategoryOneScore" || ',"weakestCategoryTwo":"' || "weakestCategoryTwo" ||
    '","weakestCategoryTwoScore":' || coalesce(CAST("weakestCategoryTwoScore" AS VARCHAR), '""') || ',"utmSource":"' || "utmSource" || '","utmMedium":"","utmCampaign":"","utmContent":"","utmTerm":"","referrer":"","landingPage":"' ||
    "landingPage" || '","currentPage":"' || "currentPage" || '","sessionId":"' || "sessionId" || '"'"""
_CLAIM = """'{"id":"' || category_id || '","name":"' || short_name || '","shortName":"' || short_name || '"'"""
_PAY = """'"rawScore":' || raw_score || ',"percentage":' || percentage || ',"resultBand":"' || band || '","weakestCategoryOne":"' || weakest_1 || '","weakestCategoryOneScore":' || weakest_1_percentage ||
    ',"weakestCategoryTwo":"' || weakest_2 || '","weakestCategoryTwoScore":' || weakest_2_percentage"""
_CAT = """'{"ordinal":' || ordinal || ',"category_id":"' || category_id || '","short_name":"' || short_name || '","raw_score":' || c.raw_score || ',"percentage":' || c.percentage ||
    ',"status":"' || status || '","answered":' || c.answered || '}'"""

SQL = {
    name: _BASE + text
    for name, text in {
        "latest_answers": "SELECT * FROM latest",
        "total_scores": "SELECT respondent_id, raw_score, percentage, band FROM tot",
        "completeness": "SELECT respondent_id, answered, CAST(floor(answered / 15.0 * 100 + 0.5) AS INT) AS progress_pct, answered = 15 AS is_complete FROM tot",
        "category_scores": "SELECT respondent_id, category_id, raw_score, percentage, status FROM cat",
        "category_progress": "SELECT respondent_id, category_id, answered, CAST(3 AS INT) AS total, answered = 3 AS is_done FROM cat",
        "weakest_two": "SELECT respondent_id, rnk, category_id, percentage FROM cat WHERE rnk <= 2",
        "weakest_flags": f"""SELECT respondent_id, category_id, rnk <= 2 AS is_weakest, CAST(CASE {_STATUS_LEVEL} ELSE 0 END AS INT) AS severity,
            CASE status WHEN 'Strong' THEN 'check' WHEN 'Minor leak' THEN 'minor' ELSE 'alert' END AS icon, raw_score || '/12' AS label FROM cat""",
        "score_event_payload": "SELECT * FROM pay",
        "recommendation_text": "SELECT respondent_id, 'Focus first on ' || lower(weakest_1) || ' and then on ' || lower(weakest_2) || '.' AS text FROM pay",
        "next_view": """SELECT respondent_id, answered = 15 AS is_complete, respondent_id % 2 = 0 AS unlocked,
            CASE WHEN answered = 15 AND respondent_id % 2 = 0 THEN 'results' WHEN answered = 15 THEN 'email' ELSE 'questions' END AS next_view FROM tot""",
        "results_viewed_once": "SELECT respondent_id, run, arg_min(event_id, (ts, event_id)) AS event_id FROM runs WHERE event_type = 'view' GROUP BY ALL",
        "events_since_restart": "SELECT respondent_id, max(run) AS run, count(*) AS n FROM runs r WHERE run = (SELECT max(run) FROM runs x WHERE x.respondent_id = r.respondent_id) GROUP BY respondent_id",
        "utm_params": "SELECT * FROM utm",
        "first_last_touch": """SELECT user_id, min(ts) AS first_ts, arg_min(event_type, (ts, event_id)) AS first_event, arg_max(event_type, (ts, event_id)) AS last_event
            FROM events GROUP BY user_id""",
        "submission_outcome": "SELECT k, reject_reason, CAST(CASE WHEN reject_reason IS NULL THEN 202 ELSE 400 END AS INT) AS status_code FROM val",
        "submission_flat": """SELECT * REPLACE (CAST("rawScore" AS DOUBLE) AS "rawScore", CAST("scorePercentage" AS DOUBLE) AS "scorePercentage",
            CAST("weakestCategoryOneScore" AS DOUBLE) AS "weakestCategoryOneScore", CAST("weakestCategoryTwoScore" AS DOUBLE) AS "weakestCategoryTwoScore") FROM flat""",
        "submission_record": f"""SELECT k, '{{"type":"scorecard_submission",' || {_FLAT} || ',"fields":{{' || {_FLAT} || '}},"result":{{"rawScore":' || "rawScore" || ',"percentage":' || "scorePercentage"
            || ',"resultBand":"' || "resultBand" || '","weakestCategories":[' || w.x || '],"categoryScores":[' || c.x || ']}},"answers":' ||
            CASE WHEN k % 4 <> 0 THEN '{{"1":' || k % 5 || ',"2":4}}' ELSE '{{}}' END || ',"trackingContext":' || CASE WHEN k % 3 = 0 THEN 'null'
              ELSE '{{"currentPage":"/now","landingPage":"/start","referrer":"","sessionId":"session' || k || '"' || CASE WHEN k % 2 = 0 THEN ',"utm":{{"gclid":"g","utm_source":"s' || k % 4 || '"}}' ELSE '' END || '}}' END
            || ',"requestContext":' || CASE WHEN k % 2 = 0 THEN '{{"referrer":"","userAgent":"agent","country":"DE","region":"","city":""}}' ELSE '{{"referrer":"http://r","userAgent":"","country":"","region":"","city":""}}' END
            || ',"timestamp":"' || "submittedAt" || '"}}' AS value
            FROM flat JOIN (SELECT k, string_agg({_CLAIM} || ',"percentage":' || pct || ',"status":"' || status || '"}}', ',' ORDER BY ordinal) AS x FROM claims WHERE ordinal <= CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END GROUP BY k) w USING (k)
            JOIN (SELECT k, string_agg({_CLAIM} || ',"rawScore":' || raw || ',"percentage":' || pct || ',"status":"' || status || '"}}', ',' ORDER BY ordinal) AS x FROM claims GROUP BY k) c USING (k)""",
        "submission_audit": """SELECT k AS respondent_id, CAST(v.percentage AS DOUBLE) AS percentage, pay.percentage AS computed, v.percentage = pay.percentage AS agrees
            FROM val v LEFT JOIN pay ON pay.respondent_id = k WHERE reject_reason IS NULL""",
        "event_accept": "SELECT event_id, CASE WHEN event_type = 'error' THEN false WHEN event_id % 7 = 0 THEN event_id <> 0 ELSE event_type <> '' END AS accepted FROM events",
        "event_record": """SELECT event_id, '{"type":"scorecard_event","eventName":' || CASE WHEN event_id % 7 = 0 THEN CAST(event_id AS VARCHAR) ELSE '"' || event_type || '"' END || ',"payload":' ||
            CASE WHEN event_type = 'view' THEN '{}' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END || ',"trackingContext":' || CASE WHEN event_id % 3 = 0 THEN '{"sessionId":"s"}' ELSE 'null' END ||
            ',"requestContext":{"referrer":"","userAgent":"agent","country":"","region":"","city":""},"timestamp":"2024-01-01T10:00:00.000Z"}' AS value
            FROM events WHERE event_type <> 'error' AND (event_id % 7 <> 0 OR event_id <> 0)""",
        "visitor_context": """SELECT user_id, 'session_' || user_id AS "sessionId", strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "firstSeenAt", arg_min(url, (ts, event_id)) AS "landingPage",
            arg_max(url, (ts, event_id)) AS "currentPage", '' AS referrer, coalesce(arg_min(coalesce(utm_value, ''), (ts, event_id)), '') AS utm_source
            FROM events e JOIN pages p ON p.page_id = e.event_id LEFT JOIN utm u ON u.page_id = p.page_id AND utm_key = 'utm_source' GROUP BY user_id""",
        "total_scores_since_restart": f"""SELECT respondent_id, raw AS raw_score, pct AS percentage, {_case("pct")[0]} AS band, answered FROM (
            SELECT *, CAST(floor(raw / 60.0 * 100 + 0.5) AS INT) AS pct FROM (SELECT respondent_id, CAST(coalesce(sum(value), 0) AS INT) AS raw, CAST(count(value) AS INT) AS answered FROM (
              SELECT r.respondent_id, CASE WHEN is_answer AND run = max(run) OVER (PARTITION BY r.respondent_id) AND
                     row_number() OVER (PARTITION BY r.respondent_id, is_answer, question_id, run ORDER BY ts DESC, event_id DESC) = 1 THEN value END AS value
              FROM (SELECT *, event_type <> 'error' AS is_answer, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS INT) AS value, event_id % 15 AS question_id
                    FROM runs JOIN (SELECT event_id, props FROM events) USING (event_id) WHERE event_type <> 'purchase') r) GROUP BY respondent_id))""",
        "respondent_state": """SELECT respondent_id, CASE WHEN on_ THEN 'e' || s END AS email, CASE WHEN on_ THEN 'd' END AS discord, on_ AS unlocked, on_ AS has_email FROM (
            SELECT user_id AS respondent_id, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS s,
                   coalesce(max((ts, event_id)) FILTER (event_type = 'purchase') > coalesce(max((ts, event_id)) FILTER (event_type = 'error'), (TIMESTAMP '1900-01-01', 0::BIGINT)), false) AS on_ FROM events GROUP BY user_id)""",
        "final_view": """, actions AS (
              SELECT user_id AS who, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS INT) AS value, a.action,
                     row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, a.seq) AS n
              FROM (SELECT *, event_id % 20 AS m FROM events) JOIN (VALUES (0, 0, 0, 'restart'), (1, 1, 0, 'home'), (2, 3, 0, 'submit'), (4, 4, 0, 'back'), (5, 6, 0, 'start'),
                     (7, 7, 0, 'next'), (8, 19, 0, 'answer'), (8, 19, 1, 'next')) a(lo, hi, seq, action) ON m BETWEEN lo AND hi
            ), fold AS (
              SELECT DISTINCT who, 0::BIGINT AS n, 'landing' AS view, 0 AS step, list_transform(range(15), lambda i: NULL::INT) AS answers, false AS unlocked, false AS seen, 0::BIGINT AS completed, 0::BIGINT AS viewed FROM actions
              UNION ALL
              SELECT who, n, new_view, CASE WHEN again THEN 0 WHEN here AND action = 'back' THEN greatest(step - 1, 0) WHEN onward AND step < 14 THEN step + 1 ELSE step END,
                     CASE WHEN again THEN list_transform(range(15), lambda i: NULL::INT) WHEN here AND action = 'answer' THEN list_transform(range(15), lambda i: CASE WHEN i = step THEN value ELSE answers[i + 1] END) ELSE answers END,
                     NOT again AND (unlocked OR (view = 'email' AND action = 'submit')), NOT again AND (seen OR new_view = 'results'), completed + finished::BIGINT, viewed + (new_view = 'results' AND NOT seen)::BIGINT
              FROM (SELECT *, CASE WHEN action = 'home' OR again THEN 'landing' WHEN view = 'landing' AND action = 'start' THEN CASE WHEN NOT done THEN 'questions' WHEN unlocked THEN 'results' ELSE 'email' END
                              WHEN finished THEN CASE WHEN unlocked THEN 'results' ELSE 'email' END WHEN view = 'email' AND action = 'submit' THEN 'results' ELSE view END AS new_view
                    FROM (SELECT *, onward AND step = 14 AND done AS finished FROM (
                      SELECT f.who, a.n, view, step, answers, unlocked, seen, completed, viewed, action, value, view = 'questions' AS here, view = 'results' AND action = 'restart' AS again,
                             view = 'questions' AND action = 'next' AND answers[step + 1] IS NOT NULL AS onward, len(list_filter(answers, lambda x: x IS NULL)) = 0 AS done
                      FROM fold f JOIN actions a ON a.who = f.who AND a.n = f.n + 1)))
            ) SELECT who AS respondent_id, view, step, CAST(len(list_filter(answers, lambda x: x IS NOT NULL)) AS INT) AS answered, unlocked, completed, viewed AS results_viewed
              FROM fold QUALIFY n = max(n) OVER (PARTITION BY who)""",
        "submission_recomputed": f""", own AS (
              SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 4 OR (c_custkey + q) % 7 = 0 OR (q = 5 AND c_custkey % 10 = 1) THEN NULL
                     ELSE (c_custkey * q + q) % 5 + CASE WHEN q = 3 AND c_custkey % 6 = 0 THEN 0.5 ELSE 0 END END AS v FROM customer CROSS JOIN range(1, 16) t(q)
            ), raw AS (SELECT k, CAST(coalesce(sum(v), 0) AS DOUBLE) AS raw_score, CAST(count(v) AS INT) AS answered, (k % 101 + CASE WHEN k % 4 = 0 THEN 0.25 ELSE 0 END)::DOUBLE AS claimed FROM own GROUP BY k),
            p AS (SELECT *, CAST(floor(raw_score / 60 * 100 + 0.5) AS INT) AS percentage FROM raw)
            SELECT k, raw_score, percentage, {_case("percentage")[0]} AS band, answered, answered = 15 AS is_complete, claimed, claimed = percentage AS agrees FROM p""",
        "visitor_context_stored": """, old AS (
              SELECT user_id FROM (SELECT DISTINCT user_id FROM events UNION SELECT unnest([100000, 100002])) WHERE user_id % 2 = 0 AND (user_id % 10 <> 0 OR user_id = 100000)
            ), now AS (
              SELECT user_id, 'session_' || user_id AS s, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS f, arg_min(url, (ts, event_id)) AS l, arg_max(url, (ts, event_id)) AS c,
                     'http://from/' || arg_min(event_id, (ts, event_id)) AS r, coalesce(arg_min(coalesce(utm_value, ''), (ts, event_id)), '') AS u
              FROM events e JOIN pages p ON p.page_id = e.event_id LEFT JOIN utm x ON x.page_id = p.page_id AND utm_key = 'utm_source' GROUP BY user_id
            ) SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN s ELSE 'old' || o.user_id END AS "sessionId", CASE WHEN o.user_id IS NULL THEN f ELSE '2020-01-01T00:00:00.000Z' END AS "firstSeenAt",
                     CASE WHEN o.user_id IS NULL THEN l ELSE '/old' END AS "landingPage", coalesce(c, '/was') AS "currentPage", CASE WHEN o.user_id IS NULL THEN r ELSE '' END AS referrer,
                     CASE WHEN o.user_id IS NULL THEN u ELSE 's' || o.user_id END AS utm_source, o.user_id IS NOT NULL AS was_stored
              FROM now n FULL JOIN old o ON o.user_id = n.user_id""",
        "scores_by_rubric": f""", second AS (
              SELECT respondent_id, (question_id + 1) // 2 AS c, value FROM latest WHERE respondent_id % 2 = 1 AND question_id <= 10
            ), parts AS (
              SELECT t.respondent_id, c.c, CAST(coalesce(sum(value), 0) AS INT) AS raw, count(value) AS n FROM totals t CROSS JOIN range(1, 6) c(c) LEFT JOIN second s ON s.respondent_id = t.respondent_id AND s.c = c.c
              WHERE t.respondent_id % 2 = 1 GROUP BY ALL
            ), whole AS (
              SELECT respondent_id, CAST(sum(raw) AS INT) AS raw_score, CAST(floor(sum(raw) / 40.0 * 100 + 0.5) AS INT) AS percentage, CAST(sum(n) AS INT) AS answered,
                     string_agg('c' || c || ':' || CAST(floor(raw / 8.0 * 100 + 0.5) AS INT), ',' ORDER BY c) AS category_percentages FROM parts GROUP BY respondent_id
            )
            SELECT respondent_id, CAST(2 AS INT) AS rubric_version, raw_score, CAST(40 AS INT) AS max_score, percentage, CASE WHEN percentage <= 33 THEN 'low' WHEN percentage <= 66 THEN 'middle' ELSE 'high' END AS band,
                   answered, answered = 10 AS is_complete, category_percentages FROM whole
            UNION ALL
            SELECT respondent_id, CAST(1 AS INT), t.raw_score, CAST(60 AS INT), t.percentage, band, t.answered, t.answered = 15, string_agg(category_id || ':' || c.percentage, ',' ORDER BY ordinal)
            FROM tot t JOIN cat c USING (respondent_id) WHERE respondent_id % 2 = 0 GROUP BY respondent_id, t.raw_score, t.percentage, band, t.answered""",
        "active_category": "SELECT respondent_id, category_id AS category, ordinal = least(answered, 14) // 3 + 1 AS is_active FROM tot CROSS JOIN cats",
        "current_question": """SELECT respondent_id, least(answered, 14) AS step, least(answered, 14) + 1 AS question_id, category_id, (least(answered, 14) + 1) || ' of 15' AS label
            FROM tot JOIN cats ON ordinal = least(answered, 14) // 3 + 1""",
        "question_options": "SELECT respondent_id, question_id, CAST(o AS INT) AS option, coalesce(o = value, false) AS is_selected FROM latest CROSS JOIN range(5) t(o)",
        "score_labels": "SELECT respondent_id, raw_score || '/60' AS total_label, percentage || '%' AS percent_label FROM tot",
        "weakest_ids": "SELECT respondent_id, string_agg(category_id, ',' ORDER BY rnk) AS weakest_ids FROM cat WHERE rnk <= 2 GROUP BY respondent_id",
        "answer_events": """SELECT event_id, '{"eventName":"question_answered","payload":{"questionId":' || (event_id % 15 + 1) || ',"category":"' || category_id || '","step":' || (event_id % 15 + 1) || ',"value":' ||
            (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) || '},"trackingContext":null}' AS value FROM events JOIN cats ON ordinal = event_id % 15 // 3 + 1""",
        "event_envelopes": f"""SELECT respondent_id, '{{"eventName":"scorecard_completed","payload":{{' || {_PAY} || '}},"trackingContext":{{"sessionId":"session_' || respondent_id || '"}}}}' AS value FROM pay""",
        "cta_events": f"""SELECT respondent_id, '{{"eventName":"audit_cta_clicked","payload":{{' || {_PAY} || ',"hasEmail":' || (respondent_id % 2 = 1) || ',"location":"results","destination":"/audit"}},"trackingContext":null}}' AS value FROM pay""",
        "score_summary": f"""SELECT respondent_id, '{{"raw_score":' || t.raw_score || ',"percentage":' || t.percentage || ',"band":"' || band || '","answered":' || t.answered || ',"is_complete":' || (t.answered = 15) ||
            ',"categories":[' || string_agg({_CAT}, ',' ORDER BY ordinal) || '],"weakest":[' || string_agg({_CAT}, ',' ORDER BY rnk) FILTER (rnk <= 2) || ']}}' AS summary
            FROM tot t JOIN cat c USING (respondent_id) GROUP BY respondent_id, t.raw_score, t.percentage, band, t.answered""",
        "band_distribution": "SELECT band, count(*) AS respondents, min(percentage) AS min_pct, max(percentage) AS max_pct FROM tot GROUP BY band",
        "status_distribution": "SELECT status, count(*) AS n FROM cat GROUP BY status",
        "weakest_ranking": "SELECT category_id, count(*) AS n FROM cat WHERE rnk = 1 GROUP BY category_id",
        "attribution_report": """SELECT coalesce(s.utm_value, '') AS utm_source, coalesce(m.utm_value, '') AS utm_medium, count(*) AS n FROM pages p
            LEFT JOIN utm s ON s.page_id = p.page_id AND s.utm_key = 'utm_source' LEFT JOIN utm m ON m.page_id = p.page_id AND m.utm_key = 'utm_medium' GROUP BY ALL""",
    }.items()
}
