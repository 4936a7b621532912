import json

import pytest
from pyspark.sql import functions as F

from scoreloom import rubric
from scoreloom.functions import rules
from scoreloom.operators import capture, flow, rubrics, scoring
from scoreloom.plans import queries
from scoreloom.sources import inputs, sinks
from scoreloom.streaming.scores import score_stream

SF = "/root/testdata/sf0.001"
LOG = "respondent_id long, question_id int, value int, ts timestamp, event_id long"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_percent_band_status_over_their_whole_domain(spark):
    rows = spark.range(0, 61).select("id", rules.percent(F.col("id"), 60).alias("p")).withColumn("band", rules.band(F.col("p"))).collect()
    for r in rows:
        assert r.p == int(r.id / 60 * 100 + 0.5)
        assert r.band == next(t for a, b, t in rubric.BANDS if a <= r.p <= b)
    odd = spark.createDataFrame([(-1,), (101,), (39,), (40,), (100,)], "p int").select(rules.band(F.col("p")), rules.status(F.col("p"))).collect()
    assert [r[0] for r in odd] == [rubric.BANDS[0][2], rubric.BANDS[0][2], rubric.BANDS[0][2], rubric.BANDS[1][2], rubric.BANDS[4][2]]
    assert [r[1] for r in odd] == ["Severe leak", "Strong", "Severe leak", "Active leak", "Strong"]


def test_latest_wins_and_ties_go_to_rubric_order(spark):
    rows = [(1, 1, 4, None, 1), (1, 1, 2, None, 2), (1, 99, 4, None, 3), (2, 3, None, None, 4)]
    log = spark.createDataFrame([(a, b, c, __import__("datetime").datetime(2024, 1, 1), e) for a, b, c, _, e in rows], LOG)
    got = {r.respondent_id: r for r in scoring.summaries(log).collect()}
    assert got[1].raw_score == 2 and got[1].answered == 1 and not got[1].is_complete
    assert [w.ordinal for w in got[2].weakest] == [1, 2] and got[2].raw_score == 0
    assert scoring.summaries(log.limit(0)).count() == 0
    good, bad = scoring.quarantine(log)
    assert (good.count(), bad.count()) == (3, 1)


def test_submissions_first_failure_counts(spark):
    summary = {"percentage": 40, "rawScore": 24, "band": {"title": "t"}, "weakestCategories": [], "categoryScores": []}
    ok = {"email": "a@b.c", "discordUsername": " x\t", "summary": summary}
    without = lambda name, value=None: (json.dumps(ok | {"summary": {k: v for k, v in (summary | {name: value}).items() if v is not None}}), "malformed")
    cases = [
        (json.dumps(ok), None), ("{", "bad_json"), ("null", "malformed"), (json.dumps(ok | {"email": "a@b.c\n"}), "bad_email"), (json.dumps(ok | {"email": "a@@b.c"}), "bad_email"),
        (json.dumps(ok | {"email": "a b@b.c"}), "bad_email"), (json.dumps(ok | {"discordUsername": 5}), "malformed"), (json.dumps(ok | {"discordUsername": " ﻿"}), "bad_discord"),
        (json.dumps(ok | {"summary": {"percentage": "40"}}), "bad_summary"), (json.dumps({"email": "a@b.c", "discordUsername": "x"}), "bad_summary"), (None, "bad_json"),
        without("band"), without("weakestCategories"), without("categoryScores", {}), without("weakestCategories", [None]), (json.dumps(ok | {"discordUsername": None}), "bad_discord"),
    ]
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "k int, value string")
    got = {r.k: r for r in capture.validate_submissions(inputs.parse_requests(df)).collect()}
    assert [got[k].reject_reason for k in range(len(cases))] == [w for _, w in cases]
    assert got[0].discord == "x" and got[0].status_code == 202 and got[1].status_code == 400


def test_query_parameters(spark):
    url = "http://x/?utm_source=a&utm_source=b%20c&UTM_medium=x&gclid=1=2&utm_term=%zz&utm_content&utm_medium=a%20b%zz+c%#utm_campaign=q"
    got = spark.createDataFrame([(1, url), (2, None), (3, "nothing")], "page_id long, url string")
    rows = {(r.utm_key, r.utm_value) for r in capture.parameter_rows(got).collect()}
    assert rows == {("utm_source", "b c"), ("gclid", "1=2"), ("utm_term", "%zz"), ("utm_content", ""), ("utm_medium", "a b%zz c%")}


def test_answers_from_json_keep_numbers_only(spark):
    df = spark.createDataFrame([(1, '{"1": 4, "2": "4", "3": 2.5, "x": 1}'), (2, "[]"), (3, "{")], "respondent_id long, answers string")
    got = sorted((r.question_id, r.value) for r in inputs.answers_from_json(df).collect() if r.value is not None)
    assert got == [(1, 4.0), (3, 2.5)]


def test_stream_equals_batch(spark, tmp_path):
    answers = inputs.answers_from_events(inputs.table(spark, "/root/testdata/sf0.001", "events"))
    for k in range(3):
        answers.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def write(df, _):
        seen.update({r.respondent_id: r for r in df.collect()})

    stream = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_stream(stream, write, str(tmp_path / "state"), once=True).awaitTermination()
    assert seen == {r.respondent_id: r for r in scoring.summaries(answers).collect()}


def test_sinks_and_outcomes(spark, tmp_path):
    df = spark.createDataFrame([(1, "A@b.c")], "k int, email string")
    sinks.to_files(df, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).head()[0]) == {"k": 1, "email": "A@b.c"}
    assert sinks.route({"common_url": "u"}, "results") == "u" and sinks.route({"results_url": "", "common_url": "u"}, "results") == ""
    assert capture.outcome(df, False).head().status_code == 202 and capture.outcome(df, True, F.lit(False)).head().status_code == 502
    assert capture.redacted(df, ["email"], "s").head().email != "A@b.c"


def test_records_of_a_bare_request(spark):
    body = {"email": "a@b.c", "discordUsername": "x", "trackingContext": {"utm": "no object", "referrer": 5, "sessionId": "s"}, "summary": {
        "percentage": 41.5, "band": {"title": "t"}, "weakestCategories": [{"id": "i", "shortName": None, "rawScore": 1}], "categoryScores": [{"id": "j", "rawScore": 2, "definition": "long"}]}}
    df = spark.createDataFrame([(1, json.dumps(body), {"referer": "r"})], "k long, value string, headers map<string,string>")
    accepted = capture.validate_submissions(inputs.parse_requests(df)).where("reject_reason is null")
    at = F.lit("2024-05-06 07:08:09.012").cast("timestamp_ntz")
    got = json.loads(capture.submission_records(accepted, at).head().value)
    flat = {"email": "a@b.c", "discordUsername": "x", "submittedAt": "2024-05-06T07:08:09.012Z", "scorePercentage": 41.5, "resultBand": "t", "weakestCategoryOne": "", "weakestCategoryOneScore": "",
            "weakestCategoryTwo": "", "weakestCategoryTwoScore": "", "utmSource": "", "utmMedium": "", "utmCampaign": "", "utmContent": "", "utmTerm": "", "referrer": "", "landingPage": "", "currentPage": "", "sessionId": "s"}
    assert got == {"type": "scorecard_submission", **flat, "fields": flat, "answers": {}, "trackingContext": body["trackingContext"], "timestamp": flat["submittedAt"],
                   "result": {"percentage": 41.5, "resultBand": "t", "weakestCategories": [{"id": "i", "shortName": None}], "categoryScores": [{"id": "j", "rawScore": 2}]},
                   "requestContext": {"referrer": "r", "userAgent": "", "country": "", "region": "", "city": ""}}
    assert capture.flat_submissions(accepted, at).head().weakestCategoryOneScore is None


def test_event_names_are_truthy(spark):
    names = [('"x"', True), ('""', False), ("5", True), ("0", False), ("true", True), ("false", False), ("null", False), ("[]", True), ("{}", True)]
    df = spark.createDataFrame([(k, f'{{"eventName":{n}}}') for k, (n, _) in enumerate(names)] + [(9, "{}"), (10, "{")], "k int, value string")
    got = {r.k: r.has_event_name for r in inputs.parse_requests(df).collect()}
    assert [got[k] for k in range(11)] == [w for _, w in names] + [False, False]


def test_envelopes_keep_null_and_drop_undefined(spark):
    df = spark.createDataFrame([(1, None, True), (2, None, False), (3, "v", False)], "k int, a string, gone boolean")
    got = [json.loads(r.value) for r in capture.envelopes(df, F.lit("e"), {"a": F.col("a"), "k": F.col("k")}, undefined={"a": F.col("gone")}).orderBy("k").collect()]
    assert [x["payload"] for x in got] == [{"k": 1}, {"a": None, "k": 2}, {"a": "v", "k": 3}] and got[0]["trackingContext"] is None
    for name in rubric.EVENTS:
        fields = capture.event_payload_of(name)
        assert set(capture.SCORE_FIELDS) <= set(fields) or name in ("scorecard_started", "question_answered")
    assert list(capture.event_payload_of("email_submitted"))[-3:] == ["email", "discordUsername", "deliveredToCaptureEndpoint"]
    row = spark.createDataFrame([(True, False)], "resumed boolean, unlocked boolean")
    assert json.loads(capture.envelopes(row, F.lit("scorecard_started"), capture.event_payload_of("scorecard_started")).head().value)["payload"] == {"resumed": True, "unlocked": False}


def log_of(spark, rows):
    """(respondent, question, value, kind) in order of time."""
    day = __import__("datetime").datetime(2024, 1, 1)
    return spark.createDataFrame([(r, q, v, day, k, kind == "restart", kind == "submit") for k, (r, q, v, kind) in enumerate(rows)], f"{LOG}, is_restart boolean, is_submit boolean")


def test_scores_count_answers_since_the_last_restart(spark):
    log = log_of(spark, [(1, 1, 4, "answer"), (1, 2, 3, "answer"), (1, 1, None, "restart"), (1, 2, 1, "answer"), (2, 1, 2, "answer"), (3, 5, 4, "answer"), (3, 5, 4, "restart")])
    got = {r.respondent_id: (r.raw_score, r.answered) for r in scoring.summaries_of(scoring.answers_since_restart(log)).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (0, 0)}


def test_states_and_saving(spark):
    log = log_of(spark, [(1, 1, 4, "submit"), (2, 1, 4, "submit"), (2, 1, 1, "restart"), (3, 1, 1, "answer"), (4, 1, 1, "restart"), (4, 1, 1, "submit")])
    got = flow.states(log.withColumn("email", F.lit("e")).withColumn("discord", F.lit("d"))).collect()
    assert {r.respondent_id: (r.email, r.unlocked, r.has_email) for r in got} == {1: ("e", True, True), 2: (None, False, False), 3: (None, False, False), 4: ("e", True, True)}
    schema = "respondent_id int, answers string, email string, discord string, unlocked boolean"
    stored = spark.createDataFrame([(1, "{}", "a", "b", False), (2, "{}", "a", "b", True)], schema)
    changes = spark.createDataFrame([(1, '{"1":2}', "", "c", True), (3, "{}", None, "d", False)], schema)
    assert sorted(map(tuple, flow.saved(stored, changes).collect())) == [(1, '{"1":2}', "a", "c", True), (2, "{}", "a", "b", True), (3, "{}", None, "d", False)]


def test_forms_labels_and_outcomes(spark):
    form = spark.createDataFrame([(" a@b.c ", " d ", True), ("a", "d", None), ("a@b.c", " ", False)], "email string, discord string, is_submitting boolean")
    got = flow.submit_guard(capture.validate_form(form)).collect()
    assert [(r.is_valid, r.submit_off) for r in got] == [(True, True), (False, False), (False, False)] and got[0].email == "a@b.c"
    state = spark.createDataFrame([(1, 0), (2, 14), (3, 15)], "respondent_id int, step int")
    assert [(r.category_id, r.label) for r in flow.current_question(state).collect()] == [("acquisition", "1 of 15"), ("compounding", "15 of 15"), (None, "16 of 15")]
    outcomes = spark.createDataFrame([(True,), (False,), (None,)], "delivered boolean")
    assert [(r.delivered_to_capture, r.unlocked, r.next_view) for r in capture.client_outcome(outcomes).collect()] == [(True, True, "results"), (False, True, "results"), (False, True, "results")]
    stored = capture.stored_context(spark.createDataFrame([("{",), ('{"a": 1}',)], "stored string")).select(F.to_json("stored")).collect()
    assert [r[0] for r in stored] == [None, '{"a":1}']
    assert [(r.ordinal, r.category_id) for r in rubric.categories(spark).collect()][0] == (1, "acquisition") and rubric.bands(spark).count() == len(rubric.BANDS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["latest_answers", "total_scores", "total_scores_since_restart", "weakest_two"])
def test_scores_are_combined_before_they_are_dealt(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF))
    assert "SortAggregate" not in plan and "Sort [" not in plan and plan.count("Exchange") <= 2
    first = plan.rindex("Exchange")
    assert "HashAggregate" in plan[first:] and "partial_max_by" in plan[first:]


def test_submissions_need_no_exchange(spark):
    for name in ("submission_flat", "submission_recomputed"):
        plan = plan_of(queries.QUERIES[name](spark, SF))
        assert plan.count("try_parse_json") + plan.count("parse_json(") <= 2 and "Join" not in plan and "Exchange" not in plan
    assert "NestedLoop" not in plan_of(queries.scores_by_rubric(spark, SF)) and "Cartesian" not in plan_of(queries.scores_by_rubric(spark, SF))


def test_moments_order_as_pairs(spark):
    df = spark.sql("""SELECT ts, event_id FROM VALUES (NULL, 5L), (TIMESTAMP_NTZ '1969-12-31 23:59:59.999999', 9223372036854775807L), (TIMESTAMP_NTZ '2024-03-10 02:30:00', -9223372036854775808L),
        (TIMESTAMP_NTZ '2024-03-10 02:30:00', NULL), (TIMESTAMP_NTZ '2024-03-10 03:15:00', 0L), (TIMESTAMP_NTZ '9999-12-31 23:59:59', 9223372036854775807L), (NULL, NULL) t(ts, event_id)""")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for column in (F.col("ts"), F.col("ts").cast("timestamp")):
                rows = df.select(rules.moment(column, F.col("event_id")).alias("m"), rules.micros(column).alias("u"), "event_id").collect()
                by_pair = sorted(rows, key=lambda r: (r.u is not None, r.u or 0, -(1 << 63) if r.event_id is None else r.event_id))
                assert [r.m for r in by_pair] == sorted(r.m for r in rows)
            own = df.where("event_id = 0").select(rules.micros(F.col("ts"))).head()[0]
            assert own == 1710040500000000
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_times_are_utc_in_any_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp'2024-01-01T10:00:00.123456Z' a, timestamp_ntz'2024-03-10 02:30:00.5' b, timestamp'2024-11-03T06:30:00Z' c, timestamp'1969-12-31T23:59:59.999999Z' d, cast(null AS timestamp) e")
        got = list(df.select(*[rules.iso_time(F.col(c)) for c in "abcde"]).head())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-01-01T10:00:00.123Z", "2024-03-10T02:30:00.500Z", "2024-11-03T06:30:00.000Z", "1969-12-31T23:59:59.999Z", None]


def test_claims_keep_their_fractions(spark):
    body = {"email": "a@b.c", "discordUsername": "x", "summary": {"percentage": 41.9, "rawScore": 24.5, "band": {"title": "t"}, "weakestCategories": [{"shortName": "s", "percentage": 1e30}], "categoryScores": []}}
    df = spark.createDataFrame([(1, json.dumps(body), "own", None)], "k long, value string, email string, headers map<string,string>")
    accepted = capture.validate_submissions(inputs.parse_requests(df)).where("reject_reason is null")
    r = capture.flat_submissions(accepted).head()
    assert (r.email, r.rawScore, r.scorePercentage, r.weakestCategoryOneScore) == ("a@b.c", 24.5, 41.9, 1e30)
    log = spark.createDataFrame([(1, q, 4, __import__("datetime").datetime(2024, 1, 1), q) for q in range(1, 7)], LOG)
    audit = scoring.audit(accepted.select(F.col("k").alias("respondent_id"), "percentage"), scoring.summaries(log)).head()
    assert (audit.percentage, audit.computed, audit.agrees) == (41.9, 40, False)


def test_keys_of_answers_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, '{"1": 4, "01": 3, " 2": 2, "3": 1, "3": 2, "+4": 1, "5.0": 1, "16": 3}')], "respondent_id long, answers string")
    assert sorted((r.question_id, r.value) for r in inputs.answers_from_json(df).collect()) == [(1, 4.0), (3, 2.0), (16, 3.0)]
    twice = spark.createDataFrame([(1, '{"email": "no", "email": "a@b.c", "summary": {"percentage": 1, "percentage": 2}}')], "k int, value string")
    assert tuple(inputs.parse_requests(twice).select("is_json", "email", "percentage").head()) == (True, "a@b.c", 2.0)


def test_requests_are_scored_by_their_own_answers(spark):
    bodies = ['{"answers": {"1": 4, "2": 2.5, "3": "4", "4": true, "5": null, "99": 4, "x": 1}}', '{"answers": []}', "{}", "{", json.dumps({"answers": {str(q): 4 for q in range(1, 16)}, "summary": {"percentage": 100}})]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, value string")
    got = {r.k: (r.raw_score, r.percentage, r.answered, r.is_complete, r.agrees) for r in scoring.recomputed(inputs.parse_requests(df)).collect()}
    assert got == {0: (6.5, 11, 2, False, None), 1: (0.0, 0, 0, False, None), 2: (0.0, 0, 0, False, None), 3: (0.0, 0, 0, False, None), 4: (60.0, 100, 15, True, True)}


def test_event_names_outside_the_catalogue(spark):
    with pytest.raises(ValueError):
        capture.event_payload_of("scorecard_finished")
    assert set(capture.event_payload_of("landing_cta_clicked")) == {"location", "destination"}
    df = spark.createDataFrame([(1, '{"eventName": "x"}'), (2, '{"eventName": 0}'), (3, "{"), (4, "3")], "k int, value string")
    got = capture.validate_events(inputs.parse_requests(df)).select("k", "reject_reason", "status_code").collect()
    assert sorted(map(tuple, got)) == [(1, None, 202), (2, "bad_event_name", 400), (3, "bad_json", 400), (4, "malformed", 400)]


def test_stored_contexts_win(spark):
    day = __import__("datetime").datetime(2024, 1, 1, 10)
    visits = spark.createDataFrame([(1, day, 1, "/a?utm_source=n", "r"), (1, day, 2, "/b", "q"), (2, day, 3, "/c?gclid=1", None), (3, day, 4, "/d", "r")], "user_id long, ts timestamp, event_id long, url string, referrer string")
    old = '{"sessionId": "s", "firstSeenAt": "t", "landingPage": "/l", "currentPage": "/p", "referrer": "", "utm": {"utm_source": "o"}}'
    stored = spark.createDataFrame([(1, old), (2, "{"), (3, "null"), (4, old), (5, "[]"), (6, None)], "user_id long, stored string")
    got = {r.user_id: r for r in capture.contexts_with_stored(visits, stored).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert tuple(got[1])[1:] == ("s", "t", "/l", "/b", "", {"utm_source": "o"}, True) and got[4].currentPage == "/p"
    assert tuple(got[2])[1:] == ("session_2", "2024-01-01T10:00:00.000Z", "/c?gclid=1", "/c?gclid=1", "", {"gclid": "1"}, False) and not got[3].was_stored


def test_rubric_tables(spark):
    questions, bands = rubrics.standard(spark)
    assert rubrics.faults(bands).collect() == []
    odd = spark.createDataFrame([(1, 0, 39, "a"), (1, 39, 60, "b"), (1, 62, 90, "c"), (2, 1, 100, "d"), (3, 0, 50, "e"), (3, 51, 40, "f"), (4, 0, 100, "g")], rubrics.BANDS)
    found = {(r.rubric_version, r.fault) for r in rubrics.faults(odd).collect()}
    assert {(1, "overlap"), (1, "gap"), (2, "gap"), (3, "empty")} <= found and not any(v == 4 for v, _ in found)
    latest = spark.createDataFrame([(1, 1, 1, 4), (1, 1, 2, None), (1, 1, 99, 4), (2, 9, 1, 4)], "respondent_id long, rubric_version int, question_id int, value int")
    with pytest.raises(ValueError, match="version 1"):
        rubrics.scores(latest, questions, odd)
    r = rubrics.scores(latest, questions, bands).collect()
    assert [(x.respondent_id, x.raw_score, x.percentage, x.answered, x.is_complete) for x in r] == [(1, 4, 7, 1, False)] and r[0].category_percentages[0].percentage == 33 and len(r[0].category_percentages) == 5
    grid = {p.percentage: p.band for p in rubrics.by_percent(bands).collect()}
    assert grid == {p: next(t for a, b, t in rubric.BANDS if a <= p <= b) for p in range(101)}


def test_ids_and_states_to_store(spark):
    df = spark.range(500).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).select(rules.session_id().alias("a"), rules.fallback_session_id(F.col("at")).alias("b"), rules.session_id(3).alias("c"))
    rows = df.collect()
    assert len({r.a for r in rows}) == len({r.b for r in rows}) == 500 and all(__import__("uuid").UUID(r.a) for r in rows)
    assert all(__import__("re").fullmatch(r"session_1704067200000_[0-9a-f]+", r.b) for r in rows)
    stored = spark.createDataFrame([(1, '{"1":4}', "a@b.c", "d", "true"), (2, None, None, None, "false")], "respondent_id long, answers string, email string, discord string, unlocked string")
    assert sorted(map(tuple, inputs.states_to_store(inputs.stored_states(stored)).collect())) == sorted(map(tuple, stored.collect()))


def test_rows_since_restart(spark):
    log = log_of(spark, [(1, 1, 4, "answer"), (1, 1, 4, "restart"), (1, 1, 4, "answer"), (1, 1, 4, "answer"), (2, 1, 1, "answer"), (3, 1, 1, "restart"), (3, 1, 1, "restart")])
    got = {r.respondent_id: (r.run, r.n) for r in flow.rows_since_restart(log, F.col("is_restart")).collect()}
    assert got == {1: (1, 3), 2: (0, 1), 3: (2, 1)} and "Window" not in plan_of(flow.rows_since_restart(log, F.col("is_restart")))


def test_step_guards(spark):
    df = spark.createDataFrame([(0, False, False, False), (14, True, True, True), (3, True, False, False)], "step int, answered_current boolean, is_complete boolean, unlocked boolean")
    got = flow.step(df).collect()
    assert [(r.back_step, r.next_step, r.view_after_next) for r in got] == [(0, 0, "questions"), (13, 14, "results"), (2, 4, "questions")]
    assert [(r.back_off, r.next_off, r.label) for r in got] == [(True, True, "1 of 15"), (False, False, "15 of 15"), (False, False, "4 of 15")]


def test_requests_are_made_in_many_tasks_from_one_small_file(spark):
    """A file of one row group is read by one task; what is made of each row isn't."""
    for name in ("submission_record", "submission_outcome"):
        found = queries.QUERIES[name](spark, SF)
        assert found.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = plan_of(queries.submission_audit(spark, SF))
    assert "RoundRobinPartitioning" in plan[plan.index("Generate inline") :]


@pytest.mark.parametrize("name", ["submission_record", "submission_outcome", "submission_flat", "submission_audit"])
def test_whole_bodies_have_no_schema_written(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF))
    assert "schemaOfVariant(_v" not in plan and plan.count("inline(array(_f") == 1


def test_requests_of_odd_types(spark):
    whole = '{"percentage":5,"band":%s,"weakestCategories":%s,"categoryScores":[]}'
    bodies = {
        None: (False, False, False), "x": (False, False, False), "null": (True, False, False), "[]": (True, False, False), "{}": (True, True, False), '{"summary":null}': (True, True, False),
        '{"summary":%s}' % (whole % ("null", "[]")): (True, True, False), '{"summary":%s}' % (whole % ("0", "[null]")): (True, True, False), '{"summary":%s}' % (whole % ("0", "{}")): (True, True, False),
        '{"summary":%s}' % (whole % ("[]", "[1,[null]]")): (True, True, True),
    }
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, value string")
    got = {r.k: (r.is_json, r.is_object, r.has_parts) for r in inputs.parse_requests(df).select("k", "is_json", "is_object", "has_parts").collect()}
    assert got == dict(enumerate(bodies.values()))
