"""Streams give what the batch queries give, however the log is cut, also after a stop and a start from the checkpoint."""

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import flow, replay, scoring
from scoreloom.plans import queries
from scoreloom.streaming import respondents

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def streamed(spark, log, cuts, make, mode, path):
    """All batches that `make` of a stream over log writes; the log comes in files by `cuts`, the last of them after the query was stopped."""
    seen = []
    for k, cut in enumerate(cuts):
        log.where(cut).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if k < len(cuts) - 2:
            continue
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        query = make(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, _: seen.append(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    assert len(seen) >= len(cuts)
    return seen


@pytest.fixture(scope="module")
def log(spark):
    marks = queries._restart_log(spark, SF).withColumn("email", F.concat(F.lit("e"), F.col("event_id").cast("string"))).withColumn("discord", F.lit("d"))
    return marks.withColumn("is_view", ~F.col("is_restart") & ~F.col("is_submit") & (F.col("event_id") % 3 == 0)).cache()


def by_time(parts):
    return [f"event_id >= {1000 * k // parts} and event_id < {1000 * (k + 1) // parts}" for k in range(parts)]


@pytest.mark.parametrize("cuts", [by_time(3), [f"event_id % 3 = {k}" for k in range(3)]], ids=["in order", "mixed"])
def test_live_states(spark, log, tmp_path, cuts):
    latest = {}
    for batch in streamed(spark, log, cuts, respondents.live_states, "update", tmp_path):
        assert len({r.respondent_id for r in batch}) == len(batch)
        latest |= {r.respondent_id: r for r in batch}
    states = spark.createDataFrame(list(latest.values()), f"respondent_id long, {respondents.WIDE}, email string, discord string, unlocked boolean, has_email boolean")
    assert rows_of(states.select("respondent_id", "email", "discord", "unlocked", "has_email")) == rows_of(flow.states(log))
    wanted = scoring.answers_since_restart(log.where("not is_submit"))
    assert rows_of(states.select(*wanted.columns).join(wanted.select("respondent_id"), "respondent_id", "left_semi")) == rows_of(wanted)
    assert rows_of(scoring.summaries_of(states).select("respondent_id", "raw_score", "band")) == rows_of(queries.total_scores_since_restart(spark, SF).select("respondent_id", "raw_score", "band"))


@pytest.mark.parametrize("parts", [2, 5])
def test_live_views(spark, log, tmp_path, parts):
    found = [tuple(r) for batch in streamed(spark, log, by_time(parts), respondents.live_views, "append", tmp_path) for r in batch]
    wanted = flow.once_per_run(flow.runs(log, F.col("is_restart")), F.col("is_view"))
    assert sorted(found) == sorted((r.respondent_id, r.run, r.event_id) for r in wanted.collect())


def test_live_flow(spark, tmp_path):
    actions = queries.action_log(spark, SF)
    latest = {}
    for batch in streamed(spark, actions, by_time(3), respondents.live_flow, "update", tmp_path):
        latest |= {r.respondent_id: tuple(r) for r in batch}
    assert sorted(latest.values()) == sorted(map(tuple, replay.final_states(actions).collect()))


def test_flow_by_hand(spark):
    full = [a for q in range(15) for a in (("answer", q % 5), ("next", None))]
    day = __import__("datetime").datetime(2024, 1, 1)
    cases = {
        1: [], 2: [("answer", 1), ("next", None)], 3: [("start", None), ("next", None), ("answer", 2), ("back", None), ("next", None), ("home", None)],
        4: [("start", None), *full], 5: [("start", None), *full, ("submit", None), ("home", None), ("start", None)], 6: [("start", None), *full, ("submit", None), ("restart", None), ("start", None), ("answer", 0)],
        7: [("start", None), *full, ("home", None), ("start", None), ("submit", None)], None: [("start", None), ("answer", None), ("next", None), ("what", 1), (None, None)],
    }
    rows = [(who, day, k, 0, a, v) for who, acts in cases.items() for k, (a, v) in enumerate(acts)]
    df = spark.createDataFrame(rows, "respondent_id long, ts timestamp, event_id long, seq int, action string, value int").repartition(4)
    got = {r.respondent_id: tuple(r)[1:] for r in replay.final_states(df).collect()}
    assert got == {
        2: ("landing", 0, 0, False, 0, 0), 3: ("landing", 1, 1, False, 0, 0), 4: ("email", 14, 15, False, 1, 0), 5: ("results", 14, 15, True, 1, 1), 6: ("questions", 0, 1, False, 1, 1),
        7: ("results", 14, 15, True, 1, 1), None: ("questions", 0, 0, False, 0, 0),
    }
    assert replay.final_states(df.limit(0)).collect() == []
