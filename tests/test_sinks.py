"""Delivery with an answer for each row, fan-out in each sink's shape, keyed state by batch id, and ingestion into three outputs."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import capture
from scoreloom.plans import queries
from scoreloom.sources import inputs, sinks
from scoreloom.sources.store import KeyedStore
from scoreloom.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def server():
    """A receiver that fails every third post, and what it got."""
    got, lock = [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            with lock:
                got.append((body, self.headers["Content-Type"]))
                status = 500 if len(got) % 3 == 0 else 200
            self.send_response(status)
            self.end_headers()

        def log_message(self, *_):
            pass

    found = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}/", got
    found.shutdown()


def test_webhook_answers_for_each_row(spark, server, tmp_path):
    url, got = server
    records = queries.submission_record(spark, SF).where("k < 40").withColumnRenamed("k", "key").cache()
    bodies = {str(r.key): r.value for r in records.collect()}
    hook = sinks.Webhook(spark, url, str(tmp_path / "hook"))
    rows = {r.key: r for r in hook.deliver(records, 0).collect()}
    assert sorted(b for b, _ in got) == sorted(bodies.values()) and {kind for _, kind in got} == {"application/json"}
    failed = {k for k, r in rows.items() if r.status_code == 502}
    assert set(rows) == set(bodies) and len(failed) == len(bodies) // 3
    assert all((r.delivered, r.http_status, r.configured) == (k not in failed, 500 if k in failed else 200, True) for k, r in rows.items())
    assert {r.key: r.status_code for r in hook.deliver(records, 0).collect()} == {k: r.status_code for k, r in rows.items()} and len(got) == len(bodies)
    again = sinks.Webhook(spark, url, str(tmp_path / "hook"), retry_failed=True)
    now = {r.key: r for r in again.deliver(records, 0).collect()}
    assert sorted(b for b, _ in got[len(bodies) :]) == sorted(bodies[k] for k in failed) and sum(r.status_code == 502 for r in now.values()) < len(failed)
    client = capture.client_outcome(hook.deliver(records, 1)).collect()
    assert all(r.unlocked and r.next_view == "results" for r in client) and {r.delivered_to_capture for r in client} == {True, False}


def test_webhook_without_a_receiver(spark, tmp_path):
    records = spark.createDataFrame([(1, "{}")], "key long, value string")
    for url in (None, ""):
        r = sinks.Webhook(spark, url, str(tmp_path / "none")).deliver(records, 0).head()
        assert (r.configured, r.delivered, r.status_code) == (False, False, 202)
    r = sinks.Webhook(spark, "http://127.0.0.1:9/", str(tmp_path / "gone"), timeout=2).deliver(records, 0).head()
    assert (r.configured, r.delivered, r.status_code, r.http_status) == (True, False, 502, None) and r.error
    assert sinks.Webhook(spark, "http://127.0.0.1:9/", str(tmp_path / "empty")).deliver(records.limit(0), 0).collect() == []


def events_of(spark):
    parsed = queries._event_requests(spark, SF).where("has_event_name").withColumnRenamed("event_id", "key")
    return parsed.select("key", "event_name", F.coalesce("payload", F.parse_json(F.lit("{}"))).alias("payload"), "context").where("key < 30")


def test_shapes_of_sinks(spark):
    rows = spark.createDataFrame([(1, '"e"', '{"a": 1, "trackingContext": 2}', '{"s": 1}'), (2, '"f"', "{}", None)], "key int, event_name string, payload string, context string")
    rows = rows.select("key", *[F.parse_json(c).alias(c) for c in ("event_name", "payload", "context")])
    of = lambda shape: [json.loads(r.value) for r in shape(rows).orderBy("key").collect()]
    assert of(sinks.tag_call) == [["event", "e", {"a": 1, "trackingContext": 2}], ["event", "f", {}]]
    assert of(sinks.capture_call) == [{"event_name": "e", "properties": {"a": 1, "trackingContext": {"s": 1}}}, {"event_name": "f", "properties": {"trackingContext": None}}]
    assert of(sinks.props_call) == [{"event_name": "e", "options": {"props": {"a": 1, "trackingContext": 2}}}, {"event_name": "f", "options": {"props": {}}}]
    assert of(sinks.event_request) == [{"eventName": "e", "payload": {"a": 1, "trackingContext": 2}, "trackingContext": {"s": 1}}, {"eventName": "f", "payload": {}, "trackingContext": None}]


def test_fan_out_sends_only_what_is_missing(spark, tmp_path):
    sent = {"tag": [], "capture": [], "api": []}
    broken = {"capture"}

    def to(name):
        def send(df, batch_id):
            rows = df.collect()
            if name in broken:
                raise OSError("down")
            sent[name].append((batch_id, len(rows)))

        return send

    shapes = {"tag": sinks.tag_call, "capture": sinks.capture_call, "api": sinks.event_request}
    declared = [*[sinks.Sink(n, s, to(n)) for n, s in shapes.items()], sinks.Sink("absent", sinks.props_call, None)]
    fan, rows = sinks.FanOut(spark, str(tmp_path / "fan"), declared), events_of(spark)
    n = rows.count()
    with pytest.raises(RuntimeError, match="capture"):
        fan(rows, 0)
    assert sent == {"tag": [(0, n)], "capture": [], "api": [(0, n)]} and fan.has("tag", 0) and not fan.has("capture", 0)
    broken.clear()
    fan(rows, 0)
    sinks.FanOut(spark, str(tmp_path / "fan"), declared)(rows, 0)
    fan(rows, 1)
    assert sent == {"tag": [(0, n), (1, n)], "capture": [(0, n), (1, n)], "api": [(0, n), (1, n)]}
    broken.add("api")
    sinks.FanOut(spark, str(tmp_path / "fan"), declared, ignore_failures=True)(rows, 2)
    assert sent["api"] == [(0, n), (1, n)] and sent["tag"][-1] == (2, n)


def test_keyed_store(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), parts=4)
    schema = "respondent_id long, answers string, email string, discord string, unlocked boolean, ts timestamp, event_id long"
    day = __import__("datetime").datetime(2024, 1, 1)
    changes = lambda *rows: spark.createDataFrame([(*r, day, k) for k, r in enumerate(rows)], schema)
    assert store.read().collect() == []
    sink = store.sink()
    first = changes((1, "{}", "a", "b", False), (2, "{}", "", None, False), (1, '{"1":1}', "c", "", True), (None, "{}", "n", "n", True))
    sink(first, 0)
    wanted = [(1, '{"1":1}', "c", None, True), (2, "{}", None, None, False), (None, "{}", "n", "n", True)]
    rows = lambda: sorted(map(tuple, store.read().collect()), key=str)
    assert rows() == sorted(wanted, key=str)
    sink(first, 0)
    assert store.merge(first, 0) == 1 and rows() == sorted(wanted, key=str)
    second = changes((1, '{"1":2}', "", "d", False), (3, "{}", "e", "f", True))
    real, store._manifests.commit = store._manifests.commit, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        sink(second, 1)
    store._manifests.commit = real
    assert rows() == sorted(wanted, key=str)
    other = KeyedStore(spark, str(tmp_path / "store"), parts=99)
    assert other.parts == 4 and other.merge(second, 1) == 2
    wanted = [(1, '{"1":2}', "c", "d", False), *wanted[1:], (3, "{}", "e", "f", True)]
    assert rows() == sorted(wanted, key=str) and len(store.read(1).collect()) == 3
    assert store.merge(changes((9, "{}", "x", "y", True)), 0, stream="another") == 3
    real, store._manifests.newest = store._manifests.newest, lambda: (2, store._manifests.read(2))
    with pytest.raises(RuntimeError):
        store.merge(second, 2)
    store._manifests.newest = real


def test_stored_states(spark):
    rows = [(1, '{"1": 4}', "a@b.c", "d", "true"), (2, "{", "", None, "false"), (3, None, None, None, None), (4, "[1]", "e", "f", "TRUE")]
    got = inputs.stored_states(spark.createDataFrame(rows, "respondent_id long, answers string, email string, discord string, unlocked string"))
    found = sorted(tuple(r) for r in got.select("respondent_id", F.to_json("answers"), "email", "discord", "unlocked").collect())
    assert found == [(1, '{"1":4}', "a@b.c", "d", True), (2, None, "", "", False), (3, None, "", "", False), (4, "[1]", "e", "f", False)]


def run_ingest(spark, rows, path, validate, records):
    for k in range(3):
        rows.where(F.col("k") % 3 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest.ingest(stream, f"{path}/out", f"{path}/state", validate, records, once=True).awaitTermination()
    return ingest.outputs(spark, f"{path}/out")


def test_submissions_as_a_stream(spark, tmp_path):
    rows = inputs.submissions_from_customers(inputs.table(spark, SF, "customer")).unionByName(spark.createDataFrame([(1000, "{", {}), (1001, "null", None), (1002, None, None)], "k long, value string, headers map<string,string>"))
    out = run_ingest(spark, rows, tmp_path, capture.validate_submissions, ingest.submission_rows)
    wanted = {r.k: r.reject_reason for r in queries.submission_outcome(spark, SF).collect()} | {1000: "bad_json", 1001: "malformed", 1002: "bad_json"}
    assert {r.k for r in out["accepted"].collect()} == {k for k, why in wanted.items() if why is None}
    found = [(r.k, r.reject_reason) for n in ("rejected", "malformed") for r in out[n].collect()]
    assert sorted(found) == sorted((k, why) for k, why in wanted.items() if why) and {r.body for r in out["malformed"].where("k >= 1000").collect()} == {"{", "null", None}
    assert out["rejected"].where("reject_reason in ('bad_json', 'malformed')").count() == 0 and out["accepted"].select("batch_id").distinct().count() == 3
    record = json.loads(out["accepted"].head().value)
    assert record["type"] == "scorecard_submission" and record["timestamp"].endswith("Z")
    ingest.deal(rows.where("k % 3 = 0"), 0, f"{tmp_path}/out", capture.validate_submissions, ingest.submission_rows)
    now = ingest.outputs(spark, f"{tmp_path}/out")["accepted"].where("batch_id = 0")
    assert now.count() == now.select("k").distinct().count()


def test_events_as_a_stream(spark, tmp_path):
    bodies = ['{"eventName":"x","payload":{"a":1}}', '{"eventName":""}', "{", "[]", '{"eventName":5}']
    rows = spark.createDataFrame([(k, b, {"user-agent": "u"}) for k, b in enumerate(bodies)], "k long, value string, headers map<string,string>")
    out = run_ingest(spark, rows, tmp_path, capture.validate_events, ingest.event_rows)
    assert sorted(r.k for r in out["accepted"].collect()) == [0, 4] and sorted((r.k, r.reject_reason) for r in out["rejected"].collect()) == [(1, "bad_event_name")]
    assert sorted((r.k, r.reject_reason) for r in out["malformed"].collect()) == [(2, "bad_json"), (3, "malformed")]
