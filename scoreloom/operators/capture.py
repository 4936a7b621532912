"""Submissions and behaviour events: validation, enrichment, flattening, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom import rubric
from scoreloom.functions.rules import given, is_email, is_filled, iso_time, tracked_parameters, trimmed, variant_fields

# Names on the wire, in their order.
UTM = ("source", "medium", "campaign", "content", "term")
CONTEXT = ("referrer", "landingPage", "currentPage", "sessionId")
SCORE_FIELDS = ("rawScore", "percentage", "resultBand", "weakestCategoryOne", "weakestCategoryOneScore", "weakestCategoryTwo", "weakestCategoryTwoScore")
WEAKEST = ("id", "name", "shortName", "percentage", "status")
SCORES = ("id", "name", "shortName", "rawScore", "percentage", "status")
SUMMARY = ("percentage", "band", "weakestCategories", "categoryScores")
NUMERIC = ("rawScore", "scorePercentage", "weakestCategoryOneScore", "weakestCategoryTwoScore")
HEADERS = {"referrer": "referer", "userAgent": "user-agent", "country": "x-vercel-ip-country", "region": "x-vercel-ip-country-region", "city": "x-vercel-ip-city"}


def validate_submissions(requests: DataFrame) -> DataFrame:
    """Parsed requests with discord trimmed, reject_reason (null: accepted) and status_code; the first check that fails counts.

    The email is not trimmed. Malformed: bodies that are no object, a discord name that is no string, and summaries without a band or
    one of their lists, or with an empty place in these.
    """
    name = trimmed(F.col("discord"))
    reason = (
        F.when(~F.col("is_json"), "bad_json").when(~F.col("is_object"), "malformed").when(~is_email(F.col("email")), "bad_email")
        .when(F.col("odd_discord"), "malformed").when(~is_filled(name), "bad_discord").when(F.col("percentage").isNull(), "bad_summary").when(~F.col("has_parts"), "malformed")
    )
    return requests.withColumn("reject_reason", reason).withColumn("discord", name).withColumn("status_code", F.when(F.col("reject_reason").isNull(), 202).otherwise(400))


def validate_form(form: DataFrame) -> DataFrame:
    """The same checks as a form makes them: both fields trimmed first."""
    return form.withColumn("email", trimmed(F.col("email"))).withColumn("discord", trimmed(F.col("discord"))).withColumn("is_valid", is_email(F.col("email")) & is_filled(F.col("discord")))


def validate_events(requests: DataFrame) -> DataFrame:
    """Parsed requests with reject_reason (null: accepted) and status_code: an event needs a name that counts as true; any will do."""
    reason = F.when(~F.col("is_json"), "bad_json").when(~F.col("is_object"), "malformed").when(~F.col("has_event_name"), "bad_event_name")
    return requests.withColumn("reject_reason", reason).withColumn("status_code", F.when(F.col("reject_reason").isNull(), 202).otherwise(400))


def outcome(accepted: DataFrame, configured: bool, delivered: Column | None = None) -> DataFrame:
    """What an accepted row's sender hears: 202, also where no sink is configured; 502 if delivery failed."""
    sent = F.lit(configured) if delivered is None else delivered
    failed = F.lit(configured) & ~sent
    return accepted.withColumns({"configured": F.lit(configured), "delivered": sent & F.lit(configured), "status_code": F.when(failed, 502).otherwise(202)})


def client_outcome(outcomes: DataFrame) -> DataFrame:
    """What the sender's page does after an outcome (delivered; null if none came): it shows the results and unlocks them in any case."""
    return outcomes.withColumns({"delivered_to_capture": F.coalesce("delivered", F.lit(False)), "unlocked": F.lit(True), "next_view": F.lit("results")})


def request_context(headers: Column) -> Column:
    """Five headers of a map, empty where missing."""
    return F.struct(*[F.coalesce(F.try_element_at(headers, F.lit(h)), F.lit("")).alias(n) for n, h in HEADERS.items()])


def tracking_fields(context: Column, utm: Column) -> dict[str, Column]:
    """The nine flat fields of a context and its utm (structs of VARIANT): strings, empty where there is none; click ids stay in the context."""
    text = lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit(""))
    return {f"utm{n.capitalize()}": text(utm[f"utm_{n}"]) for n in UTM} | {n: text(context[n]) for n in CONTEXT}


def _of(item: Column, names: tuple[str, ...]) -> Column:
    return F.struct(*[F.try_variant_get(item, f"$.{n}", "variant").alias(n) for n in names])


def _taken_apart(accepted: DataFrame) -> DataFrame:
    """accepted with its summary and context as structs: _s, its two weakest categories as _w, _c and its _u; each is taken apart once."""
    weak = F.try_variant_get("_s.weakestCategories", "$", "array<variant>")
    one = accepted.withColumn("_s", variant_fields(F.col("summary"), ("rawScore", *SUMMARY))).withColumn("_c", variant_fields(F.col("context"), ("utm", *CONTEXT)))
    two = one.withColumn("_w", F.transform(F.slice(weak, 1, 2), lambda w: variant_fields(w, ("shortName", "percentage"))))
    return two.withColumn("_u", variant_fields(F.col("_c.utm"), tuple(f"utm_{n}" for n in UTM))).withColumn("_band", variant_fields(F.col("_s.band"), ("title",)))


def submission_fields(submitted_at: Column) -> dict[str, Column]:
    """The flat fields of an accepted submission in their order, as its summary claims them; weakest ones that are missing are empty. From
    the columns of _taken_apart."""
    there = lambda x: F.when(F.schema_of_variant(x) != "VOID", x)
    weak = lambda k, name: F.coalesce(there(F.get("_w", F.lit(k))[name]), F.lit("").cast("variant"))
    return {
        "email": F.col("email"), "discordUsername": F.col("discord"), "submittedAt": iso_time(submitted_at), "rawScore": F.col("_s.rawScore"), "scorePercentage": F.col("_s.percentage"),
        "resultBand": F.col("_band.title"), "weakestCategoryOne": weak(0, "shortName"), "weakestCategoryOneScore": weak(0, "percentage"),
        "weakestCategoryTwo": weak(1, "shortName"), "weakestCategoryTwoScore": weak(1, "percentage"), **tracking_fields(F.col("_c"), F.col("_u")),
    }


def flat_submissions(accepted: DataFrame, submitted_at: Column | None = None) -> DataFrame:
    """One flat row per accepted submission, typed for tables: scores as doubles, as claimed, null where the record has an empty string."""
    fields = submission_fields(F.current_timestamp() if submitted_at is None else submitted_at)
    number = lambda x: F.when(F.schema_of_variant(x) != "STRING", F.try_variant_get(x, "$", "double"))
    typed = {n: number(x) if n in NUMERIC else x.cast("string") for n, x in fields.items()}
    return _taken_apart(accepted).select("k", F.lit("scorecard_submission").alias("type"), *[x.alias(n) for n, x in typed.items()])


def submission_records(accepted: DataFrame, submitted_at: Column | None = None) -> DataFrame:
    """(k, value): the JSON record of each accepted submission, with one timestamp, as receivers get it.

    The flat fields stand there twice, beside type and once more in `fields`; then the nested result, answers (`{}` if there are none),
    the context as it came (null if there is none) and the request's context. What the request leaves out is left out.
    """
    at = F.current_timestamp() if submitted_at is None else submitted_at
    flat = [x.alias(n) for n, x in submission_fields(at).items()]
    listed = lambda n, names: F.transform(F.try_variant_get(f"_s.{n}", "$", "array<variant>"), lambda x: _of(x, names)).alias(n)
    result = F.struct("_s.rawScore", "_s.percentage", F.col("_band.title").alias("resultBand"), listed("weakestCategories", WEAKEST), listed("categoryScores", SCORES))
    record = F.struct(
        F.lit("scorecard_submission").alias("type"), *flat, F.struct(*flat).alias("fields"), result.alias("result"), F.coalesce("answers", F.parse_json(F.lit("{}"))).alias("answers"),
        F.coalesce("context", F.parse_json(F.lit("null"))).alias("trackingContext"), request_context(F.col("headers")).alias("requestContext"), iso_time(at).alias("timestamp"),
    )
    return _taken_apart(accepted).select("k", F.to_json(record).alias("value"))


def event_records(accepted: DataFrame, key: str, at: Column | None = None) -> DataFrame:
    """(key, value): the JSON record of each accepted event request: payload `{}` and context null where there are none."""
    record = F.struct(
        F.lit("scorecard_event").alias("type"), F.col("event_name").alias("eventName"), F.coalesce("payload", F.parse_json(F.lit("{}"))).alias("payload"),
        F.coalesce("context", F.parse_json(F.lit("null"))).alias("trackingContext"), request_context(F.col("headers")).alias("requestContext"),
        iso_time(F.current_timestamp() if at is None else at).alias("timestamp"),
    )
    return accepted.select(key, F.to_json(record).alias("value"))


def attribution(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with the five utm columns, empty where missing; click ids stay in `tracked` only."""
    at = lambda key: F.coalesce(F.get(F.filter("tracked", lambda x: x["key"] == key), F.lit(0))["value"], F.lit(""))
    return pages.withColumn("tracked", tracked_parameters(F.col(url))).withColumns({f"utm_{n}": at(f"utm_{n}") for n in UTM})


def parameter_rows(pages: DataFrame) -> DataFrame:
    """(page_id, utm_key, utm_value) of each tracked parameter."""
    return pages.select("page_id", F.inline(tracked_parameters(F.col("url"))).alias("utm_key", "utm_value"))


def touches(events: DataFrame) -> DataFrame:
    """First and last touch of each user in one aggregation, by (ts, event_id): first_ts, first_event, last_event."""
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min_by("event_type", at).alias("first_event"), F.max_by("event_type", at).alias("last_event"))


def contexts(visits: DataFrame) -> DataFrame:
    """The context of each visitor (visits: user_id, ts, event_id, url, referrer): sessionId, firstSeenAt, landingPage, referrer and utm (a map)
    stay those of the first visit; currentPage is that of the last. A stored context that can't be read counts as none."""
    at = F.struct("ts", "event_id")
    first = F.min_by(F.struct("ts", "url", "referrer"), at).alias("first")
    found = visits.groupBy("user_id").agg(first, F.max_by("url", at).alias("currentPage"))
    return found.select(
        "user_id", F.concat(F.lit("session_"), F.col("user_id").cast("string")).alias("sessionId"), iso_time(F.col("first.ts")).alias("firstSeenAt"),
        F.col("first.url").alias("landingPage"), "currentPage", F.coalesce("first.referrer", F.lit("")).alias("referrer"), F.map_from_entries(tracked_parameters(F.col("first.url"))).alias("utm"),
    )


def contexts_with_stored(visits: DataFrame, stored: DataFrame) -> DataFrame:
    """`contexts` of visitors of whom some have a context from before (stored: user_id, stored as JSON text, at most one row each).

    A stored context wins: all that it says stays, and only currentPage becomes that of the last visit, if there is one. What it leaves
    out stays null. Text that is no JSON object counts as nothing stored. Visitors who only have a stored one are there too; those with
    neither aren't. One aggregation and one full join by visitor. visits: as `contexts` takes them.
    """
    known = stored_context(stored.select("user_id", "stored")).where(F.startswith(F.schema_of_variant("stored"), F.lit("OBJECT")))
    both = contexts(visits).join(known, "user_id", "full")
    is_old = F.col("stored").isNotNull()
    old = lambda n, kind="string": F.try_variant_get("stored", f"$.{n}", kind)
    fixed = [F.when(is_old, old(n)).otherwise(F.col(n)).alias(n) for n in ("sessionId", "firstSeenAt", "landingPage")]
    return both.select(
        "user_id", *fixed, F.coalesce("currentPage", old("currentPage")).alias("currentPage"), F.when(is_old, old("referrer")).otherwise(F.col("referrer")).alias("referrer"),
        F.when(is_old, old("utm", "map<string,string>")).otherwise(F.col("utm")).alias("utm"), is_old.alias("was_stored"),
    )


def stored_context(df: DataFrame, column: str = "stored") -> DataFrame:
    """df with the column read as VARIANT: null where it isn't JSON, as if nothing was stored."""
    return df.withColumn(column, F.try_parse_json(column))


def envelopes(df: DataFrame, name: Column, payload: dict[str, Column], context: Column | None = None, undefined: dict[str, Column] | None = None) -> DataFrame:
    """df with value: an event as JSON. Null payload fields are written as null; those for which `undefined` is true are left out."""
    undefined = undefined or {}
    fields = [F.when(~undefined[n], given(x)).alias(n) if n in undefined else given(x).alias(n) for n, x in payload.items()]
    body = F.struct(name.alias("eventName"), F.struct(*fields).alias("payload"), (F.parse_json(F.lit("null")) if context is None else context).alias("trackingContext"))
    return df.withColumn("value", F.to_json(body))


def score_payload() -> dict[str, Column]:
    """The seven scalars of score events by their names on the wire, from the columns of scoring.event_payload."""
    return dict(zip(SCORE_FIELDS, map(F.col, ("raw_score", "percentage", "band", "weakest_1", "weakest_1_percentage", "weakest_2", "weakest_2_percentage"))))


def event_payload_of(name: str) -> dict[str, Column]:
    """The payload of an event of rubric.EVENTS, or landing_cta_clicked for a click on the first page, from columns named as these fields in
    snake case (and those of score_payload). ValueError for another name."""
    if name not in (*rubric.EVENTS, "landing_cta_clicked"):
        raise ValueError(f"no event is named {name}")
    own = lambda *names: {n: F.col("".join(f"_{c.lower()}" if c.isupper() else c for c in n)) for n in names}
    more = {
        "scorecard_started": own("resumed", "unlocked"), "question_answered": own("questionId", "category", "step", "value"),
        "email_submitted": score_payload() | own("email", "discordUsername", "deliveredToCaptureEndpoint"),
        "audit_cta_clicked": score_payload() | own("hasEmail", "location", "destination"), "roadmap_cta_clicked": score_payload() | own("hasEmail", "location", "destination"),
        "landing_cta_clicked": own("location", "destination"),
    }
    return more.get(name, score_payload())


def redacted(df: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """df with personal columns replaced by salted digests, equal for equal values without case."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.sha2(F.concat(F.lit(salt), F.lower(c)), 256)) for c in columns})


