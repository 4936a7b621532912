"""Answers, submissions and behaviour events as tables: from wire JSON, and derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom import rubric
from scoreloom.functions.rules import NUMBERS, band, status, variant_fields
from scoreloom.operators.capture import SUMMARY


# The fields of a request's body that are read.
BODY = ("email", "discordUsername", "eventName", "payload", "answers", "trackingContext", "summary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt evenly over as many tasks as the session shuffles with. A small file is read by one task, however many rows it has and
    however much is made of each, so what costs much is made after this; rows should have the columns for it only."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def answers_from_events(events: DataFrame) -> DataFrame:
    """(respondent_id, question_id, value, ts, event_id): one row per click, as an append-only log."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return events.select(
        F.col("user_id").alias("respondent_id"), (F.col("event_id") % 15 + 1).cast("int").alias("question_id"), (k % 5).cast("int").alias("value"), "ts", "event_id"
    )


def answers_from_json(df: DataFrame, key: str = "respondent_id", column: str = "answers") -> DataFrame:
    """(key, question_id, value) from a JSON object of answers by question id. Only numbers count as answered; text that isn't a
    JSON object gives no row, and one bad value spoils only itself. A key is a question's if it is the number's own text: neither "01" nor
    " 1" is question 1. Of a key that repeats the last value counts."""
    last_key_wins(df.sparkSession)
    parsed = df.select(F.col(key), F.try_parse_json(column).alias("v")).where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    each = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "k", "x"))
    value = F.when(F.schema_of_variant("x").rlike(NUMBERS), F.try_variant_get("x", "$", "double"))
    question = F.col("k").try_cast("int")
    return each.where(question.cast("string") == F.col("k")).select(key, question.alias("question_id"), value.alias("value"))


def last_key_wins(spark: SparkSession) -> None:
    """From now on JSON objects that repeat a key are read in this session as browsers and servers do: the last value counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _claimed_category(k: Column, ordinal: Column) -> Column:
    """A category as a summary claims it, made up by rule."""
    at = lambda part: F.element_at(F.array(*[F.lit(c[part]) for c in rubric.CATEGORIES]), ordinal)
    pct = ((k + ordinal) % 101).cast("int")
    return F.struct(
        at(0).alias("id"), at(1).alias("name"), at(1).alias("shortName"), F.lit("x").alias("definition"), ((k + ordinal) % 13).cast("int").alias("rawScore"),
        pct.alias("percentage"), status(pct).alias("status"),
    )


def submissions_from_customers(customer: DataFrame) -> DataFrame:
    """(k, value, headers): a request body in JSON for each customer, some of them bad or incomplete by rule.

    No `@` in the email (k % 7 = 0), none (k % 17), a blank discord name (k % 11), no percentage (k % 13), no weakest categories
    (k % 19), one of them only (k % 5); answers, context, utm and headers of some only.
    """
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    email = F.when(k % 7 == 0, F.concat(F.lit("c"), s, F.lit(".example.com"))).when(k % 17 == 0, "").otherwise(F.concat(F.lit("c"), s, F.lit("@mail.example.com")))
    discord = F.when(k % 11 == 0, "   ").otherwise(F.concat(F.lit(" user"), s, F.lit(" ")))
    pct = (k % 101).cast("int")
    some = F.when(k % 19 != 0, F.transform(F.sequence(F.lit(1), F.when(k % 5 == 0, 1).otherwise(2)), lambda i: _claimed_category(k, i)))
    summary = F.struct(
        (k % 61).cast("int").alias("rawScore"), F.when(k % 13 != 0, pct).alias("percentage"), F.struct(band(pct).alias("title")).alias("band"),
        F.transform(F.sequence(F.lit(1), F.lit(len(rubric.CATEGORIES))), lambda i: _claimed_category(k, i)).alias("categoryScores"), some.alias("weakestCategories"),
    )
    utm = F.when(k % 2 == 0, F.struct(F.concat(F.lit("s"), (k % 4).cast("string")).alias("utm_source"), F.lit("g").alias("gclid")))
    context = F.when(k % 3 != 0, F.struct(F.concat(F.lit("session"), s).alias("sessionId"), F.lit("/start").alias("landingPage"), F.lit("/now").alias("currentPage"), F.lit("").alias("referrer"), utm.alias("utm")))
    answers = F.when(k % 4 != 0, F.struct((k % 5).cast("int").alias("1"), F.lit(4).alias("2")))
    body = F.struct(email.alias("email"), discord.alias("discordUsername"), answers.alias("answers"), summary.alias("summary"), context.alias("trackingContext"))
    headers = F.when(k % 2 == 0, F.create_map(F.lit("user-agent"), F.lit("agent"), F.lit("x-vercel-ip-country"), F.lit("DE"))).otherwise(F.create_map(F.lit("referer"), F.lit("http://r")))
    return customer.select(k.alias("k"), F.to_json(body).alias("value"), headers.alias("headers"))


def _text(v: Column) -> Column:
    """A VARIANT's string; null for anything else, as nothing is turned into a string."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def truthy(v: Column) -> Column:
    """Whether a VARIANT is a value that counts as true: not missing, null, false, 0 or an empty string."""
    kind = F.schema_of_variant(v)
    value = F.when(kind == "STRING", F.try_variant_get(v, "$", "string") != "").when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind.rlike(NUMBERS), F.try_variant_get(v, "$", "double") != 0)
    return F.coalesce(value, F.coalesce(kind != "VOID", F.lit(False)))


def parse_requests(df: DataFrame, column: str = "value") -> DataFrame:
    """df with what a request body says, each field of its own type or null, and never turned into another:

    is_json, is_object, email, discord, odd_discord (neither a string nor null), has_event_name and event_name (VARIANT), payload, answers and
    context (VARIANT, null where missing or null), summary (VARIANT), percentage, has_parts (the summary's band and both lists are there).

    The body is parsed once per row, below a generator, so that neither filters nor joins on what it says parse it again; the fields are
    made before it, where Spark computes what they share once. Only values that are told apart by type have their schema written, which
    costs as much as all that is in them. Columns of df with these names are replaced. Of a key that repeats the last value counts.
    """
    last_key_wins(df.sparkSession)
    v, kind = F.col("_v"), lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    is_there = lambda x: x.isNotNull() & ~F.is_variant_null(x)
    there = lambda x: F.when(is_there(x), x)
    whole = lambda x: F.coalesce(~F.exists(F.try_variant_get(x, "$", "array<variant>"), lambda y: ~is_there(y)), F.lit(False))
    at, of = (lambda n: F.col(f"_b.{n}")), (lambda n: F.col(f"_s.{n}"))
    fields = {
        "is_json": v.isNotNull(), "is_object": F.col("_b").isNotNull(),
        "email": _text(at("email")), "discord": _text(at("discordUsername")), "odd_discord": ~kind(at("discordUsername")).isin("STRING", "VOID"),
        "has_event_name": truthy(at("eventName")), "event_name": there(at("eventName")), "payload": there(at("payload")), "answers": there(at("answers")),
        "context": there(at("trackingContext")), "summary": there(at("summary")),
        "percentage": F.when(kind(of("percentage")).rlike(NUMBERS), F.try_variant_get(of("percentage"), "$", "double")),
        "has_parts": is_there(of("band")) & whole(of("weakestCategories")) & whole(of("categoryScores")),
    }
    others = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in fields]
    # each object is taken apart once, into fields that are VARIANT again, so that none fails for its type
    parsed = df.withColumn("_v", F.try_parse_json(column)).withColumn("_b", variant_fields(v, BODY)).withColumn("_s", variant_fields(F.col("_b.summary"), SUMMARY))
    made = parsed.select(*others, F.struct(*[x.alias(n) for n, x in fields.items()]).alias("_f"))
    return made.select(*others, F.inline(F.array("_f")))


def stored_states(df: DataFrame) -> DataFrame:
    """(respondent_id, answers, email, discord, unlocked) from what was stored as text under four keys: answers as VARIANT, null where they can't
    be read, as if they weren't there; names empty where there are none; unlocked only where the text is `true`."""
    last_key_wins(df.sparkSession)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.select("respondent_id", F.try_parse_json("answers").alias("answers"), text("email"), text("discord"), (F.coalesce("unlocked", F.lit("")) == "true").alias("unlocked"))


def states_to_store(states: DataFrame) -> DataFrame:
    """What `stored_states` reads, from (respondent_id, answers: VARIANT, email, discord, unlocked): answers as JSON text, the flag as text; a blank
    name isn't stored."""
    filled = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return states.select("respondent_id", F.to_json("answers").alias("answers"), filled("email"), filled("discord"), F.col("unlocked").cast("string").alias("unlocked"))
