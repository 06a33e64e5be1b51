"""Next best actions for all customers at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelet.functions.records import optional
from tracelet.functions.text import clamp, tokenize
from tracelet.operators.model import Model
from tracelet.operators.predict import predict

CATALOG_FIELDS = "token string, action_type string, primary_message string, description string, call_to_action string, target_url string, preferred_channel string"
# Well-known actions with their kinds and channels; the wording is our own.
CATALOG = (
    ("view_feature_guide", "in_app_message", "Have a look at the reporting guide", "A short tour of the reports", "Open the guide", "/features/advanced-reporting", "in_app"),
    ("invite_to_webinar", "email", "Join our next webinar", "A live session with room for questions", "Save a seat", "https://example.com/webinar", "email"),
    ("upgrade_plan", "email", "See what the larger plan adds", "Automations and more room to grow", "Compare", "/pricing", "email"),
    ("schedule_success_call", "calendar", "Let us talk about your goals", "A call with our team", "Pick a time", "/success/call", "email"),
)
FALLBACK = ("view_feature_guide", "invite_to_webinar", "schedule_success_call")
FALLBACK_PROBABILITY = 0.35


def spoken(token: Column) -> Column:
    """A token as a title: a blank before each capital behind the first letter, then every word with a capital, where words are parted by what is neither letter nor digit.

    So ``addToCart`` becomes Add To Cart, ``view_feature_guide`` becomes View_Feature_Guide.
    """
    first = F.concat(F.upper(F.substring(token, 1, 1)), F.substr(token, F.lit(2)))
    snake = F.when(token.rlike("^[a-z]+$"), token).otherwise(F.lower(F.regexp_replace(first, "(.)(?=[A-Z])", "$1 ")))
    # a blank behind whatever parts words makes the next one a word; the mark tells which blanks to take out again
    parted = F.regexp_replace(snake, r"([^\p{L}\p{M}\p{N}' ]+)", "$1\x01 ")
    return F.replace(F.initcap(parted), F.lit("\x01 "), F.lit(""))


def current_state(records: DataFrame) -> Column:
    """Last action, else the last step of the journey, else the state, else ``start``."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    journey = F.try_element_at(tokenize(optional(records, "journey_sequence")), F.lit(-1))
    return F.coalesce(blank(optional(records, "last_action")), blank(journey), blank(optional(records, "customer_state")), F.lit("start"))


def customers(records: DataFrame) -> DataFrame:
    """The fields that recommending needs, whatever the records have."""
    peak = F.coalesce(optional(records, "preferred_contact_hour", "int"), optional(records, "usage_peak_hour", "int"))
    day = F.coalesce(optional(records, "preferred_contact_day"), optional(records, "usage_peak_day"))
    pairs = {
        "customer_state": F.coalesce(optional(records, "customer_state"), optional(records, "state"), F.lit("unknown")),
        "days_since_signup": optional(records, "days_since_signup"), "last_action": optional(records, "last_action"),
        "session_duration": optional(records, "session_duration"), "feature_adoption": F.coalesce(optional(records, "feature_adoption_rate"), optional(records, "feature_usage_breadth")),
    }
    context = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull() & (v != ""))
    return records.select(
        F.coalesce(optional(records, "customer_id"), optional(records, "id"), F.lit("unknown")).alias("customer_id"),
        current_state(records).alias("state"), tokenize(optional(records, "journey_sequence")).alias("journey"),
        clamp(F.coalesce(optional(records, "engagement_score", "double"), F.lit(0.5))).alias("engagement"),
        optional(records, "preferred_channel").alias("own_channel"),
        F.when(peak.isNotNull(), F.format_string("%02d:00", peak)).otherwise("14:30").alias("optimal_time"), F.coalesce(day, F.lit("Wednesday")).alias("optimal_day"), context.alias("context"),
    )


def candidates(model: Model, rows: DataFrame, top: int, excluded: Sequence[str]) -> DataFrame:
    """(customer_id, rank, token, probability): predictions for each customer's state, their probabilities made to sum to one before anything is excluded; each state is predicted once.

    A customer without any gets the steps of the journey; one left with nothing gets the fallback.
    """
    limit = top + len(set(excluded)) + 5
    states = predict(model, rows.select("state").distinct(), "state", limit).where("token <> ''")
    whole = Window.partitionBy("seed")
    share = states.withColumn("p", F.when(F.sum("probability").over(whole) > 0, F.col("probability") / F.sum("probability").over(whole)).otherwise(0.0))
    listed = share.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("rank", "token", F.col("p").alias("probability")))).alias("found"))
    met = rows.join(listed, rows["state"] == listed["seed"], "left")
    journey = F.transform(F.array_distinct("journey"), lambda t, i: F.struct((i + 1).cast("int").alias("rank"), t.alias("token"), F.greatest(F.lit(0.05), 0.5 - 0.05 * i).cast("double").alias("probability")))
    some = F.when(F.size(F.coalesce("found", F.array().cast("array<struct<rank:int,token:string,probability:double>>"))) > 0, F.col("found")).otherwise(journey)
    left = F.filter(some, lambda x: ~x["token"].isin(*excluded)) if excluded else some
    spare = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(t).alias("token"), F.lit(FALLBACK_PROBABILITY).alias("probability")) for i, t in enumerate(FALLBACK)])
    return met.withColumn("left", left).withColumn("picked", F.when(F.size("left") > 0, F.slice("left", 1, max(1, top))).otherwise(F.slice(spare, 1, max(1, top))))


def next_best_actions(model: Model, records: DataFrame, top: int = 1, excluded: Sequence[str] = (), include_context: bool = False, catalog: DataFrame | None = None) -> DataFrame:
    """One row for each customer and recommended action, with impact, channel and schedule."""
    rows = customers(records)
    picked = candidates(model, rows, top, excluded)
    kept = ["customer_id", "state", "engagement", "own_channel", "optimal_time", "optimal_day", "context"]
    each = picked.select(*kept, F.posexplode("picked").alias("at", "a")).select(*kept, (F.col("at") + 1).alias("rank"), F.col("a.token").alias("recommended_action"), F.col("a.probability").alias("probability"))
    known = catalog if catalog is not None else model.transitions.sparkSession.createDataFrame(CATALOG, CATALOG_FIELDS)
    known = known.withColumnRenamed("token", "recommended_action")
    met = each.join(known, "recommended_action", "left")
    label = spoken(F.col("recommended_action"))
    p, e = F.col("probability"), F.col("engagement")
    out = [
        "customer_id", "rank", "state", "recommended_action", "probability",
        F.substring(F.sha2(F.concat_ws("|", "customer_id", "recommended_action"), 256), 1, 16).alias("action_id"),
        F.coalesce("action_type", F.lit("in_app_message")).alias("action_type"), F.coalesce("primary_message", F.concat(F.lit("Try "), label)).alias("primary_message"),
        F.coalesce("description", F.lit("A step that others took next")).alias("description"), F.coalesce("call_to_action", F.lit("Open")).alias("call_to_action"), F.coalesce("target_url", F.lit("/app")).alias("target_url"),
        F.coalesce("own_channel", "preferred_channel", F.lit("in_app")).alias("channel"),
        clamp(p * 0.6 + e * 0.2).alias("engagement_lift"), clamp(p * 0.35).alias("conversion_lift"), clamp(p * 0.25 + e * 0.25).alias("retention_lift"),
        "optimal_time", "optimal_day", F.lit("1_per_week").alias("frequency_cap"),
    ]
    return met.select(*out, *(["context"] if include_context else []))


def for_customer(records: DataFrame, customer_id: str | None) -> DataFrame:
    """The records of one customer; without an id one record."""
    return records.limit(1) if customer_id is None else records.where(F.coalesce(optional(records, "customer_id"), optional(records, "id")) == customer_id).limit(1)
