"""Stored structured-query responses (JSON text) to typed columns. No model is called here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidewatch.functions.text import strip
from tidewatch.operators.filters import OPERATORS, FieldFilter, QuerySpec

_RESPONSE = "class_uid string, filters string, time_range_hours string, confidence string, _corrupt string"
_FILTERS = "array<struct<field_path: string, operator: string, value: string>>"


def decode_intents(responses: DataFrame, column: str = "response") -> DataFrame:
    """Add ``intent``: struct(class_uid, filters, time_range_hours, confidence).

    Code fences are cut off; confidence is clamped to 0-1; filters with an unknown
    operator or no field go; hours below one become null. Text that is no JSON
    object yields confidence 0.0 and nothing else.
    """
    text = strip(F.col(column))
    fenced = F.startswith(text, F.lit("```"))
    bare = F.when(fenced, strip(F.regexp_replace(text, r"(?dmU)^\s*```[^\n]*(?:\n|\z)", ""))).otherwise(text)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = responses.withColumn("_bare", bare).withColumn("_json", F.from_json("_bare", _RESPONSE, options))
    usable = (
        F.startswith("_bare", F.lit("{")) & F.col("_json").isNotNull() & F.col("_json._corrupt").isNull()
    )
    hours = F.floor(F.col("_json.time_range_hours").try_cast("double")).try_cast("int")
    confidence = F.col("_json.confidence").try_cast("double")
    filters = F.filter(
        F.coalesce(F.from_json("_json.filters", _FILTERS), F.from_json(F.lit("[]"), _FILTERS)),
        lambda f: f["operator"].isin(*OPERATORS) & (strip(f["field_path"]) != ""),
    )
    intent = F.struct(
        F.when(usable, F.col("_json.class_uid").try_cast("int")).alias("class_uid"),
        F.when(usable, filters).otherwise(F.from_json(F.lit("[]"), _FILTERS)).alias("filters"),
        F.when(usable & (hours >= 1), hours).alias("time_range_hours"),
        F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) + F.when(confidence.isNull(), None).otherwise(0.0))
        .otherwise(F.lit(0.0))
        .alias("confidence"),
    )
    return parsed.withColumn("intent", intent).drop("_bare", "_json")


def runnable_intents(decoded: DataFrame) -> DataFrame:
    """The decoded intents that name an event class; others are no valid queries."""
    return decoded.where(F.col("intent.class_uid").isNotNull())


def intent_to_spec(intent: Row, text: str = "") -> QuerySpec:
    """One decoded intent as a query specification."""
    return QuerySpec(
        class_uid=intent.class_uid,
        filters=tuple(FieldFilter(f.field_path, f.operator, f.value) for f in intent.filters or ()),
        time_range_hours=intent.time_range_hours,
        confidence=intent.confidence,
        text=text,
    )
