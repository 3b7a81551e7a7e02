"""Z-score anomalies of current values against baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.baselines import KEYS

THRESHOLD = 3.0  # fixed value; strictly more is an anomaly


def _z_score(threshold: float) -> Column:
    distance = F.col("current_value") - F.col("baseline_mean")
    flat = F.when(distance == 0, 0.0).otherwise(threshold + 1.0)  # all observations were equal
    return F.when(F.col("baseline_stddev") == 0, flat).otherwise(distance / F.col("baseline_stddev"))


def detect_anomalies(current: DataFrame, baselines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Join current values to baselines; rows without a baseline or a finite value give no result.

    The baseline side is not forced into a broadcast: it grows with the number of
    entities, so Spark decides by size, and adaptive execution splits the event
    side when one entity holds much of the data.
    """
    finite = current.where(
        F.col("current_value").isNotNull()
        & ~F.isnan("current_value")
        & (F.abs("current_value") != float("inf"))
    )
    stats = baselines.select(*KEYS, F.col("mean").alias("baseline_mean"), F.col("stddev").alias("baseline_stddev"))
    carried = [name for name in current.columns if name not in (*KEYS, "current_value")]
    z = finite.join(stats, KEYS).withColumn("z_score", _z_score(threshold))
    return z.select(
        *carried,
        "entity_type",
        "entity_value",
        "metric_name",
        "class_uid",
        "current_value",
        "baseline_mean",
        "baseline_stddev",
        "z_score",
        (F.abs("z_score") > threshold).alias("is_anomaly"),
        F.lit(threshold).alias("threshold"),
    )


def display_anomalies(results: DataFrame) -> DataFrame:
    return results.select(
        F.concat_ws("=", "entity_type", "entity_value").alias("entity"),
        F.col("metric_name").alias("metric"),
        "current_value",
        "baseline_mean",
        "z_score",
        "is_anomaly",
    )


# Fixed value: the text shown when no model explains an anomaly.
_MESSAGE = (
    "[LLM unavailable] Anomaly detected: %s for %s=%s deviated %.2f standard "
    "deviations from the baseline mean of %.4f (current value: %.4f)."
)


def anomaly_message() -> Column:
    return F.format_string(
        _MESSAGE, "metric_name", "entity_type", "entity_value", "z_score", "baseline_mean", "current_value"
    )
