"""Which ATT&CK techniques the confirmed rules cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.techniques import BUILTIN_RULES

# ---------------------------------------------------------------------------
# Tactics in kill-chain order, and the tactic of each technique.
# ---------------------------------------------------------------------------
TACTICS = (
    "Initial Access",
    "Execution",
    "Persistence",
    "Privilege Escalation",
    "Defense Evasion",
    "Credential Access",
    "Discovery",
    "Lateral Movement",
    "Collection",
    "Exfiltration",
    "Command and Control",
    "Impact",
)
TECHNIQUE_TACTICS = {
    "T1078": "Defense Evasion",
    "T1078.002": "Defense Evasion",
    "T1110": "Credential Access",
    "T1110.001": "Credential Access",
    "T1059": "Execution",
    "T1059.001": "Execution",
    "T1059.007": "Execution",
    "T1055": "Defense Evasion",
    "T1053": "Persistence",
    "T1071": "Command and Control",
    "T1048": "Exfiltration",
    "T1090": "Command and Control",
    "T1046": "Discovery",
    "T1190": "Initial Access",
    "T1005": "Collection",
    "T1070.004": "Defense Evasion",
}
# ------------------------------------------------------- end of fixed values


def techniques_dataframe(spark: SparkSession) -> DataFrame:
    """The sixteen techniques with tactic, tactic position and the classes of their rules."""
    classes: dict[str, set[int]] = {}
    for rule in BUILTIN_RULES:
        classes.setdefault(rule.technique_id, set()).add(rule.class_uid)
    return spark.createDataFrame(
        [(t, tactic, TACTICS.index(tactic), sorted(classes.get(t, ()))) for t, tactic in TECHNIQUE_TACTICS.items()],
        "technique_id string, tactic string, tactic_order int, class_uids array<int>",
    )


def covered_techniques(rules: DataFrame) -> DataFrame:
    """(technique_id, has_sigma_rule): whether a confirmed rule's text mentions the id.

    The ids are few and known, so this is one aggregate per id over a single scan
    of the rules, not a join. A sub-technique id also mentions its parent.
    """
    mentioned = [
        F.coalesce(F.bool_or(F.contains("yaml_content", F.lit(t))), F.lit(False)).alias(t) for t in TECHNIQUE_TACTICS
    ]
    names = [f"`{t}`" for t in TECHNIQUE_TACTICS]
    one_row = rules.where("analyst_confirmed").agg(*mentioned)
    return one_row.unpivot([], [F.col(n) for n in names], "technique_id", "has_sigma_rule")


def coverage_matrix(rules: DataFrame) -> DataFrame:
    """One row per technique, in tactic order."""
    return (
        techniques_dataframe(rules.sparkSession)
        .join(covered_techniques(rules), "technique_id", "left")
        .orderBy("tactic_order", "technique_id")
        .select(
            "technique_id",
            "tactic",
            F.lit(True).alias("has_rule_match"),
            F.coalesce("has_sigma_rule", F.lit(False)).alias("has_sigma_rule"),
            "class_uids",
        )
    )


def coverage_summary(matrix: DataFrame) -> DataFrame:
    """One row of totals."""
    uncovered = F.filter(
        F.transform(
            F.sort_array(F.collect_list(F.struct(_tactic_order(), "technique_id", "has_sigma_rule"))),
            lambda r: F.when(~r["has_sigma_rule"], r["technique_id"]),
        ),
        lambda t: t.isNotNull(),
    )
    return matrix.agg(
        F.count(F.lit(1)).alias("total_techniques"),
        F.count_if("has_rule_match").alias("rule_match_count"),
        F.count_if("has_sigma_rule").alias("sigma_confirmed_count"),
        F.coalesce(F.count_if("has_sigma_rule") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias(
            "coverage_percent"
        ),
        uncovered.alias("uncovered_techniques"),
    )


def _tactic_order() -> Column:
    order = F.lit(len(TACTICS))
    for i, tactic in enumerate(TACTICS):
        order = F.when(F.col("tactic") == tactic, i).otherwise(order)
    return order.alias("tactic_order")


def coverage_by_tactic(matrix: DataFrame) -> DataFrame:
    return (
        matrix.groupBy("tactic")
        .agg(
            F.count(F.lit(1)).alias("techniques"),
            F.count_if("has_sigma_rule").alias("covered"),
        )
        .orderBy(_tactic_order())
    )


def uncovered_techniques(matrix: DataFrame) -> DataFrame:
    covered = matrix.where("has_sigma_rule").select("technique_id")
    return matrix.join(covered, "technique_id", "left_anti")


def techniques_for_tactic(matrix: DataFrame, tactic: str) -> DataFrame:
    if tactic is None:
        raise TypeError("tactic must not be None")
    if not str(tactic).strip():
        raise ValueError("tactic must not be empty")
    return matrix.where(F.col("tactic") == tactic)


def heatmap(matrix: DataFrame) -> DataFrame:
    """Tactics down, techniques across: "sigma", "rule" or "none"."""
    cell = F.when(F.col("has_sigma_rule"), "sigma").otherwise("rule")
    ids = list(TECHNIQUE_TACTICS)
    return (
        matrix.withColumn("cell", cell)
        .groupBy("tactic")
        .pivot("technique_id", ids)
        .agg(F.first("cell"))
        .fillna("none")
        .orderBy(_tactic_order())
    )


def coverage_text(summary: DataFrame) -> DataFrame:
    """The summary as lines of text; at most ten missing techniques are named."""
    missing = F.col("uncovered_techniques")
    return summary.select(
        F.concat_ws(
            "\n",
            F.format_string(
                "ATT&CK Coverage: %d/%d techniques (%.1f%%)",
                "sigma_confirmed_count",
                "total_techniques",
                "coverage_percent",
            ),
            F.format_string("Uncovered techniques: %d", F.size(missing)),
            F.when(F.size(missing) > 0, F.concat(F.lit("Missing: "), F.array_join(F.slice(missing, 1, 10), ", "))),
        ).alias("text")
    )
