"""ATT&CK technique rules as SQL predicates, and tagging as one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.registry import SUPPORTED_CLASSES


@dataclass(frozen=True)
class TechniqueRule:
    """A technique fires on events of one class for which ``condition`` is true.

    ``condition`` is SQL over event fields, or a function returning a Column.
    Null counts as no match.
    """

    technique_id: str
    class_uid: int
    condition: str | Callable[[], Column]
    description: str = ""

    def column(self) -> Column:
        return F.expr(self.condition) if isinstance(self.condition, str) else self.condition()


# Technique id, event class and condition of the sixteen built-in rules.
BUILTIN_RULES: tuple[TechniqueRule, ...] = (
    TechniqueRule("T1078", 6003, "activity_id = 1 AND severity_id = 1", "valid account used"),
    TechniqueRule("T1110", 6003, "activity_id = 2 AND severity_id = 3", "brute force"),
    TechniqueRule("T1110.001", 6003, "activity_id = 2 AND contains(lower(auth.protocol), 'ntlm')", "password guessing"),
    TechniqueRule("T1078.002", 6003, "activity_id = 1 AND contains(actor.user.name, chr(92))", "domain account used"),
    TechniqueRule("T1059", 4001, "lower(actor.process.name) LIKE ANY ('%cmd.exe%', '%powershell%')", "command interpreter"),
    TechniqueRule("T1059.001", 4001, "contains(lower(actor.process.name), 'powershell')", "PowerShell"),
    TechniqueRule("T1055", 4001, "contains(lower(actor.process.name), 'svchost') AND process.name IS NOT NULL", "process injection"),
    TechniqueRule("T1053", 4001, "lower(actor.process.name) LIKE ANY ('%schtasks%', '%at.exe%')", "scheduled task"),
    TechniqueRule("T1071", 3001, "dst_endpoint.port IN (80, 443)", "web protocol to the outside"),
    TechniqueRule("T1048", 3001, "network.bytes_out > 10000000", "large outbound transfer"),
    TechniqueRule("T1090", 3001, "dst_endpoint.port > 8080", "high port, possible proxy"),
    TechniqueRule("T1046", 3001, "dst_endpoint.port IS NOT NULL AND network.bytes_out = 0", "port probing"),
    TechniqueRule("T1190", 3002, "contains(CAST(http.response.code AS STRING), '5')", "server error under attack"),
    TechniqueRule("T1059.007", 3002, "contains(lower(http.request.url.path), '<script')", "script tag in the request"),
    TechniqueRule(
        "T1005",
        1001,
        "contains(lower(file.path), concat(chr(92), 'windows', chr(92), 'system32'))"
        " OR contains(lower(file.path), '/etc/passwd') OR contains(lower(file.path), '/etc/shadow')",
        "sensitive local file",
    ),
    TechniqueRule("T1070.004", 1001, "activity_id = 4", "file deleted"),
)


def technique_ids(rules: Iterable[TechniqueRule] = BUILTIN_RULES, class_uid: int | None = None) -> Column:
    """Array of the technique ids that fire, in rule order.

    Rules are grouped by class, so an event is only tested against its own class;
    for a scan of one class give ``class_uid`` and the others are left out.
    """
    by_class: dict[int, list[TechniqueRule]] = {}
    for rule in rules:
        by_class.setdefault(rule.class_uid, []).append(rule)

    def fired(group: list[TechniqueRule]) -> Column:
        return F.array_compact(F.array(*[F.when(r.column(), F.lit(r.technique_id)) for r in group]))

    nothing = F.array().cast("array<string>")
    if class_uid is not None:
        return fired(by_class[class_uid]) if class_uid in by_class else nothing
    tagged = None
    for uid, group in by_class.items():
        test = F.col("class_uid") == uid
        tagged = F.when(test, fired(group)) if tagged is None else tagged.when(test, fired(group))
    return nothing if tagged is None else tagged.otherwise(nothing)


def tag_events(events: DataFrame, rules: Iterable[TechniqueRule] = BUILTIN_RULES, class_uid: int | None = None) -> DataFrame:
    """Set ``mitre_technique_ids``; null, not empty, where nothing fires."""
    found = technique_ids(rules, class_uid)
    return events.withColumn("mitre_technique_ids", F.when(F.size(found) > 0, found))


def explode_techniques(tagged: DataFrame) -> DataFrame:
    """One row per event and technique."""
    return tagged.withColumn("technique_id", F.explode("mitre_technique_ids"))


def count_techniques(tagged: DataFrame, *by) -> DataFrame:
    """Events per technique, optionally also by other columns."""
    return explode_techniques(tagged).groupBy("technique_id", *by).agg(F.count(F.lit(1)).alias("events"))


def rules_dataframe(spark: SparkSession, rules: Iterable[TechniqueRule] = BUILTIN_RULES) -> DataFrame:
    return spark.createDataFrame(
        [(i, r.technique_id, r.class_uid, r.description) for i, r in enumerate(rules)],
        "rule_order int, technique_id string, class_uid int, description string",
    )


def techniques_by_class(spark: SparkSession, rules: Iterable[TechniqueRule] = BUILTIN_RULES) -> DataFrame:
    """Every supported class with its sorted technique ids; classes without rules keep an empty list."""
    classes = spark.createDataFrame([(c,) for c in SUPPORTED_CLASSES], "class_uid int")
    per_class = rules_dataframe(spark, rules).groupBy("class_uid").agg(
        F.sort_array(F.collect_set("technique_id")).alias("technique_ids")
    )
    return classes.join(per_class, "class_uid", "left").withColumn(
        "technique_ids", F.coalesce("technique_ids", F.array().cast("array<string>"))
    )


def rules_for_class(class_uid: int, rules: Iterable[TechniqueRule] = BUILTIN_RULES) -> list[TechniqueRule]:
    return [rule for rule in rules if rule.class_uid == class_uid]
