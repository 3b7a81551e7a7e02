import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.errors import RuleNotConfirmedError, RuleNotFoundError
from tidewatch.operators import coverage as C
from tidewatch.operators import rules as R
from tidewatch.plans.backtest import backtest_rule
from tidewatch.sources.audit import AuditLog
from tidewatch.sources.rules import RuleStore
from tidewatch.sources.store import EventStore

YAML = "title: t\ndetection:\n  keywords:\n    - malware\n    - 'Quoted'\nfalsepositives:\n  - none\n"


def found(spark, yaml, compat=False):
    return spark.range(1).select(R.keywords(F.lit(yaml), compat).alias("k")).first().k


def test_keywords(spark):
    assert found(spark, YAML) == ["malware", "Quoted"]
    assert found(spark, YAML, compat=True) == ["- malware", "malware", "Quoted", "none"]
    assert found(spark, "keywords: inline one\nvalue: 'two'\n") == ["inline one", "two"]
    assert found(spark, "title: x") == [] == found(spark, "title: x", compat=True)
    assert found(spark, "sel:\n  - value: x y\nKEYWORDS:\n- a\n-   b\nother:\n- c") == ["x y", "a", "b"]


@pytest.mark.parametrize("options", [{}, {"literal_keywords": 0}])
def test_keyword_search_agrees_with_brute_force(spark, options):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", "a"]
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = {r.id: list(r.hits) for r in R.with_keyword_hits(rows, keywords, **options).collect()}
    assert got == {i: [w for w in words if w in t] for i, t in enumerate(texts)}


def test_many_rules_against_brute_force(spark, make_events):
    events = make_events([{"actor.user.name": f"user{i % 13}", "src_endpoint.ip": f"10.0.0.{i % 7}"} for i in range(100)])
    rules = spark.createDataFrame(
        [(f"r{i}", f"keywords:\n  - USER{i}\n  - 10.0.0.{i}\n") for i in range(15)] + [("empty", "title: x")],
        "rule_id string, yaml_content string",
    )
    got = {r.rule_id: (r.match_count, r.total_events) for r in R.backtest_rules(events, rules, skip=("id",)).collect()}
    texts = [f"user{i % 13} 10.0.0.{i % 7}" for i in range(100)]
    want = {f"r{i}": sum(f"user{i}" in t or f"10.0.0.{i}" in t for t in texts) for i in range(15)}
    assert got == {**{k: (v, 100) for k, v in want.items()}, "empty": (0, 100)}


def test_versions(spark):
    rows = [("a", f"y{i}", f"2026-01-01 {i // 4:02d}:{i % 4:02d}:00") for i in range(20)] + [("b", "z", "2026-01-01 00:00:00")]
    submissions = spark.createDataFrame(rows, "rule_id string, yaml_content string, t string").withColumn("submitted_at", F.to_timestamp("t"))
    numbered = {(r.rule_id, r.yaml_content): r.version for r in R.number_versions(submissions).collect()}
    assert numbered == {**{("a", f"y{i}"): i + 1 for i in range(20)}, ("b", "z"): 1}
    confirmations = spark.createDataFrame([("a", 19), ("b", 1)], "rule_id string, version int").withColumn("confirmed_at", F.current_timestamp())
    latest = {r.rule_id: r for r in R.latest_rules(submissions, confirmations).collect()}
    assert latest["a"].version == 20 and latest["a"].yaml_content == "y19" and not latest["a"].analyst_confirmed
    assert latest["b"].analyst_confirmed and latest["b"].sha256 == hashlib.sha256(b"z").hexdigest()


@pytest.fixture
def rules(spark, tmp_path):
    return RuleStore(spark, str(tmp_path / "rules"), AuditLog(spark, str(tmp_path / "audit")))


def test_lifecycle(rules):
    assert rules.store_rule("r1", YAML) == 1
    with pytest.raises(RuleNotConfirmedError):
        rules.export_rule("r1")
    rules.confirm_rule("r1", "s")
    assert rules.export_rule("r1") == YAML
    assert rules.list_rules(confirmed_only=True).count() == 1
    assert rules.store_rule("r1", YAML + "x") == 2
    assert not rules.get_rule("r1").analyst_confirmed
    assert rules.list_rules(confirmed_only=True).count() == 0 and rules.versions().count() == 2
    events = [r.event_type for r in rules.audit.read("rule_audit").orderBy("occurred_at").collect()]
    assert events == ["created", "confirmed", "exported", "updated"]
    for call in (rules.get_rule, rules.confirm_rule, rules.export_rule):
        with pytest.raises(RuleNotFoundError):
            call("nope")
        with pytest.raises(TypeError):
            call(None)
    with pytest.raises(ValueError):
        rules.store_rule(" ", YAML)
    with pytest.raises(TypeError):
        rules.store_rule("r", None)


def test_backtest_counts_each_event_once(spark, rules, make_events, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    store.append(make_events([{"class_uid": 3001, "message": "MalwareX"}, {"class_uid": 6003}]))
    store.append_replay(make_events([{"class_uid": 3001, "message": "quoted"}, {"class_uid": 4001}]), "s1")
    rules.store_rule("r1", YAML)
    matched, totals = backtest_rule(store, rules, "r1", "s1")
    assert matched.count() == 2
    assert (totals["match_count"], totals["total_events"], totals["base_events"], totals["session_events"]) == (2, 4, 2, 2)
    assert totals["match_rate"] == "50.0%"
    with pytest.raises(TypeError):
        backtest_rule(store, rules, "r1", None)
    assert spark.range(1).select(R.match_rate(F.lit(0), F.lit(0)).alias("r")).first().r == "N/A"


def rule_rows(spark, *rows):
    return spark.createDataFrame(list(rows) or [], "yaml_content string, analyst_confirmed boolean")


def test_coverage(spark):
    rules = rule_rows(spark, ("tags: T1059.001", True), ("tags: T1005", False))
    matrix = C.coverage_matrix(rules)
    rows = matrix.collect()
    assert len(rows) == 16 and rows[0].technique_id == "T1190" and rows[-1].tactic == "Command and Control"
    assert {r.technique_id for r in rows if r.has_sigma_rule} == {"T1059", "T1059.001"}
    assert all(r.has_rule_match for r in rows) and rows[0].class_uids == [3002]
    summary = C.coverage_summary(matrix).first()
    assert summary.sigma_confirmed_count == 2 and float(summary.coverage_percent) == 12.5
    assert summary.uncovered_techniques[0] == "T1190" and len(summary.uncovered_techniques) == 14
    text = C.coverage_text(C.coverage_summary(matrix)).first().text
    assert text.startswith("ATT&CK Coverage: 2/16 techniques (12.5%)\nUncovered techniques: 14\nMissing: T1190, ")
    assert len(text.split("Missing: ")[1].split(", ")) == 10
    assert C.techniques_for_tactic(matrix, "Execution").count() == 3
    with pytest.raises(ValueError):
        C.techniques_for_tactic(matrix, " ")
    grid = {r.tactic: r.asDict() for r in C.heatmap(matrix).collect()}
    assert grid["Execution"]["T1059"] == "sigma" and grid["Execution"]["T1059.007"] == "rule" and grid["Execution"]["T1005"] == "none"


def test_coverage_without_rules(spark):
    matrix = C.coverage_matrix(rule_rows(spark).limit(0))
    assert matrix.count() == 16 and matrix.where("has_sigma_rule").count() == 0
    assert C.coverage_by_tactic(matrix).agg(F.sum("covered")).first()[0] == 0


def test_versions_of_one_time_have_a_fixed_order(spark):
    at = "timestamp '2026-01-01 00:00:00'"
    rows = spark.range(50).selectExpr("'r' AS rule_id", "concat('y', id) AS yaml_content", f"{at} AS submitted_at", "id AS sequence")
    order = ("submitted_at", "sequence")
    assert R.latest_rules(rows.repartition(7), order=order).first().yaml_content == "y49"
    numbered = {r.yaml_content: r.version for r in R.number_versions(rows.repartition(5), order).collect()}
    assert numbered == {f"y{i}": i + 1 for i in range(50)}


def test_more_keywords_than_literals(spark, make_events):
    """Several hundred keywords over nested events, along every path."""
    from pyspark.sql import functions as F

    events = make_events([{"actor.user.name": f"user{i}x"} for i in range(40)])
    rules = spark.range(300).select(
        F.concat(F.lit("r"), "id").alias("rule_id"),
        F.format_string("detection:\n  keywords:\n    - user%dx\n    - other%d\n", "id", "id").alias("yaml_content"),
    )
    want = {f"r{i}": int(i < 40) for i in range(300)}
    for options in ({}, {"literal_keywords": 1000}):
        got = {r.rule_id: r.match_count for r in R.backtest_rules(events, rules, **options).collect()}
        assert got == want
