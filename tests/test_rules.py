import pytest
import re

from pyspark.sql import functions as F

from ticketloom.functions import rules
from ticketloom.functions.patterns import searchable
from ticketloom.plans.inputs import PHRASES

CASES = [
    ("Is this mug dishwasher proof?", "low"),
    ("To whom it may concern, kindly cancel order 777.", "low"),
    ("UPS says the parcel went to USPS.", "low"),
    ("The vase came cracked.", "medium"),
    ("I am rather disappointed by the wait.", "medium"),
    ("I want a full refund for 222.", "medium"),
    ("Fix it today or I start a chargeback.", "high"),
    ("This is the third time I have written.", "high"),
    ("It started sparking at the plug.", "high"),
    ("THIS IS RIDICULOUS, NO PARCEL", "high"),
    ("It is late!!", "high"),
    ("Nothing urgent, please change my address.", "low"),
    ("The tracking hasn't updated since Monday.", "medium"),
    ("My discount code was refused.", "medium"),
    ("I have a flight tomorrow and no adapter yet.", "high"),
    ("The plug gets hot to the touch.", "high"),
    ("A charge appeared that I didn't make.", "high"),
    ("The money went to a closed account.", "high"),
    ("It shows another customer's address.", "high"),
    ("Just wondering about the trip gear, the trip is in August.", "low"),
]


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "text string")
    return {r["text"]: r for r in rules.with_rules(df).collect()}


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_label(labelled, text, expected):
    assert labelled[text]["weak_label"] == expected


def test_every_rule_fires_on_some_input_phrase(spark):
    df = rules.with_rules(spark.createDataFrame([(p,) for p in PHRASES], "text string"))
    assert {r[0] for r in df.select(F.explode("fired")).collect()} == set(rules.RULE_NAMES)


def test_grouped_patterns_match_like_the_plain_ones():
    texts = [p.lower() for p in PHRASES] + [t.lower() for t, _ in CASES] + ["", "urgently", "xurgent", "the 3rd email", "refunded $20", "é burnt"]
    for name, _, _, pattern in rules.RULES:
        if pattern:
            for text in texts:
                assert bool(re.search(pattern, text)) == bool(re.search(searchable(pattern), text)), (name, text)


INPUT = "text string, signals array<string>, category string, category_confidence double, urgency string, urgency_confidence double, order_amount double"


def decide(spark, **change):
    base = dict(text="x", signals=[], category="order_status", category_confidence=0.9, urgency="low", urgency_confidence=0.9, order_amount=None)
    df = spark.createDataFrame([tuple({**base, **change}.values())], INPUT)
    r = rules.with_decision(df).first()
    return r["needs_escalation"], r["escalation_reason"]


def test_calm_ticket_is_not_escalated(spark):
    assert decide(spark) == (False, None)


@pytest.mark.parametrize(
    ("change", "part"),
    [
        ({"urgency": "high"}, "Urgency classified high (confidence 0.90)"),
        ({"urgency": "high", "urgency_confidence": None}, "Urgency classified high (confidence n/a)"),
        ({"category_confidence": 0.41}, "Low category confidence (0.41 < 0.6)"),
        ({"urgency_confidence": 0.5}, "Low urgency confidence (0.50 < 0.6)"),
        ({"category": "refund_request", "order_amount": 250.5}, "Refund request on a $250.50 order (over $100)"),
        ({"signals": ["safety", "hardship"]}, "Strong urgency signal in the text: safety, hardship"),
    ],
)
def test_each_reason(spark, change, part):
    assert decide(spark, **change) == (True, part)


def test_refund_of_exactly_the_threshold_is_fine(spark):
    assert decide(spark, category="refund_request", order_amount=100.0) == (False, None)


def test_reasons_are_joined_in_rule_order(spark):
    assert decide(spark, urgency="high", category_confidence=0.1)[1] == "Urgency classified high (confidence 0.90); Low category confidence (0.10 < 0.6)"


def test_a_filter_on_the_rules_does_not_repeat_the_patterns(spark):
    df = spark.createDataFrame([(t, "high") for t, _ in CASES], "text string, urgency string")
    wrong = rules.with_rules(df).filter(F.col("weak_label") != F.col("urgency"))
    for made in (wrong, rules.rule_conflicts(rules.with_rules(df)), rules.rule_precision(rules.with_rules(df), "urgency")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_distinct(regexp_extract_all(") <= 1 and plan.count("my (personal )?") == 1
    assert {r["text"] for r in wrong.collect()} == {t for t, label in CASES if label != "high"}


def test_short_texts_are_dealt_over_all_tasks(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "text string").coalesce(1)
    assert rules.with_rules(df).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
