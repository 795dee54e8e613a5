import re

from hypothesis import given, settings, strategies as st

from ticketloom.functions import prefilter as p, rules
from conftest import rows

PIECES = sorted({w for s in rules.LITERALS.sets.values() for w in s}) + ["urgent", "right now", "my bank", " ", ", ", "the", "or", "me", "my", "today", "fuuck", "shit", "x", "é", "k", "0", "3rd time", "\n"]


def test_each_match_contains_one_of_the_literals():
    for pattern in (r"\babc(d|ef)+g?", r"(one|two) x?three", r"ab[cd]ef", r"x*longer", r"a{2}bcd", r"(?:no )?hurry|calm(ly)?", r"f+uck"):
        sets = p.literals(pattern)
        sample = ["abcd", "abcefd", "one three", "two xthree", "abcef", "abdef", "xxlonger", "aabcd", "no hurry", "hurry", "calmly", "fffuck"]
        for text in sample:
            if sets and re.search(pattern, text):
                assert any(w in text for w in sets), (pattern, text, sets)
    assert p.literals(r"a|bc") is None and p.literals(r"\d+") is None and p.literals("") is None


@settings(max_examples=300, deadline=None, database=None, derandomize=True)
@given(st.lists(st.sampled_from(PIECES), max_size=6).map("".join))
def test_no_rule_matches_without_its_literals(text):
    for name, _, _, pattern in rules.RULES:
        if pattern and name in rules.LITERALS.sets and re.search(pattern, text):
            assert any(w in text for w in rules.LITERALS.sets[name]), (name, text)


def test_literals_are_found_at_every_place(spark):
    own = p.Prefilter({"a": "late", "b": "ate|eta", "c": "later on"})
    assert own.sets == {"a": {"late"}, "b": {"ate", "eta"}, "c": {"late"}}  # "later on" begins with "late"
    df = spark.createDataFrame([(1, "late"), (2, "lateta"), (3, "x"), (4, None), (5, "")], "id int, text string")
    found = {r.id: r.f and sorted(r.f) for r in df.select("id", own.found(df.text).alias("f")).collect()}
    assert found == {1: ["ate", "late"], 2: ["ate", "eta", "late"], 3: [], 4: None, 5: []}


def test_rules_fire_as_without_the_search(spark):
    found = []

    @settings(max_examples=400, deadline=None, database=None, derandomize=True)
    @given(st.lists(st.sampled_from(PIECES), max_size=7).map(" ".join))
    def collect(text):
        found.append(text)

    collect()
    df = spark.createDataFrame([(k, t.upper() if t and k % 5 == 0 else t) for k, t in enumerate([*found, None, ""])], "id int, text string")
    plain = df.select("id", rules.fired(df.text, rules.compound(df.text)).alias("fired"))
    assert rows(rules.with_rules(df), "id", "fired") == rows(plain, "id", "fired")
