import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foretell.functions.subjects import NOT_POLITICAL
from foretell.operators import elections, patterns


@pytest.mark.parametrize(
    "pattern,want",
    [(r"\b(NFL|NBA)\b", {"fl", "ba"}), (r"box office", {"box office"}), (r"\d+k\b.*\b(BTC|ETH)", {"btc", "eth"}), (r"(ab|\d)x?", None), (r"a?", None), (r"(foo)+bar", {"foo"}), (r"[ab]cd", {"cd"})],
)
def test_what_a_match_must_contain(pattern, want):
    assert patterns.required(pattern) == want


def test_most_rules_have_an_anchor():
    assert len(patterns.Patterns([p for p, _ in NOT_POLITICAL]).always) <= 3


WORDS = ["Chiefs", "trade", "the", "NFL", "win", "2026", "BTC", "$100k", "above", "Winner?", "vs", "at", "Survivor", "eliminated", "İstanbul", "ſurvivor", "tweet", "5", "times", "rain in", "Boston", "S&P 500", "gain", "day", "yes Al Bo,yes", "all time high"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=8).map(" ".join))
def test_hits_are_those_of_each_rule_alone(text):
    rules = [p for p, _ in NOT_POLITICAL]
    assert test_hits_are_those_of_each_rule_alone.set.hits(text) == [k for k, p in enumerate(rules) if re.search(p, text, re.IGNORECASE)]


test_hits_are_those_of_each_rule_alone.set = patterns.Patterns([p for p, _ in NOT_POLITICAL])


@pytest.mark.parametrize("most", [200_000, 3])
def test_substrings_like_contains(spark, most):
    texts = [("ohio senate 2026", 1), ("John wins in 2024", 2), (None, 3), ("", 4), ("ohio senate 2026", 5)]
    names = ["ohio", "oh", "2024", "2026", "", None, "n w", "nothing", "o"]
    df = spark.createDataFrame(texts, "t string, i int")
    table = spark.createDataFrame([(n,) for n in names + names[:2]], "p string")
    got = sorted(map(tuple, patterns.substrings(df, "t", table, "p", most).collect()))
    assert got == sorted((t, n) for t in {t for t, _ in texts} - {None} for n in set(names) - {None, ""} if n in t)
    assert patterns.substrings(df.limit(0), "t", table, "p").count() == patterns.substrings(df, "t", table.limit(0), "p").count() == 0


def test_first_reason_and_political_words(spark):
    asked = ["Will the NBA Finals sell out?", "Will the president attend the NBA Finals?", "Rain?", None, "Charizard at the box office"]
    got = {r.q: r.reason for r in patterns.not_political(spark.createDataFrame([(a,) for a in asked], "q string"), "q").collect()}
    assert got == {"Will the NBA Finals sell out?": "Sports league", "Charizard at the box office": "Movies"}


def test_elections_by_text(spark):
    e = spark.createDataFrame([(1, "Primary", "OH", "2026-05-05"), (2, "Presidential Election", None, "2028-11-07"), (3, "Primary", "NM", "2026-06-02"), (4, "Primary", "OH", None), (5, None, "OH", "bad"), (6, "General Election", "OH", "2026-11-03")], "id int, name string, state string, day string")
    m = spark.createDataFrame([("a", "Ohio Senate", "who wins in 2026?"), ("b", None, "New Mexico governor 2026"), ("c", None, "John in 2026"), ("d", "2028", None), ("e", None, None), ("f", "Ohio", "some day")], "key string, label string, question string")
    states = spark.createDataFrame([("OH", "ohio"), ("NM", "new mexico")], "code string, name string")
    got = sorted(map(tuple, elections.match_by_text(e, m, states).collect()))
    assert got == [(1, "a"), (1, "c"), (2, "d"), (3, "b"), (6, "a"), (6, "b"), (6, "c")]


def test_race_context(spark):
    races = spark.createDataFrame([("r1", 1, 2024, 3.0), ("r2", 1, None, 2.0), ("r3", 1, 2025, 1.0), ("r4", 2, None, 5.0)], "race string, state int, race_year int, ord double")
    m = spark.createDataFrame([(1, 1, 2024), (2, 1, 2025), (3, 1, None), (4, 2, 2030), (5, 3, 2024)], "key int, state int, year int")
    assert dict(map(tuple, elections.race_context(m, races).collect())) == {1: "r2", 2: "r3", 3: "r3", 4: "r4"}
