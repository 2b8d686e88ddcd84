"""Questions, frames, ids and scores by example."""

import pytest
from pyspark.sql import functions as F

from foretell.functions import entities, text
from foretell.operators import frames, matching

FIELDS = "frame_type string, candidate string, party string, office string, country string, scope string, scope_type string, year int, outcome_type string, is_primary boolean, metric string, threshold_value double, threshold_direction string, actor string"
ASKED = {
    "Will Donald Trump win the 2024 US Presidential Election?": {"frame_type": "contest", "country": "US", "office": "PRES", "year": 2024, "outcome_type": "WIN", "candidate": "Donald Trump"},
    "Will the Republican win the 2026 Georgia Senate race?": {"frame_type": "contest", "country": "US", "office": "SEN", "year": 2026, "party": "GOP", "scope": "GA", "candidate": None},
    "Will Gustavo Petro win the 2022 Colombian presidential election?": {"frame_type": "contest", "country": "CO", "office": "PRES", "year": 2022},
    "Will Nikki Haley win the Republican primary in 2024?": {"frame_type": "contest", "is_primary": True, "party": "GOP"},
    "Will a Democrat win OH-11 in 2024?": {"frame_type": "contest", "office": "HOUSE", "scope": "OH-11", "scope_type": "district", "country": "US"},
    "Will the S&P 500 be above 5,000 in 2024?": {"frame_type": "threshold", "metric": "SPX", "threshold_value": 5000.0, "threshold_direction": "above"},
    "Will the Fed cut rates in 2024?": {"frame_type": "policy_change", "actor": "FED", "year": 2024, "metric": "RATE", "threshold_direction": "decrease"},
    "Will Jane Roe be confirmed as Fed Chair in 2025?": {"frame_type": "appointment", "office": "FED_CHAIR", "actor": "FED", "year": 2025, "candidate": "Jane Roe"},
    "Will Bitcoin reach $100,000 in 2025?": {"frame_type": "threshold", "metric": "BTC", "threshold_value": 100000.0},
    "Will Recep Tayyip Erdoğan win the Turkish presidential election in 2028?": {"country": "TR", "office": "PRES", "candidate": "Recep Tayyip Erdogan"},
    "Will the CDU win the most seats in the 2025 German parliamentary election?": {"frame_type": "contest", "party": "CDU", "country": "DE", "office": "PARL"},
    "Will the Supreme Court overturn it in 2025?": {"frame_type": "ruling", "actor": "SCOTUS", "country": "US", "outcome_type": "OVERTURN"},
    "Will there be a government shutdown in 2025?": {"frame_type": "occurrence", "outcome_type": "SHUTDOWN"},
    "Will Congress pass a budget by end of 2025?": {"frame_type": "legislation", "actor": "CONGRESS"},
    "Will the FDA approve it in 2026?": {"frame_type": "regulatory_action", "actor": "FDA", "outcome_type": "APPROVE"},
    "Will Israel sign a ceasefire agreement in 2025?": {"frame_type": "agreement", "country": "IL"},
    "Will it rain with us?": {"frame_type": "binary_outcome", "country": None},
    "Who will be elected Mayor of New York City in 2025?": {"frame_type": "contest", "office": "MAYOR", "scope": "NYC", "scope_type": "city", "country": "US", "candidate": None},
}


@pytest.fixture(scope="module")
def extracted(spark):
    q = spark.createDataFrame([(t,) for t in ASKED] + [(None,)], "question string")
    rows = frames.extract(q).withColumn("event", frames.event_id(F.col("frame"))).withColumn("race", frames.race_key(F.col("frame"))).collect()
    return {r.question: r for r in rows}


@pytest.mark.parametrize("asked", ASKED)
def test_fields(extracted, asked):
    got = extracted[asked].frame
    assert {k: got[k] for k in ASKED[asked]} == ASKED[asked]


def test_ids_by_type(extracted):
    event = {q: extracted[q].event for q in ASKED}
    assert event["Will Donald Trump win the 2024 US Presidential Election?"] == "BWR-ELEC-US-PRES-TRUMP-WIN-2024"
    assert extracted["Will Donald Trump win the 2024 US Presidential Election?"].race == "BWR-ELEC-US-PRES-WIN-2024"
    assert event["Will the Republican win the 2026 Georgia Senate race?"] == "BWR-ELEC-US-SEN-GA-GOP-WIN-2026"
    assert event["Will Gustavo Petro win the 2022 Colombian presidential election?"] == "BWR-ELEC-CO-PRES-PETRO-WIN-2022"
    assert event["Will the S&P 500 be above 5,000 in 2024?"] == "BWR-THRESH-SPX-5K-ABOVE-2024"
    assert event["Will the Fed cut rates in 2024?"] == "BWR-POLICY-FED-RATE-DECREASE-2024"
    assert event["Will Jane Roe be confirmed as Fed Chair in 2025?"] == "BWR-APPT-US-FED_CHAIR-ROE-CONFIRM-2025"
    assert event["Will Congress pass a budget by end of 2025?"] == "BWR-LEG-CONGRESS-2025"
    assert event["Will there be a government shutdown in 2025?"] is None and event["Will it rain with us?"] is None
    assert extracted[None].frame is None and extracted[None].confidence == 0


def test_confidence(extracted):
    assert extracted["Will Donald Trump win the 2024 US Presidential Election?"].confidence == 1.0
    assert extracted["Will it rain with us?"].confidence == 0.2


def test_parse_and_loose_comparison(spark):
    same = lambda a, b: frames.loosely_equal(F.lit(a), F.lit(b))
    got = spark.range(1).select(same("BWR-ELEC-US-SEN-MN-WIN-2026-PRI", "BWR-ELEC-US-SEN-WIN-2026").alias("a"), same("BWR-ELEC-US-SEN-2026", "BWR-ELEC-US-GOV-2026").alias("b"), same("BWR-THRESH-SPX-2024", "BWR-THRESH-BTC-2024").alias("c")).first()
    assert tuple(got) == (True, False, True)


def test_folding(spark):
    names = {"Erdoğan": "Erdogan", "Łódź": "Lodz", "José García": "Jose Garcia", "Ångström": "Angstrom", "Straße": "Strasse", "Зеленский": "Zelenskii", "Þór": "Thor", "plain": "plain", "日本": ""}
    rows = spark.createDataFrame(list(names.items()), "a string, b string").select("a", "b", text.fold(F.col("a")).alias("c")).collect()
    assert all(r.b == r.c for r in rows), rows


def test_countries(spark):
    c = entities.countries(spark)
    want = {"colombia": "CO", "colombian": "CO", "brazilian": "BR", "canadian": "CA", "japanese": "JP", "israeli": "IL", "mexican": "MX", "argentine": "AR", "french": "FR", "u.k": "GB", "nigerian": "NG", "ukrainian": "UA", "italian": "IT"}
    assert {k: c.get(k) for k in want} == want
    assert "georgia" not in c and "texas" not in c


def _score(spark, a, b):
    row = lambda d: tuple(d.get(f.split()[0]) for f in FIELDS.split(", "))
    pair = spark.createDataFrame([(row(a), row(b))], f"a struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>, b struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    names = matching.name_score(F.col("a.candidate"), F.col("b.candidate"))
    return pair.select(matching.confidence(F.col("a"), F.col("b"), names).alias("c")).first().c


def test_scores_by_type(spark):
    contest = {"frame_type": "contest", "country": "US", "office": "PRES", "candidate": "Donald Trump", "year": 2024, "outcome_type": "WIN"}
    assert _score(spark, contest, contest) >= 0.8
    assert _score(spark, contest, contest | {"year": 2028}) == 0 and _score(spark, contest, contest | {"candidate": "Joe Biden"}) == 0 and _score(spark, contest, contest | {"is_primary": True}) == 0
    level = {"frame_type": "threshold", "metric": "SPX", "year": 2024, "threshold_value": 5000.0, "actor": "FED"}
    assert _score(spark, level, level) >= 0.9 and _score(spark, level, level | {"metric": "BTC"}) == 0 and _score(spark, level, level | {"threshold_value": 6000.0}) == 0
    assert 0.8 <= _score(spark, level, level | {"threshold_value": 5100.0}) < _score(spark, level, level)
    post = {"frame_type": "appointment", "office": "FED_CHAIR", "candidate": "Jane Roe", "year": 2025, "country": "US"}
    assert _score(spark, post, post) == 1.0 and _score(spark, post, post | {"candidate": "John Doe"}) == 0 and _score(spark, post, post | {"office": "AG"}) == 0
    policy = {"frame_type": "policy_change", "actor": "FED", "metric": "RATE", "threshold_direction": "decrease", "year": 2024}
    assert _score(spark, policy, policy) == 1.0 and _score(spark, policy, policy | {"actor": "ECB"}) == 0
    law = {"frame_type": "legislation", "actor": "CONGRESS", "year": 2025}
    assert _score(spark, law, law) == 1.0 and _score(spark, law, law | {"actor": "SENATE"}) == 0.8 and _score(spark, law, law | {"year": 2026}) == 0


@pytest.mark.parametrize("a, b, low, high", [("Donald Trump", "donald TRUMP", 100, 100), ("Donald Trump", "Donald J Trump", 80, 100), ("Trump", "Donald Trump", 60, 100), ("Donald Trump", "Joe Biden", 0, 49), ("José García", "Jose Garcia", 90, 100)])
def test_name_scores(spark, a, b, low, high):
    assert low <= spark.range(1).select(matching.name_score(F.lit(a), F.lit(b)).alias("s")).first().s <= high
