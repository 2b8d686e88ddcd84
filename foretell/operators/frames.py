"""Question frames, event ids and race keys.

What a question asks becomes a struct: type, candidate, party, office, country, scope, year, outcome, measure, threshold, institution.  No parser of natural language is at hand, so the type comes from words in order: a form of `be` with its participle, comparison or noun, else the first verb that has a type, else the first keyword of an outcome.  Dictionaries are in `functions/entities.py`; each is one pattern, so a question is read once a dictionary.  Different questions are worked out once and joined back to their rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.functions import entities as en
from foretell.functions import text as tx

BE = r"(?:be|is|are|was|were|been)"
#: Codes of ids by frame type; other types have no id.
CODES = {"contest": "ELEC", "threshold": "THRESH", "appointment": "APPT", "policy_change": "POLICY", "legislation": "LEG", "agreement": "AGREE"}


def frame_type(low: Column) -> Column:
    """Type of a lower-case question."""
    after_be = lambda names: rf"\b{BE}\s+(?:[a-z']+\s+){{0,2}}?({'|'.join(names)})\b"
    participle = F.try_element_at(F.create_map(*[F.lit(x) for pair in en.PARTICIPLES.items() for x in pair]), F.regexp_extract(low, after_be(en.PARTICIPLES), 1))
    has_be = F.regexp_like(low, F.lit(rf"\b{BE}\b"))
    compares = F.regexp_like(low, F.lit(rf"\b({'|'.join(en.COMPARING)})\b"))
    happens = F.regexp_like(low, F.lit(rf"\b({'|'.join(en.EVENTS)})s?\b"))
    be = F.coalesce(participle, F.when(F.regexp_like(low, F.lit(after_be(en.COMPARING))), "threshold"), F.when(F.regexp_like(low, F.lit(after_be(en.EVENTS))), "occurrence"))
    verb = en.first_of(low, en.verb_forms())
    kind = {"WIN": "contest", "NOMINATION": "contest", "CANDIDACY": "contest", "MAJORITY": "contest", "CONTROL": "contest", "APPOINT": "appointment", "CONFIRM": "appointment", "RESIGN": "occurrence", "IMPEACH": "occurrence", "CONVICT": "occurrence"}
    keyword = F.coalesce(*[F.when(F.contains(low, F.lit(k)), kind.get(v, "binary_outcome")) for k, v in en.OUTCOMES.items()])
    return F.coalesce(F.when(has_be, be), verb, F.when(has_be, F.coalesce(F.when(compares, "threshold"), F.when(happens, "occurrence"))), keyword, F.lit("binary_outcome"))


def _keyword(low: Column, table: list[tuple[str, str]]) -> Column:
    """The first of (words, code) of which the text holds one; words are separated by bars."""
    return F.coalesce(*[F.when(F.regexp_like(low, F.lit(words)), code) for words, code in table])


def outcome(kind: Column, low: Column) -> Column:
    contest = _keyword(low, [("win|elected", "WIN"), ("nomin", "NOMINATION"), ("run|announce|candidacy", "CANDIDACY"), ("majority", "MAJORITY"), ("control", "CONTROL")])
    ruling = _keyword(low, [("overturn|reverse", "OVERTURN"), ("uphold|affirm", "UPHOLD"), ("strike", "STRIKE_DOWN")])
    regulatory = _keyword(low, [(r"\bban", "BAN"), ("approve", "APPROVE"), ("sanction", "SANCTION"), ("impose|tariff", "IMPOSE")])
    occurrence = _keyword(low, [("shutdown", "SHUTDOWN"), ("recession", "RECESSION"), (r"\bwar\b|invasion", "CONFLICT"), ("resign", "RESIGN"), ("impeach", "IMPEACH"), ("default", "DEFAULT")])
    declaration = _keyword(low, [("candidacy|run for", "CANDIDACY"), ("emergency", "EMERGENCY"), ("victory", "VICTORY")])
    by = {"contest": contest, "ruling": ruling, "regulatory_action": regulatory, "occurrence": occurrence, "declaration": declaration}
    return F.coalesce(*[F.when(kind == k, c) for k, c in by.items()])


def scope_of(text: Column, low: Column) -> Column:
    """scope and scope_type: a district code, else a state by name or by its two capitals, else a city or region by keyword."""
    district = F.regexp_extract(text, r"\b([A-Z]{2})-?(\d{1,2})\b", 0)
    district = F.when(district != "", F.concat_ws("-", F.substring(district, 1, 2), F.regexp_extract(district, r"(\d{1,2})$", 1)))
    state = F.coalesce(en.first_of(low, {n.lower(): c for n, c in tx.STATE_NAMES.items()} | {c: s for c, s in en.CITY_SCOPES.items() if c.startswith("new york")}), F.nullif(F.regexp_extract(text, rf"\b({'|'.join(s for s in tx.STATES if s not in ('IN', 'OR', 'ME', 'OK', 'HI', 'CO'))})\b", 1), F.lit("")))
    city, region = en.first_of(low, en.CITY_SCOPES), en.first_of(low, en.REGION_SCOPES)
    is_city = state.isin(*set(en.CITY_SCOPES.values())) & (F.length(state) > 2)
    pick = lambda c, kind: F.struct(c.alias("scope"), F.lit(kind).alias("scope_type"))
    none = F.lit(None).cast("string")
    return F.when(district.isNotNull(), pick(district, "district")).when(is_city, pick(state, "city")).when(state.isNotNull(), pick(state, "state")).when(city.isNotNull(), pick(city, "city")).when(region.isNotNull(), pick(region, "region")).otherwise(F.struct(none.alias("scope"), none.alias("scope_type")))


def candidate_of(kind: Column, text: Column) -> Column:
    """The name a contest or an appointment is about."""
    named = F.nullif(F.regexp_extract(text, r"(?i)^(?:will|is|was)\s+([A-Z][\w.' -]+?)\s+(?:be\s+)?(?:re-?)?(?:appointed|confirmed|nominated|named|elected|replace|succeed)", 1), F.lit(""))
    asked = tx.candidate(text)
    # a party is no name
    parties = "|".join(re.escape(p) for p in sorted(en.PARTIES, key=len, reverse=True))
    plain = F.when(~F.regexp_like(F.lower(asked), F.lit(rf"^(an?\s+|the\s+)?({parties})\b|\b(party|nominee|candidate)$|^(who|which|what)\b")), asked)
    return F.when(kind == "contest", F.coalesce(plain, named)).when(kind == "appointment", named)


def extract(questions: DataFrame, question: str = "question", close_year: str | None = None, ticker: str | None = None) -> DataFrame:
    """questions with a `frame` struct and its `confidence`.  What the text leaves open is filled from the ticker, then the year from that of the close, where columns for them are given."""
    texts = questions.select(F.col(question).alias("asked")).filter(F.col("asked").isNotNull()).distinct()
    texts = en.country_of(texts, "asked").withColumnRenamed("country", "named_country")
    texts = texts.withColumn("text", tx.clean(F.col("asked"))).withColumn("low", F.lower("text"))
    # an aggregate keeps the type from being worked out again wherever it is used
    texts = texts.withColumn("kind", frame_type(F.col("low"))).groupBy("asked", "text", "low").agg(F.first("named_country").alias("named_country"), F.first("kind").alias("kind"))
    kind, low, text = F.col("kind"), F.col("low"), F.col("text")
    contest, appointment, threshold, policy = kind == "contest", kind == "appointment", kind.isin("threshold", "metric"), kind == "policy_change"
    place = scope_of(text, low)
    is_district = place.scope_type == "district"
    office = F.when(contest & is_district, "HOUSE").when(contest | appointment, en.first_of(low, en.OFFICES))
    foreign_house = F.when((office == "HOUSE") & F.col("named_country").isNotNull() & (F.col("named_country") != "US") & ~is_district, "PARL").otherwise(office)
    country = F.when(place.scope_type.isin("district", "state", "city"), "US").otherwise(F.coalesce(F.col("named_country"), F.when(contest & (office == "SCOTUS"), "US")))
    actor = F.when(~contest, en.first_of(low, en.ACTORS))
    actor = F.when(kind == "legislation", _keyword(low, [("senate", "SENATE"), ("house", "HOUSE"), ("congress", "CONGRESS")])).otherwise(actor)
    country = F.when((kind == "ruling") & actor.isin("SCOTUS", "APPEALS", "DISTRICT"), F.coalesce(country, F.lit("US"))).otherwise(country)
    number = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
    value = F.coalesce(number(r"(?:above|over|exceed|surpass|reach|hit|below|under|fall to|more than|less than|at least|at most)\s*\$?([\d,]*\d\.?\d*)\s*%?"), number(r"([\d,]*\d\.?\d*)\s*(?:percent|%|or more|or less|or higher|or lower)"))
    up, down = r"above|over|exceed|surpass|reach|hit|rise|climb|more than|at least", r"below|under|fall|drop|decline|less than|at most"
    direction = F.when(threshold, _keyword(low, [(up, "above"), (down, "below")])).when(policy, _keyword(low, [("raise|hike|increase", "increase"), ("cut|lower|decrease|reduce", "decrease")]))
    measure = F.when(policy, _keyword(low, [("rate|interest", "RATE"), ("tariff", "TARIFF"), (r"\btax", "TAX")])).when(threshold, en.first_of(low, en.METRICS))
    fields = {
        "frame_type": kind, "candidate": candidate_of(kind, text), "party": F.when(contest, en.first_of(low, en.PARTIES)), "office": foreign_house, "country": country, "scope": place.scope, "scope_type": place.scope_type,
        "year": tx.year(text), "outcome_type": outcome(kind, low), "is_primary": contest & F.regexp_like(low, F.lit("primary|caucus")), "metric": measure,
        "threshold_value": F.when(threshold, F.replace(value, F.lit(","), F.lit("")).try_cast("double")), "threshold_direction": direction, "actor": actor,
    }
    frames = texts.select("asked", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("frame"))
    out = questions.join(frames, F.col(question) == F.col("asked"), "left").drop("asked")
    if ticker:
        out = out.withColumn("frame", tx.with_hints(F.col("frame"), tx.ticker_fields(F.col(ticker))))
    if close_year:
        out = out.withColumn("frame", F.col("frame").withField("year", F.coalesce(F.col("frame.year"), F.col(close_year).cast("int"))))
    return out.withColumn("confidence", confidence(F.col("frame")))


def confidence(frame: Column) -> Column:
    """How much of what its type needs a frame has, 0 to 1: a point for the type (0.3 for a plain yes or no), one for each of its fields, half for a year."""
    has = lambda *names: F.greatest(*[frame[n].isNotNull() for n in names], F.lit(False)).cast("double")
    needs = {"contest": [["country"], ["office"], ["year"], ["candidate", "party"]], "threshold": [["metric"], ["threshold_value"], ["threshold_direction"]], "appointment": [["candidate"], ["office", "actor"], ["year"]]}
    base = F.when(frame.frame_type == "binary_outcome", 0.3).otherwise(1.0) + 0.5 * has("year")
    score = base / 1.5
    for kind, groups in needs.items():
        score = F.when(frame.frame_type == kind, (base + sum(has(*g) for g in groups)) / (1.5 + len(groups))).otherwise(score)
    return F.when(frame.frame_type.isNull(), 0.0).otherwise(F.round(score, 3))


def _id(kind: str, *parts: Column) -> Column:
    return F.concat_ws("-", F.lit("BWR"), F.lit(CODES[kind]), *parts)


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def event_id(frame: Column, valid_scopes_only: bool = True) -> Column:
    """Id of the event a frame is about, with its subject, in the form of its type; null where a required part is missing or the type has no id."""
    scope = F.when(tx.valid_scope(frame.scope) | F.lit(not valid_scopes_only), tx.slug(frame.scope))
    name, year = _blank(tx.name_slug(frame.candidate)), frame.year.cast("string")
    contest = F.when(frame.office.isNotNull() & frame.year.isNotNull(), _id("contest", F.coalesce(frame.country, F.lit("XX")), frame.office, scope, F.coalesce(name, frame.party), F.coalesce(frame.outcome_type, F.lit("WIN")), year, F.when(frame.is_primary, "PRI")))
    post = F.coalesce(frame.office, frame.actor)
    appointment = F.when(post.isNotNull(), _id("appointment", F.coalesce(frame.country, F.lit("US")), post, name, F.coalesce(frame.outcome_type, F.lit("CONFIRM")), year))
    return F.when(frame.frame_type == "contest", contest).when(frame.frame_type == "appointment", appointment).otherwise(_other(frame))


def _other(frame: Column) -> Column:
    """Ids of the types whose events have no subject; null where only the type is known."""
    year, direction = frame.year.cast("string"), F.upper(frame.threshold_direction)
    known = lambda *parts: F.greatest(*[p.isNotNull() for p in parts], F.lit(False))
    value = tx.number_slug(frame.threshold_value)
    level = F.when(frame.metric.isNotNull() & known(frame.actor, value, direction, year), _id("threshold", frame.actor, frame.metric, value, direction, year))
    policy = F.when(known(frame.actor, frame.metric, direction, year), _id("policy_change", frame.actor, frame.metric, direction, year))
    law = F.when(known(frame.actor, year), _id("legislation", frame.actor, year))
    deal = F.when(known(frame.actor, year), _id("agreement", frame.actor, year))
    return F.when(frame.frame_type == "threshold", level).when(frame.frame_type == "policy_change", policy).when(frame.frame_type == "legislation", law).when(frame.frame_type == "agreement", deal)


def race_key(frame: Column) -> Column:
    """Id of the race without its candidate; WIN where no outcome is named; the scope is validated as in event_id."""
    scope = F.when(tx.valid_scope(frame.scope), tx.slug(frame.scope))
    year = frame.year.cast("string")
    race = F.when(frame.office.isNotNull() & frame.year.isNotNull(), _id("contest", F.coalesce(frame.country, F.lit("XX")), frame.office, scope, F.coalesce(frame.outcome_type, F.lit("WIN")), year, F.when(frame.is_primary, "PRI")))
    post = F.coalesce(frame.office, frame.actor)
    appointment = F.when(post.isNotNull(), _id("appointment", F.coalesce(frame.country, F.lit("US")), post, F.coalesce(frame.outcome_type, F.lit("CONFIRM")), year))
    return F.when(frame.frame_type == "contest", race).when(frame.frame_type == "appointment", appointment).otherwise(_other(frame))


def parse_id(event: Column) -> Column:
    """type, country, office, year and is_primary of an event id; PRI is taken off before the year is read."""
    primary = event.endswith("-PRI")
    parts = F.split(F.regexp_replace(event, "-PRI$", ""), "-")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return F.struct(at(2).alias("type"), F.when(at(2) == "ELEC", at(3)).alias("country"), F.when(at(2) == "ELEC", at(4)).alias("office"), at(-1).try_cast("int").alias("year"), primary.alias("is_primary"))


def loosely_equal(a: Column, b: Column) -> Column:
    x, y = parse_id(a), parse_id(b)
    return x.type.eqNullSafe(y.type) & x.year.eqNullSafe(y.year) & x.country.eqNullSafe(y.country) & x.office.eqNullSafe(y.office)
