"""Elections: reference dates, truncation, keys, winner picks and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.operators.patterns import substrings
from foretell.operators.ranks import group_medians

DAY = 86400
#: Days before the close at which a market of a venue that is not electoral is read.
OFFSETS = {"polymarket": 2, "kalshi": 1}


def reference_ts(close: Column, election_day: Column, electoral: Column, platform: Column, duration_days: Column, category: Column, untouched: list[str] = ("15. POLITICAL_SPEECH",)) -> Column:
    """Epoch seconds at which a market is judged: election day 08:00, else the close less the venue's offset; no offset for speeches or after at most two days of prices."""
    offset = F.when(category.isin(list(untouched)) | (duration_days <= 2), 0).when(platform == "kalshi", OFFSETS["kalshi"]).otherwise(OFFSETS["polymarket"])
    return F.coalesce(F.when(electoral, election_day + 8 * 3600), close - offset * DAY)


def with_fallback(reference: Column, first_tick: Column, close: Column, platform: Column) -> Column:
    """The close less the offset where the reference lies before the first tick."""
    return F.when(reference < first_tick, close - F.when(platform == "kalshi", OFFSETS["kalshi"]).otherwise(OFFSETS["polymarket"]) * DAY).otherwise(reference)


def truncate(ticks: DataFrame, markets: DataFrame) -> DataFrame:
    """ticks up to the end of election day, else up to the close less 24 h (12 h for kalshi); ticks of unknown markets stay.  markets: market_id, platform, close_ts, election_day."""
    cut = F.coalesce(F.col("election_day") + DAY - 1, F.col("close_ts") - F.when(F.col("platform") == "kalshi", 12 * 3600).otherwise(24 * 3600))
    cuts = markets.select("market_id", cut.alias("_cut"))
    return ticks.join(cuts, "market_id", "left").filter(F.col("_cut").isNull() | (F.col("ts") <= F.col("_cut"))).drop("_cut")


def election_key(country: Column, office: Column, location: Column, year: Column, primary: Column) -> Column:
    """country|office|location|year|is_primary; null without country, office or year."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.when(part(country).isNotNull() & part(office).isNotNull() & year.isNotNull(), F.concat_ws("|", F.trim(country), F.trim(office), F.coalesce(F.trim(location), F.lit("")), year.cast("string"), F.when(F.coalesce(primary, F.lit(False)), "True").otherwise("False")))


def largest_per_election(markets: DataFrame, key: str, volume: str, tie: str) -> DataFrame:
    """Each election's market with the largest volume (ties to the smaller id), and how many it has."""
    best = markets.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_markets"), F.max_by(F.struct(*[c for c in markets.columns if c != key]), F.struct(F.coalesce(volume, F.lit(0.0)), -F.col(tie))).alias("x"))
    return best.select(key, "n_markets", "x.*")


def winner_prediction(eve: Column, outcome: Column) -> Column:
    """Probability given to what happened."""
    return F.when(outcome == 0, 1 - eve).otherwise(eve)


def republican_probability(p: Column, republican_won: Column) -> Column:
    return F.when(republican_won, p).otherwise(1 - p)


def margin_bucket(share_a: Column, share_b: Column) -> Column:
    """Closeness of two vote shares given in 0..1."""
    m = F.abs(share_a - share_b) * 100
    return F.when(m < 5, "< 5%").when(m < 10, "5-10%").when(m < 20, "10-20%").when(m.isNotNull(), "> 20%")


def panel(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean Brier, accuracy and volumes (thousands) of winner predictions in column `w`."""
    w, rows = F.col("w"), df.filter(F.col("w").isNotNull())
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((w - 1) * (w - 1)).alias("brier"), F.avg((w > 0.5).cast("double")).alias("accuracy"), (F.avg("volume_usd") / 1000).alias("mean_volume_k"))
    medians = group_medians(rows, ["volume_usd"], keys).select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("volume_usd_median") / 1000).alias("median_volume_k"))
    return out.join(medians, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def swap_for_volume(selected: DataFrame, markets: DataFrame, key: str) -> DataFrame:
    """selected (key, market_id, volume_usd) with a larger market of the same election in its place, if there is one."""
    best = markets.groupBy(key).agg(F.max_by(F.struct("market_id", "volume_usd"), F.struct("volume_usd", -F.col("market_id"))).alias("b"))
    joined = selected.join(best, key, "left")
    larger = F.col("b.volume_usd") > F.coalesce("volume_usd", F.lit(0.0))
    return joined.select(key, F.when(larger, F.col("b.market_id")).otherwise(F.col("market_id")).alias("market_id"), F.coalesce(larger, F.lit(False)).alias("swapped"))


def match_by_text(elections: DataFrame, markets: DataFrame, states: DataFrame) -> DataFrame:
    """id, key: the markets of each election, by what their label or question says: the election's year and, unless it is national, its state, by code or by name, in lower case.

    elections: id, name, state (code), day (text, yyyy-mm-dd); markets: key, label, question; states: code, name.  An election whose name holds `general election` or `presidential` is national.  States and years are looked for in all texts at once (see patterns.py); texts meet elections by what was found in them.
    """
    text = F.lower(F.concat_ws("\n", F.coalesce("label", F.lit("")), F.coalesce("question", F.lit(""))))
    m = markets.select("key", text.alias("_text"))
    asked = elections.select("id", "state", F.regexp_extract("day", r"^(\d{4})-\d{2}-\d{2}$", 1).alias("_year"), F.lower("name").rlike("general election|presidential").alias("_national")).filter("_year <> ''")
    asked = asked.withColumn("_national", F.coalesce("_national", F.lit(False)))
    named = elections.select(F.col("state").alias("code")).filter("code is not null").distinct().join(states, "code", "left")
    words = named.select("code", F.explode(F.array(F.lower("code"), F.lower("name"))).alias("_word")).filter("_word is not null and _word <> ''")
    by_state = substrings(m, "_text", words, "_word").join(words, "_word").select("_text", F.col("code").alias("state")).distinct()
    by_year = substrings(m, "_text", asked, "_year")
    local = by_state.join(by_year, "_text").join(asked.filter("NOT _national"), ["state", "_year"])
    national = by_year.join(asked.filter("_national"), "_year")
    return local.select("id", "_text").unionByName(national.select("id", "_text")).join(m, "_text").select("id", "key")


def race_context(markets: DataFrame, races: DataFrame) -> DataFrame:
    """Each market's first race of its state whose year is equal or missing on either side.  markets: key, state, year; races: race, state, race_year, ord.

    Races are brought down to the first of each (state, year) and of each state, so a market meets at most two rows.
    """
    first = F.min(F.struct("ord", "race"))
    dated = races.groupBy("state", F.col("race_year").alias("year")).agg(first.alias("_own"))
    undated = races.groupBy("state").agg(F.min(F.when(F.col("race_year").isNull(), F.struct("ord", "race"))).alias("_any_year"), first.alias("_all"))
    both = markets.join(undated, "state").join(dated, ["state", "year"], "left")
    best = F.when(F.col("year").isNull(), F.col("_all")).otherwise(F.least("_own", "_any_year"))
    return both.select("key", best.alias("_best")).filter("_best is not null").select("key", F.col("_best.race").alias("race"))


def leader(candidates: DataFrame, election: str) -> DataFrame:
    """Per election the candidate with the highest mean price over venues, and each venue's market of that name.  candidates: election, name_slug, platform, market_id, price."""
    by_name = candidates.groupBy(election, "name_slug").agg(F.avg("price").alias("price"), *[F.max_by(F.when(F.col("platform") == v, F.col("market_id")), F.when(F.col("platform") == v, F.struct("price", -F.col("market_id")))).alias(v) for v in OFFSETS])
    return by_name.groupBy(election).agg(F.max_by(F.struct("name_slug", "price", *OFFSETS), F.struct("price", "name_slug")).alias("x")).select(election, "x.*")
