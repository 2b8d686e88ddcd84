"""Wallet aggregation with counterfactuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def direction(side: Column, label: Column, party: Column) -> Column:
    """True for a bet on Republicans, false against, null if it cannot be told."""
    buy = F.when(F.upper(side).isin("BUY", "B"), True).when(F.upper(side).isin("SELL", "S"), False)
    yes = F.when(F.lower(F.trim(label)).isin("yes", "y", "1", "true"), True).when(F.lower(F.trim(label)).isin("no", "n", "0", "false"), False)
    rep = F.when(party == "Republican", True).when(party == "Democrat", False)
    return (buy == yes) == rep


def wallets(trades: DataFrame) -> DataFrame:
    """Per wallet: volumes for and against, right and wrong, trades, markets, and the share for Republicans as it was and had wrong bets been turned (all, only those for, only those against).  trades: wallet, market_id, volume, for_rep, right."""
    v, up, right = F.col("volume"), F.col("for_rep"), F.col("right")
    usable = trades.filter(F.col("wallet").isNotNull() & (v > 0) & up.isNotNull())
    total = lambda k: F.coalesce(F.sum(F.when(k, v)), F.lit(0.0))
    wrong = ~F.coalesce(right, F.lit(True))
    share = lambda k: F.try_divide(total(k), F.sum(v)) * 100
    return usable.groupBy("wallet").agg(
        total(up).alias("volume_for"), total(~up).alias("volume_against"), total(right).alias("volume_right"), total(~right).alias("volume_wrong"), F.count("*").alias("n_trades"), F.countDistinct("market_id").alias("n_markets"),
        share(up).alias("share_for"), share(up != wrong).alias("cf_all"), share(up & ~wrong).alias("cf_rep_only"), share(up | wrong).alias("cf_dem_only"),
    )
