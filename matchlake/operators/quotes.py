"""Quotes of a match: those known at a time, the first, the last and the primary one, and how they differ.

All of a match's figures come from one aggregation whose partial sums are made before the shuffle, so a match that holds a
tenth of all quotes is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_quotes(quotes: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The quotes (match_id, at, ...) of ``cutoffs`` (match_id, cutoff_us) that were captured at or before the cutoff.

    The order within a match is (at, bookmaker, quote_id); sort where it is needed, as a result needn't be ordered in whole.
    """
    return quotes.join(cutoffs.select("match_id", "cutoff_us"), "match_id").where(F.col("at") <= F.col("cutoff_us"))


def summary(matches: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row for each match (match_id) with its quotes: quotes, primary_id and primary_bookmaker (the newest, of equals the
    first bookmaker), first_odds and last_odds of the first side, disagreement and movement.

    ``quotes``: match_id, quote_id, at, bookmaker, odds_a, odds_b. disagreement: the larger standard deviation of either
    side's odds; movement: how far the first side's odds moved from the first to the last quote, in parts of the first;
    both null below two quotes. A match without quotes has 0 and nulls; quotes without a match or time don't count.
    """
    order = F.struct("at", "quote_id")
    usable = quotes.where(F.col("match_id").isNotNull() & F.col("at").isNotNull())
    newest: Column = F.struct((-F.col("at")).alias("t"), "bookmaker", "quote_id")
    sums = usable.groupBy("match_id").agg(
        F.count("*").alias("quotes"), F.min(newest).alias("p"), F.min_by("odds_a", order).alias("first_odds"), F.max_by("odds_a", order).alias("last_odds"),
        F.stddev_pop("odds_a").alias("sa"), F.stddev_pop("odds_b").alias("sb"),
    )
    several = F.col("quotes") >= 2
    sums = sums.select(
        "match_id", "quotes", F.col("p.quote_id").alias("primary_id"), F.col("p.bookmaker").alias("primary_bookmaker"), "first_odds", "last_odds",
        F.when(several, F.greatest("sa", "sb")).alias("disagreement"), F.when(several & (F.col("first_odds") != 0), F.abs(F.col("last_odds") - F.col("first_odds")) / F.when(F.col("first_odds") != 0, F.col("first_odds"))).alias("movement"),
    )
    return matches.select("match_id").distinct().join(sums, "match_id", "left").withColumn("quotes", F.coalesce("quotes", F.lit(0)))
