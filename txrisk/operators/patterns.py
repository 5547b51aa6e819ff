"""Fraud pattern tags (F28): the simulator's fraud bands as a tagging operator.

Thresholds are arguments; defaults are the band edges of the reference
simulator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: band edges of the reference's fraud patterns
DEFAULTS = {
    "drain_min": 0.70,          # balance drain 70 %+
    "spike_min": 10.0,          # amount 10x-100x the 7-day average
    "burst_count_min": 10,      # 10+ transfers in 24 h
    "new_card_months": 3,       # card younger than 3 months
    "new_card_amount_min": 1000.0,
    "combined_drain_min": 0.80,  # combined: drain 80 %+, 5+ in 24 h, card < 6 months
    "combined_count_min": 5,
    "combined_card_months": 6,
}


def pattern_tags(df: DataFrame, **overrides) -> DataFrame:
    """Adds ``pattern_tags`` (comma-separated, fixed order) and ``n_patterns``.

    Needs balance_drain_ratio, amount_to_avg_ratio, transaction_count_24h,
    card_age_months, transaction_amount."""
    p = {**DEFAULTS, **overrides}
    drain, spike = F.col("balance_drain_ratio"), F.col("amount_to_avg_ratio")
    c24, age, amt = F.col("transaction_count_24h"), F.col("card_age_months"), F.col("transaction_amount")
    rules = [
        ("balance_drain", drain >= p["drain_min"]),
        ("amount_spike", spike >= p["spike_min"]),
        ("velocity_burst", c24 >= p["burst_count_min"]),
        ("new_card", (age < p["new_card_months"]) & (amt >= p["new_card_amount_min"])),
        ("combined", (drain >= p["combined_drain_min"]) & (c24 >= p["combined_count_min"])
         & (age < p["combined_card_months"])),
    ]
    hits = [(name, F.coalesce(cond, F.lit(False))) for name, cond in rules]
    # concat_ws skips the NULLs of rules that did not fire: no array, no lambda
    tags = F.concat_ws(",", *[F.when(hit, F.lit(name)) for name, hit in hits])
    count = sum((hit.cast("int") for _, hit in hits[1:]), hits[0][1].cast("int"))
    return df.withColumn("pattern_tags", tags).withColumn("n_patterns", count)
