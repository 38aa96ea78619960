"""Right-closed binning and label expressions (CASE WHEN, not Bucketizer)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierscope.config import (
    AVAILABILITY_LABELS, HOST_EXPERIENCE_LABELS, PROPERTY_SIZE_LABELS,
    RESEARCH_TIER_ORDER, TIER_ORDER,
)


def right_closed_bins(x: Column, edges, labels, include_lowest: bool = False) -> Column:
    """Label for (e0,e1], (e1,e2], ...; values outside every bin (or null) get null."""
    out = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = (x >= F.lit(lo)) if (include_lowest and i == 0) else (x > F.lit(lo))
        cond = lower if hi == float("inf") else lower & (x <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def price_category(price: Column, budget_max: float, mid_max: float) -> Column:
    return right_closed_bins(price, [0, budget_max, mid_max, float("inf")], TIER_ORDER)


def research_price_category(price: Column, budget_max: float, mid_max: float) -> Column:
    return right_closed_bins(price, [0, budget_max, mid_max, float("inf")],
                             RESEARCH_TIER_ORDER, include_lowest=True)


def property_size(accommodates: Column) -> Column:
    return right_closed_bins(accommodates, [0, 2, 4, 8, float("inf")], PROPERTY_SIZE_LABELS)


def host_experience(host_listings: Column) -> Column:
    return right_closed_bins(host_listings, [float("-inf"), 1, 5, float("inf")],
                             HOST_EXPERIENCE_LABELS)


def research_property_size(accommodates: Column) -> Column:
    """<=2, <=4, <=8, else 'Extra Large' (a missing capacity lands in the last branch)."""
    s, m, l, xl = PROPERTY_SIZE_LABELS
    return (F.when(accommodates <= 2, s).when(accommodates <= 4, m)
             .when(accommodates <= 8, l).otherwise(xl))


def research_host_experience(host_listings: Column) -> Column:
    """==1, <=5, else (so 0 is a small portfolio and a missing count is large)."""
    single, small, large = HOST_EXPERIENCE_LABELS
    return (F.when(host_listings == 1, single).when(host_listings <= 5, small)
             .otherwise(large))


def availability_level(availability: Column) -> Column:
    low, medium, high = AVAILABILITY_LABELS
    return F.when(availability < 90, low).when(availability < 180, medium).otherwise(high)


def superhost_label(flag: Column) -> Column:
    """Research label: TRUE or 't' -> Superhost, FALSE or 'f' -> Regular, else Unknown."""
    txt = F.lower(flag.cast("string"))
    return (F.when(txt.isin("true", "t", "1", "1.0"), "Superhost")
             .when(txt.isin("false", "f", "0", "0.0"), "Regular Host")
             .otherwise("Unknown"))


def tier_band(tier: Column, budget_max: float, mid_max: float) -> Column:
    """Human-readable nightly band for a tier (thresholds truncated to int)."""
    b, m = int(budget_max), int(mid_max)
    return (F.when(tier == TIER_ORDER[0], F.lit(f"up to ${b} / night"))
             .when(tier == TIER_ORDER[1], F.lit(f"${b} - ${m} / night"))
             .when(tier == TIER_ORDER[2], F.lit(f"above ${m} / night")))
