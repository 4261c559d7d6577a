"""Market facts: rankings, summaries, trends. Deals, listings and references are never mixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scope
from ..functions.text import in_name_order
from ..functions.values import median, positive, round_half_up
from .predicates import built_matches, price_matches
from .ranks import global_rank
from .state import QueryState


def matching_homes(homes: DataFrame, prices: DataFrame, s: QueryState) -> DataFrame:
    """(id): homes that pass the candidate, built-year and price filters. The price conditions hold on one row together.

    A home without any price row of the kind passes only if unknowns are included and no date is asked for. Both
    questions come from one aggregation over prices.
    """
    ok = F.lit(True)
    if s.candidate_only:
        ok = ok & F.col("candidate").isNotNull()
    if s.built_after is not None:
        ok = ok & built_matches(s, F.col("candidate.built_year"))
    found = homes.where(ok).select("id")
    if not s.price_active:
        return found
    missing_ok = s.include_unknown and not (s.fresh_only or s.deal_from or s.deal_to)
    of_kind = prices.where(F.col("kind") == s.price_kind)
    if not missing_ok:
        return found.join(of_kind.where(price_matches(s)).select(F.col("entity_id").alias("id")), "id", "left_semi")
    seen = of_kind.groupBy(F.col("entity_id").alias("id")).agg(F.bool_or(price_matches(s)).alias("__hit"))
    return found.join(seen, "id", "left").where(F.coalesce("__hit", F.lit(True))).select("id")


def ranking(homes: DataFrame, prices: DataFrame, s: QueryState, metric: str = "count") -> DataFrame:
    """Homes by their distinct, dated deals. metric: count, unit, total or latest.

    homes: (id, name). The deals are filtered and pre-aggregated before they meet the homes. Ranks follow the metric,
    then deal count, latest date, name and id.
    """
    s = s.but(price_kind="deal")
    deals = prices.where(~F.coalesce("possible_duplicate", F.lit(False)) & price_matches(s))
    unit, total = positive(F.col("unit_yuan_sqm")), positive(F.col("total_wan"))
    event = F.col("event_date").cast("date")
    money = F.sum(total.cast("decimal(18,2)"))
    stats = deals.groupBy(F.col("entity_id").alias("id")).agg(
        F.count(F.lit(1)).alias("deal_count"), F.count(unit).alias("priced_count"), F.count(total).alias("total_priced_count"),
        median(unit).alias("median_unit"), F.round(money, 1).cast("double").alias("total_wan"), F.max(event).alias("latest_date"), F.min(event).alias("earliest_date"),
    )
    out = homes.select("id", "name", "district").join(stats, "id")
    value = {"count": F.col("deal_count"), "unit": F.col("median_unit"), "total": F.col("total_wan")}.get(metric)
    keys = [F.col("latest_date").desc_nulls_last(), F.desc("deal_count")] if metric == "latest" else [F.coalesce(F.nullif(value, F.lit(0)), F.lit(-1)).desc(), F.desc("deal_count"), F.col("latest_date").desc_nulls_last()]
    # Close values share a coarse key: whole counts and days, and steps of about one per cent of an amount.
    day = F.coalesce(F.unix_date("latest_date"), F.lit(-1))
    coarse = {"count": F.col("deal_count"), "latest": day}.get(metric, F.floor(F.log1p(F.greatest(F.coalesce(value, F.lit(-1)), F.lit(-0.999))) * 100) if value is not None else None)
    return global_rank(out, [coarse], [*keys, in_name_order(F.col("name")).asc_nulls_last(), F.col("id")], "rank")


def market_summary(prices: DataFrame, s: QueryState, by: list[str]) -> DataFrame:
    """Deals in the window: counts of priced, missing and possibly repeated rows, unit price range, latest date."""
    window = s.but(price_kind="deal", min_budget=None, max_budget=None, min_area=None, max_area=None, fresh_only=False)
    unit, dup = positive(F.col("unit_yuan_sqm")), F.coalesce("possible_duplicate", F.lit(False))
    clean = F.when(~dup, unit)
    return prices.where(price_matches(window)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("deals"), F.count(unit).alias("priced"), F.count_if(unit.isNull()).alias("missing"), F.count_if(dup).alias("duplicates"),
        F.min(clean).alias("low"), F.max(clean).alias("high"), F.max(F.col("event_date").cast("date")).alias("latest"),
    )


def sample_price(unit: Column) -> list[Column]:
    """Aggregates: rounded mean, low, high and count of positive unit prices."""
    x = positive(unit)
    return [round_half_up(F.avg(x)).cast("long").alias("average"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n")]


def history_trend(history: DataFrame, upto: str | None = None, least: int = scope.MIN_TREND_POINTS) -> DataFrame:
    """Range of each place's numeric observations up to a snapshot; too few points show no trend."""
    h = history if upto is None else history.where(F.col("snapshot_date") <= F.lit(upto).cast("date"))
    return h.where(positive(F.col("price")).isNotNull()).groupBy("entity_id").agg(F.count(F.lit(1)).alias("points"), F.min("price").alias("low"), F.max("price").alias("high"), F.min("snapshot_date").alias("first_day"), F.max("snapshot_date").alias("last_day")).where(F.col("points") >= least).withColumn("span", F.col("high") - F.col("low"))


def latest_per_day(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by order: a day's repeated snapshots count once."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def price_list(prices: DataFrame, market: str | None, kinds: tuple[str, ...], s: QueryState) -> DataFrame:
    """Price rows of a market and of kinds, with ord; the deal window binds deals only; newest first, then by id, kind and
    time of observation. Numbers are dealt by day, so no task orders all rows."""
    event = F.col("event_date").cast("date")
    window = F.lit(True)
    if s.deal_from is not None:
        window = window & F.coalesce(event >= F.lit(s.deal_from).cast("date"), F.lit(False))
    if s.deal_to is not None:
        window = window & F.coalesce(event <= F.lit(s.deal_to).cast("date"), F.lit(False))
    ok = F.col("kind").isin(*kinds) & ((F.col("kind") != "deal") | window)
    rows = prices.where(ok if market is None else ok & (F.col("market") == market))
    newest = F.coalesce(F.coalesce("event_date", "observed_at").cast("date"), F.lit("0001-01-01").cast("date"))
    return global_rank(rows, [newest], [F.col("id"), F.col("kind"), F.col("observed_at")], "ord")
