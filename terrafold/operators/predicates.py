"""Row predicates over the canonical tables. Nothing here joins or shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import scope
from ..functions.values import finite, present
from .state import QueryState


def relation_matches(s: QueryState) -> Column:
    """An admission that is active, of the year, and of the admission type asked for."""
    ok = F.col("active") & (F.col("year").cast("string") == s.year)
    return F.coalesce(ok if s.admission == "all" else ok & (F.col("admission_type") == s.admission), F.lit(False))


def is_fresh(date: Column, today: str, days: int = scope.FRESH_DAYS) -> Column:
    """Seen within so many days up to today; the future and the unknown are not fresh."""
    return F.coalesce(F.date_diff(F.lit(today).cast("date"), date.cast("date")).between(0, days), F.lit(False))


def district_is(s: QueryState, district: Column) -> Column:
    if not s.district:
        return F.lit(True)
    return F.coalesce(district.isin(*scope.MAIN_DISTRICTS) if s.district == "main" else district == s.district, F.lit(False))


def _range(value: Column, low, high, include_unknown: bool) -> Column:
    if low is None and high is None:
        return F.lit(True)
    x = finite(value.cast("double"))
    x = F.when(x >= 0, x)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return F.coalesce(ok, F.lit(include_unknown))


def quote_date() -> Column:
    """When a price was true: a deal's event; a reference's or increment's stated date; else the observation."""
    stated = F.coalesce(F.col("price_as_of"), F.col("source_as_of"))
    incremental = F.coalesce(F.col("source_id").startswith("incremental-price:"), F.lit(False))
    return F.when(F.col("kind") == "deal", F.col("event_date").cast("date")).when(incremental | (F.col("kind") == "reference"), stated.cast("date")).otherwise(F.col("observed_at").cast("date"))


def price_matches(s: QueryState, fresh_date: Column | None = None) -> Column:
    """One price row passes all of: kind, deal window, freshness, budget and area (on this same row)."""
    ok = F.col("kind") == s.price_kind
    if s.price_kind == "deal":
        event = F.col("event_date").cast("date")
        if s.deal_from is not None:
            ok = ok & F.coalesce(event >= F.lit(s.deal_from).cast("date"), F.lit(False))
        if s.deal_to is not None:
            ok = ok & F.coalesce(event <= F.lit(s.deal_to).cast("date"), F.lit(False))
    if s.fresh_only:
        ok = ok & is_fresh(quote_date() if fresh_date is None else fresh_date, s.today)
    return ok & _range(F.col("total_wan"), s.min_budget, s.max_budget, s.include_unknown) & _range(F.col("area_sqm"), s.min_area, s.max_area, s.include_unknown)


def built_matches(s: QueryState, built_year: Column) -> Column:
    return _range(built_year, s.built_after, None, s.include_unknown)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds, else null. A rule that can't be told does not hold."""
    found = F.lit(None).cast("string")
    for holds, reason in reversed(rules):
        found = F.when(F.coalesce(holds, F.lit(False)), F.lit(reason)).otherwise(found)
    return found


def must(condition: Column, message: str, value: Column) -> Column:
    """value, where the condition holds; any other row stops the query with the message."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def accepted_project_price() -> Column:
    """A project's price that can be shown: numeric, exact, per square metre, no model reference."""
    p = lambda k: F.col(f"price.{k}")
    return F.coalesce((p("amount") > 0) & ~F.coalesce(p("font_encoded"), F.lit(False)) & p("amount_high").isNull() & p("unit").isin(*scope.UNIT_PRICES) & (F.coalesce(p("price_type"), F.lit("")) != "directory_model_reference"), F.lit(False))


def quarantine_reason(key: Column, duplicate_group: Column) -> Column:
    return first_reason((key["community"] == scope.CONFLICTING_PROJECT, f"district_conflict_{scope.CONFLICTING_PROJECT}"), (present(duplicate_group), "possible_duplicate_unresolved"))
