"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, saved, small

#: Weights dealt to the sources in code point order, again and again.
WEIGHTS = (5, 2, 1)
#: Slopes of the sources' weight schedules, dealt likewise: over schedule time t from 0 to 1 a source's demand for words
#: is target * (1 + slope * (2t - 1)). Positive: more of it late.
SLOPES = (0.5, 0.0, -0.5)
#: A source is repeated so often at most.
MAX_PASSES = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: sid (rank by code point, null last), source_size, target, slope, drift (the mean slope by target).

    sizes: rows (source, size). Targets share the total by weight, stop at max_passes times the source's size, and the
    excess is shared again by weight until no target is above. That ends at target = min(cap, level * weight): sorted by
    cap / weight, the sources before a point are capped, and the level follows from the rest. The two windows run over
    one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    k = len(weights)
    ranked = per.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("int"))
    nth: Column = F.pmod(F.col("sid") - 1, F.lit(k)) + 1
    ranked = ranked.withColumns({"w": F.element_at(F.array(*map(F.lit, weights)), nth.cast("int")), "slope": F.element_at(F.array(*map(F.lit, slopes)), (F.pmod(F.col("sid") - 1, F.lit(len(slopes))) + 1).cast("int")), "cap": F.lit(max_passes) * F.col("source_size")})
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("sid"))
    before, all_ = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    run = ranked.withColumns({"total": F.sum("source_size").over(all_), "w_all": F.sum("w").over(all_), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0))})
    run = run.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    # The first source in this order that its level does not cap sets the level of all.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("sid"), F.col("level")))).over(all_)
    run = run.withColumn("at", level)
    capped = F.col("at").isNull() | (F.struct(F.col("cap") / F.col("w"), F.col("sid"), F.lit(0.0)) < F.struct(F.col("at.col1"), F.col("at.sid"), F.lit(0.0)))
    run = run.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("at.level") * F.col("w")))
    wanted = F.sum("target").over(all_)
    drift = F.when(wanted > 0, F.sum(F.col("target") * F.col("slope")).over(all_) / wanted).otherwise(0.0)
    return run.select("source", "sid", "source_size", "target", "slope", drift.alias("drift"))


def position_at(share: Column, slope: Column) -> Column:
    """The time t in [0, 1] by which a source's integrated schedule t + slope * (t*t - t) reaches this share."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - slope) * (1 - slope) + 4 * slope * share))
    return F.when(F.abs(slope) < 1e-9, share).otherwise((root - (1 - slope)) / (2 * slope))


def demanded_by(time: Column, drift: Column) -> Column:
    """The share of all sources' words that their schedules demand by this time: the sum of their integrals."""
    return time + drift * (time * time - time)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] | None = None, weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES, max_passes: int = MAX_PASSES, by_copy: bool = False) -> DataFrame:
    """Every document once with size, source_size, target, copies, taken, positions and position, in training order.

    Documents of a source stand in the order of a digest of key and text, so that neither rows of one key, nulls among
    them, nor copies of one text stand together. Pass e over the source covers the words from
    e * source_size on; a document is taken in every pass in which its middle comes before the target, so a source's
    taken words differ from its target by half a document at most and no document exceeds max_passes times its size.
    A copy's place in its source's target gives its time, by inverting the source's integrated schedule, and the time its
    position: the share of all words, whatever their source, that the schedules demand before it. positions holds one for
    each copy, and the result is range-sorted by the first of them (documents that are not taken come last). by_copy
    gives a row for each copy instead, with copy (0, 1, ...) and its own position, range-sorted by that: the training
    order itself; a document that is not taken still has one row, with null copy and position.

    Running sums go over three levels (256 ranges of digests, 256 ranges in each, documents in those), so that no task
    holds a whole source. Null text has size 0; null sources are a source of their own, null keys sort first; repeated
    rows count each; empty tables give no rows. keep: input columns to carry (default all); input columns that clash
    with the result's are replaced.
    """
    made = ["size", "source_size", "target", "copies", "taken", *(["copy"] if by_copy else ["positions"]), "position"]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in made]
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    base = docs.select(*[F.col(c).alias(f"__c_{c}") for c in carried], F.col(source).alias("source"), F.col(key).alias("__key"), n_words(F.col(text)).alias("size"), digest.alias("__h"))
    base = base.withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    ranges = saved(base.groupBy("source", "__b").agg(F.sum("size").alias("size")), "mix-ranges")
    targets = small(saved(source_targets(ranges, weights, slopes, max_passes), "mix-targets"))
    ranges = ranges.join(targets.select(F.col("source").alias("__s"), "sid"), F.col("source").eqNullSafe(F.col("__s"))).select("sid", "__b", (F.col("__b") / 256).cast("int").alias("__hi"), "size")
    inner = F.coalesce(F.sum("size").over(W.partitionBy("sid", "__hi").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    outer = F.coalesce(F.sum("size").over(W.partitionBy("sid").orderBy("__hi").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upper = ranges.groupBy("sid", "__hi").agg(F.sum("size").alias("size")).select("sid", "__hi", outer.alias("__outer"))
    offsets = ranges.withColumn("__inner", inner).join(upper, ["sid", "__hi"]).select("sid", "__b", (F.col("__inner") + F.col("__outer")).alias("__offset"))
    full = base.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s").join(offsets, ["sid", "__b"])
    within = F.coalesce(F.sum("size").over(W.partitionBy("sid", "__b").orderBy("__h", "__key", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    full = full.withColumn("__start", F.col("__offset") + within)
    middle = lambda e: e * F.col("source_size") + F.col("__start") + F.col("size") / 2
    passes = F.filter(F.sequence(F.lit(0), F.lit(max_passes - 1)), lambda e: 2 * (e * F.col("source_size") + F.col("__start")) + F.col("size") <= 2 * F.col("target"))
    share = lambda e: F.when(F.col("target") > 0, F.least(F.lit(1.0), middle(e) / F.col("target"))).otherwise(0.0)
    times = F.transform(passes, lambda e: position_at(share(e), F.col("slope")))
    full = full.withColumn("positions", F.transform(times, lambda t: demanded_by(t, F.col("drift"))))
    full = full.withColumns({"copies": F.size("positions"), "position": F.try_element_at("positions", F.lit(1))}).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    if by_copy:
        full = full.drop("position").select("*", F.posexplode_outer("positions").alias("copy", "position"))
    full = full.orderBy(F.col("position").asc_nulls_last(), "__h", "__key", *(["copy"] if by_copy else []))
    return full.select(*[F.col(f"__c_{c}").alias(c) for c in carried], *made)
