"""Scalar values: numbers, days, identities, hashes, URLs. All are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scope

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def finite(x: Column) -> Column:
    """x where it is a finite number, else null (Spark orders NaN above all numbers)."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def number(c: Column) -> Column:
    """A non-negative finite number from text with thousands commas, else null; zero stays zero."""
    text = F.trim(F.regexp_replace(c.cast("string"), ",", ""))
    x = finite(F.when(text.rlike(_NUMBER), text.try_cast("double")))
    return F.when(x >= 0, x)


def positive(x: Column) -> Column:
    """x where it is a finite number above zero, else null."""
    x = finite(x.cast("double"))
    return F.when(x > 0, x)


def json_positive(variant: Column) -> Column:
    """The value of a JSON number above zero; strings and booleans are not numbers."""
    kind = F.schema_of_variant(variant)
    numeric = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return positive(F.when(numeric, F.try_variant_get(variant, "$", "double")))


def day(c: Column) -> Column:
    """A date from yyyymmdd or the first ten characters as year-month-day, else null."""
    text = c.cast("string")
    text = F.when(text.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)
    head = F.substring(text, 1, 10)
    return F.when(head.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(head, "y-M-d"))


def profile_date(c: Column) -> Column:
    """The first ten characters of a present value."""
    return F.when(present(c), F.substring(c.cast("string"), 1, 10))


def present(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def first_present(*cs: Column) -> Column:
    return F.coalesce(*[F.when(present(c), c.cast("string")) for c in cs])


def explicit_year(c: Column) -> Column:
    """The first four-digit year of the 20th or 21st century in a text."""
    return F.regexp_extract(c.cast("string"), "((?:19|20)[0-9]{2})", 1).try_cast("int")


def epoch_day(ms: Column, zone: str = "Asia/Shanghai") -> Column:
    """The local date of epoch milliseconds."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def digest(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def dump(c: Column) -> Column:
    """Compact JSON that keeps nulls and the order of keys."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def entry_hash(**fields: Column) -> Column:
    """Digest of an entry, whatever the order its fields are given in."""
    return digest(dump(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))


def id_set_lock(ids: Column) -> Column:
    """Aggregate: count and digest of a set of ids, as compact JSON of the sorted ids."""
    found = F.sort_array(F.collect_set(ids))
    return F.struct(F.size(found).cast("long").alias("count"), digest(F.to_json(found)).alias("sha256"))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of an ASCII text (an error for other text), as a long."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    ascii_only = F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.raise_error(F.concat(F.lit("not an ASCII id: "), c)).cast("string"))
    start = F.when(ascii_only.isNotNull(), F.lit(2166136261).cast("long"))
    step = lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(16777619).cast("long"), F.lit(1 << 32))
    return F.aggregate(codes, start, step)


def shard(c: Column, shards: int = scope.SHARDS) -> Column:
    return F.lpad(F.pmod(fnv1a(c), F.lit(shards)).cast("string"), 3, "0")


def safe_url(c: Column, host: str = scope.PROJECT_HOST, path: str = scope.PROJECT_PATH, param: str = scope.PROJECT_PARAM) -> Column:
    """An http(s) URL without user, query and fragment, else empty; one numeric identifier of one page stays."""
    part = lambda name: F.try_parse_url(c, F.lit(name))
    name = F.lower(part("HOST"))
    ids = F.regexp_extract_all(F.coalesce(part("QUERY"), F.lit("")), F.lit(f"(?:^|&){param}=([^&]*)"), F.lit(1))
    kept = F.when((name == host) & (part("PATH") == path) & (F.size(ids) == 1) & F.element_at(ids, 1).rlike("^[0-9]{1,20}$"), F.concat(F.lit(f"?{param}="), F.element_at(ids, 1))).otherwise("")
    ok = F.lower(part("PROTOCOL")).isin("http", "https") & (F.coalesce(name, F.lit("")) != "") & (F.coalesce(part("USERINFO"), F.lit("")) == "")
    url = F.concat(F.lower(part("PROTOCOL")), F.lit("://"), part("AUTHORITY"), F.coalesce(part("PATH"), F.lit("")), kept)
    return F.coalesce(F.when(ok, url), F.lit(""))


def project_key(url: Column, community: Column, district: Column) -> Column:
    """(source, community, district) where the URL's host is the project site and the id is numeric, else null."""
    ok = (F.lower(F.try_parse_url(F.nullif(safe_url(url), F.lit("")), F.lit("HOST"))) == scope.PROJECT_HOST) & community.cast("string").rlike("^[0-9]{1,20}$")
    return F.when(ok, F.struct(F.lit(scope.PROJECT_NAMESPACE).alias("source"), community.cast("string").alias("community"), F.coalesce(district, F.lit("")).alias("district")))


def district_name(c: Column) -> Column:
    """A short district name gets its suffix."""
    return F.when(c.isin(*scope.SHORT_DISTRICTS), F.concat(c, F.lit(scope.DISTRICT_SUFFIX))).otherwise(c)


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def median(x: Column) -> Column:
    """Aggregate: the middle value, or the rounded mean of the two middle values."""
    even = F.pmod(F.count(x), F.lit(2)) == 0
    return F.when(even, round_half_up(F.median(x)).cast("double")).otherwise(F.median(x))


def exact_median(rows: DataFrame, keys: Sequence[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """keys, median and n by selection, for groups of any size: the middle value, or the mean of the two middle ones.

    A sketch of bounded size gives each group a range that is sure to hold its middle; what lies below is only counted, and
    of what lies inside, some thousandths of the group, equal values meet in partial sums before they are numbered. So no
    task holds a group. Nulls do not count; a group of nulls has none; NaN is above all numbers."""
    x, within = F.col(value), [F.col(k) for k in keys]
    share = F.array(F.lit(0.5 - 2 / accuracy), F.lit(0.5 + 2 / accuracy))
    known = rows.where(x.isNotNull())
    about = known.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.percentile_approx(x, share, F.lit(accuracy)).alias("__range"), F.count(F.lit(1)).alias("n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    ranged = known.join(about, same)
    low, high = F.element_at("__range", 1), F.element_at("__range", 2)
    # Values outside the range are one row a group on each side; values inside are one row each, with their number.
    spot = F.when(x < low, -1).when(x > high, 1).otherwise(0)
    counted = ranged.groupBy(*within, "n", spot.alias("__side"), F.when(spot == 0, x).alias("__value")).agg(F.count(F.lit(1)).alias("__c"))
    until = F.sum("__c").over(W.partitionBy(*within).orderBy("__side", "__value"))
    placed = counted.withColumn("__until", until).withColumn("__from", F.col("__until") - F.col("__c") + 1)
    at = lambda place: F.max(F.when((F.col("__from") <= place) & (F.col("__until") >= place), F.col("__value")))
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return placed.groupBy(*keys, "n").agg(((at(lower) + at(upper)) / 2).alias("median")).select(*keys, "median", "n")


def normal_path(c: Column) -> Column:
    """A relative path without empty, . and .. parts; null if it is absolute or climbs above where it starts."""
    parts = F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    start = F.array().cast("array<string>")
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
    walked = F.aggregate(parts, start, lambda done, x: F.when(done.isNotNull(), F.when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))))
    return F.when(~c.startswith("/"), F.array_join(walked, "/"))


def contained(c: Column, root: Column | str) -> Column:
    """Whether a relative path lies under a root, once both are normalised."""
    path, base = normal_path(c), normal_path(F.lit(root) if isinstance(root, str) else root)
    return F.coalesce((path != "") & ((base == "") | path.startswith(F.concat(base, F.lit("/")))), F.lit(False))


def funding_gap(buy: Column, sale: Column, cash: Column, cost: Column, debt: Column) -> Column:
    """Net sale, available money and gap, if all five numbers are known."""
    b, s, c, f, d = (number(x) for x in (buy, sale, cash, cost, debt))
    known = b.isNotNull() & s.isNotNull() & c.isNotNull() & f.isNotNull() & d.isNotNull()
    return F.when(known, F.struct((s - d).alias("net_sale"), (s - d + c).alias("available"), (b + f - (s - d + c)).alias("gap")))


def price_market(source_id: Column, kind: Column, url: Column, notes: Sequence[Column]) -> Column:
    """new, resale or unknown, from the source, the kind, the channel in the URL, or an explicit wording."""
    lower = lambda name: F.coalesce(F.lower(F.try_parse_url(url, F.lit(name))), F.lit(""))
    channel = lower("PROTOCOL").isin("http", "https") & (lower("PATH").rlike("/ershoufang(?:/|$)") | (lower("HOST").rlike(r"(^|\.)(fang|anjuke)\.com$") & lower("PATH").rlike("^/esf/")))
    worded = F.lit(False)
    for note in notes:
        worded = worded | F.coalesce(note.rlike(scope.NEW_PROJECT_NOTE), F.lit(False))
    return (
        F.when(source_id.startswith("new-project:") & (kind == "reference"), "new")
        .when(source_id.startswith("incremental-price:") & kind.isin("deal", "listing"), "resale")
        .when(source_id == "deals", "resale")
        .when(channel, "resale")
        .when((kind == "reference") & worded, "new")
        .otherwise("unknown")
    )


def possible_duplicate(group: Column, baseline_matches: Column) -> Column:
    """A price row that may repeat another: it is in a duplicate group or matched a baseline row."""
    return present(group) | F.coalesce(baseline_matches > 0, F.lit(False))


def flagged_duplicate(row: Column, payload: Column) -> Column:
    """The short form of the same question: the row or its payload already says so."""
    return F.coalesce(row, F.lit(False)) | F.coalesce(payload, F.lit(False))


def building_age(built: Column, observed: Column) -> Column:
    """Years from the built year to the year of the observation, if both are known and in order."""
    b, o = explicit_year(built), explicit_year(observed)
    return F.when(o >= b, o - b)


def price_headline(kind: Column, total: Column, unit: Column) -> Column:
    """Which figure stands for a price row: a reference's unit price; else the total, the unit price, or undisclosed."""
    return F.when(kind == "reference", F.when(positive(unit).isNotNull(), "unit").otherwise("undisclosed")).when(positive(total).isNotNull(), "total").when(positive(unit).isNotNull(), "unit").otherwise("undisclosed")


def project_price_label(amount: Column, font_encoded: Column, unit: Column, text: Column) -> Column:
    """numeric where the amount can be shown, else the source's text, else undisclosed."""
    ok = ~F.coalesce(font_encoded, F.lit(False)) & positive(amount).isNotNull()
    return F.when(ok, F.concat_ws(" ", amount.cast("string"), unit)).otherwise(F.coalesce(F.when(present(text), text), F.lit("undisclosed")))
