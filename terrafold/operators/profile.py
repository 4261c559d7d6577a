"""What is known of a community, field by field, with the source of each figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scope
from ..functions.values import building_age, first_present, positive, present, round_half_up
from .market import sample_price

# The fields of a profile (first a project's key, then names in its open field list).
CORE = {
    "address": ("address",), "built_year": (None, "建成年代", "竣工时间"), "property_type": ("property_type", "物业类型"), "building_types": ("building_types", "建筑类型"),
    "property_rights": ("property_rights", "产权年限"), "building_area": ("building_area_raw", "建筑面积"), "land_area": ("land_area_raw", "占地面积"), "units": ("units_raw", "规划户数"),
    "floor_area_ratio": ("floor_area_ratio_raw", "容积率"), "green_ratio": ("green_ratio_raw", "绿化率"), "developer": ("developer",), "property_manager": ("property_manager", "物业公司"),
    "management_fee": ("management_fee_raw", "物业费", "物业费用"), "parking": (None, "车位"), "parking_ratio": (None, "车位配比"), "separation": (None, "人车分流"),
}
SCORED = ("delivery_date_raw", "opening_date_raw", "developer", "property_type", "building_types", "units_raw", "floor_area_ratio_raw", "green_ratio_raw", "land_area_raw", "building_area_raw", "property_manager", "management_fee_raw")
SCORED_FIELDS = ("最近交房", "开盘时间", "最近开盘", "物业费", "车位", "车位配比", "人车分流", "周边配套", "交通情况", "小区配套")
DELIVERY = ("delivery_date_raw", "最近交房", "交房时间", "入住时间")
OPENING = ("opening_date_raw", "最近开盘", "开盘时间", "首次开盘")
EXTENDED = {
    "record_name": ("name", "备案名称", "楼盘名称"), "opening": OPENING, "delivery": DELIVERY, "age": (None,), "storey_height": (None, "建筑层高", "层高情况", "层高"), "buildings": (None, "楼栋总数", "楼栋数"),
    "storeys": (None, "楼层状况", "楼层情况", "楼层"), "layouts": (None, "户型面积", "主力户型"), "decoration": (None, "装修情况", "装修标准", "装修"), "parking_for_sale": (None, "可售车位", "可售车位数"),
    "parking_price": (None, "车位价格"), "facade": (None, "立面材料", "外立面"), "project_company": (None, "项目公司"), "brand": (None, "开发品牌"),
}
SURROUNDING = {"小区设施": "小区配套", "交通": "交通情况", "教育": "教育", "医疗": "医疗", "商业": "商业", "办公": "办公", "景观": "景观", "周边配套": "周边配套"}
#: A profile with at least this share of its fields missing is incomplete.
MISSING_LIMIT = 0.4


def _field(name: str) -> Column:
    return F.try_element_at("field_values", F.lit(name))


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def project_score(df: DataFrame) -> Column:
    """How many of the scored fields a project row has."""
    return sum((present(_has(df, k)).cast("int") for k in SCORED), F.lit(0)) + sum((present(_field(k)).cast("int") for k in SCORED_FIELDS), F.lit(0))


def only_value(c: Column) -> Column:
    """Aggregate: the one value that all rows with a value agree on, else null."""
    values = F.collect_set(F.when(present(c), c.cast("string")))
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def best_project(projects: DataFrame) -> DataFrame:
    """Per place: the project with the most fields (then the latest), and the value all projects agree on per field."""
    keys = [k for k in {"name", *SCORED, *(v[0] for v in CORE.values() if v[0]), "sales_status"} if k in projects.columns]
    names = sorted({n for v in CORE.values() for n in v[1:]} | set(DELIVERY[1:]) | set(OPENING[1:]) | {n for v in EXTENDED.values() for n in v[1:]} | set(SURROUNDING.values()))
    order = F.struct(project_score(projects).alias("score"), F.coalesce(F.col("observed_at").cast("string"), F.lit("")).alias("observed"), F.col("source_id"))
    whole = F.struct(*[F.col(c) for c in projects.columns if c != "entity_id"])
    agreed = F.struct(*[only_value(F.col(k)).alias(k) for k in sorted(keys)])
    fields = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[only_value(_field(n)) for n in names]))
    return projects.groupBy("entity_id").agg(F.max_by(whole, order).alias("best"), agreed.alias("agreed"), fields.alias("agreed_fields"), F.max("observed_at").alias("observed_at"))


def _value(best_cols: list[str], agreed_cols: list[str], key: str | None, names: tuple[str, ...]) -> Column:
    found = []
    if key and key in best_cols:
        found.append(F.col(f"best.{key}"))
    if key and key in agreed_cols:
        found.append(F.col(f"agreed.{key}"))
    found += [F.try_element_at("best.field_values", F.lit(n)) for n in names]
    found += [F.try_element_at("agreed_fields", F.lit(n)) for n in names]
    return first_present(*found) if found else F.lit(None).cast("string")


def price_waterfall(entities: DataFrame, snapshots: DataFrame, project_prices: DataFrame, prices: DataFrame) -> DataFrame:
    """(id, basis, value, low, high, n): the newest community reference, else the newest project price, else the mean
    of listings, else the mean of deals. Possible duplicates and unknown or zero prices do not count."""
    newest = lambda v, d: F.max_by(v, F.struct(F.coalesce(d.cast("string"), F.lit("")), v))
    snap = snapshots.where(positive(F.col("reference_unit_yuan_sqm")).isNotNull()).groupBy(F.col("entity_id").alias("id")).agg(newest(F.col("reference_unit_yuan_sqm"), F.coalesce("source_as_of", "observed_at")).alias("snapshot"))
    proj = project_prices.where(positive(F.col("amount")).isNotNull()).groupBy(F.col("entity_id").alias("id")).agg(newest(F.col("amount"), F.coalesce("price_as_of", "observed_at")).alias("project"))
    clean = prices.where(~F.coalesce("possible_duplicate", F.lit(False)) & positive(F.col("unit_yuan_sqm")).isNotNull() & F.col("kind").isin("listing", "deal"))
    sample = clean.groupBy(F.col("entity_id").alias("id"), "kind").agg(F.struct(*sample_price(F.col("unit_yuan_sqm"))).alias("s"))
    both = sample.groupBy("id").agg(*[F.max(F.when(F.col("kind") == k, F.col("s"))).alias(k) for k in ("listing", "deal")])
    j = entities.select("id").join(snap, "id", "left").join(proj, "id", "left").join(both, "id", "left")
    one = lambda c: F.struct(F.lit(c).alias("basis"), F.col(c).cast("double").alias("value"), F.col(c).cast("double").alias("low"), F.col(c).cast("double").alias("high"), F.lit(1).cast("long").alias("n"))
    many = lambda c: F.struct(F.lit(c).alias("basis"), F.col(f"{c}.average").cast("double").alias("value"), F.col(f"{c}.low").alias("low"), F.col(f"{c}.high").alias("high"), F.col(f"{c}.n").alias("n"))
    price = F.coalesce(*[F.when(F.col(c).isNotNull(), one(c)) for c in ("snapshot", "project")], *[F.when(F.col(c).isNotNull(), many(c)) for c in ("listing", "deal")])
    return j.withColumn("p", price).select("id", "p.*")


def community_profile(entities: DataFrame, projects: DataFrame, waterfall: DataFrame, limit: float = MISSING_LIMIT) -> DataFrame:
    """One row per place: core fields, timing, price, and how complete that is (18 points)."""
    best = best_project(projects).withColumnRenamed("entity_id", "id")
    best_cols, agreed_cols = best.schema["best"].dataType.names, best.schema["agreed"].dataType.names
    j = entities.join(best, "id", "left").join(waterfall.select("id", "basis", F.col("value").alias("price")), "id", "left")
    value = lambda spec: _value(best_cols, agreed_cols, spec[0], spec[1:])
    out = j.withColumns({k: value(v) for k, v in CORE.items() if k not in ("address", "built_year")} | {"__address": value(CORE["address"]), "__built": value(CORE["built_year"]), "delivery": value(DELIVERY), "opening": value(OPENING)})
    out = out.withColumns({"address": first_present(F.col("__address"), F.col("address") if "address" in entities.columns else F.lit(None)), "built_year": first_present(F.col("candidate.built_year"), F.col("__built"))})
    selling = F.coalesce((F.col("best.sales_status") if "sales_status" in best_cols else F.lit("")).rlike(scope.ACTIVE_SALE), F.lit(False))
    out = out.withColumn("timing", F.when(selling & F.col("opening").isNotNull(), F.col("opening")).otherwise(F.coalesce("delivery", "opening")))
    known = sum((present(F.col(k)).cast("int") for k in CORE), F.lit(0)) + present(F.col("timing")).cast("int") + positive(F.col("price")).isNotNull().cast("int")
    total = len(CORE) + 2
    out = out.withColumns({"known": known, "total": F.lit(total)}).withColumn("missing", F.col("total") - F.col("known"))
    rate = F.col("missing") / F.col("total")
    return out.select("id", *CORE, "timing", "price", "basis", "known", "total", "missing", round_half_up(rate * 100).cast("int").alias("missing_percent"), (rate < limit).alias("passes"))


def extended_profile(entities: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per place: the fourteen further fields, how many are known, and its surroundings by label."""
    best = best_project(projects).withColumnRenamed("entity_id", "id")
    best_cols, agreed_cols = best.schema["best"].dataType.names, best.schema["agreed"].dataType.names
    j = entities.join(best, "id", "left")
    value = lambda spec: _value(best_cols, agreed_cols, spec[0], spec[1:])
    built = first_present(F.col("candidate.built_year"), value(CORE["built_year"]))
    out = j.select("id", *[(building_age(built, F.col("observed_at")).cast("string") if k == "age" else value(v)).alias(k) for k, v in EXTENDED.items()], *[value((None, n)).alias(f"__{k}") for k, n in SURROUNDING.items()])
    known, total = sum((present(F.col(k)).cast("int") for k in EXTENDED), F.lit(0)), len(EXTENDED)
    labelled = F.filter(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"__{k}").alias("value")) for k in SURROUNDING]), lambda x: present(x["value"]))
    out = out.withColumns({"extended_known": known, "extended_total": F.lit(total), "surrounding": labelled}).withColumn("extended_missing", F.col("extended_total") - F.col("extended_known"))
    percent = round_half_up(F.col("extended_missing") / F.col("extended_total") * 100).cast("int")
    return out.select("id", *EXTENDED, "extended_known", "extended_total", "extended_missing", percent.alias("extended_missing_percent"), "surrounding")
