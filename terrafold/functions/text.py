"""Texts: normal forms, body identity, districts, rent-only posts. NFKC is the one Arrow UDF here."""

from __future__ import annotations

import sys
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scope
from .values import digest

_MENTIONED = "(" + "|".join(scope.CORE_DISTRICTS) + ")"

# Executors get this module's functions by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode compatibility composition, a batch at a time (Arrow's own leaves letters decomposed)."""
    if pc.all(pc.string_is_ascii(texts), min_count=0).as_py():
        return texts
    return pa.array([t and unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def collapsed(c: Column, dots: bool = False) -> Column:
    """Without Unicode white space (and middle dots)."""
    return F.regexp_replace(c, r"(?U)[\s·•]" if dots else r"(?U)\s", "")


def norm(c: Column, school: Column | bool = False) -> Column:
    """Catalogue key: NFKC, no white space or dots; schools lose the province and city in front."""
    key = collapsed(nfkc(F.coalesce(c.cast("string"), F.lit(""))), True)
    bare = F.regexp_replace(key, f"^{scope.SCHOOL_PREFIX}", "")
    return F.when(school, bare).otherwise(key) if isinstance(school, Column) else bare if school else key


def normalize(c: Column) -> Column:
    """Search key: NFKC, no white space or dots, lower case."""
    return F.lower(norm(c))


def search_forms(c: Column) -> Column:
    """The search key as it is and without the city in front."""
    key = normalize(c)
    return F.array_distinct(F.array(key, F.regexp_replace(key, f"^{scope.CITY_PREFIX}", "")))


def matches(values: Column, query: Column) -> Column:
    """Any form of any value (search_forms of each, flattened) contains any non-empty form of the query."""
    return F.exists(values, lambda v: F.exists(F.filter(query, lambda q: q != ""), lambda q: F.contains(v, q)))


def strip_topic_tags(c: Column) -> Column:
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"#[^#\n]+?\[话题\]#", " ")
    return F.regexp_replace(text, r"(^|(?U:\s))#(?U:[^\s#])+", " ")


def letter_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def without_emoji(c: Column) -> Column:
    return F.regexp_replace(c, r"\[[^\]\n]{1,20}R\]", "")


def body_hash(c: Column) -> Column:
    """Identity of a body: topics away, NFKC, emoji tokens away, letters and numbers, lower case, digest."""
    return digest(F.lower(letter_numbers(without_emoji(nfkc(strip_topic_tags(c))))))


def meaningful_characters(c: Column) -> Column:
    """UTF-16 code units of the letters and numbers outside topics and emoji tokens."""
    return (F.octet_length(F.encode(letter_numbers(without_emoji(strip_topic_tags(c))), "UTF-16LE")) / 2).cast("long")


def post_district(title: Column, body: Column, hints: Column) -> Column:
    """The one district a post names, if no hint says otherwise; else the one hinted core district; else empty."""
    named = F.array_distinct(F.regexp_extract_all(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), strip_topic_tags(body)), F.lit(_MENTIONED), F.lit(1)))
    full = F.transform(F.filter(F.coalesce(hints, F.array().cast("array<string>")), lambda h: h.isNotNull()), lambda h: F.when(h.endswith(scope.DISTRICT_SUFFIX), h).otherwise(F.concat(h, F.lit(scope.DISTRICT_SUFFIX))))
    core = F.array_intersect(F.array_distinct(full), F.array(*map(F.lit, scope.CORE_DISTRICTS)))
    return (
        F.when(F.size(named) > 1, "")
        .when(F.size(named) == 1, F.when(F.size(F.array_except(full, named)) == 0, F.element_at(named, 1)).otherwise(""))
        .when(F.size(core) == 1, F.element_at(core, 1))
        .otherwise("")
    )


def rental_only(title: Column, body: Column) -> Column:
    """About rent, and not about a sale or purchase; investment phrases are no rent."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    rent = F.regexp_replace(F.concat_ws(" ", t, b), scope.INVESTMENT, "").rlike(scope.RENTAL)
    return rent & ~F.concat_ws(" ", t, strip_topic_tags(b)).rlike(scope.SALE) & ~t.rlike(scope.PURCHASE)


def named_home(c: Column) -> Column:
    """A home with a name of its own: no generic term, road or house number."""
    name = collapsed(nfkc(F.coalesce(c, F.lit(""))))
    return ~name.isin(*scope.GENERIC_HOMES) & ~name.rlike(scope.ROAD_OR_NUMBER)


def literal_search(query: str, *fields: Column) -> Column:
    """Any field contains the query literally, whatever the case of ASCII letters; a blank query matches all."""
    if not query.strip():
        return F.lit(True)
    lower = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.contains(lower(f), lower(F.lit(query))), F.lit(False))
    return found


def in_name_order(c: Column) -> Column:
    """Sort key of names: Chinese by pinyin."""
    return F.collate(c, scope.NAME_COLLATION)


def matching_options(options: DataFrame, query: str) -> DataFrame:
    """Options (value, label, group) whose fields together contain the query, both in NFKC, lower case and without white space."""
    key = lambda c: F.lower(collapsed(nfkc(c)))
    fields = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("label", "value", "group")])
    return options.where(F.contains(key(fields), key(F.lit(query))))
