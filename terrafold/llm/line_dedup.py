"""Line dedup by site-relative frequency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small

#: A line is boilerplate if it is on more than this share of a site's pages, and on two of them at least.
RATIO = 0.05


def _column(site: str | Column) -> Column:
    return F.col(site) if isinstance(site, str) else site


def _hashes(text: str) -> Column:
    """Hashes of a text's distinct lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))


def _counted(lines: DataFrame, totals: DataFrame, ratio: float) -> DataFrame:
    """(site, line) of rows (site, line), one per page and line, that are on more than this share of their site's pages."""
    pages = lines.groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    return pages.join(totals, F.col("site").eqNullSafe(F.col("__site"))).where(F.col("pages") > F.lit(ratio) * F.col("total")).select("site", "line")


def _lists(found: DataFrame) -> DataFrame:
    return small(saved(found.groupBy("site").agg(F.collect_set("line").alias("lines")), "boilerplate")).withColumnsRenamed({"site": "__site", "lines": "__lines"})


def _without(docs: DataFrame, lists: DataFrame, text: str, site: str | Column) -> DataFrame:
    """docs joined with their site's list: __all (lines), __hit (hashes of those that go), __kept (those that stay)."""
    out = docs.join(lists, _column(site).eqNullSafe(F.col("__site")), "left").withColumn("__all", F.split(text, "\n"))
    # The intersection hashes both sides once, so that a long list costs no more than its length for each page.
    out = out.withColumn("__hit", F.coalesce(F.array_intersect(_hashes(text), F.col("__lines")), F.array().cast("array<bigint>")))
    stay = F.filter("__all", lambda x: (F.trim(x) == "") | ~F.array_contains("__hit", F.xxhash64(x)))
    return out.withColumn("__kept", F.when(F.size("__hit") > 0, stay).otherwise(F.col("__all")))


def boilerplate(docs: DataFrame, text: str = "text", site: str | Column = "source", ratio: float = RATIO, alike: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per site that has boilerplate: __site, __lines (hashes of its boilerplate lines).

    site names a column, or is an expression such as url_filter.host_of(url). A page counts once for a line however often
    it repeats it, and equal texts of a site are one page, in a line's pages and in the site's: a document that is
    repeated is no boilerplate. Counting is by (site, line hash), with partial sums before the shuffle, so one hot site or
    line never meets in one task. A site has at most (mean lines per page / ratio) boilerplate lines, however many pages it
    has. Hashes are 64 bits wide and compared within a site only.

    alike, if given, gets (page, text), the distinct texts that hold a line which is boilerplate so far, and returns
    (page, group): pages of a group, such as near copies, then count once for a line, and only lines that are still on more
    than the ratio of the site's distinct texts are boilerplate.
    """
    texts = saved(docs.select(_column(site).alias("site"), F.xxhash64(text).alias("page"), _hashes(text).alias("lines")).distinct(), "distinct-pages")
    lines = texts.select("site", "page", F.explode("lines").alias("line"))
    totals = small(saved(texts.groupBy(F.col("site").alias("__site")).agg(F.count(F.lit(1)).alias("total")), "site-totals"))
    found = _counted(lines, totals, ratio)
    if alike is None:
        return _lists(found)
    found = saved(found, "repeated-lines")
    holders = _without(docs.where(F.col(text).isNotNull()), _lists(found), text, site).where(F.size("__hit") > 0)
    holders = saved(holders.select(F.xxhash64(text).alias("page"), F.col(text).alias("text")).dropDuplicates(["page"]), "pages-with-repeated-lines")
    groups = alike(holders).select("page", "group")
    near = found.withColumnsRenamed({"site": "__s", "line": "__l"})
    own = lines.join(small(near), F.col("site").eqNullSafe(F.col("__s")) & (F.col("line") == F.col("__l"))).join(groups, "page")
    return _lists(_counted(own.select("site", "line", "group").distinct(), totals, ratio))


def dedup_lines(docs: DataFrame, text: str = "text", site: str | Column = "source", ratio: float = RATIO, alike: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every row with its text less the site's boilerplate lines (see there), plus n_lines and n_removed.

    Blank lines stay and count as lines; the rest joins by newlines in the old order. Null text stays null with no lines;
    an empty text has one blank line. Null sites are a site of their own. Rows, repeated ones too, are kept even when no
    line is left (empty text). Input columns n_lines and n_removed are replaced; others pass through. Texts are handled
    whole. The lists of boilerplate lines come to the texts while they are small enough to broadcast; beyond, both are
    joined by site, and adaptive execution splits the texts of a hot site among tasks. An empty table gives no rows.
    """
    out = _without(docs.drop("n_lines", "n_removed"), boilerplate(docs, text, site, ratio, alike), text, site)
    out = out.withColumns({"n_lines": F.coalesce(F.size("__all"), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("__all") - F.size("__kept"), F.lit(0)).cast("long")})
    return out.withColumn(text, F.when(F.size("__hit") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text))).drop("__site", "__lines", "__all", "__hit", "__kept")
