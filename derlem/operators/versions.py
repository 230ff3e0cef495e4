"""Series of versions of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, group: list[str], day: str, distinct: bool = True) -> DataFrame:
    """(group, n, median_gap, newest) over distinct days, or over those of all rows; a group with one day has no gap."""
    u = df.filter(F.col(day).isNotNull()).select(*group, day)
    u = u.distinct() if distinct else u
    g = u.withColumn("_gap", F.date_diff(day, F.lag(day).over(Window.partitionBy(*group).orderBy(day))))
    return g.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.median("_gap"), 3).alias("median_gap"), F.max(day).cast("string").alias("newest"))


def is_series(stats: DataFrame, kinds: list[str], least_gap: int = 150) -> DataFrame:
    """Groups that are a periodical's versions: of a listed kind, with a median gap of ``least_gap`` days."""
    return stats.filter(F.col("tur").isin(kinds) & (F.col("median_gap") >= least_gap))


def _ranked(docs: DataFrame, group: list[str], key: str, day: str, kinds: list[str]) -> DataFrame:
    """``docs`` with ``_series`` (null outside of one) and ``_r``, the place within the group from the newest on."""
    stats = gaps(docs, group, day, distinct=False).join(docs.groupBy(*group).agg(F.count("*").alias("_all")), group)
    series = is_series(stats, kinds).filter(F.col("n") == F.col("_all")).select(*group, F.lit(True).alias("_series"))
    w = Window.partitionBy(*group).orderBy(F.col(day).desc_nulls_last(), F.col(key).desc())
    return docs.join(series, group, "left").withColumn("_r", F.row_number().over(w))


def current(docs: DataFrame, group: list[str], key: str, day: str, kinds: list[str]) -> DataFrame:
    """``docs`` (one row per document) without the older members of a series; every other document is current for itself.

    A series is a named group of a listed kind whose documents all have a day, with the median gap of ``is_series`` between
    them. Its current document is the one with the newest day, then the largest ``key``.
    """
    return _ranked(docs, group, key, day, kinds).filter(F.col("_series").isNull() | (F.col("_r") == 1)).drop("_series", "_r")


def older(docs: DataFrame, group: list[str], key: str, day: str, kinds: list[str]) -> DataFrame:
    """The members of series that are not current, with ``current_id``, the key of the one that is."""
    x = _ranked(docs, group, key, day, kinds).filter("_series")
    now = x.filter("_r = 1").select(*group, F.col(key).alias("current_id"))
    return x.filter("_r > 1").join(now, group).drop("_series", "_r")
