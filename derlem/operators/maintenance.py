"""Keeping tables and indexes: upserts, synchronisation, pending work, failure runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """One row per key: the latest time (null is earliest), then the largest ``tie``, which must tell rows of one key apart.

    The winners are found on narrow rows, by an aggregation that combines before it shuffles; the wide rows are only
    filtered by them.
    """
    won = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(F.struct(F.col(time), F.col(tie))).alias("_w"))
    on = F.col(tie) == F.col(f"_w.{tie}")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(won, on, "left_semi")


def advance(state: DataFrame | None, rows: DataFrame, number: str, keys: list[str], sums: dict[str, str], maxima: dict[str, str]) -> DataFrame:
    """Counters (keys, n, sums, maxima, _mark) after the rows whose ``number`` is above the mark that ``state`` left; None is no state yet.

    The mark is the largest number counted. Rows that come later with a number below it are not counted again, nor ever.
    """
    if state is not None:
        mark = state.agg(F.coalesce(F.max("_mark"), F.lit(-(2**62))).alias("_m"))
        rows = rows.join(F.broadcast(mark), F.col(number) > F.col("_m")).drop("_m")
    new = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(a) for a, c in sums.items()], *[F.max(c).alias(a) for a, c in maxima.items()], F.max(number).alias("_mark"))
    if state is None:
        return new
    return state.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(a).alias(a) for a in sums], *[F.max(a).alias(a) for a in [*maxima, "_mark"]])


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with those rows of ``new`` whose key it lacks; of repeated new keys one row."""
    return target.unionByName(new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete_keys(tables: list[DataFrame], gone: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Each table without the keys of ``gone``: deletion that reaches derived tables."""
    return [t.join(gone.select(*keys).distinct(), keys, "left_anti") for t in tables]


def sync_actions(here: DataFrame, there: DataFrame, keys: list[str], time: str, digest: str | None = None) -> DataFrame:
    """What a synchronisation does with each key; equal times keep the own record. With ``digest``, ``conflict`` says whether both have one and they differ."""
    a, b = F.col("_a"), F.col("_b")
    own = [time, *([digest] if digest else [])]
    j = here.select(*keys, F.struct(*own).alias("_a")).join(there.select(*keys, F.struct(*own).alias("_b")), keys, "full_outer")
    newer = (b[time] > a[time]) | (a[time].isNull() & b[time].isNotNull())
    action = F.when(a.isNull(), "insert").when(b.isNull(), "only_here").when(newer, "newer_there").otherwise("keep").alias("action")
    return j.select(*keys, action, *([F.coalesce(a[digest] != b[digest], F.lit(False)).alias("conflict")] if digest else []))


def change_decision(old: DataFrame, new: DataFrame, keys: list[str], content: str, date: str) -> DataFrame:
    j = old.select(*keys, F.struct(content, date).alias("_a")).join(new.select(*keys, F.struct(content, date).alias("_b")), keys, "full_outer")
    a, b = F.col("_a"), F.col("_b")
    kind = F.when(a.isNull(), "new").when(b.isNull(), "gone").when(~a[content].eqNullSafe(b[content]), "changed").when(~a[date].eqNullSafe(b[date]), "metadata").otherwise("same")
    return j.select(*keys, kind.alias("decision"))


def pending_days(done: DataFrame, first: str, last: str, refresh: int = 0) -> DataFrame:
    """Days from ``first`` to ``last`` that are not in ``done`` (d), and the last ``refresh`` days anyway."""
    end = F.lit(last).cast("date")
    calendar = done.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), end)).alias("d"))
    open_days = calendar.join(done.select("d").distinct(), "d", "left_anti")
    return open_days.unionByName(calendar.filter(F.col("d") > F.date_sub(end, refresh))).distinct()


def failure_runs(events: DataFrame, key: str, order: list[str], bad: Column, threshold: int, tie: str) -> DataFrame:
    """Runs of at least ``threshold`` failures without a success between them."""
    w = Window.partitionBy(key).orderBy(*order)
    x = events.withColumns({"_bad": bad, "island": F.sum(F.when(bad, 0).otherwise(1)).over(w)})
    return x.groupBy(key, "island").agg(F.count_if("_bad").alias("n_errors"), F.min(F.when(F.col("_bad"), F.col(tie))).alias("first_error")).filter(F.col("n_errors") >= threshold)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys that ``new`` has, and ``new``; rows of ``old`` with a null key stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def history(rows: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """(key, version, valid_from, valid_to, last_seen, value): runs of equal values along ``step``; ``rows`` has one row per key and step.

    A null value is a value of its own. ``valid_to`` is where the next version begins, null for the last one.
    """
    w = Window.partitionBy(key).orderBy(step)
    x = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).when(~F.lag(value).over(w).eqNullSafe(F.col(value)), 1).otherwise(0)).withColumn("version", F.sum("_new").over(w))
    g = x.groupBy(key, "version").agg(F.min(step).alias("valid_from"), F.max(step).alias("last_seen"), F.first(value).alias(value))
    return g.select(key, "version", "valid_from", F.lead("valid_from").over(Window.partitionBy(key).orderBy("version")).alias("valid_to"), "last_seen", value)


def until_known(rows: DataFrame, group: str, order: str, known: str, streak: int) -> DataFrame:
    """The rows of each group up to the one with which ``streak`` known ones in a row are reached."""
    w = Window.partitionBy(group).orderBy(order)
    x = rows.withColumn("_i", F.sum(F.when(F.col(known), 0).otherwise(1)).over(w))
    x = x.withColumn("_run", F.sum(F.when(F.col(known), 1).otherwise(0)).over(Window.partitionBy(group, "_i").orderBy(order)))
    stop = x.filter(F.col("_run") >= streak).groupBy(group).agg(F.min(order).alias("_stop"))
    return x.join(stop, group, "left").filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_i", "_run", "_stop")


def prune(df: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """The rows not older than ``days`` on a stated day; rows without a time stay."""
    first = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")
    return df.filter(F.col(time).isNull() | (F.col(time).cast("timestamp") >= first))


def health(events: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """(key, n, n_failed, failure_rate, longest_run) of calls; a run ends with a success."""
    w = Window.partitionBy(key).orderBy(*order)
    x = events.select(key, bad.alias("_bad"), F.sum(F.when(bad, 0).otherwise(1)).over(w).alias("_i"))
    runs = x.groupBy(key, "_i").agg(F.count("*").alias("n"), F.count_if("_bad").alias("k"))
    return runs.groupBy(key).agg(F.sum("n").alias("n"), F.sum("k").alias("n_failed"), F.round(F.sum("k") / F.sum("n"), 6).alias("failure_rate"), F.max("k").alias("longest_run"))
