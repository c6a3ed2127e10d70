"""Time series (series_id, t, v): joined time vectors and resampling."""

from __future__ import annotations

from enum import IntFlag

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.frames import islands, neighbours


class Strategy(IntFlag):
    UNION = 0
    INTERSECTION = 1
    PAD_0 = 2
    INTERPOLATION = 4


def extract_times(series: DataFrame, strategy: Strategy = Strategy.UNION, by: str | None = None, order: str | None = None, width: int | None = None) -> DataFrame:
    """Ascending times (t) of all series of a group; a time comes as often as in the series that has it most often. by: groups
    series; None makes one group. order: the whole-number column by which samples of a series follow each other; then a time that is
    NaN splits a series in two, as of different vectors. Without it NaN is dropped. width: as of frames.islands."""
    keys = [by] if by else []
    if order is not None:
        series = islands(series, [*keys, "series_id"], order, F.isnan("t"), width)
        times = extract_times(series.where(~F.isnan("t")).withColumn("series_id", F.struct("series_id", "island")), strategy & ~Strategy.INTERSECTION, by)
        return _within_all(times, series.where(~F.isnan("t")), keys) if strategy & Strategy.INTERSECTION else times
    own = series.where(~F.isnan("t") & F.col("t").isNotNull())
    if strategy & Strategy.INTERSECTION:
        own = _within_all(own, own, keys)
    again = F.row_number().over(Window.partitionBy(*keys, "series_id", "t").orderBy("t"))
    return own.select(*keys, "t", again.alias("again")).distinct().select(*keys, "t")


def _within_all(times: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """The times that are within the range of every whole series."""
    ends = series.groupBy(*keys, "series_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).groupBy(*keys).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    both = times.join(ends, keys) if keys else times.crossJoin(F.broadcast(ends))  # one row
    return both.where((F.col("t") >= F.col("a")) & (F.col("t") <= F.col("b"))).select(times.columns)


def resample(series: DataFrame, times: DataFrame, pad: float | None = None, interpolate: bool = True, width: float | None = None) -> DataFrame:
    """series_id, t, v at distinct times (series_id, t). Outside: pad, or the sample of that end. Without interpolation the
    nearest sample, of two as near the later one. width: the time ranges by which a series is dealt to tasks."""
    found = neighbours(series, times, by="series_id", width=width)
    p, n, t = F.col("p"), F.col("n"), F.col("t")
    edge = F.lit(pad) if pad is not None else F.coalesce(p["v"], n["v"])
    f = (t - p["t"]) / (n["t"] - p["t"])
    inside = n["v"] * f + (1 - f) * p["v"] if interpolate else F.when(t - p["t"] < n["t"] - t, p["v"]).otherwise(n["v"])
    return found.select("series_id", "t", F.when(p.isNull() | n.isNull(), edge).when(p["t"] == t, p["v"]).otherwise(inside).alias("v"))


def resample_pair(a: DataFrame, b: DataFrame, strategy: Strategy, width: float | None = None) -> DataFrame:
    """t, a, b of two single series on their common times. width: the time ranges by which both are dealt to tasks."""
    both = a.withColumn("series_id", F.lit(0)).unionByName(b.withColumn("series_id", F.lit(1)))
    grid = extract_times(both, strategy).distinct()
    pad = 0.0 if strategy & Strategy.PAD_0 else None
    out = resample(both, grid.withColumn("series_id", F.explode(F.array(F.lit(0), F.lit(1)))), pad, bool(strategy & Strategy.INTERPOLATION), width)
    return out.groupBy("t").agg(F.max(F.when(F.col("series_id") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("series_id") == 1, F.col("v"))).alias("b"))
