"""Calibrations as tables: for each movie and integration time, digital levels and their temperatures, both increasing.

`lookups` makes one row of two sorted arrays of each; a pixel finds its place there by binary search, as a column expression, and
its temperature on the line between two entries; beyond the ends it has that of the end. The same arrays the other way round give the digital level of
a temperature. So both ways stay in the JVM, and different movies have different tables in one query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators import reading

#: Entries of a table at most: levels have 13 bits.
MOST = 1 << 13


def lookups(table: DataFrame, by: tuple[str, ...] = ("movie_id", "ti")) -> DataFrame:
    """by, levels, temperatures: of rows (by, dl, t). Levels that come again have their least temperature; entries without a level or
    temperature are left out. A table whose temperatures do not increase, or of more than MOST entries, is an error."""
    own = table.where("dl is not null and t is not null and not isnan(t)").groupBy(*by, F.col("dl").cast("int").alias("dl")).agg(F.min(F.col("t").cast("double")).alias("t"))
    each = own.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dl", "t"))).alias("e"))
    levels, temperatures = (F.transform("e", lambda x: x[k]) for k in ("dl", "t"))
    out = each.select(*by, levels.alias("levels"), temperatures.alias("temperatures"))
    fine = (F.size("levels") <= MOST) & (F.array_distinct("temperatures") == F.array_sort("temperatures")) & (F.array_sort("temperatures") == F.col("temperatures"))
    return out.withColumn("levels", F.when(fine, F.col("levels")).otherwise(F.raise_error(F.lit("the temperatures of a calibration increase with its levels, which are at most 8192")).cast("array<int>")))


def place(values: Column, v: Column) -> Column:
    """How many of the sorted values are at most v, by binary search."""
    steps = F.sequence(F.lit(1), F.lit(MOST.bit_length()))

    def halve(s: Column, _) -> Column:
        middle = ((s["low"] + s["high"]) / 2).cast("int")
        up = F.get(values, middle) <= v
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(up, middle + 1).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(middle).alias("high")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halve)["low"]


def between(x: Column, y: Column, v: Column, i: Column) -> Column:
    """The value at v on the line through the points (x, y), of which i are at or before v; that of the end beyond it."""
    a, b = F.get(x, i - 1).cast("double"), F.get(x, i).cast("double")
    c, d = F.get(y, i - 1).cast("double"), F.get(y, i).cast("double")
    return F.when(i == 0, F.get(y, F.lit(0)).cast("double")).when(i == F.size(x), c).otherwise(c + (d - c) * ((v - a) / (b - a)))


def _found(values: DataFrame, tables: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return values.join(tables.select(*by, "levels", "temperatures"), list(by), "left")


def to_temperatures(values: DataFrame, tables: DataFrame, level: str = "dl", by: tuple[str, ...] = ("movie_id", "ti"), inv_emissivity: Column | None = None) -> DataFrame:
    """values with `temperature`, null where there is no table. Levels are the low 13 bits of a pixel, times the emissivity's
    inverse, if that is given."""
    v = F.col(level).cast("double") if inv_emissivity is None else F.col(level) * inv_emissivity
    own = _found(values.withColumn("_v", v), tables, by).withColumn("_i", place(F.col("levels"), F.col("_v")))
    return own.withColumn("temperature", between(F.col("levels"), F.col("temperatures"), F.col("_v"), F.col("_i"))).drop("levels", "temperatures", "_i", "_v")


def to_levels(values: DataFrame, tables: DataFrame, temperature: str = "temperature", by: tuple[str, ...] = ("movie_id", "ti"), inv_emissivity: Column | None = None) -> DataFrame:
    """values with `level`, the nearest whole one; null where there is no table."""
    own = _found(values, tables, by).withColumn("_i", place(F.col("temperatures"), F.col(temperature)))
    v = between(F.col("temperatures"), F.col("levels"), F.col(temperature), F.col("_i"))
    v = v if inv_emissivity is None else v / inv_emissivity
    return own.withColumn("level", F.floor(v + 0.5).cast("int")).drop("levels", "temperatures", "_i")


def of_pixels(pixels: DataFrame, tables: DataFrame, movie: str = "movie_id") -> DataFrame:
    """pixels (movie, px, ...) with `temperature`: the upper three bits of a pixel are its integration time, the others its level."""
    own = pixels.withColumns({"ti": F.shiftright("px", 13), "dl": F.col("px").bitwiseAND(F.lit(8191))})
    return to_temperatures(own, tables.withColumnRenamed("movie_id", movie), "dl", (movie, "ti"))


class TableCalibration(reading.Calibration):
    """A movie's calibration from the tables of its integration times, {ti: (levels, temperatures)}: the same for columns and images.

    An integration time without a table has no temperatures: null in columns, an error for images. Image values are temperatures in
    whole numbers, rounded; levels are the low 13 bits of a word."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]], name: str = "Temperature", files: list[str] = ()):
        self.of, self.name, self._files = {int(k): (np.asarray(a, np.int64), np.asarray(b, np.float64)) for k, (a, b) in tables.items()}, name, list(files)
        for levels, temperatures in self.of.values():
            if not len(levels) or len(levels) > MOST or (np.diff(levels) <= 0).any() or (np.diff(temperatures) <= 0).any():
                raise ValueError("levels and temperatures of a calibration increase")

    @classmethod
    def of_movie(cls, lookup: DataFrame, movie_id, **more) -> TableCalibration:
        """From the rows of `lookups` of one movie, of which there are at most eight."""
        rows = lookup.where(F.col("movie_id") == movie_id).limit(8).collect()
        return cls({r.ti: (r.levels, r.temperatures) for r in rows}, **more)

    def _by_time(self, ti: Column, of) -> Column:
        out = F.lit(None).cast("double")
        for k, (levels, temperatures) in self.of.items():
            out = F.when(ti == k, of(F.array(*map(F.lit, levels.tolist())), F.array(*map(F.lit, temperatures.tolist())))).otherwise(out)
        return out

    def to_temp(self, v: Column, ti: Column, inv_emissivity: Column) -> Column:
        at = v.cast("double") * inv_emissivity
        return self._by_time(ti, lambda levels, temperatures: between(levels, temperatures, at, place(levels, at)))

    def to_dl(self, t: Column, ti: Column, inv_emissivity: Column) -> Column:
        return F.floor(self._by_time(ti, lambda levels, temperatures: between(temperatures, levels, t, place(temperatures, t))) / inv_emissivity + 0.5).cast("int")

    def apply_float(self, img: np.ndarray, inv_emissivity: np.ndarray | float = 1.0) -> np.ndarray:
        out, level, times = np.zeros(img.shape), (img & 8191) * np.broadcast_to(inv_emissivity, img.shape), img >> 13
        for k in np.unique(times).tolist():
            if k not in self.of:
                raise reading.CalibrationNotFound(f"integration time {k}")
            here = times == k
            out[here] = np.interp(level[here], *self.of[k])
        return out.astype(np.float32)

    def apply(self, img: np.ndarray, inv_emissivity: np.ndarray | float = 1.0) -> np.ndarray:
        return np.clip(np.floor(self.apply_float(img, inv_emissivity) + 0.5), 0, 65535).astype("<u2")

    def supports_emissivity(self) -> bool:
        return True

    def files(self) -> list[str]:
        return self._files

    def tables(self) -> dict[str, np.ndarray]:
        return {f"{kind}_{k}": v for k, pair in self.of.items() for kind, v in zip(("levels", "temperatures"), pair, strict=True)}


def catalog(spark: SparkSession, calibrations: dict) -> DataFrame:
    """movie_id, name, values: the tables of calibrations by movie, to be queried like any other."""
    rows = [(movie, name, np.asarray(c.tables()[name], float).ravel().tolist()) for movie, c in calibrations.items() for name in reading.table_names(c)]
    return spark.createDataFrame(rows, "movie_id string, name string, values array<double>")
