"""Verbs over frames (movie_id, pos, ...) and pixels (frame, y, x, px). Movies are keys: all windows are by movie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels_of(frames: DataFrame, frame: str, values: str, width: int, value: Column | None = None) -> DataFrame:
    """One row a pixel, of a column that holds each frame row by row."""
    v = F.col("v") if value is None else value
    each = frames.select(F.col(frame).alias("frame"), F.posexplode(values).alias("i", "v"))
    return each.select("frame", F.expr(f"cast(i div {width} as int)").alias("y"), (F.col("i") % width).alias("x"), v.alias("px"))


def slice_frames(frames: DataFrame, n: int, start: int = 0, stop: int = 0, step: int = 0) -> DataFrame:
    """[start:stop:step]: 0 stands for the default, negative bounds count once from the end."""
    a = start + n if start < 0 else start
    b = n if not stop else stop + n if stop < 0 else stop
    s = step or 1
    out = frames.where((F.col("pos") >= a) & (F.col("pos") < b))
    return out if s == 1 else out.where((F.col("pos") - a) % s == 0)


def at_position(frames: DataFrame, pos: int, n: int) -> DataFrame:
    """The frame at a position of movies of n frames; negative ones count from the end, others beyond are an IndexError."""
    if not -n <= pos < n:
        raise IndexError(f"no frame {pos} among {n}")
    return frames.where(F.col("pos") == (pos + n if pos < 0 else pos))


def at_positions(frames: DataFrame, positions: list[int]) -> DataFrame:
    """Rows at positions, in their order and as often as they are given (column `nr`)."""
    wanted = frames.sparkSession.createDataFrame(list(enumerate(positions)), "nr int, pos int")
    return frames.join(F.broadcast(wanted), "pos")  # as many rows as the caller has typed


def neighbours(samples: DataFrame, probes: DataFrame, by: str = "movie_id", t: str = "t", carried: tuple[str, ...] = ("v",), width: float | None = None) -> DataFrame:
    """Each probe (by, t) with the sample at or before it (p) and at or after it (n): one shuffle, no join of samples and probes.

    Both windows run from an end to the current row, one of them backwards, so each row is visited once. width: the length of the
    time ranges by which a series is dealt to tasks; a range's probes beyond its own samples get what the nearest range that
    has samples carries over. None leaves a series whole."""
    own = F.struct(F.col(t).alias("t"), *carried)
    both = samples.select(by, F.col(t).alias("at"), own.alias("s"), F.lit(False).alias("probe")).unionByName(
        probes.select(by, F.col(t).alias("at")).withColumn("s", F.lit(None).cast(_kind(samples, t, carried))).withColumn("probe", F.lit(True))
    )
    cell = F.lit(0).cast("long") if width is None else F.floor(F.col("at") / F.lit(width))
    both = both.withColumn("cell", cell)

    def latest(s: Column, keys: list[str], *order: Column) -> Column:
        return F.last(s, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow))

    out = both.select(by, "cell", "at", "probe", latest(F.col("s"), [by, "cell"], F.asc("at")).alias("p"), latest(F.col("s"), [by, "cell"], F.desc("at")).alias("n")).where("probe")
    if width is not None:
        ends = both.groupBy(by, "cell").agg(F.max("s").alias("high"), F.min("s").alias("low"))
        held = ends.select(by, "cell", latest(F.col("high"), [by], F.asc("cell")).alias("high"), latest(F.col("low"), [by], F.desc("cell")).alias("low"))
        held = held.select(by, "cell", *[F.lag(c).over(Window.partitionBy(by).orderBy(o)).alias(k) for c, o, k in (("high", F.asc("cell"), "before"), ("low", F.desc("cell"), "after"))])
        out = out.join(held, [by, "cell"]).select(by, "at", F.coalesce("p", "before").alias("p"), F.coalesce("n", "after").alias("n"))
    return out.select(by, F.col("at").alias(t), "p", "n")


def _kind(df: DataFrame, t: str, carried: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return f"struct<t:{kinds[t]}," + ",".join(f"{c}:{kinds[c]}" for c in carried) + ">"


def nearest(frames: DataFrame, probes: DataFrame, width: float | None = None) -> DataFrame:
    """movie_id, t, pos of the frame nearest in time; of two as near, the one before. At equal times the least pos counts.
    width: see neighbours."""
    single = frames.groupBy("movie_id", "t").agg(F.min("pos").alias("pos"))
    found = neighbours(single, probes, carried=("pos",), width=width)
    use_before = F.col("n").isNull() | (F.col("p").isNotNull() & ((F.col("t") - F.col("p.t")) <= (F.col("n.t") - F.col("t"))))
    return found.select("movie_id", "t", F.when(use_before, F.col("p.pos")).otherwise(F.col("n.pos")).alias("pos"))


def frame_period(frames: DataFrame) -> DataFrame:
    gap = F.col("ts_ns") - F.lag("ts_ns").over(Window.partitionBy("movie_id").orderBy("pos"))
    return frames.select("movie_id", gap.alias("gap")).groupBy("movie_id").agg(F.round(F.avg("gap"), 3).alias("frame_period"))


def duration(frames: DataFrame) -> DataFrame:
    return frames.groupBy("movie_id").agg(((F.max_by("ts_ns", "pos") - F.min_by("ts_ns", "pos")) * 1e-9).alias("duration"))


def chunks(frames: DataFrame, step: int, n: DataFrame) -> DataFrame:
    """Tumbling windows of `step` frames without the partial tail; timestamps start anew at 20 ms a frame. n: (movie_id, n)."""
    own = frames.join(n, "movie_id").withColumn("chunk", F.floor(F.col("pos") / step).cast("int")).where((F.col("chunk") + 1) * step <= F.col("n"))
    return own.select("movie_id", "pos", "chunk", ((F.col("pos") - F.col("chunk") * step).cast("long") * 20_000_000).alias("ts_ns"))


def attributes_wide(frames: DataFrame, keys: list[str]) -> DataFrame:
    """A column for each key; keys are given, so that the schema doesn't need a pass over the data."""
    return frames.select("movie_id", "pos", *[F.try_element_at("attrs", F.lit(k)).alias(k) for k in keys])


def attribute(frames: DataFrame, key: str) -> DataFrame:
    return frames.select("movie_id", "pos", F.try_element_at("attrs", F.lit(key)).try_cast("double").alias("value")).where("value is not null")


# --- images


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame", "px").agg(F.count("*").alias("n"))


def median_pixel(pixels: DataFrame, percent: float, mask: DataFrame | None = None) -> DataFrame:
    """Least value whose cumulative count reaches round(n * percent); 0 for none. mask: the (y, x) that count, of all frames."""
    pixels = pixels if mask is None else pixels.join(mask.select("y", "x"), ["y", "x"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("frame").orderBy("px"))
    total = F.sum("n").over(Window.partitionBy("frame"))
    h = histogram(pixels).select("frame", "px", upto.alias("upto"), total.alias("total"))
    reached = F.col("upto") >= F.round(F.col("total") * F.lit(percent))
    out = h.where(reached).groupBy("frame").agg(F.min("px").alias("median"))
    return out if percent else out.withColumn("median", F.lit(0))


def background(pixels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mode of bins of four values, of ties the lowest."""
    bins = pixels.groupBy(*by, "frame", F.shiftright("px", 2).alias("bin")).agg(F.count("*").alias("n"))
    best = bins.groupBy(*by, "frame").agg(F.max(F.struct("n", (-F.col("bin")).alias("low"))).alias("b"))
    return best.select(*by, "frame", (-F.col("b.low") * 4 + 1).alias("background"))


def translate_nearest(pixels: DataFrame, dx: int, dy: int, w: int, h: int) -> DataFrame:
    """By whole pixels; what comes from outside is the nearest pixel of the edge. Each source pixel says where it goes, so
    nothing is joined: those of the edges go to several places."""
    def targets(c: str, d: int, n: int) -> Column:
        to = F.col(c) + d
        low = F.when(F.col(c) == 0, F.lit(0)).otherwise(to)
        high = F.when(F.col(c) == n - 1, F.lit(n - 1)).otherwise(to)
        return F.filter(F.sequence(F.least(low, high), F.greatest(low, high)), lambda k: (k >= 0) & (k < n) & (F.least(F.greatest(k - d, F.lit(0)), F.lit(n - 1)) == F.col(c)))

    ys = pixels.select("frame", "px", F.explode(targets("y", dy, h)).alias("y"), "x")
    return ys.select("frame", "px", "y", F.explode(targets("x", dx, w)).alias("x")).select("frame", "y", "x", "px")


def stencil(pixels: DataFrame, radius: int) -> DataFrame:
    """frame, y, x, px (centre), vs: the pixels in bounds of a square, as (dy, dx, v). Rows say to which centres they belong."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])
    each = pixels.select("frame", "y", "x", "px", F.explode(offsets).alias("o"))
    each = each.select("frame", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), F.struct("o.dy", "o.dx", F.col("px").alias("v")).alias("e"))
    out = each.groupBy("frame", "y", "x").agg(F.collect_list("e").alias("vs"))
    centre = F.filter("vs", lambda e: (e["dy"] == 0) & (e["dx"] == 0))
    return out.where(F.size(centre) > 0).select("frame", "y", "x", F.get(centre, 0)["v"].alias("px"), "vs")


def gaussian(pixels: DataFrame, sigma: float) -> DataFrame:
    r = max(1, int(2 * sigma))
    k = lambda e: F.exp(-(e["dy"] * e["dy"] + e["dx"] * e["dx"]).cast("double") / (2 * sigma * sigma))
    total = lambda f: F.aggregate(F.transform("vs", f), F.lit(0.0), lambda s, x: s + x)
    return stencil(pixels, r).select("frame", "y", "x", (total(lambda e: k(e) * e["v"]) / total(k)).alias("value"))


def median3(pixels: DataFrame, w: int, h: int) -> DataFrame:
    """3x3 median; along edges of three pixels; in corners the lesser of the row's two."""
    at_x, at_y = F.col("x").isin(0, w - 1), F.col("y").isin(0, h - 1)
    row, column = F.filter("vs", lambda e: e["dy"] == 0), F.filter("vs", lambda e: e["dx"] == 0)
    chosen = F.when(at_x & at_y, row).when(at_y, row).when(at_x, column).otherwise(F.col("vs"))
    values = F.array_sort(F.transform(chosen, lambda e: e["v"]))
    return stencil(pixels, 1).select("frame", "y", "x", F.when(at_x & at_y, F.get(values, 0)).otherwise(F.get(values, F.floor(F.size(values) / 2).cast("int"))).alias("px"))


def bad_pixels(pixels: DataFrame, k: float = 5.0) -> DataFrame:
    """frame, y, x of pixels beyond k trimmed deviations of their 5x5 neighbourhood, or below the frame's floor."""
    counted = pixels.groupBy("frame").agg(F.count("*").alias("n"))
    ranks = pixels.select("frame", "px", F.row_number().over(Window.partitionBy("frame").orderBy("px")).alias("r")).join(counted, "frame")
    middle = ranks.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select("frame", F.col("px").alias("m"))
    floor = pixels.join(middle, "frame").groupBy("frame", "m").agg(F.sqrt(F.avg(((F.col("px") - F.col("m")) ** 2).cast("double"))).alias("s")).select(
        "frame", F.greatest(F.lit(0), F.col("m") - (F.col("s") * k).cast("int")).alias("floor")
    )
    v = F.array_sort(F.transform("vs", lambda e: e["v"]))
    n = F.size(v)
    st = stencil(pixels, 2).select("frame", "y", "x", "px", v.alias("v"), F.get(v, F.floor(n / 2).cast("int")).alias("med"))
    low, high = F.floor(F.size("v") / 5).cast("int"), F.floor(F.size("v") * 4 / 5).cast("int")
    inner = F.slice("v", low + 1, high - low)
    s5 = F.sqrt(F.aggregate(inner, F.lit(0.0), lambda s, x: s + (x - F.col("med")) * (x - F.col("med"))) / (high - low))
    st = st.withColumn("s5", s5).join(floor, "frame")
    return st.where((F.col("px") < F.col("med") - k * F.col("s5")) | (F.col("px") > F.col("med") + k * F.col("s5")) | (F.col("px") < F.col("floor"))).select("frame", "y", "x")


def frame_differences(pixels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """By frame: sample deviation of |difference to the frame before|, mean and maximum. by: the columns that name the movie;
    none where all pixels are of one."""
    before = F.lag("px").over(Window.partitionBy(*by, "y", "x").orderBy("frame"))
    d = F.abs(F.col("px") - F.col("b"))
    return pixels.withColumn("b", before).groupBy(*by, "frame").agg(F.round(F.stddev_samp(d), 6).alias("std_diff"), F.round(F.avg("px"), 6).alias("mean"), F.max("px").alias("max"))


def split_deviation(pixels: DataFrame, backgrounds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(sqrt((sum d)^2 - sum d^2)) / n of |difference to the frame before|, for background and foreground pixels. by: the columns
    that name the movie, in pixels and backgrounds; none where all are of one."""
    before = F.lag("px").over(Window.partitionBy(*by, "y", "x").orderBy("frame"))
    d = pixels.withColumn("b", before).where("b is not null").join(backgrounds, [*by, "frame"]).select(*by, "frame", F.abs(F.col("px") - F.col("b")).cast("double").alias("d"), (F.col("px") > F.col("background")).alias("fore"))

    def one(on: Column) -> Column:
        n, s, q = F.count(F.when(on, 1)), F.sum(F.when(on, F.col("d"))), F.sum(F.when(on, F.col("d") * F.col("d")))
        return F.when(n > 0, F.sqrt(s * s - q) / n).otherwise(F.lit(0.0))

    return d.groupBy(*by, "frame").agg(F.round(one(~F.col("fore")), 6).alias("background_dev"), F.round(one(F.col("fore")), 6).alias("foreground_dev"))


def emissivity(pixels: DataFrame, table: DataFrame) -> DataFrame:
    """Pixels with their emissivity, 1 where there is none."""
    return pixels.join(table, ["y", "x"], "left").select("frame", "y", "x", "px", F.coalesce("e", F.lit(1.0)).alias("e"))


def flip(pixels: DataFrame, w: int, h: int, left_right: bool, up_down: bool) -> DataFrame:
    y, x = (h - 1 - F.col("y")) if up_down else F.col("y"), (w - 1 - F.col("x")) if left_right else F.col("x")
    return pixels.select("frame", y.alias("y"), x.alias("x"), "px")


def islands(df: DataFrame, by: list[str], order: str, flag: Column, width: int | None = None) -> DataFrame:
    """df with `island`: how many flagged rows come up to each row, in order of a whole-number column. width: the ranges of that column
    by which a series is dealt to tasks; counts of ranges are added up by themselves."""
    marked = df.withColumn("_flag", F.when(flag, 1).otherwise(0))
    upto = lambda *keys: F.sum("_flag").over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    if width is None:
        return marked.withColumn("island", upto(*by)).drop("_flag")
    marked = marked.withColumn("_cell", F.floor(F.col(order) / F.lit(width)))
    each = marked.groupBy(*by, "_cell").agg(F.sum("_flag").alias("own"))
    earlier = each.select(*by, "_cell", F.coalesce(F.sum("own").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    return marked.withColumn("island", upto(*by, "_cell")).join(earlier, [*by, "_cell"]).withColumn("island", F.col("island") + F.col("_earlier")).drop("_flag", "_cell", "_earlier")


def running_average_with_resets(series: DataFrame, n: int, value: str, reset: Column, by: tuple[str, ...] = ("movie_id",), order: str = "pos", width: int | None = None) -> DataFrame:
    """series with `mean`: the whole-number mean of the last n values, of which those before the last reset count as the value at it.

    `order` counts rows from 0 without gaps. Resets make islands; in its island a row sums the last n values, and what is missing to
    n, or to as many as there are yet, has the island's first value. width: the ranges of `order`, of n rows at least, by which a
    series is dealt to tasks; a range also gets the n - 1 rows before it, which tell all that matters of what was earlier."""
    if width is not None and width < n:
        raise ValueError("ranges are of n rows at least")
    own = series.withColumns({"_reset": F.coalesce(reset, F.lit(False)), "_cell": F.lit(0).cast("long") if width is None else F.floor(F.col(order) / F.lit(width)), "_own": F.lit(True)})
    if width is not None:
        ahead = own.where(F.col(order) % width >= width - (n - 1)).withColumns({"_cell": F.col("_cell") + 1, "_own": F.lit(False)})
        own = own.unionByName(ahead)
    marked = own.withColumn("_island", F.sum(F.when(F.col("_reset"), 1).otherwise(0)).over(Window.partitionBy(*by, "_cell").orderBy(order)))
    recent = Window.partitionBy(*by, "_cell", "_island").orderBy(order).rowsBetween(-(n - 1), 0)
    first = F.first(value).over(Window.partitionBy(*by, "_cell", "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    held = F.least(F.col(order) + 1, F.lit(n))
    total = F.sum(value).over(recent) + (held - F.count(F.lit(1)).over(recent)) * first
    return marked.withColumn("mean", F.floor(total / held).cast("long")).where("_own").drop("_reset", "_cell", "_own", "_island")


def running_average(pixels: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Whole-number mean of each pixel's last n frames. by: the columns that name the movie; none where all pixels are of one."""
    w = Window.partitionBy(*by, "y", "x").orderBy("frame").rowsBetween(-(n - 1), 0)
    return pixels.select(*by, "frame", "y", "x", F.floor(F.sum("px").over(w) / F.count("px").over(w)).cast("long").alias("mean"))
