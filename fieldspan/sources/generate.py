"""Synthetic walks over a plot, by column arithmetic over ``spark.range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspan.functions import geo

#: Where the default plot lies and when its walk begins.
PLOT_LAT, PLOT_LON, PLOT_T = 38.3005, 32.8985, 1_723_000_000.0


def _on_earth(walk: DataFrame, lat0: float, lon0: float) -> DataFrame:
    m_lat, m_lon = geo.metres_per_degree(F.lit(lat0))
    lat, lon = geo.inverse(F.col("x"), F.col("y"), F.lit(lat0), F.lit(lon0), m_lat, m_lon)
    return walk.withColumns({"lat": lat, "lon": lon})


def straight_pass(spark: SparkSession, length_m: float = 25.0, speed_kmh: float = 2.5, interval_s: float = 1.0, lat0: float = 40.0, lon0: float = 32.5, x: float = 0.0) -> DataFrame:
    """n, t, x, y, lat, lon: one lane due north."""
    n = max(2, round(length_m / (speed_kmh / 3.6) / interval_s))
    walk = spark.range(n + 1).select(F.col("id").alias("n"), (F.col("id") * F.lit(length_m / (speed_kmh / 3.6) / n)).alias("t"), F.lit(float(x)).alias("x"), (F.col("id") * F.lit(length_m / n)).alias("y"))
    return _on_earth(walk, lat0, lon0)


#: A walk over the default plot. Lanes are counted from 0; ``shift`` moves a lane east, ``still_m`` is the scatter while standing.
DEFAULTS = {
    "lanes": 24, "length_m": 40.0, "swath_m": 1.0, "offset_m": 12.0, "per_load": 8, "skip": (13,), "shift": {5: -0.4}, "refill_s": 150.0, "work_kmh": 2.5, "walk_kmh": 5.0, "turn_kmh": 1.2,
    "interval_s": 2.0, "noise_m": 0.0, "still_m": 0.6, "seed": 7, "t0": PLOT_T, "lat0": PLOT_LAT, "lon0": PLOT_LON,
}


def _value(v) -> Column:
    if isinstance(v, dict):
        return F.map_from_arrays(F.lit(list(v)).cast("array<int>"), F.lit([float(x) for x in v.values()]).cast("array<double>"))
    return F.array(*map(F.lit, v)).cast("array<int>") if isinstance(v, tuple) else F.lit(v)


def plots(table: DataFrame, **given) -> DataFrame:
    """``table`` (plot_id, and any of the parameters in DEFAULTS as columns) with all parameters: its own, those given, or the defaults."""
    return table.withColumns({k: _value(given.get(k, v)) for k, v in DEFAULTS.items() if k not in table.columns})


def lane_table(plot: DataFrame) -> DataFrame:
    """A row a worked lane of each plot, with the plot's parameters: trip (from 0), x, near and far (y where it is entered and left),
    last_x, refill (the tank is empty before it), final (the walk's last)."""
    lane = F.col("lane")
    every = plot.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).where(~F.array_contains("skip", lane))
    gone = F.size(F.filter(F.array_distinct("skip"), lambda k: (k >= 0) & (k < lane)))
    left_out = F.size(F.filter(F.array_distinct("skip"), lambda k: (k >= 0) & (k < F.col("lanes"))))
    placed = every.withColumns({
        "trip": lane - gone, "x": F.col("offset_m") + F.col("swath_m") * (lane + 0.5) + F.coalesce(F.try_element_at("shift", lane), F.lit(0.0)), "final": lane - gone == F.col("lanes") - left_out - 1,
    })
    far = F.col("length_m") * (1 - F.col("trip") % 2)  # even trips go up, odd ones down
    order = Window.partitionBy("plot_id").orderBy("trip")
    return placed.withColumns({"near": F.col("length_m") - far, "far": far, "last_x": F.lag("x", 1, 0.0).over(order), "refill": (F.col("trip") > 0) & (F.col("trip") % F.col("per_load") == 0)})


def legs(plot: DataFrame) -> DataFrame:
    """plot_id, k, ax, ay, bx, by, t, s, still, and the parameters that positions need: the walks' legs in order, when each begins and how long it takes.

    Each lane's legs are columns of its row: home and a stay before a lane with a fresh tank, the way to
    its near end, the lane itself. A stay of 90 s at home opens and closes the walk.
    """
    zero, x, near, far = F.lit(0.0), F.col("x"), F.col("near"), F.col("far")
    first, fresh = F.col("trip") == 0, F.col("refill") | (F.col("trip") == 0)

    def leg(part: int, ax: Column, ay: Column, bx: Column, by: Column, kmh: Column, stay: Column | None = None) -> Column:
        way = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
        return F.struct(F.lit(part).alias("part"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), (way / (kmh / 3.6) if stay is None else stay).alias("s"), F.lit(stay is not None).alias("still"))

    walking, last_x, rest = F.col("walk_kmh"), F.col("last_x"), F.lit(90.0)
    to_x, to_y = F.when(fresh, zero).otherwise(last_x), F.when(fresh, zero).otherwise(near)
    along = leg(4, x, near, x, far, F.col("work_kmh"))
    none = F.slice(F.array(along), 1, 0)
    opening = F.when(first, F.array(leg(0, zero, zero, zero, zero, walking, rest))).otherwise(none)
    refills = F.when(F.col("refill"), F.array(leg(1, last_x, near, zero, zero, walking), leg(2, zero, zero, zero, zero, walking, F.col("refill_s")))).otherwise(none)
    enter = leg(3, to_x, to_y, x, near, F.when(fresh, walking).otherwise(F.col("turn_kmh")))
    closing = F.when(F.col("final"), F.array(leg(5, x, far, zero, zero, walking), leg(6, zero, zero, zero, zero, walking, rest))).otherwise(none)
    kept = ["plot_id", "interval_s", "noise_m", "still_m", "seed", "t0", "lat0", "lon0"]
    each = lane_table(plot).select(*kept, "trip", F.explode(F.concat(opening, refills, F.array(enter, along), closing)).alias("leg")).select(*kept, "trip", "leg.*").where("s > 0")
    order = Window.partitionBy("plot_id").orderBy("trip", "part")  # a few rows a lane
    begun = F.coalesce(F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero)
    return each.select(*kept, (F.row_number().over(order) - 1).alias("k"), "ax", "ay", "bx", "by", begun.alias("t"), "s", "still")


def walks(plot: DataFrame) -> DataFrame:
    """plot_id, n, t, x, y, lat, lon, accuracy_m: back and forth over each of ``plots`` with refills at (0, 0).

    Any number of walks is one job: times are running sums within a walk, and no step looks across walks.
    """
    table = legs(plot).withColumn("steps", F.greatest(F.lit(1), F.round(F.col("s") / F.col("interval_s"))).cast("int"))
    counted = F.col("steps") + F.when(F.col("k") == 0, 1).otherwise(0)
    before = Window.partitionBy("plot_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("first_n", F.coalesce(F.sum(counted).over(before), F.lit(0)))
    each = table.withColumn("j", F.explode(F.sequence(F.when(F.col("k") == 0, 0).otherwise(1), "steps"))).withColumn("share", F.col("j") / F.col("steps"))

    def jitter(c: int):
        wide = F.when(F.col("still"), F.col("still_m")).otherwise(0.0)
        # Box-Muller on hashes: the same for a position however the rows are dealt.
        u, v = (F.shiftrightunsigned(F.xxhash64("seed", F.lit(c), F.lit(i), "k", "j"), 11) * F.lit(2.0**-53) for i in (0, 1))
        return (wide + F.col("noise_m")) * F.sqrt(-2 * F.log(u + F.lit(1e-300))) * F.cos(2 * F.lit(3.141592653589793) * v)

    n = F.col("first_n") + F.col("j") - F.when(F.col("k") == 0, 0).otherwise(1)
    spots = each.select("plot_id", "lat0", "lon0", n.cast("long").alias("n"), (F.col("t0") + F.col("t") + F.col("s") * F.col("share")).alias("t"), (F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("share") + jitter(0)).alias("x"), (F.col("ay") + (F.col("by") - F.col("ay")) * F.col("share") + jitter(1)).alias("y"))
    m_lat, m_lon = geo.metres_per_degree(F.col("lat0"))
    lat, lon = geo.inverse(F.col("x"), F.col("y"), F.col("lat0"), F.col("lon0"), m_lat, m_lon)
    return spots.select("plot_id", "n", "t", "x", "y", lat.alias("lat"), lon.alias("lon"), F.lit(2.0).alias("accuracy_m"))


def walk(spark: SparkSession, **given) -> DataFrame:
    """``walks`` of one plot: n, t, x, y, lat, lon, accuracy_m."""
    return walks(plots(spark.range(1).select(F.col("id").alias("plot_id")), **given)).drop("plot_id")
