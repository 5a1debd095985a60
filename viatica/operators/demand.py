"""Trip demand: validation, chains, ownership, classes, aggregation in space and time, sampling and OD expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viatica.functions.lineage import kept, spread

SPAN = 10_000  # trips of a cell that one row is opened into
MODES = ("walk", "bike", "car", "transit", "car_transit", "bike_transit", "bike_share", "bike_share_transit", "taxi")


def trip_faults(trips: DataFrame, zones: int) -> DataFrame:
    """How many trips break each rule."""
    rules = {
        "mode_unknown": F.col("mode").isNotNull() & ~F.col("mode").isin(*MODES),
        "mode_missing": F.col("mode").isNull(),
        "weight_missing": F.col("weight").isNull(),
        "zone_out_of_range": ~(F.col("o_zone").between(0, zones - 1) & F.col("d_zone").between(0, zones - 1)),
        "departure_negative": F.col("departure_s") < 0,
        "same_ends": F.col("o_zone") == F.col("d_zone"),
    }
    counted = trips.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, c in rules.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("code"), F.col(n).alias("rows")) for n in rules])).alias("x")).select("x.code", "x.rows")


def diagnostics(found: DataFrame, most: int) -> DataFrame:
    """Findings (code, element) counted by code, with the first `most` elements of each."""
    rank = F.row_number().over(Window.partitionBy("code").orderBy("element"))
    count = F.count("*").over(Window.partitionBy("code"))
    return found.withColumns({"n": rank, "rows": count}).filter(F.col("n") <= most).select("code", "rows", "element")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def chain() -> Window:
    return Window.partitionBy("traveller_id").orderBy("trip_seq")


def travellers(trips: DataFrame, default_weight: int = 1) -> DataFrame:
    """One row a traveller: trips, the first weight given, the first class, and whether the classes differ."""
    key = F.col("trip_seq")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(key, F.col(c))))[c]
    return trips.groupBy("traveller_id").agg(F.count("*").alias("trips"), F.coalesce(first("weight"), F.lit(default_weight)).cast("long").alias("weight"), first("user_class").alias("user_class"), (F.count_distinct("user_class") > 1).alias("classes_differ"))


def chained_origins(trips: DataFrame) -> DataFrame:
    """A trip starts where the one before it ended."""
    before = F.lag("d_zone").over(chain())
    return trips.withColumn("origin", F.coalesce(before, "o_zone")).withColumn("moved", F.coalesce(before != F.col("o_zone"), F.lit(False)))


def ownership(travellers_: DataFrame, persons: DataFrame, class_defaults: DataFrame) -> DataFrame:
    """What a person says of a car, else the class's default, else none."""
    return travellers_.join(persons, "traveller_id", "left").join(F.broadcast(class_defaults), "user_class", "left").select("traveller_id", F.coalesce("owns_car", "class_owns_car", F.lit(False)).alias("owns_car"), F.col("owns_car").isNotNull().alias("overridden"))


def window_report(trips: DataFrame, start: int, end: int) -> DataFrame:
    inside = F.col("departure_s").between(start, end - 1)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return trips.agg(count(inside).alias("kept"), count(F.col("departure_s") < start).alias("before"), count(F.col("departure_s") >= end).alias("after"))


def departure_span(trips: DataFrame, quarter: int = 900) -> DataFrame:
    """Where a window starts by default, and how long the departures last in whole quarters."""
    start = F.floor(F.min("departure_s") / quarter) * quarter
    end = (F.floor(F.max("departure_s") / quarter) + 1) * quarter
    return trips.agg(start.cast("long").alias("start_s"), (end - start).cast("long").alias("period_s"))


def offered_modes(trips: DataFrame, class_modes: DataFrame) -> DataFrame:
    """The modes a trip may use: its own if it has one and its class allows it, else all of its class."""
    joined = trips.join(F.broadcast(class_modes), "user_class", "left")
    own = F.array_intersect("modes", F.array("mode"))
    return joined.withColumn("offered", F.when(F.col("mode").isNull(), F.col("modes")).otherwise(own))


def square(x: str, y: str) -> Column:
    d = lambda c: F.col(f"p_{c}") - F.col(f"z_{c}")
    return d(x) * d(x) + d(y) * d(y)


def nearest_zone(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Each point's nearest zone, the first of a tie. The zone table is small and fixed: a broadcast, one candidate kept a point."""
    z = zones.select(F.collect_list(F.struct("zone", "x", "y")).alias("all"))
    near = F.array_min(F.transform("all", lambda r: F.struct(((F.col("x") - r["x"]) * (F.col("x") - r["x"]) + (F.col("y") - r["y"]) * (F.col("y") - r["y"])).alias("d2"), r["zone"].alias("zone"))))
    return points.crossJoin(F.broadcast(z)).withColumn("near", near).select("point", F.col("near.zone").alias("zone"), F.col("near.d2").alias("d2"))  # one row: the zones in an array


def cell_points(ends: DataFrame, cell: int) -> DataFrame:
    """Each grid cell's most used point: most ends, then the least coordinates."""
    counts = ends.withColumns({"cx": F.floor(F.col("x") / cell).cast("long"), "cy": F.floor(F.col("y") / cell).cast("long")}).groupBy("cx", "cy", "x", "y").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(F.desc("n"), "x", "y"))
    total = F.sum("n").over(Window.partitionBy("cx", "cy"))
    return counts.withColumns({"r": best, "ends": total}).filter("r = 1").select("cx", "cy", "x", "y", "ends")


def order_key(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def systematic_sample(rows: DataFrame, strata: Sequence[str], key: str, weight: int, seed: int) -> DataFrame:
    """Every weight-th row of each stratum in a seeded order, each standing for weight."""
    n = F.row_number().over(Window.partitionBy(*strata).orderBy(order_key(seed, key), key)) - 1
    return rows.withColumn("n", n).filter(F.col("n") % weight == 0).drop("n").withColumn("sample_weight", F.lit(weight).cast("long"))


def assign_classes(people: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """Classes by cumulative share: whole seeded order, weights summed, each person by the middle of their stretch.

    The running sum over all people is taken in two steps, within the first two digits of the order key and over those
    256 sums, so that no task holds everybody.
    """
    keyed = people.withColumn("k", order_key(seed, "traveller_id")).withColumn("b", F.substring("k", 1, 2))
    sums = keyed.groupBy("b").agg(F.sum("weight").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("b", before.alias("before"), F.sum("s").over(Window.partitionBy(F.lit(0))).alias("all"))
    inside = F.sum("weight").over(Window.partitionBy("b").orderBy("k", "traveller_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.withColumn("inside", inside).join(F.broadcast(sums), "b")
    middle2 = 2 * (F.col("before") + F.col("inside")) - F.col("weight")  # twice the middle, in whole people
    ranged = shares.select("user_class", (F.sum("percent").over(Window.orderBy("user_class")) - F.col("percent")).alias("lo"), F.sum("percent").over(Window.orderBy("user_class")).alias("hi"))
    hit = (middle2 * 50 >= F.col("lo") * F.col("all")) & (middle2 * 50 < F.col("hi") * F.col("all"))
    return placed.join(F.broadcast(ranged), hit).select("traveller_id", "user_class")


def integerise(cells: DataFrame, whole: int, seed: int) -> DataFrame:
    """Largest remainders over all cells (o, d, parts of 1/whole): whole trips that keep the total; ties by a seeded key."""
    cells = kept(cells).withColumns({"n": F.expr(f"parts div {whole}"), "rest": F.col("parts") % whole, "k": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("o").cast("string"), F.col("d").cast("string")).cast("binary"))})
    left = cells.agg((F.round(F.sum("parts") / whole) - F.sum("n")).cast("long").alias("left"))
    ranked = cells.withColumn("r", F.row_number().over(Window.orderBy(F.desc("rest"), "k")))  # an OD matrix: zones squared, whatever the trips
    return ranked.crossJoin(F.broadcast(left)).select("o", "d", (F.col("n") + (F.col("r") <= F.col("left")).cast("long")).alias("n"))


def trips_of(cells: DataFrame, start: int, length: int, seed: int) -> DataFrame:
    """One row a trip of each cell (o, d, n), with a seeded departure within the period. Cells are few and full, so they are cut into stretches of SPAN trips, which are dealt over tasks."""
    parts = cells.filter("n > 0").select("o", "d", "n", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(SPAN).cast("long"))).alias("first")).repartition(spread(cells), "o", "d", "first")
    rows = parts.select("o", "d", F.explode(F.sequence("first", F.least("n", F.col("first") + (SPAN - 1)))).alias("i"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("o", "d", "i")]).cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.select("o", "d", "i", (F.lit(start) + draw % length).cast("long").alias("departure_s"))


def vehicle_places(trips: DataFrame) -> DataFrame:
    """Where a traveller's car stands before each trip, and whether that is the trip's origin: it moves with car trips only."""
    moved = F.when(F.col("mode") == "car", F.col("d_zone"))
    home = F.first("o_zone").over(chain())
    at = F.coalesce(F.last(moved, ignorenulls=True).over(chain().rowsBetween(Window.unboundedPreceding, -1)), home)
    return trips.select("traveller_id", "trip_seq", at.alias("car_zone"), (at == F.col("o_zone")).alias("car_here"))
