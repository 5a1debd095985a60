"""Readers of persons, zone points, parkings, docks, vehicles, chargers, transfers, road times and options, and writers of small results.

Each table is read once as text and checked as it is read: a row that breaks its table's rules fails the task that meets it, with the row's id.
Repeated ids are found by one aggregate.
"""

from __future__ import annotations

import json
import math
import tomllib
import zipfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.sources.tables import InputError, _csv

# What a table's columns are called, the needed ones first.
PARKING_COLUMNS = ["parking_id", "lon", "lat", "vehicle", "capacity", "name", "hub_id", "initial_occupancy", "fee_eur"]
DOCK_COLUMNS = ["dock_id", "lon", "lat", "capacity", "name", "hub_id", "bikes"]
VEHICLE_COLUMNS = ["vehicle_id", "lon", "lat", "soc"]
CHARGER_COLUMNS = ["charger_id", "lon", "lat", "plugs", "hub_id", "kw"]
PERSON_COLUMNS = {"traveller_id": "string", "owns_car": "boolean", "owns_bike": "boolean", "has_transit_pass": "boolean", "user_class": "string"}
MODES = ["car", "bike", "walk", "transit", "car_transit", "bike_transit", "bike_share", "taxi"]


def _table(spark: SparkSession, path: str, columns: Sequence[str], needed: int) -> DataFrame:
    """The columns of a comma- or tab-separated table as trimmed texts, whatever the case of their names; blank is null, a needed column must be there."""
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    raw = _csv(spark, path, "\t" if first is not None and "\t" in first.value else ",")
    there = {c.strip().lower().lstrip("﻿"): c for c in raw.columns}
    if lost := [c for c in columns[:needed] if c not in there]:
        raise InputError(f"no columns {', '.join(lost)}")
    return raw.select(*[(F.nullif(F.trim(F.col(f"`{there[c]}`")), F.lit("")) if c in there else F.lit(None).cast("string")).alias(c) for c in columns])


def _must(value: Column, good: Column, key: str, name: str, what: str) -> Column:
    """value, or an error that names the row."""
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.coalesce(F.col(key), F.lit("a row")), F.lit(f": {name} {what}"))))


def _number(name: str, key: str, needed: bool = False, least: float = -math.inf, most: float = math.inf) -> Column:
    value = F.col(name).try_cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < math.inf) & (value >= least) & (value <= most)
    return _must(value, good if needed else F.col(name).isNull() | F.coalesce(good, F.lit(False)), key, name, "is not a number that may be there").alias(name)


def _count(name: str, key: str, needed: bool = False, default: int | None = None) -> Column:
    value = F.col(name).try_cast("double")
    good = value.isNotNull() & (value >= 0) & (value == F.floor(value))
    whole = F.coalesce(value.cast("long"), F.lit(default).cast("long"))
    return _must(whole, good if needed else F.col(name).isNull() | F.coalesce(good, F.lit(False)), key, name, "must be a whole number of at least 0").alias(name)


def _id(name: str) -> Column:
    return _must(F.col(name), F.col(name).isNotNull(), name, name, "is missing").alias(name)


def _once(rows: DataFrame, key: str) -> DataFrame:
    twice = rows.groupBy(key).count().filter("count > 1").first()
    if twice is not None:
        raise InputError(f"{key} {twice[0]} is there twice")
    return rows


def read_persons_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Only traveller_id has to be there; flags and classes that are not are null."""
    df = spark.read.parquet(path)
    if "traveller_id" not in df.columns:
        raise InputError("no column traveller_id")
    rows = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in PERSON_COLUMNS.items()])
    return rows.withColumn("traveller_id", _id("traveller_id"))


def read_zone_points(spark: SparkSession, path: str) -> DataFrame:
    """(zone_id, lon, lat, weight_origin, weight_destination): where a zone's trips may start and end; `weight` stands for both, a missing one is 1."""
    first = _csv(spark, path)
    there = {c.strip().lower(): c for c in first.columns}
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{there[n]}`")), F.lit("")) for n in names if n in there], F.lit(None).cast("string"))
    raw = first.select(pick("zone_id", "zone", "id").alias("zone_id"), pick("x_coord", "lon", "longitude").alias("lon"), pick("y_coord", "lat", "latitude").alias("lat"), *[F.coalesce(pick(w), pick("weight"), F.lit("1")).alias(w) for w in ("weight_origin", "weight_destination")])
    return raw.select(_id("zone_id"), _number("lon", "zone_id", True), _number("lat", "zone_id", True), *[_number(w, "zone_id", True, 0.0) for w in ("weight_origin", "weight_destination")])


def read_parkings(spark: SparkSession, path: str) -> DataFrame:
    rows = _table(spark, path, PARKING_COLUMNS, 5)
    vehicle = F.lower("vehicle")
    k = "parking_id"
    return _once(rows.select(_id(k), _number("lon", k, True), _number("lat", k, True), _must(vehicle, F.coalesce(vehicle.isin("car", "bike"), F.lit(False)), k, "vehicle", "is neither car nor bike").alias("vehicle"), _count("capacity", k, True), "name", "hub_id", _count("initial_occupancy", k, default=0), _number("fee_eur", k, least=0.0)), k)


def read_dock_table(spark: SparkSession, path: str) -> DataFrame:
    k = "dock_id"
    rows = _table(spark, path, DOCK_COLUMNS, 4).select(_id(k), _number("lon", k, True), _number("lat", k, True), _count("capacity", k, True), "name", "hub_id", _count("bikes", k))
    return _once(rows.withColumn("bikes", _must(F.col("bikes"), F.col("bikes").isNull() | (F.col("bikes") <= F.col("capacity")), k, "bikes", "are more than slots")), k)


def read_gbfs(spark: SparkSession, information: str, status: str | None = None) -> DataFrame:
    """Docks of a bike-sharing feed, versions 2 and 3: stations without a capacity are left out; bikes are those there at the moment of `status`, no more than slots."""
    schema = "data struct<stations: array<struct<station_id: string, lon: double, lat: double, capacity: long, name: string>>>"
    whole = spark.read.text(information, wholetext=True).select(F.from_json("value", schema).alias("j"))
    if whole.filter("j.data.stations is not null").isEmpty():
        raise InputError(f"{information}: no data.stations list")
    rows = whole.select(F.explode("j.data.stations").alias("s")).select("s.*").filter("station_id is not null and capacity is not null")
    name = F.when(F.col("name").startswith("["), F.get_json_object("name", "$[0].text")).otherwise(F.col("name"))  # a list of texts by language
    rows = rows.select(F.col("station_id").alias("dock_id"), "lon", "lat", "capacity", F.nullif(F.trim(name), F.lit("")).alias("name"))
    if status is None:
        return _once(rows.withColumn("bikes", F.lit(None).cast("long")), "dock_id")
    now = spark.read.text(status, wholetext=True).select(F.from_json("value", "data struct<stations: array<struct<station_id: string, num_bikes_available: long, num_vehicles_available: long>>>").alias("j"))
    now = now.select(F.explode("j.data.stations").alias("s")).select(F.col("s.station_id").alias("dock_id"), F.coalesce("s.num_bikes_available", "s.num_vehicles_available").alias("now"))
    return _once(rows.join(now, "dock_id", "left").withColumn("bikes", F.when(F.col("now").isNotNull(), F.least("now", "capacity"))).drop("now"), "dock_id")


def read_vehicles(spark: SparkSession, path: str) -> DataFrame:
    k = "vehicle_id"
    return _once(_table(spark, path, VEHICLE_COLUMNS, 3).select(_id(k), _number("lon", k, True), _number("lat", k, True), _number("soc", k, least=0.0, most=1.0)), k)


def read_chargers(spark: SparkSession, path: str) -> DataFrame:
    k = "charger_id"
    return _once(_table(spark, path, CHARGER_COLUMNS, 4).select(_id(k), _number("lon", k, True), _number("lat", k, True), _count("plugs", k, True), "hub_id", _number("kw", k, least=0.0)), k)


def read_transfers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(from_stop, to_stop, min_s) of a feed's transfers of type 1 (no time) and 2 (its least time) that hold for all routes and trips, and how many rows were kept and skipped."""
    raw = _csv(spark, path)
    if lost := [c for c in ("from_stop_id", "to_stop_id", "transfer_type") if c not in raw.columns]:
        raise InputError(f"no columns {', '.join(lost)}")
    general = F.lit(True)
    for c in ("from_route_id", "to_route_id", "from_trip_id", "to_trip_id"):
        if c in raw.columns:
            general = general & F.coalesce(F.trim(c) == "", F.lit(True))
    least = F.col("min_transfer_time").try_cast("long") if "min_transfer_time" in raw.columns else F.lit(None).cast("long")
    rows = raw.withColumn("min_s", F.when(general & (F.col("transfer_type") == "1"), F.lit(0).cast("long")).when(general & (F.col("transfer_type") == "2"), least))
    report = rows.agg(F.count("min_s").alias("kept"), (F.count("*") - F.count("min_s")).alias("skipped"))
    return rows.filter("min_s is not null").select(F.col("from_stop_id").alias("from_stop"), F.col("to_stop_id").alias("to_stop"), "min_s"), report


def unpacked(feed: str, folder: str) -> str:
    """The folder of a feed: itself, or, of a zip file, `folder` with its tables. The folder must be one that executors share."""
    if not feed.endswith(".zip"):
        return feed
    with zipfile.ZipFile(feed) as z:
        for name in z.namelist():
            if name.endswith(".txt"):
                (Path(folder) / Path(name).name).write_bytes(z.read(name))
    return folder


def class_entries(classes: DataFrame) -> DataFrame:
    """Classes (class, share, modes array, owns_car, owns_bike, has_transit_pass) with what is not said: modes in their fixed order, a car for whoever may drive, a bike for whoever may ride, both if modes are not said, and no pass."""
    known = F.array(*[F.lit(m) for m in MODES])
    any_of = lambda *m: F.col("modes").isNull() | F.arrays_overlap("modes", F.array(*[F.lit(x) for x in m]))
    bad = F.filter("modes", lambda m: ~F.array_contains(known, m))
    modes = F.when(F.col("modes").isNull(), F.lit(None)).when(F.size(bad) > 0, F.raise_error(F.concat(F.col("class"), F.lit(": no such mode ")))).otherwise(F.filter(known, lambda m: F.array_contains("modes", m)))
    share = _must(F.col("share"), F.col("share").isNull() | (F.col("share") >= 0), "class", "share", "must be at least 0")
    return classes.select("class", share.alias("share"), modes.alias("modes"), F.coalesce("owns_car", any_of("car", "car_transit")).alias("owns_car"), F.coalesce("owns_bike", any_of("bike", "bike_transit")).alias("owns_bike"), F.coalesce("has_transit_pass", F.lit(False)).alias("has_transit_pass"))


def road_times(link_bins: DataFrame) -> DataFrame:
    """(link, bin, seconds): mean time of each link and bin that has traffic."""
    return link_bins.filter("pcu > 0 and pcu_seconds > 0").select("link", "bin", (F.col("pcu_seconds") / F.col("pcu")).alias("seconds"))


def read_options(path: str, known: Mapping[str, type]) -> dict[str, object]:
    """Options of a TOML file, groups joined by dots; an unknown name or another type is refused."""
    out: dict[str, object] = {}

    def walk(table: Mapping[str, object], before: str) -> None:
        for name, value in table.items():
            full = f"{before}{name}"
            if isinstance(value, Mapping):
                walk(value, f"{full}.")
            elif full not in known:
                raise InputError(f"no option {full}")
            elif not isinstance(value, known[full]) and not (known[full] is float and type(value) is int):
                raise InputError(f"{full} must be {known[full].__name__}")
            else:
                out[full] = value

    walk(tomllib.loads(Path(path).read_text()), "")
    return out


def write_trips(trips: DataFrame, path: str) -> None:
    """Trips as CSV files under one header, nulls blank."""
    trips.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_kpis_csv(kpis: DataFrame, path: str, run_id: str, design_id: str = "", replication: int = 0) -> None:
    """Key figures (iteration, mode, metric, value) as one small CSV file, with the run they are of."""
    rows = kpis.select(F.lit(run_id).alias("run_id"), F.lit(design_id).alias("design_id"), F.lit(replication).alias("replication"), "iteration", "mode", "metric", "value")
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)  # some hundreds of rows


def write_manifest(path: str, **facts: object) -> None:
    """What a run was: names, seeds, fingerprints and counts, as JSON with sorted keys."""
    Path(path).write_text(json.dumps(facts, indent=1, sort_keys=True, default=str) + "\n")


def write_timings(path: str, rows: Sequence[tuple[str, int | None, float]]) -> None:
    """(stage, iteration, seconds) as CSV; a stage outside the iterations has none."""
    Path(path).write_text("stage,iteration,seconds\n" + "".join(f"{s},{'' if i is None else i},{x:.6f}\n" for s, i, x in rows))


def timings_by_stage(rows: DataFrame) -> DataFrame:
    """Seconds of each stage over all iterations, and how often it ran."""
    return rows.groupBy("stage").agg(F.round(F.sum("seconds"), 6).alias("seconds"), F.count("*").alias("times"))
