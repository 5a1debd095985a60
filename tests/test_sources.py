from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from viatica.sources import places, tables
from viatica.streaming import bins


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_trips_csv_and_parquet(spark, tmp_path):
    head = ",".join(tables.TRIP_COLUMNS)
    path = put(tmp_path, "t.csv", head + "\nа1,0,4.1,52.0,4.2,52.1,28800,c0,,car\n7,1,4,52,4,52,30000,c1,2,\n")
    got = tables.read_trips(spark, path)
    assert [(r.traveller_id, r.trip_seq, r.weight, r.mode) for r in got.collect()] == [("а1", 0, None, "car"), ("7", 1, 2, None)]
    got.write.parquet(str(tmp_path / "t.parquet"))
    assert tables.read_trips_parquet(spark, str(tmp_path / "t.parquet")).count() == 2
    got.withColumn("user_class", F.lit(None).cast("string")).write.parquet(str(tmp_path / "bad.parquet"))
    with pytest.raises(Exception, match="null in user_class"):
        tables.read_trips_parquet(spark, str(tmp_path / "bad.parquet")).collect()
    with pytest.raises(tables.InputError):
        tables.read_trips(spark, put(tmp_path, "x.csv", "traveller_id\n1\n"))


def test_zones_od_classes(spark, tmp_path):
    zones = tables.read_zones(spark, put(tmp_path, "z.csv", "ID,Lon,Lat\na,4.5,52\nb,4.6,52\n"))
    assert [tuple(r) for r in zones.orderBy("zone_id").collect()] == [("a", 4.5, 52.0), ("b", 4.6, 52.0)]
    with pytest.raises(tables.InputError, match="twice"):
        tables.read_zones(spark, put(tmp_path, "z2.csv", "zone,x,y\na,1,2\na,1,2\n"))
    assert tables.read_od(spark, put(tmp_path, "od.csv", "origin,destination,volume\na,b,1.5\n")).first().trips == 1.5
    classes, betas = tables.read_classes(spark, put(tmp_path, "c.csv", "class,share,modes,beta_time\nx,0.5,car; walk,-0.2\ny,0.5,bike,\n"))
    assert classes.orderBy("class").first().modes == ["car", "walk"] and [tuple(r) for r in betas.collect()] == [("x", "time", -0.2)]
    with pytest.raises(tables.InputError, match="unknown"):
        tables.read_classes(spark, put(tmp_path, "c2.csv", "class,share,modes,colour\nx,1,car,red\n"))


def test_networks(spark, tmp_path):
    links = tables.read_links(spark, put(tmp_path, "l.csv", "link_id,From_node,to_node,length,lanes,free_flow_speed,cap,note,signal\n1,a,b,0.5,2,30,900,x,yes\n"), "km", "mph").first()
    assert links.length == 500 and links.free_flow_speed == pytest.approx(48.28032) and links.capacity == 900 and links.signalised and not links.roundabout
    timed = tables.read_links(spark, put(tmp_path, "l2.csv", "init_node,term_node,length_m,fftt,speed\na,b,1000,2,0\n")).first()
    assert timed.free_flow_speed == pytest.approx(30.0) and timed.id == "a-b"
    tntp = put(tmp_path, "n.tntp", "<NUMBER OF NODES> 2\n<END OF METADATA>\n~ init term\n\t1\t2\t25900.2\t6\t6\t0.15\t4\t0\t0\t1\t;\n")
    row = tables.tntp_links(spark, tntp).first()
    assert (row["from"], row["to"], row.capacity, row.power) == ("1", "2", 25900.2, 4.0)
    (tmp_path / "g").mkdir()
    put(tmp_path / "g", "link.csv", "link_id,from_node_id,to_node_id,directed,length,lanes,capacity\n1,a,b,false,100,2,900\n2,b,c,true,50,1,800\n")
    got = {r.id: (r["from"], r["to"], r.capacity) for r in tables.gmns_links(spark, str(tmp_path / "g")).collect()}
    assert got == {"1": ("a", "b", 1800.0), "1_r": ("b", "a", 1800.0), "2": ("b", "c", 800.0)}
    (tmp_path / "m").mkdir()
    put(tmp_path / "m", "config.csv", "dataset_name,long_length,speed,crs\nx,miles,mph,EPSG:4326\n")
    put(tmp_path / "m", "link.csv", "link_id,from_node_id,to_node_id,directed,length,free_speed\n1,a,b,No,2,30\n")
    got = {r.id: (r.length, r.free_flow_speed) for r in tables.gmns_links(spark, str(tmp_path / "m")).collect()}
    assert got == {"1": (3218.688, pytest.approx(48.28032)), "1_r": (3218.688, pytest.approx(48.28032))}
    put(tmp_path / "m", "config.csv", "long_length\nfurlong\n")
    with pytest.raises(tables.InputError, match="furlong"):
        tables.gmns_units(spark, str(tmp_path / "m"))


def test_gtfs_and_docks(spark, tmp_path):
    put(tmp_path, "stops.txt", "stop_id,stop_lat,stop_lon,location_type\ns1,52,4,0\ns2,52,4.1,\nst,52,4,1\n")
    put(tmp_path, "routes.txt", "route_id,route_type\nr,700\n")
    put(tmp_path, "trips.txt", "trip_id,route_id,service_id\nt,r,w\n")
    put(tmp_path, "stop_times.txt", "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,25:00:00,25:00:30,s1,1\nt,,,s2,2\nt,26:00:00,26:00:00,st,3\n")
    feed = tables.read_gtfs(spark, str(tmp_path))
    assert feed["routes"].first().kind == "bus" and feed["stops"].count() == 2
    assert [(r.seq, r.arrive_s) for r in feed["stop_times"].orderBy("seq").collect()] == [(1, 90000), (2, None)]
    docks = tables.read_docks(spark, put(tmp_path, "g.json", '{"data": {"stations": [{"station_id": "d", "lon": 1, "lat": 2, "capacity": 9}]}}'))
    assert tuple(docks.first()) == ("d", 1.0, 2.0, 9)


def test_osm_tags(spark):
    rows = [{"highway": "primary", "maxspeed": "30 mph"}, {"highway": "motorway"}, {"highway": "footway"}, {"highway": "service", "access": "private", "oneway": "-1", "maxspeed": "walk"}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, tags map<string,string>").orderBy("i")
    got = df.select(tables.road_class(F.col("tags")), tables.direction(F.col("tags")), tables.max_speed(F.col("tags"))).collect()
    assert [tuple(r) for r in got] == [("primary", "both", 48.28032), ("motorway", "forward", None), (None, "both", None), (None, "backward", None)]
    durations = spark.createDataFrame([("01:30",), ("0:20:30",), ("PT1H5M",), ("soon",)], "t string")
    assert [r[0] for r in durations.select(tables.ferry_seconds(F.col("t"))).collect()] == [5400.0, 1230.0, 3900.0, None]


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3), (2, 2, 4)], "bin long, link long, pcu long")
    tables.write_results({"link_bins": rows}, str(tmp_path))
    back = tables.open_results(spark, str(tmp_path), ["link_bins"])["link_bins"]
    assert sorted((r.bin, r.link, r.pcu) for r in back.collect()) == [(1, 2, 3), (2, 2, 4)] and spark.table("link_bins").count() == 2


def test_live_bins(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 10, 0), (1, 1, 20, 600), (1, 1, 5, 1000)], "link long, pcu long, seconds long, s long").select("link", "pcu", "seconds", F.timestamp_seconds("s").alias("exit_at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = bins.live_link_bins(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.crossings, r.pcu, r.pcu_seconds) for r in spark.table("live").collect())
    assert got == [(1, 1, 5), (2, 3, 40)]


def test_persons_and_zone_points(spark, tmp_path):
    spark.createDataFrame([(7, True), (8, None)], "traveller_id long, owns_car boolean").write.parquet(str(tmp_path / "p.parquet"))
    assert [tuple(r) for r in places.read_persons_parquet(spark, str(tmp_path / "p.parquet")).orderBy("traveller_id").collect()] == [("7", True, None, None, None), ("8", None, None, None, None)]
    got = places.read_zone_points(spark, put(tmp_path, "zp.csv", "zone,lon,lat,weight,weight_origin\na,4,52,2,\na,4.1,52,,3\n"))
    assert [tuple(r) for r in got.orderBy("lon").collect()] == [("a", 4.0, 52.0, 2.0, 2.0), ("a", 4.1, 52.0, 3.0, 1.0)]
    with pytest.raises(Exception, match="weight_origin"):
        places.read_zone_points(spark, put(tmp_path, "zq.csv", "zone,lon,lat,weight\na,4,52,-1\n")).collect()


def test_places(spark, tmp_path):
    got = places.read_parkings(spark, put(tmp_path, "pk.csv", "Parking_ID,lon,lat,vehicle,capacity,fee_eur\np1,4,52,CAR,10,1.5\np2,4,52,bike,0,\n")).orderBy("parking_id").collect()
    assert [(r.parking_id, r.vehicle, r.capacity, r.initial_occupancy, r.fee_eur, r.hub_id) for r in got] == [("p1", "car", 10, 0, 1.5, None), ("p2", "bike", 0, 0, None, None)]
    for bad, what in (("p1,4,52,bus,1\n", "vehicle"), ("p1,4,52,car,1.5\n", "capacity"), ("p1,,52,car,1\n", "lon"), (",4,52,car,1\n", "parking_id")):
        with pytest.raises(Exception, match=what):
            places.read_parkings(spark, put(tmp_path, "bad.csv", "parking_id,lon,lat,vehicle,capacity\n" + bad)).collect()
    with pytest.raises(tables.InputError, match="twice"):
        places.read_dock_table(spark, put(tmp_path, "d.tsv", "dock_id\tlon\tlat\tcapacity\nd\t4\t52\t3\nd\t4\t52\t3\n"))
    with pytest.raises(tables.InputError, match="no columns plugs"):
        places.read_chargers(spark, put(tmp_path, "c.csv", "charger_id,lon,lat\nc,4,52\n"))
    with pytest.raises(Exception, match="more than slots"):
        places.read_dock_table(spark, put(tmp_path, "d2.csv", "dock_id,lon,lat,capacity,bikes\nd,4,52,3,4\n")).collect()
    assert places.read_vehicles(spark, put(tmp_path, "v.csv", "vehicle_id,lon,lat,soc\nv,4,52,0.5\nw,4,52,\n")).orderBy("vehicle_id").first().soc == 0.5
    assert places.read_chargers(spark, put(tmp_path, "c2.csv", "charger_id,lon,lat,plugs,kw\nc,4,52,2,22\n")).first().kw == 22


def test_gbfs(spark, tmp_path):
    info = put(tmp_path, "i.json", '{"data": {"stations": [{"station_id": "a", "lon": 4, "lat": 52, "capacity": 5, "name": "A "}, {"station_id": "b", "lon": 4, "lat": 52, "capacity": 3, "name": [{"text": "B", "language": "en"}]}, {"station_id": "c", "lon": 4, "lat": 52}]}}')
    status = put(tmp_path, "s.json", '{"data": {"stations": [{"station_id": "a", "num_bikes_available": 2}, {"station_id": "b", "num_vehicles_available": 9}]}}')
    assert [(r.dock_id, r.capacity, r.name, r.bikes) for r in places.read_gbfs(spark, info, status).orderBy("dock_id").collect()] == [("a", 5, "A", 2), ("b", 3, "B", 3)]
    assert [r.bikes for r in places.read_gbfs(spark, info).collect()] == [None, None]
    with pytest.raises(tables.InputError, match="stations"):
        places.read_gbfs(spark, put(tmp_path, "x.json", "{}"))


def test_transfers_feeds_options_and_classes(spark, tmp_path):
    rows, report = places.read_transfers(spark, put(tmp_path, "transfers.txt", "from_stop_id,to_stop_id,transfer_type,min_transfer_time,from_route_id\na,b,2,90,\nb,a,1,,\na,c,0,,\na,d,2,60,r1\na,e,2,,\n"))
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "b", 90), ("b", "a", 0)] and tuple(report.first()) == (2, 3)
    import zipfile

    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("feed/stops.txt", "stop_id,stop_lat,stop_lon\ns,52,4\n")
    (tmp_path / "out").mkdir()
    assert tables._csv(spark, places.unpacked(str(tmp_path / "f.zip"), str(tmp_path / "out")) + "/stops.txt").count() == 1
    options = put(tmp_path, "o.toml", "[msa]\niterations = 5\n[loading]\nbin_s = 900\n")
    assert places.read_options(options, {"msa.iterations": int, "loading.bin_s": float}) == {"msa.iterations": 5, "loading.bin_s": 900}
    with pytest.raises(tables.InputError, match="loading.bin_s"):
        places.read_options(options, {"msa.iterations": int})
    classes = spark.createDataFrame([("a", 0.5, ["walk", "car"], None, None, None), ("b", None, None, None, False, None), ("c", 0.2, ["bike_transit"], None, None, True)], "class string, share double, modes array<string>, owns_car boolean, owns_bike boolean, has_transit_pass boolean")
    assert [tuple(r)[2:] for r in places.class_entries(classes).orderBy("class").collect()] == [(["car", "walk"], True, False, False), (None, True, False, False), (["bike_transit"], False, True, True)]
    with pytest.raises(Exception, match="no such mode"):
        places.class_entries(classes.withColumn("modes", F.array(F.lit("boat")))).collect()


def test_small_results(spark, tmp_path):
    kpis = spark.createDataFrame([(0, "all", "completed", 3.5), (0, "a,b", "mean", 0.1)], "iteration long, mode string, metric string, value double")
    places.write_kpis_csv(kpis, str(tmp_path / "k"), "r1")
    assert sorted(r.value for r in spark.read.csv(str(tmp_path / "k"), header=True, inferSchema=True).collect()) == [0.1, 3.5]
    places.write_manifest(str(tmp_path / "m.json"), seed=3, names=["a"])
    assert (tmp_path / "m.json").read_text() == '{\n "names": [\n  "a"\n ],\n "seed": 3\n}\n'
    places.write_timings(str(tmp_path / "t.csv"), [("read", None, 1.5), ("load", 0, 2.0), ("load", 1, 1.0)])
    got = places.timings_by_stage(spark.read.csv(str(tmp_path / "t.csv"), header=True, inferSchema=True))
    assert {r.stage: (r.seconds, r.times) for r in got.collect()} == {"read": (1.5, 1), "load": (3.0, 2)}
    bins_ = spark.createDataFrame([(1, 0, 2.0, 30.0), (1, 1, 0.0, 0.0)], "link long, bin long, pcu double, pcu_seconds double")
    assert [tuple(r) for r in places.road_times(bins_).collect()] == [(1, 0, 15.0)]
    trips = spark.createDataFrame([("a", 0, None), ("b", 1, "car")], "traveller_id string, trip_seq long, mode string")
    places.write_trips(trips, str(tmp_path / "trips"))
    assert sorted((r.traveller_id, r.mode) for r in spark.read.csv(str(tmp_path / "trips"), header=True).collect()) == [("a", None), ("b", "car")]
