"""Frozen tables: bits, damage, versions, facts and writers that are lost."""

from __future__ import annotations

import json
import struct
from pathlib import Path

import pytest

from viatica.sources import frozen
from viatica.sources.tables import InputError

LEGS = [(3 * k, f"t{k}", k % 2, "bike_share", k + 1, 28_800.0 + k / 3, k, 99 - k, "a", f"d{k}", 0.1 + k * 1e-9, k**0.5, -0.0) for k in range(7)]


def bits(row):
    return tuple(struct.pack("<d", v) if isinstance(v, float) else v for v in row)


def legs_of(spark, rows=LEGS):
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in frozen.LEG_COLUMNS.items()))


def test_legs_read_back_bit_for_bit(spark, tmp_path):
    folder = str(tmp_path / "day")
    frozen.write_legs(legs_of(spark), folder, {"run": "7"})
    assert sorted(map(bits, frozen.read_legs(spark, folder, {"run": "7"}).collect())) == sorted(map(bits, LEGS))
    with pytest.raises(InputError, match="made with run '7'"):
        frozen.read_legs(spark, folder, {"run": "8"})
    with pytest.raises(InputError, match="empty cell"):
        frozen.write_legs(legs_of(spark, [*LEGS[:2], (None, *LEGS[2][1:])]), str(tmp_path / "no"))
    with pytest.raises(InputError, match="have no dock_to"):
        frozen.write_legs(legs_of(spark).drop("dock_to"), str(tmp_path / "no"))
    frozen.write_legs(legs_of(spark, []), str(tmp_path / "none"))
    assert frozen.read_legs(spark, str(tmp_path / "none")).count() == 0


def test_damage_is_refused(spark, tmp_path):
    folder = tmp_path / "net"
    tables = {"nodes": spark.range(50).selectExpr("id as node", "id * 2 as x"), "links": spark.range(90).selectExpr("id as link", "array(id, id + 1) as ends")}
    header = frozen.write_frozen(tables, str(folder), "network")
    assert {k: v.count() for k, v in frozen.read_frozen(spark, str(folder), "network").items()} == {"nodes": 50, "links": 90}
    whole = (folder / "header.json").read_text()

    def refused(text, match):
        (folder / "header.json").write_text(text)
        Path(folder / ".header.json.crc").unlink(missing_ok=True)
        with pytest.raises(InputError, match=match):
            frozen.read_frozen(spark, str(folder), "network")

    refused(whole[: len(whole) // 2], "damaged")
    refused("", "damaged")
    refused("[1]", "damaged")
    refused(whole.replace('"rows": "50"', '"rows": "51"'), "damaged")
    newer = {**json.loads(whole), "version": 2}
    refused(json.dumps({**newer, "check": frozen._checked(newer)}), "version is 2")
    other = {**json.loads(whole), "kind": "legs"}
    refused(json.dumps({**other, "check": frozen._checked(other)}), "kind is 'legs'")
    (folder / "header.json").write_text(whole)
    Path(folder / ".header.json.crc").unlink(missing_ok=True)
    spark.range(50).selectExpr("id as node", "id * 3 as x").write.mode("overwrite").parquet(f"{folder}/{header['freeze']}/nodes.parquet")
    with pytest.raises(InputError, match="nodes does not hold"):
        frozen.read_frozen(spark, str(folder), "network")
    assert set(frozen.read_frozen(spark, str(folder), "network", verify=False)) == {"nodes", "links"}
    with pytest.raises(InputError, match="nothing is frozen"):
        frozen.read_frozen(spark, str(tmp_path / "empty"), "network")


def test_a_lost_writer_leaves_what_was_there(spark, tmp_path):
    folder = tmp_path / "net"
    frozen.write_frozen({"nodes": spark.range(5)}, str(folder), "network")
    broken = spark.range(5).selectExpr("if(id = 3, raise_error('lost'), id) as id")
    with pytest.raises(Exception, match="lost"):
        frozen.write_frozen({"nodes": spark.range(9), "links": broken}, str(folder), "network")
    assert frozen.read_frozen(spark, str(folder), "network")["nodes"].count() == 5
    frozen.write_frozen({"nodes": spark.range(6)}, str(folder), "network")
    assert len([p for p in folder.iterdir() if p.is_dir()]) == 3
    frozen.forget_frozen(spark, str(folder))
    assert frozen.read_frozen(spark, str(folder), "network")["nodes"].count() == 6 and len([p for p in folder.iterdir() if p.is_dir()]) == 1


def test_fingerprints_do_not_depend_on_order(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id as string) as s", "if(id % 3 = 0, null, id / 7) as d")
    assert frozen.fingerprint(rows) == frozen.fingerprint(rows.orderBy("s").repartition(5)) != frozen.fingerprint(rows.filter("id <> 500"))
