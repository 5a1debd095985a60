"""PBF files that the test writes, read back in any number of partitions."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest

from viatica.sources import pbf


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zig(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def field(number: int, value: int | bytes) -> bytes:
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def packed(values, signed=False, delta=False) -> bytes:
    values = [b - a for a, b in zip([0, *values], values, strict=False)] if delta else values
    return b"".join(varint(zig(v) if signed else v) for v in values)


def blob(kind: str, data: bytes, squeezed: bool) -> bytes:
    inner = field(2, len(data)) + field(3, zlib.compress(data)) if squeezed else field(1, data)
    header = field(1, kind.encode()) + field(3, len(inner))
    return struct.pack(">I", len(header)) + header + inner


def written(elements, each: int, squeezed=True, dense=True, features=(b"OsmSchema-V0.6", b"DenseNodes")) -> bytes:
    out = blob("OSMHeader", b"".join(field(4, f) for f in features), squeezed)
    for at in range(0, len(elements), each):
        strings: dict[str, int] = {"": 0}
        number = lambda s: strings.setdefault(s, len(strings))  # noqa: B023, E731
        tags = lambda t: (packed([number(k) for k in t]), packed([number(v) for v in t.values()]))  # noqa: B023, E731
        groups, own = b"", elements[at : at + each]
        nodes = [e for e in own if e[0] == "node"]
        if nodes and dense:
            flat = [x for e in nodes for x in [*[y for k, v in e[4].items() for y in (number(k), number(v))], 0]]
            groups += field(2, field(2, field(1, packed([e[1] for e in nodes], True, True)) + field(8, packed([round(e[2] * 1e7) for e in nodes], True, True)) + field(9, packed([round(e[3] * 1e7) for e in nodes], True, True)) + field(10, packed(flat))))
        elif nodes:
            groups += field(2, b"".join(field(1, field(1, zig(e[1])) + field(2, tags(e[4])[0]) + field(3, tags(e[4])[1]) + field(8, zig(round(e[2] * 1e7))) + field(9, zig(round(e[3] * 1e7)))) for e in nodes))
        ways = b"".join(field(3, field(1, e[1]) + field(2, tags(e[4])[0]) + field(3, tags(e[4])[1]) + field(8, packed(e[5], True, True))) for e in own if e[0] == "way")
        rels = b"".join(field(4, field(1, e[1]) + field(2, tags(e[4])[0]) + field(3, tags(e[4])[1]) + field(8, packed([number(r) for _, _, r in e[6]])) + field(9, packed([m for _, m, _ in e[6]], True, True)) + field(10, packed([pbf.KINDS.index(t) for t, _, _ in e[6]]))) for e in own if e[0] == "relation")
        groups += (field(2, ways) if ways else b"") + (field(2, rels) if rels else b"")
        out += blob("OSMData", field(1, b"".join(field(1, s.encode()) for s in strings)) + groups, squeezed)
        if at == 0:
            out += blob("Something", b"else", squeezed)  # blobs of other kinds are passed over
    return out


@pytest.fixture(scope="module")
def elements():
    draw = random.Random(9)
    some = lambda: {f"k{draw.randrange(9)}": draw.choice(["", "yes", "naïve ü", "中"]) for _ in range(draw.randrange(4))}
    nodes = [("node", draw.choice([-1, 1]) * draw.randrange(1, 1 << 40), round(draw.uniform(-90, 90), 7), round(draw.uniform(-180, 180), 7), some(), None, None) for _ in range(400)]
    ways = [("way", n + 10**10, None, None, some(), [draw.choice(nodes)[1] for _ in range(draw.randrange(30))], None) for n in range(150)]
    rels = [("relation", n + 1, None, None, some(), None, [(draw.choice(pbf.KINDS), draw.randrange(1 << 35), draw.choice(["", "outer", "stop"])) for _ in range(draw.randrange(6))]) for n in range(40)]
    return [*nodes, *ways, *rels]


def shown(e):
    near = lambda x: None if x is None else round(x, 7)
    return (e[0], e[1], near(e[2]), near(e[3]), tuple(sorted(e[4].items())), None if e[5] is None else tuple(e[5]), None if e[6] is None else tuple(tuple(m) for m in e[6]))


def read(spark, path, **options):
    spark.dataSource.register(pbf.OsmPbf)
    reader = spark.read.format("osm_pbf")
    for k, v in options.items():
        reader = reader.option(k, v) if k != "schema" else reader.schema(v)
    return reader.load(str(path))


@pytest.mark.parametrize("each, squeezed, dense, size", [(37, True, True, 1), (37, True, True, 4000), (1000, False, False, 16 << 20), (90, True, False, 1)])
def test_round_trip(spark, tmp_path, elements, each, squeezed, dense, size):
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(written(elements, each, squeezed, dense))
    df = read(spark, path, blobBytes=size)
    assert sorted(map(shown, map(tuple, df.collect())), key=str) == sorted(map(shown, elements), key=str)
    parts = df.rdd.getNumPartitions()
    assert parts == (-(-len(elements) // each) if size == 1 else parts) and (size != 16 << 20 or parts == 1)
    uri = read(spark, path.as_uri(), schema="kind string, id long")
    assert uri.groupBy("kind").count().count() == 3 and uri.count() == len(elements)


def test_only_what_is_wanted(spark, tmp_path, elements, monkeypatch):
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(written(elements, 50))
    ways = read(spark, path, schema="id long, refs array<long>", kinds="way")
    assert {r.id: r.refs for r in ways.collect()} == {e[1]: e[5] for e in elements if e[0] == "way"}
    block = pbf.Block(memoryview(b""), {"id"}, {"way"})
    assert block.rows == {"id": []}
    reader = pbf.PushedReader(spark.createDataFrame([], "kind string, id long").schema, {"path": str(path)})
    rest = list(reader.pushFilters([pbf.EqualTo(("kind",), "way"), pbf.EqualTo(("id",), 3)]))
    assert reader.kinds == {"way"} and rest == [pbf.EqualTo(("id",), 3)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 150
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert read(spark, path, pushFilters="true").filter("kind = 'relation' and id > 20").count() == 20
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_what_is_refused(spark, tmp_path, elements):
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(written(elements[:5], 5, features=(b"OsmSchema-V0.6", b"HistoricalInformation")))
    with pytest.raises(Exception, match="HistoricalInformation"):
        read(spark, path).count()
    path.write_bytes(b"no map at all, but some text that is long enough to be read")
    with pytest.raises(Exception, match="not a PBF"):
        read(spark, path).count()
    with pytest.raises(Exception, match="no kind"):
        read(spark, path, kinds="lake").count()
    path.write_bytes(written([], 5))
    assert read(spark, path).count() == 0


def test_varints():
    draw = random.Random(2)
    values = [0, 1, 127, 128, (1 << 63) - 1, (1 << 64) - 1, *[draw.randrange(1 << draw.randint(1, 64)) for _ in range(500)]]
    assert pbf.varints(b"".join(map(varint, values))).tolist() == values
    signed = [0, -1, 1, -(1 << 62), (1 << 62), *[draw.randint(-(1 << 40), 1 << 40) for _ in range(100)]]
    assert pbf.zigzag(pbf.varints(packed(signed, True))).tolist() == signed and pbf.varints(b"").tolist() == []
    assert np.array_equal(np.cumsum(pbf.zigzag(pbf.varints(packed(signed[5:], True, True)))), signed[5:])
