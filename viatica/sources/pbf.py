"""OpenStreetMap PBF files as a Spark data source.

    spark.dataSource.register(OsmPbf)
    spark.read.format("osm_pbf").schema("id long, refs array<long>").option("kinds", "way").load("region.osm.pbf")

The file is a row of blobs, each a size, a header and a body. Planning reads the sizes and headers alone, hopping over the bodies, and deals the blobs to
partitions of about `blobBytes` each (16 MB), so a region or a planet is read by as many tasks as it has room for; a task reads its stretch of the file and
decodes a blob at a time. Varints of a packed field are decoded all at once; columns that the schema leaves out, and kinds that `kinds` or, with `pushFilters` true, a filter on
`kind` leaves out, are not decoded. Files are opened by URI (file, hdfs, s3) through Arrow's file systems, on the executors as well.

Columns: kind (node, way, relation), id, lat, lon, tags, refs (a way's nodes), members (type, ref, role).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "kind string, id long, lat double, lon double, tags map<string,string>, refs array<long>, members array<struct<type:string,ref:long,role:string>>"
KINDS = ("node", "way", "relation")
ARROW = {
    "kind": pa.string(),
    "id": pa.int64(),
    "lat": pa.float64(),
    "lon": pa.float64(),
    "tags": pa.map_(pa.string(), pa.string()),
    "refs": pa.list_(pa.int64()),
    "members": pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])),
}
# Field numbers of the format's messages.
BLOB_HEADER = {"type": 1, "size": 3}
BLOB = {"raw": 1, "raw_size": 2, "zlib": 3}
BLOCK = {"strings": 1, "groups": 2, "granularity": 17, "lat_offset": 19, "lon_offset": 20}
GROUP = {"nodes": 1, "dense": 2, "ways": 3, "relations": 4}
NODE = {"id": 1, "keys": 2, "values": 3, "lat": 8, "lon": 9}
DENSE = {"ids": 1, "lats": 8, "lons": 9, "keys_values": 10}
WAY = {"id": 1, "keys": 2, "values": 3, "refs": 8}
RELATION = {"id": 1, "keys": 2, "values": 3, "roles": 8, "refs": 9, "types": 10}
FEATURES = {b"OsmSchema-V0.6", b"DenseNodes"}


def varints(data: bytes | memoryview) -> np.ndarray:
    """All varints of a packed field, as unsigned 64-bit numbers."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for i in range(int(sizes.max())):
        own = np.flatnonzero(sizes > i)
        out[own] |= (raw[starts[own] + i] & 127).astype(np.uint64) << np.uint64(7 * i)
    return out


def zigzag(x: np.ndarray) -> np.ndarray:
    """Signed numbers of zigzag ones."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields: a number for varints, the bytes for what has a length."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < n:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"a field of wire type {kind}")


def body(blob: bytes) -> memoryview:
    """A blob's contents."""
    for number, value in fields(memoryview(blob)):
        if number == BLOB["raw"]:
            return memoryview(bytes(value))
        if number == BLOB["zlib"]:
            return memoryview(zlib.decompress(value))
        if number not in (BLOB["raw_size"],):
            raise ValueError("a blob that is neither raw nor zlib")
    raise ValueError("an empty blob")


def blobs(file, size: int) -> Iterator[tuple[str, int, int]]:
    """(type, offset of the body, bytes of the body) of a file's blobs, reading headers alone."""
    at = 0
    while at < size:
        file.seek(at)
        (n,) = struct.unpack(">I", file.read(4))
        if n > 65_536:
            raise ValueError("not a PBF file: a header of more than 64 kB")
        header = dict(fields(memoryview(file.read(n))))
        length = header[BLOB_HEADER["size"]]
        if length > 32 << 20:
            raise ValueError("not a PBF file: a blob of more than 32 MB")
        yield bytes(header[BLOB_HEADER["type"]]).decode(), at + 4 + n, length
        at += 4 + n + length


def open_uri(path: str):
    """(file system, path) of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Block:
    """A block of primitives, decoded as far as columns and kinds are wanted."""

    def __init__(self, data: memoryview, columns: set[str], kinds: set[str]):
        self.columns, self.kinds = columns, kinds
        self.granularity, self.lat_offset, self.lon_offset = 100, 0, 0
        self.strings: list[str] = []
        self.rows: dict[str, list] = {c: [] for c in columns}
        groups = []
        for number, value in fields(data):
            if number == BLOCK["strings"]:
                self.strings = [bytes(s).decode("utf-8", "replace") for _, s in fields(value)]
            elif number == BLOCK["groups"]:
                groups.append(value)
            elif number == BLOCK["granularity"]:
                self.granularity = value
            elif number == BLOCK["lat_offset"]:
                self.lat_offset = _signed(value)
            elif number == BLOCK["lon_offset"]:
                self.lon_offset = _signed(value)
        for group in groups:
            for number, value in fields(group):
                if number == GROUP["dense"] and "node" in kinds:
                    self._dense(dict(fields(value)))
                elif number == GROUP["nodes"] and "node" in kinds:
                    self._one("node", value, NODE)
                elif number == GROUP["ways"] and "way" in kinds:
                    self._one("way", value, WAY)
                elif number == GROUP["relations"] and "relation" in kinds:
                    self._one("relation", value, RELATION)

    def _put(self, n: int, **given) -> None:
        for c in self.columns:
            self.rows[c] += given.get(c, [None] * n)

    def _degrees(self, x: np.ndarray, offset: int) -> list[float]:
        return ((offset + self.granularity * x) * 1e-9).tolist()

    def _dense(self, own: dict) -> None:
        ids = np.cumsum(zigzag(varints(own.get(DENSE["ids"], b""))))
        n, out = len(ids), {"kind": ["node"] * len(ids), "id": ids.tolist()}
        for c, field, offset in (("lat", "lats", self.lat_offset), ("lon", "lons", self.lon_offset)):
            if c in self.columns:
                out[c] = self._degrees(np.cumsum(zigzag(varints(own.get(DENSE[field], b"")))), offset)
        if "tags" in self.columns:
            flat = varints(own.get(DENSE["keys_values"], b"")).astype(np.int64)
            out["tags"] = [[] for _ in range(n)]
            node = at = 0
            for stop in np.flatnonzero(flat == 0).tolist():  # a zero where a key would be ends a node's tags
                if (stop - at) % 2 == 0:
                    out["tags"][node] = [(self.strings[k], self.strings[v]) for k, v in zip(flat[at:stop:2].tolist(), flat[at + 1 : stop : 2].tolist(), strict=True)]
                    node, at = node + 1, stop + 1
        self._put(n, **out)

    def _one(self, kind: str, data: memoryview, numbers: dict[str, int]) -> None:
        own: dict = dict(fields(data))
        ident = own.get(numbers["id"], 0)
        out: dict = {"kind": [kind], "id": [_unzigzag(ident) if kind == "node" else _signed(ident)]}
        if "tags" in self.columns:
            keys, values = (varints(own.get(numbers[c], b"")).astype(np.int64).tolist() for c in ("keys", "values"))
            out["tags"] = [[(self.strings[k], self.strings[v]) for k, v in zip(keys, values, strict=True)]]
        if kind == "node":
            for c, offset in (("lat", self.lat_offset), ("lon", self.lon_offset)):
                if c in self.columns:
                    out[c] = self._degrees(np.array([_unzigzag(own.get(numbers[c], 0))]), offset)
        if kind == "way" and "refs" in self.columns:
            out["refs"] = [np.cumsum(zigzag(varints(own.get(numbers["refs"], b"")))).tolist()]
        if kind == "relation" and "members" in self.columns:
            refs = np.cumsum(zigzag(varints(own.get(numbers["refs"], b"")))).tolist()
            roles, types = (varints(own.get(numbers[c], b"")).astype(np.int64).tolist() for c in ("roles", "types"))
            out["members"] = [[{"type": KINDS[t], "ref": r, "role": self.strings[s]} for t, r, s in zip(types, refs, roles, strict=True)]]
        self._put(1, **out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _unzigzag(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


class Stretch(InputPartition):
    def __init__(self, path: str, parts: list[tuple[int, int]]):
        self.path, self.parts = path, parts


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        unknown = set(self.columns) - set(ARROW)
        if unknown:
            raise ValueError(f"a PBF file has no column {', '.join(sorted(unknown))}")
        if "path" not in options:
            raise ValueError("no path")
        self.path, self.most = options["path"], int(options.get("blobbytes", options.get("blobBytes", 16 << 20)))
        self.kinds = {k.strip() for k in options.get("kinds", ",".join(KINDS)).split(",")}
        if self.kinds - set(KINDS):
            raise ValueError(f"no kind {', '.join(sorted(self.kinds - set(KINDS)))}")

    def partitions(self) -> list[InputPartition]:
        system, path = open_uri(self.path)
        out: list[InputPartition] = []
        held, size = [], 0
        with system.open_input_file(path) as file:
            for kind, at, n in blobs(file, file.size()):
                if kind == "OSMHeader":
                    file.seek(at)
                    needed = {bytes(v) for k, v in fields(body(file.read(n))) if k == 4}
                    if needed - FEATURES:
                        raise ValueError(f"the file needs {', '.join(sorted(x.decode() for x in needed - FEATURES))}")
                elif kind == "OSMData":
                    if held and size + n > self.most:
                        out.append(Stretch(self.path, held))
                        held, size = [], 0
                    held.append((at, n))
                    size += n
        return [*out, Stretch(self.path, held)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, path = open_uri(partition.path)
        kind = pa.schema([(c, ARROW[c]) for c in self.columns])
        with system.open_input_file(path) as file:
            for at, n in partition.parts if self.kinds else []:
                file.seek(at)
                block = Block(body(file.read(n)), {*self.columns, "id"}, self.kinds)
                if len(block.rows["id"]):
                    yield pa.RecordBatch.from_arrays([pa.array(block.rows[c], ARROW[c]) for c in self.columns], schema=kind)


class PushedReader(Reader):
    """A reader that takes filters on `kind`; Spark asks it only where spark.sql.python.filterPushdown.enabled is set, and refuses it elsewhere."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds &= {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds &= set(f.value)
            else:
                yield f


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return (PushedReader if self.options.get("pushfilters", self.options.get("pushFilters", "false")) == "true" else Reader)(schema, self.options)
