"""Tables frozen together: Parquet under one header with a version, facts and a fingerprint of every table, which a reader checks before it hands them out.

A writer puts its tables in a folder of their own, reads them back for their fingerprints, and only then renames a header over the last one, in one step of the file system. So a writer that is lost half way leaves
the earlier tables in place, and a reader sees all of one freeze or all of another. Fingerprints do not depend on the order of rows or on files: rows, the sum and the exclusive or of a 64-bit hash of all columns.
Folders of earlier freezes stay until `forget_frozen` removes them, so that readers under way end well.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.sources.tables import InputError

# The format's name and version, and the columns of a frozen leg.
FORMAT, VERSION = "viatica-frozen", 1
LEG_COLUMNS = {"trip": "long", "traveller_id": "string", "trip_seq": "long", "service": "string", "weight": "long", "request_s": "double", "origin_node": "long", "destination_node": "long", "dock_from": "string", "dock_to": "string", "ride_s": "double", "egress_s": "double", "assumed_extra_walk_s": "double"}


def fingerprint(df: DataFrame) -> dict[str, str]:
    """What a table holds, whatever its order: one pass, combined where the rows are. Columns of maps have no hash and are refused by Spark."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0).cast("long")
    row = df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string").alias("xor")).first()
    return {"rows": str(row["rows"]), "sum": row["sum"], "xor": row["xor"]}


def _checked(header: Mapping) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in header.items() if k != "check"}, sort_keys=True).encode()).hexdigest()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file in place of the one there, if any, in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(draft), files.makeQualified(target), over)


def write_frozen(tables: Mapping[str, DataFrame], folder: str, kind: str, facts: Mapping[str, str] | None = None) -> dict:
    """Tables of one kind frozen in a folder, with facts that a reader can ask for (what they were made from, say); returns the header."""
    if not tables:
        raise InputError("nothing to freeze")
    spark = next(iter(tables.values())).sparkSession
    freeze = uuid.uuid4().hex
    about = {}
    for name, df in tables.items():
        path = f"{folder}/{freeze}/{name}.parquet"
        df.write.parquet(path)
        back = spark.read.schema(df.schema).parquet(path)
        about[name] = {"schema": df.schema.simpleString(), **fingerprint(back)}
    header = {"format": FORMAT, "version": VERSION, "kind": kind, "freeze": freeze, "facts": dict(facts or {}), "tables": about}
    header["check"] = _checked(header)
    _put(spark, f"{folder}/header.json", json.dumps(header, sort_keys=True))
    return header


def read_header(spark: SparkSession, folder: str, kind: str, facts: Mapping[str, str] | None = None) -> dict:
    """The header of what is frozen in a folder; InputError if there is none, if it is damaged, or if it is of another format, version, kind or facts than asked for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/header.json")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise InputError(f"{folder}: nothing is frozen here")
    text = spark.read.text(f"{folder}/header.json", wholetext=True).first()
    try:
        header = json.loads(text[0] if text else "")
    except ValueError as bad:
        raise InputError(f"{folder}: the header is damaged") from bad
    if not isinstance(header, dict) or header.get("check") != _checked(header):
        raise InputError(f"{folder}: the header is damaged")
    for key, want in (("format", FORMAT), ("version", VERSION), ("kind", kind)):
        if header.get(key) != want:
            raise InputError(f"{folder}: {key} is {header.get(key)!r}, not {want!r}")
    for key, want in (facts or {}).items():
        if header["facts"].get(key) != want:
            raise InputError(f"{folder}: made with {key} {header['facts'].get(key)!r}, not {want!r}")
    return header


def read_frozen(spark: SparkSession, folder: str, kind: str, facts: Mapping[str, str] | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables frozen in a folder, by name. With verify every table is read once for its fingerprint; without, only its header and schema count."""
    header = read_header(spark, folder, kind, facts)
    found = {}
    for name, about in header["tables"].items():
        df = spark.read.parquet(f"{folder}/{header['freeze']}/{name}.parquet")
        if df.schema.simpleString() != about["schema"]:
            raise InputError(f"{folder}: {name} has columns {df.schema.simpleString()}, not {about['schema']}")
        if verify and fingerprint(df) != {k: about[k] for k in ("rows", "sum", "xor")}:
            raise InputError(f"{folder}: {name} does not hold what was frozen")
        found[name] = df
    return found


def forget_frozen(spark: SparkSession, folder: str) -> None:
    """Removes folders of freezes other than the one the header names, and drafts of headers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    now = json.loads(spark.read.text(f"{folder}/header.json", wholetext=True).first()[0])["freeze"]
    for status in files.listStatus(path):
        name = status.getPath().getName()
        old = len(name) == 32 and name != now and all(c in "0123456789abcdef" for c in name)
        if old or name.startswith("header.json."):
            files.delete(status.getPath(), True)


def write_legs(legs: DataFrame, folder: str, facts: Mapping[str, str] | None = None) -> dict:
    """A day's legs of services, by trip; a leg with an empty cell is refused."""
    missing = [c for c in LEG_COLUMNS if c not in legs.columns]
    if missing:
        raise InputError(f"legs have no {', '.join(missing)}")
    rows = legs.select(*[F.col(c).cast(t).alias(c) for c, t in LEG_COLUMNS.items()])
    _refuse_empty(rows)
    return write_frozen({"legs": rows.repartitionByRange("trip").sortWithinPartitions("trip", "trip_seq")}, folder, "legs", facts)


def read_legs(spark: SparkSession, folder: str, facts: Mapping[str, str] | None = None) -> DataFrame:
    rows = read_frozen(spark, folder, "legs", facts)["legs"]
    _refuse_empty(rows)
    return rows


def _refuse_empty(rows: DataFrame) -> None:
    some = rows.filter(" or ".join(f"{c} is null" for c in LEG_COLUMNS)).select("trip").first()
    if some:
        raise InputError(f"a leg with an empty cell (trip {some['trip']})")
