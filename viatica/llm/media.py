"""Interleaved document sequences: ordered text and media references out of HTML, resolved by digest joins.

A page is parsed into an ordered array of structs: text blocks, and media references with their digest and caption
(the figure's caption, else the alternative text). References are exploded with their position and joined to a media
store by digest, so pages that show one payload share what is known of it; positions and captions stay with the reference,
and `assemble` puts a page's items together again in order.

A stored payload is a grey PNG of 8-bit samples, 64 a row: lossless, read by any image library. Features are computed
from the bytes read back from the store, not from what was to be written.

Edge cases: null and empty HTML have no items; unclosed tags are closed at the page's end; script and style are not text;
a reference without a digest, or to a digest that the store lacks, stays with null columns; repeated rows give repeated
items; equal payloads in the store count once (those of one batch are also stored once); an empty table gives no rows; other columns are carried along by
`parse` and `resolve`, but for own ones by the name items, which give way, and own ones by the name of an item's field or of a column of the store, which
come out of `resolve` with page_ in front.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.llm.base import binaries, cut, others, packed, slices, table, task

FIELDS = ("kind", "text", "digest", "caption")
ITEM = "array<struct<" + ", ".join(f"{x}: string" for x in FIELDS) + ">>"
ROW = 64
PNG = b"\x89PNG\r\n\x1a\n"
PREFIX = "sha256:"
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "section", "article", "header", "footer", "nav", "blockquote", "pre", "figure", "body", "title"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.hidden = 0

    def _break(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def _end_caption(self) -> None:
        if self.caption is not None and self.figure is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[self.figure :]:
                if item["kind"] == "media" and text:
                    item["caption"] = text
        self.caption = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS or tag in MEDIA:
            self._break()
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "figure":
            self.figure = len(self.items)
        if tag == "figcaption":
            self._break()
            self.caption = []
        if tag in MEDIA:
            own = dict(attrs)
            src = own.get("src") or ""
            self.items.append({"kind": "media", "text": None, "digest": src[len(PREFIX) :].lower() if src.startswith(PREFIX) else None, "caption": own.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption":
            self._end_caption()
        if tag == "figure":
            self._end_caption()
            self.figure = None
        if tag in BREAKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def items(html: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser._end_caption()
    parser._break()
    return parser.items


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the column items (in place of html): what a page shows, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.string()) for x in FIELDS]))
        for batch in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array([items(x) for x in batch.column("html").to_pylist()], kind)], names=["d", "items"])

    rows = pages.select(others(pages, html).alias("d"), F.col(html).alias("html"))
    made = rows.mapInArrow(task(run), f"d {rows.schema['d'].dataType.simpleString()}, items {ITEM}")
    return made.select(*[F.col(f"d.`{c}`").alias(c) for c in pages.columns if c.lower() not in (html.lower(), "items")], "items")


def resolve(parsed: DataFrame, store: DataFrame) -> DataFrame:
    """One row per item: parsed's other columns, position, kind, text, digest, caption and the store's columns for its digest.

    store has one row per digest. Join it before its payload is needed only if that fits: with `features` of a store
    in its place, no payload is moved.
    """
    taken = {"position", *FIELDS, *(c.lower() for c in store.columns)}
    own = [c for c in parsed.columns if c != "items"]
    held = packed([F.col(f"`{c}`") for c in own], [f"page_{c}" if c.lower() in taken else c for c in own])
    rows = parsed.select(held.alias("d"), F.posexplode("items").alias("position", "item")).select("d", "position", "item.*")
    found = rows.join(store, "digest", "left")
    return found.select(*[F.col(f"d.`{c}`").alias(c) for c in found.schema["d"].dataType.names[1:]], *[c for c in found.columns if c != "d"])


def assemble(resolved: DataFrame, key: str) -> DataFrame:
    """(key, items): each page's resolved items in order again."""
    rest = [c for c in resolved.columns if c not in (key, "position")]
    return resolved.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", F.struct(*rest).alias("item")))).alias("items"))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of a grey 8-bit PNG whose lines are not filtered."""
    if stored[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(stored):
        size, name = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(name + body):
            raise ValueError("damaged PNG")
        if name == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif name == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def padded(data: Column) -> Column:
    """Bytes with 0 appended up to a positive multiple of 64."""
    size = F.greatest(F.octet_length(data), F.lit(1))
    return F.rpad(data, (F.ceil(size / ROW) * ROW).cast("int"), F.lit(b"\0"))


def media_store(payloads: DataFrame) -> DataFrame:
    """(digest, stored) of payloads (digest, payload), written to the shared folder. Equal payloads of one batch are stored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            own = dict(zip(batch.column("digest").to_pylist(), binaries(batch.column("payload")), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([to_png(x) for x in own.values()], pa.binary())], names=["digest", "stored"])

    return cut(payloads.select("digest", "payload").mapInArrow(task(run), "digest string, stored binary"))


def feature(payload: bytes) -> str:
    """Rows of the picture, mean sample, and entropy of its samples in bits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    return f"{len(payload) // ROW}x{ROW} mean={float(counts @ np.arange(256)) / len(payload):.4f} entropy={max(0.0, float(-(share * np.log2(share)).sum())):.4f}"


def features(store: DataFrame) -> DataFrame:
    """One row per digest of a store, from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "stored"):
            stored = binaries(batch.column("stored"))
            back = [from_png(x) for x in stored]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("digest"),
                    pa.array([len(x) for x in back], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([zlib.crc32(x[-64:]) for x in back], pa.int64()),
                    pa.array([len(x) for x in stored], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in stored]),
                    pa.array([feature(x) for x in back]),
                ],
                names=["digest", *FEATURES],
            )

    kinds = dict(zip(FEATURES, ("long", "string", "long", "long", "string", "string"), strict=True))
    return store.mapInArrow(task(run), "digest string, " + ", ".join(f"{k} {v}" for k, v in kinds.items())).groupBy("digest").agg(*[F.max(c).alias(c) for c in FEATURES])


FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def page_of(digest: Column, n_bytes: Column) -> Column:
    """A page of seven items: a heading, the payload as a figure between two paragraphs, a picture that no store has, and the payload again, with alternative text only."""
    image = lambda x: F.concat(F.lit(f'<img src="{PREFIX}'), x, F.lit('" alt="'), F.substring(x, 1, 8), F.lit('">'))
    caption = F.concat(F.lit("<figcaption>all <b>"), n_bytes.cast("string"), F.lit("</b> bytes</figcaption>"))
    return F.concat(F.lit("<h1>Document</h1><p>Before"), F.lit("<figure>"), image(digest), caption, F.lit("</figure><p>Between</p>"), image(F.lit("none")), F.lit("<p>After"), image(digest))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a figure of a page. All columns come out of the pages and the store: n_bytes out of the figure's caption, position and caption from the reference."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    docs = docs.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), padded(F.col("data")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    told = cut(features(media_store(docs)))  # one row a digest; cut, so that a digest that very many pages show can be split in the join
    pages = parse(docs.select("doc_id", page_of(F.col("digest"), F.col("n_bytes")).alias("html")))
    # of a page's references, the captioned one is resolved here
    figures = pages.withColumn("items", F.transform("items", lambda x: F.when((x["kind"] == "media") & x["caption"].endswith(" bytes"), x)))
    shown = resolve(figures, told).filter("kind = 'media'")
    return shown.select("doc_id", F.regexp_extract("caption", "([0-9]+) bytes$", 1).cast("long").alias("n_bytes"), *FEATURES, F.col("position").cast("long").alias("position"), "caption")
