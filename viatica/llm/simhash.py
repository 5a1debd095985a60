"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, in two halves of 32. Two fingerprints that differ in at most 3 bits differ in at most 1 bit in
one half. Each half is covered by a code of radius 1: the perfect Hamming code over 31 bits, with the last bit as it
is. A half has one home anchor (the code word at distance 0 or 1) and is copied to all anchors within the radius plus the
half's threshold, 2: at most 17. If two halves differ in at most 1 bit, the home anchor of one is among the anchors of
the other, so every link shows at some anchor, where homes are compared with all that came, by exact 64-bit distance.
There are 2^28 anchors, so the rows at an anchor are few but for fingerprints that are really close.

Edge cases: null and empty texts, and texts of white space, have fingerprint zero and link like any other; under three
words the whole sequence is the one shingle; repeated rows and rows with a null id take part, and component_id is the
least id that is not null (null if there is none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.llm.base import binaries, cut, partitions, slices, table, task
from viatica.llm.graph import components

LANE = np.uint64(0x0101010101010101)
HALF_THRESHOLD, THRESHOLD = 1, 3


def _hashes(text: bytes, width: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        yield np.array([digest(joined, 42)], np.uint64)
        return
    ends = (starts + lengths - 1)[width - 1 :]
    for i in range(0, len(ends), block):
        pairs = zip(starts[i : i + block].tolist(), ends[i : i + block].tolist(), strict=False)
        yield np.array([digest(joined[a:b], 42) for a, b in pairs], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first: eight bits at a time in the bytes of a sum of at most 255."""
    cuts = np.arange(0, len(hashes), 255)
    counts = np.zeros(64, np.int64)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & LANE, cuts)
        counts[shift::8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return counts


def fingerprint(text: bytes, width: int = 3) -> int:
    """Signed, as Spark has no unsigned 64-bit integers."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in _hashes(text, width):
        counts += bit_counts(hashes)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0]) if total else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, whatever type its name has."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = pa.array([fingerprint(x, width) for x in binaries(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], names=["doc_id", "fp"])

    return rows.mapInArrow(task(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _syndromes(bits31: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bits31), np.uint64)
    for i in range(31):
        out ^= ((bits31 >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in halves, anchor, is it the home) for all anchors within 2 of 32-bit halves; the first 31 bits are coded."""
    one = np.uint64(1)
    coded, syndrome = halves & np.uint64(0x7FFFFFFF), _syndromes(halves & np.uint64(0x7FFFFFFF))
    bit = lambda place: np.where(place > 0, one << (np.maximum(place, one) - one), np.uint64(0))
    home = (coded ^ bit(syndrome)) | (halves & np.uint64(1 << 31))
    at = np.arange(len(halves))
    which, found, is_home = [at, at], [home, home ^ np.uint64(1 << 31)], [np.ones(len(at), bool), np.zeros(len(at), bool)]
    off = np.flatnonzero(syndrome)  # code words lie 3 apart at least: a half that is a code word has no other within 2
    for i in range(1, 32):  # two flips i and j lead to a code word if i xor j is the syndrome
        i_ = np.uint64(i)
        j = syndrome[off] ^ i_
        use = off[j > i_]
        which.append(use)
        found.append(halves[use] ^ bit(np.full(len(use), i_)) ^ bit(syndrome[use] ^ i_))
        is_home.append(np.zeros(len(use), bool))
    return np.concatenate(which), np.concatenate(found), np.concatenate(is_home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.asarray(batch.column("fp")).astype(np.int64)
        for at in range(0, len(fps), 1 << 14):
            part = fps[at : at + (1 << 14)]
            bits = part.view(np.uint64)
            for half in (0, 1):
                which, found, home = anchors((bits >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
                keys = (found | np.uint64(half << 32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[which]), pa.array(home)], names=["anchor", "fp", "home"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable position for positions 0 to n-1 linked by a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != (again := new[new])).any():
            new = again
        if (new == root).all():
            return root
        root = new


def _close(fps: np.ndarray, home: np.ndarray, threshold: int, block: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of homes and others at one anchor that are close. Very many are first split by each quarter of the bits: of four quarters one at least is the same."""
    if len(fps) > 4096 and threshold <= 3:
        for quarter in range(4):
            part = (fps >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
            order = np.argsort(part, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(rows) > 1 and home[rows].any():
                    yield from ((rows[i], rows[j]) for i, j in _blocks(fps[rows], home[rows], threshold, block))
    else:
        yield from _blocks(fps, home, threshold, block)


def _blocks(fps: np.ndarray, home: np.ndarray, threshold: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    homes = np.flatnonzero(home)
    step = max(1, block // len(fps))
    for at in range(0, len(homes), step):
        own = homes[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fps[own, None] ^ fps) <= threshold)
        yield own[i], j


def _compare(threshold: int):
    """Over rows sorted by anchor: links (a, b) that join all close fingerprints of an anchor, as a star around their least."""

    def stars(keys: np.ndarray, fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        root = np.arange(len(keys))
        left, right = [], []
        for shift in range(1, 32):  # rows of one anchor lie together: compare each with the one `shift` further on
            a = np.flatnonzero(keys[shift:] == keys[:-shift])
            if not len(a):
                break
            a = a[(home[a] | home[a + shift]) & (np.bitwise_count(fps[a] ^ fps[a + shift]) <= threshold)]
            left.append(a)
            right.append(a + shift)
        for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
            own = np.arange(n)
            for i, j in _close(fps[s : s + n], home[s : s + n], threshold):
                own = _roots(n, np.r_[np.arange(n), i], np.r_[own, j])
            left.append(s + np.arange(n))
            right.append(s + own)
        if left:
            root = _roots(len(keys), np.concatenate(left), np.concatenate(right))
        out = np.flatnonzero(root != np.arange(len(keys)))
        pairs = np.unique(np.stack([fps[out], fps[root[out]]], 1).astype(np.uint64), axis=0) if len(out) else np.zeros((0, 2), np.uint64)
        return pairs[:, 0], pairs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, b = stars(*(np.concatenate(x) for x in zip(*rows, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = (np.asarray(batch.column(n)).astype(np.int64) for n in (0, 1))
            rows = (keys, fps.view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
            first = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on in the next batch
            if first:
                yield flush([*held, tuple(x[:first] for x in rows)])
                held = []
            held.append(tuple(x[first:] for x in rows))
        if held:
            yield flush(held)

    return run


def linked(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between different values of fp, enough to join all that differ in at most `threshold` (3 or fewer) bits."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the two halves hold one difference each: threshold is 3 at most")
    copies = fps.select("fp").distinct().mapInArrow(task(_replicate), "anchor long, fp long, home boolean")
    dealt = copies.repartition(partitions(fps.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(task(_compare(threshold)), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) for every row of documents (doc_id, text)."""
    marked = cut(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), width))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(linked(marked, threshold))
    placed = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = cut(placed)
    named = cut(placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component: that with the least id, rows without an id last, and of these and of one id's texts that with the least hash.

    Rows are told apart by id and 128 bits of their text's hash; of rows that have both in common one stays. Which row stays is decided on these alone;
    texts are moved once, to meet the decisions.
    """
    t, u = F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), t.alias("t"), u.alias("u"))
    marked = cut(fingerprints(docs.select(key.alias("doc_id"), "text"), width))
    alike = marked.groupBy("fp", "doc_id").agg(F.count("*").alias("n"))
    roots = components(linked(marked, threshold))
    placed = alike.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), F.struct("doc_id", "n").alias("row"))
    first = placed.groupBy("root").agg(F.min("row").alias("row")).select("row.doc_id.*", "row.n")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), key.alias("k")).select("d", "k.*")
    found = rows.join(first.hint("shuffle_hash"), ["none", "id", "t", "u"])
    once, more = found.filter("n = 1"), found.filter("n > 1").dropDuplicates(["none", "id", "t", "u"])
    return once.unionByName(more).select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
