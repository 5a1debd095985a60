"""Quality by a generalised additive model with pairwise interactions.

Every whole text becomes a row of measures (`MEASURES`): sizes, word lengths, repetition of words and lines, shares of kinds of bytes, endings of
words, entropy. Each measure is cut into bins at quantiles of a sample. Shallow trees (two levels, so up to four leaves) are boosted one
measure at a time in turns: a tree of one measure changes only that measure's lookup table over its bins. Then pairs of measures are
ranked by what a cut of both would still gain, and the best pairs get tables of their own in the same way, by trees that cut one and then the other. A score is the
sigmoid of a bias and the sum of the looked-up values: one addition a table, over all rows of a batch at once.

The fit is bounded: about `rows` labelled rows, chosen by the hash of their id (all, if there are fewer); they are measured where they lie, and
their measures alone are gathered. All else runs over every document.

Edge cases: a null text is empty, and an empty text has all measures zero; rows whose label is null are not learned from, nor are rows without an id; an id labelled twice is
good only if all its labels say so; an unlabelled corpus, or one with a single label, scores its share of good rows (0 without any); equal texts score alike; an
empty table gives no rows; other columns are ignored, whatever their names. Very long texts are measured whole, one at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.llm.base import binaries, cut, fold, lean, slices, table, task

THRESHOLD = 0.3
MEASURES = (
    "log_bytes log_words mean_word spread_word longest_word distinct_words top_word repeated_next repeated_pairs log_lines short_lines repeated_lines words_a_line bare_lines upper digits other_bytes "
    "marks bars brackets hashes spaces entropy ends_in_mark ends_in_stop doubled_marks upper_words short_words distinct_letters vowels"
).split()

BYTES = np.arange(256)
LETTER = ((BYTES | 32) >= 97) & ((BYTES | 32) <= 122) | (BYTES >= 128)
KINDS = {
    "upper": (BYTES >= 65) & (BYTES <= 90),
    "digits": (BYTES >= 48) & (BYTES <= 57),
    "other_bytes": BYTES >= 128,
    "marks": ((BYTES >= 33) & (BYTES <= 47)) | ((BYTES >= 58) & (BYTES <= 64)) | ((BYTES >= 91) & (BYTES <= 96)) | ((BYTES >= 123) & (BYTES <= 126)),
    "bars": np.isin(BYTES, list(b"|/\\")),
    "brackets": np.isin(BYTES, list(b"()[]{}<>")),
    "hashes": np.isin(BYTES, list(b"#$%&*+=@^_~")),
    "spaces": np.isin(BYTES, list(b" \t\n\r\x0b\x0c")),
    "vowels": np.isin(BYTES | 32, list(b"aeiou")),
}


def measures(text: bytes) -> list[float]:
    """The measures of one text, in the order of MEASURES."""
    words = text.split()
    if not words:
        return [0.0] * len(MEASURES)
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    share = counts / len(raw)
    some = share[share > 0]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = len(words)
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    mark = KINDS["marks"][raw]
    ends = [w[-1] for w in words]
    last = np.bincount(np.array(ends, np.int64), minlength=256)
    stops = last[list(b".,;:!?")].sum()
    out = {
        "log_bytes": np.log1p(len(raw)),
        "log_words": np.log1p(n),
        "mean_word": sizes.mean(),
        "spread_word": sizes.std(),
        "longest_word": np.log1p(sizes.max()),
        "distinct_words": len(seen) / n,
        "top_word": max(seen.values()) / n,
        "repeated_next": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "repeated_pairs": 1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0,
        "log_lines": np.log1p(len(lines)),
        "short_lines": sum(len(x) < 20 for x in lines) / len(lines),
        "repeated_lines": 1 - len(set(lines)) / len(lines),
        "words_a_line": np.log1p(n / len(lines)),
        "bare_lines": sum(x.rstrip()[-1:] not in b".!?\"')" for x in lines) / len(lines),
        "entropy": -(some * np.log2(some)).sum(),
        "ends_in_mark": last[KINDS["marks"]].sum() / n,
        "ends_in_stop": stops / n,
        "doubled_marks": np.count_nonzero(mark[1:] & mark[:-1]) / n,
        "upper_words": sum(w.isupper() for w in words) / n,
        "short_words": np.count_nonzero(sizes <= 3) / n,
        "distinct_letters": np.count_nonzero(counts[LETTER]),
    }
    out |= {k: share[own].sum() for k, own in KINDS.items()}
    return [float(out[m]) for m in MEASURES]


def measured(texts: list[bytes]) -> np.ndarray:
    return np.array([measures(x) for x in texts], np.float64).reshape(len(texts), len(MEASURES))


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of ordered bins with gradient and curvature sums g and h."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    total, most = g.sum(), h.sum()
    gain = a * a / (b + ridge) + (total - a) ** 2 / (most - b + ridge) - total * total / (most + ridge)
    gain = np.where((b > 1) & (most - b > 1), gain, 0.0)  # a leaf needs some rows
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 0 else 0


def tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A two-level tree over ordered bins: its step in each bin."""
    step = np.zeros(len(g))
    first = best_cut(g, h, ridge)[1]
    for a, b in ((0, first), (first, len(g))):
        middle = a + best_cut(g[a:b], h[a:b], ridge)[1] if b - a > 1 else a
        for c, d in ((a, middle), (middle, b)):
            if d > c:
                step[c:d] = -g[c:d].sum() / (h[c:d].sum() + ridge)
    return step


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """As tree, over a grid of two measures: a cut of one, then of the other on either side."""
    best, step = 0.0, np.zeros_like(g)
    for flip in (False, True):
        u, v = (g.T, h.T) if flip else (g, h)
        for at in range(1, len(u)):
            made, gain = np.zeros_like(u), 0.0
            for part in (slice(0, at), slice(at, len(u))):
                gs, hs = u[part].sum(0), v[part].sum(0)
                more, middle = best_cut(gs, hs, ridge)
                gain += more
                for c, d in ((0, middle), (middle, len(gs))):
                    if d > c:
                        made[part, c:d] = -gs[c:d].sum() / (hs[c:d].sum() + ridge)
            if gain > best:
                best, step = gain, made.T if flip else made
    return step


class Additive:
    """Lookup tables over bins of measures and of pairs of measures."""

    def __init__(self, bias: float = 0.0, bins: int = 32, coarse: int = 8):
        self.bias, self.bins, self.coarse = bias, bins, coarse
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, m], "right") for m, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), np.int64)

    def _grid_of(self, binned: np.ndarray, m: int) -> np.ndarray:
        """Coarse bins of a measure, so that each has as many of its bins."""
        return binned[:, m] * self.coarse // len(self.tables[m])

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        out = np.full(len(x), self.bias)
        for m, values in enumerate(self.tables):
            out += values[bins[:, m]]
        for (a, b), values in zip(self.pairs, self.grids, strict=True):
            out += values[self._grid_of(bins, a), self._grid_of(bins, b)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x).clip(-30, 30)))

    def fit(self, x: np.ndarray, labels: np.ndarray, turns: int = 150, pair_turns: int = 60, pairs: int = 8, rate: float = 0.1, ridge: float = 2.0) -> None:
        share = labels.mean().clip(1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, m], np.linspace(0, 1, self.bins + 1)[1:-1], method="higher")) for m in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = self.binned(x)
        raw = np.full(len(x), self.bias)

        def off() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-raw.clip(-30, 30)))
            return p - labels, p * (1 - p)

        for _ in range(turns):
            for m, values in enumerate(self.tables):
                g, h = (np.bincount(bins[:, m], w, len(values)) for w in off())
                step = rate * tree(g, h, ridge)
                values += step
                raw += step[bins[:, m]]
        grids = np.stack([self._grid_of(bins, m) for m in range(x.shape[1])], 1)
        n = self.coarse
        g, h = off()

        def sums(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = grids[:, a] * n + grids[:, b]
            return np.bincount(own, g, n * n).reshape(n, n), np.bincount(own, h, n * n).reshape(n, n)

        def gain(pair: tuple[int, int]) -> float:
            gs, hs = sums(*pair, g, h)
            step = pair_tree(gs, hs, ridge)
            return float(-(gs * step).sum() - 0.5 * (hs * step * step).sum())

        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: (-gain(p), p))
        self.pairs = ranked[:pairs]
        self.grids = [np.zeros((n, n)) for _ in self.pairs]
        for _ in range(pair_turns):
            for (a, b), values in zip(self.pairs, self.grids, strict=True):
                step = rate * pair_tree(*sums(a, b, *off()), ridge)
                values += step
                raw += step[grids[:, a], grids[:, b]]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, quality) of about `rows` labelled documents that are not held out. The ids are broadcast, being so few."""
    own = labels.filter("quality is not null and doc_id is not null").filter(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    there = own.count()
    if there > rows:
        own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1_000_000)) < int(1e6 * rows / there))
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", F.when(F.col("quality") > 0, 1).otherwise(0).alias("quality"))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        x = measured(binaries(b.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(MEASURES)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("quality").cast(pa.int32()), lists], names=["quality", "x"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Additive:
    seen = cut(labelled_sample(docs, labels, rows).mapInArrow(task(_measured), "quality int, x array<double>")).toArrow()  # about `rows` rows of measures
    own = seen.column("quality").to_numpy().astype(float)
    if len(own) == 0 or own.min() == own.max():
        return Additive(30.0 if len(own) and own[0] else -30.0)
    x = seen.column("x").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
    order = np.lexsort((*x.T, own))  # the same sums however the rows came
    model = Additive()
    model.fit(x[order], own[order])
    return model


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(shared.value.score(measured(binaries(b.column("text")))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task(run), "doc_id long, score double")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
