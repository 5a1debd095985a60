"""Toxicity by a factorization machine over hashed terms.

Terms are a document's words and their beginnings (4 to 6 bytes, for inflected words), each hashed to one of 2^22 places.
A sample of labelled rows gives counts; the places most associated with the label (log-likelihood ratio) are the
features. Then rows that hold one of these are counted again, and the places that tell toxic from clean among them, either way, are
features as well: a group's name or a mitigating word means nothing alone. A factorization machine is fitted to both: score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the
features present anywhere in the whole text, so pairs of terms count beyond their sum. As features are present or
absent, a long clean text is scored like a short one.

The fit is bounded: about `rows` labelled rows, chosen by the hash of their id (all, if there are fewer), and `features`
features by either count; that is what is gathered and broadcast, whatever the corpus holds. All else runs over every document.

Edge cases: a null text is empty, and an empty text scores the bias alone; rows whose label is null are not learned
from; an id labelled twice is toxic if either says so; an unlabelled corpus, or one with a single label, scores its
share of toxic rows (0 without any); repeated rows are scored alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.llm.base import binaries, cut, fold, kept, lean, slices, table, task

PLACES = 1 << 22
THRESHOLD = 0.7
MARKS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words(text: bytes) -> set[bytes]:
    return set(text.lower().translate(MARKS).split())


def places(word: bytes) -> list[int]:
    """Hashed places of a word and its beginnings."""
    terms = [word, *(b"^" + word[:n] for n in (4, 5, 6) if len(word) > n)]
    return [xxhash.xxh32_intdigest(t) % PLACES for t in terms]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, toxic rows, clean rows) by batch."""
    for batch in slices(batches, "text"):
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(binaries(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            found[label].update({p for w in words(text) for p in places(w)})
        all_ = np.fromiter(found[0].keys() | found[1].keys(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(all_), *(pa.array([found[k][p] for p in all_.tolist()], pa.int64()) for k in (1, 0))], names=["place", "ones", "zeros"])


def _counted_beside(scorer: Scorer):
    """As _counted, of the rows that hold a feature of the scorer; place -1 has the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            held = batch.filter(pa.array([bool(scorer.features(x)) for x in binaries(batch.column("text"))], pa.bool_()))
            ones = sum(held.column("toxic").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([ones], pa.int64()), pa.array([held.num_rows - ones], pa.int64())], names=["place", "ones", "zeros"])
            yield from _counted([held])

    return run


def association(ones: Column, zeros: Column, n1: int, n0: int) -> Column:
    """Log-likelihood ratio of presence in toxic and clean rows against the label."""
    term = lambda x, r, s: F.when(x > 0, x * F.log(x * float(n1 + n0) / (r * s))).otherwise(0.0)
    have, lack = ones + zeros, F.lit(n1 + n0) - ones - zeros
    return 2 * (term(ones, have, F.lit(n1)) + term(zeros, have, F.lit(n0)) + term(n1 - ones, lack, F.lit(n1)) + term(n0 - zeros, lack, F.lit(n0)))


class Machine:
    """A factorization machine over features that are present or absent."""

    def __init__(self, features: int, factors: int = 4, seed: int = 5):
        random = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(features), random.normal(0, 0.05, (features, factors))

    def raw(self, features: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([np.bincount(rows, self.v[features, f], n) for f in range(self.v.shape[1])], 1)
        squares = np.bincount(rows, (self.v[features] ** 2).sum(1), n)
        return self.bias + np.bincount(rows, self.w[features], n) + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, features: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(features, rows, n)[0].clip(-30, 30)))

    def fit(self, features: np.ndarray, rows: np.ndarray, labels: np.ndarray, turns: int = 250, rate: float = 0.05, decay: float = 1e-4) -> None:
        """Adam on the whole sample; the logistic loss with a little weight decay."""
        n, m, k = len(labels), len(self.w), self.v.shape[1]
        share = labels.mean().clip(1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        first, second = np.zeros(1 + m + m * k), np.zeros(1 + m + m * k)
        for t in range(1, turns + 1):
            raw, sums = self.raw(features, rows, n)
            off = 1 / (1 + np.exp(-raw.clip(-30, 30))) - labels
            own = off[rows]
            g_w = np.bincount(features, own, m)
            g_v = np.stack([np.bincount(features, own * sums[rows, f], m) for f in range(k)], 1) - g_w[:, None] * self.v
            g = np.concatenate([[off.sum()], g_w, g_v.ravel()]) / n
            g[1:] += decay * np.concatenate([self.w, self.v.ravel()])
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            self.bias -= float(step[0])
            self.w -= step[1 : 1 + m]
            self.v -= step[1 + m :].reshape(m, k)


class Scorer:
    """Features of whole texts by a memory of words, and their scores."""

    def __init__(self, chosen: np.ndarray, machine: Machine, limit: int = 400_000):
        self.number = {int(p): n for n, p in enumerate(chosen)}
        self.machine, self.limit = machine, limit
        self.known: dict[bytes, tuple[int, ...]] = {}

    def features(self, text: bytes) -> set[int]:
        if len(self.known) > self.limit:
            self.known.clear()
        found, known, number = set(), self.known, self.number
        for w in words(text):
            own = known.get(w)
            if own is None:
                own = tuple(number[p] for p in places(w) if p in number)
                if len(w) <= 48:  # so the memory is bounded in bytes
                    known[w] = own
            if own:
                found.update(own)
        return found

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [sorted(self.features(x)) for x in texts]
        return np.fromiter((f for x in found for f in x), np.int64), np.repeat(np.arange(len(texts)), [len(x) for x in found])

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.machine.score(*self.rows(texts), len(texts))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of about `rows` labelled documents that are not held out. The ids are broadcast, being so few."""
    own = labels.filter("toxic is not null and doc_id is not null").filter(fold("doc_id", 3) != 1).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    there = own.count()
    if there > rows:
        own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1e6 * rows / there))
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, features: int = 8_000, least: int = 3) -> tuple[np.ndarray, Machine]:
    sample = cut(labelled_sample(docs, labels, rows))
    counted = sample.mapInArrow(task(_counted), "place long, ones long, zeros long").groupBy("place").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    n1, n0 = (int(x or 0) for x in sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    if not n1 or not n0:
        machine = Machine(0)
        machine.bias = 30.0 if n1 else -30.0
        return np.zeros(0, np.int64), machine
    best = counted.filter(F.col("ones") >= least).filter(F.col("ones") * n0 > F.col("zeros") * n1 * 2).withColumn("g", association(F.col("ones"), F.col("zeros"), n1, n0)).filter("g > 12").orderBy(F.desc("g"), "place").limit(features).select("place").collect()
    chosen = np.array(sorted(r[0] for r in best), np.int64)
    if len(chosen):
        beside = cut(sample.mapInArrow(task(_counted_beside(Scorer(chosen, Machine(0)))), "place long, ones long, zeros long").groupBy("place").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")))
        m1, m0 = beside.filter("place = -1").select("ones", "zeros").first()
        if m1 and m0:
            more = beside.filter("place >= 0").filter(F.col("ones") + F.col("zeros") >= least)
            more = more.withColumn("g", association(F.col("ones"), F.col("zeros"), m1, m0)).filter("g > 12").orderBy(F.desc("g"), "place").limit(features).select("place").collect()
            chosen = np.union1d(chosen, np.array([r[0] for r in more], np.int64))
    scorer = Scorer(chosen, Machine(len(chosen)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [sorted(scorer.features(x)) for x in binaries(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "f"])

    seen = sample.mapInArrow(task(run), "toxic int, f array<int>").toArrow()
    lists = seen.column("f").combine_chunks()
    labels_ = seen.column("toxic").to_numpy().astype(float)
    flat = lists.flatten().to_numpy().astype(np.int64)
    sizes = np.asarray(pa.compute.list_value_length(lists))
    order = np.lexsort((flat, np.repeat(np.arange(len(sizes)), sizes)))
    scorer.machine.fit(flat[order], np.repeat(np.arange(len(sizes)), sizes), labels_)
    return chosen, scorer.machine


def score(docs: DataFrame, chosen: np.ndarray, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((chosen, machine))  # bounded by `features`
    key = ("toxicity", hash((chosen.tobytes(), machine.w.tobytes(), machine.bias)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(key, lambda: Scorer(*shared.value))
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scorer.score(binaries(batch.column("text"))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task(run), "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = table(spark, sf_dir, "documents")
    found = score(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (F.coalesce(fold("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
