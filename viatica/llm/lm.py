"""Language-model scoring by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are lower-cased words and one end a document. All training documents are counted (hash of a token -> count, summed
over the cluster). The top of the model is a set of classes: the `classes` - 2 most frequent tokens, the end, and GROUPS groups of
all other tokens, by the first bits of their hashes. It predicts a class from the two before it: its representation is the
elementwise-weighted sum of theirs, its score the product with the class's own vector plus a bias. Every partition of the training
text takes one pass of noise-contrastive steps from the same start, and the parameters are averaged by tokens (so they depend
on how the input is partitioned), summed on the executors, not the driver.

Every other counted token has a vector and a bias of its own, below its group; one more leaf is for tokens never seen. Given its
group and the class before it, a token's probability is exp(vector . context + bias) over the same sum of all tokens of the
group. The vectors come from one Newton step, shortened by STEP, of the noise-contrastive objective from the start "as frequent as
counted", with the group's counts as noise and the noise taken in expectation: for a token seen c times that is
(c S + RIDGE s I)^-1 (sum of its contexts - c times the group's mean context), S being the covariance of the group's contexts and s
its mean variance. It needs only sums, so it does not depend on order or partitions. Parameters grow with the vocabulary.

Scores are normalised exactly, by batched matrix products: with A1 and A2 the products of all context and class vectors, the
normaliser of a pair of contexts is a product of two matrices, exp(A1) exp(A2 + b)^T, so one table has them all; a group has one
normaliser for each class before, from the product of its vectors and all contexts.

The `near` next frequent tokens are broadcast with their vectors (a bound: 2^18 of them are 18 MB) and scored where the text is. All
tokens beyond are scored where their part of a group is, to which the text sends (hash, class before, row) and gets back sums a row. Groups are
parted by further bits of the hashes, up to 2^16 parts, so that a part has about TASK_TOKENS training tokens; sums and normalisers add up over parts.
As a context, a token below the top has the vector of its group.

Edge cases: a null text is empty, its one token the end; documents with a null id are learned from; without training
tokens all tokens are unseen and both scores follow from N = V = 0; repeated rows are scored once each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.llm.base import binaries, cut, fold, kept, partitions, slices, table, task

END = "\n"  # no word holds it
REST, CLOSE = 0, 1  # class of the first group of tokens that have none of their own, class of the end
BITS = 7
GROUPS = 1 << BITS  # the other groups' classes follow those of the frequent tokens
RIDGE, STEP, SPREAD = 10.0, 0.4, 0.6  # of a leaf's vector: ridge, length of the step, and what its bias gives back of its spread
TASK_TOKENS = 400_000  # training tokens below the top for a task, about
HIGHEST = 60.0  # no leaf's exponent goes beyond, so that sums stay finite


def hashes_of(tokens: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n).view(np.int64)


END_HASH = int(hashes_of([END.encode()], 1)[0])


def counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token stands in docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        ends = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.r_[hashes_of(seen, len(seen)), END_HASH]), pa.array([*seen.values(), ends], pa.int64())], names=["h", "c"])
            seen.clear()
            return out

        for batch in slices(batches, "text", 4 << 20):
            for text in binaries(batch.column("text")):
                seen.update(text.lower().split())
                ends += 1
            if len(seen) > 300_000:
                yield flush()
                ends = 0
        if seen or ends:
            yield flush()

    return docs.select("text").mapInArrow(task(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 0")


def groups_of(hashes: np.ndarray, more: int = 0) -> np.ndarray:
    """Groups by the first bits of hashes; with some bits more, parts of groups."""
    return (hashes.view(np.uint64) >> np.uint64(64 - BITS - more)).astype(np.int64)


class _Codes(dict):
    """Code of a token; a new one is looked up by its hash, and remembered unless it is long."""

    def __init__(self, number: dict[int, int], rest: int):
        super().__init__()
        self.number, self.rest = number, rest

    def __missing__(self, token: bytes) -> int:
        x = xxhash.xxh64_intdigest(token)
        own = self.number.get(x - (1 << 64) if x >> 63 else x, self.rest + (x >> 64 - BITS))
        if len(token) <= 48:
            self[token] = own
        return own


class Coder:
    """Codes of whole texts by a bounded memory of tokens: classes first, then near tokens, then the groups of all others."""

    def __init__(self, top: np.ndarray, near: np.ndarray, limit: int = 400_000):
        self.group_class = np.r_[REST, len(top) + 2 + np.arange(GROUPS - 1)]
        self.classes = len(top) + 1 + GROUPS
        self.rest = self.classes + len(near)
        self.near_group = groups_of(near)
        self.class_of = np.r_[np.arange(self.classes), self.group_class[self.near_group], self.group_class].astype(np.int32)
        number = dict(zip(top.tolist(), range(2, len(top) + 2), strict=True))
        number.update(zip(near.tolist(), range(self.classes, self.rest), strict=True))
        self.known = _Codes(number, self.rest)
        self.limit = limit

    def stream(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts one after another, each with its end; how many tokens each has; places and hashes of the tokens that are neither of a class nor near."""
        if len(self.known) > self.limit:
            self.known.clear()
        words = [x.lower().split() for x in texts]
        sizes = np.fromiter((len(x) + 1 for x in words), np.int64, len(words))
        flat = [w for x in words for w in x]
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int32, len(flat))
        out = np.full(int(sizes.sum()), CLOSE, np.int32)
        at = np.ones(len(out), bool)
        at[np.cumsum(sizes) - 1] = False
        out[at] = codes
        far = np.flatnonzero(codes >= self.rest)
        return out, sizes, np.flatnonzero(out >= self.rest), hashes_of([flat[i] for i in far.tolist()], len(far))


def contexts(classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; ends stand before a text."""
    starts = np.cumsum(sizes) - sizes
    one = np.r_[CLOSE, classes[:-1]]
    one[starts] = CLOSE
    two = np.r_[CLOSE, one[:-1]]
    two[starts] = CLOSE
    return one, two


class LogBilinear:
    NAMES = ("r", "q", "m", "b")

    def __init__(self, unigram: np.ndarray, width: int = 24, seed: int = 8):
        """unigram: the training share of each class."""
        random = np.random.default_rng(seed)
        n = len(unigram)
        self.share = (unigram + 1e-9) / (unigram + 1e-9).sum()
        self.r, self.q = (random.normal(0, 0.05, (n, width)).astype(np.float32) for _ in range(2))
        self.m = np.ones((2, width), np.float32)
        self.b = np.log(self.share).astype(np.float32)
        self.seen = {x: np.full(n, 1e-2, np.float32) for x in ("r", "q", "b")}

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES]).astype(np.float64)

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.NAMES:
            old = getattr(self, x)
            setattr(self, x, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def steps(self, classes: np.ndarray, sizes: np.ndarray, random: np.random.Generator, noise: int = 24, block: int = 512, run: int = 32, batch: int = 8192, rate: float = 0.07) -> None:
        """One pass of noise-contrastive steps over texts one after another: each token against the noise tokens its block shares. AdaGrad by parameter row.

        Steps are taken over runs of neighbouring tokens, in random order, so that a token's row is fetched and moved once for its three parts: as target, and as each context.
        """
        starts = np.cumsum(sizes) - sizes
        stream = np.insert(classes, starts, CLOSE).astype(np.uint16)  # a second end before each text, itself no target
        counted = np.ones(len(stream), np.float32)
        counted[starts + np.arange(len(starts))] = 0
        short = -len(stream) % run
        stream = np.r_[np.full(2, CLOSE, np.uint16), stream, np.full(short, CLOSE, np.uint16)]
        counted = np.r_[np.zeros(2, np.float32), counted, np.zeros(short, np.float32)]
        cumulative = np.cumsum(self.share)
        log_noise = np.log(self.share * noise).astype(np.float32)
        first = random.permutation(np.arange(2, len(stream), run))
        for at in range(0, len(first), batch // run):
            self._step(stream, counted, first[at : at + batch // run, None] + np.arange(-2, run), cumulative, log_noise, random, noise, block, rate)

    def _step(self, stream, counted, places, cumulative, log_noise, random, noise: int, block: int, rate: float) -> None:
        width = self.q.shape[1]
        own = stream[places]
        n, length = len(own), own.shape[1] - 2
        rows, target, weight = own.ravel(), own[:, 2:].ravel(), counted[places[:, 2:]].ravel()
        parts = np.concatenate([self.q, self.r * self.m[0], self.r * self.m[1]], 1)
        x = parts.take(rows, 0).reshape(n, length + 2, 3 * width)
        h = (x[:, 1:-1, width : 2 * width] + x[:, :-2, 2 * width :]).reshape(-1, width)
        qw = x[:, 2:, :width].reshape(-1, width)
        bias = self.b - log_noise
        with np.errstate(over="ignore"):
            g = -weight / (1 + np.exp(np.einsum("nd,nd->n", h, qw) + bias.take(target)))
            gh = qw * g[:, None]
            cuts = np.arange(0, len(h), block)
            fake = np.minimum(np.searchsorted(cumulative, random.random((len(cuts), noise))), len(self.share) - 1)
            to_q, to_b = np.empty((len(cuts), noise, width), np.float32), np.empty((len(cuts), noise), np.float32)
            for k, s in enumerate(cuts.tolist()):
                qf, part = self.q.take(fake[k], 0), h[s : s + block]
                p = part @ -qf.T
                p -= bias.take(fake[k])
                np.exp(p, out=p)
                p += 1
                np.divide(weight[s : s + block, None], p, out=p)
                gh[s : s + block] += p @ qf
                to_q[k], to_b[k] = p.T @ part, p.sum(0)
        moves = np.zeros((n, length + 2, 3 * width), np.float32)
        np.multiply(h.reshape(n, length, width), g.reshape(n, length, 1), out=moves[:, 2:, :width])
        moves[:, 1:-1, width : 2 * width] = moves[:, :-2, 2 * width :] = gh.reshape(n, length, width)
        order = np.argsort(rows, kind="stable")
        ordered = rows.take(order)
        begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        total = np.zeros((len(self.b), 3 * width), np.float32)
        total[ordered[begin]] = np.add.reduceat(moves.reshape(-1, 3 * width).take(order, 0), begin, 0)
        np.add.at(total[:, :width], fake.ravel(), to_q.reshape(-1, width))
        one, two = total[:, width : 2 * width], total[:, 2 * width :]
        gm = np.stack([(one * self.r).sum(0), (two * self.r).sum(0)]) / block
        self._move("q", total[:, :width], rate)
        self._move("r", one * self.m[0] + two * self.m[1], rate)
        self._move("b", (np.bincount(target, g, len(self.b)) + np.bincount(fake.ravel(), to_b.ravel(), len(self.b))).astype(np.float32), rate)
        self.m -= rate * 0.1 * gm

    def _move(self, name: str, total: np.ndarray, rate: float) -> None:
        value, seen = getattr(self, name), self.seen[name]
        seen += np.einsum("nd,nd->n", total, total) / total.shape[1] if total.ndim > 1 else total * total
        scale = rate / np.sqrt(seen)
        value -= scale[:, None] * total if total.ndim > 1 else scale * total

    def context(self) -> np.ndarray:
        """What each class is as the token just before."""
        return self.r * self.m[0]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log p of class w after classes i, j is a1[i, w] + a2[j, w] - z[i, j]; gives (a1, a2, z)."""
        a1 = (self.r * self.m[0]) @ self.q.T
        a2 = (self.r * self.m[1]) @ self.q.T + self.b
        top1, top2 = a1.max(1, keepdims=True), a2.max(1, keepdims=True)
        z = np.log(np.maximum(np.exp(a1 - top1) @ np.exp(a2 - top2).T, 1e-30)) + top1 + top2.T
        return a1, a2, z


@dataclass
class Group:
    """What all leaves of a group share: mean of its contexts, their covariance with its axes and variances along them, and the sum of its weights."""

    mean: np.ndarray
    spread: np.ndarray
    axes: np.ndarray
    size: np.ndarray
    weight: float

    @classmethod
    def of(cls, context: np.ndarray, before: np.ndarray, weight: float) -> Group:
        """before: how often each class stands before a token of the group."""
        x, seen = context.astype(np.float64), max(1.0, before.sum())
        mean = before @ x / seen
        spread = (x * before[:, None]).T @ x / seen - np.outer(mean, mean)
        size, axes = np.linalg.eigh(spread)
        return cls(mean, spread, axes, np.maximum(size, 1e-9), weight)

    def unseen(self) -> float:
        """The bias of tokens never seen; their vector is zero."""
        return -math.log(self.weight)


class Leaves:
    """Tokens of a group, or of a part of it: hashes in order, counts, and the sums of the contexts they stand in."""

    def __init__(self, hashes: np.ndarray, counted: np.ndarray, context: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counted = hashes[order], counted[order]
        self.context = context
        self.sums, self.pairs = np.zeros((len(hashes), context.shape[1])), np.zeros(len(hashes))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        return _find(self.hashes, hashes)

    def add(self, leaf: np.ndarray, before: np.ndarray) -> None:
        """Training tokens and the class before each."""
        self.pairs += np.bincount(leaf, minlength=len(self.pairs))
        for k, column in enumerate(np.ascontiguousarray(self.context.T)):
            self.sums[:, k] += np.bincount(leaf, column.take(before), len(self.pairs))

    def learn(self, group: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vectors as 16-bit floats, biases, these leaves' share of the group's normaliser after each class)."""
        q = (self.sums - self.pairs[:, None] * group.mean) @ group.axes
        q = STEP * (q / (self.pairs[:, None] * group.size + RIDGE * group.size.mean())) @ group.axes.T
        b = np.log((self.counted + 1) / group.weight) - SPREAD * np.einsum("nd,nd->n", q @ group.spread, q)
        half = q.astype(np.float16)
        vectors = half.astype(np.float32)
        b = (b - vectors @ group.mean).astype(np.float32)
        total, step = np.empty(len(self.context)), max(1, (1 << 21) // max(1, len(b)))
        for at in range(0, len(total), step):
            total[at : at + step] = np.exp(leaf_scores(self.context[at : at + step] @ vectors.T, b)).sum(1)
        return half, b, total


def _find(ordered: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in an ordered array; its length for those that it does not hold."""
    if not len(ordered):
        return np.zeros(len(hashes), np.int64)
    at = np.searchsorted(ordered, hashes)
    return np.where(ordered[np.minimum(at, len(ordered) - 1)] == hashes, at, len(ordered))


def leaf_scores(products: np.ndarray, b: np.ndarray) -> np.ndarray:
    products += b
    return np.minimum(products, HIGHEST, out=products)


SENT = "key int, kind int, at long, a binary, b binary, c binary"
WORDS, NEAR, FAR, DOCS = range(1, 5)  # what a row brings, in the order a part of a group reads them
CHUNK, BEFORE = 4096, 1 << 20  # negative keys are of sums over all rows: parameters by chunks, and from BEFORE on the classes before a group's tokens


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names=["key", "kind", "at", "a", "b", "c"])


def _by_key(kind: int, at: int, keys: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """One row a key, with its part of up to three arrays."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    ordered = keys[order]
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
    arrays_ = [x[order] for x in arrays]
    blank = (None,) * (3 - len(arrays))
    return [(g, kind, at, *[x[s:e].tobytes() for x in arrays_], *blank) for g, (s, e) in zip(ordered[begin].tolist(), itertools.pairwise([*begin.tolist(), len(keys)]), strict=True)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, one after another."""
    for batch in batches:
        yield from zip(*[batch.column(x).to_pylist() for x in ("key", "kind", "at", "a", "b", "c")], strict=True)


def _in_groups(sent: DataFrame, n: int) -> DataFrame:
    return sent.repartitionById(n, F.col("key")).sortWithinPartitions("key", "kind", "at")


def lessons(learned: DataFrame, shared, start: LogBilinear, more: int) -> DataFrame:
    """One reading of all training text: the parameters each partition has trained, and (token, class before) of all tokens below the top, by parts of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        top, near = shared.value
        coder = kept(("coder", hash((top.tobytes(), near.tobytes()))), lambda: Coder(top, near))
        model = LogBilinear(start.share, start.r.shape[1])
        model.set(start.parameters())
        random, tokens, part = np.random.default_rng(9), 0, TaskContext.get().partitionId()
        near_keys, all_before = groups_of(near, more), np.zeros(GROUPS * coder.classes, np.int64)
        for n, batch in enumerate(slices(batches, "text", 4 << 20)):
            codes, sizes, far, hashes = coder.stream(binaries(batch.column("text")))
            classes = coder.class_of.take(codes)
            model.steps(classes, sizes, random)
            tokens += len(codes)
            before = contexts(classes, sizes)[0]
            close = np.flatnonzero((codes >= coder.classes) & (codes < coder.rest))
            places = codes[close] - coder.classes
            all_before += np.bincount(np.r_[coder.near_group[places], groups_of(hashes)] * coder.classes + np.r_[before[close], before[far]], minlength=len(all_before))
            before, at = before.astype(np.uint16), part << 32 | n
            yield _rows(_by_key(NEAR, at, near_keys[places], places.astype(np.uint32), before[close]) + _by_key(FAR, at, groups_of(hashes, more), hashes, before[far]))
        if tokens:
            flat = model.parameters() * tokens
            yield _rows([(-1 - i // CHUNK, 0, part, np.r_[tokens, flat[i : i + CHUNK]].tobytes(), None, None) for i in range(0, len(flat), CHUNK)])
            yield _rows([(-BEFORE - g, 0, part, x.astype(np.float64).tobytes(), None, None) for g, x in enumerate(all_before.reshape(GROUPS, -1)) if x.any()])

    return learned.select("text").mapInArrow(task(run), SENT)


def sums_by_key(rows: DataFrame) -> dict[int, np.ndarray]:
    """The arrays `a` of rows, summed by key on the executors, in a fixed order. Keys and lengths are bounded by `classes` and GROUPS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for k, _, _, a, *_ in _groups(batches):
            own = np.frombuffer(a)
            if k != key:
                if key is not None:
                    yield _rows([(key, 0, 0, total.tobytes(), None, None)])
                key, total = k, np.zeros(len(own))
            total = total + own
        if key is not None:
            yield _rows([(key, 0, 0, total.tobytes(), None, None)])

    return {r.key: np.frombuffer(r.a) for r in rows.repartition(8, "key").sortWithinPartitions("key", "at").mapInArrow(task(run), SENT).select("key", "a").collect()}


@dataclass
class Learned:
    top: np.ndarray  # hashes and counts of the tokens of a class
    top_counts: np.ndarray
    ends: float
    near: np.ndarray  # hashes, counts, vectors and biases of the near tokens
    near_counts: np.ndarray
    near_q: np.ndarray
    near_b: np.ndarray
    unseen_b: np.ndarray  # by group
    z: np.ndarray  # by group and class before
    model: LogBilinear
    leaves: DataFrame  # FAR rows: hashes, counts, vectors and biases of all other tokens, by group
    n: int
    v: int
    more: int  # bits of a hash beyond its group's that tell parts of a group
    tasks: int


def _leaf_bytes(q: np.ndarray, b: np.ndarray) -> bytes:
    return q.tobytes() + b.astype("<f4").tobytes()


def _leaf_arrays(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, np.float16, len(data) // 2 - 2 * n).reshape(n, -1), np.frombuffer(data, "<f4", n, len(data) - 4 * n)


def most_frequent(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the `most` words (h, c) with the greatest counts, the least hashes of a tie, in that order.

    The least count that is taken is found by counting words by ranges of counts, then by count, so nothing is sorted and no task sees more than its part.
    """
    step = F.floor(F.log("c") * 64).cast("int")
    wanted, level = most, None
    for r in sorted(words.groupBy(step.alias("s")).count().collect(), reverse=True):  # some thousands of ranges
        if r["count"] > wanted:
            level = r.s
            break
        wanted -= r["count"]
    kept_ = words
    if level is not None:
        least, part = None, 0.0
        for c, n in sorted(words.filter(step == level).groupBy("c").agg(F.count("*")).collect(), reverse=True):
            if n > wanted:
                least, part = c, wanted / n
                break
            wanted -= n
        edge = int(-(2**63) + part * 2**64 + 8 * 2**64 * math.sqrt(part + 1e-9) / math.sqrt(n))  # of evenly spread hashes, enough for the ties wanted and few more
        kept_ = words.filter((F.col("c") > least) | ((F.col("c") == least) & (F.col("h") <= min(edge, 2**63 - 1))))
    found = kept_.toArrow()
    hashes, counted = (found.column(x).to_numpy().astype(t) for x, t in (("h", np.int64), ("c", np.float64)))
    order = np.lexsort((hashes, -counted))[:most]
    return hashes[order], counted[order]


def learn(learned: DataFrame, classes: int = 2048, near: int = 1 << 18, width: int = 24) -> Learned:
    known = cut(counts(learned))
    total = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("h") == END_HASH, F.col("c"))), F.lit(0))).first()
    n, v, ends = int(total[0]), int(total[1]), float(total[2])
    words = known.filter(F.col("h") != END_HASH)
    hashes, counted = most_frequent(words, classes - 2 + near)
    top, own, close, close_counts = hashes[: classes - 2], counted[: classes - 2], hashes[classes - 2 :], counted[classes - 2 :]
    rest, weight = np.zeros(GROUPS), np.ones(GROUPS)
    for g, c, w in words.groupBy(F.shiftrightunsigned("h", 64 - BITS).alias("g")).agg(F.sum("c"), F.sum(F.col("c") + 1)).collect():
        rest[g], weight[g] = c, w + 1  # one for tokens never seen
    rest -= np.bincount(groups_of(top), own, GROUPS)
    weight -= np.bincount(groups_of(top), own + 1, GROUPS)
    unigram = np.r_[rest[0], ends, own, rest[1:]] + 1
    start = LogBilinear(unigram / unigram.sum(), width)
    spark = learned.sparkSession
    shared = spark.sparkContext.broadcast((top, close))
    wanted = int(rest.sum()) // TASK_TOKENS + 1
    more = min(16, max(BITS, (wanted - 1).bit_length())) - BITS
    tasks = min(1 << BITS + more, wanted)
    taught = cut(lessons(learned, shared, start, more))
    found = sums_by_key(taught.filter("key < 0"))
    model = LogBilinear(start.share, width)
    chunks = [found[k][1:] / found[k][0] for k in sorted(found, reverse=True) if k > -BEFORE]
    model.set(np.concatenate(chunks) if chunks else start.parameters())
    context = model.context()
    stats = [Group.of(context, found.get(-BEFORE - g, np.zeros(len(unigram))), float(weight[g])) for g in range(GROUPS)]
    bound = spark.sparkContext.broadcast((top, close, context, stats))

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        above, part = np.sort(np.r_[bound.value[0], END_HASH]), TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            h, c = (batch.column(k).to_numpy() for k in ("h", "c"))
            below = _find(above, h) == len(above)
            yield _rows(_by_key(WORDS, part << 32 | i, groups_of(h[below], more), h[below], c[below].astype(np.float64)))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, near_hashes, own_context, own_stats = bound.value
        by_hash = np.argsort(near_hashes)
        held: dict[int, list[tuple]] = {}
        part, leaves = None, None

        def flush(kind: int) -> None:
            parts = held.pop(kind, [])
            if parts:
                which = np.concatenate([np.frombuffer(p[0], np.uint32 if kind == NEAR else np.int64) for p in parts])
                leaves.add(leaves.find(near_hashes[which] if kind == NEAR else which), np.concatenate([np.frombuffer(p[1], np.uint16) for p in parts]).astype(np.int64))

        def plant() -> Leaves:
            parts = held.pop(WORDS, [])
            return Leaves(*[np.concatenate([np.empty(0, t), *[np.frombuffer(p[k], t) for p in parts]]) for k, t in ((0, np.int64), (1, np.float64))], own_context)

        def finish() -> pa.RecordBatch:
            nonlocal leaves
            leaves = leaves if leaves is not None else plant()
            flush(NEAR)
            flush(FAR)
            group = part >> more
            q, b, total = leaves.learn(own_stats[group])
            at = _find(near_hashes[by_hash], leaves.hashes)
            close_by, far = np.flatnonzero(at < len(near_hashes)), np.flatnonzero(at == len(near_hashes))
            rows = [(-1 - group, WORDS, part, total.tobytes(), None, None)]
            if len(close_by):
                rows.append((part, NEAR, 0, by_hash[at[close_by]].astype(np.int64).tobytes(), None, _leaf_bytes(q[close_by], b[close_by])))
            rows += [(part, FAR, k, leaves.hashes[s].tobytes(), leaves.counted[s].tobytes(), _leaf_bytes(q[s], b[s])) for k, s in enumerate(far[i : i + 8192] for i in range(0, len(far), 8192))]
            return _rows(rows)

        for key, kind, _, a, b, _ in _groups(batches):
            if key != part:
                if part is not None:
                    yield finish()
                part, leaves = key, None
                held.clear()
            if kind != WORDS and leaves is None:
                leaves = plant()
            held.setdefault(kind, []).append((a, b))
            if kind != WORDS and sum(len(p[1]) for p in held[kind]) > max(400_000, 8 * len(leaves.counted)):
                flush(kind)
        if part is not None:
            yield finish()

    rows = words.mapInArrow(task(send_words), SENT).union(taught.filter("key >= 0"))
    grown = cut(_in_groups(rows, tasks).mapInArrow(task(grow), SENT))
    near_q, near_b = np.zeros((len(close), width), np.float16), np.zeros(len(close), np.float32)
    for r in grown.filter(F.col("kind") == NEAR).collect():  # a vector a near token
        at = np.frombuffer(r.a, np.int64)
        near_q[at], near_b[at] = _leaf_arrays(r.c, len(at))
    unseen, totals = np.array([x.unseen() for x in stats], np.float32), sums_by_key(grown.filter("key < 0"))
    z = np.stack([np.log(totals.get(-1 - g, 0.0) + np.exp(unseen[g], dtype=np.float64) * np.ones(len(unigram))) for g in range(GROUPS)]).astype(np.float32)
    return Learned(top, own, ends, close, close_counts, near_q, near_b, unseen, z, model, grown.filter(F.col("kind") == FAR), n, v, more, tasks)


def apply(docs: DataFrame, own: Learned) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    tree = (own.top, own.top_counts, own.ends, own.near, own.near_counts, own.near_q, own.near_b, own.unseen_b, own.z, own.model)
    shared = docs.sparkSession.sparkContext.broadcast(tree)  # bounded by `classes`, GROUPS, `near` and `width`
    more, keys = own.more, 1 << BITS + own.more
    name = ("lm", hash((own.top.tobytes(), own.near.tobytes(), own.near_q.tobytes(), own.model.parameters().tobytes())))
    nats = math.log(10)

    def make():
        top, top_counts, ends, near, near_counts, q, b, _, z, model = shared.value
        coder = Coder(top, near)
        counted = np.r_[0.0, ends, top_counts, np.zeros(GROUPS - 1), near_counts, np.zeros(GROUPS)]
        return coder, np.log10(counted + 1), (counted > 0).astype(np.float64), [x.astype(np.float32) for x in model.tables()], model.context(), q.astype(np.float32), b, z

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32  # rows keep their places in a scan, whichever executor reads them
        coder, plus, there, (a1, a2, z), context, q, b, leaf_z = kept(name, make)
        for batch in slices(batches, "text", 4 << 20):
            codes, sizes, far, hashes = coder.stream(binaries(batch.column("text")))
            classes = coder.class_of.take(codes).astype(np.int64)
            one, two = contexts(classes, sizes)
            rows = one * len(context)
            logs = (a1.ravel().take(rows + classes) + a2.ravel().take(two * len(context) + classes) - z.ravel().take(rows + two)).astype(np.float64)
            close = np.flatnonzero((codes >= coder.classes) & (codes < coder.rest))
            for part in np.array_split(close, len(close) // 65_536 + 1):
                place, before = codes[part] - coder.classes, one[part]
                logs[part] += leaf_scores(np.einsum("nd,nd->n", q.take(place, 0), context.take(before, 0)), b.take(place)) - leaf_z[coder.near_group[place], before]
            starts = np.cumsum(sizes) - sizes
            sums = np.stack([np.add.reduceat(x, starts) for x in (logs / nats, plus.take(codes), there.take(codes))])
            ids = batch.column("doc_id").cast(pa.int64())
            named = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            yield _rows([*_by_key(FAR, at, groups_of(hashes, more), hashes, one[far].astype(np.uint16), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[far]), ((at >> 32) % keys, DOCS, at, sums.tobytes(), sizes.tobytes(), ids.tobytes() + named.tobytes())])
            at += len(sizes)

    def score_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, unseen, z, model = shared.value
        context = model.context()
        group, words, held, scored = None, [], [], []

        def flush() -> None:
            if not held:
                return
            h, before = np.concatenate([np.frombuffer(p[1], np.int64) for p in held]), np.concatenate([np.frombuffer(p[2], np.uint16) for p in held])
            row = np.concatenate([p[0] + np.frombuffer(p[3], np.int32).astype(np.int64) for p in held])
            held.clear()
            found = _find(hashes, h)
            s = leaf_scores(np.einsum("nd,nd->n", q.take(found, 0), context.take(before, 0)), b.take(found)) - z[group >> more][before]
            scored.append((row, s / nats, plus.take(found), found < len(hashes)))

        def summed() -> pa.RecordBatch:
            row = np.concatenate([x[0] for x in scored])
            order = np.argsort(row, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])
            sums = [np.add.reduceat(np.concatenate([x[k] for x in scored]).astype(np.float64)[order], first) for k in (1, 2, 3)]
            own_rows = row[order][first]
            scored.clear()
            out = []
            for i, j in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[np.flatnonzero(np.r_[True, np.diff(own_rows >> 32) != 0]), len(own_rows)].tolist()), strict=True):
                out.append((int(own_rows[i] >> 32), FAR, int(own_rows[i]), (own_rows[i:j] & 0xFFFFFFFF).astype(np.uint32).tobytes(), np.stack([x[i:j] for x in sums[:2]]).tobytes(), sums[2][i:j].astype(np.uint32).tobytes()))
            return _rows(out)

        hashes, plus, q, b = np.empty(0, np.int64), np.zeros(1), np.zeros((1, context.shape[1]), np.float32), np.zeros(1, np.float32)
        for key, kind, at, x, y, w in _groups(batches):
            if key != group:
                flush()
                group, words = key, []
                hashes = None
            if kind == WORDS:
                words.append((x, y, w))
                continue
            if kind == DOCS:
                yield _rows([(at >> 32, WORDS, at, x, y, w)])
                continue
            if hashes is None:
                hashes = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(p[0], np.int64) for p in words]])  # in order, as they were written
                plus = np.log10(np.r_[np.concatenate([np.empty(0), *[np.frombuffer(p[1]) for p in words]]), 0.0] + 1)
                leaves = [_leaf_arrays(p[2], len(p[0]) // 8) for p in words]
                q = np.concatenate([*[p[0] for p in leaves], np.zeros((1, context.shape[1]), np.float16)]).astype(np.float32)
                b = np.r_[np.concatenate([np.empty(0, np.float32), *[p[1] for p in leaves]]), unseen[key >> more]]
            held.append((at, x, y, w))
            if sum(len(p[1]) for p in held) > 1_600_000:
                flush()
                if sum(len(p[0]) for p in scored) > 2_000_000:
                    yield summed()
        flush()
        if scored:
            yield summed()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, first, parts, sums = None, 0, [], None

        def out() -> pa.RecordBatch:
            sizes, ids, named = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=~named), pa.array(sizes), *map(pa.array, sums)], names=["doc_id", "n_tokens", "score", "logs", "known"])

        for key, kind, at, x, y, w in _groups(batches):
            if key != source:
                if source is not None:
                    if sums is None:
                        sums = np.concatenate([p[0] for p in parts], 1)
                    yield out()
                source, parts, sums = key, [], None
            if kind == WORDS:
                n = len(y) // 8
                parts.append((np.frombuffer(x).reshape(3, n), np.frombuffer(y, np.int64), np.frombuffer(w, np.int64, n), np.frombuffer(w, bool, n, 8 * n)))
                continue
            if sums is None:
                sums = np.concatenate([p[0] for p in parts], 1)
            rows = np.frombuffer(x, np.uint32)  # each row once in a batch
            sums[:2, rows] += np.frombuffer(y).reshape(2, -1)
            sums[2, rows] += np.frombuffer(w, np.uint32)
        if source is not None:
            if sums is None:
                sums = np.concatenate([p[0] for p in parts], 1)
            yield out()

    words = own.leaves.select("key", F.lit(WORDS).alias("kind"), "at", "a", "b", "c")
    sent = words.union(docs.select("doc_id", "text").mapInArrow(task(run), SENT))
    parts = _in_groups(sent, own.tasks).mapInArrow(task(score_far), SENT)
    sums = parts.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "kind", "at").mapInArrow(task(gather), "doc_id long, n_tokens long, score double, logs double, known double")
    return sums.select(
        "doc_id",
        "n_tokens",
        F.col("known").cast("long").alias("n_known"),
        F.lit(own.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(own.n + own.v + 1)).alias("base_score"),
        "score",
    )


def score(docs: DataFrame, learned: DataFrame, **parameters) -> DataFrame:
    return apply(docs, learn(learned, **parameters))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 7), F.lit(0)) == 2
    found = score(docs, docs.filter(~held))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
