"""Language identification by cross-parsing entropy.

For each language a suffix automaton over a sample of its labelled text knows every substring of it. A text is parsed
from left to right into the longest phrases that the automaton knows; it needs c phrases, and the language with the least
c log2(size of its sample) a letter, the cross-parsing estimate of the entropy, wins. Symbols are code points: every letter of a language's
sample is a symbol of its own automaton, however many scripts and letters there are in all. The automaton is turned into a
table in which a step that leaves the sample starts the next phrase, with a column for each letter of this language only; that of a language of more than `NARROW`
symbols is a hash table of its steps instead, as most of its columns would be empty.

Whole batches of texts are parsed in step by array look-ups. A long text stands in several blocks, all parsed at once as if a phrase
began at each; then every block is parsed again from the state in which the block before it ended, beside its first parse, until
the two are in one state, from where on they agree. Where they do not meet, the next block is parsed again, and so on:
the phrases are those of one parse of the whole text, however long.

The sample is bounded: up to `rows` documents of a language, chosen by the hash of their id, a stretch of up to `stretch` characters of each, which begins at a place given by that hash
(a shorter document is taken whole), and of these as many as fit `chars` characters (`total` over the number of languages, if that is less). They are cut to that where they
lie; no more is gathered. So the tables' size does not grow with the corpus. Of more than `languages` languages those with most labelled rows are learned.

Edge cases: a null text, or one without a letter, is `und` with score 0; letters that no sample has are a phrase each;
ties go to the language first in the alphabet; with no labelled row every language is `und`; with one language the score
is 1; repeated rows are scored alike; an empty table gives no rows; other columns pass unchanged, but for own ones by the names lang_pred
and lang_score, which give way to the new ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viatica.llm.base import fold, kept, others, slices, table, task

BLOCK = 512
NARROW = 96  # symbols of a language whose steps stand in a full table


def training_sample(docs: DataFrame, rows: int = 96, stretch: int = 4000, chars: int = 40_000, languages: int = 1024, total: int = 1_600_000) -> dict[str, str]:
    """Text by language, of bounded size."""
    labelled = docs.filter("lang is not null and text is not null and length(text) > 0")
    used = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang").collect()
    each = min(chars, total // max(1, len(used)))
    stretch = min(stretch, each)
    size, h = F.length("text"), F.xxhash64("doc_id", F.lit(4))
    first = F.pmod(h, F.greatest(size - stretch + 1, F.lit(1))) + 1
    own = labelled.select("lang", h.alias("h"), F.substr("text", first.cast("int"), F.lit(stretch)).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    ranked = own.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows)  # cut to `rows` a language before the shuffle
    so_far = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = ranked.withColumn("so_far", so_far).filter(F.col("so_far") <= each + 1).filter(F.col("lang").isin([r[0] for r in used]))
    found: dict[str, list[str]] = {}
    for lang, text in fits.orderBy("lang", "n").select("lang", "text").collect():
        found.setdefault(lang, []).append(text)
    return {lang: "\n".join(texts) for lang, texts in found.items()}


class Symbols:
    """Code points as symbols: 0 is no letter, every letter of a sample has its own, then one for letters that no sample has, then the filling of blocks."""

    def __init__(self, samples: dict[str, str]):
        letters = sorted({x[:1] for text in samples.values() for x in map(str.lower, set(text)) if x[:1].isalpha()})
        self.other, self.fill = len(letters) + 1, len(letters) + 2
        self.kind = np.uint8 if self.fill < 256 else np.int32
        own = {letter: n + 1 for n, letter in enumerate(letters)}
        self.of = np.zeros(0x110000, self.kind)
        for point in range(0x110000):
            letter = chr(point)
            if letter.isalpha():
                self.of[point] = own.get(letter.lower()[:1], self.other)

    def coded(self, text: str) -> np.ndarray:
        return self.of[code_points(text)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class Table:
    """The greedy parse as a table: for state and symbol, twice the next state's row start, plus 1 if a phrase ends there and this symbol begins a new one.

    Blocks and states are given by own columns: the symbols of the sample, then one for any other, then the filling, at which a state stays.
    """

    def __init__(self, step: list[dict[int, int]], fill: int):
        self._columns(step, fill)
        used = list(self.used)
        start = np.zeros(self.width, np.int64)
        start[self.column[used]] = [step[0][c] * self.width for c in used]
        out = np.empty((len(step), self.width), np.int32)
        out[:] = start << 1 | 1
        out[:, -1] = np.arange(len(step)) * self.width << 1
        state = np.repeat(np.arange(len(step)), [len(x) for x in step])
        symbol = self.column[np.fromiter((c for x in step for c in x), np.int64)]
        out[state, symbol] = np.fromiter((t for x in step for t in x.values()), np.int64) * self.width << 1
        out[0, :-1] |= 1  # at the start, any symbol begins a phrase
        self.steps = out.ravel()

    def _columns(self, step: list[dict[int, int]], fill: int) -> None:
        self.used = sorted(step[0])
        self.width = len(self.used) + 2
        self.column = np.full(fill + 1, len(self.used), np.uint8 if self.width <= 256 else np.int32)
        self.column[self.used] = np.arange(len(self.used))
        self.column[fill] = len(self.used) + 1

    def run(self, columns: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases begun, last state) of blocks, given by column, parsed from these states."""
        state, count = state << 1, np.zeros(len(state), np.int32)
        for symbol in columns:
            state >>= 1
            state += symbol
            state = self.steps.take(state)
            count += state & 1
        return count, state >> 1

    def rerun(self, columns: np.ndarray, blocks: np.ndarray, old: np.ndarray, new: np.ndarray, every: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases more than from the old states, blocks that end in another state, that state) of blocks parsed from new states."""
        more = np.zeros(len(blocks), np.int32)
        at, own = np.arange(len(blocks)), blocks
        for start in range(0, len(columns), every):
            part = columns[start : start + every, own]
            before, old = self.run(part, old)
            after, new = self.run(part, new)
            more[at] += after - before
            apart = old != new
            at, own, old, new = at[apart], own[apart], old[apart], new[apart]
            if not len(at):
                break
        return more, own, new

    def phrases(self, columns: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases begun in each block; follows tells the blocks that go on from the one before."""
        columns = self.column[columns]
        start = np.zeros(columns.shape[1], np.int32)
        count, end = self.run(columns, start)
        while True:
            again = np.flatnonzero(follows & (np.r_[0, end[:-1]] != start))
            if not len(again):
                return count
            true = end[again - 1]
            more, changed, state = self.rerun(columns, again, start[again], true)
            count[again] += more
            start[again] = true
            end[changed] = state


class Hashed(Table):
    """The same parse by a hash table of the steps that stay in the sample, keyed by state and symbol: a language of very many letters has few steps a state."""

    def __init__(self, step: list[dict[int, int]], fill: int):
        self._columns(step, fill)
        state = np.repeat(np.arange(len(step), dtype=np.int64), [len(x) for x in step])
        symbol = self.column[np.fromiter((c for x in step for c in x), np.int64)].astype(np.int64)
        keys, to = state * self.width + symbol, np.fromiter((t for x in step for t in x.values()), np.int32)
        self.bits = int(4 * len(keys)).bit_length()
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self._place(keys)
        while len(keys):  # each free place takes one of the keys that want it; the others look at the next place
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            taken = free[one]
            self.keys[at[taken]], self.to[at[taken]] = keys[taken], to[taken]
            rest = np.ones(len(keys), bool)
            rest[taken] = False
            keys, to, at = keys[rest], to[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.start = np.zeros(self.width, np.int32)
        self.start[self.column[self.used]] = [step[0][c] for c in self.used]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """Where each key leads, -1 if it is not there."""
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.to[at], -1)
        live = np.flatnonzero((there != keys) & (there >= 0))
        while len(live):
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[live]]
            hit = there == keys[live]
            out[live[hit]] = self.to[at[live[hit]]]
            live = live[~hit & (there >= 0)]
        return out

    def run(self, columns: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state, count = state.astype(np.int32), np.zeros(len(state), np.int32)
        for symbol in columns:
            filling = symbol == self.width - 1
            to = self._found(state.astype(np.int64) * self.width + symbol)
            begins = ((to < 0) | (state == 0)) & ~filling
            state = np.where(filling, state, np.where(to < 0, self.start[symbol], to)).astype(np.int32)
            count += begins
        return count, state


def parser(step: list[dict[int, int]], fill: int) -> Table:
    return (Table if len(step[0]) <= NARROW else Hashed)(step, fill)


class Model:
    def __init__(self, samples: dict[str, str]):
        self.symbols = Symbols(samples)
        self.languages = sorted(samples)
        coded = [self.symbols.coded(samples[x]) for x in self.languages]
        self.tables = [parser(automaton(x.tolist()), self.symbols.fill) for x in coded]
        self.bits = np.array([math.log2(max(2, len(x))) for x in coded])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (texts x languages) and letters of each text."""
        coded = [self.symbols.coded(x) for x in texts]
        sizes = np.array([len(x) for x in coded], np.int64)
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        grid = np.full((int(blocks.sum()), BLOCK), self.symbols.fill, self.symbols.kind)
        flat = grid.reshape(-1)
        for at, x in zip((first * BLOCK).tolist(), coded, strict=True):
            flat[at : at + len(x)] = x
        letters = np.array([np.count_nonzero(x) for x in coded], np.int64)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        columns = np.ascontiguousarray(grid.T)
        owner = np.repeat(np.arange(len(texts)), blocks)
        follows = np.r_[False, owner[1:] == owner[:-1]][: len(owner)]
        for n, table_ in enumerate(self.tables):
            out[:, n] = np.bincount(owner, table_.phrases(columns, follows), len(texts)).astype(np.int64)
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        counts, letters = self.phrases(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = counts * self.bits
        best = cost.argmin(1)
        sure = np.ones(len(texts))
        if len(self.languages) > 1:
            two = np.partition(cost, 1, 1)
            sure = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
        named = letters > 0
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), named.tolist(), strict=True)], np.where(named, sure, 0.0).clip(0, 1)


def _found(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """(d, text, lang_pred, lang_score): d holds the other columns of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # no more than `total` characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        model = kept(("language", hash(tuple(sorted(own.items())))), lambda: Model(own))
        for batch in slices(batches, "text", 2 << 20):
            lang, score = model.predict([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("text"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["d", "text", "lang_pred", "lang_score"])

    rows = docs.select(others(docs, "text").alias("d"), "text")
    return rows.mapInArrow(task(run), f"d {rows.schema['d'].dataType.simpleString()}, text string, lang_pred string, lang_score double")


def _own(column: str) -> Column:
    return F.col(column) if column == "text" else F.col(f"d.`{column}`").alias(column)


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """All columns of docs with lang_pred and lang_score."""
    return _found(docs, samples).select(*[_own(c) for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")], "lang_pred", "lang_score")


def with_language(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """docs with the predicted language as `lang`, without the rows that have no letter. Without samples, `lang` stays as it is."""
    if not samples:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = _found(docs, samples).filter("lang_pred <> 'und'")
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else _own(c) for c in docs.columns])


def learn(docs: DataFrame) -> dict[str, str]:
    """From rows that are not held out."""
    return training_sample(docs.filter(fold("doc_id", 3) != 1))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", (F.coalesce(fold("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
