"""Token ids of whole texts by a public tokenizer file, with one search per distinct piece of text between white space."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from viatica.llm.base import kept

WORD_BPE = "word_bpe_49k.json"


def vocabulary(name: str = WORD_BPE) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PairMerger:
    """Byte-pair merging of many short pieces at once.

    Every piece is a row of symbols; each round merges in every row its leftmost pair of least rank, as the tokenizer does
    in one piece, until no row has a pair left. Pairs are looked up in two hash tables of which each pair stands in one.
    """

    SLOTS = 1 << 18
    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.keys = np.full((2, self.SLOTS), -1, np.int64)
        self.rank = np.full((2, self.SLOTS), self.NONE, np.int32)
        self.made = made
        homes = [self._slot(keys, i).tolist() for i in (0, 1)]
        at: list[dict[int, int]] = [{}, {}]
        for n in range(len(keys)):
            side, moved = 0, n
            for _ in range(500):  # a pair that finds its slot taken sends the other to its second table
                slot = homes[side][moved]
                moved, at[side][slot] = at[side].get(slot), moved
                if moved is None:
                    break
                side = 1 - side
            else:
                raise ValueError("the pair tables are too small for this vocabulary")
        for side in (0, 1):
            slots = np.fromiter(at[side].keys(), np.int64, len(at[side]))
            which = np.fromiter(at[side].values(), np.int64, len(at[side]))
            self.keys[side, slots], self.rank[side, slots] = keys[which], which

    def _slot(self, keys: np.ndarray, side: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(self.MULTIPLIERS[side])) >> np.uint64(46)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        out = np.full(keys.shape, self.NONE, np.int32)
        for side in (0, 1):
            slot = self._slot(keys, side)
            hit = self.keys[side, slot] == keys
            out[hit] = self.rank[side, slot[hit]]
        return out

    def __call__(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; none is empty."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        for start in range(0, len(order), 8_000):
            rows = order[start : start + 8_000]
            self._merge([pieces[i] for i in rows], sizes[rows], rows, out)
        return out

    def _merge(self, pieces: list[bytes], sizes: np.ndarray, rows: np.ndarray, out: list[np.ndarray]) -> None:
        n, width = len(pieces), int(sizes[-1])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        inside = np.arange(width) < sizes[:, None]
        symbols = np.zeros((n, width), np.int64)
        symbols[inside] = self.inner[flat]
        symbols[np.arange(n), sizes - 1] = self.last[flat[np.cumsum(sizes) - 1]]
        length = sizes.copy()
        ranks = np.full((n, width), self.NONE, np.int32)
        both = np.arange(width - 1) < (length - 1)[:, None]
        ranks[:, :-1][both] = self._ranks(symbols[:, :-1][both], symbols[:, 1:][both])
        columns = np.arange(width)
        while n:
            at = ranks.argmin(1)
            line = np.arange(n)
            best = ranks[line, at]
            done = best == self.NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[rows[i]] = symbols[i, : length[i]].copy()
                go = ~done
                symbols, ranks, rows, length, at, best = symbols[go], ranks[go], rows[go], length[go], at[go], best[go]
                n = len(rows)
                line = np.arange(n)
                if not n:
                    break
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            length -= 1
            symbols[line, at] = self.made[best]
            ranks[line, at] = self.NONE
            right = np.flatnonzero(at + 1 < length)
            ranks[right, at[right]] = self._ranks(symbols[right, at[right]], symbols[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranks(symbols[left, at[left] - 1], symbols[left, at[left]])
            keep = int(length.max())
            if keep < width:
                symbols, ranks, width = symbols[:, :keep], ranks[:, :keep], keep
                columns = np.arange(width)


class _Numbers(dict):
    """Gives each new piece the next number; the encoder fills in its ids afterwards. Counts the bytes of all pieces."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.size = 0

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        self.size += len(piece)
        return n


class PieceEncoder:
    """Encodes UTF-8 texts to ids.

    The tokenizer must drop white space and never join text across it (as word_bpe_49k does; another is refused): then the ids of a text
    are those of its pieces between ASCII white space, one after another, and equal pieces have equal ids. Ids of up to
    `limit` pieces of `most` bytes together are remembered; beyond that the rarer and the longer ones are forgotten before the next texts, so memory is bounded whatever the corpus holds.
    Strings of special tokens in a text are ordinary text.
    """

    LONG = 64  # bytes of a piece that is not remembered past its batch if memory is short

    def __init__(self, path: str, limit: int = 600_000, most: int = 32 << 20):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit, self.most = limit, most
        alone = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("Ab,", "cd9", "\u00e9")]
        if self.tokenizer.encode(" Ab,  cd9\n\t\u00e9 ", add_special_tokens=False).ids != sum(alone, []):
            raise ValueError(f"{path}: its ids of a text are not those of the pieces between white space")
        model = json.loads(Path(path).read_text())
        kinds = [x.get("type") for x in model["pre_tokenizer"].get("pretokenizers", [])]
        self.merger = PairMerger(model["model"]) if kinds == ["Split", "ByteLevel"] else None
        self.split = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall if self.merger else None
        self.words: dict[str, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbers()
        self.first = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.hits = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces seen most often, half the limit at most, and none that is long."""
        self.words.clear()
        seen = np.sort(self.hits)[::-1]
        least = max(2, int(seen[min(len(seen) - 1, self.limit // 2)]) + 1)
        names = list(self.numbers)
        stay = np.flatnonzero((self.hits >= least) & (np.fromiter(map(len, names), np.int64, len(names)) <= self.LONG))
        lengths = np.diff(self.first)[stay]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.first[stay] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self._reset()
        for i in stay.tolist():
            self.numbers[names[i]] = len(self.numbers)
            self.numbers.size += len(names[i])
        self.first, self.flat, self.hits = np.r_[0, ends], flat, np.zeros(len(stay), np.int64)

    def _by_library(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids(self, new: list[bytes]) -> list[bytes]:
        """32-bit ids of new pieces. Pieces of European letters go through the merger, as they are the same whatever the Unicode version; others through the library."""
        texts = [x.decode("utf-8", "replace") for x in new]
        plain = [self.merger is not None and (x.isascii() or max(x) < "\u0250" and "\u0130" not in x) and len(x) <= 60 for x in texts]
        out = [b""] * len(new)
        rest = [i for i, p in enumerate(plain) if not p]
        for i, ids in zip(rest, self._by_library([texts[i] for i in rest]), strict=True):
            out[i] = ids
        split = {i: self.split(texts[i].lower()) for i, p in enumerate(plain) if p}
        if len(self.words) > self.limit // 2:
            self.words.clear()
        unseen = list({w for x in split.values() for w in x} - self.words.keys())
        merged = self.merger([w.encode() for w in unseen]) if unseen else []
        self.words.update((w, ids.astype("<u4").tobytes()) for w, ids in zip(unseen, merged, strict=True))
        for i, x in split.items():
            out[i] = b"".join([self.words[w] for w in x])
        return out

    def _learn(self) -> None:
        if not self.numbers.new:
            return
        ids = self._ids(self.numbers.new)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        self.numbers.new = []

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids start (one more entry than texts)."""
        if len(self.numbers) > self.limit or self.numbers.size > self.most:
            self._forget()
        number = self.numbers.__getitem__
        parts = [np.fromiter(map(number, pieces), np.int64, len(pieces)) for pieces in (x.split() for x in texts)]
        self._learn()
        which = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        hits = np.bincount(which, minlength=len(self.numbers))
        hits[: len(self.hits)] += self.hits
        self.hits = hits
        lengths = self.first[which + 1] - self.first[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.first[which] - (ends - lengths), lengths) + np.arange(total)]
        pieces = np.cumsum([0, *map(len, parts)])
        return ids, np.concatenate([[0], ends])[pieces] if total else np.zeros(len(texts) + 1, np.int64)


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for this file, made once."""
    return kept(("encoder", path), lambda: PieceEncoder(path))
