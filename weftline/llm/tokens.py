"""Byte-level BPE ids of whole columns.

The library `tokenizers` spends most of its time on pieces (words with their leading space) that
it has met before. Here NumPy cuts all texts of a block into pieces by the vocabulary's own
pattern, looks them up in a bounded table, and gives only new pieces to `tokenizers`. Texts with
characters from U+3000 on, or with the string of an added token (such as <|endoftext|>, which the library takes as that
token), go to it whole. Ids are equal to those of the library (tested).
"""

from __future__ import annotations

import os

import numpy as np

from .common import Slots, blocks, mix, ragged, _power

OTHER, LETTER, NUMBER, SPACE = range(4)
_FROM = 0x3000
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
#: Pieces, and ids in them, that one Python worker remembers at most.
REMEMBER = 1_000_000


class Bpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        every = "".join(map(chr, range(_FROM)))
        self.kind = np.zeros(_FROM + 1, np.uint8)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
            self.kind[[m.start() for m in regex.finditer(pattern, every)]] = kind
        self.kind[_WHITE] = SPACE
        self.code = mix(np.arange(1, _FROM + 2, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        self.forget()

    def forget(self) -> None:
        self.slots, self.pool = Slots(), np.zeros(1 << 16, self.dtype)
        self.at, self.size, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and for each text, and once more at the end, the ids before it."""
        ids, counts = [], []
        for i, j in blocks(offsets):
            a, b = self._block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(a)
            counts.append(b)
        flat = np.concatenate(ids) if ids else np.zeros(0, self.dtype)
        sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return flat, np.concatenate([[0], np.cumsum(sizes)])

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        got = [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        try:
            text = data.tobytes().decode()
        except UnicodeDecodeError:
            return self._whole(data, offsets)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        if not len(points):
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        added = [t.encode() for t in self.added if t in text]
        if points.max() >= _FROM or added:
            far = np.add.reduceat(np.append(points >= _FROM, False), before[:-1]) * (np.diff(before) > 0) > 0
            if added:
                far |= [any(t in data[a:b].tobytes() for t in added) for a, b in zip(offsets[:-1], offsets[1:])]
            if far.any():
                return self._mixed(data, offsets, far)
        starts = self._starts(points, before)
        first = np.searchsorted(starts, before)
        ends = np.append(starts[1:], len(points))
        up, down = _power(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.code[points] * up[: len(points)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        which = self.slots.find(hashes)
        new = np.flatnonzero(which < 0)
        if len(new):
            distinct, where = np.unique(hashes[new], return_index=True)
            if self.slots.n + len(distinct) > REMEMBER:
                self.forget()
                distinct, new = np.unique(hashes, return_index=True)
            else:
                new = new[where]
            self._learn(distinct, [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            which = self.slots.find(hashes)
        sizes = self.size[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.pool[ragged(self.at[which], sizes)], np.diff(total[first])

    def _mixed(self, data, offsets, far) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(far)) + 1, [len(far)]])
        for i, j in zip(cuts[:-1], cuts[1:]):
            a, b = (self._whole if far[i] else self._block)(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(a)
            sizes.append(b)
        return np.concatenate(ids), np.concatenate(sizes)

    def _starts(self, points: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where pieces start. A piece is a contraction ('s 't 're 've 'm 'll 'd), or a run of letters,
        of numbers or of others, each with one space before it, or white space: all of it at the end
        of a text, else all but its last character, which stands alone or goes to the next run."""
        n, kind = len(points), self.kind[points]
        edge = np.zeros(n + 1, bool)
        edge[before] = True
        new = edge[:n].copy()
        new[1:] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(new)
        ends = np.append(runs[1:], n)
        followed = (kind[runs] == SPACE) & ~edge[ends]
        last = ends[followed] - 1
        new[last] = True
        new[last[points[last] == 32] + 1] = False
        quote = runs[(points[runs] == 39) & (ends - runs == 1) & ~edge[ends] & new[runs]]
        quote = quote[kind[quote + 1] == LETTER]
        if len(quote):
            padded = np.append(points, [0, 0])
            one, two = padded[quote + 1], padded[quote + 2]
            two = np.where(edge[np.minimum(quote + 2, n)], 0, two)
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            for some, k in ((quote[single], 2), (quote[double], 3)):
                new[some + 1] = False
                rest = some + k
                rest = rest[(rest < n) & ~edge[np.minimum(rest, n)]]
                new[rest[kind[rest] == LETTER]] = True
        return np.flatnonzero(new)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), self.dtype, int(sizes.sum()))
        n, m = self.slots.n, self.slots.n + len(got)
        if m > len(self.at):
            self.at, self.size = (np.resize(x, 2 * m) for x in (self.at, self.size))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(flat)))
        self.at[n:m] = self.used + np.cumsum(sizes) - sizes
        self.size[n:m] = sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.slots.add(hashes)


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
