"""Words of many texts at once, as numpy arrays of hashes. No word becomes a Python object."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_MASK = (1 << 64) - 1
#: Texts are taken together up to this many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * step) | np.uint64(1)


_BYTE = constants(256, 1)
_BASE = int(constants(1, 2)[0])
_powers = {_BASE: np.ones(1, np.uint64), pow(_BASE, -1, 1 << 64): np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64."""
    if len(_powers[base]) < n:
        all_ = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
        all_[0] = 1
        _powers[base] = np.multiply.accumulate(all_)
    return _powers[base][:n]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: ``offsets`` delimits each text's words."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        encoded = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
        self.raw = b"\n".join(encoded) + b"\n"
        if lower:
            self.raw = self.raw.lower()  # bytes: A-Z only
        data = np.frombuffer(self.raw, np.uint8)
        lengths = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
        self.text_at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.offsets = np.searchsorted(self.start, self.text_at)
        self._data = data
        self._sums = None

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first ``prefix`` bytes (0 where a word is not longer)."""
        if self._sums is None:
            sums = _BYTE[self._data] * _power(_BASE, len(self._data))
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sums, dtype=np.uint64)])
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        inverse = _power(pow(_BASE, -1, 1 << 64), len(self._data))
        h = mix((self._sums[end] - self._sums[self.start]) * inverse[self.start] + (end - self.start).astype(np.uint64))
        return h if prefix is None else np.where(self.end - self.start > prefix, h, np.uint64(0))

    def kept(self, text: int, keep: np.ndarray) -> bytes:
        """The words of one text that ``keep`` marks, joined by one space."""
        a, b = self.offsets[text], self.offsets[text + 1]
        return b" ".join(self.raw[s:e] for s, e in zip(self.start[a:b][keep], self.end[a:b][keep], strict=True))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries; runs across texts are among them and have to be left out by position."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * factor + hashes[j : n + j]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def batches(frames: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """The frames in pieces whose texts have at most CHUNK_BYTES characters together, or one row."""
    for frame in frames:
        if not len(frame):
            continue
        size = frame[column].str.len().fillna(0).to_numpy(np.int64).cumsum() // CHUNK_BYTES
        cuts = np.flatnonzero(np.diff(size)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
            yield frame.iloc[a:b]
