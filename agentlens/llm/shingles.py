"""Words and word shingles of a text as 64-bit numbers, for the operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers made from a seed."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class Words(dict):
    """Hashes of words; forgets all when it holds ``limit``, so a worker's memory stays bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """One hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Bytes of text whose words are hashed at a time, and of a word that is hashed by itself.
PIECE_BYTES, LONG_WORD = 1 << 16, 64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = constants(256, 7)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BYTES[_WHITE] = 0


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE_BYTES + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C1B
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each word ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, A-Z lower-cased, and where it begins, without a
    look-up for each word: a polynomial over a number for each byte, as a difference of running sums. Long words, which
    such sums may confuse, are hashed by themselves. The numbers are other ones than those of ``Words``."""
    data, out, begin = np.frombuffer(raw, np.uint8), [], 0
    while begin < len(data) or not out:
        end = min(len(data), begin + PIECE_BYTES)
        if end < len(data):
            white = np.flatnonzero(_WHITE[data[begin:end]])
            # A word that fills the piece goes on to the next white space.
            while not len(white) and end < len(data):
                begin_, end = end, min(len(data), end + PIECE_BYTES)
                white = np.flatnonzero(_WHITE[data[begin_:end]]) + begin_ - begin
            end = begin + int(white[-1]) + 1 if len(white) else end
        words, starts = _hashed(data[begin:end])
        out.append((words, starts + begin))
        begin = end
    return out[0] if len(out) == 1 else tuple(map(np.concatenate, zip(*out, strict=True)))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = _WHITE[data]
    edges = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    if len(data) <= PIECE_BYTES:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _UP[: len(data)], out=sums[1:])
        out = mixed((sums[ends] - sums[starts]) * _DOWN[starts])
        long = np.flatnonzero(ends - starts > LONG_WORD).tolist()
    else:
        long = range(len(starts))
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes().lower())
    return out, starts


def together(texts: Iterable[str | None], size: int = 5) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Shingles of consecutive texts of about PIECE_BYTES (a longer one stands alone) as one sequence, and for each text
    from where to where its own go there. Those across two texts belong to none; texts of fewer than ``size`` words have none."""

    def made(raws: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        words, starts = hashed(b"\n".join(raws))
        begins = np.cumsum([0, *(len(x) + 1 for x in raws)])
        at = np.searchsorted(starts, begins)
        all_ = shingled(words, size) if len(words) >= size else words[:0]
        return all_, [(a, max(a, b - size + 1)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    held, n = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and n + len(raw) + 1 > PIECE_BYTES:
            yield made(held)
            held, n = [], 0
        held.append(raw)
        n += len(raw) + 1
    if held:
        yield made(held)


def sequences(texts: Iterable[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """The shingles of each text, as ``together`` makes them."""
    for all_, spans in together(texts, size):
        for lo, hi in spans:
            yield all_[lo:hi]


def shingled(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each place of ``size`` consecutive words; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    if len(words) < size:
        return shingled(np.concatenate([words, np.full(size - len(words), len(words), np.uint64)]), size)
    n, k = len(words) - size + 1, constants(size, 5)
    out = words[:n] * k[0]
    for i in range(1, size):
        out = out + mixed(words[i : i + n] + k[i]) * k[i]
    return mixed(out)
