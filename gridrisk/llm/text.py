"""Tokens and shingles of byte strings inside Arrow tasks, vectorised with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Hashes(dict):
    """64-bit hashes of words, remembered; forgotten when there are too many."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width consecutive word hashes, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = (out * GOLD) + (hashes[k : k + n] ^ (out >> np.uint64(29)))
        return mixed(out)


#: Bytes that part words, and a random odd number for every other byte, the same for A to Z as for a to z.
BLANK_BYTES = np.zeros(256, bool)
BLANK_BYTES[[9, 10, 11, 12, 13, 32]] = True
with np.errstate(over="ignore"):
    BYTE_VALUES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLD) | np.uint64(1)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, GOLD)]))


def hashed_words(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts that lie one after another in raw, text k from cuts[k] to cuts[k + 1], and
    how many words each has. A word's hash is a polynomial of its bytes' values modulo 2**64, mixed with its length."""
    at = np.flatnonzero(~BLANK_BYTES[raw])
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(cuts) - 1, np.int64)
    first = np.concatenate([[True], at[1:] != at[:-1] + 1])
    heads = np.searchsorted(at, cuts[:-1])
    first[heads[heads < len(at)]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(starts, append=len(at))
    inside = np.arange(len(at)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(BYTE_VALUES[raw[at]] * _powers(int(lengths.max()))[inside], starts)
        hashes = mixed(sums + lengths.astype(np.uint64) * GOLD)
    return hashes, np.diff(np.searchsorted(at[starts], cuts))


def shingle_sets(texts: pa.Array, width: int = 5, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, null texts being empty; fewer than width words make one shingle,
    none make none. Texts are hashed together in blocks of about so many bytes."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + block, side="right")) - 1)
        hashes, counts = hashed_words(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        runs = windows(hashes, width)
        for stop, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            yield np.unique(runs[stop - n : stop - width + 1]) if n >= width else windows(hashes[stop - n : stop], n) if n else np.empty(0, np.uint64)
        start = end


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A to Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
