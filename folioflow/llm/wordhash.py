"""Words of an Arrow string column as arrays of 64-bit hashes, without a Python object for each word.

A word's hash mixes its length and its bytes, eight at a time. Texts are
taken in groups of about ``GROUP`` bytes, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; differences of bytes wrap, so each range is one comparison."""
    return data | (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def spaced(low: np.ndarray) -> np.ndarray:
    """Bytes of words: all but white space (0x20, 0x09-0x0D)."""
    return ~((low == 0x20) | ((low - np.uint8(9)) < 5))


def alnum(low: np.ndarray) -> np.ndarray:
    """Bytes of words: 0-9, a-z and whatever is not ASCII."""
    return ((low - np.uint8(0x30)) < 10) | ((low - np.uint8(0x61)) < 26) | (low >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: By the number of a chunk's bytes: the bits that belong to it.
_BITS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word from its length and its bytes, eight at a time."""
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    eight = np.ndarray(len(low) + 1, "<u8", padded.data, strides=(1,))
    length = ends - starts
    out = mix((eight[starts] & _BITS[np.minimum(length, 8)]) ^ (length.astype(_U) * _U(_BASE)))
    more, at = np.flatnonzero(length > 8), 8
    while len(more):
        p, left = starts[more] + at, length[more] - at
        out[more] = mix(out[more] * _U(_BASE) + (eight[p] & _BITS[np.minimum(left, 8)]))
        more, at = more[left > 8], at + 8
    return out


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def grouped(column: pa.Array, word_bytes: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of texts: the first text's row, its lower-cased bytes, the words' starts, ends and hashes,
    and the index of each text's first word (one more entry than texts)."""
    data, offsets = bytes_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
        j = min(j, n)
        at = offsets[i : j + 1] - offsets[i]
        low = lowered(data[offsets[i] : offsets[j]])
        is_word = np.zeros(len(low) + 1, bool)
        is_word[:-1] = word_bytes(low)
        before = np.zeros(len(low) + 1, bool)
        before[1:] = is_word[:-1]
        edges = at[:-1][at[:-1] < len(low)]
        before[edges] = False
        starts = np.flatnonzero(is_word & ~before)
        after = np.zeros(len(low) + 1, bool)
        after[:-1] = is_word[1:]
        inner = at[1:][(at[1:] > 0) & (at[1:] <= len(low))]
        after[inner - 1] = False
        ends = np.flatnonzero(is_word & ~after) + 1
        hashes = word_hashes(low, starts, ends)
        yield i, low, starts, ends, hashes, np.searchsorted(starts, at)
        i = j


#: Of each place in a gram, the factor of the word's hash there; from a rule: odd and mixed, so that no sums of a few of them agree, as a gram may
#: hold the same word in several places.
_PLACE = mix(np.arange(1, 65, dtype=_U) * _U(_BASE)) | _U(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (windows over text borders are the caller's to leave out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.full(n, _U(k), _U)
    for j in range(k):
        total += hashes[j : j + n] * _PLACE[j % len(_PLACE)]
    return mix(total)


def running(mask: np.ndarray) -> np.ndarray:
    """How many are true before each place, and in all."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask.view(np.int8), out=out[1:])
    return out


class Sets:
    """The shingle sets of a group of texts: of text ``first + k`` the sorted distinct tokens ``tokens[at[k]:at[k + 1]]``,
    ``n_words[k]`` words, and a set digest of 128 bits in ``low[k]`` and ``high[k]``."""

    def __init__(self, first: int, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, words_at: np.ndarray, width: int):
        n_texts, n = len(words_at) - 1, len(hashes)
        self.first, self.n_words = first, np.diff(words_at)
        valid = np.ones(n, bool)
        for j in range(1, width):
            last = words_at[1:] - j
            valid[last[last >= words_at[:-1]]] = False
        all_grams = np.zeros(n, _U)
        whole = grams(hashes, width)
        all_grams[: len(whole)] = whole
        for k in range(1, min(width, n + 1)):  # fewer words than a shingle: the whole sequence
            p = words_at[:-1][self.n_words == k]
            if len(p):
                valid[p] = True
                all_grams[p] = grams(hashes[p[:, None] + np.arange(k)].reshape(-1), k)[::k]
        before = running(valid)
        tokens, cuts = all_grams[valid], before[words_at]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                tokens[a:b].sort()
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        new[cuts[:-1][cuts[:-1] < len(tokens)]] = True
        self.tokens = tokens[new]
        self.at = running(new)[cuts]
        self.n = np.diff(self.at)
        self.low = self._sums(mix(self.tokens ^ _PLACE[7]))
        self.high = self._sums(mix(self.tokens + _PLACE[9]))
        if (single := np.flatnonzero(self.n == 1)).size:
            # one token holds 64 bits; the digest of its words holds 128
            raw = low.tobytes()
            for k in single.tolist():
                a = int(words_at[k])
                b = min(int(words_at[k + 1]), a + width)
                said = b" ".join([raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])
                d = hashlib.blake2b(said, digest_size=16).digest()
                self.low[k], self.high[k] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")

    def _sums(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x) + 1, _U)
        np.cumsum(x, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """How many tokens of each text the mask has."""
        return np.diff(running(mask)[self.at])


def shingle_sets(column: pa.Array, width: int) -> Iterator[Sets]:
    """The sets of a column's texts, a group at a time; words are what white space separates."""
    for first, low, starts, ends, hashes, at in grouped(column, spaced):
        yield Sets(first, low, starts, ends, hashes, at, width)
