"""Words and shingles of whole batches as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millrace.llm.arrow import kept, offsets

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(k: int) -> np.uint64:
    """The k-th of a fixed series of odd 64-bit numbers."""
    return mix(np.array([k + 1], np.uint64) * _ODD)[0] | np.uint64(1)


def spaces() -> np.ndarray:
    """Bytes of words that white space separates: all but space and tab to carriage return."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def signs() -> np.ndarray:
    """Bytes of words that ASCII white space, signs and controls separate."""
    return np.array([chr(b).isalnum() or b > 127 for b in range(256)])


#: Bytes of text that are hashed at once, unless one text is longer: some fifty bytes of memory go to each.
STEP = 1 << 19


def hashes(column: pa.Array, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z in lower case, and where each text's words begin; null has none."""
    at = offsets(column)
    found, begins, start, total = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0, 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(at, at[start] + STEP, side="right")) - 1)
        own, marks = _hashes(column.slice(start, end - start), word)
        found.append(own)
        begins.append(marks[1:] + total)
        start, total = end, total + len(own)
    return np.concatenate(found), np.concatenate(begins)


def _hashes(column: pa.Array, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = offsets(column)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    begins = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), begins
    where = np.flatnonzero(inside)
    heads = np.flatnonzero(first[where])
    place = where - np.repeat(starts, np.diff(np.append(heads, len(where))))
    return mix(np.add.reduceat(cells(raw[where], place), heads)), begins


#: Places of a word whose cells are kept in a table; those of longer words are computed.
PLACES = 64


def cells(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte at each place, A-Z as a-z.

    A word's hash is the sum of its cells (tabulation hashing): two words that
    differ anywhere get equal hashes by chance only, at odds of 2**64 to 1.
    """
    table = kept("cells", lambda: _cells(np.tile(np.arange(256), PLACES), np.repeat(np.arange(PLACES), 256)))
    near = place < PLACES
    if near.all():
        return table[place * 256 + byte]
    out = np.empty(len(byte), np.uint64)
    out[near] = table[place[near] * 256 + byte[near]]
    out[~near] = _cells(byte[~near], place[~near])
    return out


def _cells(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    low = byte.astype(np.uint64) + np.where((byte >= 65) & (byte <= 90), np.uint64(32), np.uint64(0))
    return mix(mix(place.astype(np.uint64) * _ODD + salt(99)) ^ (low + np.uint64(1)) * salt(98))


def shingle_sets(words: np.ndarray, begins: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; of fewer words, the whole sequence as one."""
    whole = np.zeros(0, np.uint64)
    if len(words) >= n:
        whole = mix(sum((words[k : len(words) - n + 1 + k] * salt(k) for k in range(n)), np.zeros(len(words) - n + 1, np.uint64)))
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(words[a + k]) * int(salt(k)) for k in range(b - a)) + int(salt(1000 + b - a)) & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
