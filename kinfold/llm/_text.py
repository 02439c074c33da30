"""Words and shingles of many texts at once, as NumPy arrays of 64-bit hashes.

A word is a run without ASCII white space of the lower-cased text. All texts
of a chunk are hashed by one pass of prefix sums over their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK_BYTES = 1 << 20
SHINGLE = 5
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES, lower: bool = True) -> Iterator[tuple[int, list[bytes]]]:
    """Index of the first text and the (lower-cased) UTF-8 of texts, of about ``limit`` bytes or one text together."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = ((t or "").lower() if lower else t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


def words(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, offsets of each text's words, starts and ends of the words in the joined bytes, and those bytes."""
    data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    edge = np.diff(np.concatenate(([True], blank[data])).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    table = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    power = np.full(len(data) + 1, 0x5851F42D4C957F2D, _U)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(len(data) + 1, pow(0x5851F42D4C957F2D, -1, 1 << 64), _U)
    back[0] = 1
    back = np.cumprod(back)
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum(table[data] * power[:-1], out=prefix[1:])
    hashes = mix64((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(_U))
    sizes = np.fromiter((len(b) + 1 for b in held), np.int64, len(held))
    offsets = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return hashes, offsets, starts, ends, data


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``n`` words in a row and offsets of each text's; a text of fewer words has one shingle of them all."""
    counts = np.diff(offsets)
    out = np.zeros(max(len(hashes) - n + 1, 0), _U)
    odd = [_U(int(x) | 1) for x in mix64(np.arange(11, 11 + n, dtype=_U))]
    for k in range(n):
        out += hashes[k : k + len(out)] * odd[k]
    out = mix64(out)
    many = np.maximum(counts - n + 1, 0)
    each = np.where((counts > 0) & (counts < n), 1, many)
    ends = np.cumsum(each)
    result = np.empty(int(ends[-1]) if len(ends) else 0, _U)
    owner = np.repeat(np.arange(len(counts)), each)
    at = np.arange(len(result)) - np.repeat(ends - each, each) + np.repeat(offsets[:-1], each)
    long = counts[owner] >= n
    result[long] = out[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        few = hashes[offsets[i] : offsets[i + 1]]
        result[ends[i] - 1] = mix64((few * np.array(odd[: len(few)], _U)).sum(dtype=_U, keepdims=True) + _U(len(few)))[0]
    return result, np.concatenate(([0], ends))
