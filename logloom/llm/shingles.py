"""Word shingles and their sketches over Arrow buffers, a batch at a time.

Words are runs of other than ASCII white space, with A-Z as a-z.  A word's
hash comes from running sums over the whole buffer, so no word becomes a Python
object; a shingle's hash combines its words' hashes to 64 bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(_INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
STEP = 1 << 20  # bytes hashed at once; a longer text is hashed by itself


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_of(raw: np.ndarray, ends: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first byte of every word, a run without separators;
    ``ends`` are the documents' ends."""
    word = ~separators[raw]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    inner = ends[:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begin[inner] = word[inner]  # a word ends with its document
    stop[inner - 1] = word[inner - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    up, down = _POWERS.upto(len(raw))
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_FOLDED[raw] * up, out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U) * _U(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(ends, first, side="right"), first


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int):
    """Yield each document's sorted distinct shingle hashes, in order.

    With fewer than ``k`` words the whole sequence is one shingle; without
    words the set is empty."""
    n, i = len(offsets) - 1, 0
    weights = mix(np.arange(1, k + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
        hashes, doc, _ = words_of(raw[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i])
        bounds = np.searchsorted(doc, np.arange(j - i + 1))
        rolled = np.zeros(max(len(hashes) - k + 1, 0), _U)
        for shift in range(k):
            rolled += hashes[shift : shift + len(rolled)] * weights[shift]
        rolled = mix(rolled)
        for d in range(j - i):
            a, b = int(bounds[d]), int(bounds[d + 1])
            if b - a >= k:
                s = np.sort(rolled[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                few = (hashes[a:b] * weights[: b - a]).sum(keepdims=True, dtype=_U)
                yield mix(few + _U((b - a) * _BASE % (1 << 64)))
            else:
                yield np.zeros(0, _U)
        i = j


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    two = [mix(s + _U(0x632BE59BD9B4E019)).sum(dtype=_U), mix(s ^ _U(0x9FB21C651E98DF25)).sum(dtype=_U)]
    return mix(np.array(two, _U) ^ _U(len(s))).tobytes()


def fast_similarity_sketch(s: np.ndarray, t: int, seeds: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of ``t`` coordinates.

    In each of the first ``t`` rounds every element falls into one bin with a
    value; an earlier round beats a later one, so rounds end as soon as all bins
    are filled, for sets of more than ``t log t`` elements mostly after the
    first or second.  Round ``t + i`` throws all elements into bin ``i``, so no
    coordinate stays empty.  Coordinates agree with the probability of the
    sets' similarity, and their number concentrates as with independent ones."""
    empty = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, empty)
    low = _U(0xFFFFFFFF)
    for r in range(2 * t):
        h = mix(s ^ seeds[r])
        value = (h & low) | (_U(r) << _U(32))
        if r < t:
            bins = ((h >> _U(32)) * _U(t)) >> _U(32)
            np.minimum.at(out, bins.astype(np.intp), value)
        else:
            out[r - t] = min(out[r - t], value.min())
        if (out != empty).all():
            break
    return out


def sketch_seeds(t: int) -> np.ndarray:
    return mix(np.arange(1, 2 * t + 1, dtype=_U) * _U(0xE7037ED1A0B428DB))


def band_hashes(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band is part of it."""
    bands = sketch.reshape(-1, rows)
    keys = np.arange(1, len(bands) + 1, dtype=_U) * _U(_BASE)
    for c in range(rows):
        keys = mix(keys + bands[:, c])
    return keys.view(np.int64)
