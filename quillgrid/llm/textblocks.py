"""Vectorised splitting and hashing of texts: numpy over whole blocks, no Python step per word.

A word's hash is the sum over its bytes of a random number of the byte times a random
number of its place, modulo 2**64, so no pattern of bytes cancels as it does in a
polynomial with a wrapping modulus; a sequence's hash joins those of its halves with a
mixing step each time.  Memory follows the block, and a huge text is hashed in pieces
that end at separators, so it follows the text's words and not eight times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are handled at once, and of which the words are hashed at once.
BLOCK, PIECE = 1 << 20, 1 << 18

_SEQ = 0xD1342543DE82EF95 | 1
_PLACES: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbered(n: int, salt: int) -> np.ndarray:
    """Fixed random numbers for 0 to n - 1."""
    return mix(mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) ^ U(salt)))


def places(n: int) -> np.ndarray:
    """The random numbers of places in a word, for n places at least."""
    if not _PLACES or len(_PLACES[0]) < n:
        made = numbered(max(n, 1 << 12), 0x94D049BB133111EB)
        if len(made) > 1 << 16:  # for one huge word only
            return made
        _PLACES[:] = [made]
    return _PLACES[0]


def sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the words values[a:b] (not empty, in order, apart), from the random numbers of their characters."""
    start = np.zeros(len(values), dtype=np.int32)
    start[a] = a
    np.maximum.accumulate(start, out=start)
    at = np.arange(len(values), dtype=np.int32)
    at -= start
    del start
    longest = int((b - a).max()) if len(a) else 0
    np.minimum(at, max(longest - 1, 0), out=at)  # between words
    total = np.empty(len(values) + 1, dtype=U)
    total[0] = 0
    np.cumsum(values * places(longest or 1)[at], out=total[1:])
    return mix((total[b] - total[a]) ^ (b - a).astype(U) << U(48))


def _separators(kind: str) -> np.ndarray:
    """True for bytes that end words; fixed by each query's definition of a word."""
    sep = np.zeros(256, dtype=bool)
    if kind == "space":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    else:  # words of letters and digits, after A-Z are lower-cased; bytes from 0x80 belong to words
        sep[:0x80] = True
        sep[0x30:0x3A] = False
        sep[0x61:0x7B] = False
    return sep


SEPARATORS = {k: _separators(k) for k in ("space", "alnum")}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BYTES = numbered(256, 0xC2B2AE3D27D4EB4F)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of an Arrow string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, off - off[0]


def runs(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def _piece(data: np.ndarray, starts: np.ndarray, sep: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if lower:
        data = LOWER[data]
    word = ~sep[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inside = starts[starts < len(data)]
    first[inside] = word[inside]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = inside[inside > 0] - 1
    last[before] = word[before]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return sums(BYTES[data], a, b), a, b


def words(data: np.ndarray, offsets: np.ndarray, kind: str, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word, and the n+1 word offsets of the documents."""
    sep = SEPARATORS[kind]
    if len(data) <= 2 * PIECE:
        h, a, b = _piece(data, offsets[:-1], sep, lower) if len(data) else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    else:  # cut where a separator stands
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            step = PIECE
            while end < len(data):
                look = sep[LOWER[data[end : end + step]] if lower else data[end : end + step]]
                if look.any():
                    end += int(look.argmax())
                    break
                end = min(len(data), end + step)
            inside = offsets[(offsets >= at) & (offsets < end)] - at
            h, a, b = _piece(data[at:end], inside, sep, lower)
            parts.append((h, a + at, b + at))
            at = end
        h, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, a, b, np.searchsorted(a, offsets, "left")


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` word hashes (ignoring where documents end), by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, size, power = None, 0, 1, h
    while True:
        if length & size:
            part = power[done : done + n]
            out = part if out is None else mix(out * U(_SEQ) + part)
            done += size
        if done == length:
            return mix(out ^ U(length * 0x9E3779B9))
        power = mix(power[:-size] * U(_SEQ) + power[size:])
        size *= 2


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each word its document's number."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def whole(offsets: np.ndarray, length: int, n: int) -> np.ndarray:
    """For each window start below ``n`` whether the window ends inside its document."""
    doc = owner(offsets)[:n]
    return np.arange(n) + length <= offsets[1:][doc]


def equal(values: np.ndarray, a: np.ndarray, b: np.ndarray, where: np.ndarray, back: np.ndarray) -> bool:
    """Whether each word values[a:b] is the one that stands for it, word where[back]; words follow each other without gaps."""
    of = where[back]
    size = b - a
    if not np.array_equal(size, size[of]):
        return False
    place = np.repeat((a[of] - a).astype(np.int32), size)
    place += np.arange(int(a[0]), int(b[-1]), dtype=np.int32) if len(a) else np.zeros(0, np.int32)
    return bool(np.array_equal(values[place], values[a[0] : b[-1]])) if len(a) else True


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind) if kind else pa.array(values))
