"""Word and shingle hashes of many texts at once, on the bytes of an Arrow column.

Words are maximal runs of bytes other than space and \\t to \\r, after A-Z are lower-cased; all of those are single bytes in UTF-8, so no text
is decoded. A word's hash mixes eight bytes at a time into 64 bits; a shingle's is mixed from the sum of its words' hashes, mixed by place.
Two different shingles of one comparison agree with a chance of about 2^-64 for each pair.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed at once.
CHUNK = 250_000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64((seed * _BASE + _BASE) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Runs of more bytes are hashed one by one by the library.
_LONG = 64
#: The first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of each run of bytes [start, end): of its length and then of eight bytes after another; by XXH3 where it is longer than _LONG."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    h = mix(size.astype(np.uint64), 5)
    short = size <= _LONG
    live = np.flatnonzero(short & (size > 0))
    at = 0
    while len(live):
        rest = size[live] - at
        h[live] = mix(h[live] ^ (eight[starts[live] + at] & _FIRST[np.minimum(rest, 8)]))
        at += 8
        live = live[rest > 8]
    if not short.all():
        import xxhash

        for i in np.flatnonzero(~short):
            h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return h


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of True that cross no row, and the n + 1 offsets of the rows among them."""
    n = len(inside)
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 offsets of the rows among them."""
    starts, ends, rows = runs(~_SPACE[raw], offsets)
    return run_hashes(_LOWER[raw], starts, ends), rows


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for terms: maximal runs of ASCII letters, digits and bytes above 127."""
    starts, ends, rows = runs(_TERM[raw], offsets)
    return run_hashes(_LOWER[raw], starts, ends), rows


def parts_of(column, size: int = CHUNK):
    """(slice of the rows of a string column, its bytes, its offsets): as many rows as have size bytes together, one at least."""
    at, sizes = 0, column_bytes(column)[1]
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + size, side="right")) - 1)
        yield slice(at, to), *column_bytes(column.slice(at, to - at))
        at = to


def shingle_sets(column, k: int):
    """For each row its distinct shingles of k words as ascending unsigned 64-bit hashes; fewer words are one shingle, none is none."""
    at = 0
    n = len(column)
    sizes = column_bytes(column)[1]
    while at < n:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK, side="right")) - 1)
        raw, offsets = column_bytes(column.slice(at, to - at))
        h, rows = word_hashes(raw, offsets)
        parts = [mix(h, 11 + i) for i in range(k)]
        grams = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
        for i, p in enumerate(parts):
            grams += p[i : i + len(grams)]
        grams = mix(grams, 3)
        for a, b in zip(rows[:-1], rows[1:]):
            if b - a >= k:
                g = np.sort(grams[a : b - k + 1])
                keep = np.empty(len(g), dtype=bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                yield g[keep]
            elif b > a:
                whole = np.zeros(1, dtype=np.uint64)
                for i in range(b - a):
                    whole += parts[i][a + i]
                yield mix(whole, 100 + int(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)
        at = to
