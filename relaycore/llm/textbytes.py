"""Word splitting and hashing over UTF-8 bytes with numpy.

Words are runs of bytes outside a separator class, so no Python string is made
per word.  Multi-byte characters consist of bytes >= 0x80 only, which no ASCII
separator class contains.
"""

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Hash tables are built for runs of this many bytes; longer words enlarge them.
_SEGMENT = 1 << 20

_bytes = np.arange(256)
#: `[^\x20\x09-\x0D]+`
SPACE_WORD = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM_WORD = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
#: bytes.translate table that lower-cases A-Z and blanks what is no ALNUM_WORD byte.
ALNUM_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if ALNUM_WORD[b] else 0x20 for b in range(256))

_tables = {"power": np.ones(1, U64), "inverse": np.ones(1, U64)}


def _power_tables(n):
    if len(_tables["power"]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        for name, base in (("power", _BASE), ("inverse", _BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=U64)
    return _tables["power"], _tables["inverse"]


def mix(h):
    """A bijective finaliser that spreads a uint64 array over all bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def as_array(data):
    return np.frombuffer(data, np.uint8)


def word_spans(arr, is_word):
    """Start and end offsets of the words of a uint8 array."""
    flags = np.zeros(len(arr) + 2, np.int8)
    flags[1:-1] = is_word[arr]
    steps = np.diff(flags)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def span_hashes(arr, starts, ends):
    """A uint64 hash of each span; equal bytes give equal hashes in every document."""
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + _SEGMENT, "right")))
        part = arr[base : int(ends[hi - 1])]
        power, inverse = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def shingle_hashes(words, n):
    """Hashes of the n-word shingles of a word-hash array; shorter texts are one shingle, none without words."""
    if not len(words):
        return np.empty(0, U64)
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, U64)
    for k in range(n):
        out = out * U64(0x9FB21C651E98DF25) + words[k : k + len(out)]
    return mix(out + U64(n))


def merge_intervals(starts, ends):
    """Union of half-open intervals as sorted disjoint runs; touching runs join."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return starts[new], reach[np.concatenate((new[1:] - 1, [len(starts) - 1]))]
