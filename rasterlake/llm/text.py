"""Byte-level word and shingle hashing over Arrow string arrays.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.
All work is vectorised over the UTF-8 buffer; a text is never truncated. Working
memory is bounded by ``BLOCK`` bytes (or the longest word) times a small constant,
whatever a text's size. Words are told apart by a keyed 64-bit hash (SipHash, BLAKE2b),
which no pattern in the bytes makes collide. A null text has no words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
#: Words of up to this many bytes are hashed together by SipHash; longer ones by BLAKE2b, each for itself.
LONGEST = 71
#: The key of the words' hash: fixed, so that all tasks and runs agree.
_KEY = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_lean: list[bool] = []
#: What a worker keeps from task to task for tokens; it goes when the worker turns to words.
KEPT: dict = {}
#: Multipliers for the words of a shingle by place, and a seed for short texts by length.
_PLACE = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def lean() -> None:
    """Let a worker that is used again give large arrays back to the system when they are freed (glibc; else nothing)."""
    if not _lean:
        _lean.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            import ctypes

            c = ctypes.CDLL("libc.so.6")
            c.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD: larger arrays are mapped, and unmapped when freed
            c.mallopt(-8, 2)  # M_ARENA_MAX
        except (OSError, AttributeError):
            pass
        trim()


def trim() -> None:
    """Give freed memory back to the system (glibc; else nothing)."""
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def let_go() -> None:
    """Drop what a worker kept for other work: workers are used again by the next stages, beside the heap that the ones before filled."""
    if KEPT:
        KEPT.clear()
        trim()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b - np.uint8(9)) < 5)


def _sign(b: np.ndarray) -> np.ndarray:
    """ASCII bytes that are neither letters nor digits."""
    return ~((b >= 128) | (((b | np.uint8(32)) - np.uint8(97)) < 26) | ((b - np.uint8(48)) < 10))


def _lower(b: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return b + (((b - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _sip_round(v: list[np.ndarray]) -> None:
    a, b, c, d = v
    a = a + b
    b = _turn(b, 13) ^ a
    a = _turn(a, 32)
    c = c + d
    d = _turn(d, 16) ^ c
    a = a + d
    d = _turn(d, 21) ^ a
    c = c + b
    b = _turn(b, 17) ^ c
    v[:] = a, b, _turn(c, 32), d


def digests(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: tuple[int, int] = _KEY) -> np.ndarray:
    """64-bit hashes of spans of bytes: SipHash-1-3, all spans of one number of 8-byte blocks at a time; BLAKE2b beyond ``LONGEST`` bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    padded = np.zeros(len(b) + 8, dtype=np.uint8)
    padded[: len(b)] = b
    at_byte = np.ndarray((len(b) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    blocks = size >> 3
    first = [np.uint64(c ^ key[i % 2]) for i, c in enumerate((0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573))]
    for n in range(min(int(blocks.max(initial=-1)), LONGEST >> 3) + 1):
        own = np.flatnonzero(blocks == n)
        if not len(own):
            continue
        begin, spare = starts[own], (size[own] & 7).astype(np.uint64)
        v = [np.full(len(own), x) for x in first]
        for k in range(n + 1):
            m = at_byte[begin + 8 * k]
            if k == n:
                m = (m & ((np.uint64(1) << (spare << np.uint64(3))) - np.uint64(1))) | (np.uint64(8 * n << 56 & (1 << 64) - 1) + (spare << np.uint64(56)))
            v[3] = v[3] ^ m
            _sip_round(v)
            v[0] = v[0] ^ m
        v[2] = v[2] ^ np.uint64(0xFF)
        for _ in range(3):
            _sip_round(v)
        out[own] = v[0] ^ v[1] ^ v[2] ^ v[3]
    secret = b"".join(k.to_bytes(8, "little") for k in key)
    for i in np.flatnonzero(blocks > LONGEST >> 3):
        out[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return out


def secret_digests(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes under keys that no one knows: two multilinear hashes of 32 bits each.

    Two different spans collide with a chance of 2 ** -64 over the keys, whatever they hold;
    keys: 2 rows of random 64-bit numbers, two for each 8 bytes of the longest span and one more.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    padded = np.zeros(len(b) + 8, dtype=np.uint8)
    padded[: len(b)] = b
    at_byte = np.ndarray((len(b) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    blocks = np.maximum(size - 1, 0) >> 3
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    for n in range(int(blocks.max(initial=-1)) + 1):
        own = np.flatnonzero(blocks == n)
        begin, spare = starts[own], ((8 * (n + 1) - size[own]) * 8).astype(np.uint64)
        sums = [size[own].astype(np.uint64) * k[0] for k in keys]
        for i in range(n + 1):
            m = at_byte[begin + 8 * i]
            if i == n:
                m = np.where(spare < 64, (m << spare) >> spare, np.uint64(0))
            for s, k in zip(sums, keys):
                s += (m & low) * k[2 * i + 1]
                s += (m >> half) * k[2 * i + 2]
        out[own] = (sums[0] & ~low) | (sums[1] >> half)
    return out


def _block(b: np.ndarray, breaks: np.ndarray, gap=_space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of ``b``; a word never crosses a break."""
    filled = ~gap(b)
    before = np.zeros(len(b), dtype=bool)
    before[1:] = filled[:-1]
    before[breaks] = False
    starts = np.flatnonzero(filled & ~before)
    after = np.zeros(len(b), dtype=bool)
    after[:-1] = filled[1:]
    after[breaks[breaks > 0] - 1] = False
    ends = np.flatnonzero(filled & ~after) + 1
    return digests(_lower(b), starts, ends), starts, ends


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its values (null: empty)."""
    lean()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, gap=_space) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the place of its first (one more entry at the end)."""
    h, _, _, first = spans(column, gap)
    return h, first


def spans(column: pa.Array, gap=_space) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, with each word's byte start and end in the concatenated texts."""
    let_go()
    data, offsets = raw(column)
    hashes, starts, ends = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:
            near = offsets[np.searchsorted(offsets, to, "right") - 1]
            if near > at:
                to = int(near)
            else:  # one text is longer than a block: cut it at white space
                gaps = np.flatnonzero(gap(data[at:to]))
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:  # one word is longer than a block
                    own_end = int(offsets[np.searchsorted(offsets, at, "right")])
                    to = own_end
                    for p in range(at, own_end, BLOCK):
                        gaps = np.flatnonzero(gap(data[p : min(p + BLOCK, own_end)]))
                        if len(gaps):
                            to = p + int(gaps[0])
                            break
        lo, hi = np.searchsorted(offsets, [at, to])
        breaks = np.unique(offsets[lo:hi] - at)
        h, s, e = _block(data[at:to], breaks[breaks < to - at], gap)
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets)


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``words``, for runs of ASCII letters, digits and other characters beyond ASCII, all letters lower-cased."""
    return words(pc.utf8_lower(column), _sign)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    keep = np.empty(len(x), dtype=bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def kmers(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _PLACE[0]
    for j in range(1, k):
        out += h[j : j + n] * _PLACE[j]
    return mix(out)


def shingles(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; one for a shorter text; none without words."""
    h, first = words(column)
    runs = kmers(h, k)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n >= k:
            out.append(distinct(runs[a : b - k + 1]))
        elif n:
            out.append(mix((h[a:b] * _PLACE[:n]).sum(keepdims=True) + _PLACE[40 + n : 41 + n]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
