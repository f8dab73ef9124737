"""Vectorised text kernels shared by the operators of this subpackage.

Every kernel works on one contiguous UTF-8 buffer holding several documents
(`buf`, with `off[i]:off[i + 1]` the bytes of document i), so that a word costs
a few array operations instead of a Python object.  The character classes are
all ASCII, hence splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are handled in chunks of about so many bytes; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Word bytes of the `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` class.
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
RADIX = U64(0x9E3779B97F4A7C15)
#: Masks of the lowest 0 to 8 bytes.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def by_byte(table: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """The entries (of one byte) of a table of 256 for each byte of a buffer."""
    return np.frombuffer(buf.tobytes().translate(table.tobytes()), table.dtype)


def powers(n: int, base: np.uint64 = RADIX) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for pieces of a column, whole texts each."""
    buf, off = buffer_of(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a text's edge."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < n]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:] - 1
    edge = edge[edge >= 0]
    last[edge] = inside[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def load_blocks(padded: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The `size` (1 to 8) bytes from each position on, as little-endian numbers, out of aligned blocks of eight."""
    block, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    out = padded[block] >> shift
    out |= padded[block + 1] << (U64(64) - shift)  # a shift by 64 gives 0
    out &= LOW_BYTES[size]
    return out


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit content hash of each of the non-empty spans.

    A span is cut into blocks of eight bytes; each goes, with its place, through the
    finaliser before the sum, so that no arithmetic structure of a text (as with a
    polynomial modulo 2 ** 64) carries over to the hash.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    padded = np.zeros((len(buf) >> 3) + 2, "<u8")
    padded.view(np.uint8)[: len(buf)] = buf
    total = mix(load_blocks(padded, starts, np.minimum(lens, 8)) ^ mix(np.array([RADIX])))
    long = np.flatnonzero(lens > 8)
    if len(long):
        more = (lens[long] - 1) >> 3
        edge = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(edge, more) + 1
        at = np.repeat(starts[long], more) + (place << 3)
        blocks = load_blocks(padded, at, np.minimum(np.repeat(ends[long], more) - at, 8))
        total[long] += np.add.reduceat(mix(blocks ^ mix((place + 1).astype(np.uint64) * RADIX)), edge)
    return mix(total + lens.astype(np.uint64))


def words(buf: np.ndarray, off: np.ndarray, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and each text's range of words."""
    starts, ends = spans(by_byte(word_bytes, buf), off)
    return starts, ends, hash_spans(buf, starts, ends), np.searchsorted(starts, off)


def owners(ranges: np.ndarray) -> np.ndarray:
    """For each word the number of its text, from the texts' ranges."""
    return np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))


def code_point_positions(buf: np.ndarray) -> np.ndarray:
    """For each byte position 0 .. len(buf) the number of code points that start before it."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def as_int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
