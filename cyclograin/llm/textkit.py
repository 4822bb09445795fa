"""Words, hashes and bounded batches shared by the text operators.

Texts reach Python as Arrow batches and are worked off in chunks of a few megabytes, whatever
the batch size of the session is. Inside a chunk the bytes of all texts lie in one buffer
and words are found and hashed with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
SLICE = 1 << 17
_R = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)
_WORD_R = 0xC2B2AE3D27D4EB4F
_WORD_R_INV = pow(_WORD_R, -1, 1 << 64)


def byte_table(separators: bytes) -> np.ndarray:
    """True for every byte that belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: words are what lies between ASCII white space
SPACE_WORDS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: words are digits, lower-case letters and all non-ASCII characters
ALNUM_WORDS = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POW: list[np.ndarray] = []


def _byte_powers() -> list[np.ndarray]:
    if not _POW:
        _POW.extend((powers(_R, SLICE), powers(_R_INV, SLICE)))
    return _POW


def _long_word(buf: np.ndarray) -> int:
    up, _ = _byte_powers()
    total, scale, step = 0, 1, pow(_R, SLICE, 1 << 64)
    for at in range(0, len(buf), SLICE):
        part = buf[at : at + SLICE].astype(np.uint64) + np.uint64(1)
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * scale
        scale = scale * step % (1 << 64)
    return total % (1 << 64)


def word_spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end positions of the words of a byte buffer."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = table[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, equal for equal bytes wherever they stand.

    A polynomial over the bytes, taken from running sums over slices of bounded length.
    """
    up, down = _byte_powers()
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + SLICE, side="right"))
        if j <= i:
            out[i] = _long_word(buf[base : int(ends[i])])
            i += 1
            continue
        s, e = starts[i:j] - base, ends[i:j] - base
        part = buf[base : base + int(e[-1])].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=run[1:])
        out[i:j] = (run[e] - run[s]) * down[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


class Windows:
    """Hashes of any run of consecutive words, from running sums over the words' hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.down = powers(_WORD_R_INV, n)
        self.run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(_WORD_R, n), out=self.run[1:])

    def of(self, length: int) -> np.ndarray:
        n = len(self.down) - length + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return mix((self.run[length:] - self.run[:n]) * self.down[:n])


def chunks(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut Arrow batches into pieces with at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        sizes = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else []
        at = 0
        while at < len(col):
            end = max(at + 1, int(np.searchsorted(sizes, int(sizes[at]) + limit, side="right")) - 1)
            yield batch.slice(at, end - at), col.slice(at, end - at).to_pylist()
            at = end


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One lower-cased (A-Z only) buffer of all texts and the place where each begins.

    A line feed follows every text, so no word reaches into the next one.
    """
    data = b"\n".join([t or b"" for t in texts] + [b""]).lower()
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(data, dtype=np.uint8), np.concatenate(([0], np.cumsum(lengths)))


def word_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> pa.Array:
    """The words of a buffer as one Arrow array, so that Arrow counts and looks them up by their bytes."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    data = buf[table[buf]]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def decoded(raw: bytes | None) -> str:
    """A text as Python characters; bytes that are no UTF-8 become replacement characters."""
    return (raw or b"").decode("utf-8", "replace")
