"""Static range asymmetric numeral system for token ids: blocks that are coded and decoded independently.

One frequency table, shared by all blocks, is scaled to 2 ** BITS. A block is coded in `LANES` interleaved lanes: token i
belongs to lane i mod LANES, and every step works on all lanes at once. A lane's state is a 64-bit integer of at least
2 ** 31 that gives off 32 bits at a time. Every `EVERY` steps a checkpoint keeps all states and the place in the data, so
a reader can start there, or several can share a block. A checksum covers the block's bytes, another the ids.

Block: magic "RNS1", then little-endian unsigned 32-bit integers: tokens n, words of data w, checkpoints c, CRC-32 of the
ids (each as 32 bits), CRC-32 of all that follows; then c checkpoints (32-bit place, LANES 64-bit states), the last of them
where decoding starts, and w 32-bit words in the order in which they were given off.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RNS1"
BITS = 20
LANES = 4096
EVERY = 128
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4s5I")


class Table:
    """Frequencies scaled to 2 ** BITS: every id that was counted keeps at least 1."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.float64)
        total, size = counts.sum(), 1 << BITS
        used = np.flatnonzero(counts)
        if len(used) > size:
            raise ValueError("more different ids than the table has places")
        freq = np.zeros(len(counts), np.int64)
        if len(used):
            freq[used] = np.maximum(1, np.floor(counts[used] / total * (size - len(used)))).astype(np.int64)
            freq[used[counts[used].argmax()]] += size - freq.sum()
        self.freq, self.start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.of_slot = np.repeat(np.arange(len(counts), dtype=np.int32), freq)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block from ids (unsigned 32-bit), all of which the table knows."""
    n = len(ids)
    steps, places = -(-n // LANES), ids.astype(np.intp)
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    at, marks = 0, []
    bits, half, top = np.uint64(BITS), np.uint64(32), np.uint64(63 - BITS)
    for t in range(steps - 1, -1, -1):  # the decoder runs the other way
        part = places[t * LANES : (t + 1) * LANES]
        x, f, c = state[: len(part)], table.freq.take(part), table.start.take(part)
        full = x >= f << top
        if full.any():
            out = x[full]
            words.append(out.astype(np.uint32))
            at += len(out)
            x = np.where(full, x >> half, x)
        q = x // f
        state[: len(part)] = (q << bits) + (x - q * f) + c
        if t % EVERY == 0:
            marks.append(struct.pack("<I", at) + state.astype("<u8").tobytes())
    data = b"".join(marks) + (np.concatenate(words).astype("<u4").tobytes() if words else b"")
    check = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
    return _HEAD.pack(MAGIC, n, at, len(marks), check, zlib.crc32(data)) + data


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or of the checkpoint intervals first to last (exclusive) only: EVERY * LANES ids each.

    Raises ValueError where the magic, a length or a checksum is wrong.
    """
    if len(block) < _HEAD.size:
        raise ValueError("a block is cut off")
    magic, n, count, marks, check, rest = _HEAD.unpack_from(block)
    size = 4 + 8 * LANES
    data = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or len(data) != marks * size + 4 * count or marks != -(-n // (LANES * EVERY)):
        raise ValueError("a block's header or length is wrong")
    if zlib.crc32(data) != rest:
        raise ValueError("a block's bytes don't match their checksum")
    whole = first == 0 and last is None
    last = marks if last is None else min(last, marks)
    words = np.frombuffer(data, "<u4", count, marks * size)
    steps = -(-n // LANES)
    out = np.empty(max(0, min(last * EVERY, steps) - first * EVERY) * LANES, np.uint32)
    bits, half, mask = np.uint64(BITS), np.uint64(32), np.uint64((1 << BITS) - 1)
    done = 0
    for k in range(first, last):
        mark = (marks - 1 - k) * size  # the encoder made the last interval's first
        at = struct.unpack_from("<I", data, mark)[0]
        state = np.frombuffer(data, "<u8", LANES, mark + 4).astype(np.uint64)
        for t in range(k * EVERY, min((k + 1) * EVERY, steps)):
            width = min(LANES, n - t * LANES)
            x = state[:width]
            slot = x & mask
            ids = table.of_slot.take(slot.view(np.int64))
            x = table.freq.take(ids) * (x >> bits) + slot - table.start.take(ids)
            low = x < LOW
            m = int(np.count_nonzero(low))
            if m:
                x[low] = (x[low] << half) | words[at - m : at]
                at -= m
            state[:width] = x
            out[done : done + width] = ids
            done += width
    out = out[:done]
    if whole and zlib.crc32(out.astype("<u4", copy=False)) != check:
        raise ValueError("a block's ids don't match their checksum")
    return out
