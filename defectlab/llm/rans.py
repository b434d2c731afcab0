"""Static range asymmetric numeral systems over token ids, as numpy does a step for all lanes at once.

A block holds whole documents. Its ids are dealt to ``LANES`` interleaved
coders that share one frequency table; every ``CHECKPOINT`` steps the decoder's
states and its place among the words are kept, so that a reader can start at
any checkpoint. A CRC of the ids closes the block.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 1024
CHECKPOINT = 256
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK32 = np.uint64(0xFFFFFFFF)


class Frequencies:
    """Counts of all ids scaled to ``2 ** SCALE_BITS``; every id that occurs keeps at least one slot.

    ``SCALE_BITS`` must leave a slot for every id: vocabularies up to half a
    million. Scaling is deterministic, so readers rebuild it from the counts.
    """

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.int64)
        total, slots = int(counts.sum()), 1 << SCALE_BITS
        if np.count_nonzero(counts) > slots // 2:
            raise ValueError("more distinct ids than the scale can hold")
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (slots / max(total, 1))).astype(np.int64)), 0)
        order = np.argsort(-freq, kind="stable")
        rest, at = slots - int(freq.sum()), 0
        while total and rest:  # what rounding left goes to, or comes from, the most frequent ids
            i = order[at]
            change = rest if rest > 0 else -min(-rest, max(0, int(freq[i]) - 1 - int(freq[i]) // 2))
            freq[i] += change
            rest -= change
            at = (at + 1) % len(order)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else np.zeros(0, np.uint64)
        self.slot_id = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> dict:
        """``words``: 32-bit words in the decoder's order; ``states`` and ``places`` at the checkpoints."""
        steps = -(-len(ids) // LANES)
        x = np.full(LANES, LOW, dtype=np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        for step in range(steps - 1, -1, -1):
            now = ids[step * LANES : (step + 1) * LANES]
            n = len(now)
            f, lane = self.freq[now], x[:n]
            full = lane >= (f << np.uint64(63 - SCALE_BITS))
            if full.any():
                words = (lane[full] & MASK32).astype(np.uint32)
                lane[full] >>= WORD
                out.append(words)
                written += len(words)
            q = lane // f
            x[:n] = (q << np.uint64(SCALE_BITS)) + (lane - q * f) + self.start[now]
            if step % CHECKPOINT == 0:
                marks.append((written, x.copy()))
        marks.reverse()
        return {
            "words": np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32),
            "states": np.concatenate([s for _, s in marks]) if marks else np.zeros(0, np.uint64),
            "places": np.array([written - w for w, _ in marks], dtype=np.int64),
        }

    def decode(self, block: dict, n: int, checkpoint: int = 0, to: int | None = None) -> np.ndarray:
        """Ids from the given checkpoint on, up to the checkpoint ``to`` or the end of the ``n`` ids."""
        first = checkpoint * CHECKPOINT
        last = -(-n // LANES) if to is None else min(to * CHECKPOINT, -(-n // LANES))
        x = block["states"][checkpoint * LANES : (checkpoint + 1) * LANES].copy()
        at = int(block["places"][checkpoint]) if len(block["places"]) else 0
        words, found = block["words"], np.empty(max(0, min(n, last * LANES) - first * LANES), dtype=np.uint32)
        mask = np.uint64((1 << SCALE_BITS) - 1)
        for step in range(first, last):
            m = min(LANES, n - step * LANES)
            lane = x[:m]
            slot = lane & mask
            ids = self.slot_id[slot]
            lane = self.freq[ids] * (lane >> np.uint64(SCALE_BITS)) + slot - self.start[ids]
            short = lane < LOW
            k = int(short.sum())
            if k:
                lane[short] = (lane[short] << WORD) | words[at : at + k].astype(np.uint64)
                at += k
            x[:m] = lane
            found[(step - first) * LANES : (step - first) * LANES + m] = ids
        return found


def checked(ids: np.ndarray, crc: int) -> np.ndarray:
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's ids do not have its checksum")
    return ids
